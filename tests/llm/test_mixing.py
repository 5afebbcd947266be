import random
from fractions import Fraction

import pytest

from scriptoria.llm.mixing import mix_sources

DDL = "doc_id long, source string, mix_slot string, m_source int"


def rows(n=3000, seed=1):
    rng = random.Random(seed)
    return [(i, rng.choice(["big"] * 6 + ["mid", "mid", "small", None, "", "x" if rng.random() < 0.1 else "mid"]), "clash", 1) for i in range(n)]


def brute_windows(found, block_rows):
    """Every block lies within its window, in each period, and blocks take all slots once."""
    blocks = {}
    for r in found:
        blocks.setdefault((r.source, r.mix_block), set()).add((r.mix_slot, r.mix_start, r.mix_release, r.mix_deadline, r.mix_units, r.mix_period))
    assert all(len(v) == 1 for v in blocks.values())
    slots = sorted(next(iter(v))[0] for v in blocks.values())
    assert slots == list(range(len(slots)))
    return {k: next(iter(v)) for k, v in blocks.items()}


@pytest.mark.parametrize("weights", [None, {"big": 3, "mid": 2, "small": 1}, {"small": 1}, {}])
def test_windows_and_deviation(spark, weights):
    data = rows()
    found = mix_sources(spark.createDataFrame(data, DDL), weights=weights, block_rows=7, buckets=16).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(data)))
    assert len({r.mix_position for r in found}) == len(data)
    phases = {}
    for (source, _), (slot, start, release, deadline, units, period) in brute_windows(found, 7).items():
        assert release <= slot - start < deadline
        phases.setdefault((start, period), []).append((slot - start, source, units))
    for (_, period), inside in phases.items():
        for source, units in {x[1:] for x in inside}:
            mine = [x[0] for x in inside if x[1] == source]
            # a source that is used up at the end of a phase has its share until then
            assert all(abs(Fraction(t * units, period) - sum(m < t for m in mine)) < 1 for t in range(len(inside) + 1))
    if weights == {"big": 3, "mid": 2, "small": 1}:
        shares = {r.source: r.mix_units / r.mix_period for r in found if r.mix_start == 0}
        assert [shares[x] for x in ("big", "mid", "small")] == pytest.approx([3 / 6, 2 / 6, 1 / 6]) and shares[None] < 1e-9 if None in shares else True


def test_deterministic_whatever_the_partitions(spark):
    df = spark.createDataFrame(rows(400), DDL)
    one = {(r.doc_id, r.mix_position) for r in mix_sources(df).collect()}
    assert one == {(r.doc_id, r.mix_position) for r in mix_sources(df.repartition(9)).collect()}


def test_empty_single_null_and_repeated(spark):
    df = spark.createDataFrame([(None, None, "a", 1), (1, None, "a", 1), (1, None, "a", 1)], DDL)
    assert mix_sources(df.limit(0)).collect() == []
    assert sorted(r.mix_position for r in mix_sources(df).collect()) == [0, 1, 2]
    assert mix_sources(df).columns[:3] == ["doc_id", "source", "m_source"]


def test_too_many_sources(spark):
    with pytest.raises(ValueError, match="sources"):
        mix_sources(spark.createDataFrame([(i, str(i), "a", 1) for i in range(1001)], DDL))
