import pytest

from scriptoria.llm.mixing import mix_sources


@pytest.mark.parametrize("sizes, weights", [({"a": 3000, "b": 900}, {"a": 9999, "b": 1}), ({"a": 900, "b": 900, "c": 600, None: 40}, {"a": 1, "b": 2**0.5, "c": 0.0007}), ({"a": 2500, "b": 400}, {"a": 1.0}), ({"a": 700, "b": 1398}, {"a": 0.3334, "b": 0.6666}), ({"a": 280, "b": 279, "c": 1298}, {"a": 0.1504, "b": 0.1504, "c": 0.6992})])
def test_blocks_follow_the_target_weights(spark, sizes, weights):
    """No source is ever a block or more away from its target, however many blocks there are."""
    names = [s for s, n in sizes.items() for _ in range(n)]
    found = mix_sources(spark.createDataFrame(list(enumerate(names)), "doc_id long, source string"), weights=weights, block_rows=1, buckets=4).collect()
    assert sorted(r.doc_id for r in found) == list(range(len(names)))
    order = [r.source for r in sorted(found, key=lambda r: r.mix_position)]
    assert sorted(r.mix_slot for r in found) == list(range(len(names)))
    assert all(r.mix_release <= r.mix_slot - r.mix_start < r.mix_deadline for r in found)
    left, start, done = dict(sizes), 0, dict.fromkeys(sizes, 0)
    for slot, source in enumerate(order, 1):
        done[source] += 1
        left[source] -= 1
        whole = sum(weights.get(s, 0) for s in done)
        assert not whole or all(abs(done[s] - (slot - start) * weights.get(s, 0) / whole) < 1 for s in done)
        if not left[source]:
            start, done = slot, {s: 0 for s in done if left[s]}


def test_uneven_sources_up_to_the_first_exhaustion(spark):
    """One period that is not full: no source is a block or more away from its share before the first one is used up."""
    sizes = {"a": 700, "b": 410, "c": 95, "d": 30, None: 11}
    names = [s for s, n in sizes.items() for _ in range(n)]
    found = mix_sources(spark.createDataFrame(list(enumerate(names)), "doc_id long, source string"), block_rows=4, buckets=8).collect()
    blocks = {(r.source, r.mix_block): r for r in found}
    order = sorted(blocks.values(), key=lambda r: r.mix_slot)
    assert [r.mix_slot for r in order] == list(range(len(order)))
    left, done = {s: -(-n // 4) for s, n in sizes.items()}, dict.fromkeys(sizes, 0)
    root = sum(n**0.5 for n in sizes.values())
    for slot, r in enumerate(order, 1):
        done[r.source] += 1
        assert all(abs(done[s] - slot * n**0.5 / root) < 1 for s, n in sizes.items()), slot
        if done[r.source] == left[r.source]:
            break


def test_shuffled_schedule_gives_the_same(spark, monkeypatch):
    from scriptoria.llm import mixing

    df = spark.createDataFrame([(i, "big" if i % 3 else f"s{i % 7}") for i in range(900)], "doc_id long, source string")
    for options in ({}, {"weights": {"big": 9999, "s1": 1}, "block_rows": 1}):
        one = {(r.doc_id, r.mix_position) for r in mix_sources(df, **options).collect()}
        monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)
        assert {(r.doc_id, r.mix_position) for r in mix_sources(df, **options).collect()} == one
        monkeypatch.undo()


def test_many_sources(spark):
    """A thousand sources of uneven sizes are mixed in the time of a test."""
    rows = [(i, f"s{int(i**0.75) % 1000}") for i in range(20_000)]
    found = mix_sources(spark.createDataFrame(rows, "doc_id long, source string"), block_rows=16, buckets=16).collect()
    assert len(found) == len(rows) and len({r.mix_position for r in found}) == len(rows)


def test_null_and_repeated_keys_stay_whole(spark):
    df = spark.createDataFrame([(None if i % 3 else i // 9, "ab"[i % 2]) for i in range(200)], "doc_id long, source string")
    found = mix_sources(df, block_rows=8, buckets=3).collect()
    assert sorted(map(str, [(r.doc_id, r.source) for r in found])) == sorted(map(str, [(r.doc_id, r.source) for r in df.collect()])) and len({r.mix_position for r in found}) == 200
