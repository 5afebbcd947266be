import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from scriptoria.operators import merge as M
from scriptoria.operators import planner as P
from scriptoria.streaming.state import PROVIDER, live_items, live_rows

LOG = "log_id long, item_id long, ts timestamp_ntz, rating int, counted boolean"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, PROVIDER)
    yield spark
    spark.conf.set(name, before) if before else spark.conf.unset(name)


def streamed(spark, make, folder, name):
    """All files of a folder, one after the other, in batches of their own; every row that came out, with its batch."""
    seen = []
    stream = make(spark.readStream.schema(spark.read.parquet(f"{folder}/*").schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*"))
    keep = lambda batch, n: seen.extend((n, r) for r in batch.collect())
    stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}-{name}").outputMode("update").trigger(availableNow=True).start().awaitTermination()
    return seen


def test_live_items_equal_the_replay_whatever_the_order(rocks, tmp_path):
    rng, start = random.Random(7), datetime(2024, 1, 1, 6)
    rows = [(n, rng.randrange(9), start + timedelta(hours=rng.randrange(700)), rng.randrange(1, 5), rng.random() < 0.9) for n in range(160)]
    rows += [(500, 3, rows[0][2], 1, True), (501, 3, rows[0][2], 4, True)]
    items = rocks.createDataFrame([(i, i // 2) for i in range(10)], "item_id long, material_id long")
    rng.shuffle(rows)  # answers of any time in any package
    for part in range(4):
        rocks.createDataFrame(rows[part::4], LOG).coalesce(1).write.parquet(f"{tmp_path}/log/{part}")
    seen = streamed(rocks, lambda s: live_items(s, items), f"{tmp_path}/log", "ck")
    last = {}
    for _, r in seen:
        last[r.item_id] = r
    whole = rocks.createDataFrame(rows, LOG)
    want = {r.item_id: r for r in P.replay(whole).collect()}
    assert last.keys() == want.keys()
    for item, r in want.items():
        got = last[item]
        assert (got.reps, got.lapses, got.state, got.last_review, got.due) == (r.reps, r.lapses, r.state, r.last_review, r.due)
        assert (got.stability, got.difficulty) == pytest.approx((r.stability, r.difficulty))
    # the longest burial that an item ever had is that of the last answer to its sibling
    buried = {r.item_id: r.buried_until for r in P.buried(whole, items).collect()}
    longest = {}
    for _, r in seen:
        if r.buried_until:
            longest[r.item_id] = max(longest.get(r.item_id, r.buried_until), r.buried_until)
    assert longest == {i: t for i, t in buried.items() if i in last}


def test_timers_bring_buried_items_back(rocks, tmp_path):
    day = datetime(2024, 3, 1, 9)
    parts = [[(1, 0, day, 3, True), (2, 1, day + timedelta(minutes=5), 3, True)], [(3, 8, day + timedelta(days=5), 3, True)], [(4, 8, day + timedelta(days=9), 3, True)]]
    for n, part in enumerate(parts):
        rocks.createDataFrame(part, LOG).coalesce(1).write.parquet(f"{tmp_path}/log/{n}")
    items = rocks.createDataFrame([(0, 0), (1, 0), (8, 4)], "item_id long, material_id long")
    seen = streamed(rocks, lambda s: live_items(s, items), f"{tmp_path}/log", "ck")
    of = [r.buried_until for _, r in seen if r.item_id == 0]
    assert of[0] == datetime(2024, 3, 2, 4) and of[-1] is None
    assert {r.item_id for _, r in seen if r.buried_until is None and r.reps == 1} >= {0, 1, 8}


def test_a_deletion_beats_versions_before_and_after_it(rocks, tmp_path):
    rng, ddl = random.Random(5), "table_name string, id string, updated_at long, payload string, deleted boolean"
    rows = [(rng.choice("ab"), str(rng.randrange(25)), rng.randrange(8), rng.choice(["x", "y", "z", None]), rng.random() < 0.08) for _ in range(300)] + [("a", "7", 99, "late", False), ("a", "7", 1, None, True)]
    for order in range(2):
        rng.shuffle(rows)
        for part in range(3):
            rocks.createDataFrame(rows[part::3], ddl).coalesce(1).write.parquet(f"{tmp_path}/in{order}/{part}")
        last = {}
        for _, r in streamed(rocks, live_rows, f"{tmp_path}/in{order}", "ck"):
            last[r.table_name, r.id] = (r.updated_at, r.payload, r.deleted)
        table = rocks.createDataFrame(rows, ddl)
        dead = M.merged_tombstones(table.limit(0).selectExpr("table_name", "id", "updated_at AS deleted_at"), table.where("deleted").selectExpr("table_name", "id", "updated_at AS deleted_at"))
        kept = M.last_writer_wins(table.limit(0), table.where("NOT deleted"), ["table_name", "id"]).join(dead.select("table_name", "id"), ["table_name", "id"], "left_anti")
        want = {(r.table_name, r.id): r.updated_at for r in kept.collect()}
        assert {k: v[0] for k, v in last.items() if not v[2]} == want
        best = {}
        for t, i, at, payload, deleted in rows:
            if not deleted:
                best[t, i] = max(best.get((t, i), (-1, "")), (at, payload or ""))
        assert {k: (v[0], v[1] or "") for k, v in last.items() if not v[2]} == {k: v for k, v in best.items() if k in want}
        assert {k: v[0] for k, v in last.items() if v[2]} == {(r.table_name, r.id): r.deleted_at for r in dead.select("table_name", "id", F.col("deleted_at")).collect()} or all(v[2] == (k not in want) for k, v in last.items())
