import json

from scriptoria.operators.merge import last_writer_wins
from scriptoria.streaming.live import first_of_each, merge_inbox, read_state, study_sessions

EVENTS = "/root/testdata/sf0.001/events.parquet"


def drained(df, name, spark, tmp_path):
    q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).collect()


def test_sessions_stream_agrees_with_batch(spark, tmp_path):
    table = spark.read.parquet(EVENTS)
    table.repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    batch = {tuple(r) for r in study_sessions(table).collect()}
    live = {tuple(r) for r in drained(study_sessions(stream), "sessions", spark, tmp_path)}
    assert live <= batch and len(live) > 0.9 * len(batch)  # the last sessions are still open


def test_duplicates(spark, tmp_path):
    table = spark.read.parquet(EVENTS)
    table.unionByName(table).repartition(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(table.schema).parquet(f"{tmp_path}/in")
    assert len(drained(first_of_each(stream, "event_id"), "firsts", spark, tmp_path)) == table.count() == first_of_each(table.unionByName(table), "event_id").count()


def test_inbox_agrees_with_one_merge(spark, tmp_path):
    ddl, rows = "k long, v string, updated_at long", []
    (tmp_path / "in").mkdir()
    for n in range(3):
        part = [{"k": k, "v": f"{n}-{k}", "updated_at": (k * 7 + n * 5) % 11} for k in range(n, 20, n + 1)]
        rows += part
        (tmp_path / "in" / f"{n}.json").write_text("\n".join(map(json.dumps, part)))
        merge_inbox(spark, f"{tmp_path}/in", ddl, ["k"], f"{tmp_path}/state", f"{tmp_path}/ck").awaitTermination()
    got = {r.k: r.updated_at for r in read_state(spark, f"{tmp_path}/state", spark.createDataFrame([], ddl).schema).collect()}
    empty = spark.createDataFrame([], ddl)
    want = {r.k: r.updated_at for r in last_writer_wins(empty, spark.createDataFrame([tuple(r.values()) for r in rows], ddl), ["k"]).collect()}
    assert got == want
