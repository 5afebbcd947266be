"""Streaming forms of batch queries: sessions, an inbox of replica files, and duplicates that come late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from scriptoria.operators.merge import last_writer_wins


def study_sessions(events: DataFrame, user: str = "user_id", ts: str = "ts", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Runs of a user's events with less than `gap` between neighbours; works on streams and tables. A stream in append
    mode gives a session once the watermark has passed its end."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp"))
    rows = rows.withWatermark(ts, late) if rows.isStreaming else rows
    out = rows.groupBy(F.session_window(ts, gap).alias("w"), user).agg(F.count("*").alias("answers"))
    return out.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "answers")


def first_of_each(events: DataFrame, key: str, ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """One row for each key; a stream remembers keys only as long as duplicates may come. Of a table's rows it is the first by
    time, of equal times always the same."""
    if not events.isStreaming:
        place = F.row_number().over(Window.partitionBy(key).orderBy(ts, F.xxhash64(*sorted(events.columns))))
        return events.withColumn("first_place", place).where("first_place = 1").drop("first_place")
    return events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def merge_inbox(spark: SparkSession, inbox: str, schema: StructType | str, keys: list[str], state: str, checkpoint: str) -> StreamingQuery:
    """Merge replica files as they arrive: each batch and the state so far become a new state folder, and a pointer to it
    is written last. A batch that runs again after a failure writes the same folder again. Files that were seen are kept
    in the checkpoint."""

    def merge(batch: DataFrame, number: int) -> None:
        base = read_state(spark, state, batch.schema)
        out = last_writer_wins(base, batch, keys)
        out.write.mode("overwrite").parquet(f"{state}/v{number:08d}")
        spark.createDataFrame([(number,)], "number long").coalesce(1).write.mode("append").parquet(f"{state}/log")

    stream = spark.readStream.schema(schema).json(inbox)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_state(spark: SparkSession, state: str, schema: StructType) -> DataFrame:
    """The newest merged state, or an empty frame before the first."""
    log = spark.read.schema("number long").option("ignoreMissingFiles", True)
    try:
        last = log.parquet(f"{state}/log").agg(F.max("number")).head()[0]
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        last = None
    return spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{state}/v{last:08d}")
