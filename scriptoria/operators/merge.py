"""Merging replicas: the last writer wins, deletes win over all, children follow their parents, twins become one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_writer_wins(base: DataFrame, incoming: DataFrame, keys: list[str], stamp: str = "updated_at") -> DataFrame:
    """One row for each key: the incoming one where it is new or strictly later. Of several incoming rows of a key the
    latest counts, of equally late ones always the same, by a hash of all columns. Merging the same rows again changes nothing."""
    both = base.withColumn("own", F.lit(1)).unionByName(incoming.withColumn("own", F.lit(0)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(stamp).desc_nulls_last(), F.desc("own"), F.xxhash64(*sorted(base.columns))))
    return both.withColumn("place", place).where("place = 1").drop("own", "place")


def merged_tombstones(base: DataFrame, incoming: DataFrame) -> DataFrame:
    """Deletions by (table_name, id): the first that was recorded stays."""
    return base.unionByName(incoming).groupBy("table_name", "id").agg(F.min("deleted_at").alias("deleted_at"))


def without_deleted(rows: DataFrame, tombstones: DataFrame, key: str, table_name: str) -> DataFrame:
    """A deleted row does not come back, however late its update."""
    gone = tombstones.where(F.col("table_name") == table_name).select(F.col("id").alias("gone"))
    return rows.join(gone, rows[key] == gone.gone, "left_anti")


def without_orphans(rows: DataFrame, parents: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """Rows of which every parent (frame, its key, the rows' column) is there; a null reference needs none."""
    for parent, key, column in parents:
        there = parent.select(F.col(key).alias("parent_key")).distinct()
        free = rows.where(F.col(column).isNull())
        rows = rows.where(F.col(column).isNotNull()).join(there, F.col(column) == F.col("parent_key"), "left_semi").unionByName(free)
    return rows


def resolve_twins(base: DataFrame, incoming: DataFrame, natural: list[str], key: str, order: list[str]) -> DataFrame:
    """Rows that two replicas made for one thing: per natural key the row that wins (its id is survivor) and the ids that
    become it. The incoming row wins if it is strictly greater by `order`, compared column by column, nulls least."""
    rank: list[Column] = [F.col(c).desc_nulls_last() for c in order]
    both = base.withColumn("own", F.lit(1)).unionByName(incoming.withColumn("own", F.lit(0)))
    w = Window.partitionBy(*natural).orderBy(*rank, F.desc("own"), key)
    return both.withColumn("survivor", F.first(key).over(w)).select(*natural, key, "survivor", "own")


def remapped(log: DataFrame, twins: DataFrame, key: str) -> DataFrame:
    """Log rows under the surviving twin's id."""
    to = twins.where(F.col(key) != F.col("survivor")).select(F.col(key).alias("old_id"), "survivor").distinct()
    return log.join(to, log[key] == to.old_id, "left").withColumn(key, F.coalesce("survivor", key)).drop("old_id", "survivor")


def referenced_only(rows: DataFrame, references: DataFrame, key: str, column: str) -> DataFrame:
    """Rows that something refers to: what a content package takes along."""
    return rows.join(references.select(F.col(column).alias("used")), rows[key] == F.col("used"), "left_semi")


def newest_by(rows: DataFrame, keys: list[str], stamp: str, *more: str) -> DataFrame:
    """The newest row of each key, as a cache lookup takes it."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(stamp).desc(), *more))
    return rows.withColumn("place", place).where("place = 1").drop("place")


def changed_fingerprints(fields: DataFrame, known: DataFrame, key: str, item: str) -> DataFrame:
    """Keys whose set of items differs from the fingerprint that was stored, or was never stored."""
    now = fields.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.col(item).cast("string"))), ","), 256).alias("fingerprint"))
    return now.join(known.select(key, F.col("fingerprint").alias("old")), key, "left").where(~F.col("fingerprint").eqNullSafe(F.col("old"))).select(key, "fingerprint")
