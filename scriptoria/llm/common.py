"""What several corpus operators share: shared-folder tables, fresh names, text functions run in Arrow batches."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of text after which a Python stage hands a batch back, so that long texts do not pile up in a worker.
BATCH_BYTES = 8_000_000
#: Rows from which the bounds between shards are taken.
SAMPLE_ROWS = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share. Where that is unset, a temporary folder of
    this machine on a local master only: elsewhere executors would not see it, so that is a ValueError."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/scriptoria/{uuid.uuid4().hex}"


def delete_at_exit(spark: SparkSession, path: str) -> None:
    """The folder goes when the driver's JVM ends, if nothing has deleted it before."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)


def delete_folder(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


#: Where scratch() notes the folders that cut() writes.
_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that cut() writes inside are deleted at the end, but for those it is told to keep."""
    made: list[str] = []
    before = _noted.set(made)
    try:
        yield
    finally:
        _noted.reset(before)
        for path in made:
            delete_folder(spark, path)


def cut(df: DataFrame, name: str = "cut", keep: bool = False, group_bytes: int | None = None) -> DataFrame:
    """Write a frame as a Parquet table in the shared folder and read it again: its lineage ends there, and a lost executor
    loses nothing of it. The table is deleted by drop_cut(), at the end of a scratch() around it unless kept, or with the
    driver's end. group_bytes is the size of the table's row groups, of which tasks hold one in memory."""
    spark, folder = df.sparkSession, shared_dir(df.sparkSession)
    path = f"{folder}/{name}"
    df.write.options(**({"parquet.block.size": group_bytes} if group_bytes else {})).parquet(path)
    delete_at_exit(spark, folder)
    if not keep and (noted := _noted.get()) is not None:
        noted.append(folder)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a table that cut() wrote."""
    spark = df.sparkSession
    for file in df.inputFiles()[:1]:
        folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name, with underscores before it as long as the frame has such a column."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def fold_of(key: str | Column, folds: int) -> Column:
    """crc32 of the key as text, modulo the number of folds; null for a null key."""
    return F.pmod(F.crc32((F.col(key) if isinstance(key, str) else key).cast("string")), F.lit(folds))


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows at most, chosen by a hash of the key: the same rows in every run and on every cluster."""
    n = df.count()
    if n <= most:
        return df
    grain = 1_000_000
    return df.where(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(grain)) < int(grain * most / n))


#: Bytes that a shard should have, and the shards that there are at most: beyond that shards grow.
SHARD_BYTES, MOST_SHARDS = 16_000_000, 50_000
#: A place in an order: 0 or 1 as nulls come last or first, the number, and what parts rows of one number.
PLACE = "struct<flag:int,number:bigint,tie:string>"


def shard_of(key: Column, bounds: list) -> Column:
    """The number of bounds that are at most the key, by binary search; null keys come after all others. Bounds are ints or,
    for keys of type PLACE, tuples (flag, number, tie)."""
    if not bounds:
        return F.lit(0)
    kind = "array<bigint>" if isinstance(bounds[0], int) else f"array<{PLACE}>"
    rows = bounds if isinstance(bounds[0], int) else [dict(zip(("flag", "number", "tie"), b, strict=True)) for b in bounds]
    table, steps = F.from_json(F.lit(json.dumps(rows)), kind), len(bounds).bit_length()  # one constant, whatever its length

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s.lo + s.hi) / 2).cast("int")
        low = F.get(table, middle) <= key
        open_ = s.lo < s.hi
        return F.struct(F.when(open_ & low, middle + 1).otherwise(s.lo).alias("lo"), F.when(open_ & ~low, middle).otherwise(s.hi).alias("hi"))

    found = F.aggregate(F.sequence(F.lit(0), F.lit(steps)), F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi")), halve, lambda s: s.lo)
    return F.coalesce(F.when(key.isNotNull(), found), F.lit(len(bounds)))


def place_of(key: Column, tie: Column, nulls_first: bool = False) -> Column:
    """A long key's place in ascending order, rows of one key by tie."""
    flag = key.isNotNull() if nulls_first else key.isNull()
    return F.struct(flag.cast("int").alias("flag"), F.coalesce(key, F.lit(0)).cast("long").alias("number"), F.coalesce(tie, F.lit("")).alias("tie")).cast(PLACE)


def shard_bounds(rows: DataFrame, shards: int | None = None, shard_bytes: int = SHARD_BYTES) -> list[tuple]:
    """Places that cut the rows (place, size in bytes) into ranges of about shard_bytes, or into about `shards` ranges of
    equal bytes. Rows of one key are cut apart by their ties; only rows with both in common always stay together.

    Bounds come from a sample that a hash of the place picks, so they depend on the rows alone. Its rows are summed up by
    place before they come to the driver: a place that very many rows share is one of them.
    """
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).head()
    shards = shards or min(MOST_SHARDS, -(-total // shard_bytes))
    if shards < 2:
        return []
    most = max(SAMPLE_ROWS, 20 * shards)
    picked = rows if n <= most else rows.where(F.pmod(F.xxhash64(F.lit("sample"), "place"), F.lit(1_000_000)) < max(1, int(1_000_000 * most / n)))
    sample = sorted((*r.place, r["size"]) for r in picked.groupBy("place").agg(F.sum("size").alias("size")).collect())
    whole, seen, bounds = sum(x[-1] for x in sample), 0, []
    for *place, size in sample:
        # a bound stands before the place with which a range would go over its share
        if seen and (len(bounds) + 1) * whole < (seen + size) * shards and len(bounds) + 1 < shards:
            bounds.append(tuple(place))
            while (len(bounds) + 1) * whole < seen * shards and len(bounds) + 1 < shards:
                shards -= 1  # one place filled several ranges
        seen += size
    return bounds


def with_texts_mapped(
    df: DataFrame, text_col: str, keep: Sequence[str], make: Callable[[], Callable], fields: Sequence[tuple[str, T.DataType]], batch_bytes: int = BATCH_BYTES
) -> DataFrame:
    """keep's columns and, from each row's text, the fields.

    make() runs once in a task and gives a function from str or None to a tuple of the fields' values. Columns travel
    under internal names, so clashing or repeated names do no harm; a field replaces a kept column of its name.
    """
    keep = [c for c in keep if c not in {n for n, _ in fields}]
    narrow = df.select(*[df[c].alias(f"k{i}") for i, c in enumerate(keep)], df[text_col].cast("string").alias("t"))
    inner = T.StructType([*narrow.schema.fields[:-1], *[T.StructField(f"f{i}", kind) for i, (_, kind) in enumerate(fields)]])
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow, width = to_arrow_schema(inner), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            start, size, values = 0, 0, []

            def flush(start, values, batch=batch):
                kept = [batch.column(i).slice(start, len(values)).cast(arrow.field(i).type) for i in range(width)]
                made = [pa.array([v[j] for v in values], arrow.field(width + j).type) for j in range(len(fields))]
                return pa.RecordBatch.from_arrays([*kept, *made], schema=arrow)

            for text in batch.column(width):
                text = text.as_py()
                values.append(work(text))
                size += len(text or "")
                if size >= batch_bytes:
                    yield flush(start, values)
                    start, size, values = start + len(values), 0, []
            if values:
                yield flush(start, values)

    return narrow.mapInArrow(run, inner).toDF(*keep, *[n for n, _ in fields])
