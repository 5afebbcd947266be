"""Packages: the tables of a replica as compressed JSON with a manifest, written and read by Spark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT, VERSION = "scriptoria-package", 1
# Settings that belong to a device and do not travel.
DEVICE_SETTINGS = ("ai", "external", "device")


def write_package(tables: Mapping[str, DataFrame], path: str, kind: str) -> None:
    """One folder of gzipped JSON for each table; the manifest comes last, so a folder without one is no package."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("compression", "gzip").option("ignoreNullFields", False).json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    rows = [(FORMAT, VERSION, kind, name, df.schema.json()) for name, df in tables.items()]
    spark.createDataFrame(rows, "format string, version int, kind string, name string, schema string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def read_package(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that the manifest names, with its schemas; a newer version is refused."""
    from pyspark.sql.types import StructType
    import json

    listed = spark.read.schema("format string, version int, kind string, name string, schema string").json(f"{path}/manifest").collect()  # a row for each table
    if not listed or any(r.format != FORMAT for r in listed):
        raise ValueError("no package")
    if max(r.version for r in listed) > VERSION:
        raise ValueError("the package is from a newer version")
    return {r.name: spark.read.schema(StructType.fromJson(json.loads(r.schema))).json(f"{path}/{r.name}") for r in listed}


def exported(tables: Mapping[str, DataFrame], kind: str) -> dict[str, DataFrame]:
    """What a kind of package takes along: all (backup); content with cited chunks only; progress without deletions; sync
    without a device's settings."""
    out = dict(tables)
    if kind == "content" and {"source_chunk", "citation"} <= out.keys():
        used = out["citation"].select(F.col("chunk_id").alias("used")).distinct()
        out["source_chunk"] = out["source_chunk"].join(used, F.col("chunk_id") == F.col("used"), "left_semi")
    if kind == "progress":
        out.pop("tombstone", None)
    if kind == "sync" and "setting" in out:
        out["setting"] = out["setting"].where(~F.col("key").isin(*DEVICE_SETTINGS))
    return out
