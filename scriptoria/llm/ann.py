"""Nearest neighbours by block matrix join: int8 product tiles with error bounds, exact scores for what survives."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import cut, fresh

#: Vectors in a block of candidates and in a block of queries.
CANDIDATE_BLOCK, QUERY_BLOCK = 4096, 1024
#: Products of more components than this may not be whole in float32.
WHOLE_IN_FLOAT32 = 2**24 // 127**2
#: Room for rounding in the bounds themselves.
SLACK = 1e-6

BLOCK_DDL = "block int, dim int, ids binary, codes binary, scales binary, errors binary"
BLOCK = pa.schema([("block", pa.int32()), ("dim", pa.int32()), *[(n, pa.binary()) for n in ("ids", "codes", "scales", "errors")]])
PAIR_DDL = "query_id long, vec_id long, low double, high double"
PAIR = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(vector, lambda x: x != 0)


def quantised_blocks(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of about `size` vectors (id, v) of one dimension: the unit vectors as int8 codes, each with its scale and the
    length of what the codes leave out. Blocks are dealt by a hash of the id."""
    counts = {r[0]: max(1, -(-r[1] // size)) for r in vectors.groupBy(F.size("v")).count().collect()}
    if not counts:
        return vectors.sparkSession.createDataFrame([], BLOCK_DDL)
    # as many entries as there are dimensions in the data
    parts = F.element_at(F.create_map(*[F.lit(x) for kv in counts.items() for x in kv]), F.size("v"))
    dealt = vectors.withColumn("dim", F.size("v")).withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int"))

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        block, dim = key[0].as_py(), key[1].as_py()
        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(ids), dim)[order]
        v = v / np.abs(v).max(axis=1, keepdims=True)
        unit = v / np.linalg.norm(v, axis=1, keepdims=True)
        scale = np.abs(unit).max(axis=1) / 127
        codes = np.rint(unit / scale[:, None])
        errors = np.linalg.norm(unit - codes * scale[:, None], axis=1)
        cells = [ids[order].astype("<i8"), codes.astype(np.int8), scale.astype("<f8"), errors.astype("<f8")]
        return pa.Table.from_arrays([pa.array([x], t) for x, t in zip([block, dim, *[c.tobytes() for c in cells]], BLOCK.types, strict=True)], schema=BLOCK)

    return dealt.groupBy("block", "dim").applyInArrow(pack, BLOCK_DDL)


def tile_survivors(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Of each tile (a block of queries, a block of candidates), the pairs that the bounds cannot rule out.

    With unit vectors x = code part + rest, x.y differs from the product of the code parts by at most
    |code part of x| * |rest of y| + |rest of x|. A pair goes if its upper bound is below the k-th largest lower bound of
    its query in the tile, the query's own row not counted.
    """
    for batch in batches:
        for q_ids, q_codes, q_scales, q_errors, ids, codes, scales, errors, dim in zip(*batch.columns, strict=True):
            dim = dim.as_py()
            kind = np.float32 if dim <= WHOLE_IN_FLOAT32 else np.float64
            raw = lambda cell, t: np.frombuffer(cell.as_buffer(), t)
            a, b = raw(q_codes, np.int8).reshape(-1, dim).astype(kind), raw(codes, np.int8).reshape(-1, dim).astype(kind)
            q_ids, ids = raw(q_ids, "<i8"), raw(ids, "<i8")
            product = (a @ b.T).astype(np.float64) * raw(q_scales, "<f8")[:, None] * raw(scales, "<f8")[None, :]
            bound = (1 + raw(q_errors, "<f8"))[:, None] * raw(errors, "<f8")[None, :] + raw(q_errors, "<f8")[:, None] + SLACK
            low = product - bound
            low[q_ids[:, None] == ids[None, :]] = -np.inf
            n = low.shape[1]
            floor = np.partition(low, n - k, axis=1)[:, n - k] if n > k else np.full(len(low), -np.inf)
            i, j = np.nonzero((low + 2 * bound >= floor[:, None]) & (low > -np.inf))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (q_ids[i], ids[j], low[i, j], (low + 2 * bound)[i, j])], schema=PAIR)


def exact_scores(left: pd.Series, right: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(left, right, strict=True):
        x, y = np.asarray(x, np.float64), np.asarray(y, np.float64)
        a, b = np.abs(x).max(), np.abs(y).max()  # keeps squares within range; powers of two leave the digits alone
        x, y = np.ldexp(x, -int(np.frexp(a)[1])), np.ldexp(y, -int(np.frexp(b)[1]))
        out.append(float(np.dot(x, y) / (np.sqrt(np.dot(x, x)) * np.sqrt(np.dot(y, y)))))
    return pd.Series(out, dtype="float64")


def nearest(
    df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding",
    candidate_block: int = CANDIDATE_BLOCK, query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """For each row that is_query picks, its k nearest of all other rows by cosine: query_id, rank, vec_id, score.

    The answer is exact. Equal vectors are one candidate (copies of a vector share its scores), with the k + 1 smallest
    ids. Distinct vectors become int8 blocks; each block of queries meets each block of candidates of its dimension in a
    tile, by a join on the candidates' block number, to which queries are dealt; a tile keeps the pairs whose upper bound
    reaches its k-th lower bound, then the k-th lower bound of all tiles prunes again, and what survives is scored in
    double precision on the original vectors. Heaps of at most k rows, first for part of a query's rows and then for all,
    merge the scores: larger first, ties to the smaller id.

    Vectors that are null, empty or zero or hold null or non-finite components take no part, nor do null ids. Vectors of
    different lengths are not compared. Rows that repeat an id: the same vector counts once, another vector is a further
    candidate under that id; rows of the query's own id are never its neighbours. Fewer than k candidates: all of them. An empty table, or one without
    queries or usable vectors, gives no rows; further columns are left out, whatever their names.
    """
    vectors = df.where(usable(df[vector_col]) & df[id_col].isNotNull()).select(df[id_col].cast("long").alias("id"), df[vector_col].alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    same = F.xxhash64(F.transform("v", lambda x: x + F.lit(0.0)))  # 0.0 and -0.0 alike
    keyed = cut(vectors.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float"))).withColumn("h", same), "vectors")
    classes = keyed.groupBy("h", "v").agg(F.min("id").alias("rep"))
    # a vector's k + 1 smallest ids, in two steps: k + 1 of each part of a class, then of these
    parts = keyed.select("h", "v", "id").withColumn("part", F.pmod(F.xxhash64("id"), F.lit(64)))
    members = parts.withColumn("n", F.dense_rank().over(Window.partitionBy("h", "v", "part").orderBy("id"))).where(F.col("n") <= k + 1).drop("n").distinct()
    members = members.withColumn("n", F.row_number().over(Window.partitionBy("h", "v").orderBy("id"))).where(F.col("n") <= k + 1)
    members = members.groupBy("h", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    reps = cut(members.join(classes, ["h", "v"]).select("rep", "v", "ids"), "classes")
    asked = cut(keyed.where("q").select("h", "v", "id").distinct().join(classes, ["h", "v"]).select("id", "rep"), "queries")

    candidates = cut(quantised_blocks(reps.select(F.col("rep").alias("id"), "v"), candidate_block), "candidate_blocks")
    wanted = reps.join(asked.select("rep").distinct(), "rep", "left_semi").select(F.col("rep").alias("id"), "v")
    queries = cut(quantised_blocks(wanted, query_block), "query_blocks")
    per_dim = candidates.groupBy("dim").agg(F.collect_list("block").alias("blocks"))
    dealt = queries.select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "codes", "scales", "errors")], "dim").join(per_dim, "dim").withColumn("block", F.explode("blocks"))
    tiles = dealt.join(candidates, ["dim", "block"]).select("q_ids", "q_codes", "q_scales", "q_errors", "ids", "codes", "scales", "errors", "dim")

    pairs = cut(tiles.mapInArrow(lambda batches: tile_survivors(batches, k), PAIR_DDL), "pairs")
    bars = pairs.groupBy("query_id", F.pmod(F.xxhash64("vec_id"), F.lit(8)).alias("part")).agg(F.sort_array(F.collect_list("low"), False).alias("lows"))
    bars = bars.select("query_id", F.slice("lows", 1, k).alias("lows")).groupBy("query_id").agg(F.sort_array(F.flatten(F.collect_list("lows")), False).alias("lows"))
    pairs = pairs.join(bars.select("query_id", F.coalesce(F.get("lows", F.lit(k - 1)), F.lit(float("-inf"))).alias("bar")), "query_id").where("high >= bar").select("query_id", "vec_id")
    own = asked.select(F.col("rep").alias("query_id"), F.col("rep").alias("vec_id")).distinct()  # copies of the query's vector
    left, right = reps.select(F.col("rep").alias("query_id"), F.col("v").alias("x")), reps.select(F.col("rep").alias("vec_id"), F.col("v").alias("y"), "ids")
    scored = pairs.unionByName(own).join(right, "vec_id").join(left, "query_id").withColumn("score", F.pandas_udf(exact_scores, T.DoubleType())("x", "y"))
    scored = scored.select("query_id", F.explode("ids").alias("vec_id"), "score")
    # k + 1 rows for each queried vector, of which a query that is one of them leaves out itself
    best = heap_merged(scored, k + 1)
    found = asked.join(best.withColumnRenamed("query_id", "rep"), "rep").where("id != vec_id").select(F.col("id").alias("query_id"), "vec_id", "score").distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


HIT = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def heap_merged(scored: DataFrame, k: int) -> DataFrame:
    """The k best rows of each query: a heap of k over each partition's rows of a query, and then over what these kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query, heap = None, []
        for batch in batches:
            out = []
            for q, vec, score in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if q != query:
                    out += [(query, -v, s) for s, v in heap]
                    query, heap = q, []
                if len(heap) < k:
                    heapq.heappush(heap, (score, -vec))
                elif (score, -vec) > heap[0]:
                    heapq.heapreplace(heap, (score, -vec))
            yield rows(out)
        yield rows([(query, -v, s) for s, v in heap])

    def rows(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], HIT.types[i]) for i in range(3)], schema=HIT)

    ddl = "query_id long, vec_id long, score double"
    part = scored.select("query_id", "vec_id", "score").sortWithinPartitions("query_id").mapInArrow(run, ddl)
    return part.repartition("query_id").sortWithinPartitions("query_id").mapInArrow(run, ddl)
