"""Merkle manifest of a dataset: a digest for each row, a tree for each group of rows, a tree over the groups, and proofs.

A tree's leaves are cut into aligned blocks of FANOUT ** LEVELS; a task makes a block's levels as contiguous matrices of hex
digests and finds siblings by their indices. Blocks' tops are the leaves of the next tier, so a group of any size is spread
over many tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import cut

#: Nodes that are hashed into one, and levels that a task's block of a tree has.
FANOUT, LEVELS = 3, 7
#: A proof: for each level, the digests of the siblings before and after the node on the way, each as one string.
PATH = "array<struct<before:string,after:string>>"


def field_text(value: Column) -> Column:
    """`-` for null, otherwise the length in bytes of UTF-8, a colon and the value as text."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(values: Sequence[Column]) -> Column:
    """SHA-256 in lower-case hex over the fields one after the other: different rows never give the same bytes."""
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a proof lead to."""
    return F.aggregate(path, leaf, lambda node, s: F.sha2(F.concat(s.before, node, s.after), 256))


def proof_digest(path: Column) -> Column:
    """SHA-256 over all siblings of a proof, from the leaf to the root and from left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s.before, s.after)), ""), 256)


def with_places(df: DataFrame, tree: str, order: Sequence[Column]) -> DataFrame:
    """df with place (from 0) in the order of the row's tree and size (rows of the tree).

    Rows are sorted by ranges over the whole cluster and written with their range's number; places are counted within ranges,
    and the rows of the ranges before are added. So a tree that holds most rows is spread like any other. Only counts are
    brought together: of a tree as many as there are ranges.
    """
    ranges = df.repartitionByRange(tree, *order).sortWithinPartitions(tree, *order).withColumn("mark", F.monotonically_increasing_id())
    ranges = cut(ranges.withColumn("range_no", F.shiftright("mark", 33)), "ranges")
    counts = ranges.groupBy(tree, "range_no").agg(F.count("*").alias("rows"), F.min("mark").alias("first"))
    whole = Window.partitionBy(tree)
    earlier = F.sum("rows").over(whole.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(tree, "range_no", "first", F.sum("rows").over(whole).alias("size"), F.coalesce(earlier, F.lit(0)).alias("earlier"))
    return ranges.join(counts, [tree, "range_no"]).withColumn("place", F.col("earlier") + F.col("mark") - F.col("first")).drop("mark", "range_no", "first", "earlier")


def levels_up(size: int, levels: int) -> int:
    """Levels that a block of a tree of so many nodes goes up: all of them, or as many as leave one node."""
    if size > FANOUT**levels:
        return levels
    up = 0
    while size > 1:
        size, up = -(-size // FANOUT), up + 1
    return up


def levels_of(digests: list[str], up: int) -> list[np.ndarray]:
    """The block's levels as matrices of 64 bytes a row: each run of FANOUT rows is a row of the reshaped matrix, and its hash
    a row of the next level; a last run may be shorter."""
    out = [np.frombuffer("".join(digests).encode(), np.uint8).reshape(-1, 64)]
    for _ in range(up):
        nodes = out[-1]
        whole = len(nodes) // FANOUT * FANOUT
        runs = [*nodes[:whole].reshape(-1, 64 * FANOUT), *([nodes[whole:].reshape(-1)] if whole < len(nodes) else [])]
        out.append(np.frombuffer("".join(hashlib.sha256(run).hexdigest() for run in runs).encode(), np.uint8).reshape(-1, 64))
    return out


def siblings(levels: list[np.ndarray]) -> tuple[list[list[str]], list[list[str]]]:
    """By level and leaf, the digests in the leaf's ancestor's run before it and after it."""
    leaves, before, after = np.arange(len(levels[0])), [], []
    for level, nodes in enumerate(levels[:-1]):
        text, own = nodes.tobytes().decode(), leaves // FANOUT**level
        first = own - own % FANOUT
        last = np.minimum(first + FANOUT, len(nodes))
        before.append([text[64 * a : 64 * b] for a, b in zip(first.tolist(), own.tolist(), strict=True)])
        after.append([text[64 * (a + 1) : 64 * b] for a, b in zip(own.tolist(), last.tolist(), strict=True)])
    return before, after


def _sorted_block(table: pa.Table, levels: int) -> tuple[pa.Table, int]:
    return table.sort_by("place"), levels_up(table.column("size")[0].as_py(), levels)


def _tops(nodes: DataFrame, levels: int) -> DataFrame:
    """The tops of the nodes' blocks: the nodes of the next tier."""

    block = FANOUT**levels

    def top(table: pa.Table) -> pa.Table:
        table, up = _sorted_block(table, levels)
        digest = levels_of(table.column("digest").to_pylist(), up)[-1].tobytes().decode()
        place, size = table.column("place")[0].as_py() // block, -(-table.column("size")[0].as_py() // block)
        return pa.table({"tree": [table.column("tree")[0].as_py()], "place": [place], "size": [size], "digest": [digest]})

    blocks = nodes.select("tree", "place", "size", "digest", F.floor(F.col("place") / block).alias("block"))
    return blocks.groupBy("tree", "block").applyInArrow(top, "tree string, place long, size long, digest string")


def _tiers(nodes: DataFrame, levels: int) -> list[DataFrame]:
    """The nodes and the tiers above them, up to the one that has a single node for each tree."""
    tiers, most = [nodes], nodes.agg(F.max("size")).head()[0] or 0
    while len(tiers) == 1 or most > 1:
        tiers.append(cut(_tops(tiers[-1], levels), "tops"))
        most = -(-most // FANOUT**levels)
    return tiers


def _with_paths(names: Sequence[str], levels: int):
    """Of a block's nodes and the row that its top has above, the named columns of the nodes with path, subroot and root."""
    siblings_of_a_level = pa.struct([("before", pa.string()), ("after", pa.string())])

    def found(own: pa.Table, above: pa.Table) -> pa.Table:
        own, up = _sorted_block(own, levels)
        before, after = siblings(levels_of(own.column("digest").to_pylist(), up))
        (higher,) = above.column("path").to_pylist()
        every = [[{"before": b[i], "after": a[i]} for b, a in zip(before, after, strict=True)] + higher for i in range(own.num_rows)]
        columns = {n: own.column(n) for n in names} | {"path": pa.array(every, pa.list_(siblings_of_a_level))}
        return pa.table(columns | {n: pa.array(above.column(n).to_pylist() * own.num_rows, pa.string()) for n in ("subroot", "root")})

    return found


def _down(tiers: list[DataFrame], top: DataFrame, levels: int) -> DataFrame:
    """The lowest tier's rows, other columns kept, with path, subroot and root. top has these for the highest tier's nodes:
    (tree, place, path, subroot, root)."""
    for nodes in reversed(tiers[:-1]):
        kept = [f for f in nodes.schema.fields if f.name != "size"]
        schema = T.StructType([*kept, *[top.schema[c] for c in ("path", "subroot", "root")]])
        blocks = nodes.withColumn("block", F.floor(F.col("place") / FANOUT**levels)).groupBy("tree", "block")
        above = top.select("tree", "place", "path", "subroot", "root").groupBy("tree", "place")
        top = blocks.cogroup(above).applyInArrow(_with_paths([f.name for f in kept], levels), schema)
    return top


def merkle_proofs(df: DataFrame, leaf_col: str, group_col: str, order_col: str, keep: Sequence[str] = (), levels: int = LEVELS) -> DataFrame:
    """keep's columns, leaf, place (from 0, in the group), path, subroot and root for every row of df.

    In each group, read as text, leaves ascend by order_col; while several nodes remain, each FANOUT consecutive ones (at the end
    fewer, even one) become the hash of their digests. What remains is the group's subroot, a lone leaf itself. Subroots, by
    group in the order of their bytes, lead to the root in the same way. path has the siblings from the leaf to the root.

    Null groups are one group, which comes first; null keys come first in their group; rows of one key go by their leaves, so
    repeated rows are leaves of their own and their order makes no difference to the tree. An empty table gives no rows. Rows
    are leaves whatever their texts hold; levels changes how much a task has at once, not what comes out; columns of df with the names that come out do no harm, as others are left out. keep
    may not name an output column.
    """
    if clash := {"leaf", "place", "path", "subroot", "root"} & {c.lower() for c in keep}:
        raise ValueError(f"keep names output columns: {sorted(clash)}")
    # the key of a tree is never null, and tells a null group from the text of any group
    rows = df.select(field_text(df[group_col]).alias("tree"), df[leaf_col].alias("digest"), df[order_col].alias("number"), *[df[c].alias(f"k{i}") for i, c in enumerate(keep)])
    leaves = with_places(rows, "tree", [F.col("number").asc_nulls_first(), F.col("digest").asc()])
    tiers = _tiers(leaves, levels)
    group = F.when(F.col("tree") != "-", F.expr("substr(tree, instr(tree, ':') + 1)"))
    groups = tiers[-1].select(F.lit("all").alias("tree"), F.col("tree").alias("name"), "digest", group.alias("group_name"))
    over = _tiers(with_places(groups, "tree", [F.col("group_name").asc_nulls_first()]), levels)
    nothing, no_text = F.array().cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot")
    found = _down(over, over[-1].select("tree", "place", nothing, no_text, F.col("digest").alias("root")), levels)
    top = cut(found.select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("place"), "path", F.col("digest").alias("subroot"), "root"), "groups")
    out = _down(tiers, top, levels)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("digest").alias("leaf"), "place", "path", "subroot", "root")
