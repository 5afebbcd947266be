"""SimHash near-duplicates: fingerprints, deletion-variant candidate keys, verified links, and components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptoria.llm.common import cut, drop_cut, fresh, with_texts_mapped

#: Fingerprints link at this many differing bits at most.
MAX_BITS = 3
#: Fingerprints under one key that one task compares; larger groups are dealt out in tiles.
TILE = 20_000


def fingerprint_texts(df: DataFrame, text_col: str = "text", keep: list[str] | None = None, shingle: int = 3) -> DataFrame:
    """keep's columns (all unless given) and simhash, a signed long.

    A-Z become lower case, words are runs of anything but ASCII white space, shingles are `shingle` words joined by
    spaces, with repeats. Texts of fewer words have one shingle, the whole sequence; texts without words (null too) have
    simhash 0. A bit is set if more than half of the shingles' XXH64 values (UTF-8, seed 42) have it.
    """

    def make():
        from xxhash import xxh64_digest

        def work(text):
            words = text.encode().lower().split() if text else ()
            if not words:
                return (0,)
            if len(words) <= shingle:
                return (int(np.frombuffer(xxh64_digest(b" ".join(words), 42), ">i8")[0]),)
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[:-shingle].tolist()]
            hashes = b"".join([xxh64_digest(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)])
            n, counts = len(starts), np.zeros(64, np.int64)
            table = np.frombuffer(hashes, np.uint8).reshape(n, 8)
            for at in range(0, n, 65_536):
                counts += np.unpackbits(table[at : at + 65_536], axis=1).sum(axis=0, dtype=np.int64)
            return (int(np.packbits(counts * 2 > n).view(">i8")[0]),)

        return work

    return with_texts_mapped(df, text_col, df.columns if keep is None else keep, make, [("simhash", T.LongType())])


#: Keys of a fingerprint: each 32-bit half with one bit made a wildcard, and each half as it is (place 32). With 3
#: differing bits at most, one of the halves differs in one bit or none, so linked fingerprints share a key.
VARIANT_KEYS = """
flatten(transform(array(0, 1), seg -> transform(sequence(0, 32), p ->
  (if(seg = 0, fp & 4294967295, shiftrightunsigned(fp, 32)) & if(p < 32, ~shiftleft(1L, p), -1L))
  | shiftleft(cast(p as bigint), 32) | shiftleft(cast(seg as bigint), 38))))
"""
HALVES = "array(fp & 4294967295, shiftrightunsigned(fp, 32) | shiftleft(1L, 38))"


def link_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Links a < b between distinct fingerprints (column fp): enough of them that all fingerprints within max_bits (3 at
    most) of each other are connected.

    Fingerprints are dealt out by key. Under a key each group gives a spanning forest of its links, at most one link for
    each member, never all pairs. A key whose group can exceed `tile` (a half that many fingerprints share) is dealt out
    in tiles: members are split in blocks of about tile / 2, and every two blocks meet in one group.
    """
    if max_bits > 3:
        raise ValueError("two halves with one wildcard find at most 3 differing bits")
    fps = fps.select("fp").distinct()
    keys = fps.select(F.explode(F.expr(VARIANT_KEYS)).alias("key"), "fp")
    halves = fps.select(F.explode(F.expr(HALVES)).alias("half")).groupBy("half").count()
    hot = cut(halves.where(F.col("count") > tile // 2).coalesce(1), "hot")
    if hot.head(1):
        places = F.expr("transform(sequence(0, 32), p -> (half & if(p < 32, ~shiftleft(1L, p), -1L)) | shiftleft(cast(p as bigint), 32))")
        blocks = hot.select(F.explode(places).alias("hot_key"), F.expr(f"cast(ceil(4 * count / {tile}) as int)").alias("blocks"))
        blocks = blocks.groupBy("hot_key").agg(F.max("blocks").alias("blocks"))
        keys = keys.join(blocks, keys.key == blocks.hot_key, "left")
        mine = F.expr("cast(pmod(xxhash64(fp), blocks) as int)")
        pairs = F.expr("transform(sequence(0, blocks - 1), o -> least(mine, o) * blocks + greatest(mine, o))")
        keys = keys.withColumn("mine", mine).withColumn("tile", F.explode(F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(pairs)))
        dealt = keys.select("key", "tile", "fp").repartition("key", "tile").sortWithinPartitions("key", "tile", "fp")
    else:
        dealt = keys.select("key", F.lit(0).alias("tile"), "fp").repartition("key").sortWithinPartitions("key", "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = np.empty((0, 3), np.int64)
        for batch in batches:
            rows = np.stack([np.asarray(batch.column(i)).astype(np.int64) for i in range(3)], axis=1)
            rows = np.concatenate([left, rows])
            last = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
            done = last[-1] + 1 if len(last) else 0
            left = rows[done:]
            yield from links_of(rows[:done], max_bits)
        yield from links_of(left, max_bits)

    return dealt.mapInArrow(run, "a long, b long").distinct()


def bits_set(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))


def links_of(rows: np.ndarray, max_bits: int) -> Iterator[pa.RecordBatch]:
    """rows: key, tile and fingerprint, sorted; whole groups of one key and tile."""
    if len(rows) < 2:
        return
    starts = np.flatnonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])
    sizes, fps = np.diff(np.r_[starts, len(rows)]), rows[:, 2]
    at = starts[sizes == 2]
    a, b = fps[at], fps[at + 1]
    place = (rows[at, 0] >> 32) & 63
    # a pair that agrees in the wildcard bit shares the whole half, and that key finds it
    side = ((a ^ b) >> (place + 32 * ((rows[at, 0] >> 38) & 1))) & 1
    near = (bits_set(a ^ b) <= max_bits) & ((place == 32) | (side == 1))
    found = [(a[near], b[near])]
    for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        found.append(forest(fps[s : s + n], max_bits))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def forest(fps: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links within a group, by breadth-first search over what has not been reached."""
    a, b, rest, queue = [], [], fps, []
    while len(rest):
        if not queue:
            queue, rest = [rest[0]], rest[1:]
        x = queue.pop()
        near = bits_set(rest ^ x) <= max_bits
        if near.any():
            reached, rest = rest[near], rest[~near]
            a.append(np.full(len(reached), x))
            b.append(reached)
            queue.extend(reached)
    none = np.empty(0, np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def components(links: DataFrame) -> DataFrame:
    """node and root, the smallest node that it is connected with, for every node of links (longs a, b).

    Rounds of large-star and small-star over link tables that are written to the shared folder; links to a node's smallest
    neighbour replace its links, until a round changes nothing. Minima are aggregated before the shuffle and joined back,
    so a node with very many links is no group of its own.
    """
    cur = cut(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    seal = None
    while True:
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = cut(small, "links")
        row = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head()
        drop_cut(cur)
        cur = new
        if row == seal:
            break
        seal = row
    nodes = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(
    df: DataFrame, text_col: str = "text", key_col: str = "doc_id", max_bits: int = MAX_BITS, shingle: int = 3, tile: int = TILE
) -> DataFrame:
    """One row for each of df's: the key column, simhash and component_id, the smallest key reachable over links.

    Exact copies are one fingerprint from the start and are never paired. Texts without words have fingerprint 0 and link
    like any other. Rows with a null key are linked too, but only a key that is not null can name a component; where there
    is none, component_id is null. Rows with equal keys each get a row. An empty frame gives an empty one.
    """
    (key,) = fresh(df.select(key_col), "key_")
    docs = cut(fingerprint_texts(df.select(F.col(key_col).alias(key), F.col(text_col).alias("text_")), "text_", [key], shingle), "fingerprints")
    names = component_names(docs, key, max_bits, tile)
    # a written table on each side, so that the join's shuffles are its own and adaptive execution splits a hot fingerprint
    return docs.join(names, docs.simhash == names.fp).select(F.col(key).alias(key_col), "simhash", "component_id")


def component_names(docs: DataFrame, key: str, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """For each fingerprint of docs (key, simhash): fp, component_id, first, its own smallest key, and n, how many rows of
    that key it has."""
    pairs = docs.groupBy(F.col("simhash").alias("fp"), F.col(key).alias("first")).agg(F.count("*").alias("n"))
    # nulls come after all keys: a fingerprint's first key is null only if all of its keys are
    least = F.min(F.struct(F.col("first").isNull().alias("none"), "first", "n"))
    fps = cut(pairs.groupBy("fp").agg(least.alias("x")).select("fp", "x.first", "x.n"), "fps")
    comp = components(link_fingerprints(fps, max_bits, tile))
    linked = fps.join(comp, fps.fp == comp.node)
    roots = linked.groupBy("root").agg(F.min("first").alias("least"))
    named = comp.join(roots, "root").select("node", "least")
    return cut(fps.join(named, fps.fp == named.node, "left").select("fp", F.coalesce("least", "first").alias("component_id"), "first", "n"), "names")


def keep_first(df: DataFrame, text_col: str = "text", key_col: str = "doc_id", max_bits: int = MAX_BITS, shingle: int = 3, tile: int = TILE) -> DataFrame:
    """The rows of df that stand for their component: those with the smallest key of it, once for each key.

    Of rows with one key, only those whose own text is in the component that the key names can stand for it; of several the
    one with the smallest text stays, ties by a hash of the row. A row with a null key cannot stand for a component; it
    stays only if all of its component have null keys, and then all of them stay. An empty frame gives an empty one.
    """
    (name,) = fresh(df, "simhash_of_row")
    ours = df.withColumnsRenamed({c: f"{name}_{c}" for c in df.columns if c.lower() == "simhash"})
    marked = cut(fingerprint_texts(ours, text_col, None, shingle).withColumnRenamed("simhash", name), "marked")
    names = component_names(marked.select(F.col(key_col).alias("key"), F.col(name).alias("simhash")), "key", max_bits, tile)
    stays = names.where(F.col("component_id").eqNullSafe(F.col("first")))
    kept = marked.join(stays.select("fp", F.col("first").alias(f"{name}_key")), (F.col(name) == F.col("fp")) & F.col(key_col).eqNullSafe(F.col(f"{name}_key")), "left_semi")
    if stays.where("first is not null").groupBy("first").agg(F.sum("n").alias("n")).where("n > 1").head(1):
        hashed = [c for c, kind in marked.dtypes if "map<" not in kind and "variant" not in kind]
        one = kept.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(F.min_by(F.struct("*"), F.struct(F.col(text_col), F.xxhash64(*hashed))).alias(name))
        kept = one.select(f"{name}.*").unionByName(kept.where(F.col(key_col).isNull()))
    return kept.drop(name).toDF(*df.columns)
