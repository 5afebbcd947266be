"""Ranked lexical search by block-max pruning.

The index is a table with a row for each block, a range of documents as the table holds them: the block's forward index
(terms of each document with their counts) and, for each of its terms, the most that it can add to a score. A search bounds a
block's scores by its maxima, takes blocks by falling bound, and stops where the bound is below what it already has.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import cut, delete_at_exit, shared_dir

#: A block ends after so many documents, or so many different terms of its documents.
BLOCK_DOCS, BLOCK_POSTINGS = 32, 200_000
#: Bytes of blocks that a task scores together, and that it hands back at once.
CHUNK_BYTES = 4_000_000
#: Queries, and cells of terms x queries, that a pass over the index takes together: both bound what is sent to the tasks.
GROUP_QUERIES, GROUP_CELLS = 256, 4_000_000
#: Blocks by which a first threshold of each query is found.
PILOT_BLOCKS = 4
#: Bytes of a text whose words are listed at once.
PIECE_BYTES = 1_000_000
#: Blocks that Spark reads, and hands to a task's Python, at once: rows of the index are long, about 200 kB. Bytes of a row
#: group of the index.
ARROW_ROWS, GROUP_BYTES = 64, 16_000_000
#: Sums below this are exact as doubles.
EXACT = 2**53

# Separators become blanks, capitals small letters; bytes from 128 on are parts of other letters.
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words_of(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8: runs of ASCII digits and letters and of all other characters, A-Z in lower case. They come
    in lists of bounded size, so that a very long text is never a list of all its words."""
    folded, at = (text or b"").translate(_FOLD), 0
    while at < len(folded):
        end = folded.find(b" ", at + PIECE_BYTES)
        end = len(folded) if end < 0 else end
        yield folded[at:end].split()
        at = end


def counted(text: bytes | None) -> tuple[int, Counter]:
    n, found = 0, Counter()
    for words in words_of(text):
        n += len(words)
        found.update(words)
    return n, found


@dataclass(frozen=True)
class Index:
    """blocks: the table; n_docs: documents with terms; n_terms: all their terms, repeats included."""

    blocks: DataFrame
    n_docs: int
    n_terms: int


_BLOCKS = (
    "block long, keys array<bigint>, starts array<int>, places array<int>, counts array<int>, parts array<int>, "
    "terms array<binary>, found_in array<int>, maxima array<int>"
)


def index_documents(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> Index:
    """Index every document, by one pass for the lengths and one for the blocks; nothing is shuffled.

    Null, empty and wordless texts are no documents of the index. Keys are longs and may be null or repeated: every row is a
    document of its own. An empty table gives an index without blocks. Texts of any length are read whole; further columns
    are left out, so their names do no harm.
    """
    rows = docs.select(docs[key_col].cast("long").alias("key"), docs[text_col].cast("string").cast("binary").alias("text"))

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in batches:
            for text in batch.column(0):
                size = sum(map(len, words_of(text.as_py())))
                n, total = n + (size > 0), total + size
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    sums = rows.select("text").mapInArrow(lengths, "n long, total long").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0)))
    n_docs, n_terms = sums.head()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 33, 0
        keys, places, counts, parts, starts, local = [], [], [], [], [0], {}

        def block() -> pa.RecordBatch:
            place, part = np.array(places, np.int64), np.array(parts, np.int64)
            terms = np.array(list(local), object)
            order = np.argsort(terms, kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            maxima = np.zeros(len(order), np.int64)
            np.maximum.at(maxima, back[place], part)
            row = {
                "block": first + made, "keys": keys, "starts": starts, "places": back[place], "counts": counts, "parts": part,
                "terms": list(terms[order]), "found_in": np.bincount(back[place], minlength=len(order)), "maxima": maxima,
            }
            return pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in _schema()], schema=_schema())

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                n, found = counted(text.as_py())
                if not n:
                    continue
                m = 75 + 25 * n * n_docs // n_terms
                keys.append(key.as_py())
                places.extend([local.setdefault(w, len(local)) for w in found])
                counts.extend(found.values())
                parts.extend([1_000_000_000 * tf // (1000 * tf + 12 * m) for tf in found.values()])
                starts.append(len(places))
                if len(keys) == BLOCK_DOCS or len(places) >= BLOCK_POSTINGS:
                    yield block()
                    made += 1
                    keys, places, counts, parts, starts, local = [], [], [], [], [0], {}
        if keys:
            yield block()

    return Index(cut(rows.mapInArrow(blocks, _BLOCKS), "blocks", group_bytes=GROUP_BYTES), n_docs, n_terms)


def _schema() -> pa.Schema:
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = {"block": pa.int64(), "keys": longs, "starts": ints, "places": ints, "counts": ints, "parts": ints, "terms": pa.list_(pa.binary()), "found_in": ints, "maxima": ints}
    return pa.schema(list(kinds.items()))


@dataclass
class Asked:
    """A group of queries: their terms, in order, and by term the queries that ask for it and how often."""

    items: list
    terms: list[bytes]
    asked: list[dict[int, int]]

    @staticmethod
    def of(queries: list[tuple[object, Counter]]) -> Asked:
        by_term: dict[bytes, dict[int, int]] = {}
        for q, (_, words) in enumerate(queries):
            for word, times in words.items():
                by_term.setdefault(word, {})[q] = times
        terms = sorted(by_term)
        return Asked([item for item, _ in queries], terms, [by_term[t] for t in terms])

    def weighted(self, weights: np.ndarray) -> np.ndarray:
        """terms x queries: a term's weight times how often a query asks for it."""
        out = np.zeros((len(self.terms), len(self.items)), np.int64)
        for t, by in enumerate(self.asked):
            for q, times in by.items():
                out[t, q] = times * weights[t]
        return out


def groups_of(items: DataFrame, item_col: str, text_col: str) -> Iterator[Asked]:
    """The queries in groups whose terms and numbers are bounded, one group after the other."""
    queries, terms = [], set()
    rows = items.select(items[item_col].alias("item"), items[text_col].cast("string").cast("binary").alias("text")).distinct().orderBy("item", "text")
    for row in rows.toLocalIterator():
        n, words = counted(bytes(row.text) if row.text is not None else None)
        if not n:
            continue
        more = terms | words.keys()
        if queries and (len(queries) == GROUP_QUERIES or len(more) * (len(queries) + 1) > GROUP_CELLS):
            yield Asked.of(queries)
            queries, more = [], set(words)
        queries.append((row["item"], words))
        terms = more
    if queries:
        yield Asked.of(queries)


def _values(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list begins and ends in the flat values, and these."""
    offsets = column.offsets.to_numpy()
    return offsets - offsets[0], column.flatten()


def _asked_terms(batch: pa.RecordBatch, terms: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of a batch's lists of terms, and each term's number among those asked for, or -1."""
    offsets, values = _values(batch.column("terms"))
    return offsets, pc.fill_null(pc.index_in(values, value_set=pa.array(terms, values.type)), -1).to_numpy(zero_copy_only=False)


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of about CHUNK_BYTES."""
    for batch in batches:
        rows = max(1, int(batch.num_rows * CHUNK_BYTES / max(1, batch.nbytes)))
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _frequencies(index: Index, group: Asked) -> np.ndarray:
    """The documents that hold each asked term, summed up in the tasks first."""
    terms = group.terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(terms), np.int64)
        for batch in _sliced(batches):
            _, number = _asked_terms(batch, terms)
            here = number >= 0
            np.add.at(sums, number[here], _values(batch.column("found_in"))[1].to_numpy()[here])
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_pydict({"term": pa.array(some, pa.int64()), "docs": pa.array(sums[some], pa.int64())})

    out = np.zeros(len(terms), np.int64)
    for row in index.blocks.select("terms", "found_in").mapInArrow(count, "term long, docs long").groupBy("term").agg(F.sum("docs").alias("docs")).collect():
        out[row.term] = row.docs
    return out


def weights_of(found_in: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in found_in], np.int64)


def _matrix(weighted: np.ndarray, most_part: int = 1_000_000) -> np.ndarray:
    """As doubles where no sum of a query can reach 2**53, so that products are exact and fast; as integers otherwise."""
    sums = weighted.astype(object).sum(axis=0) if len(weighted) else np.zeros(0, object)
    return weighted.astype(np.float64) if max(sums, default=0) * most_part < EXACT else weighted


def _pilot_blocks(index: Index, group: Asked, weighted: np.ndarray) -> list[int]:
    """The blocks with the highest bounds of each query: the only columns read are the terms and their maxima."""
    terms = group.terms

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix = _matrix(weighted)
        best: list[list[tuple[int, int]]] = [[] for _ in range(matrix.shape[1])]
        for batch in _sliced(batches):
            offsets, number = _asked_terms(batch, terms)
            maxima = _values(batch.column("maxima"))[1].to_numpy().astype(matrix.dtype)
            for i, block in enumerate(batch.column("block").to_pylist()):
                at = offsets[i] + np.flatnonzero(number[offsets[i] : offsets[i + 1]] >= 0)
                bound = maxima[at] @ matrix[number[at]]
                for q in np.flatnonzero(bound):
                    if len(best[q]) < PILOT_BLOCKS:
                        heapq.heappush(best[q], (int(bound[q]), -block))
                    elif (int(bound[q]), -block) > best[q][0]:
                        heapq.heapreplace(best[q], (int(bound[q]), -block))
        rows = [(q, bound, -block) for q, found in enumerate(best) for bound, block in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["query", "bound", "block"])

    found = index.blocks.select("block", "terms", "maxima").mapInArrow(bounds, "query long, bound long, block long")
    first = Window.partitionBy("query").orderBy(F.desc("bound"), "block")
    chosen = found.withColumn("n", F.row_number().over(first)).where(F.col("n") <= PILOT_BLOCKS)
    return sorted(r.block for r in chosen.select("block").distinct().collect())  # at most GROUP_QUERIES * PILOT_BLOCKS


def _scored(blocks: DataFrame, group: Asked, weighted: np.ndarray, k: int, thresholds: np.ndarray) -> DataFrame:
    """(query, key, score): from each task the k best documents of each query that reach its threshold. A task goes through
    its blocks chunk by chunk, within a chunk by falling bound, and its k-th best score raises the threshold on the way."""
    terms = group.terms

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, least = _matrix(weighted), thresholds.copy()
        best: list[list[tuple]] = [[] for _ in range(matrix.shape[1])]
        for batch in _sliced(batches):
            offsets, number = _asked_terms(batch, terms)
            flat = {name: _values(batch.column(name)) for name in ("keys", "starts", "places", "parts", "maxima")}
            of = lambda name, i: flat[name][1].slice(flat[name][0][i], flat[name][0][i + 1] - flat[name][0][i]).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            wanted = []
            for i in range(batch.num_rows):
                here = np.flatnonzero(number[offsets[i] : offsets[i + 1]] >= 0)
                asked = matrix[number[offsets[i] + here]]
                bound = of("maxima", i)[here].astype(matrix.dtype) @ asked
                for q in np.flatnonzero((bound >= least) & (bound > 0)):
                    wanted.append((int(q), -int(bound[q]), i))
            wanted.sort()
            forward: dict[int, np.ndarray] = {}
            done = -1
            for q, bound, i in wanted:
                if q == done or -bound < least[q]:
                    done = q  # the query's other blocks have bounds as low or lower
                    continue
                if i not in forward:
                    place = np.full(offsets[i + 1] - offsets[i], -1)
                    here = np.flatnonzero(number[offsets[i] : offsets[i + 1]] >= 0)
                    place[here] = np.arange(len(here))
                    column, starts = place[of("places", i)], of("starts", i)
                    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
                    parts = np.zeros((len(starts) - 1, len(here)), matrix.dtype)
                    parts[row[column >= 0], column[column >= 0]] = of("parts", i)[column >= 0]
                    forward[i] = parts, number[offsets[i] + here], batch.column("keys")[i].as_py()
                parts, numbers, keys = forward[i]
                scores = parts @ matrix[numbers, q]
                for d in np.flatnonzero((scores >= least[q]) & (scores > 0)):
                    entry = (int(scores[d]), keys[d] is not None, -(keys[d] or 0))
                    if len(best[q]) < k:
                        heapq.heappush(best[q], entry)
                    elif entry > best[q][0]:
                        heapq.heapreplace(best[q], entry)
                    if len(best[q]) == k:
                        least[q] = max(least[q], best[q][0][0])
        rows = [(q, -key if known_key else None, points) for q, found in enumerate(best) for points, known_key, key in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], pa.int64()) for j in range(3)], names=["query", "key", "score"])

    return blocks.select("block", "keys", "starts", "places", "parts", "terms", "maxima").mapInArrow(score, "query long, key long, score long")


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.col("key").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, items: DataFrame, k: int = 20, item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_col, rank (int, from 1), key (long), score (long): each item's k best documents with a score above 0.

    Equal scores go by ascending key, null keys last; where documents of one key and score compete for the last ranks, they
    are alike in these columns. Items with null, empty or wordless texts have no rows. Repeated rows of items count once;
    different texts under one item are queries of their own, each with its ranks. Items come in groups of bounded size, each
    with its own passes over the index. An empty index or no items give no rows.
    """
    spark, kind = index.blocks.sparkSession, items.schema[item_col].dataType
    schema, folder = f"{item_col} {kind.simpleString()}, rank int, key long, score long", shared_dir(index.blocks.sparkSession)
    spark.createDataFrame([], schema).write.parquet(f"{folder}/none")
    for number, group in enumerate(groups_of(items, item_col, text_col)):
        with short_batches(spark):
            _search_group(index, group, k, item_col, kind.simpleString(), f"{folder}/group{number}")
    delete_at_exit(spark, folder)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)


@contextmanager
def short_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside reads ARROW_ROWS rows of a file at once, as Python gets them; the session's own settings are put back.

    Spark's reader would otherwise decode 4,096 rows together, or as many as a file has, so that memory would grow with files.
    """
    names = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = {name: spark.conf.get(name) for name in names}
    for name in names:
        spark.conf.set(name, str(ARROW_ROWS))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _search_group(index: Index, group: Asked, k: int, item_col: str, kind: str, path: str) -> None:
    """Writes a group's ranks."""
    spark = index.blocks.sparkSession
    weighted = group.weighted(weights_of(_frequencies(index, group), index.n_docs))
    thresholds = np.zeros(len(group.items), np.int64)
    if pilot := _pilot_blocks(index, group, weighted):
        first = index.blocks.where(F.col("block").isin(*pilot))
        for row in _ranked(_scored(first, group, weighted, k, thresholds), k).where(F.col("rank") == k).collect():
            thresholds[row["query"]] = row["score"]
    names = spark.createDataFrame(list(enumerate(group.items)), f"query long, {item_col} {kind}")
    found = _ranked(_scored(index.blocks, group, weighted, k, thresholds), k).join(F.broadcast(names), "query")  # a group is bounded
    found.select(item_col, F.col("rank").cast("int").alias("rank"), "key", "score").write.parquet(path)
