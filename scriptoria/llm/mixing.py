"""Mixing sources to target weights: Pfair windows and earliest-deadline-first, in DataFrame operations only."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.llm.common import cut, fresh

#: A source joins the schedule by a broadcast table of at most this many sources.
MAX_SOURCES = 1000

#: Rows of a block, and parts of the whole to which weights are taken.
BLOCK_ROWS, PARTS = 64, 10**10
#: Rows that a task numbers at once, about; sources are cut into as many buckets as that asks for, BUCKETS at least.
BUCKET_ROWS, BUCKETS = 100_000, 256
#: Rows of a table that go to every task; a larger one is joined by a shuffle. Either way the rows that come out are the same.
BROADCAST_ROWS = 200_000

#: Slots that are collected before they are handed on, so that long schedules are not copied for each slot.
CHUNK = 1024

#: All blocks, slot by slot: of the blocks that are released, the one with the earliest deadline runs, the first source of
#: equals. Block k (from 0) of a source with u of PARTS has the window [floor(k*PARTS/u), ceil((k+1)*PARTS/u)); each source's
#: next window is kept and changes only when the source runs. When a source is used up, the windows of the others begin anew at
#: the next slot with the shares that they have without it. A pick is ((sources used up before) * sources + source) * blocks +
#: the source's block.
SCHEDULE = f"""
aggregate(
  sequence(0L, (n_blocks - 1) div {CHUNK}),
  named_struct(
    'next', transform(all, x -> named_struct('done', 0L, 'base', 0L, 'release', 0L, 'deadline', (whole + x.units - 1) div x.units)),
    'start', 0L, 'period', whole, 'gone', 0, 'out', cast(array() as array<array<bigint>>)),
  (o, chunk) -> element_at(transform(array(aggregate(
    sequence(chunk * {CHUNK}, least(n_blocks, (chunk + 1) * {CHUNK}) - 1),
    named_struct('next', o.next, 'start', o.start, 'period', o.period, 'gone', o.gone, 'picks', cast(array() as array<bigint>)),
    (s, slot) -> element_at(transform(
      array(cast(array_min(transform(s.next, (w, i) -> if(w.release <= slot, w.deadline * size(all) + i, null))) % size(all) as int)),
      pick -> if(s.next[pick].done + 1 < all[pick].blocks,
        named_struct(
          'next', transform(s.next, (w, i) -> if(i = pick, named_struct('done', w.done + 1, 'base', w.base,
            'release', s.start + ((w.done + 1 - w.base) * s.period) div all[i].units,
            'deadline', s.start + ((w.done + 2 - w.base) * s.period + all[i].units - 1) div all[i].units), w)),
          'start', s.start, 'period', s.period, 'gone', s.gone, 'picks', concat(s.picks, array((s.gone * size(all) + pick) * n_blocks + s.next[pick].done))),
        named_struct(
          'next', transform(s.next, (w, i) -> if(i = pick or w.done = all[i].blocks,
            named_struct('done', all[i].blocks, 'base', w.base, 'release', n_blocks, 'deadline', n_blocks),
            named_struct('done', w.done, 'base', w.done, 'release', slot + 1,
              'deadline', slot + 1 + (s.period - all[pick].units + all[i].units - 1) div all[i].units))),
          'start', slot + 1, 'period', s.period - all[pick].units, 'gone', s.gone + 1, 'picks', concat(s.picks, array((s.gone * size(all) + pick) * n_blocks + s.next[pick].done))))), 1))),
    e -> named_struct('next', e.next, 'start', e.start, 'period', e.period, 'gone', e.gone, 'out', concat(o.out, array(e.picks)))), 1),
  o -> o.out)
"""


def all_slots(sources: DataFrame) -> DataFrame:
    """A row for each block: source, units, block, slot, start, period, release, deadline.

    Each slot depends on the one before, so one task goes over the blocks, a few longs for each; it reads the sources' rows
    only and says which source runs. What follows from that (a block's number, and where its windows begin) is added to the
    rows in parallel.
    """
    one = sources.agg(F.sort_array(F.collect_list(F.struct("source", "units", "blocks"))).alias("all"), F.sum("units").alias("whole"), F.sum("blocks").alias("n_blocks"))
    chunks = one.where("n_blocks > 0").select("n_blocks", F.size("all").alias("m"), F.posexplode(F.expr(SCHEDULE)).alias("chunk", "picks"))
    code = F.expr("pick div n_blocks")
    picks = cut(chunks.select("chunk", "m", "n_blocks", F.posexplode("picks").alias("at", "pick")).select(
        (F.col("chunk").cast("long") * CHUNK + F.col("at")).alias("slot"), (F.col("pick") % F.col("n_blocks")).alias("block"),
        (code % F.col("m")).cast("int").alias("i"), F.floor(code / F.col("m")).cast("int").alias("gone")), "picks")
    listed = one.select(F.posexplode("all").alias("i", "x")).select("i", "x.source", "x.units")
    base = picks.groupBy("i", "gone").agg(F.min("block").alias("base"))
    # a phase for each source that is used up: those left in it share its slots. MAX_SOURCES rows at most
    ends = picks.groupBy("i").agg(F.max("gone").alias("last")).join(F.broadcast(listed), "i")
    left = F.sum("units").over(Window.orderBy(F.desc("last")).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    phases = picks.groupBy("gone").agg(F.min("slot").alias("start")).join(F.broadcast(ends.select(F.col("last").alias("gone"), left.alias("period"))), "gone")
    out = picks.join(F.broadcast(listed), "i").join(F.broadcast(phases), "gone").join(base, ["i", "gone"])
    return out.select(
        "source", "units", "block", "slot", "start", "period",
        F.expr("((block - base) * period) div units").alias("release"), F.expr("((block - base + 1) * period + units - 1) div units").alias("deadline"),
    )


def source_table(counts: DataFrame, weights: dict[str, float] | None, temperature: float, block_rows: int, units: dict[str | None, int] | None = None) -> DataFrame:
    """One row per source: n_rows, blocks and units, its weight in PARTS of the whole, 1 at least.

    counts has (source, n) and any number of rows for a source. Without weights, a source's weight is its row count to the power
    temperature. units gives the sources' units in place of both; a source that it leaves out has 1.
    """
    sources = counts.groupBy("source").agg(F.sum("n").alias("n_rows"))
    if units is not None:
        listed = F.lit(json.dumps([{"named": name, "units": int(n)} for name, n in units.items()]))
        given = counts.sparkSession.range(1).select(F.inline(F.from_json(listed, "array<struct<named:string,units:bigint>>")))
        found = sources.join(F.broadcast(given), sources.source.eqNullSafe(given.named), "left")  # MAX_SOURCES rows at most
        return found.select("source", "n_rows", F.ceil(F.col("n_rows") / block_rows).alias("blocks"), F.greatest(F.lit(1), F.col("units")).cast("long").alias("units"))
    if weights is None:
        weight = F.pow(F.col("n_rows").cast("double"), F.lit(float(temperature)))
    else:
        listed = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.expr("map('', 0D)")
        weight = F.greatest(F.coalesce(F.try_element_at(listed, F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(0.0)), F.lit(0.0))
    sources = sources.withColumn("weight", weight)
    total = sources.agg(F.sum("weight").alias("total"))
    units = F.greatest(F.lit(1), F.coalesce(F.round(F.try_divide(F.col("weight") * PARTS, "total")), F.lit(1))).cast("long")
    return sources.crossJoin(F.broadcast(total)).select("source", "n_rows", F.ceil(F.col("n_rows") / block_rows).alias("blocks"), units.alias("units"))  # one row of totals


def refuse(n: int) -> None:
    if n > MAX_SOURCES:
        raise ValueError(f"{n} sources; at most {MAX_SOURCES} can be mixed, so merge small ones first")


def source_units(df: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, temperature: float = 0.5) -> dict[str | None, int]:
    """Each source's weight in PARTS of the whole, 1 at least, as mix_sources() takes them for units. No rows have none; more than
    MAX_SOURCES sources are refused with ValueError."""
    counts = cut(df.groupBy(F.col(source_col).cast("string").alias("source")).agg(F.count("*").alias("n")), "counts")
    refuse(counts.count())
    found = source_table(counts, weights, temperature, BLOCK_ROWS).select("source", "units").collect()
    return dict(sorted(map(tuple, found), key=lambda x: (x[0] is not None, x[0] or "")))


def mix_sources(
    df: DataFrame,
    source_col: str = "source",
    key_col: str = "doc_id",
    weights: dict[str, float] | None = None,
    temperature: float = 0.5,
    block_rows: int = BLOCK_ROWS,
    buckets: int | None = None,
    units: dict[str | None, int] | None = None,
) -> DataFrame:
    """Give each row its place in a mixture of the sources.

    Rows of a source are put in the order of the MD5 of their key and cut into blocks of block_rows. Each block has a release
    slot and a deadline slot from its source's weight, to one part in PARTS, and earliest-deadline-first over these windows
    fills every slot: at each slot a source's number of blocks differs from its share by less than one block, however many
    slots there are. When a source is used up, the others share its slots in proportion from the next slot on. No row is
    dropped or repeated, and places depend on the rows and arguments alone.

    Added: mix_block (the source's block, from 0), mix_units and mix_period (share = units / period), mix_slot, mix_start (the
    slot after which the last source was used up), mix_release and mix_deadline (slots from mix_start) and mix_position
    (slot * block_rows + place in the block; unique if keys are). A column of such a name is replaced.

    A null source is a source of its own; sources that weights leaves out, or gives zero or less, get one part of PARTS, so
    they come last. units, from source_units(), stands for weights and temperature. Rows with equal keys stand next to each other, in any order. An empty frame gives an empty one. Skew: rows
    are numbered within (source, bucket), with prefix sums over the buckets, so a source with most rows is spread over as
    many tasks as its rows ask for. The sources' table goes to every task: more than MAX_SOURCES sources are refused with
    ValueError. One task makes the schedule: choose block_rows so that there are some ten million blocks at most.
    """
    made = ["mix_block", "mix_units", "mix_period", "mix_release", "mix_deadline", "mix_slot", "mix_start", "mix_position"]
    df = df.drop(*made)
    buckets = buckets or max(BUCKETS, -(-df.count() // BUCKET_ROWS))
    src, bucket, order, place = fresh(df, "m_source", "m_bucket", "m_order", "m_place")
    rows = df.withColumn(src, F.col(source_col).cast("string")).withColumn(order, F.md5(F.coalesce(F.col(key_col).cast("string"), F.lit(""))))
    rows = rows.withColumn(bucket, F.expr(f"cast(conv(substr({order}, 1, 8), 16, 10) as bigint) * {int(buckets)} div 4294967296"))
    counts = cut(rows.groupBy(F.col(src).alias("source"), F.col(bucket).alias("bucket")).agg(F.count("*").alias("n")), "counts")
    sources = cut(source_table(counts, weights, temperature, block_rows, units).coalesce(1), "sources")
    refuse(sources.count())
    slots = cut(all_slots(sources), "slots")

    def to_all(frame: DataFrame, n_rows: int) -> DataFrame:
        return F.broadcast(frame) if n_rows <= BROADCAST_ROWS else frame

    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    o_source, o_bucket, o_before = fresh(rows, "o_source", "o_bucket", "before")
    offsets = counts.select(F.col("source").alias(o_source), F.col("bucket").alias(o_bucket), F.coalesce(before, F.lit(0)).alias(o_before))

    numbered = rows.withColumn(place, F.row_number().over(Window.partitionBy(src, bucket).orderBy(order, key_col)) - 1)
    numbered = numbered.join(to_all(offsets, counts.count()), numbered[src].eqNullSafe(offsets[o_source]) & (numbered[bucket] == offsets[o_bucket]))
    (number,) = fresh(numbered, "number")
    numbered = numbered.withColumn(number, F.col(o_before) + F.col(place)).withColumn("mix_block", F.expr(f"{number} div {int(block_rows)}"))
    x = slots.toDF(*(xn := fresh(numbered, *slots.columns)))
    of = dict(zip(slots.columns, xn, strict=True))
    placed = numbered.join(to_all(x, slots.count()), numbered[src].eqNullSafe(x[of["source"]]) & (numbered["mix_block"] == x[of["block"]]))
    for name in ("units", "period", "release", "deadline", "slot", "start"):
        placed = placed.withColumn(f"mix_{name}", F.col(of[name]))
    return placed.withColumn("mix_position", F.col("mix_slot") * block_rows + F.col(number) % block_rows).select(*df.columns, *made)
