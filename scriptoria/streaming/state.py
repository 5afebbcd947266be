"""Streams that remember: review items as their answers arrive, and replica rows that stay deleted once they were deleted.

The session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from scriptoria.operators.planner import Scheduler
from scriptoria.operators.recall import study_day_start

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DAY = 86_400_000_000

CARD = "reps long, lapses long, stability double, difficulty double, last long, state long, buried long"
ITEMS = "item_id long, material_id long, reps long, lapses long, stability double, difficulty double, last long, due long, state long, buried long"


def _micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def _local(micros: Column) -> Column:
    return F.timestamp_micros(micros).cast("timestamp_ntz")


class LiveItems(StatefulProcessor):
    """Of one material: its items' cards, and their answers in case one comes late.

    An answer that is later than all of its item's takes the card one step further. A late one is put in its place and the
    item's answers are gone over again, so what is known never depends on the order in which answers come. An answer buries
    the material's other items until the study day ends, when a timer brings them back.
    """

    def __init__(self, scheduler: Scheduler):
        self.scheduler = scheduler

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cards = handle.getMapState("cards", "item_id long", CARD)
        self.answers = handle.getListState("answers", "item_id long, at long, log_id long, rating long, day_end long")

    def stepped(self, card: tuple, at: int, rating: int) -> tuple:
        reps, lapses, stability, difficulty, last, state, buried = card
        days = 0.0 if last is None else float(max(0, (at - last) // DAY))
        lapses += rating == 1 and state == 2
        stability, difficulty = self.scheduler.step((stability, difficulty), rating, days)
        state = 3 if rating == 1 and state >= 2 else 2 if rating >= 3 else max(state, 1)
        return reps + 1, int(lapses), float(stability), float(difficulty), at, int(state), buried

    def row(self, material: int, item: int, card: tuple) -> tuple:
        due = card[4] + int(self.scheduler.interval(card[2]) * DAY)
        return (item, material, *card[:5], due, card[5], card[6])

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        new = sorted((int(r.item_id), int(r.at), int(r.log_id), int(r.rating), int(r.day_end)) for part in rows for r in part.itertuples())
        cards = {k[0]: tuple(v) for k, v in self.cards.iterator()} if self.cards.exists() else {}
        known = None
        for item in sorted({r[0] for r in new}):
            mine, card = [r for r in new if r[0] == item], cards.get(item, (0, 0, 0.0, 0.0, None, 0, None))
            if card[4] is not None and mine[0][1] <= card[4]:  # late, or at the same moment
                known = known if known is not None else [tuple(map(int, r)) for r in self.answers.get()]
                mine, card = sorted([r for r in known if r[0] == item] + mine), (0, 0, 0.0, 0.0, None, 0, card[6])
            for _, at, _, rating, _ in mine:
                card = self.stepped(card, at, rating)
            cards[item] = card
        self.answers.appendList(new)
        # an item waits for the last answer to another one, whatever came in between
        for item, card in cards.items():
            until = max((r[4] for r in new if r[0] != item), default=None)
            if until is not None and (card[6] is None or until > card[6]):
                cards[item] = (*card[:6], until)
        for until in {r[4] for r in new}:
            self.handle.registerTimer(until // 1000)
        for item, card in cards.items():
            self.cards.updateValue((item,), card)
        yield self.frame([self.row(int(key[0]), item, card) for item, card in sorted(cards.items())])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, out = expiredTimerInfo.getExpiryTimeInMs() * 1000, []
        for (item,), card in [(tuple(k), tuple(v)) for k, v in self.cards.iterator()]:
            if card[6] is not None and card[6] <= now:
                self.cards.updateValue((item,), (*card[:6], None))
                out.append(self.row(int(key[0]), int(item), (*card[:6], None)))
        yield self.frame(sorted(out))

    @staticmethod
    def frame(rows: list[tuple]) -> pd.DataFrame:
        names = [x.split(" ")[0] for x in ITEMS.split(", ")]
        return pd.DataFrame(rows, columns=names).astype({"buried": "Int64"})

    def close(self) -> None:
        pass


def live_items(log: DataFrame, items: DataFrame, scheduler: Scheduler = Scheduler()) -> DataFrame:
    """Review items as a stream of answers (log_id, item_id, ts, rating, counted) leaves them: item_id, material_id, reps, lapses,
    stability, difficulty, last_review, due, state, buried_until.

    items (item_id, material_id) is a table. Write it in update mode: of an item's rows the last one holds, and it is what
    planner.replay makes of all answers so far. Items of which none was answered have no row. Answers that do not count are
    left out; no answer is too late, as the watermark is that of arrival. Timers go by it too: with the first batch after the
    study day's end an item is no longer buried.
    """
    rows = log.where("counted").join(items.select("item_id", "material_id"), "item_id")
    end = study_day_start(F.col("ts").cast("timestamp_ntz")) + F.expr("interval 1 day")
    rows = rows.select("material_id", "item_id", "log_id", _micros(F.col("ts")).alias("at"), _micros(end).alias("day_end"), F.col("rating").cast("long").alias("rating"), F.current_timestamp().alias("arrived"))
    rows = rows.withWatermark("arrived", "0 seconds")
    out = rows.groupBy("material_id").transformWithStateInPandas(LiveItems(scheduler), outputStructType=ITEMS, outputMode="Update", timeMode="EventTime")
    kept = ["item_id", "material_id", F.col("reps").cast("int").alias("reps"), F.col("lapses").cast("int").alias("lapses"), "stability", "difficulty"]
    return out.select(*kept, _local(F.col("last")).alias("last_review"), _local(F.col("due")).alias("due"), F.col("state").cast("int").alias("state"), _local(F.col("buried")).alias("buried_until"))


ROW = "table_name string, id string, updated_at long, payload string, deleted boolean"


class LiveRow(StatefulProcessor):
    """Of one row: its latest version, or that it was deleted, which nothing undoes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.now = handle.getValueState("now", "updated_at long, payload string, deleted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = tuple(self.now.get()) if self.now.exists() else None
        if before and before[2]:
            return
        now = before
        for r in (r for part in rows for r in part.itertuples()):
            if r.deleted:
                stamps = [x[0] for x in (now,) if x and x[2]] + [int(r.updated_at)]
                now = (min(stamps), None, True)  # the first deletion that was recorded
            elif now is None or not now[2]:
                version = (int(r.updated_at), None if r.payload is None or r.payload != r.payload else r.payload, False)
                newer = now is None or version[0] > now[0] or (version[0] == now[0] and (version[1] or "") > (now[1] or ""))
                now = version if newer else now
        if now != before:
            self.now.update(now)
            yield pd.DataFrame([(*key, *now)], columns=[x.split(" ")[0] for x in ROW.split(", ")])

    def close(self) -> None:
        pass


def live_rows(inbox: DataFrame) -> DataFrame:
    """Replica rows (table_name, id, updated_at long, payload, deleted) as a stream of packages leaves them, in update mode: of a
    row's versions the last one emitted holds.

    The latest version wins, of equal stamps the greater payload; a deletion wins over every version, earlier or later, in
    the same package or in any that comes after it. So the order of packages makes no difference to what stays.
    """
    rows = inbox.select("table_name", "id", "updated_at", "payload", F.coalesce("deleted", F.lit(False)).alias("deleted"))
    return rows.groupBy("table_name", "id").transformWithStateInPandas(LiveRow(), outputStructType=ROW, outputMode="Update", timeMode="None")
