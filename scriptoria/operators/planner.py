"""Planning a session within a budget, and replaying answers over review items."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.operators.recall import exam_urgency, recall_probability, study_day_start

#: A new item costs this much more than a known one.
NEW_COST = 1.6
OTHER_SECONDS = 15.0


def estimated_seconds(typical: Column, new: Column) -> Column:
    base = F.coalesce(typical, F.lit(OTHER_SECONDS))
    return F.floor(F.when(new, base * NEW_COST).otherwise(base) + 0.5)


def priority(now: str) -> Column:
    """Of a due item with state, weight, status and days (to the exam): learning items first, then what is likely lost,
    weighed by what it counts for and how soon."""
    learning = F.when(F.col("state").isin(1, 3), 10.0).otherwise(0.0)
    urgency = F.when(F.col("status") == "maintenance", F.lit(0.5)).otherwise(exam_urgency(F.col("days")))
    return learning + (1 - recall_probability(now)) * (0.5 + F.coalesce("weight", F.lit(0.0))) * urgency


def best_per_material(due: DataFrame) -> DataFrame:
    """The due item of each material with the highest priority; ties go to the smaller item id."""
    place = F.row_number().over(Window.partitionBy("material_id").orderBy(F.desc(F.round("priority", 9)), "item_id"))
    return due.withColumn("place", place).where("place = 1").drop("place")


def first_fit(rows: DataFrame, by: list[str], order: list[Column], cost: str, item: str, budget: float) -> DataFrame:
    """For each group, its items in order with taken: whether an item still fits what those taken before it leave. An item
    that does not fit is passed over and later ones are tried. A group is one learner's list and is folded in one pass."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    lists = rows.withColumn("place", place).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("place", F.col(item).alias("item"), F.col(cost).cast("double").alias("cost")))).alias("list"))
    nothing = F.array().cast("array<struct<item:bigint,taken:boolean>>")

    def step(s: Column, x: Column) -> Column:
        fits = s.used + x.cost <= budget
        return F.struct((s.used + F.when(fits, x.cost).otherwise(0.0)).alias("used"), F.concat(s.out, F.array(F.struct(x["item"].cast("bigint").alias("item"), fits.alias("taken")))).alias("out"))

    done = F.aggregate("list", F.struct(F.lit(0.0).alias("used"), nothing.alias("out")), step, lambda s: s.out)
    return lists.select(*by, F.inline(done)).withColumnRenamed("item", item)


def within_caps(rows: DataFrame, by: list[str], group: str, order: list[Column], cost: str, group_cap: Column, cap: int, budget: float) -> DataFrame:
    """New items: up to a cap for each group and one for all, and only as long as the running cost stays in the budget."""
    inside = F.row_number().over(Window.partitionBy(*by, group).orderBy(*order))
    rows = rows.withColumn("inside", inside).where(group_cap.isNull() | (F.col("inside") <= group_cap))
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(w)).withColumn("used", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where((F.col("place") <= cap) & (F.col("used") <= budget)).drop("inside")


def round_robin(rows: DataFrame, by: list[str], group: str, order: list[Column]) -> DataFrame:
    """place: one row of each group in turn, groups in the order of their first rows."""
    w = Window.partitionBy(*by).orderBy(*order)
    rows = rows.withColumn("at", F.row_number().over(w)).withColumn("turn", F.row_number().over(Window.partitionBy(*by, group).orderBy(*order)))
    rows = rows.withColumn("first", F.min("at").over(Window.partitionBy(*by, group)))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("turn", "first"))).drop("at", "turn", "first")


def arranged(reviews: DataFrame, fresh: DataFrame, by: list[str], order: str) -> DataFrame:
    """Reviews and new items in one sequence, a new one after every floor(reviews / new) reviews; place counts from 0."""
    number = lambda df, new: df.withColumn("i", F.row_number().over(Window.partitionBy(*by).orderBy(order)) - 1).withColumn("new", F.lit(new))
    rows = number(reviews, False).unionByName(number(fresh, True))
    w = Window.partitionBy(*by)
    n, r = F.count_if(F.col("new")).over(w), F.count_if(~F.col("new")).over(w)
    gap = F.greatest(F.lit(1), F.floor(F.try_divide(r, n)))
    place = F.when(F.col("new"), F.least(r, (F.col("i") + 1) * gap) + F.col("i")).otherwise(F.col("i") + F.when(n > 0, F.least(n, F.floor(F.col("i") / gap))).otherwise(0))
    return rows.withColumn("place", place.cast("bigint")).drop("i")


def spread(rows: DataFrame, by: list[str], schema: str) -> DataFrame:
    """A learner's cards (place, topic_id, subject_id) reordered so that neighbours differ in topic and subject, or at least
    in topic, as far as they can. Each choice depends on the one before, so a learner's session is one group."""

    def greedy(cards: pd.DataFrame) -> pd.DataFrame:
        pool, out, last = cards.sort_values("place").to_dict("records"), [], None
        while pool:
            differs = lambda c: last is None or (c["topic_id"] != last["topic_id"] and c["subject_id"] != last["subject_id"])  # noqa: B023, E731
            at = next((i for i, c in enumerate(pool) if differs(c)), None)
            if at is None:
                at = next((i for i, c in enumerate(pool) if c["topic_id"] != last["topic_id"]), 0)
            last = pool.pop(at)
            out.append({**last, "place": len(out)})
        return pd.DataFrame(out, columns=cards.columns)

    return rows.groupBy(*by).applyInPandas(greedy, schema)


@dataclass(frozen=True)
class Scheduler:
    """Parameters of the forgetting model: initial stability by rating, difficulty, growth, lapses, decay and retention.
    All are parameters; intervals carry no random part."""

    initial: tuple[float, float, float, float] = (0.212, 1.2931, 2.3065, 8.2956)
    decay: float = -0.1542
    growth: float = 1.8722
    saturation: float = 0.1666
    recall_gain: float = 0.796
    lapse: tuple[float, float, float, float] = (1.4835, 0.0614, 0.2629, 1.6483)
    hard, easy = 0.6014, 1.8729
    retention: float = 0.9

    def interval(self, stability: float) -> float:
        factor = 0.9 ** (1 / self.decay) - 1
        return max(1.0, round(stability / factor * (self.retention ** (1 / self.decay) - 1)))

    def step(self, card: tuple[float, float], rating: int, days: float) -> tuple[float, float]:
        """(stability, difficulty) after an answer `days` after the last one."""
        import math

        stability, difficulty = card
        if stability <= 0:
            return self.initial[rating - 1], min(10.0, max(1.0, 6.4133 - math.exp(0.8334 * (rating - 1)) + 1))
        difficulty = min(10.0, max(1.0, difficulty - 0.8 * (rating - 3) * (10 - difficulty) / 9))
        recall = (1 + (0.9 ** (1 / self.decay) - 1) * days / stability) ** self.decay
        if rating == 1:
            a, b, c, d = self.lapse
            return min(stability, a * difficulty**-b * ((stability + 1) ** c - 1) * math.exp(d * (1 - recall))), difficulty
        bonus = {2: self.hard, 3: 1.0, 4: self.easy}[rating]
        return stability * (1 + math.exp(self.growth) * (11 - difficulty) * stability**-self.saturation * (math.exp((1 - recall) * self.recall_gain) - 1) * bonus), difficulty


REPLAYED = "item_id long, reps int, lapses int, stability double, difficulty double, last_review timestamp_ntz, due timestamp_ntz, state int"


def replay(log: DataFrame, scheduler: Scheduler = Scheduler()) -> DataFrame:
    """Review items as their answers leave them: each item's counted answers, in order of (ts, log_id), step by step.
    Answers are aggregated to one list for an item before Python sees them; dropping a row of the log undoes an answer."""
    lists = log.where("counted").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("ts", "log_id", "rating"))).alias("answers"))

    def run(batches):
        for batch in batches:
            out = []
            for item, answers in zip(batch["item_id"], batch["answers"], strict=True):
                card, last, lapses, state = (0.0, 0.0), None, 0, 0
                for a in answers:
                    ts, rating = pd.Timestamp(a["ts"]), int(a["rating"])
                    days = 0.0 if last is None else max(0.0, (ts - last).total_seconds() // 86_400)
                    lapses += rating == 1 and state == 2
                    card, last = scheduler.step(card, rating, days), ts
                    state = 3 if rating == 1 and state >= 2 else 2 if rating >= 3 else max(state, 1)
                out.append((item, len(answers), int(lapses), *card, last, last + pd.Timedelta(days=scheduler.interval(card[0])), state))
            yield pd.DataFrame(out, columns=["item_id", "reps", "lapses", "stability", "difficulty", "last_review", "due", "state"])

    return lists.mapInPandas(run, REPLAYED)


def sync_items(materials: DataFrame, items: DataFrame) -> DataFrame:
    """What the review items of materials (material_id, keys) need: created, kept or removed, by (material_id, sub_key)."""
    want = materials.select("material_id", F.explode("keys").alias("sub_key")).withColumn("wanted", F.lit(True))
    have = items.select("material_id", "sub_key").distinct().withColumn("had", F.lit(True))
    action = F.when(F.col("had").isNull(), "created").when(F.col("wanted").isNull(), "removed").otherwise("kept")
    return want.join(have, ["material_id", "sub_key"], "full").select("material_id", "sub_key", action.alias("action"))


def exam_weight(rows: DataFrame, key: str) -> DataFrame:
    """Weight of topics from distinct documents by kind (rows: key, document_id, kind, emphasis, on_exam_list): the exam list
    counts most, then lecture notes (more with each lecture, and when stressed), syllabus, acts, and other literature."""
    n = lambda *kinds: F.count_distinct(F.when(F.col("kind").isin(*kinds), F.col("document_id")))
    sums = rows.groupBy(key).agg(n("note").alias("notes"), n("act").alias("acts"), n("textbook", "case_law", "scholarly").alias("books"), F.max("emphasis").alias("emphasis"), F.max("on_exam_list").alias("listed"))
    notes = F.least(F.lit(0.9), 0.5 + 0.1 * (F.col("notes") - 1) + F.when(F.col("emphasis") > 0, 0.2).otherwise(0.0))
    weight = F.greatest(
        F.when(F.col("listed") == 2, 1.0).otherwise(0.0), F.when(F.col("listed") == 1, 0.5).otherwise(0.0), F.when(F.col("notes") > 0, notes).otherwise(0.0),
        F.when(F.col("acts") > 0, 0.3).otherwise(0.0), F.when(F.col("books") > 0, 0.2).otherwise(0.0),
    )
    return sums.select(key, F.round(weight, 2).alias("weight"))


def first_gaps(items: DataFrame, material: str, sub_key: str, item: str) -> DataFrame:
    """Of the unseen items of each material the first by the number in its key, so that c2 comes before c10; ties go to the
    key and then to the item. One aggregate, combined before its shuffle."""
    number = F.regexp_extract(sub_key, r"(\d+)", 1).try_cast("bigint")
    first = F.min(F.struct(F.coalesce(number, F.lit(-1).cast("bigint")).alias("number"), F.col(sub_key), F.col(item))).alias("first")
    return items.groupBy(material).agg(first).select(material, f"first.{item}", f"first.{sub_key}")


def backlog(planned: DataFrame, by: list[str], cost: str, full_budget: float) -> DataFrame:
    """From a list with taken (see first_fit): the deferred items, and the days that all due ones take, 0 if none waits."""
    sums = planned.groupBy(*by).agg(F.count_if(~F.col("taken")).alias("deferred"), F.sum(cost).alias("due"))
    days = F.when(F.col("deferred") > 0, F.ceil(F.col("due") / max(60.0, full_budget))).otherwise(0).cast("bigint")
    return sums.select(*by, "deferred", days.alias("backlog_days"))


def buried(log: DataFrame, items: DataFrame) -> DataFrame:
    """Until when an item waits because another item of its material was answered: the end of the study day of the last such
    answer that counts. Items without an answered sibling have no row."""
    last = log.where("counted").groupBy("item_id").agg(F.max("ts").alias("last"))
    known = items.select("item_id", "material_id").join(last, "item_id", "left")
    # of each material the two items answered last: an item waits for the first of them that it is not itself
    answered = known.where("last IS NOT NULL").withColumn("n", F.row_number().over(Window.partitionBy("material_id").orderBy(F.desc("last"), "item_id"))).where("n <= 2")
    two = answered.groupBy("material_id").agg(F.max(F.when(F.col("n") == 1, F.col("item_id"))).alias("top"), F.max(F.when(F.col("n") == 1, F.col("last"))).alias("one"), F.max(F.when(F.col("n") == 2, F.col("last"))).alias("two"))
    at = F.when(F.col("item_id") == F.col("top"), F.col("two")).otherwise(F.col("one"))
    rows = known.join(two, "material_id").withColumn("at", at).where("at IS NOT NULL")
    return rows.select("item_id", (study_day_start(F.col("at")) + F.expr("interval 1 day")).alias("buried_until"))


def rating_preview(items: DataFrame, days: Column, scheduler: Scheduler = Scheduler()) -> DataFrame:
    """For each item (item_id, stability, difficulty; stability 0 if new) answered `days` after its last answer, its stability
    and interval in days after each of the four ratings. The same model as Scheduler.step, in columns."""
    p = scheduler
    rows = items.withColumn("days", days).withColumn("rating", F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])))
    s, r = F.col("stability"), F.col("rating")
    d = F.least(F.lit(10.0), F.greatest(F.lit(1.0), F.col("difficulty") - 0.8 * (r - 3) * (10 - F.col("difficulty")) / 9))
    lost = 1 - F.pow(1 + F.lit(0.9 ** (1 / p.decay) - 1) * F.col("days") / s, F.lit(p.decay))
    a, b, c, e = p.lapse
    lapsed = F.least(s, a * F.pow(d, F.lit(-b)) * (F.pow(s + 1, F.lit(c)) - 1) * F.exp(e * lost))
    bonus = F.when(r == 2, p.hard).when(r == 4, p.easy).otherwise(1.0)
    grown = s * (1 + F.exp(F.lit(p.growth)) * (11 - d) * F.pow(s, F.lit(-p.saturation)) * (F.exp(lost * p.recall_gain) - 1) * bonus)
    fresh = F.get(F.array(*[F.lit(x) for x in p.initial]), r - 1)
    after = F.when(s <= 0, fresh).when(r == 1, lapsed).otherwise(grown)
    longer = (p.retention ** (1 / p.decay) - 1) / (0.9 ** (1 / p.decay) - 1)
    return rows.withColumn("after", after).select("item_id", "rating", F.col("after").alias("stability"), F.greatest(F.lit(1.0), F.rint(F.col("after") * longer)).cast("bigint").alias("interval"))
