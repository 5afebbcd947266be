"""Analytics over answer logs and review items: calibration, mastery, readiness, focus, streaks and the like.

Every function takes and gives frames; `now` and other moments are timestamps without zone, in the learner's local time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The study day begins at this hour.
DAY_START_HOUR = 4
#: Longer answers count as this long.
MAX_ANSWER_MS = 120_000
#: Exponent of the forgetting curve, a parameter of the scheduler.
DECAY = -0.1542
# Seconds that an answer takes before there is a history, by material type.
DEFAULT_SECONDS = {"qa": 12.0, "cloze": 12.0, "list": 35.0, "provision": 12.0, "distinction": 20.0, "why": 18.0}


def moment(now: str | Column) -> Column:
    return F.lit(now).cast("timestamp_ntz") if isinstance(now, str) else now


def study_day(ts: Column) -> Column:
    """The day an answer counts for."""
    return (ts - F.expr(f"interval {DAY_START_HOUR} hours")).cast("date")


def study_day_start(now: str | Column) -> Column:
    return study_day(moment(now)).cast("timestamp_ntz") + F.expr(f"interval {DAY_START_HOUR} hours")


def recall_probability(at: str | Column, decay: float = DECAY) -> Column:
    """Chance of recalling an item (state, last_review, stability) at a moment: 0 if new, 0.9 after `stability` days."""
    factor = 0.9 ** (1 / decay) - 1
    at = moment(at)
    days = F.floor(F.timestamp_diff("SECOND", F.col("last_review"), at) / F.lit(86400.0))
    curve = F.pow(1 + F.lit(factor) * F.greatest(days, F.lit(0)) / F.col("stability"), F.lit(decay))
    return F.when((F.col("state") == 0) | F.col("last_review").isNull(), F.lit(0.0)).otherwise(curve)


def calibration(log: DataFrame, since: str | None = None) -> DataFrame:
    """For each stated confidence, the number of answers and of right ones (rating 3 or 4)."""
    rows = log.where(F.col("confidence").isNotNull())
    rows = rows.where(F.col("ts") >= moment(since)) if since else rows
    return rows.groupBy("confidence").agg(F.count("*").alias("answers"), F.count_if(F.col("rating") >= 3).alias("correct"))


def hardest_materials(log: DataFrame, items: DataFrame, materials: DataFrame, limit: int = 8) -> DataFrame:
    """Active materials that are forgotten most: share of rating 1, then lapses. Logs and items are aggregated apart, so
    that joining them multiplies nothing."""
    answers = log.join(items.select("item_id", "material_id"), "item_id").groupBy("material_id").agg(F.count("*").alias("answers"), F.avg((F.col("rating") == 1).cast("int")).alias("again_share"))
    lapses = items.groupBy("material_id").agg(F.max("lapses").alias("lapses"))
    rows = materials.where("status = 'active'").select("material_id", "topic_id").join(lapses, "material_id").join(answers, "material_id")
    rows = rows.where((F.col("answers") >= 3) & ((F.col("lapses") > 0) | (F.col("again_share") >= 0.3)))
    return rows.orderBy(F.desc("again_share"), F.desc("lapses"), "material_id").limit(limit)


def introduced_since(log: DataFrame, items: DataFrame, materials: DataFrame, topics: DataFrame, since: str | Column) -> DataFrame:
    """Items first answered since a moment, by subject."""
    first = log.where("counted").groupBy("item_id").agg(F.min("ts").alias("first")).where(F.col("first") >= moment(since))
    rows = first.join(items.select("item_id", "material_id"), "item_id").join(materials.select("material_id", "topic_id"), "material_id").join(topics.select("topic_id", "subject_id"), "topic_id")
    return rows.groupBy("subject_id").agg(F.count("*").alias("introduced"))


def typical_seconds(log: DataFrame, items: DataFrame, materials: DataFrame, last: int = 1000) -> DataFrame:
    """Seconds an answer of each type takes: the upper median of the last answers, from ten of a type on, 4 at least;
    otherwise the default. The window of `last` answers is a feature: habits change."""
    recent = log.where(F.col("duration_ms").isNotNull()).join(items.select("item_id", "material_id"), "item_id").join(materials.select("material_id", "type"), "material_id")
    recent = recent.orderBy(F.desc("ts"), "log_id").limit(last)
    taken = F.least("duration_ms", F.lit(MAX_ANSWER_MS)) / 1000
    by_type = recent.groupBy("type").agg(F.array_sort(F.collect_list(taken)).alias("xs"))  # `last` values at most
    by_type = by_type.where(F.size("xs") >= 10).select("type", F.greatest(F.lit(4.0), F.get("xs", F.floor(F.size("xs") / 2).cast("int"))).alias("measured"))
    defaults = log.sparkSession.createDataFrame(sorted(DEFAULT_SECONDS.items()), "type string, usual double")
    return defaults.join(by_type, "type", "full").select("type", F.coalesce("measured", "usual").alias("seconds"))


def studied_seconds(log: DataFrame, since: str | Column) -> DataFrame:
    ms = F.sum(F.least(F.coalesce("duration_ms", F.lit(0)), F.lit(MAX_ANSWER_MS)))
    return log.where(F.col("ts") >= moment(since)).agg(F.floor(F.coalesce(ms, F.lit(0)) / 1000 + 0.5).alias("seconds"))


def days_to_exam(exams: DataFrame, now: str | Column) -> DataFrame:
    """The nearest coming exam of each subject, the days to it and how urgent that makes the subject."""
    today = study_day(moment(now))
    nearest = exams.where(F.col("date") >= today).groupBy("subject_id").agg(F.min("date").alias("date"))
    return nearest.select("subject_id", "date", F.date_diff("date", today).alias("days")).withColumn("urgency", exam_urgency(F.col("days")))


def exam_urgency(days: Column) -> Column:
    """1 far from an exam or without one, 2.5 on its day."""
    return F.when(days.isNull(), F.lit(1.0)).otherwise(1 + 1.5 * F.exp(-F.greatest(days, F.lit(0)) / 14))


def answers_by_day(log: DataFrame, now: str, days: int = 14) -> DataFrame:
    """Answers of each of the last study days, days without any included."""
    today = study_day(moment(now))
    calendar = log.sparkSession.range(days).select(F.date_sub(today, F.col("id").cast("int")).alias("day"))
    counts = log.groupBy(study_day(F.col("ts")).alias("day")).agg(F.count("*").alias("n"))
    return calendar.join(counts, "day", "left").select("day", F.coalesce("n", F.lit(0)).alias("answers"))


def streaks(log: DataFrame, now: str, by: list[str], horizon: int = 400) -> DataFrame:
    """Study days in a row up to today, or up to yesterday if today has no answer yet: the island of days that ends there."""
    today = study_day(moment(now))
    days = log.select(*by, study_day(F.col("ts")).alias("day")).where((F.col("day") <= today) & (F.col("day") > F.date_sub(today, horizon))).distinct()
    number = F.row_number().over(Window.partitionBy(*by).orderBy("day"))
    islands = days.withColumn("island", F.date_sub("day", number)).groupBy(*by, "island").agg(F.max("day").alias("last"), F.count("*").alias("streak"))
    return islands.where(F.col("last") >= F.date_sub(today, 1)).select(*by, "streak")


def learning_items(items: DataFrame, materials: DataFrame, topics: DataFrame) -> DataFrame:
    """Items that count for progress: of active materials, not suspended, with their topic and subject."""
    active = materials.where("status = 'active'").select("material_id", "topic_id")
    return items.where("not suspended").join(active, "material_id").join(topics.select("topic_id", "subject_id", "section_id"), "topic_id")


def topic_mastery(items: DataFrame, materials: DataFrame, topics: DataFrame, now: str | Column) -> DataFrame:
    """Mean recall of a topic's items, 0 for a topic without items, with counts and what the topic weighs."""
    rows = learning_items(items, materials, topics).withColumn("recall", recall_probability(now))
    found = rows.groupBy("topic_id").agg(F.avg("recall").alias("mean"), F.count("*").alias("n"), F.count_if(F.col("reps") > 0).alias("l"))
    return topics.join(found, "topic_id", "left").select(
        "topic_id", "name", "subject_id", "section_id", F.coalesce("mean", F.lit(0.0)).alias("mastery"), F.coalesce("n", F.lit(0)).alias("items"),
        F.coalesce("l", F.lit(0)).alias("learned"), F.coalesce("exam_weight_override", "exam_weight").alias("weight"), (F.col("on_exam_list") == 2).alias("on_list"),
    )


def section_mastery(mastery: DataFrame) -> DataFrame:
    """Mean of the topics that have items: topics count alike, whatever their number of items."""
    return mastery.groupBy("subject_id", "section_id").agg(F.coalesce(F.avg(F.when(F.col("items") > 0, F.col("mastery"))), F.lit(0.0)).alias("mastery"), F.count("*").alias("topics"))


def subject_mastery(items: DataFrame, materials: DataFrame, topics: DataFrame, subjects: DataFrame, exams: DataFrame, now: str) -> DataFrame:
    """Mean over the subject's items, now and at 9:00 of its next exam (readiness; null without exam or items)."""
    rows = learning_items(items, materials, topics)
    coming = days_to_exam(exams, now).select("subject_id", F.col("date").alias("exam_date"))
    exam_at = F.col("exam_date").cast("timestamp_ntz") + F.expr("interval 9 hours")
    rows = rows.join(coming, "subject_id", "left")
    found = rows.groupBy("subject_id").agg(
        F.avg(recall_probability(now)).alias("mastery"), F.count("*").alias("items"), F.count_if(F.col("reps") > 0).alias("learned"),
        F.avg(F.when(F.col("exam_date").isNotNull(), recall_probability(exam_at))).alias("readiness"),
    )
    out = subjects.where("status != 'archived'").join(found, "subject_id", "left").join(coming, "subject_id", "left")
    return out.select("subject_id", "name", F.coalesce("mastery", F.lit(0.0)).alias("mastery"), F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("learned", F.lit(0)).alias("learned"), "exam_date", "readiness")


def today_focus(mastery: DataFrame, subjects: DataFrame, limit: int = 5) -> DataFrame:
    """Topics of active subjects most worth today's attention: heavy and weakly remembered."""
    rows = mastery.join(subjects.where("status = 'active'").select("subject_id", F.col("name").alias("subject")), "subject_id")
    rows = rows.where(((F.col("items") > 0) | F.col("on_list")) & ~((F.col("items") > 0) & (F.col("learned") == F.col("items")) & (F.col("mastery") >= 0.9)))
    rows = rows.withColumn("worth", (0.3 + F.col("weight")) * (1 - F.col("mastery")))
    return rows.orderBy(F.desc("worth"), "topic_id").limit(limit).select("topic_id", "subject", "items", "learned", "worth")


def material_slots(links: DataFrame, fields: DataFrame) -> DataFrame:
    """The part of its topic that a material belongs to: the earliest part of its fields."""
    return links.join(fields.select("field_id", "field_type", "slot_order"), "field_id").groupBy("material_id").agg(F.min_by("field_type", "slot_order").alias("slot"))


def topic_parts(topics: DataFrame, fields: DataFrame, materials: DataFrame, links: DataFrame, items: DataFrame, now: str) -> DataFrame:
    """Each part of each topic that has points or materials: how many, how well learned, and whether it lacks materials."""
    points = fields.where("status = 'active'").groupBy("topic_id", F.col("field_type").alias("slot")).agg(F.count("*").alias("points"))
    slotted = material_slots(links, fields).join(materials.where("status in ('active', 'pending')").select("material_id", "topic_id", "status"), "material_id")
    made = slotted.groupBy("topic_id", "slot").agg(F.count("*").alias("materials"))
    live = items.where("not suspended").join(slotted.where("status = 'active'"), "material_id").withColumn("recall", recall_probability(now))
    learned = live.groupBy("topic_id", "slot").agg(F.count("*").alias("items"), F.count_if(F.col("reps") > 0).alias("learned"), F.avg("recall").alias("mastery"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    parts = points.join(made, ["topic_id", "slot"], "full").join(learned, ["topic_id", "slot"], "left").join(topics.select("topic_id"), "topic_id", "left_semi")
    return parts.select("topic_id", "slot", zero("points"), zero("materials"), zero("items"), zero("learned"), F.coalesce("mastery", F.lit(0.0)).alias("mastery"), (F.col("points").isNotNull() & F.col("materials").isNull()).alias("uncovered"))


def topic_list(topics: DataFrame, fields: DataFrame, materials: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each topic: active fields, distinct parts, materials by status, items started."""
    f = fields.where("status = 'active'").groupBy("topic_id").agg(F.count("*").alias("fields"), F.count_distinct("field_type").alias("parts"))
    m = materials.groupBy("topic_id").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "pending").alias("pending"))
    i = items.where("reps > 0").join(materials.where("status = 'active'").select("material_id", "topic_id"), "material_id").groupBy("topic_id").agg(F.count("*").alias("started"))
    out = topics.join(f, "topic_id", "left").join(m, "topic_id", "left").join(i, "topic_id", "left")
    return out.select("topic_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fields", "parts", "active", "pending", "started")])


def lesson_candidates(topics: DataFrame, materials: DataFrame, items: DataFrame, limit: int = 3) -> DataFrame:
    """Topics to begin with: two new cards or more, none answered yet; the heaviest first."""
    live = items.where("not suspended").join(materials.where("status = 'active' and not synthesis").select("material_id", "topic_id"), "material_id")
    n = live.groupBy("topic_id").agg(F.count_if(F.col("reps") == 0).alias("fresh"), F.count_if(F.col("reps") > 0).alias("seen"))
    weight = F.coalesce("exam_weight_override", "exam_weight").alias("weight")
    rows = topics.select("topic_id", weight).join(n.where("fresh >= 2"), "topic_id")
    return rows.orderBy("seen", F.desc("weight"), "topic_id").limit(limit).select("topic_id", "weight", "fresh", "seen")


def untouched_materials(materials: DataFrame, items: DataFrame) -> DataFrame:
    """Active materials, apart from syntheses, of which no item has been answered."""
    return materials.where("status = 'active' and not synthesis").join(items.where("reps > 0").select("material_id"), "material_id", "left_anti")


def status_counts(materials: DataFrame, by: list[str]) -> DataFrame:
    kinds = ("active", "pending", "needs_review", "rejected", "suspended")
    return materials.groupBy(*by).agg(F.count("*").alias("all"), *[F.count_if(F.col("status") == k).alias(k) for k in kinds])


def list_rating(items: Column) -> Column:
    """Suggested rating of a recited list (booleans): all 3; one missed of four or more 2; else 1."""
    missed = F.size(F.filter(items, lambda x: ~x))
    return F.when(missed == 0, 3).when((missed == 1) & (F.size(items) >= 4), 2).otherwise(1)


def verified_share(rows: DataFrame, by: str, ok: Column) -> DataFrame:
    """Model comparison: outputs, accepted ones and their share."""
    return rows.groupBy(by).agg(F.count("*").alias("outputs"), F.count_if(ok).alias("verified"), F.try_divide(F.count_if(ok), F.count("*")).alias("share"))


def course_status(drills: DataFrame, stages: list[str], least_sessions: int, least_share: float) -> DataFrame:
    """Stages of a course in order: done with enough good drills, open if all earlier ones are done (per learner)."""
    good = F.col("correct") >= least_share * F.col("size")
    done = drills.groupBy("learner", "stage").agg(F.count("*").alias("drills"), F.count_if(good).alias("good"), F.max("size").alias("largest"))
    order = F.array_position(F.array(*[F.lit(s) for s in stages]), F.col("stage")).cast("int")
    w = Window.partitionBy("learner").orderBy("place")
    done = done.withColumn("place", order).withColumn("done", F.col("good") >= least_sessions)
    unlocked = F.coalesce(F.min(F.col("done").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)) == 1
    return done.withColumn("unlocked", unlocked)
