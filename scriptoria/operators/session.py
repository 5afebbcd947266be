"""A whole study session for each learner: due reviews first, new items with what they leave of the budget, one order for all."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.operators import planner as P
from scriptoria.operators.recall import DEFAULT_SECONDS, MAX_ANSWER_MS, days_to_exam, moment, study_day_start
from scriptoria.operators.tables import settled

#: Last answers of a learner from which the usual time of an answer is taken, and those of a type that it needs.
RECENT, ENOUGH = 1000, 10
#: Exams that are not known are this many days away.
FAR = 9999


@dataclass(frozen=True)
class Settings:
    """budget_seconds overrides what daily_minutes and today's answers leave; new_limit overrides new_per_day, the subjects'
    limits and the pause while reviews wait."""

    daily_minutes: float = 20
    new_per_day: int = 10
    interleave: bool = True
    budget_seconds: float | None = None
    ignore_studied_today: bool = False
    new_limit: int | None = None


@dataclass(frozen=True)
class SessionPlan:
    """cards: learner, place (from 0), item_id, material_id, topic_id, subject_id, type, is_new, seconds; summary: a row for each
    learner with items."""

    cards: DataFrame
    summary: DataFrame


def usual_seconds(log: DataFrame, items: DataFrame, materials: DataFrame) -> DataFrame:
    """learner, type, seconds: the upper median of the learner's last RECENT answers of a type, 4 at least, where there are
    ENOUGH. Only the last answers of each learner reach the shuffle's other side."""
    rows = log.where("duration_ms IS NOT NULL").join(items.select("item_id", "learner", "material_id"), "item_id").join(materials.select("material_id", "type"), "material_id")
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy("learner").orderBy(F.desc("ts"), "log_id"))).where(F.col("n") <= RECENT)
    taken = F.least("duration_ms", F.lit(MAX_ANSWER_MS)) / 1000
    lists = rows.groupBy("learner", "type").agg(F.array_sort(F.collect_list(taken)).alias("xs")).where(F.size("xs") >= ENOUGH)
    return lists.select("learner", "type", F.greatest(F.lit(4.0), F.get("xs", F.floor(F.size("xs") / 2).cast("int"))).alias("usual"))


def budgets(items: DataFrame, log: DataFrame, now: str, s: Settings) -> DataFrame:
    """learner, studied (seconds today) and budget (seconds that are left)."""
    today = log.where(F.col("ts") >= study_day_start(now)).join(items.select("item_id", "learner"), "item_id")
    ms = F.sum(F.least(F.coalesce("duration_ms", F.lit(0)), F.lit(MAX_ANSWER_MS)))
    studied = today.groupBy("learner").agg(F.floor(ms / 1000 + 0.5).cast("double").alias("studied"))
    rows = items.select("learner").distinct().join(studied, "learner", "left").withColumn("studied", F.coalesce("studied", F.lit(0.0)))
    left = F.greatest(F.lit(0.0), F.lit(s.daily_minutes * 60.0) - (F.lit(0.0) if s.ignore_studied_today else F.col("studied")))
    return rows.withColumn("budget", F.lit(float(s.budget_seconds)) if s.budget_seconds is not None else left)


def ready_syntheses(items: DataFrame, materials: DataFrame) -> DataFrame:
    """learner and topic_id where every active material of the topic that is no synthesis has an item the learner has answered."""
    parts = materials.where("status = 'active' AND NOT synthesis").select("material_id", "topic_id")
    need = parts.groupBy("topic_id").agg(F.count("*").alias("need"))
    answered = items.where("reps > 0").select("learner", "material_id").distinct().join(parts, "material_id").groupBy("learner", "topic_id").agg(F.count("*").alias("have"))
    return answered.join(need, "topic_id").where("have = need").select("learner", "topic_id")


def _folded(due: DataFrame, budget: DataFrame) -> DataFrame:
    """learner, budget, studied, used, taken (item ids in order), due_total, due_seconds: a learner's due items by falling
    priority, each taken if it still fits. The fold keeps what it takes only, which the budget bounds."""
    entry = F.struct((-F.round("priority", 9)).alias("order"), "item_id", F.col("seconds").cast("double").alias("cost"))
    lists = due.groupBy("learner").agg(F.array_sort(F.collect_list(entry)).alias("list"), F.count("*").alias("due_total"), F.sum("seconds").alias("due_seconds"))

    def step(s: Column, x: Column) -> Column:
        fits = s.used + x.cost <= F.col("budget")
        return F.when(fits, F.struct((s.used + x.cost).alias("used"), F.concat(s.taken, F.array(x.item_id)).alias("taken"))).otherwise(s)

    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<bigint>").alias("taken"))
    rows = budget.join(lists, "learner", "left").withColumn("fold", F.aggregate(F.coalesce("list", F.array().cast("array<struct<order:double,item_id:bigint,cost:double>>")), start, step))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("learner", "budget", "studied", "fold.used", "fold.taken", none("due_total"), none("due_seconds"))


def plan_sessions(items: DataFrame, materials: DataFrame, topics: DataFrame, subjects: DataFrame, exams: DataFrame, log: DataFrame, now: str, settings: Settings = Settings()) -> SessionPlan:
    """The session that every learner has before them now.

    items: learner, item_id, material_id, sub_key, state, reps, due, last_review, stability, suspended, buried_until;
    materials: material_id, topic_id, type, status, synthesis, created_at; topics: topic_id, subject_id, exam_weight,
    exam_weight_override; subjects: subject_id, status, daily_new_limit; exams: subject_id, date; log: log_id, item_id, ts,
    duration_ms, counted. An item belongs to one learner.

    Reviews: of each material the due item with the highest priority; by falling priority each that fits the budget. If some
    do not, no new items come. Otherwise new ones of active subjects: of each material the first gap, a synthesis only once the
    rest of its topic was answered; the nearest exam first, then the heavier topic, then the older material, subjects in turn if
    they are mixed; as many as today's limits leave, until one would go over the budget. New items are spread among the
    reviews, and neighbours differ in topic and subject as far as they can; subjects that are not mixed follow each other.

    Ties go to the smaller item_id. Learners without cards have a summary all the same. Nothing is more than one learner's
    candidates in one place.
    """
    day_end = study_day_start(now) + F.expr("interval 1 day")
    seconds = F.create_map(*[F.lit(x) for pair in DEFAULT_SECONDS.items() for x in pair])
    rows = items.where(~F.col("suspended") & (F.col("buried_until").isNull() | (F.col("buried_until") <= moment(now))))
    rows = rows.join(materials.where("status = 'active'").select("material_id", "topic_id", "type", "synthesis", "created_at"), "material_id")
    rows = rows.join(topics.select("topic_id", "subject_id", F.coalesce("exam_weight_override", "exam_weight").alias("weight")), "topic_id")
    rows = rows.join(subjects.where("status <> 'archived'").select("subject_id", "status", "daily_new_limit"), "subject_id")
    rows = rows.join(days_to_exam(exams, now).select("subject_id", "days"), "subject_id", "left").join(usual_seconds(log, items, materials), ["learner", "type"], "left")
    rows = settled(rows.withColumn("seconds", P.estimated_seconds(F.coalesce("usual", F.try_element_at(seconds, "type")), F.col("state") == 0)))

    due = rows.where((F.col("state") != 0) & (F.col("due") <= day_end)).withColumn("priority", P.priority(now))
    best = F.row_number().over(Window.partitionBy("learner", "material_id").orderBy(F.desc(F.round("priority", 9)), "item_id"))
    due = due.withColumn("best", best).where("best = 1")
    folded = settled(_folded(due, budgets(items, log, now, settings)))
    taken = folded.select("learner", F.posexplode("taken").alias("rank", "item_id"))
    card = ["learner", "item_id", "material_id", "topic_id", "subject_id", "type", "days", "seconds"]
    reviews = rows.join(taken, ["learner", "item_id"]).select(*card, F.col("rank").cast("long").alias("rank"))

    ready = ready_syntheses(items, materials).withColumn("ready", F.lit(True))
    new = rows.where("state = 0 AND status = 'active'").join(ready, ["learner", "topic_id"], "left").where("NOT synthesis OR ready")
    number = F.coalesce(F.regexp_extract("sub_key", r"(\d+)", 1).try_cast("bigint"), F.lit(-1).cast("bigint"))
    gap = F.row_number().over(Window.partitionBy("learner", "material_id").orderBy(number, "sub_key", "item_id"))
    new = new.withColumn("gap", gap).where("gap = 1")
    order = [F.coalesce("days", F.lit(FAR)), F.desc("weight"), F.col("created_at"), F.col("item_id")]
    queue = P.round_robin(new, ["learner"], "subject_id", order) if settings.interleave else new.withColumn("place", F.row_number().over(Window.partitionBy("learner").orderBy(*order)))
    first = log.where("counted").groupBy("item_id").agg(F.min("ts").alias("first")).where(F.col("first") >= study_day_start(now))
    began = first.join(items.select("item_id", "learner", "material_id"), "item_id").join(materials.select("material_id", "topic_id"), "material_id").join(topics.select("topic_id", "subject_id"), "topic_id")
    began = began.groupBy("learner", "subject_id").agg(F.count("*").alias("begun"))
    limit = settings.new_limit
    if limit is None:
        total = began.groupBy("learner").agg(F.sum("begun").alias("begun_in_all"))
        queue = queue.join(began, ["learner", "subject_id"], "left").join(total, "learner", "left")
        inside = F.row_number().over(Window.partitionBy("learner", "subject_id").orderBy("place"))
        queue = queue.withColumn("inside", inside).where(F.col("daily_new_limit").isNull() | (F.col("inside") <= F.col("daily_new_limit") - F.coalesce("begun", F.lit(0))))
        left = F.greatest(F.lit(0), settings.new_per_day - F.coalesce("begun_in_all", F.lit(0)))
    else:
        left = F.lit(limit)
    open_ = folded.where("due_total = size(taken)") if limit is None else folded
    line = Window.partitionBy("learner").orderBy("place")
    queue = queue.join(open_.select("learner", "budget", "used"), "learner").withColumn("n", F.row_number().over(line)).withColumn("cost", F.sum("seconds").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    added = queue.where((F.col("n") <= left) & (F.col("used") + F.col("cost") <= F.col("budget"))).select(*card, F.col("n").cast("long").alias("rank"))

    line_up = P.arranged(reviews, added, ["learner"], "rank").select(*card, "new", "place")
    kinds = "learner long, item_id long, material_id long, topic_id long, subject_id long, type string, days int, seconds long, new boolean, place long"
    by = ["learner"] if settings.interleave else ["learner", "subject_id"]
    cards = P.spread(line_up.withColumns({c: F.col(c).cast(k) for c, k in (x.split(" ") for x in kinds.split(", "))}), by, kinds)
    if not settings.interleave:
        ahead = [F.coalesce("days", F.lit(FAR)), F.col("subject_id"), F.col("place")]
        cards = cards.withColumn("place", (F.row_number().over(Window.partitionBy("learner").orderBy(*ahead)) - 1).cast("long"))
    cards = settled(cards.select("learner", "place", "item_id", "material_id", "topic_id", "subject_id", "type", F.col("new").alias("is_new"), "seconds"))

    sums = cards.groupBy("learner").agg(F.count_if("is_new").alias("new_included"), F.sum("seconds").alias("est_seconds"))
    available = new.groupBy("learner").agg(F.count("*").alias("new_available"))
    out = folded.join(sums, "learner", "left").join(available, "learner", "left")
    deferred, full = F.col("due_total") - F.size("taken"), max(60.0, settings.daily_minutes * 60.0)
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    summary = out.select(
        "learner", "budget", "studied", none("est_seconds"), F.col("due_total").cast("long").alias("due_total"), F.size("taken").cast("long").alias("due_included"), none("new_included"), deferred.cast("long").alias("deferred"),
        F.when(deferred > 0, F.ceil(F.col("due_seconds") / full)).otherwise(0).cast("long").alias("backlog_days"), ((deferred > 0) & F.lit(limit is None)).alias("new_paused"), none("new_available"),
    )
    return SessionPlan(cards, summary)
