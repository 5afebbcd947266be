"""The learning tables as expressions over the driver's tables, for Spark and, as SQL, for the oracles.

An event is an answer; its user and type name an item, two neighbouring items are a material, and so on up to topics and
subjects. All expressions are deterministic; the present moment is a constant.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 12:00:00"
SLOTS = ["definition", "basis", "premise", "element", "effect", "exception", "deadline", "case_law", "doctrine", "ratio"]
TYPES = ["qa", "cloze", "list", "distinction", "why"]
SUBJECT_STATUS = {0: "active", 1: "active", 2: "active", 3: "archived", 4: "maintenance"}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def review_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end")
    e, n = read(spark, sf_dir, "events"), F.col("event_id")
    return e.select(
        n.alias("log_id"),
        (F.col("user_id") * 5 + kind).alias("item_id"),
        F.col("ts").cast("timestamp_ntz").alias("ts"),
        F.when((n % 3 == 2) & (n % 5 < 3), F.lit(4)).otherwise(1 + n * 7 % 4).cast("int").alias("rating"),
        F.when(n % 11 != 0, 1 + n % 3).cast("int").alias("confidence"),
        F.when(n % 13 != 0, F.floor(F.col("value") * 1000)).cast("bigint").alias("duration_ms"),
        (F.col("event_type") != "error").alias("counted"),
        F.col("event_type").alias("mode"),
    )


def review_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = review_log(spark, sf_dir)
    items = logs.groupBy("item_id").agg(F.count_if(F.col("counted")).alias("n"), F.count_if(F.col("rating") == 1).alias("l"), F.max("ts").alias("t"))
    new, i = F.col("item_id") % 10 == 0, F.col("item_id")
    return items.select(
        "item_id",
        F.expr("item_id div 2").alias("material_id"),
        F.concat(F.lit("c"), i % 2 * 9 + 1).alias("sub_key"),
        F.when(new, 0).otherwise(F.col("n")).cast("bigint").alias("reps"),
        F.when(new, 0).otherwise(F.col("l")).cast("bigint").alias("lapses"),
        F.when(~new, F.col("t")).alias("last_review"),
        F.when(new, 0).when(i % 10 == 1, 1).when(i % 10 == 2, 3).otherwise(2).cast("int").alias("state"),
        (1 + i % 40 * 1.5).cast("double").alias("stability"),
        (i % 17 == 0).alias("suspended"),
    )


def material(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("material_id")
    return review_item(spark, sf_dir).select("material_id").distinct().select(
        m,
        (m % 40).alias("topic_id"),
        F.get(F.array(*[F.lit(t) for t in TYPES]), (m % 5).cast("int")).alias("type"),
        F.when(m % 19 == 0, "pending").when(m % 23 == 0, "needs_review").otherwise("active").alias("status"),
        (m % 29 == 0).alias("synthesis"),
    )


def topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("topic_id")
    return material(spark, sf_dir).select("topic_id").distinct().select(
        t,
        F.concat(F.lit("topic "), t).alias("name"),
        (t % 5).alias("subject_id"),
        F.when(t % 7 != 0, t % 8).alias("section_id"),
        (t % 11 / 10.0).cast("double").alias("exam_weight"),
        F.when(t % 9 == 0, 0.95).cast("double").alias("exam_weight_override"),
        (t % 3).cast("int").alias("on_exam_list"),
    )


def subject(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.create_map(*[F.lit(x) for kv in SUBJECT_STATUS.items() for x in kv])
    k = F.col("r_regionkey").cast("int")
    return read(spark, sf_dir, "region").select(k.cast("bigint").alias("subject_id"), F.col("r_name").alias("name"), status[k].alias("status"), F.when(k % 2 == 0, k + 3).alias("daily_new_limit"))


def exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("subject_id")
    days = subject(spark, sf_dir).where(s != 3).select(s, F.explode(F.array(s * 9 - 5, s * 9 + 40)).alias("d"))
    return days.select(s, F.date_add(F.lit("2024-02-01").cast("date"), F.col("d").cast("int")).alias("date"))


def topic_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    rows = topic(spark, sf_dir).select("topic_id", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).where((F.col("topic_id") + k) % 3 != 0)
    return rows.select(
        (F.col("topic_id") * 10 + k).alias("field_id"), "topic_id", F.get(F.array(*[F.lit(s) for s in SLOTS]), k).alias("field_type"),
        F.when(F.col("topic_id") * k % 7 == 6, "superseded").otherwise("active").alias("status"), k.cast("int").alias("slot_order"),
    )


def material_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, t = F.col("material_id"), F.col("topic_id")
    links = material(spark, sf_dir).select(m, F.explode(F.array_distinct(F.array(t * 10 + m % 10, t * 10 + m * 3 % 10))).alias("field_id"))
    return links.join(topic_field(spark, sf_dir).select("field_id"), "field_id", "left_semi").select("material_id", "field_id")


_case = lambda x, values: f"CASE {x} " + " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values)) + " END"

#: The same tables for the oracles; queries follow as `WITH {TABLES} SELECT ...`.
TABLES = f"""
review_log AS (
  SELECT event_id AS log_id, user_id * 5 + CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS item_id, ts,
    CAST(CASE WHEN event_id % 3 = 2 AND event_id % 5 < 3 THEN 4 ELSE 1 + event_id * 7 % 4 END AS INTEGER) AS rating,
    CAST(CASE WHEN event_id % 11 <> 0 THEN 1 + event_id % 3 END AS INTEGER) AS confidence,
    CAST(CASE WHEN event_id % 13 <> 0 THEN floor(value * 1000) END AS BIGINT) AS duration_ms, event_type <> 'error' AS counted, event_type AS mode
  FROM events),
review_item AS (
  SELECT item_id, item_id // 2 AS material_id, 'c' || (item_id % 2 * 9 + 1) AS sub_key, CASE WHEN item_id % 10 = 0 THEN 0 ELSE n END AS reps, CASE WHEN item_id % 10 = 0 THEN 0 ELSE l END AS lapses,
    CASE WHEN item_id % 10 <> 0 THEN t END AS last_review, CASE item_id % 10 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 2 END AS state,
    CAST(1 + item_id % 40 * 1.5 AS DOUBLE) AS stability, item_id % 17 = 0 AS suspended
  FROM (SELECT item_id, count(*) FILTER (counted) AS n, count(*) FILTER (rating = 1) AS l, max(ts) AS t FROM review_log GROUP BY item_id)),
material AS (
  SELECT material_id, material_id % 40 AS topic_id, {_case('material_id % 5', TYPES)} AS type,
    CASE WHEN material_id % 19 = 0 THEN 'pending' WHEN material_id % 23 = 0 THEN 'needs_review' ELSE 'active' END AS status, material_id % 29 = 0 AS synthesis
  FROM (SELECT DISTINCT material_id FROM review_item)),
topic AS (
  SELECT topic_id, 'topic ' || topic_id AS name, topic_id % 5 AS subject_id, CASE WHEN topic_id % 7 <> 0 THEN topic_id % 8 END AS section_id, CAST(topic_id % 11 / 10.0 AS DOUBLE) AS exam_weight,
    CAST(CASE WHEN topic_id % 9 = 0 THEN 0.95 END AS DOUBLE) AS exam_weight_override, topic_id % 3 AS on_exam_list
  FROM (SELECT DISTINCT topic_id FROM material)),
subject AS (
  SELECT CAST(r_regionkey AS BIGINT) AS subject_id, r_name AS name, {_case('r_regionkey', SUBJECT_STATUS.values())} AS status, CASE WHEN r_regionkey % 2 = 0 THEN r_regionkey + 3 END AS daily_new_limit FROM region),
exam AS (
  SELECT subject_id, CAST(DATE '2024-02-01' + CAST(d AS INTEGER) AS DATE) AS date FROM (SELECT subject_id, unnest([subject_id * 9 - 5, subject_id * 9 + 40]) AS d FROM subject WHERE subject_id <> 3)),
topic_field AS (
  SELECT topic_id * 10 + k AS field_id, topic_id, {_case('k', SLOTS)} AS field_type, CASE WHEN topic_id * k % 7 = 6 THEN 'superseded' ELSE 'active' END AS status, k AS slot_order
  FROM topic, range(10) r(k) WHERE (topic_id + k) % 3 <> 0),
material_field AS (
  SELECT DISTINCT material_id, field_id FROM (SELECT material_id, unnest([topic_id * 10 + material_id % 10, topic_id * 10 + material_id * 3 % 10]) AS field_id FROM material)
  WHERE field_id IN (SELECT field_id FROM topic_field))
"""

DECAY = -0.1542
FACTOR = 0.9 ** (1 / DECAY) - 1


def recall_sql(at: str) -> str:
    """Recall of a review_item row at a moment, for the oracles."""
    days = f"floor(date_sub('second', last_review, {at}) / 86400.0)"
    return f"CASE WHEN state = 0 OR last_review IS NULL THEN 0.0 ELSE pow(1 + {FACTOR!r} * greatest({days}, 0) / stability, {DECAY!r}) END"
