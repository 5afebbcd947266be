"""Queries that plan the sessions of learners, each of whom has sixty items."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptoria.operators.session import Settings, plan_sessions
from scriptoria.plans import bindings as B
from scriptoria.plans.bindings import TABLES, recall_sql
from scriptoria.plans.registry import query

ITEMS = 60
NOW, DAY, TODAY = "2024-01-30 21:00:00", "TIMESTAMP '2024-01-30 04:00:00'", "DATE '2024-01-30'"
MIXED, BLOCKS = Settings(daily_minutes=30, new_per_day=6), Settings(daily_minutes=15, new_per_day=4, interleave=False, ignore_studied_today=True)


def _plan(spark, sf_dir, settings):
    items = B.review_item(spark, sf_dir).withColumns(
        {
            "learner": F.expr(f"item_id div {ITEMS}"),
            "due": F.col("last_review") + F.make_dt_interval(days=F.expr(f"item_id * 7 % 40 * (1 + item_id div {ITEMS} % 12) div 6 - 10").cast("int")),
            "buried_until": F.when(F.col("item_id") % 13 == 0, F.lit("2024-01-31 04:00:00")).cast("timestamp_ntz"),
        }
    )
    materials = B.material(spark, sf_dir).withColumn("created_at", F.col("material_id") * 7 % 31)
    return plan_sessions(items, materials, B.topic(spark, sf_dir), B.subject(spark, sf_dir), B.exam(spark, sf_dir), B.review_log(spark, sf_dir), NOW, settings)


def plan_sql(s: Settings, select: str) -> str:
    budget, studied = s.daily_minutes * 60, "studied" if not s.ignore_studied_today else "0"
    turns = "row_number() OVER (PARTITION BY learner ORDER BY turn, lead_spot)" if s.interleave else "spot"
    one = "c.topic <> last.topic AND c.subject <> last.subject" if s.interleave else "c.topic <> last.topic"
    # in blocks, the cards of each subject are a list of their own
    key = "learner" if s.interleave else "learner, subject_id"
    final = "SELECT *, n - 1 AS final FROM chosen" if s.interleave else f"SELECT c.*, row_number() OVER (PARTITION BY learner ORDER BY coalesce(d.days, 9999), subject_id, n) - 1 AS final FROM chosen c LEFT JOIN days d USING (subject_id)"
    match = "s.learner = c.learner" + ("" if s.interleave else " AND s.subject_id = c.subject_id")
    return f"""WITH RECURSIVE {TABLES}, days AS (SELECT subject_id, CAST(min(date) - {TODAY} AS INTEGER) AS days FROM exam WHERE date >= {TODAY} GROUP BY subject_id),
it AS (SELECT *, item_id // {ITEMS} AS learner, last_review + to_days(CAST(item_id * 7 % 40 * (1 + item_id // {ITEMS} % 12) // 6 - 10 AS INTEGER)) AS due FROM review_item),
recent AS (SELECT learner, type, least(duration_ms, 120000) / 1000 AS s, row_number() OVER (PARTITION BY learner ORDER BY ts DESC, log_id) AS n FROM review_log JOIN it USING (item_id) JOIN material USING (material_id) WHERE duration_ms IS NOT NULL),
ranks AS (SELECT learner, type, s, row_number() OVER (PARTITION BY learner, type ORDER BY s) - 1 AS k, count(*) OVER (PARTITION BY learner, type) AS m FROM recent WHERE n <= 1000),
usual(type, s) AS (VALUES ('qa', 12.0), ('cloze', 12.0), ('list', 35.0), ('provision', 12.0), ('distinction', 20.0), ('why', 18.0)),
studied AS (SELECT learner, floor(sum(least(coalesce(duration_ms, 0), 120000)) / 1000 + 0.5) AS studied FROM review_log JOIN it USING (item_id) WHERE ts >= {DAY} GROUP BY learner),
budget AS (SELECT learner, CAST(coalesce(studied, 0) AS DOUBLE) AS studied, CAST(greatest(0, {budget} - coalesce({studied}, 0)) AS DOUBLE) AS budget FROM (SELECT DISTINCT learner FROM it) LEFT JOIN studied USING (learner)),
cand AS (SELECT i.learner, i.item_id, i.material_id, i.sub_key, m.topic_id, t.subject_id, m.type, m.synthesis, m.material_id * 7 % 31 AS created, i.state, i.due, s.status, s.daily_new_limit, d.days, coalesce(exam_weight_override, exam_weight) AS weight,
  CAST(floor((CASE WHEN i.state = 0 THEN 1.6 ELSE 1 END) * coalesce(greatest(4.0, r.s), u.s, 15) + 0.5) AS BIGINT) AS seconds,
  (CASE WHEN i.state IN (1, 3) THEN 10 ELSE 0 END) + (1 - ({recall_sql(f"TIMESTAMP '{NOW}'")})) * (0.5 + coalesce(exam_weight_override, exam_weight)) * CASE WHEN s.status = 'maintenance' THEN 0.5 WHEN days IS NULL THEN 1 ELSE 1 + 1.5 * exp(-greatest(days, 0) / 14.0) END AS priority
  FROM it i JOIN material m USING (material_id) JOIN topic t ON t.topic_id = m.topic_id JOIN subject s ON s.subject_id = t.subject_id LEFT JOIN days d ON d.subject_id = s.subject_id
  LEFT JOIN ranks r ON r.learner = i.learner AND r.type = m.type AND r.m >= 10 AND r.k = r.m // 2 LEFT JOIN usual u ON u.type = m.type
  WHERE m.status = 'active' AND s.status <> 'archived' AND NOT suspended AND item_id % 13 <> 0),
due AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY round(priority, 9) DESC, item_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY learner, material_id ORDER BY round(priority, 9) DESC, item_id) AS best FROM cand WHERE state <> 0 AND due <= {DAY} + INTERVAL 1 DAY) WHERE best = 1),
fit(learner, place, item_id, used, taken) AS (SELECT learner, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), CAST(0 AS DOUBLE), false FROM budget
  UNION ALL SELECT d.learner, d.place, d.item_id, f.used + CASE WHEN f.used + d.seconds <= budget THEN d.seconds ELSE 0 END, f.used + d.seconds <= budget FROM fit f JOIN due d ON d.learner = f.learner AND d.place = f.place + 1 JOIN budget b ON b.learner = f.learner),
used AS (SELECT learner, max(used) AS used, count(*) FILTER (place > 0) AS due_total, count(*) FILTER (taken) AS due_included FROM fit GROUP BY learner),
whole AS (SELECT l.learner, m.topic_id FROM (SELECT DISTINCT learner FROM it) l, material m LEFT JOIN (SELECT DISTINCT learner, material_id FROM it WHERE reps > 0) a ON a.learner = l.learner AND a.material_id = m.material_id
  WHERE m.status = 'active' AND NOT m.synthesis GROUP BY ALL HAVING count(*) = count(a.material_id)),
gaps AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY learner, material_id ORDER BY CAST(substring(sub_key, 2) AS INTEGER), sub_key, item_id) AS gap FROM cand c
  WHERE state = 0 AND status = 'active' AND (NOT synthesis OR EXISTS (SELECT 1 FROM whole w WHERE w.learner = c.learner AND w.topic_id = c.topic_id))) WHERE gap = 1),
turn AS (SELECT *, row_number() OVER (PARTITION BY learner ORDER BY coalesce(days, 9999), weight DESC, created, item_id) AS spot, row_number() OVER (PARTITION BY learner, subject_id ORDER BY coalesce(days, 9999), weight DESC, created, item_id) AS turn FROM gaps),
queue AS (SELECT *, {turns} AS place FROM (SELECT *, min(spot) OVER (PARTITION BY learner, subject_id) AS lead_spot FROM turn)),
begun AS (SELECT learner, subject_id, count(*) AS begun FROM (SELECT item_id FROM review_log WHERE counted GROUP BY item_id HAVING min(ts) >= {DAY}) JOIN it USING (item_id) JOIN material USING (material_id) JOIN topic USING (topic_id) GROUP BY ALL),
capped AS (SELECT * FROM (SELECT q.*, row_number() OVER (PARTITION BY q.learner, q.subject_id ORDER BY place) AS inside, coalesce(b.begun, 0) AS begun FROM queue q LEFT JOIN begun b ON b.learner = q.learner AND b.subject_id = q.subject_id) WHERE daily_new_limit IS NULL OR inside <= daily_new_limit - begun),
added AS (SELECT * FROM (SELECT c.*, u.used, budget, row_number() OVER w AS n, sum(seconds) OVER w AS cost, greatest(0, {s.new_per_day} - coalesce((SELECT sum(begun) FROM begun b WHERE b.learner = c.learner), 0)) AS most FROM capped c JOIN used u ON u.learner = c.learner AND due_total = due_included JOIN budget b ON b.learner = c.learner
  WINDOW w AS (PARTITION BY c.learner ORDER BY place)) WHERE n <= most AND used + cost <= budget),
mix AS (SELECT d.learner, d.item_id, d.material_id, d.topic_id, d.subject_id, d.type, d.seconds, false AS is_new, row_number() OVER (PARTITION BY d.learner ORDER BY d.place) - 1 AS i FROM due d JOIN fit f ON f.learner = d.learner AND f.item_id = d.item_id AND f.taken
  UNION ALL SELECT learner, item_id, material_id, topic_id, subject_id, type, seconds, true, n - 1 FROM added),
sized AS (SELECT *, count(*) FILTER (is_new) OVER w AS nf, count(*) FILTER (NOT is_new) OVER w AS nr FROM mix WINDOW w AS (PARTITION BY learner)),
spaced AS (SELECT *, CASE WHEN nf = 0 THEN 1 ELSE greatest(1, nr // nf) END AS gap FROM sized),
placed AS (SELECT *, CASE WHEN is_new THEN least(nr, (i + 1) * gap) + i ELSE i + CASE WHEN nf = 0 THEN 0 ELSE least(nf, i // gap) END END AS place FROM spaced),
pools AS (SELECT {key}, list({{'topic': topic_id, 'subject': subject_id, 'item': item_id}} ORDER BY place) AS pool FROM placed GROUP BY {key}),
greedy AS (SELECT {key}, 0 AS n, pool[1:0] AS picked, pool, {{'topic': CAST(-1 AS BIGINT), 'subject': CAST(-1 AS BIGINT), 'item': CAST(-1 AS BIGINT)}} AS last FROM pools
  UNION ALL SELECT {key}, n + 1, pool[spot:spot], pool[1:spot - 1] || pool[spot + 1:], pool[spot] FROM (SELECT *, CASE WHEN apart > 0 THEN apart WHEN other > 0 THEN other ELSE 1 END AS spot FROM (SELECT *, coalesce(list_position(list_transform(pool, lambda c: {one}), true), 0) AS apart, coalesce(list_position(list_transform(pool, lambda c: c.topic <> last.topic), true), 0) AS other FROM greedy WHERE len(pool) > 0))),
chosen AS (SELECT {", ".join("s." + k for k in key.split(", "))}, s.n, c.item_id, c.material_id, c.topic_id, {"c.subject_id, " if s.interleave else ""}c.type, c.is_new, c.seconds FROM greedy s JOIN placed c ON {match} AND c.item_id = s.last.item WHERE s.n > 0),
final AS ({final})
{select}"""


CARDS = "SELECT learner, CAST(final AS BIGINT) AS place, item_id, material_id, topic_id, subject_id, type, is_new, seconds FROM final"


@query(plan_sql(MIXED, CARDS))
def session_plan(spark, sf_dir):
    """Every learner's session, subjects mixed."""
    return _plan(spark, sf_dir, MIXED).cards


@query(plan_sql(BLOCKS, CARDS))
def session_plan_blocks(spark, sf_dir):
    """Every learner's session, one subject after the other."""
    return _plan(spark, sf_dir, BLOCKS).cards


SUMMARY = f"""SELECT b.learner, b.budget, b.studied, CAST(coalesce(est, 0) AS BIGINT) AS est_seconds, due_total, due_included, coalesce(fresh, 0) AS new_included, due_total - due_included AS deferred,
CAST(CASE WHEN due_total > due_included THEN ceil(due_seconds / {MIXED.daily_minutes * 60.0}) ELSE 0 END AS BIGINT) AS backlog_days, due_total > due_included AS new_paused, coalesce(available, 0) AS new_available
FROM budget b JOIN used USING (learner) LEFT JOIN (SELECT learner, sum(seconds) AS est, count(*) FILTER (is_new) AS fresh FROM final GROUP BY learner) USING (learner)
LEFT JOIN (SELECT learner, sum(seconds) AS due_seconds FROM due GROUP BY learner) USING (learner) LEFT JOIN (SELECT learner, count(*) AS available FROM gaps GROUP BY learner) USING (learner)"""


@query(plan_sql(MIXED, SUMMARY))
def session_summary(spark, sf_dir):
    return _plan(spark, sf_dir, MIXED).summary
