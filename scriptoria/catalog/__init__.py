"""The learning tables' schemas by version, and frames brought into their form."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Columns of each table and the version that brought them. Parents come before their children.
TABLES: dict[str, list[tuple[int, str]]] = {
    "subject": [(1, "id string, name string, status string, target_retention double, daily_new_limit int, updated_at timestamp"), (3, "learn_article_numbers boolean")],
    "exam": [(1, "id string, subject_id string, kind string, format string, date date, updated_at timestamp")],
    "legal_act": [(1, "id string, abbrev string, title string, state_as_of date, updated_at timestamp")],
    "source_document": [(1, "id string, subject_id string, kind string, title string, file_hash string, lecture_date date, version int, updated_at timestamp"), (4, "url string, meta_json string")],
    "source_chunk": [(1, "id string, document_id string, ord int, heading_path array<string>, page_from int, page_to int, text string, text_hash string, processed_at timestamp")],
    "section": [(1, "id string, subject_id string, parent_id string, title string, ord int, origin string, updated_at timestamp")],
    "topic": [(1, "id string, subject_id string, section_id string, name string, aliases array<string>, exam_weight double, emphasis int, on_exam_list int, updated_at timestamp"), (3, "exam_weight_override double")],
    "topic_field": [(1, "id string, topic_id string, field_type string, content_json string, ord int, status string, updated_at timestamp")],
    "topic_relation": [(1, "id string, from_topic string, to_topic string, type string, updated_at timestamp")],
    "citation": [(1, "id string, owner_type string, owner_id string, chunk_id string, quote string, char_start int, char_end int, verified boolean")],
    "source_conflict": [(1, "id string, topic_id string, candidates_json string, status string, resolution string, updated_at timestamp")],
    "material": [(1, "id string, topic_id string, type string, payload_json string, status string, created_at timestamp, updated_at timestamp")],
    "material_field": [(1, "material_id string, topic_field_id string")],
    "review_item": [(1, "id string, material_id string, sub_key string, due timestamp, stability double, difficulty double, reps int, lapses int, state int, last_review timestamp, buried_until timestamp, suspended boolean, updated_at timestamp")],
    "review_log": [(1, "id string, review_item_id string, ts timestamp, rating int, confidence int, duration_ms bigint, mode string, counted_in_fsrs boolean"), (2, "prev_state_json string")],
    "suggestion": [(3, "id string, subject_id string, kind string, text string, status string")],
    "job": [(3, "id string, subject_id string, kind string, status string, done int, total int")],
    "setting": [(1, "key string, value string"), (5, "updated_at timestamp")],
    "tombstone": [(1, "table_name string, id string, deleted_at timestamp")],
}
VERSION = max(v for parts in TABLES.values() for v, _ in parts)


def schema_of(table: str, version: int = VERSION) -> StructType:
    return StructType.fromDDL(", ".join(ddl for v, ddl in TABLES[table] if v <= version))


def conformed(df: DataFrame, table: str, version: int = VERSION) -> DataFrame:
    """df with the table's columns in order: missing ones null, others cast; columns that the table lacks go."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(table, version)])


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(valid rows, others with the names of the rules they break); a rule that is null is broken."""
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    marked = df.withColumn("broken", broken)
    return marked.where(F.size("broken") == 0).drop("broken"), marked.where(F.size("broken") > 0)


def subject_rules() -> dict[str, Column]:
    target = F.col("target_retention")
    return {"name": F.trim("name") != "", "status": F.col("status").isin("active", "maintenance", "archived"), "retention": target.isNull() | target.between(0.7, 0.97)}


def clamped(values: dict[str, Column], limits: dict[str, tuple[float, float]]) -> dict[str, Column]:
    """Numbers of settings within their limits."""
    return {k: reduce(lambda x, f: f(x), [lambda x, k=k: F.greatest(x, F.lit(limits[k][0])), lambda x, k=k: F.least(x, F.lit(limits[k][1]))], v) if k in limits else v for k, v in values.items()}
