"""Changes by people and imports, as tables of what they change: deletions, decisions, suggestions, versions, topic lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators.search import similar_names


def after_deletion(materials: DataFrame, citations: DataFrame, chunks: DataFrame, deleted: DataFrame) -> DataFrame:
    """materials with the status that deleting documents (document) leaves: those that cited a deleted document and no other
    go back for review, unless they are rejected. Materials without citations stay as they are."""
    gone = chunks.select("chunk_id", "document").join(deleted.select("document").distinct().withColumn("gone", F.lit(True)), "document", "left")
    cited = citations.where("owner_type = 'material'").select(F.col("owner_id").alias("material_id"), "chunk_id").join(gone, "chunk_id")
    orphans = cited.groupBy("material_id").agg(F.min(F.coalesce("gone", F.lit(False))).alias("orphan"))
    status = F.when(F.col("orphan") & (F.col("status") != "rejected"), "needs_review").otherwise(F.col("status"))
    return materials.join(orphans, "material_id", "left").withColumn("status", status).drop("orphan")


def resolved_fields(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status of the fields of decided conflicts: field_id, status, superseded.

    conflicts: conflict_id, candidates_json (an array of field ids); decisions: conflict_id, chosen. A decision whose choice is
    no candidate has no effect. The chosen field is active, or conflicted if a conflict without a decision names it too; the
    others are superseded. Where decisions about a field differ, the one with the greatest conflict_id holds; superseded tells
    whether any decision set the field aside.
    """
    listed = conflicts.select("conflict_id", F.from_json("candidates_json", "array<bigint>").alias("candidates"))
    all_fields = listed.join(decisions, "conflict_id", "left")
    all_fields = all_fields.withColumn("decided", F.coalesce(F.array_contains("candidates", F.col("chosen")), F.lit(False)))
    rows = all_fields.select("conflict_id", "decided", "chosen", F.explode(F.array_distinct("candidates")).alias("field_id"))
    wins = F.col("chosen") == F.col("field_id")
    fields = rows.groupBy("field_id").agg(
        F.max(F.when(F.col("decided"), F.struct("conflict_id", wins.alias("wins")))).alias("last"),
        F.max(~F.col("decided")).alias("open"),
        F.max(F.coalesce(F.col("decided") & ~wins, F.lit(False))).alias("superseded"),
    )
    status = F.when(~F.col("last.wins"), "superseded").when(F.col("open"), "conflicted").otherwise("active")
    return fields.where("last IS NOT NULL").select("field_id", status.alias("status"), "superseded")


def after_decisions(materials: DataFrame, links: DataFrame, fields: DataFrame) -> DataFrame:
    """materials with active or pending ones back for review where they build on a field that a decision set aside."""
    hit = links.join(fields.where("superseded").select("field_id"), "field_id", "left_semi").select("material_id").distinct().withColumn("hit", F.lit(True))
    status = F.when(F.col("hit") & F.col("status").isin("active", "pending"), "needs_review").otherwise(F.col("status"))
    return materials.join(hit, "material_id", "left").withColumn("status", status).drop("hit")


def after_review(items: DataFrame, materials: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with their material's status and whether they are suspended, after decisions (material_id, action, too_easy):
    approve makes pending, flagged and active materials active and lets their items go on; reject sets the material aside and
    remembers whether it was too easy; flag suspends the items and leaves the material. One decision for a material."""
    rows = items.select("item_id", "material_id", "suspended").join(materials.select("material_id", "status"), "material_id").join(decisions, "material_id", "left")
    approved, rejected = F.col("action") == "approve", F.col("action") == "reject"
    status = F.when(approved & F.col("status").isin("pending", "needs_review", "active"), "active").when(rejected, "rejected").otherwise(F.col("status"))
    suspended = F.when(approved, F.lit(False)).when(F.col("action") == "flag", F.lit(True)).otherwise(F.col("suspended"))
    return rows.select("item_id", "material_id", status.alias("status"), suspended.alias("suspended"), F.coalesce(rejected & F.col("too_easy"), F.lit(False)).alias("too_easy"))


def added_suggestions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Suggestions (id, subject_id, kind, text, created) that come to those there are (the same and status): texts are trimmed,
    empty ones go, one that is open already is not added, and of equal new ones the first is (by created and id)."""
    key = ["subject_id", "kind", "text"]
    trimmed = incoming.withColumn("text", T.collapsed(F.col("text"))).where("text != ''")
    first = trimmed.groupBy(*key).agg(F.min(F.struct("created", "id")).alias("first"))
    fresh = first.join(existing.where("status = 'open'").select(*key).distinct(), key, "left_anti")
    return fresh.select("first.id", *key, "first.created")


def open_suggestions(suggestions: DataFrame, topics: DataFrame) -> DataFrame:
    """Open suggestions with their topic's name, if any, and their place in the subject's list, the newest first."""
    rows = suggestions.where("status = 'open'").join(topics.select("topic_id", F.col("name").alias("topic_name")), "topic_id", "left")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("subject_id").orderBy(F.desc("created"), "id")))


def import_versions(known: DataFrame, files: DataFrame) -> DataFrame:
    """What importing files (file_id, subject_id, name, kind, hash) does beside known documents (subject_id, name, kind, hash,
    version): file_id, duplicate, version.

    A file whose hash the subject has, or has from an earlier file of this import, is a duplicate with a null version. Others
    get the version after that of their name and kind, in the order of file_id.
    """
    stored = known.select("subject_id", "hash").distinct().withColumn("stored", F.lit(True))
    firsts = files.groupBy("subject_id", "hash").agg(F.min("file_id").alias("first_id")).join(stored, ["subject_id", "hash"], "left")
    rows = files.join(firsts, ["subject_id", "hash"]).withColumn("duplicate", F.col("stored").isNotNull() | (F.col("file_id") != F.col("first_id")))
    name = ["subject_id", "name", "kind"]
    before = known.groupBy(*name).agg(F.max("version").alias("before"))
    fresh = rows.where("NOT duplicate").join(before, name, "left")
    number = F.row_number().over(Window.partitionBy(*name).orderBy("file_id"))
    fresh = fresh.select("file_id", F.lit(False).alias("duplicate"), (F.coalesce("before", F.lit(0)) + number).cast("bigint").alias("version"))
    return fresh.unionByName(rows.where("duplicate").select("file_id", "duplicate", F.lit(None).cast("bigint").alias("version")))


def list_lines(text: Column) -> Column:
    """Lines of a list of topics without their numbers and bullets, of 3 to 160 characters."""
    marker = r"(?i)^\s*(\d+[.)]|[-*•]|[a-z]\))\s*"  # fixed value: the marks of list items
    lines = F.transform(F.split(text, "\n+"), lambda s: F.trim(F.regexp_replace(s, marker, "")))
    return F.filter(lines, lambda s: F.length(s).between(3, 160))


def matched_topics(lists: DataFrame, topics: DataFrame, text: str) -> DataFrame:
    """Each different line of topic lists (column text) with its topic of topics (topic_id, name): the one of the same name
    without case and marks, else the most alike with Jaccard 0.5 or more, else null: line, topic_id, how."""
    plain = lambda c: T.collapsed(T.fold(F.col(c)))
    lines = lists.select(F.explode(list_lines(F.col(text))).alias("line")).distinct().withColumn("plain", plain("line"))
    named = topics.withColumn("plain", plain("name")).groupBy("plain").agg(F.min("topic_id").alias("same_id"))
    found = lines.join(named, "plain", "left")
    rest = found.where("same_id IS NULL").select("line", F.col("line").alias("name"))
    alike = similar_names(rest, topics, "line", "topic_id", "name", 0.5, 1).select("line", F.col("topic_id").alias("alike_id"))
    out = found.join(alike, "line", "left")
    how = F.when(F.col("same_id").isNotNull(), "same").when(F.col("alike_id").isNotNull(), "alike").otherwise("new")
    return out.select("line", F.coalesce("same_id", "alike_id").alias("topic_id"), how.alias("how"))
