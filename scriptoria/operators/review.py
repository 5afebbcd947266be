"""Lists for people: what waits for review, conflicts with a hint, statistics of documents and subjects, checks of material."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T


def review_queue(materials: DataFrame, citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Materials that wait, flagged ones first, with their citations (owner_type is filtered before the join)."""
    waiting = materials.where(F.col("status").isin("pending", "needs_review")).select("material_id", "topic_id", "status")
    cited = citations.where("owner_type = 'material'").select(F.col("owner_id").alias("material_id"), "chunk_id").join(chunks.select("chunk_id", "document"), "chunk_id")
    sources = cited.groupBy("material_id").agg(F.count("*").alias("citations"), F.array_sort(F.collect_set("document")).alias("documents"))
    out = waiting.join(sources, "material_id", "left")
    place = F.row_number().over(Window.partitionBy("topic_id").orderBy((F.col("status") == "needs_review").desc(), "material_id"))
    return out.select("material_id", "topic_id", "status", F.coalesce("citations", F.lit(0)).alias("citations"), F.coalesce(F.array_join("documents", ", "), F.lit("")).alias("documents"), place.alias("place"))


def conflict_hints(candidates: DataFrame) -> DataFrame:
    """Of the candidates (conflict_id, candidate_id, rank) of each conflict the one from the best source, if only one is."""
    best = F.min("rank").over(Window.partitionBy("conflict_id"))
    top = candidates.withColumn("best", best).where("rank = best").groupBy("conflict_id").agg(F.count("*").alias("n"), F.min("candidate_id").alias("candidate_id"))
    return top.select("conflict_id", F.when(F.col("n") == 1, F.col("candidate_id")).alias("hint"))


def document_stats(chunks: DataFrame, citations: DataFrame) -> DataFrame:
    """Chunks, processed ones and cited ones of each document."""
    cited = citations.select("chunk_id").distinct().withColumn("cited", F.lit(True))
    rows = chunks.join(cited, "chunk_id", "left")
    return rows.groupBy("document").agg(F.count("*").alias("chunks"), F.count_if(F.col("processed")).alias("processed"), F.count_if(F.col("cited")).alias("cited"))


def subject_stats(subjects: DataFrame, topics: DataFrame, materials: DataFrame, items: DataFrame) -> DataFrame:
    t = topics.groupBy("subject_id").agg(F.count("*").alias("topics"))
    m = materials.join(topics.select("topic_id", "subject_id"), "topic_id")
    counts = m.groupBy("subject_id").agg(F.count_if(F.col("status") == "active").alias("active"), F.count_if(F.col("status") == "pending").alias("pending"))
    i = items.join(m.where("status = 'active'").select("material_id", "subject_id"), "material_id").groupBy("subject_id").agg(F.count("*").alias("items"))
    out = subjects.join(t, "subject_id", "left").join(counts, "subject_id", "left").join(i, "subject_id", "left")
    return out.select("subject_id", "name", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("topics", "active", "pending", "items")])


def subjects_by_exam(subjects: DataFrame, exams: DataFrame, today: Column) -> DataFrame:
    """Subjects in the order of their next exam, those without one last, then by name."""
    coming = exams.where(F.col("date") >= today).groupBy("subject_id").agg(F.min("date").alias("exam"))
    rows = subjects.join(coming, "subject_id", "left")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.col("exam").asc_nulls_last(), F.lower("name"))))  # as many rows as subjects


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(T.collapsed(F.coalesce(text, F.lit(""))), " "), lambda w: w != ""))


def checked_materials(materials: DataFrame) -> DataFrame:
    """materials (type, q, a, text, prompt, items) with status valid or invalid and warnings: an answer over 20 words, a
    question that asks for an essay, more than seven items. A material without what it must have is invalid."""
    blank = lambda c: T.collapsed(F.coalesce(F.col(c), F.lit(""))) == ""
    items = F.filter(F.coalesce(F.col("items"), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    pair = F.col("type").isin("qa", "provision", "distinction", "why")
    problem = (
        F.when(pair & (blank("q") | blank("a")), "question or answer is missing")
        .when((F.col("type") == "cloze") & blank("text"), "text is missing")
        .when((F.col("type") == "cloze") & (F.size(T.cloze_keys(F.coalesce("text", F.lit("")))) == 0), "no gap")
        .when((F.col("type") == "list") & blank("prompt"), "prompt is missing")
        .when((F.col("type") == "list") & (F.size(items) < 2), "fewer than two items")
        .when(~pair & ~F.col("type").isin("cloze", "list"), "unknown type")
    )
    warnings = F.array_compact(
        F.array(
            F.when(pair & (word_count(F.col("a")) > 20), "long answer"),
            F.when(pair & F.coalesce("q", F.lit("")).rlike(r"(?iu)^\s*(omów|scharakteryzuj|przedstaw)(?![A-Za-z0-9_])"), "essay question"),
            F.when((F.col("type") == "list") & (F.size(items) > 7), "many items"),
        )
    )
    return materials.withColumn("problem", problem).withColumn("warnings", warnings).withColumn("check", F.when(problem.isNull(), "valid").otherwise("invalid"))


def retention(status: Column, target: Column, overall: float, maintenance: float = 0.8) -> Column:
    return F.when(status == "maintenance", F.least(F.coalesce(target, F.lit(maintenance)), F.lit(maintenance))).otherwise(F.coalesce(target, F.lit(overall)))


def prompt_budget(window: Column, answer: Column, system: Column) -> Column:
    """Tokens left for the sources: 92 in 100 of the window less answer, instructions and a margin."""
    return F.floor(window * 0.92) - answer - T.estimated_tokens(system) - 32


def untried_by_lecture(documents: DataFrame, chunks: DataFrame, citations: DataFrame, materials: DataFrame, items: DataFrame, today: Column, days: int = 1) -> DataFrame:
    """document, lecture_date and fresh: for each note of a lecture today or in the days before, how many of the active materials
    that cite it, syntheses apart, were never answered; notes without such materials have no row.

    documents: document, kind, lecture_date; chunks: chunk_id, document; citations: owner_type, owner_id, chunk_id; materials:
    material_id, status, synthesis; items: material_id, reps. Each side is made distinct before it is joined, so that a material
    that cites a note often counts once.
    """
    notes = documents.where((F.col("kind") == "note") & F.col("lecture_date").between(F.date_sub(today, days), today)).select("document", "lecture_date")
    cited = citations.where("owner_type = 'material'").select(F.col("owner_id").alias("material_id"), "chunk_id")
    cited = cited.join(chunks.select("chunk_id", "document").join(notes, "document"), "chunk_id").select("material_id", "document", "lecture_date").distinct()
    untried = materials.where("status = 'active' AND NOT synthesis").select("material_id").join(items.where("reps > 0").select("material_id"), "material_id", "left_anti")
    return cited.join(untried, "material_id").groupBy("document", "lecture_date").agg(F.count("*").alias("fresh"))


def merged_settings(stored: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """profile, key, value, own: every setting of every profile, as JSON. stored: profile, key, value_json.

    defaults has the JSON of every key; the keys of nested settings are written with a point (as in `ai.model`), and a stored
    object is laid over the defaults field by field. Values that are no JSON fall back to the default, keys that defaults does
    not know are left out, and of several rows of a key the greatest value counts.
    """
    nested = sorted({k.split(".")[0] for k in defaults if "." in k})
    read = stored.withColumn("v", F.try_parse_json("value_json")).where("v IS NOT NULL")
    plain = read.where(~F.col("key").isin(*nested)).select("profile", "key", F.to_json("v").alias("value"))
    fields = F.from_json(F.to_json("v"), "map<string,variant>")
    inner = read.where(F.col("key").isin(*nested)).select("profile", F.col("key").alias("outer"), F.explode(fields).alias("field", "x"))
    inner = inner.select("profile", F.concat_ws(".", "outer", "field").alias("key"), F.to_json("x").alias("value"))
    known = stored.sparkSession.createDataFrame(sorted(defaults.items()), "key string, usual string")  # as many rows as settings
    own = plain.unionByName(inner).groupBy("profile", "key").agg(F.max("value").alias("value"))
    every = stored.select("profile").distinct().crossJoin(F.broadcast(known))
    out = every.join(own, ["profile", "key"], "left")
    return out.select("profile", "key", F.coalesce("value", "usual").alias("value"), F.col("value").isNotNull().alias("own"))
