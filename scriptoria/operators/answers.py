"""What models answered: JSON read under a schema, with an error row for each answer that does not keep to it, and compared."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptoria.functions import text as T
from scriptoria.operators.quotes import validated_fields
from scriptoria.operators.tables import settled

# The form of an answer, its field types, and the length from which a name is none.
FIELD = "struct<type:string,definition_kind:string,text:string,quote:string>"
TOPIC = f"struct<name:string,aliases:array<string>,emphasized:boolean,fields:array<{FIELD}>,relations:array<struct<type:string,target:string>>>"
ANSWER = f"topics array<{TOPIC}>, gaps array<string>, not_read string"
FIELD_TYPES = ("definition", "basis", "premise", "element", "effect", "exception", "deadline", "case_law", "doctrine", "ratio")
LONGEST_NAME = 120


def read_answers(answers: DataFrame, raw: str = "raw") -> DataFrame:
    """answers with out (topics, gaps) and error; raw is read once, by Spark's JSON reader in permissive mode.

    An answer is valid if all of it is JSON of the form of ANSWER with a list of topics; a fence of three backquotes around it
    does not matter, and keys that the form does not have are passed over. Others have null for out and an error: `empty`,
    `no JSON of this form` (broken off, or a value of another type) or `no topics`. Every row of answers has one row.
    """
    text = F.trim(F.regexp_replace(F.coalesce(F.col(raw), F.lit("")), r"^\s*```[a-z]*\s*|\s*```\s*$", ""))
    read = F.from_json(text, ANSWER, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "not_read"})
    error = F.when(text == "", "empty").when(F.col("read").isNull() | F.col("read.not_read").isNotNull(), "no JSON of this form").when(F.col("read.topics").isNull(), "no topics")
    rows = answers.withColumn("read", read).withColumn("error", error)
    return rows.withColumn("out", F.when(F.col("error").isNull(), F.struct("read.topics", "read.gaps"))).drop("read")


def answer_topics(read: DataFrame, key: str) -> DataFrame:
    """key, topic (its place in the answer), name, aliases, emphasized, fields, relations of topics with a usable name; aliases
    are trimmed, and neither empty nor the name again."""
    rows = read.select(key, F.posexplode("out.topics").alias("topic", "t")).where("t IS NOT NULL").withColumn("name", T.collapsed(F.coalesce("t.name", F.lit(""))))
    none = F.array().cast("array<string>")
    aliases = F.filter(F.transform(F.coalesce("t.aliases", none), lambda a: F.trim(F.coalesce(a, F.lit("")))), lambda a: (a != "") & (a != F.col("name")))
    return rows.where(F.length("name").between(1, LONGEST_NAME)).select(key, "topic", "name", aliases.alias("aliases"), F.coalesce("t.emphasized", F.lit(False)).alias("emphasized"), "t.fields", "t.relations")


def answer_fields(topics: DataFrame, key: str) -> DataFrame:
    """key, topic, field (its place), type, definition_kind (none unless it is a definition), text, quote: fields of a known type
    with a text."""
    rows = topics.select(key, "topic", F.posexplode("fields").alias("field", "f")).where(F.col("f.type").isin(*FIELD_TYPES) & (F.trim(F.coalesce("f.text", F.lit(""))) != ""))
    kind = F.when(F.col("f.type") == "definition", F.col("f.definition_kind")).otherwise(F.lit("none"))
    return rows.select(key, "topic", "field", "f.type", kind.alias("definition_kind"), F.trim("f.text").alias("text"), "f.quote")


def answer_relations(topics: DataFrame, key: str) -> DataFrame:
    """key, topic, type, target: relations with a target."""
    rows = topics.select(key, "topic", F.explode("relations").alias("r")).where(F.trim(F.coalesce("r.target", F.lit(""))) != "")
    return rows.select(key, "topic", "r.type", F.trim("r.target").alias("target"))


def model_comparison(answers: DataFrame, chunks: DataFrame, first: int | None = None) -> DataFrame:
    """For each model of answers (answer_id, model, chunk_id, raw, seconds): chunks, seconds, valid_json, topics, fields, rejected,
    verified_share and error, that of its last chunk with one.

    Fields are checked against their chunk alone (see quotes.validated_fields); a topic counts if one of its fields is
    accepted. first takes the answers for the first so many chunks of each document and model, in their order. A model whose
    answers are all bad has zeros and an error.
    """
    if first is not None:
        place = F.row_number().over(Window.partitionBy("model", "document").orderBy("ord", "answer_id"))
        answers = answers.join(chunks.select("chunk_id", "document", "ord"), "chunk_id").withColumn("place", place).where(F.col("place") <= first).drop("document", "ord", "place")
    read = settled(read_answers(answers))
    topics = answer_topics(read, "answer_id")
    fields = settled(answer_fields(topics, "answer_id").join(read.select("answer_id", "model", "chunk_id"), "answer_id").withColumn("field_id", F.concat_ws("-", "answer_id", "topic", "field")))
    alone = chunks.select("chunk_id", F.col("chunk_id").alias("document"), F.lit(0).alias("ord"), "text")
    checked = validated_fields(fields.select("field_id", "chunk_id", "text", "quote"), alone, neighbours=False).select("field_id", "accepted")
    kept = fields.join(checked, "field_id").groupBy("model").agg(
        F.count_distinct(F.when(F.col("accepted"), F.struct("answer_id", "topic"))).alias("topics"), F.count_if("accepted").alias("fields"), F.count_if(~F.col("accepted")).alias("rejected")
    )
    error = F.max(F.when(F.col("error").isNotNull(), F.struct("answer_id", "error"))).alias("last")
    sums = read.groupBy("model").agg(F.count("*").alias("chunks"), F.sum("seconds").alias("seconds"), F.count_if(F.col("error").isNull()).alias("valid_json"), error)
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.coalesce(F.try_divide("fields", F.col("fields") + F.col("rejected")), F.lit(0.0)).alias("verified_share")
    return sums.join(kept, "model", "left").select("model", "chunks", "seconds", "valid_json", none("topics"), none("fields"), none("rejected"), share, F.col("last.error").alias("error"))
