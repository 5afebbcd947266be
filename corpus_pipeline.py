"""A corpus pipeline over `documents`: each stage takes (spark, docs, sf_dir) and gives the next one's docs."""

from __future__ import annotations

import json

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm import bpe, langid, mixing, secrets, simhash
from scriptoria.llm.common import cut, drop_cut, fold_of, fresh, scratch, table

#: Texts whose language is less certain than this go, and so do texts without letters.
LEAST_CERTAIN = 0.5
#: The mixture, as metadata of the column source: Parquet tables and Spark's operators on rows keep it.
MIXTURE = "mixture"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language that the text shows. Learned from the documents outside fold 2 of 4.

    Null texts and texts without letters go, also where there is nothing to learn from; texts of any length are read whole;
    repeated rows are treated alike and all stay or go; no documents give none; a column of docs named like one of the
    operator's (lang_pred, score) stays as it is.
    """
    model = langid.train(docs.where(F.coalesce(fold_of("doc_id", 4) != 2, F.lit(True))))
    names = fresh(docs, "lang_of_text", "lang_score")
    plain = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    found = langid.identify(plain, model, text_col=f"c{docs.columns.index('text')}").toDF(*docs.columns, *names)
    return found.where((F.col(names[0]) != "und") & (F.col(names[1]) >= LEAST_CERTAIN)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each group of near-duplicates.

    Null, empty and wordless texts are near-duplicates of each other. Documents without a doc_id go where their group has
    one with a doc_id, and stay otherwise. Of repeated rows one stays, of different texts under one doc_id the one that is in
    the group which that doc_id names. Texts of any length are read whole, and no documents give none.
    """
    return simhash.keep_first(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put a mark for each secret in the texts, and count their characters again where that changed them.

    Null and empty texts stay as they are; texts of any length are read whole; repeated rows are treated alike; no
    documents give none; columns of docs with the names of helper columns stay as they are.
    """
    (before,) = fresh(docs, "text_before")
    clean = secrets.redact(docs.withColumn(before, F.col("text")))
    changed = ~F.col("text").eqNullSafe(F.col(before))
    n_chars = F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return clean.withColumn("n_chars", n_chars).select(*docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: dict[str, float] | None = None) -> DataFrame:
    """Weigh the sources and put the documents in the order of that mixture: files and rows in files follow each other by
    mix_position. The sources' units are noted in the metadata of the column source, where the last stage takes them from.

    Without weights, a source weighs the root of its number of documents. No document goes or is repeated. Null sources are one
    source, null doc_ids are placed like others, repeated rows stand next to each other, no documents give none. A column of
    docs named like one of the operator's stays as it is.
    """
    plain = docs.select([F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)])
    source = f"c{docs.columns.index('source')}"
    units = mixing.source_units(plain, source, weights)
    mixed = mixing.mix_sources(plain, source, f"c{docs.columns.index('doc_id')}", units=units)
    mixed = mixed.repartitionByRange("mix_position").sortWithinPartitions("mix_position")
    noted = {**docs.schema["source"].metadata, MIXTURE: json.dumps(list(units.items()))}
    return mixed.select(*plain.columns).toDF(*docs.columns).withMetadata("source", noted)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text (unsigned 32-bit little-endian, packed) and digests of the ids and of what they decode to, with
    the row's place in the mixture that docs come with. Readers do not keep the order of rows, so rows are placed by doc_id and
    source under the mixture's units; documents that no mixture was made for have null places.

    Null texts are empty ones and have no ids; texts of any length are encoded whole; every row gives one, repeated rows
    too; no documents give none; further columns of docs are left out.
    """
    noted, mixed = docs.schema["source"].metadata.get(MIXTURE), docs.select("doc_id", "source", "text")
    if noted is None:
        mixed = mixed.select("*", *[F.lit(None).cast("long").alias(c) for c in ("mix_slot", "mix_position")])
    else:
        mixed = mixing.mix_sources(mixed, units=dict(json.loads(noted)))
    ids = bpe.encode_texts(mixed, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id", "source", "mix_slot", "mix_position"], decode=True)
    return ids.select("doc_id", "source", "mix_slot", "mix_position", "n_tokens", "token_ids", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_to_weights),
    ("byte_bpe", encode_bytes),
]

#: SQL has no tokenizer and no language model, so run() is tested against a version by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. A stage's tables are deleted as soon as the next one has read them."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        with scratch(spark):
            done = cut(stage(spark, docs, sf_dir), name, keep=True)
        if i:
            drop_cut(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
