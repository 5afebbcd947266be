"""The queries op1 to op13 over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptoria.llm.common import bounded_sample, fold_of, scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def labelled_documents(spark: SparkSession, sf_dir: str, label: str, folds: int, held: int, most: int) -> DataFrame:
    """Texts of labelled documents outside the held-out fold: at most about `most` rows, chosen before texts are read."""
    labels = table(spark, sf_dir, "labels").where(F.col(label).isNotNull() & (fold_of("doc_id", folds) != held)).select("doc_id", label)
    chosen = bounded_sample(labels, "doc_id", most)
    return table(spark, sf_dir, "documents").select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # `most` short rows


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptoria.llm.toxicity import TRAIN_ROWS, fit, score_toxicity

    model = fit(labelled_documents(spark, sf_dir, "toxic", 5, 0, TRAIN_ROWS))
    scored = score_toxicity(table(spark, sf_dir, "documents").select("doc_id", "text"), model, keep=["doc_id"])
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", "predicted")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptoria.llm.secrets import BASE_KINDS, base_only, find_secrets, of_kind, spans_text

    found = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    counts = [F.size(of_kind(spans, kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(spans_text(base_only(spans)), 256).alias("base_sha256"), spans_text(spans).alias("spans"))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptoria.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptoria.llm.simhash import near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("simhash")), 16, "0").alias("fingerprint"), "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptoria.llm.common import shared_dir
    from scriptoria.llm.warc import read_warc, write_warc

    path = f"{shared_dir(spark)}/warc"
    write_warc(table(spark, sf_dir, "pages"), path)
    return read_warc(spark, path, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from scriptoria.llm.bpe import encode_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = encode_texts(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=["doc_id"], decode=True)
    return ids.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptoria.llm.rules import TRAIN_ROWS, fit, score_quality

    model = fit(labelled_documents(spark, sf_dir, "quality", 3, 1, TRAIN_ROWS), "text", "quality", "doc_id")
    scored = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return scored.select("doc_id", F.coalesce(fold_of("doc_id", 3) == 1, F.lit(False)).alias("held_out"), "score", "predicted")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptoria.llm.cws import edited_fingerprints

    return edited_fingerprints(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptoria.llm.mixing import mix_sources

    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_sources(docs)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptoria.llm.langid import identify, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(fold_of("doc_id", 4) != 2))
    found = identify(docs, model, keep=["doc_id"])
    return found.select("doc_id", F.coalesce(fold_of("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptoria.llm.pii import BASE_KINDS, base_only, find_pii
    from scriptoria.llm.secrets import of_kind, spans_text

    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("pii_spans")
    counts = [F.size(of_kind(spans, kind)).cast("long").alias(f"n_{kind}") for kind in BASE_KINDS]
    scores = F.array_join(F.transform(spans, lambda s: F.round(s.score * 100).cast("int").cast("string")), ",")
    return found.select("doc_id", *counts, F.sha2(spans_text(base_only(spans)), 256).alias("base_sha256"), spans_text(spans).alias("spans"), scores.alias("scores"))


def op12_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptoria.llm.ranked import index_documents, search

    with scratch(spark):
        index = index_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
        found = search(index, table(spark, sf_dir, "benchmark").select("item_id", "text"), k=20)
    return found.select("item_id", "rank", F.col("key").alias("doc_id"), "score")


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from scriptoria.llm.merkle import fold, merkle_proofs, proof_digest, row_digest

    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    fields = [F.col(c) for c in docs.columns]
    tampered = [*fields[:-1], F.replace("text", F.lit("\n"), F.lit(""))]
    docs = docs.select("doc_id", "source", row_digest(fields).alias("own"), F.when(fold_of("doc_id", 2) == 0, row_digest(tampered)).alias("other"))
    docs = docs.withColumn("other", F.coalesce("other", "own"))
    proofs = merkle_proofs(docs, "own", "source", "doc_id", keep=["doc_id", "other"])
    out = proofs.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), fold(F.col("other"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def queries() -> dict[str, Query]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    from scriptoria.llm import oracles

    return oracles.oracle_sql()
