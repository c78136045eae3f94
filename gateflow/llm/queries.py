"""One query per operator, over its whole table and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.llm.bpe import bpe
from gateflow.llm.decontaminate import contamination, items_digest
from gateflow.llm.exact_dedup import DigestIndex, deduplicate
from gateflow.llm.language_id import identify, learn
from gateflow.llm.license_scan import scan_licences
from gateflow.llm.merkle import manifest
from gateflow.llm.multi_index import hard_negatives
from gateflow.llm.ngram_join import ngram_components
from gateflow.llm.pii import KINDS, personal_data, written
from gateflow.llm.quality import quality_scores
from gateflow.llm.tables import table
from gateflow.llm.token_files import read_tokens, token_index, write_tokens
from gateflow.llm.toxicity import toxicity
from gateflow.llm.warc import payload_index, read_warc, write_warc
from gateflow.sinks.tables import scratch_path


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(written(KINDS), 256).alias("base_sha256"),
        written((*KINDS, "context")).alias("spans"),
        F.size("context").cast("long").alias("n_context"),
        sum((F.size(k) for k in (*KINDS, "context")), F.lit(0)).cast("long").alias("n_spans"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 5 == 0, F.lit(False))
    scores = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out("id"))
    return scores.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    toxic, good = F.col("toxic"), F.col("quality")
    categories = {"toxic": toxic, "toxic_junk": toxic * (1 - good)}
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), categories)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = DigestIndex(spark, scratch_path(spark, "digest-index"), buckets)
    return deduplicate(table(spark, sf_dir, "documents"), index)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    return payload_index(read_warc(spark, path))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digests=True)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    samples = learn(docs, ~held_out)
    found = identify(docs, samples)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "bits")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", "n_items", items_digest("item_ids").alias("items_sha256"), "contaminated"
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


def op11_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return token_index(read_tokens(spark, path, with_ids=False))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return manifest(
        table(spark, sf_dir, "documents"),
        ["doc_id", "source", "lang", "n_chars", "text"],
        F.crc32(F.col("doc_id").cast("string")) % 5 == 0,
        {"text": F.translate("text", upper, upper.lower())},
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_pii, op2_quality, op3_toxicity, op4_exact_dedup, op5_warc, op6_bpe, op7_language_id, op8_decontaminate,
        op9_license_scan, op10_ngram_join, op11_token_output, op12_merkle, op13_hard_negatives,
    )
}
