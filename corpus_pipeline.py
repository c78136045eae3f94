"""Corpus pipeline: documents in, tokens of the clean and distinct ones out.

Each stage takes (spark, docs, sf_dir) and returns a frame, which is written and
read back as the next one's docs. A stage works on every row its predecessor
kept; all but the last return the columns of documents. Ids may be null or repeat:
the stage that drops near copies writes its docs once with a number for each row and
drops by that number; the others decide by id and text, or by the text alone. Of copies
the row with the smallest id stays, a null id comes after all others, and of near copies
with equal ids the one with the smallest number.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gateflow.llm.bpe import bpe
from gateflow.llm.decontaminate import contamination
from gateflow.llm.exact_dedup import DigestIndex, deduplicate, digest_of
from gateflow.llm.ngram_join import ngram_components
from gateflow.llm.quality import of_quality
from gateflow.llm.tables import numbered, stored, table
from gateflow.sinks.tables import scratch_path

#: Score from which a document is kept.
LEAST_QUALITY = 0.3
#: Bits of a sieve at most: 262,144 words, some 10 MB where it is broadcast. With more
#: marks more rows pass it, and the join behind it decides as before.
SIEVE = 1 << 24
#: The quality model and tokenizer have no SQL form; tests hold the stages against
#: brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble doesn't reject."""
    learned_from = F.crc32(F.col("id").cast("string")) % 5 != 0
    return of_quality(docs, table(spark, sf_dir, "labels"), learned_from, LEAST_QUALITY)


def without(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """Numbered documents less those whose number is in `dropped` (row)."""
    return docs.join(stored(dropped.withColumnRenamed("row", row), "dropped", docs.count()), row, "left_anti").drop(row)


def sieve(marks: DataFrame) -> tuple[DataFrame, int]:
    """(word, bits): places of the marked ids (`of`) among a number of bits, a word a row;
    and that number. It goes with the marks up to SIEVE, so the table stays small."""
    size = min(SIEVE, 1 << (16 * marks.count() + 64).bit_length())
    at = F.pmod(F.xxhash64("of"), F.lit(size))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))
    bit = marks.select(F.shiftright(at, 6).alias("word"), bit.alias("bit"))
    return bit.groupBy("word").agg(F.bit_or("bit").alias("bits")), size


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id.

    Rows are told apart by id and digest, so docs are not written again. Rows that repeat
    both are copies of one document; any one of them stays. Only rows whose id may be
    marked, by a sieve of bits, meet the marks: the others stay where they are read.
    """
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = DigestIndex(spark, scratch_path(spark, "digest-index"), buckets)
    told = deduplicate(docs, index).where("group_size > 1 or not kept")
    told = told.select(F.col("doc_id").alias("of"), F.unhex("text_sha256").alias("told"), "kept")
    marks = told.groupBy("of", "told", "kept").count().where("not kept or count > 1")
    marks = stored(marks.select("of", "told", F.col("kept").alias("stays")), "marks", docs.count())
    words, size = sieve(marks)
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    at = F.pmod(F.xxhash64("id"), F.lit(size))
    sieved = rows.withColumn("at", at).join(F.broadcast(words), F.shiftright("at", 6) == F.col("word"), "left")
    may = F.coalesce(F.getbit("bits", (F.col("at") % 64).cast("int")), F.lit(0)) == 1
    same = F.col("id").eqNullSafe(F.col("of")) & F.col("digest").eqNullSafe(F.col("told"))
    met = sieved.where(may).select("row", "id", digest_of(F.col("row.text")).alias("digest")).join(marks, same, "left")
    kept = sieved.where(~may).select("row.*").union(met.where("stays is null").select("row.*"))
    if marks.where("stays").isEmpty():
        return kept
    one = met.where("stays").groupBy("id", "digest").agg(F.first("row").alias("row"))
    return kept.union(one.select("row.*"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the one with the smallest id."""
    docs, row = numbered(docs)
    found = ngram_components(docs, doc_id=row).select(F.col(row).alias("row"), "component_id")
    found = stored(found, "near-rows", docs.count())
    linked = found.where("component_id <> row")
    members = linked.unionByName(linked.select(F.col("component_id").alias("row"), "component_id").distinct())
    ids = docs.select(F.col(row).alias("row"), F.col("doc_id").alias("id"))
    place = F.struct(F.col("id").isNull().alias("last"), "id", "row")
    first = members.join(ids, "row").groupBy("component_id").agg(F.min(place)["row"].alias("row"))
    return without(docs, members.select("row").join(first.select("row"), "row", "left_anti"), row)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any benchmark window.

    Whether a document goes is told by its text alone, so the digest of the text says
    which go, and docs are not written again with numbers.
    """
    key = "text_digest"
    while key in (c.lower() for c in docs.columns):
        key += "_"
    digest = F.unhex(F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)).alias(key)
    found = contamination(docs.select(digest, "text"), table(spark, sf_dir, "benchmark"), doc_id=key, id_type="binary")
    dropped = stored(found.where("contaminated").select(key).distinct(), "dropped")
    return docs.select("*", digest).join(dropped, key, "left_anti").drop(key)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, with digests of them and of the decoded text."""
    coded = bpe(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return coded.select(
        "doc_id", "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("n-gram Jaccard join", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("BPE encoding and decoding", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), "pipeline")
    return docs
