"""Statistics of whole texts, as one row of numbers per document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import in_small_batches
from gateflow.llm.words import SPACED, buffers, slices, word_digests

UPPER, LOWER, DIGIT, SPACE, LINE, SIGN, WIDE, REST = range(8)


def _classes() -> np.ndarray:
    """Class of each byte; a character beyond ASCII counts by its first byte."""
    out = np.full(256, SIGN, np.uint8)
    out[0x41:0x5B], out[0x61:0x7B], out[0x30:0x3A] = UPPER, LOWER, DIGIT
    out[[0x20, 0x09, 0x0B, 0x0C, 0x0D]], out[0x0A] = SPACE, LINE
    out[0x80:0xC0], out[0xC0:] = REST, WIDE
    return out


CLASSES = _classes()
STATS = (
    "chars", "words", "word_length", "letters", "upper", "digits", "signs", "lines", "wide",
    "distinct", "repeated", "top_word",
)


def _by_class(offsets: np.ndarray, body: np.ndarray) -> np.ndarray:
    """Bytes of each class (columns) in each text; two bytes of room per byte of text."""
    out = np.zeros((len(offsets) - 1, 8))
    full = offsets[1:] > offsets[:-1]
    if full.any():
        classes, starts = CLASSES[body], offsets[:-1][full]
        for c in range(8):
            out[full, c] = np.add.reduceat(classes == c, starts, dtype=np.int64)
    return out


def text_stats(texts: pa.Array) -> np.ndarray:
    """Rows of STATS; an empty text has zeros."""
    out = []
    for i, j in slices(texts):
        part = texts.slice(i, j - i)
        offsets, body = buffers(part)
        rows = len(part)
        by = _by_class(offsets, body)
        chars = by.sum(axis=1) - by[:, REST]
        letters = by[:, UPPER] + by[:, LOWER] + by[:, WIDE]
        words = word_digests(part, SPACED)
        n = words.counts.astype(float)
        distinct, repeated, top = np.zeros(rows), np.zeros(rows), np.zeros(rows)
        at = 0
        for k, m in enumerate(words.counts.tolist()):
            own = words.digests[at : at + m]
            at += m
            if m:
                counts = np.unique(own, return_counts=True)[1]
                distinct[k], top[k] = len(counts), counts.max()
                repeated[k] = (own[1:] == own[:-1]).sum()
        share = lambda a, b: np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
        out.append(
            np.stack(
                [
                    np.log1p(chars), np.log1p(n), share(chars - by[:, SPACE] - by[:, LINE], n), share(letters, chars),
                    share(by[:, UPPER], letters), share(by[:, DIGIT], chars), share(by[:, SIGN], chars),
                    share(by[:, LINE], n), share(by[:, WIDE], letters), share(distinct, n), share(repeated, n), share(top, n),
                ],
                axis=1,
            )
        )
    return np.concatenate(out) if out else np.zeros((0, len(STATS)))


def with_stats(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, one column per statistic); null counts as empty."""
    in_small_batches(docs.sparkSession)
    schema = pa.schema([("id", pa.int64()), *((s, pa.float64()) for s in STATS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = text_stats(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], schema=schema)

    rows = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{s} double" for s in STATS))


def beside(docs: DataFrame, text: str) -> DataFrame:
    """Each row whole, as the struct `row`, with its statistics: (row, statistics).

    Python gets the texts alone and gives back the statistics; rows wait in the JVM,
    where they are read, and no column of `docs` can clash with a statistic.
    """
    in_small_batches(docs.sparkSession)

    @F.arrow_udf("struct<" + ", ".join(f"{s}: double" for s in STATS) + ">")
    def stats(texts: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays([pa.array(c) for c in text_stats(texts).T], names=list(STATS))

    # not to be worked out again for each statistic a condition reads
    once = stats.asNondeterministic()
    return docs.select(F.struct("*").alias("row"), once(F.col(text)).alias("stats")).select("row", "stats.*")
