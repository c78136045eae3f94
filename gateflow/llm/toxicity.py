"""Toxicity: a chain of linear models, one per category.

Features are the distinct lower-cased words of a text, hashed to HASHED columns.
The first category's model sees them alone; each later one sees the probabilities
of the earlier categories too. For training, those probabilities come from models
that were fitted without the row (FOLDS folds by a digest of the id), so a later
model learns how far they can be trusted on new text. For scoring, models fitted
on all sampled rows are chained. Models are lasso logistic regressions over the
words that differ most between the classes.

The fit takes at most TRAIN_ROWS labelled ids, those first by a digest of the id, and of
these as many as have TRAIN_WORDS different words in all (counted per text). An id that
has several documents gives the one whose words have the smallest digest; of several
labels the smallest counts. Rows with a null id, or a null label in any category, are
left out of the fit; a category with one
class only gets that class's share as probability, 0 without rows. Null and empty
texts have no words and get each model's base rate. Repeated rows give repeated
rows, an empty table an empty result; of `docs` only id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gateflow.llm.tables import prepared, stored
from gateflow.llm.words import ALNUM, mix, slices, word_digests

HASHED, FOLDS, TRAIN_ROWS, THRESHOLD = 1 << 18, 3, 20_000, 0.5
TRAIN_WORDS = 16 << 20
#: Words kept for a model: seen in so many rows, so many standard errors from
#: independence, and so many of them; weight of the penalty; steps.
ROWS, ERRORS, KEPT, LASSO, STEPS = 4, 3.0, 4_000, 0.00005, 600


def hashed_words(texts: pa.Array) -> Iterator[np.ndarray]:
    """Sorted distinct hashed words of each text."""
    for i, j in slices(texts):
        words = word_digests(texts.slice(i, j - i), ALNUM)
        own = (words.digests & np.uint64(HASHED - 1)).astype(np.int64)
        for part in np.split(own, np.cumsum(words.counts)[:-1]):
            yield np.unique(part)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Linear:
    """Intercept, weights by hashed word, and weights of earlier probabilities."""

    intercept: float
    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    earlier: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def predict(self, rows: np.ndarray, columns: np.ndarray, n: int, earlier: np.ndarray) -> np.ndarray:
        """Probabilities of n rows whose words are the pairs (rows, columns)."""
        z = np.full(n, self.intercept)
        if len(self.words):
            at = np.minimum(np.searchsorted(self.words, columns), len(self.words) - 1)
            here = self.words[at] == columns
            z += np.bincount(rows[here], weights=self.weights[at[here]], minlength=n)
        if len(self.earlier):
            z += earlier @ self.earlier
        return _sigmoid(z)


def fit(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, earlier: np.ndarray) -> Linear:
    """Lasso logistic regression by accelerated proximal steps."""
    n, positive = len(labels), labels.sum()
    if positive in (0, n):
        return Linear(40.0 if n and positive else -40.0)
    seen = np.bincount(columns, minlength=HASHED)
    with_label = np.bincount(columns, weights=labels[rows], minlength=HASHED)
    p = seen / n
    errors = np.abs(with_label - positive * p) / np.sqrt(np.maximum(positive * p * (1 - p), 1e-9))
    usable = np.flatnonzero((seen >= ROWS) & (errors >= ERRORS))
    words = np.sort(usable[np.argsort(-errors[usable], kind="stable")[:KEPT]])
    place = np.full(HASHED, -1)
    place[words] = np.arange(len(words))
    here = place[columns] >= 0
    r, c, m = rows[here], place[columns[here]], len(words)

    def forward(w):
        return w[0] + earlier @ w[1 : 1 + k] + np.bincount(r, weights=w[1 + k :][c], minlength=n)

    def backward(g):
        return np.concatenate([[g.sum()], earlier.T @ g, np.bincount(c, weights=g[r], minlength=m)])

    k = earlier.shape[1]
    v = np.ones(1 + k + m)
    for _ in range(30):  # largest curvature
        v = backward(forward(v))
        size = np.linalg.norm(v)
        v /= size
    step = 4 * n / (1.02 * size)
    w = ahead = np.zeros(1 + k + m)
    t = 1.0
    for _ in range(STEPS):
        moved = ahead - step * backward(_sigmoid(forward(ahead)) - labels) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * LASSO, 0)
        new[: 1 + k] = moved[: 1 + k]  # the words alone are penalised
        t, old = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead, w = new + (old - 1) / t * (new - w), new
    kept = np.flatnonzero(w[1 + k :])
    return Linear(float(w[0]), words[kept], w[1 + k :][kept], w[1 : 1 + k])


def fit_chain(rows: np.ndarray, columns: np.ndarray, labels: np.ndarray, fold: np.ndarray) -> list[Linear]:
    """One model per column of `labels`, in order."""
    n = len(labels)
    earlier, chain = np.zeros((n, 0)), []
    for k in range(labels.shape[1]):
        chain.append(fit(rows, columns, labels[:, k], earlier))
        if k + 1 == labels.shape[1]:
            break
        out = np.zeros(n)
        for f in range(FOLDS):
            use = fold != f
            renumber = np.cumsum(use) - 1
            inside = use[rows]
            model = fit(renumber[rows[inside]], columns[inside], labels[use, k], earlier[use])
            out[~use] = model.predict(rows, columns, n, earlier)[~use]
        earlier = np.column_stack([earlier, out])
    return chain


def _lower(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))


def learn(docs: DataFrame, labels: DataFrame, categories: dict[str, Column], doc_id: str, text: str) -> list[Linear]:
    """Chain from the sampled rows; their hashed words, not their texts, reach the
    driver: of at most TRAIN_ROWS rows, and TRAIN_WORDS in all."""
    prepared(docs.sparkSession)
    names = list(categories)
    told = labels.select(F.col(doc_id).cast("long").alias("id"), F.struct(*(c.cast("double").alias(k) for k, c in categories.items())).alias("y"))
    whole = [F.col("y")[k].isNotNull() for k in names]
    told = told.where(F.col("id").isNotNull() & reduce(lambda a, b: a & b, whole))
    # one label per id, one row per label: what repeats takes the smallest
    told = told.groupBy("id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("id"), "id").limit(TRAIN_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = pa.array([w.astype(np.int32).tobytes() for w in hashed_words(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["id", "words"])

    told = stored(told, "toxicity-labels")
    chosen = _lower(docs, doc_id, text).join(F.broadcast(told.select("id")), "id")  # TRAIN_ROWS ids
    found = chosen.mapInArrow(run, "id long, words binary").groupBy("id").agg(F.min(F.struct(F.xxhash64("words").alias("key"), "words"))["words"].alias("words"))
    rows = stored(found.join(told, "id").select("id", "words", *(F.col("y")[k].alias(k) for k in names)), "toxicity-train")
    # sizes of TRAIN_ROWS rows at most are summed in one task
    so_far = F.sum(F.length("words")).over(Window.orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, 0))
    within = rows.select("id", so_far.alias("bytes")).where(F.col("bytes") <= 4 * TRAIN_WORDS).select("id")
    sample = rows.join(within, "id").toArrow().sort_by("id")
    words = [np.frombuffer(w.as_buffer(), np.int32) for w in sample["words"]]
    rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
    columns = np.concatenate([*words, np.zeros(0, np.int32)]).astype(np.int64)
    y = np.column_stack([sample[k].to_numpy() for k in names])
    fold = mix(sample["id"].to_numpy().astype(np.uint64)) % np.uint64(FOLDS)
    return fit_chain(rows, columns, y, fold)


def toxicity(
    docs: DataFrame,
    labels: DataFrame,
    categories: dict[str, Column],
    doc_id: str = "doc_id",
    text: str = "text",
    threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per row of `docs`: id, p_<category> each, flagged (the first category
    reaches the threshold). `categories` gives each category's label as a column
    over `labels`, in the order of the chain."""
    given = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, categories, doc_id, text))
    names = ["id", *(f"p_{k}" for k in categories)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = list(hashed_words(batch.column(1)))
            rows = np.repeat(np.arange(len(words)), [len(w) for w in words])
            columns = np.concatenate([*words, np.zeros(0, np.int64)])
            earlier = np.zeros((len(words), 0))
            for model in given.value:
                p = model.predict(rows, columns, len(words), earlier)
                earlier = np.column_stack([earlier, p])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(p) for p in earlier.T)], names=names)

    scored = _lower(docs, doc_id, text).mapInArrow(run, "id long, " + ", ".join(f"{x} double" for x in names[1:]))
    return scored.select(
        F.col("id").alias(doc_id), *names[1:], (F.col(names[1]) >= threshold).alias("flagged")
    )
