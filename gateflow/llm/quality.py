"""Quality classifier: a sparse ensemble of rules over text statistics.

A small random forest is grown on labelled rows. Every path from a root to a node
is a rule, a conjunction of bounds on statistics; the same rule from several trees
counts once. A lasso logistic regression over the rules keeps few of them. The
kept rules and weights are compiled into one Spark column, so scoring is an
expression over the statistics.

Null and empty texts have statistics of zero and are scored like any other row.
Labelled rows with a null label are left out; an id labelled several times counts
as often. Without both classes among the labels, the score is the share of good
labels (0.5 without any). Repeated rows give repeated rows, an empty table an empty
result. Only id and text are read, whatever other columns are called.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gateflow.llm.tables import stored
from gateflow.llm.text_stats import STATS, beside, with_stats

TREES, DEPTH, LASSO, SEED = 16, 3, 0.0005, 7

#: Bounds of a rule: (statistic, is an upper bound, value).
Rule = frozenset[tuple[str, bool, float]]


def paths(node, held: dict[tuple[str, bool], float]) -> list[Rule]:
    """Rules of a tree, one per node below its root; of several bounds on one side
    of a statistic the tightest holds."""
    rules = [frozenset((s, upper, v) for (s, upper), v in held.items())] if held else []
    if "LeafNode" not in node.getClass().getName():
        split = node.split()
        stat, value = STATS[split.featureIndex()], float(split.threshold())
        for child, upper in ((node.leftChild(), True), (node.rightChild(), False)):
            known = held.get((stat, upper), value)
            bound = min(known, value) if upper else max(known, value)
            rules += paths(child, {**held, (stat, upper): bound})
    return rules


def holds(rule: Rule) -> Column:
    """Whether a row's statistics satisfy the rule."""
    return reduce(
        lambda a, b: a & b, [F.col(s) <= F.lit(v) if upper else F.col(s) > F.lit(v) for s, upper, v in sorted(rule)]
    )


@dataclass
class RuleEnsemble:
    """Weighted rules; `score` is their compiled column."""

    intercept: float
    weights: dict[Rule, float]

    def score(self) -> Column:
        total = reduce(
            lambda a, b: a + b,
            [F.when(holds(r), F.lit(w)).otherwise(F.lit(0.0)) for r, w in sorted(self.weights.items(), key=lambda x: sorted(x[0]))],
            F.lit(self.intercept),
        )
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def fit(train: DataFrame) -> RuleEnsemble:
    """Ensemble from rows of STATS and `label` (0 or 1)."""
    shares = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(shares) < 2:
        known = next(iter(shares), None)
        return RuleEnsemble(0.0 if known is None else 20.0 if known else -20.0, {})
    vectors = VectorAssembler(inputCols=list(STATS), outputCol="features").transform(train).select("features", "label")
    forest = RandomForestClassifier(
        numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="onethird", subsamplingRate=0.7, minInstancesPerNode=5
    ).fit(vectors)
    rules = sorted({r for tree in forest.trees for r in paths(tree._call_java("rootNode"), {})}, key=sorted)
    names = [f"rule_{i}" for i in range(len(rules))]
    held = train.select("label", *(holds(r).cast("double").alias(n) for r, n in zip(rules, names, strict=True)))
    inputs = VectorAssembler(inputCols=names, outputCol="features").transform(held).select("features", "label")
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60).fit(inputs)
    weights = {r: float(w) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w}
    return RuleEnsemble(float(model.intercept), weights)


def learn(stats: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", label: str = "quality") -> RuleEnsemble:
    """Ensemble from the labels of rows that `usable` (over `id`) marks; others are
    never read into the fit."""
    told = labels.select(F.col(doc_id).cast("long").alias("id"), F.col(label).cast("double").alias("label"))
    return fit(stored(stats.join(told.where(usable & F.col("label").isNotNull()), "id"), "quality-train"))


def quality_scores(
    docs: DataFrame, labels: DataFrame, usable: Column, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """(id, score) per row of `docs`."""
    stats = stored(with_stats(docs, doc_id, text), "quality-stats")
    ensemble = learn(stats, labels, usable, doc_id, label)
    return stats.select(F.col("id").alias(doc_id), ensemble.score().alias("score"))


def of_quality(
    docs: DataFrame, labels: DataFrame, usable: Column, least: float, doc_id: str = "doc_id", text: str = "text", label: str = "quality"
) -> DataFrame:
    """Rows of `docs`, all columns, that score `least` or more; rows stay where they
    are read."""
    ensemble = learn(with_stats(docs, doc_id, text), labels, usable, doc_id, label)
    return beside(docs, text).where(ensemble.score() >= least).select("row.*")
