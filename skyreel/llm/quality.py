"""Quality classifier: a sparse rule ensemble over text statistics.

Statistics are column expressions. A random forest is grown on the labelled rows, every path from its roots becomes a
conjunctive rule, a logistic model with a lasso penalty weighs the rules, and those that keep a weight are compiled into
one column expression.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, prepared

TREES, DEPTH, SEED = 16, 3, 11
LASSO = 2e-3
ROUNDS = 40
MOST_RULES = 256


def statistics() -> dict[str, Column]:
    """Numbers of a text column named ``text``; all are 0 for a null or empty text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.col("__words")
    size = F.greatest(F.size(words), F.lit(1))
    length = F.greatest(F.char_length(text), F.lit(1))
    double = lambda c: c.cast("double")
    count = lambda pattern: double(F.regexp_count(text, F.lit(pattern)))
    return {
        "characters": double(F.char_length(text)),
        "words": double(F.size(words)),
        "word_length": double(F.char_length(text)) / size,
        "distinct_words": double(F.size(F.array_distinct(words))) / size,
        "capitals": count(r"\p{Lu}") / length,
        "marks": count(r"[^\p{L}\p{N}\s]") / length,
        "digits": count(r"\d") / length,
        "doubled_words": count(r"(?:^|\s)(\S+)(?=\s\1(?:\s|$))") / size,
        "lines": count(r"\n") / size,
    }


NAMES = ("characters", "words", "word_length", "distinct_words", "capitals", "marks", "digits", "doubled_words", "lines")


def measured(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of every row's whole text."""
    prepared(documents.sparkSession)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    rows = rows.select("doc_id", "text", F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda w: w != "").alias("__words"))
    return rows.select("doc_id", *(c.alias(n) for n, c in statistics().items()))


@dataclass(frozen=True)
class Rule:
    """All of these must hold: (statistic, whether it must be above, bound)."""

    parts: frozenset[tuple[str, bool, float]]

    def column(self) -> Column:
        held = F.lit(True)
        for name, above, bound in sorted(self.parts):
            held = held & (F.col(name) > bound if above else F.col(name) <= bound)
        return held.cast("double")


CONDITION = re.compile(r"^(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def rules_of(tree: str) -> set[Rule]:
    """The paths of one tree, from its printed form; opposite bounds on one statistic are kept as tight as they get."""
    path: list[tuple[int, tuple[str, bool, float]]] = []
    out = set()
    for line in tree.splitlines():
        if found := CONDITION.match(line):
            depth = len(found[1])
            path = [p for p in path if p[0] < depth]
            path.append((depth, (NAMES[int(found[2])], found[3] == ">", float(found[4]))))
            tight: dict[tuple[str, bool], float] = {}
            for _, (name, above, bound) in path:
                old = tight.get((name, above))
                tight[name, above] = bound if old is None else (max if above else min)(old, bound)
            out.add(Rule(frozenset((n, a, b) for (n, a), b in tight.items())))
    return out


@dataclass(frozen=True)
class Ensemble:
    bias: float
    weighed: tuple[tuple[Rule, float], ...]

    def score(self) -> Column:
        """The probability of label 1, over the statistics' columns."""
        total = F.lit(self.bias)
        for rule, weight in self.weighed:
            total = total + rule.column() * F.lit(weight)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def train(rows: DataFrame) -> Ensemble:
    """Fit to all of ``rows`` (the statistics and ``y``: 0 or 1). With one kind of label the score is the share of label 1,
    with none it is 0.5."""
    rows = checkpointed(rows.where("y in (0, 1)").select(array_to_vector(F.array(*NAMES)).alias("features"), F.col("y").cast("double").alias("y"), *NAMES))
    total, ones = rows.agg(F.count("y"), F.coalesce(F.sum("y"), F.lit(0.0))).first()
    if total == 0:
        return Ensemble(0.0, ())
    if ones in (0, total):
        return Ensemble(30.0 if ones else -30.0, ())
    forest = RandomForestClassifier(labelCol="y", numTrees=TREES, maxDepth=DEPTH, subsamplingRate=0.7, featureSubsetStrategy="onethird", seed=SEED, maxBins=64).fit(rows)
    rules = sorted({r for t in forest.trees for r in rules_of(t.toDebugString)}, key=lambda r: (len(r.parts), sorted(r.parts)))[:MOST_RULES]
    if not rules:
        return Ensemble(math.log(ones / (total - ones)), ())
    held = rows.select("y", array_to_vector(F.array(*(r.column() for r in rules))).alias("features"))
    fitted = LogisticRegression(labelCol="y", elasticNetParam=1.0, regParam=LASSO, maxIter=ROUNDS, standardization=False).fit(held)
    weights = fitted.coefficients.toArray()
    return Ensemble(float(fitted.intercept), tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def scored(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score of every document, learned from ``labels`` (doc_id, y). Rows that repeat a doc_id are all scored and,
    where labelled, all learned from; of conflicting labels the larger counts."""
    stats = checkpointed(measured(documents))
    known = labels.where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.max("y").alias("y"))
    model = train(stats.join(known, "doc_id"))
    return stats.select("doc_id", model.score().alias("score"), F.lit(len(model.weighed)).alias("n_rules"))
