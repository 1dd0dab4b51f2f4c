"""Quality classifier: a sparse rule ensemble over text statistics, compiled into Spark column expressions."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callquality.llm.common import fresh, written
from callquality.llm.stats import text_statistics

STATISTICS = ("n_words", "word_chars", "n_chars", "n_symbols", "n_bangs", "n_upper", "n_digits", "n_lines", "n_dup_lines", "n_distinct_words")
#: Features as (name, numerator, denominator); the first is a size, the others ratios.
FEATURES = (
    ("words", "n_words", None),
    ("word_length", "word_chars", "n_words"),
    ("symbols", "n_symbols", "n_words"),
    ("bangs", "n_bangs", "n_words"),
    ("upper", "n_upper", "word_chars"),
    ("digits", "n_digits", "word_chars"),
    ("duplicate_lines", "n_dup_lines", "n_lines"),
    ("distinct_words", "n_distinct_words", "n_words"),
    ("line_length", "n_words", "n_lines"),
)


def features(stats: Column) -> dict[str, Column]:
    return {name: stats[top].cast("double") / (F.greatest(stats[bottom], F.lit(1)) if bottom else F.lit(1)) for name, top, bottom in FEATURES}


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float


@dataclass(frozen=True)
class RuleEnsemble:
    """score = logistic(intercept + the weights of the rules that hold); a rule is a conjunction of conditions."""

    intercept: float
    rules: tuple[tuple[tuple[Condition, ...], float], ...] = field(default=())

    def score(self, values: dict[str, Column]) -> Column:
        total = F.lit(self.intercept)
        for conditions, weight in self.rules:
            holds = F.lit(True)
            for c in conditions:
                holds = holds & (values[c.feature] > c.threshold if c.above else values[c.feature] <= c.threshold)
            total = total + F.when(holds, F.lit(weight)).otherwise(0.0)
        return 1.0 / (1.0 + F.exp(-total))


_SPLIT = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)$")


def tree_paths(described: str) -> set[tuple[Condition, ...]]:
    """Every path from the root of a described tree to a node below it, as a conjunction of conditions."""
    paths, held = set(), []
    for line in described.splitlines():
        if m := _SPLIT.match(line):
            depth = len(m[1])
            held = [h for h in held if h[0] < depth]
            held.append((depth, Condition(FEATURES[int(m[3])][0], m[4] == ">", float(m[5]))))
            paths.add(tuple(sorted({c for _, c in held}, key=lambda c: (c.feature, c.above, c.threshold))))
    return paths


def fit_rules(examples: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.002, seed: int = 7) -> RuleEnsemble:
    """Fits the ensemble to a table (features, label 0/1): tree paths become rules, lasso keeps few of them.

    Without examples the score is one half, with a single label that label's share, smoothed by one of each.
    """
    counts = {r["label"]: r["n"] for r in examples.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if len(counts) < 2:
        ones, n = counts.get(1, 0), sum(counts.values())
        return RuleEnsemble(math.log((ones + 1) / (n - ones + 1)))
    names = [name for name, _, _ in FEATURES]
    vectors = VectorAssembler(inputCols=names, outputCol="x").transform(examples).select("x", F.col("label").cast("double").alias("label"), *names)
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird").fit(vectors)
    rules = sorted({p for tree in forest.trees for p in tree_paths(tree.toDebugString)}, key=str)
    if not rules:
        return RuleEnsemble(math.log((counts[1] + 1) / (counts[0] + 1)))
    holds = []
    for k, conditions in enumerate(rules):
        test = F.lit(True)
        for c in conditions:
            test = test & (F.col(c.feature) > c.threshold if c.above else F.col(c.feature) <= c.threshold)
        holds.append(test.cast("double").alias(f"r{k}"))
    matrix = VectorAssembler(inputCols=[f"r{k}" for k in range(len(rules))], outputCol="rules").transform(vectors.select("label", *holds)).select("label", "rules")
    matrix = written(matrix, "rule-matrix")
    lasso = LogisticRegression(featuresCol="rules", labelCol="label", elasticNetParam=1.0, regParam=penalty, maxIter=60).fit(matrix)
    kept = tuple((rule, float(w)) for rule, w in zip(rules, lasso.coefficients.toArray(), strict=True) if w)
    return RuleEnsemble(float(lasso.intercept), kept)


def labelled_examples(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", most: int = 20_000) -> DataFrame:
    """Features and labels of at most ``most`` labelled documents, those with the smallest hashes of their keys.

    The bound is the size of the sample the classifier is fitted on, so the join that finds its texts may broadcast it.
    Rows without key or label are no examples; of several labels of a key the smallest counts, of several texts each.
    """
    known = labels.filter(labels[key].isNotNull() & labels[label].isNotNull()).groupBy(labels[key].alias("_key")).agg(F.min(label).cast("int").alias("label"))
    sample = written(known.orderBy(F.xxhash64(F.col("_key").cast("string")), "_key").limit(most), "label-sample")
    found = docs.select(docs[key].alias("_key"), docs[text].alias("_text")).join(F.broadcast(sample), "_key")
    stats = found.select("label", text_statistics(F.col("_text"), STATISTICS).alias("stats"))
    return written(stats.select(F.when(F.col("label") > 0, 1).otherwise(0).alias("label"), *[c.alias(n) for n, c in features(F.col("stats")).items()]), "examples")


def score_quality(docs: DataFrame, model: RuleEnsemble, text: str = "text", out_col: str = "quality", threshold: float = 0.3) -> DataFrame:
    """All columns of ``docs`` and the struct ``out_col``: score (0 to 1) and predicted (1 from ``threshold`` on).

    Column expressions only, no shuffle. Null and empty texts are scored as texts without words. A column already named
    ``out_col`` is replaced; repeated rows are scored alike; an empty table stays empty.
    """
    kept = docs.drop(out_col)
    own = fresh(kept, "stats")
    stats = kept.withColumn(own, text_statistics(kept[text], STATISTICS))
    ratios = stats.withColumn(own, F.struct(*[c.alias(n) for n, c in features(F.col(own)).items()]))
    scored = ratios.withColumn(own, model.score({n: F.col(own)[n] for n, _, _ in FEATURES}))
    return scored.withColumn(out_col, F.struct(F.col(own).alias("score"), (F.col(own) >= threshold).cast("int").alias("predicted"))).drop(own)
