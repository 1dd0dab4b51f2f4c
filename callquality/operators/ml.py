"""Fitting with Spark ML: median regression, three-class heads, isotonic calibration, importance, ablation, curves.

Spark's trees take no NaN: missing values become the median and an indicator column. Independent fits run from a few
driver threads on one session. Fits are equal in purpose to boosted histograms, not in value.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callquality.functions.exprs import order_hash
from callquality.operators.joins import GuardError
from callquality.operators.metrics import log_loss, pinball, roc_auc
from callquality.operators.sampling import hash_ranked, quota_sample
from callquality.operators.scoring import calibrate_column, renormalised
from callquality.operators.shared import stored
from callquality.operators.splits import two_halves

#: Folds that ``out_of_fold`` fits; each is a model and a part of one union.
MOST_FOLDS = 1000
#: Folds that are fitted side by side.
FOLDS_AT_ONCE = 3


def with_indicators(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return df.withColumns({f"missing_{c}": F.col(c).isNull().cast("double") for c in features})


def _assembled(features: Sequence[str]) -> list:
    return [
        Imputer(inputCols=list(features), outputCols=[f"filled_{c}" for c in features], strategy="median"),
        VectorAssembler(inputCols=[*[f"filled_{c}" for c in features], *[f"missing_{c}" for c in features]], outputCol="features"),
    ]


def fit_median(df: DataFrame, features: Sequence[str], target: str, iterations: int = 20, depth: int = 3, seed: int = 0) -> PipelineModel:
    """Boosted trees under absolute loss: the conditional median of the target."""
    head = GBTRegressor(featuresCol="features", labelCol=target, lossType="absolute", maxIter=iterations, maxDepth=depth, seed=seed, predictionCol="t_predicted")
    return Pipeline(stages=[*_assembled(features), head]).fit(with_indicators(df, features))


def fit_direction(df: DataFrame, features: Sequence[str], label: str, weight: str | None = None, trees: int = 20, depth: int = 5, seed: int = 0) -> PipelineModel:
    """A three-class forest, with weights."""
    head = RandomForestClassifier(featuresCol="features", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed, probabilityCol="probability", predictionCol="direction_predicted", rawPredictionCol="direction_raw", **({"weightCol": weight} if weight else {}))
    return Pipeline(stages=[*_assembled(features), head]).fit(with_indicators(df.withColumn(label, F.col(label).cast("double")), features))


def with_predictions(df: DataFrame, features: Sequence[str], median: PipelineModel | None = None, direction: PipelineModel | None = None, classes: int = 3) -> DataFrame:
    out = with_indicators(df, features)
    for model in (median, direction):
        if model is not None:
            out = model.transform(out).drop(*[f"filled_{c}" for c in features], "features")
    if direction is not None:
        p = vector_to_array("probability")
        out = out.withColumns({f"p_{k}": F.coalesce(F.get(p, F.lit(k)), F.lit(0.0)) for k in range(classes)}).drop("probability", "direction_raw")
    return out.drop(*[f"missing_{c}" for c in features])


def fit_calibrators(df: DataFrame, label: str, classes: int = 3, weight: str | None = None) -> DataFrame:
    """knots (class, i, x, y) of an isotonic fit of each class; a class absent or alone has none and passes through."""
    of = F.col(label).cast("int")
    present = {r[0] for r in df.filter(of.isNotNull()).select(F.when(of.between(0, classes - 1), of).otherwise(-1)).distinct().collect()}
    rows = []
    for k in range(classes):
        if k in present and len(present) > 1:
            hit = df.select((F.col(label) == k).cast("double").alias("y"), F.col(f"p_{k}").alias("x"), *([F.col(weight).alias("w")] if weight else []))
            fit = IsotonicRegression(featuresCol="x", labelCol="y", **({"weightCol": "w"} if weight else {})).fit(hit)
            rows += [(k, i, float(x), float(y)) for i, (x, y) in enumerate(zip(fit.boundaries, fit.predictions, strict=True))]
    return df.sparkSession.createDataFrame(rows, "class int, i int, x double, y double")


def apply_calibrators(df: DataFrame, knots: DataFrame, classes: int = 3) -> DataFrame:
    """p_k through their knots, clipped and renormalised, as column expressions over one row of knots."""
    packed = knots.groupBy().agg(*[F.array_sort(F.collect_list(F.when(F.col("class") == k, F.struct("x", "y", "i")))).alias(f"_k{k}") for k in range(classes)])
    joined = df.crossJoin(packed)
    fixed = renormalised([calibrate_column(F.col(f"p_{k}"), F.coalesce(F.col(f"_k{k}"), F.array().cast("array<struct<x:double,y:double,i:int>>"))) for k in range(classes)])
    return joined.withColumns({f"p_{k}": c for k, c in enumerate(fixed)}).drop(*[f"_k{k}" for k in range(classes)])


def early_stop(df: DataFrame, loss_by_size: str = "loss", size: str = "size", step: int = 25, patience: int = 3, tolerance: float = 1e-6) -> int:
    """The prefix at which a fit that checks every ``step`` iterations would stop, from the losses of all prefixes."""
    rows = df.filter(F.col(size) % step == 0).select(size, loss_by_size).orderBy(size).toLocalIterator()
    best, best_size, waited = float("inf"), None, 0
    for n, loss in rows:
        best_size = n if best_size is None else best_size
        if loss < best - tolerance:
            best, best_size, waited = loss, n, 0
        else:
            waited += 1
            if waited >= patience:
                break
    return best_size or 0


def gbt_prefix_losses(model: PipelineModel, held_out: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """(size, loss) of every prefix of a boosted regressor, from cumulative contributions of its trees in one pass."""
    trained = model.stages[-1]
    ready = PipelineModel(model.stages[:-1]).transform(with_indicators(held_out, features)).select(F.monotonically_increasing_id().alias("row"), target, "features")
    parts = ready
    for k, tree in enumerate(trained.trees):
        parts = tree.setPredictionCol(f"_t{k}").transform(parts)
    terms = F.array(*[F.col(f"_t{k}") * w for k, w in enumerate(trained.treeWeights)])

    def losses(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                y = batch.column("y").to_numpy()[:, None]
                off = y - np.cumsum(batch.column("terms").flatten().to_numpy(zero_copy_only=False).reshape(n, -1), axis=1)
                total = 0.5 * np.abs(off).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(1, len(total) + 1, dtype=np.int32)), pa.array(total), pa.array(np.full(len(total), n))], ["size", "total", "n"])

    known = parts.select(F.col(target).cast("double").alias("y"), terms.alias("terms")).filter("y IS NOT NULL")
    return known.mapInArrow(losses, "size int, total double, n long").groupBy("size").agg((F.sum("total") / F.sum("n")).alias("loss"))


def cross_fitted_gate(df: DataFrame, features: Sequence[str], label: str, group: str, threshold: float = 0.5, seed: int = 0, **how) -> DataFrame:
    """Adds gate_fires: each half of the groups is scored by a head fit on the other half."""
    halves = two_halves(df, group, seed)
    parts = []
    for half in (0, 1):
        model = fit_direction(halves.filter(F.col("half") != half), features, label, seed=seed, **how)
        parts.append(with_predictions(halves.filter(F.col("half") == half), features, direction=model))
    return parts[0].unionByName(parts[1]).withColumn("gate_fires", F.col("p_0") < threshold).drop("half", "p_0", "p_1", "p_2", "direction_predicted")


def fit_heads(df: DataFrame, features: Sequence[str], target: str, label: str, group: str, cells: Sequence[str], key: Sequence[str], cap: int, calib: DataFrame | None = None, gated: bool = True, weight: str | None = None, seed: int = 0) -> dict:
    """A quota sample trains the direction head; where its cross-fitted gate fires, rows train the size head."""
    sample = quota_sample(df, cells, cap, key, seed)
    direction = fit_direction(sample, features, label, weight, seed=seed)
    pool = cross_fitted_gate(sample, features, label, group, seed=seed).filter("gate_fires") if gated else sample
    median = fit_median(pool if not pool.isEmpty() else sample, features, target, seed=seed)
    knots = fit_calibrators(with_predictions(calib if calib is not None else sample, features, direction=direction), label)
    return {"direction": direction, "median": median, "knots": knots}


def fit_regimes(df: DataFrame, regimes: Sequence[str], fit: Callable[[DataFrame], dict], regime: str = "regime", threads: int = 3) -> dict[str, dict]:
    """One set of experts a regime; the fits run side by side."""
    with ThreadPoolExecutor(threads) as pool:
        done = {r: pool.submit(fit, df.filter(F.col(regime) == r)) for r in regimes}
        return {r: f.result() for r, f in done.items()}


def out_of_fold(df: DataFrame, folds: DataFrame, key: str, fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """Predictions of every row by a model that did not see its key: folds (key, fold, role). GuardError beyond
    ``MOST_FOLDS``."""
    numbers = [r["fold"] for r in folds.select("fold").distinct().orderBy("fold").limit(MOST_FOLDS + 1).collect()]
    if len(numbers) > MOST_FOLDS:
        raise GuardError(f"more than {MOST_FOLDS} folds")

    def one(n) -> DataFrame:
        own = folds.filter(F.col("fold") == n)
        predict = fit(df.join(own.filter("role = 'train'").select(key), key, "left_semi"))
        return predict(df.join(own.filter("role = 'test'").select(key), key, "left_semi")).withColumn("fold", F.lit(n))

    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        return reduce(DataFrame.unionByName, pool.map(one, numbers))


def shuffled_column(df: DataFrame, column: str, key: Sequence[str], seed: int) -> DataFrame:
    """The table with one column permuted: the values' hash order is joined to the rows' own order."""
    rows = hash_ranked(df, key, "rows", name="_at")
    values = hash_ranked(df.select(*key, F.col(column).alias("_new")), key, seed, name="_at").select("_at", "_new")
    return rows.join(values, "_at").withColumn(column, F.col("_new")).drop("_at", "_new")


def shuffled_copies(df: DataFrame, features: Sequence[str], key: Sequence[str], repeats: int) -> DataFrame:
    """Each row as it is (``feature`` and ``repeat`` NULL) and once a feature and repeat, with that feature's value taken from
    the row that has its place in the repeat's hash order: what ``shuffled_column`` gives, for all of them in one plan. A
    repeat has one permutation for all features, so ranks are joined once a repeat."""
    rows = stored(hash_ranked(df, key, "rows", name="_at"), "importance")
    asked = df.select(*key, F.struct(*features).alias("_new"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    values = hash_ranked(asked, key, F.col("repeat"), ["repeat"], "_at").select("repeat", "_at", "_new")
    mixed = [F.struct(F.lit(f).alias("feature"), F.struct(*[(F.col("_new")[c] if c == f else F.col(c)).alias(c) for c in features]).alias("x")) for f in features]
    rest = [c for c in df.columns if c not in features]
    copies = rows.join(values, "_at").select(*rest, "repeat", F.explode(F.array(*mixed)).alias("_m")).select(*rest, "repeat", "_m.feature", "_m.x.*")
    return rows.drop("_at").withColumns({"feature": F.lit(None).cast("string"), "repeat": F.lit(None).cast("int")}).unionByName(copies)


def permutation_importance(df: DataFrame, features: Sequence[str], key: Sequence[str], loss: Callable[[DataFrame, list[str]], DataFrame], repeats: int = 5, cap: int = 30_000) -> DataFrame:
    """(feature, mean, sd) of the rise of a loss when a feature is shuffled; at most ``cap`` rows, those first in hash order.

    ``loss(df, by)`` gives a table of ``by`` and one value. It is called once, on all copies of the rows (``by`` is feature and
    repeat), so the number of jobs does not depend on features or repeats."""
    sample = stored(df.withColumn("_h", order_hash(0, *key)).orderBy("_h").limit(cap).drop("_h"), "importance")
    found = loss(shuffled_copies(sample, features, key, repeats), ["feature", "repeat"])
    found = found.toDF(*[c if c in ("feature", "repeat") else "loss" for c in found.columns])
    found = stored(found.select("feature", "repeat", F.col("loss").cast("double").alias("loss")), "importance")
    base = found.filter("feature IS NULL").select(F.col("loss").alias("base"))
    rises = found.filter("feature IS NOT NULL").crossJoin(F.broadcast(base)).withColumn("rise", F.col("loss") - F.col("base"))  # base is one row
    return rises.groupBy("feature").agg(F.avg("rise").alias("mean"), F.stddev_pop("rise").alias("sd"))


def ablation_curve(train: DataFrame, test: DataFrame, ranking: Sequence[str], target: str, sizes: Sequence[int], **how) -> DataFrame:
    """(k, loss): the median head refit on the first k features of a ranking; k = 0 is the constant median."""
    rows = []
    for k in sizes:
        if k == 0:
            level = train.agg(F.median(target)).first()[0]
            scored = test.withColumn("t_predicted", F.lit(level))
        else:
            scored = with_predictions(test, ranking[:k], median=fit_median(train, ranking[:k], target, **how))
        rows.append((k, float(scored.agg(pinball(F.col(target), F.col("t_predicted"))).first()[0])))
    return train.sparkSession.createDataFrame(rows, "k int, loss double")


def direction_ablation_curve(train: DataFrame, test: DataFrame, ranking: Sequence[str], label: str, sizes: Sequence[int], classes: int = 3, **how) -> DataFrame:
    """(k, loss): log-loss of the direction head on the first k features; k = 0 is the class prior."""
    rows = []
    for k in sizes:
        if k == 0:
            n = train.count()
            prior = {int(r[label]): r["count"] / n for r in train.groupBy(label).count().limit(classes + 1).collect()}
            scored = test.withColumns({f"p_{c}": F.lit(float(prior.get(c, 0.0))) for c in range(classes)})
        else:
            scored = with_predictions(test, ranking[:k], direction=fit_direction(train, ranking[:k], label, **how))
        rows.append((k, float(log_loss(scored, label, [f"p_{c}" for c in range(classes)]).first()[0])))
    return train.sparkSession.createDataFrame(rows, "k int, loss double")


def smallest_within(curve: DataFrame, stratum: str, size: str, value: str, tolerance: float) -> DataFrame:
    """The smallest size whose value is within the tolerance of the largest size's in every stratum."""
    best = curve.groupBy(stratum).agg(F.max_by(value, size).alias("_best"), F.max(size).alias("_last"))
    ok = curve.join(best, stratum).groupBy(size).agg(F.bool_and(F.col(value) <= F.col("_best") * (1 + tolerance)).alias("_ok"), F.max("_last").alias("_last"))
    return ok.agg(F.coalesce(F.min(F.when(F.col("_ok"), F.col(size))), F.max("_last")).alias(size))


def distinguishability(real: DataFrame, simulated: DataFrame, features: Sequence[str], group: str, folds: int = 3, seed: int = 0) -> DataFrame:
    """AUC of a classifier that tells two samples apart, cross-validated by hash of the group."""
    both = real.select(group, *features).withColumn("y", F.lit(0.0)).unionByName(simulated.select(group, *features).withColumn("y", F.lit(1.0)))
    both = both.withColumn("_fold", F.pmod(F.crc32(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")).cast("binary")), F.lit(folds)))

    def one(k: int) -> DataFrame:
        head = GBTClassifier(featuresCol="features", labelCol="y", maxIter=10, maxDepth=3, seed=seed)
        model = Pipeline(stages=[*_assembled(features), head]).fit(with_indicators(both.filter(F.col("_fold") != k), features))
        return model.transform(with_indicators(both.filter(F.col("_fold") == k), features)).select("y", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))

    with ThreadPoolExecutor(FOLDS_AT_ONCE) as pool:
        out = reduce(DataFrame.unionByName, pool.map(one, range(folds)))
    return roc_auc(out.withColumn("y", F.col("y") == 1), "score", "y")
