"""Evaluation that fits or stages models: learning curves, and the bundle of one regime. Results are long tables of
metrics (part, item, metric, value), so that any sink can take them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callquality.functions.exprs import half_even
from callquality.operators import metrics, ml
from callquality.operators.scoring import calibrated, compile_knots, compile_model, softmax, tree_values
from callquality.operators.shared import stored


def long_metrics(df: DataFrame, part: str, item: Sequence[str] = ()) -> DataFrame:
    """(part, item, metric, value): one row for each numeric column that isn't part of the item; booleans count as 0, 1."""
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name not in item]
    each = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in numbers])
    name = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in item]) if item else F.lit("")
    return df.select(F.lit(part).alias("part"), name.alias("item"), F.explode(each).alias("_x")).select("part", "item", "_x.*")


def write_metrics(found: DataFrame, path: str, predictions: DataFrame | None = None, predictions_path: str | None = None, by: Sequence[str] = ()) -> None:
    """The metrics as JSON lines, and the rows' probabilities, if wanted, as columns of Parquet."""
    found.write.mode("overwrite").json(path)
    if predictions is not None and predictions_path is not None:
        writer = predictions.write.mode("overwrite")
        (writer.partitionBy(*by) if by else writer).parquet(predictions_path)


def staged_scores(df: DataFrame, nodes: DataFrame, regime: str, features: Sequence[str], sizes: Sequence[int], knots: DataFrame | None = None, ratio: int = 2, classes: int = 3) -> DataFrame:
    """Each row once a size, with size, t_predicted and p_0 ... of the model's first iterations: ``size`` of the direction
    head, ``ratio`` times as many of the size head, baselines included; a shorter head stays whole. Knots (size, class, i,
    x, y) calibrate each size by its own curves. One pass: sums go on from size to size.
    """
    spark, own = df.sparkSession, nodes.filter(F.col("regime") == regime)
    trees = compile_model(own)
    curves = compile_knots(knots.withColumn("regime", F.col("size"))) if knots is not None else {}
    counted = own.select("head", "iter", "class").distinct().groupBy("head").agg(*[F.count_if(F.col("iter") < F.when(F.col("head") == "size", ratio * s).otherwise(s)).alias(str(s)) for s in sizes]).collect()
    ends = {r["head"]: [r[str(s)] for s in sizes] for r in counted}
    shared = spark.sparkContext.broadcast(({h: trees.get((regime, h), []) for h in ("size", "direction")}, ends, curves))
    carried = df.columns
    base = df.withColumn("_x", F.array(*[F.col(c).cast("double") for c in features]))

    def stages(head: str, x: np.ndarray, width: int):
        of, ends_, _ = shared.value
        total, done = np.zeros((len(x), width)), 0
        for end in ends_.get(head, [0] * len(sizes)):
            for tree in of[head][done:end]:
                total[:, tree[0]] += tree_values(tree, x)
            done = max(done, end)
            yield total.copy()

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, len(features))
            rows = [batch.column(c) for c in carried]
            for size, t, raw in zip(sizes, stages("size", x, 1), stages("direction", x, classes), strict=True):
                p = calibrated(softmax(raw), shared.value[2].get(size, {}))
                columns = [pa.array(np.full(n, size), pa.int32()), pa.array(t[:, 0], pa.float64()), *[pa.array(p[:, k], pa.float64()) for k in range(classes)]]
                yield pa.RecordBatch.from_arrays([*rows, *columns], [*carried, "size", "t_predicted", *[f"p_{k}" for k in range(classes)]])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return base.mapInArrow(run, f"{kinds}, size int, t_predicted double, " + ", ".join(f"p_{k} double" for k in range(classes)))


def learning_curves(
    cells: DataFrame, calib: DataFrame, nodes: DataFrame, regime: str, features: Sequence[str], sizes: Sequence[int], label: str, called: str, truth: str, strata: dict[str, Column],
    cell: str = "cell", weight: str | None = None, ratio: int = 2, classes: int = 3, digits: int = 3, gate: float = 0.5,
) -> DataFrame:
    """(cell, stratum, size, n, mae_raw, mae_gated, log_loss) of a model's prefixes, recalibrated at each size.

    ``calib`` gives the curves, ``cells`` the rows to judge; both hold the features. Weights put a sample of a cell back
    on its population's scale. Rows of no stratum count nowhere; a stratum without rows has none."""
    for_curves = stored(staged_scores(calib.select(*dict.fromkeys([*features, label])), nodes, regime, features, sizes, None, ratio, classes), "curves")
    knots = None
    for s in sizes:
        one = ml.fit_calibrators(for_curves.filter(F.col("size") == s), label, classes).withColumn("size", F.lit(s))
        knots = one if knots is None else knots.unionByName(one)
    staged = staged_scores(cells, nodes, regime, features, sizes, knots, ratio, classes)
    p_ok, factor = F.round("p_0", digits), F.round(F.exp("t_predicted"), digits)
    new = F.when((p_ok < gate) & (factor > 0), half_even(F.col(called) / factor)).otherwise(F.col(called))
    w = F.lit(1.0) if weight is None else F.col(weight)
    p = F.get(F.array(*[F.col(f"p_{k}") for k in range(classes)]), F.col(label))
    rows = metrics.strata(staged, strata).select(
        cell, "stratum", "size", w.alias("_w"), F.abs(F.col(called) - F.col(truth)).alias("_raw"), F.abs(new - F.col(truth)).alias("_new"),
        (-F.ln(F.least(F.greatest(p, F.lit(1e-6)), F.lit(1.0)))).alias("_loss"),
    )
    mean = lambda c, name: metrics.weighted_mean(F.col(c), F.col("_w")).alias(name)
    return rows.groupBy(cell, "stratum", "size").agg(F.count("*").alias("n"), mean("_raw", "mae_raw"), mean("_new", "mae_gated"), mean("_loss", "log_loss"))


def evaluation_bundle(
    df: DataFrame, folds: DataFrame, key: str, row_key: Sequence[str], fit: Callable[[DataFrame], Callable[[DataFrame], DataFrame]], called: str, truth: str, target: str, label: str, tol: str,
    rows: Column | None = None, rankings: Sequence[str] = (), ablation_sizes: Sequence[int] = (), classes: int = 3, digits: int = 3, seed: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """(metrics, predictions) of one regime's rows, each predicted by a model that did not see its ``key``.

    ``fit`` turns training rows into a function that adds t_predicted and p_0 ... ; ``rows`` keeps a part (such as units
    of one base). Metrics: rows, size (point), gated (with factor and probability rounded as they are emitted), direction
    (log-loss, accuracy, calibration error, area under the curve of a right call), confusion; with ``rankings`` (the
    features) the permutation importance of both heads on the first fold's held-out rows, and with ``ablation_sizes`` the
    losses of both heads refitted on the first features of those rankings. Without rows the metrics say n = 0.
    """
    own = df if rows is None else df.filter(F.coalesce(rows, F.lit(False)))
    names = [f"p_{k}" for k in range(classes)]
    found = ml.out_of_fold(own, folds, key, fit)
    factor = F.round(F.exp("t_predicted"), digits)
    found = stored(found.withColumns({
        "predicted": F.col(called) / F.exp("t_predicted"), "corrected": F.when(factor > 0, half_even(F.col(called) / factor)),
        "p_emitted": F.round("p_0", digits), "right": F.col(label) == 0, "delta": half_even(F.col(called)) - half_even(F.col(truth)),
    }), "predictions")
    parts = [
        long_metrics(own.agg(F.count("*").alias("n_rows")), "rows"),
        long_metrics(metrics.point_metrics(found, (), called, truth, "predicted", target, "t_predicted", tol), "size"),
        long_metrics(metrics.gated_errors(found, (), called, truth, "corrected", "p_emitted"), "gated"),
        long_metrics(metrics.log_loss(found, label, names), "direction"), long_metrics(metrics.accuracy(found, label, names), "direction"),
        long_metrics(metrics.calibration_error(found, "p_0", "right"), "direction"), long_metrics(metrics.roc_auc(found, "p_0", "right"), "direction"),
        long_metrics(metrics.confusion(found, label, names), "confusion", ["label", "predicted"]),
    ]
    if rankings:
        first = folds.filter(F.col("fold") == folds.agg(F.min("fold")).first()[0])
        train, test = (own.join(first.filter(F.col("role") == role).select(key), key, "left_semi") for role in ("train", "test"))
        predict = fit(train)
        losses = {
            "size": lambda x, by: predict(x).groupBy(*by).agg(metrics.pinball(F.col(target), F.col("t_predicted"))),
            "direction": lambda x, by: metrics.log_loss(predict(x), label, names, by),
        }
        curves = {"size": (ml.ablation_curve, target), "direction": (ml.direction_ablation_curve, label)}
        for head, loss in losses.items():
            rises = ml.permutation_importance(test, rankings, row_key, loss, repeats=3)
            parts.append(long_metrics(rises, f"importance {head}", ["feature"]))
            if ablation_sizes:
                order = [r["feature"] for r in rises.orderBy(F.desc("mean"), "feature").select("feature").collect()]
                curve, goal = curves[head]
                parts.append(long_metrics(curve(train, test, order, goal, ablation_sizes, seed=seed), f"ablation {head}", ["k"]))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, found
