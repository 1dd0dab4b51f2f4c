"""Training recipes: which rows each head of each regime is fitted on, with which weights, and the fit of one regime."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callquality.operators import ml
from callquality.operators.joins import GuardError
from callquality.operators.sampling import balancing_weights, cap_rows, quota_sample
from callquality.operators.shared import stored
from callquality.operators.splits import two_halves

#: Heads of a recipe's rows.
DIRECTION, SIZE, CALIBRATION = "direction", "size", "calibration"


class Recipe(NamedTuple):
    """``cap``: rows of a head in a regime, spread evenly over ``cells``; calibration takes a fifth. ``reference_rows``: so many
    rows of the population without a variant join the direction head, whose other rows are then those of the size head.
    ``balance``: a column of cells in which the direction head's two wrong classes weigh the same (NULL: not balanced)."""

    cap: int
    cells: Sequence[str]
    reference_rows: int | None = None
    balance: str | None = None


def recipe_rows(
    rows: DataFrame, recipe: Recipe, key: Sequence[str], length_rows: DataFrame | None = None, by: Sequence[str] = ("regime",), calibration: str = "calibration",
    representative: str = "representative", variant: str = "variant", label: str = "dir_code", wrong: tuple[object, object] = (1, 2), seed: int = 0,
) -> DataFrame:
    """The rows of ``rows`` that each head is fitted on, with ``head`` and ``weight``; a row may serve several heads.

    Rows of people held out (``calibration``) only calibrate, and of these only representative ones do, as they estimate
    frequencies. The size head draws from ``length_rows``, a table of another population with the same columns and people
    held out, where given. A flag that is NULL counts as false. A regime without rows for a head has none. GuardError for
    ``reference_rows`` without ``length_rows``.
    """
    if recipe.reference_rows is not None and length_rows is None:
        raise GuardError("rows without a variant join those of another table: give length_rows")
    by, flag = list(by), lambda c: F.coalesce(F.col(c), F.lit(False))
    rows = stored(rows, "recipe")
    other = rows if length_rows is None else stored(length_rows.select(*rows.columns), "recipe")
    sample = lambda df, cap: quota_sample(df.filter(~flag(calibration)), recipe.cells, cap, key, seed, by)
    size = sample(other, recipe.cap)
    if recipe.reference_rows is not None:
        direction = size.unionByName(sample(rows.filter(~flag(variant)), recipe.reference_rows))
    else:
        direction = size if length_rows is None else sample(rows, recipe.cap)
    held = cap_rows(rows.filter(flag(calibration) & flag(representative)), max(1, recipe.cap // 5), key, seed + 2, by)
    weighed = [_balanced(part, recipe.balance, by, label, wrong).withColumn("head", F.lit(head)) for part, head in ((direction, DIRECTION), (held, CALIBRATION))]
    return weighed[0].unionByName(weighed[1]).unionByName(size.withColumns({"weight": F.lit(1.0), "head": F.lit(SIZE)}))


def _balanced(df: DataFrame, cell: str | None, by: Sequence[str], label: str, wrong: tuple[object, object]) -> DataFrame:
    if cell is None:
        return df.withColumn("weight", F.lit(1.0))
    named = df.withColumn("_cell", F.when(F.col(cell).isNotNull(), F.to_json(F.struct(*by, cell))))
    return balancing_weights(named, "_cell", label, *wrong).select(*df.columns, "weight")


def fit_recipe(part: DataFrame, features: Sequence[str], target: str, label: str, group: str, threshold: float = 0.5, gated: bool = True, seed: int = 0, classes: int = 3) -> dict[str, PipelineModel | DataFrame]:
    """direction, median and knots of one regime's ``recipe_rows`` (``ml.fit_regimes`` runs it a regime).

    The size head learns the rows at which the gate fires, judged by direction heads that did not see their group; all
    rows where it never fires. The right class is calibrated on rows as they are, the wrong ones on weighed rows. A regime
    without calibration rows has no knots."""
    part = stored(part, "recipe-part")
    of = lambda head: part.filter(F.col("head") == head)
    direction, size, held = of(DIRECTION), of(SIZE), of(CALIBRATION)
    model = ml.fit_direction(direction, features, label, "weight", seed=seed)
    pool = size
    if gated:
        halves = two_halves(part.filter(F.col("head") != CALIBRATION).select(group).distinct(), group, seed)
        fired = None
        for half in (0, 1):
            judge = ml.fit_direction(direction.join(halves, group).filter(F.col("half") != half), features, label, "weight", seed=seed)
            judged = ml.with_predictions(size.join(halves, group).filter(F.col("half") == half), features, direction=judge, classes=classes)
            judged = judged.filter(F.col("p_0") < threshold).select(*size.columns)
            fired = judged if fired is None else fired.unionByName(judged)
        fired = stored(fired, "recipe-gated")
        pool = size if fired.isEmpty() else fired
    scored = stored(ml.with_predictions(held, features, direction=model, classes=classes).select(label, "weight", *[f"p_{k}" for k in range(classes)]), "recipe-held")
    knots = ml.fit_calibrators(scored, label, classes).filter("class = 0").unionByName(ml.fit_calibrators(scored, label, classes, "weight").filter("class > 0"))
    return {"direction": model, "median": ml.fit_median(pool, features, target, seed=seed), "knots": knots}
