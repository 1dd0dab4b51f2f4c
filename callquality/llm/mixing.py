"""Mixing sources to target weights: repetition rates per source, whole copies plus one hash-seeded Bernoulli copy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callquality.llm.common import fresh, small_side, word_count, written


def mixing_targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """Adds ``target`` to a table (source, source_size) of one row a source.

    Sources by code point, null last, get ``weights`` in turn and share ``share`` times all sizes; no target is above
    ``most`` times its source's size, and what is above is shared again by weight. The result is
    min(most * size, level * weight) for the level at which the targets sum to the share, found from running sums over
    the sources ordered by the level at which they are full. Work is on one row a source; documents don't move.
    """
    n = len(weights)
    by_name = W.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    turn = (F.row_number().over(by_name) - 1) % n
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    full = F.lit(float(most)) * F.col("source_size") / F.col("weight")
    order = W.orderBy("full", F.col("source").isNull(), F.col("source").cast("binary"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    all_rows = W.partitionBy(F.lit(0))
    level = (F.lit(float(share)) * F.sum("source_size").over(all_rows) - F.lit(float(most)) * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(after)
    ranked = sizes.withColumn("weight", weight).withColumn("full", full).withColumn("level", level)
    # The right level is that of the first source which it does not fill; if all are full, no level binds.
    held = F.min(F.when(F.col("level") <= F.col("full"), F.struct(F.col("full"), F.col("level")))).over(all_rows)["level"]
    return ranked.withColumn("target", F.least(F.lit(float(most)) * F.col("source_size"), F.coalesce(held * F.col("weight"), F.lit(float("inf"))))).select("source", "source_size", "target")


def draw(seed: str, key: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the key alone."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def mixing_plan(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", seed: str = "mix-1", out_col: str = "mix", **how) -> DataFrame:
    """All columns of ``docs`` and the struct ``out_col``: size, source_size, target, rate, copies (long).

    ``copies`` is floor(rate) plus 1 where ``draw(seed, key)`` is below the fraction, with rate = target / source_size.
    Equal keys draw alike, a null key as the text "null"; a null source is a source of its own, a null text has size 0
    and a source of size 0 has rate 0. Sizes meet per source in a partial aggregation; the table of sources is written
    and counted, and broadcast only below ``small_side``'s limit, else both sides are shuffled and hot sources split.
    """
    kept = docs.drop(out_col)
    sized = kept.withColumn(out_col, word_count(kept[text]))
    sources = kept.select(kept[source].alias("source"), word_count(kept[text]).alias("size")).groupBy("source").agg(F.sum("size").alias("source_size"))
    own = fresh(sized, "mix_target")
    targets = small_side(written(mixing_targets(sources, **how).select(F.struct("source", "source_size", "target").alias(own)), "mix-targets"))
    of = F.col(own)
    joined = sized.join(targets, sized[source].eqNullSafe(of["source"]), "left")
    rate = F.when(of["source_size"] > 0, of["target"] / of["source_size"]).otherwise(F.lit(0.0))
    whole = F.floor(rate)
    copies = whole + F.when(draw(seed, F.col(key)) < rate - whole, 1).otherwise(0)
    fields = (F.col(out_col).alias("size"), of["source_size"].alias("source_size"), of["target"].alias("target"), rate.alias("rate"), copies.cast("long").alias("copies"))
    return joined.withColumn(out_col, F.struct(*fields)).drop(own)


def mix(docs: DataFrame, **how) -> DataFrame:
    """Each document as often as ``mixing_plan`` says, with the columns of ``docs``; none of a document with 0 copies."""
    own = fresh(docs, "mix_plan")
    plan = mixing_plan(docs, out_col=own, **how)
    copies = F.when(F.col(own)["copies"] > 0, F.sequence(F.lit(1), F.col(own)["copies"]))
    return plan.withColumn(own, F.explode(copies)).select(*docs.columns)
