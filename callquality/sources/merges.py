"""Two runs of the same sources made one: what is taken from the other run, checked, counted, published by source."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callquality.functions.exprs import hash_fraction, multiset_digest
from callquality.operators.joins import GuardError, replace_groups, row_differences
from callquality.operators.shared import stored
from callquality.sources.snapshots import current_version, publish, read_snapshot

#: What can become of an entity; rows of the first three come from the other run, those of ``dropped`` go.
TAKEN = ("replaced", "replaced_reference", "added")


def _entities(df: DataFrame, keys: Sequence[str], branch: str, unit: str, wanted: str, side: str) -> DataFrame:
    found = df.groupBy(*keys).agg(F.min(branch).alias(f"{side}_branch"), F.max(branch).alias("_other"), F.min(unit).alias(f"{side}_unit"), F.max(F.coalesce(F.col(wanted), F.lit(False))).alias(f"{side}_wanted"))
    odd = found.filter(F.col(f"{side}_branch") != F.col("_other")).limit(1).collect()
    if odd:
        raise GuardError(f"{odd[0][keys[-1]]} is on two branches of the {side} run")
    return found.drop("_other")


def entity_cases(current: DataFrame, other: DataFrame, source: str, entity: str, branch: str, unit: str, wanted: str, quick: str = "quick", rate: float = 0.0) -> DataFrame:
    """(source, entity, case) of every entity of either run.

    Entities with units of one base that the other run called on the quick branch, and this one did not, are taken from
    it: ``replaced`` (wanted ones), ``replaced_reference`` and, where this run has none, ``added``. Those on the full branch
    here and nowhere there are ``dropped``, or ``dropped_below`` where their hash falls below ``rate``. The rest stays:
    ``quick_here`` (full there), ``other_branch`` (longer units whose branch differs) and ``kept``. GuardError for a wanted
    entity of that kind that one run lacks, or one on two branches."""
    keys = [source, entity]
    both = _entities(current, keys, branch, unit, wanted, "current").join(_entities(other, keys, branch, unit, wanted, "other"), keys, "full_outer")
    here, there = F.col("current_branch"), F.col("other_branch")
    one = F.coalesce(F.col("current_unit") == 1, F.lit(False)) | F.coalesce(F.col("other_unit") == 1, F.lit(False))
    some = F.coalesce("current_wanted", F.lit(False)) | F.coalesce("other_wanted", F.lit(False))
    take = one & (there == quick) & (here.isNull() | (here != quick))
    case = (
        F.when(one & some & (here.isNull() | there.isNull()), "missing").when(take & some, "replaced").when(take & here.isNotNull(), "replaced_reference").when(take, "added")
        .when(one & here.isNotNull() & (here != quick) & there.isNull(), F.when(hash_fraction(F.col(entity), F.col(source)) < rate, "dropped_below").otherwise("dropped"))
        .when(one & (here == quick) & there.isNotNull() & (there != quick), "quick_here").when(~one & (here != there), "other_branch").otherwise("kept")
    )
    cases = stored(both.select(source, entity, case.alias("case")), "cases")
    gone = cases.filter("case = 'missing'").limit(1).collect()
    if gone:
        raise GuardError(f"{gone[0][entity]} of {gone[0][source]} is missing from a run")
    return cases


def merged_rows(current: DataFrame, other: DataFrame, cases: DataFrame, source: str, entity: str, pos: str) -> DataFrame:
    """The current rows, with those of the cases taken from the other run in the places of the old ones, by ``place``."""
    key = F.struct(source, entity)
    chosen = cases.filter(F.col("case").isin(*TAKEN) | F.col("case").startswith("dropped")).select(key.alias("_entity"))
    return replace_groups(current.withColumn("_entity", key), other.withColumn("_entity", key), chosen, "_entity", pos).drop("_entity")


def merge_runs(
    spark: SparkSession, root: str, current: DataFrame, other: DataFrame, source: str, entity: str, on: Sequence[str], pos: str, branch: str = "genotyping_branch", unit: str = "motif_size", wanted: str = "variant_locus",
    quick: str = "quick", rate: float = 0.0, code: str = "",
) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of all sources as published under ``root`` and ``root``-summary, by source; both runs need the same
    columns and types. A source is built again only if the rows of one of its runs or ``code`` changed.

    The summary has (source, what, n): rows here and merged, entities by case, and, of entities on the quick branch in
    both runs, ``compared`` and ``differing`` rows by key ``on``, and ``differing <field>`` by column."""
    if sorted(current.dtypes) != sorted(other.dtypes):
        raise GuardError("the runs have different columns or types")
    digest = lambda df, name: df.groupBy(source).agg(multiset_digest(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"})).alias(name))
    sources = digest(current, "current").join(digest(other, "other"), source, "full_outer").withColumn("code", F.lit(f"{code} {quick} {rate}"))

    def parts(changed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        own = [df.join(changed.select(source), source, "left_semi") for df in (current, other.select(*current.columns))]
        return *own, entity_cases(*own, source, entity, branch, unit, wanted, quick, rate)

    def rows(changed: DataFrame) -> DataFrame:
        merged = merged_rows(*parts(changed), source, entity, pos)
        return merged.select(*current.columns, F.col("place.at").alias("place_at"), F.col("place.then").alias("place_then"))

    def summary(changed: DataFrame) -> DataFrame:
        here, there, cases = parts(changed)
        count = lambda df, what: df.groupBy(source, what.alias("what")).agg(F.count("*").alias("n"))
        fast = [df.filter((F.col(branch) == quick) & (F.col(unit) == 1)).drop(pos) for df in (here, there)]
        met = fast[0].join(fast[1].select(source, *on), [source, *on], "left_semi")
        off = row_differences(met, fast[1].join(fast[0].select(source, *on), [source, *on], "left_semi"), [source, *on])
        done = [
            count(here, F.lit("rows here")), count(merged_rows(here, there, cases, source, entity, pos), F.lit("rows merged")), count(cases, F.concat(F.lit("entities "), F.col("case"))),
            count(met, F.lit("compared")), count(off.select(source, *on).distinct(), F.lit("differing")), count(off, F.concat(F.lit("differing "), F.col("field"))),
        ]
        out = done[0]
        for d in done[1:]:
            out = out.unionByName(d)
        return out

    if current_version(spark, root) == 0 and sources.isEmpty():
        raise GuardError("no rows to merge")
    provenance = ["current", "other", "code"]
    sources = stored(sources, "merge-sources")
    publish(spark, root, sources, source, provenance, rows, note="merged runs")
    publish(spark, f"{root}-summary", sources, source, provenance, summary, note="merged runs")
    return read_snapshot(spark, root).drop("part_key"), read_snapshot(spark, f"{root}-summary").drop("part_key")
