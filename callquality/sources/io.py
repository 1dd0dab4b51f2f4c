"""Readers and writers: nested call records, truth and region tables, parts with provenance, manifests, contracts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from callquality.functions import parse as P
from callquality.functions.exprs import numeric, strip_prefix, valid_partition
from callquality.operators.joins import GuardError, first_per_key, only_keys_of
from callquality.operators.shared import counted_broadcast

#: Schema of one variant in a call record; numbers are doubles, as they are written either way.
_METRICS = "struct<AlleleNumber:int,AlleleSize:int,Depth:double,HighQualityUnambiguousReads:double,StrandBiasBinomialPhred:double,MeanInsertedBasesWithinRepeats:double,MeanDeletedBasesWithinRepeats:double,ReadRepeatPurity:double,LeftFlankNormalizedDepth:double,RightFlankNormalizedDepth:double>"
_VARIANT = (
    "struct<RepeatUnit:string,ReferenceRegion:string,QuickGenotype:boolean,Genotype:string,GenotypeConfidenceInterval:string,CountsOfSpanningReads:string,CountsOfFlankingReads:string,"
    f"CountsOfHighQualityUnambiguousReads:string,CountsOfInrepeatReads:string,ReferenceRepeatPurity:double,AlleleQualityMetrics:struct<Alleles:array<{_METRICS}>>>"
)
LOCUS = f"struct<LocusId:string,Coverage:double,ReadLength:double,Variants:map<string,{_VARIANT}>>"
DOCUMENT = f"SampleParameters struct<SampleId:string>, LocusResults map<string,{LOCUS}>"
TRUTH = "LocusId string, Chrom string, Start0Based long, End long, Motif string, NumRepeatsInReference string, NumRepeatsShortAllele string, NumRepeatsLongAllele string, RepeatPurityShortAllele double, RepeatPurityLongAllele double"


def read_call_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, sample_id, locus) of whole documents, gzipped or not. A document isn't splittable: a task each.
    Large call sets should be written one locus a line and read with ``read_call_lines``."""
    docs = spark.read.schema(DOCUMENT).option("multiLine", True).json(path).withColumn("source_file", F.input_file_name())
    return docs.select("source_file", F.col("SampleParameters.SampleId").alias("sample_id"), F.explode(F.map_values("LocusResults")).alias("locus"))


def read_call_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from lines of one locus each, with the sample's id: splittable."""
    rows = spark.read.schema(f"SampleId string, Locus {LOCUS}").json(path)
    return rows.select(F.input_file_name().alias("source_file"), F.col("SampleId").alias("sample_id"), F.col("Locus").alias("locus"))


def variant_rows(calls: DataFrame, sample_id: str | None = None) -> DataFrame:
    """One row a variant, under the given sample id where there is one."""
    each = calls.select("source_file", F.coalesce(F.lit(sample_id), F.col("sample_id")).alias("sample_id"), "locus", F.explode(F.map_entries("locus.Variants")).alias("e"))
    return each.select("source_file", "sample_id", F.col("locus.LocusId").alias("locus_id"), F.col("locus.Coverage").alias("coverage"), F.col("locus.ReadLength").alias("read_length"), F.col("e.key").alias("variant_id"), "e.value.*")


def allele_rows(variants: DataFrame) -> DataFrame:
    """One row an element, with parsed counts, metrics and derived values; two rows of NULLs where there is no call."""
    v = variants.withColumns({
        "genotype": P.parse_genotype(F.col("Genotype")), "region": P.parse_region(F.col("ReferenceRegion")), "spanning": P.parse_counts(F.col("CountsOfSpanningReads")),
        "flanking": P.parse_counts(F.col("CountsOfFlankingReads")), "unambiguous": P.parse_counts(F.col("CountsOfHighQualityUnambiguousReads")), "inrepeat": P.parse_counts(F.col("CountsOfInrepeatReads")),
        "motif_size": F.length("RepeatUnit").cast("double"), "alleles": F.coalesce("AlleleQualityMetrics.Alleles", F.array().cast(f"array<{_METRICS}>")),
    })
    v = v.withColumn("intervals", P.parse_intervals(F.col("GenotypeConfidenceInterval"), F.coalesce(F.size("genotype"), F.lit(0))))
    branch = F.when(F.coalesce("QuickGenotype", F.lit(False)), "quick").otherwise("full")
    v = v.withColumn("genotyping_branch", branch).withColumn("allele_rank", F.explode(P.call_ranks(F.col("genotype"))))
    rank = F.col("allele_rank")
    called = F.when(F.col("genotype").isNotNull(), F.get("genotype", rank))
    has = F.col("genotype").isNotNull()
    a = v.withColumns({"called": called, "m": P.metrics_for(F.col("alleles"), rank, called), "ci": F.get("intervals", rank), "mode": P.counts_mode(F.col("spanning"))})
    ref_bp = (F.col("region.end") - F.col("region.start")).cast("double")
    n_ref = F.try_divide(ref_bp, F.col("motif_size"))
    total = lambda c: F.when(has, P.counts_total(F.col(c))).cast("double")
    full = lambda c: F.when(F.col("genotyping_branch") == "full", c)
    c = F.col("called")
    return a.select(
        "source_file", "sample_id", "locus_id", "variant_id", "allele_rank", F.when(has, P.has_own_metrics(F.col("alleles"), rank)).otherwise(False).alias("has_own_quality_metrics"),
        "motif_size", F.col("ReferenceRepeatPurity").alias("reference_repeat_purity"), ref_bp.alias("ref_size_bp"), n_ref.alias("num_repeats_in_reference"), c.cast("double").alias("called"),
        (c - n_ref).alias("called_minus_ref"), F.size("genotype").cast("double").alias("n_alleles"), F.size(F.array_distinct("genotype")).cast("double").alias("n_distinct_alleles"),
        F.col("ci.lo").cast("double").alias("ci_start"), F.col("ci.hi").cast("double").alias("ci_end"), (F.col("ci.hi") - F.col("ci.lo")).cast("double").alias("ci_width"),
        total("spanning").alias("spanning_total"), total("unambiguous").alias("hq_unamb_total"), total("flanking").alias("flanking_total"),
        F.when(has, P.counts_at(F.col("spanning"), c)).cast("double").alias("spanning_at_called"), F.when(has, P.counts_above(F.col("spanning"), c)).cast("double").alias("spanning_above_called"),
        F.when(has, P.counts_above(F.col("flanking"), c)).cast("double").alias("flanking_above_called"), P.support_fraction(P.counts_at(F.col("spanning"), c), P.counts_total(F.col("spanning"))).alias("support_frac"),
        F.when(has, P.flanking_share(P.counts_total(F.col("flanking")), P.counts_total(F.col("spanning")))).alias("flanking_frac"), "coverage", F.col("m.Depth").alias("depth"),
        F.col("m.HighQualityUnambiguousReads").alias("hq_unambiguous_reads"), F.col("m.StrandBiasBinomialPhred").alias("strand_bias_phred"), F.col("m.MeanInsertedBasesWithinRepeats").alias("mean_inserted_bases"),
        F.col("m.MeanDeletedBasesWithinRepeats").alias("mean_deleted_bases"), F.col("m.ReadRepeatPurity").alias("read_repeat_purity"), "genotyping_branch",
        full(F.col("m.LeftFlankNormalizedDepth")).alias("left_flank_norm_depth"), full(F.col("m.RightFlankNormalizedDepth")).alias("right_flank_norm_depth"), full(total("inrepeat")).alias("inrepeat_total"),
        (c - F.col("mode.size")).cast("double").alias("called_minus_spanning_mode"), F.when(has, F.coalesce("mode.n", F.lit(0))).cast("double").alias("spanning_mode_support"),
        F.abs(c - P.sister_value(F.col("genotype"), rank)).cast("double").alias("het_gap"),
    )


def typical_read_length(calls: DataFrame) -> DataFrame:
    """Per source the largest read length of any of its loci, over all loci."""
    return calls.groupBy("source_file").agg(F.max("locus.ReadLength").alias("read_length"))


def last_version(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(source_file, version): the last match of a pattern in each text file."""
    lines = spark.read.text(path).select(F.input_file_name().alias("source_file"), F.monotonically_increasing_id().alias("line"), F.regexp_extract_all("value", F.lit(pattern), F.lit(1)).alias("found"))
    return lines.filter(F.size("found") > 0).groupBy("source_file").agg(F.max_by(F.element_at("found", -1), "line").alias("version"))


def read_truth(spark: SparkSession, path: str, schema: str = TRUTH, key: str = "LocusId") -> DataFrame:
    """A truth table of tabs, as strings and numbers, one row a key (the smallest row of equal keys), with the partition
    normalised; other partitions are left out and unreadable counts are NULL."""
    raw = spark.read.option("sep", "\t").option("header", True).schema(schema).csv(path)
    counts = {c: numeric(c) for c in raw.columns if c.startswith("NumRepeats")}
    return first_per_key(raw.withColumns(counts), [key], *[c for c in raw.columns if c != key]).withColumn("Chrom", valid_partition("Chrom")).filter("Chrom IS NOT NULL")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").schema("chrom string, start long, end long").csv(path).withColumn("chrom", strip_prefix("chrom"))


def read_keyed(spark: SparkSession, path: str, keys: DataFrame, on: str, columns: Sequence[str]) -> DataFrame:
    return only_keys_of(spark.read.option("sep", "\t").option("header", True).csv(path).select(*columns), keys, [on])


def read_known_entities(spark: SparkSession, path: str, location: str, motif: str, reference_motif: str, numbers: Sequence[str]) -> DataFrame:
    """A metadata table: ``chrom:start-end`` (1-based) as 0-based columns, the first token of the unit or the reference
    unit, coerced numbers."""
    raw = spark.read.option("sep", "\t").option("header", True).csv(path)
    region = P.parse_region(F.col(location))
    token = F.nullif(F.split_part(F.coalesce(F.col(motif), F.lit("")), F.lit(" "), F.lit(1)), F.lit(""))
    return raw.withColumns({"chrom": region["chrom"], "start": region["start"] - 1, "end": region["end"], "expanded_motif": F.coalesce(token, F.col(reference_motif)), **{c: numeric(c) for c in numbers}})


def keyed_values(df: DataFrame, name: str, key: str, value: str) -> DataFrame:
    """Long (name, key, value) rows as one map a name."""
    return df.groupBy(name).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(key, value)))).alias("values"))


def read_parts(spark: SparkSession, path: str, pattern: str = r"([^/]+)\.parquet") -> DataFrame:
    """All parts under a path, with the part's name as ``individual``."""
    return spark.read.parquet(path).withColumn("individual", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def read_population(spark: SparkSession, path: str, schema: T.StructType, population: str, individuals: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Parts laid out by population, branch and individual (``write_parts``): one population, the individuals of a table
    (their distinct values, found small before they are broadcast), and some columns.

    The population is cut by its folder, the individuals by pruning at run time, columns and filters reach the files."""
    parts = spark.read.schema(schema).parquet(path).filter(F.col("population") == population)
    wanted = counted_broadcast(individuals.select("individual").distinct())
    return parts.select("population", "branch", "individual", *columns).join(wanted, "individual")


def union_roots(tables: dict[str, DataFrame], part: str) -> DataFrame:
    """Rows of several roots with ``root``; a part may be in one root only, and no root may be empty."""
    out = None
    for root, df in tables.items():
        if df.isEmpty():
            raise GuardError(f"{root} has no rows")
        here = df.withColumn("root", F.lit(root))
        out = here if out is None else out.unionByName(here)
    twice = out.groupBy(part).agg(F.count_distinct("root").alias("n")).filter("n > 1").limit(1).collect()
    if twice:
        raise GuardError(f"part {twice[0][0]} is in several roots")
    return out


def source_listing(spark: SparkSession, path: str) -> DataFrame:
    """(path, modified, length) of files, without reading them."""
    return spark.read.format("binaryFile").load(path).select("path", F.col("modificationTime").alias("modified"), "length")


def changed_sources(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Sources that the manifest doesn't know in this version."""
    return listing.join(manifest.select("path", "modified", "length"), ["path", "modified", "length"], "left_anti")


def require_fresh(upstream: DataFrame, derived: DataFrame, on: str, modified: str = "modified") -> None:
    """GuardError if an upstream is newer than what is derived from it."""
    new = upstream.groupBy(on).agg(F.max(modified).alias("_up")).join(derived.groupBy(on).agg(F.min(modified).alias("_down")), on).filter("_up > _down").limit(1).collect()
    if new:
        raise GuardError(f"{new[0][on]} is older than its source")


def require_contract(schema: T.StructType, doubles: Sequence[str], others: Sequence[str] = (), name: str = "table") -> None:
    """GuardError unless the columns are there, those of the contract as doubles. Check each part before a union."""
    kinds = {f.name: f.dataType for f in schema.fields}
    missing = [c for c in (*doubles, *others) if c not in kinds]
    narrowed = [c for c in doubles if c in kinds and not isinstance(kinds[c], T.DoubleType)]
    if missing or narrowed:
        raise GuardError(f"{name}: missing {missing}, not double {narrowed}")


def project_features(df: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Columns in the order of the contract, as doubles; a float column is an error, as it has lost digits."""
    narrow = [f.name for f in df.schema.fields if f.name in names and isinstance(f.dataType, T.FloatType)]
    missing = [n for n in names if n not in df.columns]
    if narrow or missing:
        raise GuardError(f"float {narrow}, missing {missing}")
    return df.select(*keep, *[F.col(n).cast("double").alias(n) for n in names])


def require_population(schema: T.StructType, name: str = "table") -> None:
    require_contract(schema, ["keep_probability"], ["variant", "in_pool", "representative"], name)


def write_parts(df: DataFrame, path: str, *by: str) -> None:
    """Replaces the partitions that ``df`` holds and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("sep", "\t").option("header", True).option("compression", "gzip").csv(path)


def marked(df: DataFrame, ids: DataFrame, on: str, column: str) -> DataFrame:
    """One boolean column replaced: whether the key is among the ids; all other columns as they were."""
    hit = ids.select(on, F.lit(True).alias("_hit")).distinct()
    return df.join(hit, on, "left").withColumn(column, F.coalesce("_hit", F.lit(False))).drop("_hit")


def stale_parts(present: DataFrame, manifest: DataFrame, on: Sequence[str]) -> DataFrame:
    """Parts whose key has left the manifest."""
    return present.join(manifest.select(*on).distinct(), list(on), "left_anti")


def catalog_json(df: DataFrame, *columns: str) -> Column:
    return F.to_json(F.struct(*columns))


def write_catalog(df: DataFrame, path: str, *columns: str) -> None:
    df.select(catalog_json(df, *columns).alias("value")).write.mode("overwrite").text(path)


def registry(spark: SparkSession, rows: Sequence[tuple[str, str, str, str, str]]) -> DataFrame:
    """(source, truth, label, role, path), one row a source."""
    return spark.createDataFrame(list(rows), "source string, truth string, label string, role string, path string")


def sources_by_person(sources: DataFrame, person: Column) -> DataFrame:
    return sources.groupBy(person.alias("person")).agg(F.sort_array(F.collect_list("source")).alias("sources"))
