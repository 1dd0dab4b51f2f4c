"""Packed strings and nested call records as arrays and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR = r"\((\d+), *(\d+)\)"


def parse_counts(s: Column) -> Column:
    """``(size, count), ...`` as an array of structs; empty and NULL give an empty array."""
    s = F.coalesce(s, F.lit(""))
    numbers = lambda g: F.transform(F.regexp_extract_all(s, F.lit(_PAIR), F.lit(g)), lambda x: x.cast("int"))
    return F.arrays_zip(numbers(1).alias("size"), numbers(2).alias("n"))


def parse_genotype(s: Column) -> Column:
    """``a/b`` as an array of ints; NULL if any part is none."""
    parts = F.split(s, "/")
    return F.when(F.forall(parts, lambda x: x.rlike(r"^-*[0-9]+$")), F.transform(parts, lambda x: x.try_cast("int")))


def parse_intervals(s: Column, n: Column) -> Column:
    """``lo-hi/lo-hi`` as an array of n structs (lo, hi); malformed and missing parts are NULL."""
    parts = F.split(s, "/")

    def part(i: Column) -> Column:
        p = F.get(parts, i - 1)
        good = p.rlike(r"^[0-9]+-[0-9]+$")
        value = lambda k: F.when(good, F.split_part(p, F.lit("-"), F.lit(k)).try_cast("int"))
        return F.struct(value(1).alias("lo"), value(2).alias("hi"))

    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), part)).otherwise(F.array().cast("array<struct<lo:int,hi:int>>"))


def parse_region(s: Column) -> Column:
    """``chrom:start-end`` as a struct, NULL if it is none."""
    pattern = r"^([^:]+):([0-9]+)-([0-9]+)$"
    take = lambda k: F.regexp_extract(s, pattern, k)
    return F.when(s.rlike(pattern), F.struct(take(1).alias("chrom"), take(2).cast("long").alias("start"), take(3).cast("long").alias("end")))


def counts_total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0), lambda t, e: t + e["n"])


def counts_at(counts: Column, value: Column) -> Column:
    return counts_total(F.filter(counts, lambda e: e["size"] == value))


def counts_above(counts: Column, value: Column) -> Column:
    return counts_total(F.filter(counts, lambda e: e["size"] > value))


def support_fraction(at: Column, total: Column) -> Column:
    return F.try_divide(at.cast("double"), total.cast("double"))


def flanking_share(flanking: Column, spanning: Column) -> Column:
    """flanking / (flanking + spanning), zero without flanking."""
    return F.when(flanking == 0, 0.0).otherwise(F.try_divide(flanking.cast("double"), (flanking + spanning).cast("double")))


def metrics_for(alleles: Column, rank: Column, value: Column) -> Column:
    """The metrics entry of an element: the one with its 1-based number; if that one's size disagrees and there are more
    entries than the rank, one with the right size goes before it; without a numbered one, one with the right size."""
    numbered = F.get(F.filter(alleles, lambda a: a["AlleleNumber"] == rank + 1), F.lit(0))
    sized = F.get(F.filter(alleles, lambda a: a["AlleleSize"] == value), F.lit(0))
    disagrees = numbered["AlleleSize"].isNotNull() & (numbered["AlleleSize"] != value) & (F.size(alleles) > rank)
    return F.when(numbered.isNull(), sized).when(disagrees, F.coalesce(sized, numbered)).otherwise(numbered)


def has_own_metrics(alleles: Column, rank: Column) -> Column:
    return F.coalesce(F.exists(alleles, lambda a: a["AlleleNumber"] == rank + 1), F.lit(False))


def counts_mode(counts: Column) -> Column:
    """(size, n) of the most frequent size, sizes seen once left out unless all are; of equals the first listed."""
    many = F.filter(counts, lambda e: e["n"] >= 2)
    used = F.when(F.size(many) > 0, many).otherwise(counts)
    ranked = F.transform(used, lambda e, i: F.struct(e["n"].alias("n"), (-i).alias("place"), e["size"].alias("size")))
    best = F.array_max(ranked)
    return F.when(F.size(used) > 0, F.struct(best["size"].alias("size"), best["n"].alias("n")))


def sister_value(values: Column, rank: Column) -> Column:
    """The other of two values, the nearest other of more (the first of equals), NULL for one."""
    own = F.get(values, rank)
    apart = F.transform(values, lambda v, i: F.struct(F.abs(v - own).alias("d"), i.alias("i"), v.alias("v")))
    others = F.filter(apart, lambda e: e["i"] != rank)
    return F.when(F.size(values) == 2, F.get(values, 1 - rank)).when(F.size(values) > 2, F.array_min(others)["v"])


def call_ranks(values: Column) -> Column:
    """Ranks to explode: of each value, or 0 and 1 where there is no call."""
    return F.when(values.isNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.sequence(F.lit(0), F.size(values) - 1))


def reference_span(cigar: Column) -> Column:
    """Reference bases that an alignment covers."""
    ops = F.arrays_zip(
        F.transform(F.regexp_extract_all(cigar, F.lit(r"([0-9]+)([MIDNSHP=X])"), F.lit(1)), lambda x: x.cast("int")).alias("n"),
        F.regexp_extract_all(cigar, F.lit(r"([0-9]+)([MIDNSHP=X])"), F.lit(2)).alias("op"),
    )
    return F.aggregate(F.filter(ops, lambda e: e["op"].isin("M", "D", "N", "=", "X")), F.lit(0), lambda t, e: t + e["n"])


def mean_quality(qualities: Column, start: Column, end: Column) -> Column:
    """Mean Phred value of the characters [start, end), half to even; -1 if there are none."""
    part = F.substring(qualities, start + 1, F.greatest(end - start, F.lit(0)))
    values = F.transform(F.split(part, ""), lambda c: F.ascii(c) - 33)
    n = F.length(part)
    return F.when(n > 0, F.rint(F.aggregate(values, F.lit(0), lambda t, v: t + v) / n).cast("int")).otherwise(F.lit(-1))


def parse_measured_reads(s: Column) -> Column:
    """``kind:length:mapq:quality:strand,...`` as an array of structs."""

    def read(x: Column) -> Column:
        p = F.split(x, ":")
        number = lambda k: F.get(p, k).try_cast("int")
        return F.struct(F.get(p, 0).alias("kind"), number(1).alias("length"), number(2).alias("mapq"), number(3).alias("quality"), F.get(p, 4).alias("strand"))

    return F.transform(F.filter(F.split(F.coalesce(s, F.lit("")), ","), lambda x: x != ""), read)
