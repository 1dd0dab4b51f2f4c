"""Bins, rounding, hashes and labels as column expressions.

Missing values are NULL, never NaN: ``known`` turns NaN into NULL, and comparisons with NULL are false where it says so.
Rounding is half to even (``rint``) with negative zero made zero.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tolerance in units by absolute size, as (upper limit, limit included, tolerance).
TOLERANCE_TIERS = ((50, False, 0), (120, True, 1), (270, False, 2), (600, False, 4), (None, False, 8))
DIRECTIONS = ("OK", "TOO_LONG", "TOO_SHORT")
#: Lower edges of the unit-size categories; the first category is below the first edge.
UNIT_CATEGORY_EDGES = (2, 3, 4, 5, 6, 7, 16, 25)
UNIT_CATEGORIES = ("1", "2", "3", "4", "5", "6", "7-15", "16-24", "25+")
#: Inclusive upper edges of the signed difference bins; what is above the last is the open tail.
DIFFERENCE_EDGES = (-31, -26, -21, -19, -17, -15, -13, -11, -9, -7, -5, -3, -1, 0, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 25, 30)
#: Half-open bins of a truth's size, and of a correction factor.
TRUTH_SIZE_EDGES = (20, 50, 100, 200)
TRUTH_SIZE_LABELS = ("0-20", "20-50", "50-100", "100-200", "200+")
FACTOR_EDGES = (0.5, 0.8, 1.25, 2.0, 3.0, 4.0, 5.0)
VALID_PARTITIONS = tuple([str(k) for k in range(1, 23)] + ["X", "Y"])


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """The number, with NaN as NULL."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def numeric(c: Column | str) -> Column:
    """A number from text; what is none is NULL."""
    return known(F.expr(f"try_cast({c} AS double)") if isinstance(c, str) else c.try_cast("double"))


def half_even(c: Column | str) -> Column:
    return F.rint(col(c)) + F.lit(0.0)


def emitted(c: Column | str, digits: int = 3) -> Column:
    """Rounded half to even to so many digits, as values are stored."""
    scale = 10.0**digits
    return F.rint(col(c) * scale) / scale + F.lit(0.0)


def ratio(top: Column, bottom: Column) -> Column:
    """NULL where the denominator is zero."""
    return F.try_divide(top.cast("double"), bottom.cast("double"))


def bin_index(value: Column | str, edges: Sequence[float], side: str = "right") -> Column:
    """Number of edges at or below the value (side right: bins closed below) or strictly below it (left: closed above).

    NULL stays NULL. A chain of comparisons; edges are few."""
    value = col(value)
    if side not in ("left", "right"):
        raise ValueError("side is left or right")
    out = F.lit(None).cast("int")
    inside = F.when(value.isNull(), out)
    for k, edge in enumerate(edges):
        inside = inside.when((value < edge) if side == "right" else (value <= edge), F.lit(k))
    return inside.otherwise(F.lit(len(edges)))


def bin_label(index: Column, labels: Sequence[str]) -> Column:
    return F.get(F.array(*[F.lit(x) for x in labels]), index)


def unit_category(unit: Column | str) -> Column:
    """Category number 0 to 8 of a unit size."""
    return bin_index(unit, UNIT_CATEGORY_EDGES, "right")


def difference_bin(difference: Column | str) -> Column:
    """Signed difference, rounded, in 27 bins with inclusive upper edges and open tails; missing is -1."""
    return F.coalesce(bin_index(half_even(difference), DIFFERENCE_EDGES, "left"), F.lit(-1))


def size_label(value: Column | str, edges: Sequence[float], labels: Sequence[str], unknown: str = "?") -> Column:
    """Label of a half-open size bin; negative or missing sizes are ``unknown``."""
    value = col(value)
    return F.when(value.isNull() | (value < 0), F.lit(unknown)).otherwise(bin_label(bin_index(value, edges), labels))


def bin_with_gaps(value: Column | str, ranges: Sequence[tuple[float, float]]) -> Column:
    """Number of the closed range that holds the value, else -1."""
    out = F.when(col(value).isNull(), F.lit(-1))
    for k, (low, high) in enumerate(ranges):
        out = out.when(col(value).between(low, high), F.lit(k))
    return out.otherwise(F.lit(-1))


def width_bin(value: Column | str, width: float, last: int) -> Column:
    """Lower edge of a bin of fixed width; the last bin is open."""
    return F.least(F.floor(col(value) / width), F.lit(last)) * width


def share_bin(inside: Column, width: Column, steps: int = 5) -> Column:
    """A share rounded up to a step."""
    return F.ceil(steps * inside / width) * width / steps


# Labels


def tolerance(size: Column | str) -> Column:
    """Tolerance in units for an absolute size; NULL size has none."""
    size, out = col(size), None
    for high, closed, units in TOLERANCE_TIERS:
        if high is None:
            return F.when(size.isNull(), F.lit(None).cast("int")).otherwise(out.otherwise(F.lit(units)))
        test = size <= high if closed else size < high
        out = F.when(test, F.lit(units)) if out is None else out.when(test, F.lit(units))
    raise AssertionError


def direction_code(called: Column | str, truth: Column | str, tol: Column) -> Column:
    """0 right within the tolerance, 1 too large, 2 too small, of the difference of the rounded values."""
    off = F.rint(col(called)) - F.rint(col(truth))
    return F.when(off > tol, F.lit(1)).when(off < -tol, F.lit(2)).when(off.isNotNull(), F.lit(0))


def direction_name(code: Column) -> Column:
    return bin_label(code, DIRECTIONS)


def regime_of(branch: Column | str, spanning: Column | str) -> Column:
    """Routing class: quick, or full with or without spanning support (missing support is none)."""
    branch = col(branch)
    return F.when(branch == "quick", F.lit("quick")).when(F.coalesce(col(spanning), F.lit(0)) >= 1, F.lit("full_spanning")).otherwise(F.lit("full_nonspanning"))


def absolute_size(unit: Column | str, value: Column | str) -> Column:
    return col(unit).cast("double") * half_even(value)


def log_ratio(called: Column | str, truth: Column | str) -> Column:
    return F.ln(col(called).cast("double")) - F.ln(col(truth).cast("double"))


def with_labels(df: DataFrame, called: str = "called", truth: str = "truth", unit: str = "unit", branch: str = "branch", spanning: str = "spanning") -> DataFrame:
    """Adds log_ratio, size, tol, dir_code, direction and regime."""
    df = df.withColumns({"log_ratio": log_ratio(called, truth), "size": absolute_size(unit, called), "tol": tolerance(absolute_size(unit, truth))})
    df = df.withColumn("dir_code", direction_code(called, truth, F.col("tol")))
    return df.withColumns({"direction": direction_name(F.col("dir_code")), "regime": regime_of(branch, spanning)})


def gate_fires(p_ok: Column | str, factor: Column | str, threshold: float = 0.5, only: Column | None = None) -> Column:
    """Whether a correction is applied: both known, factor positive, p below the threshold, and ``only`` if given."""
    test = (col(p_ok) < threshold) & (col(factor) > 0)
    return F.coalesce(test if only is None else test & only, F.lit(False))


def corrected(called: Column | str, factor: Column | str, fires: Column) -> Column:
    return F.when(fires, half_even(col(called).cast("double") / F.when(fires, col(factor)))).otherwise(col(called).cast("double"))


def interval_features(called: str = "called", start: str = "ci_start", end: str = "ci_end", width: str = "ci_width") -> dict[str, Column]:
    """Asymmetry and relative width of an interval around a value; zero where a part of the interval is missing, and
    NULL asymmetry where only the value is."""
    v, a, b, w = (numeric(F.col(c)) for c in (called, start, end, width))
    missing = a.isNull() | b.isNull() | w.isNull()
    return {
        "ci_asymmetry": F.when(missing, 0.0).otherwise(ratio((b - v) - (v - a), w + 1)),
        "ci_over_value": F.when(v.isNull() | w.isNull(), 0.0).otherwise(ratio(w, v + 1)),
    }


# Names and keys


def strip_prefix(c: Column | str, prefix: str = "chr") -> Column:
    return F.regexp_replace(col(c), f"^{prefix}", "")


def valid_partition(c: Column | str) -> Column:
    """The first token of a key without its prefix if it is a valid partition, else NULL."""
    token = strip_prefix(F.split_part(col(c), F.lit("-"), F.lit(1)))
    return F.when(token.isin(*VALID_PARTITIONS), token)


def key_parts(c: Column | str) -> Column:
    """``partition-start-end-unit`` as a struct."""
    parts = F.split(col(c), "-")
    number = lambda k: F.get(parts, k).try_cast("long")
    return F.struct(F.get(parts, 0).alias("partition"), number(1).alias("start"), number(2).alias("end"), F.get(parts, 3).alias("unit"))


def family_of(name: Column | str) -> Column:
    """A name without a suffix of depth (_12x) or of derivation (_spiked_3)."""
    return F.regexp_replace(F.regexp_replace(col(name), r"_spiked_[0-9]+$", ""), r"_[0-9]+x$", "")


def is_derived(name: Column | str) -> Column:
    return F.coalesce(col(name).rlike(r"_spiked_[0-9]+$"), F.lit(False))


# Hashes


def hash_fraction(*parts: Column | str) -> Column:
    """CRC32 of the parts joined by bars, as a fraction of 2**32."""
    return F.crc32(F.concat_ws("|", *[col(p) for p in parts]).cast("binary")) / F.lit(4294967296.0)


def sha_fraction(*parts: Column | str) -> Column:
    """The first 8 bytes of a SHA-256 as a fraction of 2**64."""
    word = F.conv(F.substring(F.sha2(F.concat_ws("|", *[col(p) for p in parts]), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return word.cast("double") / F.lit(2.0**64)


def order_hash(seed: int | str | Column, *key: Column | str) -> Column:
    """An order that depends on the seed and the key alone: MD5 in hex, so that any engine can repeat it."""
    return F.md5(F.concat_ws("|", seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed)), *[col(k).cast("string") for k in key]))


def content_digest(row_text: Column) -> Column:
    """Aggregate: a digest of a set of rows that their order does not change."""
    return F.sha2(F.array_join(F.sort_array(F.collect_list(row_text)), "\n"), 256)


#: Digits of a digest's sum and their bits.
DIGITS, DIGIT_BITS = 16, 16


def digest_sums(row_text: Column) -> list[Column]:
    """Aggregates: sums of the 16-bit digits of the rows' SHA-256, the lowest digit first; NULL rows don't count. They merge
    as sums do, so each task sends one row a group, and hold 2**47 rows."""
    h = F.sha2(row_text, 256)
    return [F.coalesce(F.sum(F.conv(F.substring(h, 61 - 4 * k, 4), 16, 10).cast("long")), F.lit(0)) for k in range(DIGITS)]


def multiset_digest(row_text: Column) -> Column:
    """Aggregate: a digest of a multiset of rows, in 64 hex digits: the sum of their SHA-256 modulo 2**256. Order does not
    change it, a repeated row does; no rows give zeros. For tables that aren't built against it: whoever may choose
    rows can make two multisets agree."""
    sums = F.array(*digest_sums(row_text))
    one = F.lit(1 << DIGIT_BITS)
    start = F.struct(F.lit("").alias("hex"), F.lit(0).cast("long").alias("carry"))

    def step(done: Column, s: Column) -> Column:
        whole = s + done["carry"]
        return F.struct(F.concat(F.lpad(F.lower(F.hex(whole % one)), 4, "0"), done["hex"]).alias("hex"), F.shiftright(whole, DIGIT_BITS).alias("carry"))

    return F.aggregate(sums, start, step)["hex"]


def register(spark: SparkSession) -> None:
    """Makes tolerance, direction_code, regime_of, unit_category, bin_index, hash_fraction and motif_family SQL functions."""
    ladder = " ".join(f"WHEN size {'<=' if closed else '<'} {high} THEN {units}" for high, closed, units in TOLERANCE_TIERS if high is not None)
    steps = " ".join(f"WHEN unit < {edge} THEN {k}" for k, edge in enumerate(UNIT_CATEGORY_EDGES))
    bodies = {
        "tolerance(size DOUBLE) RETURNS INT": f"CASE WHEN size IS NULL THEN NULL {ladder} ELSE {TOLERANCE_TIERS[-1][2]} END",
        "direction_code(called DOUBLE, truth DOUBLE, tol INT) RETURNS INT": "CASE WHEN rint(called) - rint(truth) > tol THEN 1 WHEN rint(called) - rint(truth) < -tol THEN 2 WHEN called IS NOT NULL AND truth IS NOT NULL THEN 0 END",
        "regime_of(branch STRING, spanning DOUBLE) RETURNS STRING": "CASE WHEN branch = 'quick' THEN 'quick' WHEN coalesce(spanning, 0) >= 1 THEN 'full_spanning' ELSE 'full_nonspanning' END",
        "unit_category(unit DOUBLE) RETURNS INT": f"CASE WHEN unit IS NULL THEN NULL {steps} ELSE {len(UNIT_CATEGORY_EDGES)} END",
        "bin_index(x DOUBLE, edges ARRAY<DOUBLE>) RETURNS INT": "CASE WHEN x IS NOT NULL THEN size(filter(edges, e -> e <= x)) - 1 END",
        "hash_fraction(a STRING, b STRING) RETURNS DOUBLE": "crc32(cast(concat_ws('|', a, b) AS binary)) / 4294967296D",
        "motif_family(m STRING) RETURNS STRING": "array_min(flatten(transform(array(m, reverse(translate(m, 'ACGTN', 'TGCAN'))), s -> transform(sequence(1, length(s)), i -> concat(substr(s, i), substr(s, 1, i - 1))))))",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
