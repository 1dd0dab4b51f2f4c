"""Containment, overlap and islands of half-open intervals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callquality.operators.ordering import counted_before
from callquality.operators.quantiles import null_safe_join
from callquality.operators.shared import stored

#: Cells that the rows of a partition key are dealt to, for neighbours in position.
CELL_WIDTH = 1 << 20


def inside_disjoint(points: DataFrame, regions: DataFrame, by: str = "chrom", start: str = "start", end: str = "end", out: str = "inside", width: int = 1 << 16) -> DataFrame:
    """Adds whether a row's interval lies in the last of the disjoint regions that starts at or before its start.

    Regions are cut at multiples of ``width``; a row looks in the cell of its start, so the join is on (by, cell) and a
    hot ``by`` is spread over its cells. Rows stay as they are, also repeated ones and those with NULLs (not inside).
    """
    cells = F.sequence(F.floor(F.col(start) / width), F.floor(F.greatest(F.col(end) - 1, F.col(start)) / width))
    r = regions.filter(F.col(start) < F.col(end)).select(F.col(by).alias("_by"), F.col(start).alias("_low"), F.col(end).alias("_high"), F.explode(cells).alias("_cell"))
    p = points.withColumn("_at", F.floor(F.col(start) / width))
    hit = (F.col(by) == F.col("_by")) & (F.col("_at") == F.col("_cell")) & (F.col("_low") <= F.col(start)) & (F.col(start) < F.col("_high"))
    return p.join(r, hit, "left").withColumn(out, F.coalesce(F.col(end) <= F.col("_high"), F.lit(False))).drop("_at", "_by", "_low", "_high", "_cell")


#: Each level of nested cells is so many times as wide as the one below; levels that positions need at most.
NEST, LEVELS = 16, 8


def _nested(start: Column, end: Column, width: int) -> Column:
    """The nested cells (level, cell) that cover [start, end) exactly on their level, the cells of the lowest level but in
    part: at most 2 * (NEST - 1) a level, so their number grows with the logarithm of the length."""
    first, after = F.floor(start / width).cast("long"), F.floor(F.greatest(end - 1, start) / width).cast("long") + 1

    def on(level: int, cells: Column) -> Column:
        return F.transform(cells, lambda c: F.struct(F.lit(level).alias("level"), c.alias("cell")))

    def cells(a: Column, z: Column) -> Column:
        return F.when(a < z, F.sequence(a, z - 1)).otherwise(F.array().cast("array<bigint>"))

    inside = [(F.ceil(first / NEST**k).cast("long"), F.floor(after / NEST**k).cast("long")) for k in range(LEVELS + 1)]
    parts = []
    for level, ((a, z), (up_a, up_z)) in enumerate(zip(inside, inside[1:], strict=False)):  # whole cells, but for those of whole parents
        own = F.when(up_a < up_z, F.concat(cells(a, up_a * NEST), cells(up_z * NEST, z))).otherwise(cells(a, z))
        parts.append(on(level, own))
    return F.concat(*parts)


def stabbed(points: DataFrame, spans: DataFrame, by: str, at: Column, s_by: str, start: Column, end: Column, width: int = 1 << 14) -> DataFrame:
    """Pairs of a point and the spans [start, end) that hold it, with all columns of both.

    A span is in few nested cells, whatever its length; a point looks in its cell of each level that spans are on."""
    s = stored(spans.withColumn("_nested", F.explode(_nested(start, end, width))).select("*", F.col("_nested.level").alias("_slevel"), F.col("_nested.cell").alias("_scell")).drop("_nested"), "spans")
    levels = sorted(r["_slevel"] for r in s.select("_slevel").distinct().collect())
    cells = [F.struct(F.lit(k).alias("level"), F.floor(at / (width * NEST**k)).cast("long").alias("cell")) for k in levels]
    p = points.withColumn("_cell", F.explode(F.array(*cells) if cells else F.array().cast("array<struct<level:int,cell:bigint>>")))
    meet = (F.col(by) == F.col(s_by)) & (F.col("_cell.level") == F.col("_slevel")) & (F.col("_cell.cell") == F.col("_scell")) & (start <= at) & (at < end)
    return p.join(s, meet).drop("_cell", "_slevel", "_scell")


def overlap_join(left: DataFrame, right: DataFrame, by: str = "chrom", start: str = "start", end: str = "end", pad: int = 0, width: int = 1 << 14, how: str = "inner") -> DataFrame:
    """Pairs of rows whose intervals overlap, the left one padded; the right columns get the prefix ``r_``.

    Of two intervals that overlap, the later one's start lies in the other: so a pair comes out once, and the starts of
    either side look for the intervals of the other in nested cells (``stabbed``). Intervals that hold nothing meet those
    that hold their place inside. ``how`` left keeps left rows without partner, semi and anti keep left rows only, and
    find them by counts, without pairs.
    """
    if how == "semi" or how == "anti":
        # Rows with one interval share their fate, so intervals are the key.
        spans = stored(left.select(by, start, end).distinct(), "spans")
        met = _overlap_counts(spans, right, by, start, end, pad).filter("_n > 0").select(by, start, end)
        return left.join(met, [by, start, end], f"left_{how}").select(*left.columns)
    low, high = F.col(start) - pad, F.col(end) + pad
    r_low, r_high = F.col(f"r_{start}"), F.col(f"r_{end}")
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    inside = (low < r_high) & (r_low < high)
    later = stabbed(r, left, f"r_{by}", r_low, by, low, high, width).filter(inside & (r_low > low))
    earlier = stabbed(left, r, by, low, f"r_{by}", r_low, r_high, width).filter(inside)
    names = [*left.columns, *r.columns]
    pairs = later.select(*names).unionByName(earlier.select(*names))
    if how == "left":
        lonely = overlap_join(left, right, by, start, end, pad, width, "anti")
        return pairs.unionByName(lonely, allowMissingColumns=True)
    return pairs


def _overlap_counts(spans: DataFrame, right: DataFrame, by: str, start: str, end: str, pad: int) -> DataFrame:
    """The distinct ``spans`` (by, start, end) with ``_n``, the right intervals that overlap: those that start before the
    end, less those that end by the start. Counted along both orders, so neither length nor pile-ups make pairs."""
    low, high = F.col(start) - pad, F.col(end) + pad
    kind = F.col(start).isNotNull() & F.col(end).isNotNull() & (F.col(start) <= F.col(end)) & F.col(by).isNotNull()
    empty = (F.col(start) == F.col(end)).cast("int")
    ends = lambda at, sign: F.struct(at.cast("double").alias("_at"), F.lit(sign).alias("_sign"))
    r = right.filter(kind).select(F.lit(True).alias("_point"), F.col(by).alias("_by"), F.explode(F.array(ends(F.col(start), 1), ends(F.col(end), -1))).alias("_e"), empty.alias("_kind"), *[F.lit(None).cast(spans.schema[c].dataType).alias(c) for c in (start, end)])
    # An interval that holds nothing overlaps none of its like, so it asks for the others (kind 0) only.
    asked = F.when(low < high, 2).otherwise(1)
    l = spans.filter(kind).select(F.lit(False).alias("_point"), F.col(by).alias("_by"), F.explode(F.array(ends(high, 1), ends(low, -1))).alias("_e"), asked.alias("_kind"), start, end)  # noqa: E741
    events = r.unionByName(l).select("_point", "_by", "_e.*", "_kind", start, end)
    # before the end: starts < high; by the start: ends <= low, so those points come first
    turn = F.when(F.col("_sign") == 1, F.col("_point").cast("int")).otherwise((~F.col("_point")).cast("int"))
    counted = counted_before(events.withColumn("_turn", turn), ["_by", "_sign"], ["_at", "_turn"], F.col("_point"), "_count", F.col("_kind"), F.col("_kind"), fan=2)
    found = counted.filter("NOT _point").groupBy(F.col("_by").alias(by), start, end).agg(F.sum(F.col("_sign") * F.col("_count")).alias("_n"))
    return found


def overlap_length(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    return F.greatest(F.lit(0), F.least(end, other_end) - F.greatest(start, other_start))


def best_overlap(left: DataFrame, right: DataFrame, key: str, prefer: Column, right_order: str, by: str = "chrom", start: str = "start", end: str = "end", same: Column | None = None) -> DataFrame:
    """For each left key the partner with ``prefer`` first, then the largest overlap, then the first in order."""
    pairs = overlap_join(left, right, by, start, end)
    if same is not None:
        pairs = pairs.filter(same)
    size = overlap_length(F.col(start), F.col(end), F.col(f"r_{start}"), F.col(f"r_{end}"))
    order = W.partitionBy(key).orderBy(F.coalesce(prefer, F.lit(False)).desc(), size.desc(), F.col(f"r_{right_order}"))
    return pairs.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def overlap_summary(left: DataFrame, right: DataFrame, key: str, name: str, low: str, high: str, by: str = "chrom", start: str = "start", end: str = "end") -> DataFrame:
    """Per left row: the overlapping names joined, the smallest ``low`` and the largest ``high``; NULL without partner."""
    pairs = overlap_join(left, right, by, start, end)
    found = pairs.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list(f"r_{name}")), ",").alias("names"), F.min(f"r_{low}").alias("lowest"), F.max(f"r_{high}").alias("highest"))
    return left.join(found, key, "left")


def count_overlaps(left: DataFrame, right: DataFrame, key: str, by: str = "chrom", start: str = "start", end: str = "end", pad: int = 0) -> DataFrame:
    """Number of overlapping right rows of each left row, zero included; no pairs are formed."""
    spans = left.select(by, start, end).distinct()
    found = _overlap_counts(spans, right.select(by, start, end), by, start, end, pad)
    return null_safe_join(left, found, [by, start, end], "left").withColumn("n_overlaps", F.coalesce("_n", F.lit(0))).select(*left.columns, "n_overlaps")


def _with_cells(rows: DataFrame, per_cell: DataFrame) -> DataFrame:
    c = per_cell.withColumnsRenamed({"_by": "_cby", "_at": "_cat"})
    return rows.join(c, F.col("_by").eqNullSafe(F.col("_cby")) & F.col("_at").eqNullSafe(F.col("_cat")), "left").drop("_cby", "_cat")


def _dealt(df: DataFrame, by: str, start: str, width: int) -> DataFrame:
    """Adds the cell (_by, _at) of each row."""
    return df.withColumns({"_by": F.col(by), "_at": F.floor(F.col(start) / width)})


def _with_previous(dealt: DataFrame, value: Column, order: Sequence[str], name: str) -> DataFrame:
    """Adds the value of the row before within ``_by``: inside the cell, or the last of the cell with rows before it."""
    cells, inside = W.partitionBy("_by").orderBy("_at"), W.partitionBy("_by", "_at").orderBy(*order)
    lasts = dealt.groupBy("_by", "_at").agg(F.max_by(value, F.struct(*order)).alias("_last"))
    carried = _with_cells(dealt, lasts.select("_by", "_at", F.lag("_last").over(cells).alias("_before")))
    return carried.withColumn(name, F.when(F.row_number().over(inside) == 1, F.col("_before")).otherwise(F.lag(value).over(inside))).drop("_before")


def islands(df: DataFrame, by: str = "chrom", start: str = "start", end: str = "end", gap: float = 0, key: str | None = None, width: int = CELL_WIDTH) -> DataFrame:
    """Adds ``island``, from 1 in each ``by``: a row that starts ``gap`` or more behind the end of the row before it opens one.

    Order is (start, end, key). Rows are dealt by cells of ``width``, so a hot ``by`` is spread; what a cell takes over
    from those before it (the last end, the islands so far) comes from one row a cell.
    """
    order, cells = [start, end, *([key] if key else [])], W.partitionBy("_by").orderBy("_at")
    told = _with_previous(stored(_dealt(df, by, start, width), "islands"), F.col(end), order, "_previous")
    marked = told.withColumn("_new", F.coalesce((F.col(start) - F.col("_previous") >= gap).cast("int"), F.lit(1))).drop("_previous")
    marked = stored(marked, "islands")
    counts = marked.groupBy("_by", "_at").agg(F.sum("_new").alias("_n"))
    so_far = F.coalesce(F.sum("_n").over(cells.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    based = _with_cells(marked, counts.select("_by", "_at", so_far.alias("_base")))
    inside = W.partitionBy("_by", "_at").orderBy(*order)
    return based.withColumn("island", F.col("_base") + F.sum("_new").over(inside.rowsBetween(W.unboundedPreceding, 0))).drop("_by", "_at", "_new", "_base")


def first_of_island(df: DataFrame, by: str = "chrom", start: str = "start", end: str = "end", gap: float = 0, key: str | None = None) -> DataFrame:
    """The first row of each island, found by a partial aggregation, so that a long island needs no task of its own."""
    told = islands(df, by, start, end, gap, key)
    first = F.min_by(F.struct(*told.columns), F.struct(start, end, *([key] if key else [])))
    return told.groupBy(F.col(by).alias("_by"), F.col("island").alias("_island")).agg(first.alias("_row")).select("_row.*")


def padded_regions(df: DataFrame, pad: int, start: str = "start", end: str = "end") -> DataFrame:
    return df.withColumn(start, F.greatest(F.lit(0), F.col(start) - pad)).withColumn(end, F.col(end) + pad)


def start_rate(events: DataFrame, windows: DataFrame, by: str = "chrom", at: str = "start", start: str = "start", end: str = "end") -> DataFrame:
    """Events that start inside windows, per unit of window length."""
    points = events.select(F.col(by).alias(by), F.col(at).alias(start), (F.col(at) + 1).alias(end))
    inside = overlap_join(points, windows.select(by, start, end), by, start, end).agg(F.count("*").alias("n"))
    total = windows.agg(F.sum(F.col(end) - F.col(start)).alias("width"))
    return inside.crossJoin(total).select("n", "width", F.try_divide(F.col("n").cast("double"), F.col("width").cast("double")).alias("rate"))


def pairs_within(windows: DataFrame, reads: DataFrame, window: str, name: str, by: str = "chrom", at: str = "start", start: str = "start", end: str = "end") -> DataFrame:
    """(window, name) of read pairs both of whose mates start in the window; ``reads`` has one row a mate."""
    points = reads.select(name, F.col(by).alias(by), F.col(at).alias(start), (F.col(at) + 1).alias(end))
    met = overlap_join(points, windows.select(window, by, start, end), by, start, end)
    inside = met.groupBy(F.col(f"r_{window}").alias(window), name).agg(F.count("*").alias("here"))
    mates = reads.groupBy(name).agg(F.count("*").alias("mates"))
    return inside.join(mates, name).filter("here = 2 AND mates = 2").select(window, name)


def proximity_edges(df: DataFrame, key: str, by: str = "chrom", start: str = "start", end: str = "end", gap: float = 0, same: str | None = None, width: int = CELL_WIDTH) -> DataFrame:
    """Edges between neighbours in position closer than ``gap``, and from each row to the smallest key with its ``same``.

    Rows are dealt by cells of ``width``, as in ``islands``."""
    told = _with_previous(_dealt(df, by, start, width), F.struct(F.col(key).alias("b"), F.col(end).alias("end")), [start, end, key], "_previous")
    near = told.filter(F.col("_previous")["b"].isNotNull() & (F.col(start) - F.col("_previous")["end"] < gap)).select(F.col(key).alias("a"), F.col("_previous")["b"].alias("b"))
    if same is None:
        return near
    first = df.groupBy(same).agg(F.min(key).alias("b"))
    return near.unionByName(df.join(first, same).select(F.col(key).alias("a"), "b").filter("a <> b"))
