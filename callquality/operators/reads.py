"""Measuring repeat lengths in reads: unique flanks, spanning and bound reads, summaries per locus.

Spark finds which reads meet which loci (an overlap join by bins) and spreads the pairs; a task measures whole Arrow batches
of them at once (``flanks``). ``loci`` has locus_id, chrom, start, end, motif, window_start, window_seq; ``reads`` has name, flag, chrom,
start, end, mapq, cigar, seq, qual (0-based, end from ``parse.reference_span``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callquality.functions.parse import reference_span
from callquality.operators.flanks import FLANK, INNER, Alignments, Texts, blocks, joints, near_places, repeats, unique_in_windows
from callquality.operators.intervals import overlap_join

#: How far an alignment may be off, how far from a locus reads are looked at, what counts as a low mapping
#: quality, and the least end of a one-sided read that must repeat the motif.
ALIGNED_WITHIN, PAD, LOW_MAPQ, LEAST_END = 10, 20, 20, 8


def unique_flanks(window_seq: str | None, window_start: int, start: int, end: int) -> bool:
    """Whether both flanks are whole, without N, and occur once in the window."""
    return bool(unique_in_windows(Texts.of(pa.array([window_seq], pa.string())), np.array([start - window_start]), np.array([end - window_start]))[0])


def _anchors(seqs: Texts, flanks: np.ndarray, inner: slice, fine: np.ndarray, aligned: Alignments, want: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number, place) of the flank in each read: near matches, exact in the part beside the repeat, the first aligned base
    of which is aligned near its place; without an aligned base the place is unknown and counts."""
    rows, places, differ = near_places(seqs, flanks, fine)
    known, skip, place = aligned.first_aligned(seqs.at[rows] + places)
    kept = ~differ[:, inner].any(axis=1) & (~known | (np.abs(place - want[rows] - skip) <= ALIGNED_WITHIN))
    number, at = np.bincount(rows[kept], minlength=len(seqs)), np.zeros(len(seqs), np.int64)
    at[rows[kept]] = places[kept]
    return number, at


def measured_batch(seq: Texts, qual: Texts, start: np.ndarray, cigar: Texts, left: Texts, right: Texts, motif: Texts, locus_start: np.ndarray, locus_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, kind, length, mean quality) of the rows, each a read at a locus, that measure it: spanning, or bound by the left
    or right flank.

    A read with two places for a flank is not measured, nor one whose CIGAR does not fit its bases, nor a locus without
    motif or whole flanks. A one-sided read runs to its end, without what there may belong to the other flank, and the last
    bases of that must repeat the motif (at least eight, and two motifs); it counts for nothing if its alignment covers the
    other flank. The quality is -1 where there is none."""
    aligned, n = Alignments(cigar, start, seq), seq.sizes
    fine = aligned.fits & (motif.sizes > 0) & (left.sizes == FLANK) & (right.sizes == FLANK)
    lefts, rights = np.zeros((len(seq), FLANK), np.uint8), np.zeros((len(seq), FLANK), np.uint8)
    whole = np.flatnonzero(fine)
    lefts[whole], rights[whole] = left.parts(whole, 0, FLANK), right.parts(whole, 0, FLANK)
    n_a, a = _anchors(seq, lefts, slice(FLANK - INNER, FLANK), fine, aligned, locus_start - FLANK)
    n_b, b = _anchors(seq, rights, slice(0, INNER), fine, aligned, locus_end)
    fine &= (n_a <= 1) & (n_b <= 1)
    low, high = np.where(n_a == 1, a + FLANK, 0), np.where(n_b == 1, b, n)
    only_left, only_right = np.flatnonzero(fine & (n_a == 1) & (n_b == 0)), np.flatnonzero(fine & (n_a == 0) & (n_b == 1))
    high[only_left] -= joints(seq.parts(only_left, n[only_left] - FLANK, FLANK), rights[only_left], (n - low)[only_left])
    low[only_right] += joints(lefts[only_right], seq.parts(only_right, np.zeros_like(only_right), FLANK), high[only_right])
    least = np.maximum(LEAST_END, 2 * motif.sizes)
    kind = np.full(len(seq), "", object)
    kind[fine & (n_a == 1) & (n_b == 1) & (low <= high)] = "spanning"
    free = {"left": aligned.ends < locus_end + FLANK, "right": start > locus_start - FLANK}
    for name, rows in (("left", only_left), ("right", only_right)):
        rows = rows[((high - low >= least) & free[name])[rows]]
        checked = (high - least if name == "left" else low)[rows]
        kind[rows[repeats(seq, rows, checked, least[rows], motif)]] = name
    kept = np.flatnonzero(kind != "")
    low, high = low[kept], high[kept]
    known, lone = qual.sizes, np.flatnonzero(qual.sizes == 1)
    known[lone[qual.parts(lone, 0, 1)[:, 0] == ord("*")]] = 0
    known, sums = known[kept], np.concatenate([[0], np.cumsum(qual.data.astype(np.int64) - 33)])
    first, last = np.minimum(low, known), np.minimum(high, known)
    total = sums[qual.at[kept] + last] - sums[qual.at[kept] + first]
    return kept, kind[kept], high - low, np.where(last <= first, -1, np.rint(total / np.maximum(last - first, 1))).astype(np.int64)


def measured(seq: str, qual: str, start: int, cigar: str, left: str, right: str, motif: str, locus_start: int, locus_end: int) -> tuple[str, int, int] | None:
    """(kind, length, mean quality) of one read at one locus, or None: ``measured_batch`` of one row."""
    texts, numbers = (lambda x: Texts.of(pa.array([x], pa.string()))), (lambda x: np.array([x], np.int64))
    row, kind, length, quality = measured_batch(texts(seq), texts(qual), numbers(start), texts(cigar), texts(left), texts(right), texts(motif), numbers(locus_start), numbers(locus_end))
    return (str(kind[0]), int(length[0]), int(quality[0])) if len(row) else None


def flank_table(loci: DataFrame) -> DataFrame:
    """Adds left and right flanks and ``has_unique_flanks``."""
    low, high = F.col("start") - F.col("window_start"), F.col("end") - F.col("window_start")

    @F.arrow_udf("boolean")
    def unique(seq: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
        place = lambda x: x.cast(pa.int64()).fill_null(-1).to_numpy(zero_copy_only=False)
        return pa.array(unique_in_windows(Texts.of(seq), place(low), place(high)))

    return loci.withColumns({
        "left_flank": F.substring("window_seq", low - FLANK + 1, F.lit(FLANK)), "right_flank": F.substring("window_seq", high + 1, F.lit(FLANK)),
        "has_unique_flanks": unique("window_seq", low.cast("long"), high.cast("long")),
    })


def with_ends(reads: DataFrame) -> DataFrame:
    return reads.withColumn("end", F.col("start") + reference_span(F.col("cigar")))


def measure_reads(reads: DataFrame, loci: DataFrame) -> DataFrame:
    """(locus_id, kind, length, mapq, quality, strand, name) of the reads, of any mapping quality, that measure a locus
    with unique flanks."""
    known = flank_table(loci).filter("has_unique_flanks").select("locus_id", "chrom", "start", "end", "motif", "left_flank", "right_flank")
    good = with_ends(reads).filter((F.col("cigar") != "*") & (F.col("seq") != "*"))
    pairs = overlap_join(known, good, pad=PAD)
    wanted = pairs.select("locus_id", "motif", "left_flank", "right_flank", "start", "end", "r_name", "r_flag", "r_start", "r_cigar", "r_mapq", "r_seq", "r_qual")

    def run(batches):
        for batch in batches:
            texts = {c: Texts.of(batch.column(c)) for c in ("motif", "left_flank", "right_flank", "r_cigar", "r_seq", "r_qual")}
            numbers = {c: batch.column(c).cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in ("start", "end", "r_start", "r_flag")}
            for first, last in blocks(texts["r_seq"].sizes):
                t, x = {c: v.rows(first, last) for c, v in texts.items()}, {c: v[first:last] for c, v in numbers.items()}
                rows, kind, length, quality = measured_batch(t["r_seq"], t["r_qual"], x["r_start"], t["r_cigar"], t["left_flank"], t["right_flank"], t["motif"], x["start"], x["end"])
                kept = batch.slice(first, last - first).take(pa.array(rows))
                strand = np.where(x["r_flag"][rows] & 16, "-", "+")
                out = {"locus_id": kept["locus_id"], "kind": kind, "length": length, "mapq": kept["r_mapq"], "quality": quality, "strand": strand, "name": kept["r_name"]}
                kinds = {"length": pa.int32(), "mapq": pa.int32(), "quality": pa.int32()}
                yield pa.RecordBatch.from_pydict({c: pa.array(v, kinds.get(c, pa.string())) if isinstance(v, np.ndarray) else v.cast(kinds.get(c, pa.string())) for c, v in out.items()})

    return wanted.mapInArrow(run, "locus_id string, kind string, length int, mapq int, quality int, strand string, name string")


def locus_summary(loci: DataFrame, reads: DataFrame, measures: DataFrame) -> DataFrame:
    """Per locus, those without reads included: overlapping reads, low-quality ones, and the packed measurements."""
    met = overlap_join(loci.select("locus_id", "chrom", "start", "end"), with_ends(reads).select("chrom", "start", "end", "mapq"), pad=PAD)
    counts = met.groupBy("locus_id").agg(F.count("*").alias("n_reads_overlapping"), F.count_if(F.col("r_mapq") < LOW_MAPQ).alias("n_reads_mapq_below_20"))
    text = F.concat_ws(":", "kind", "length", "mapq", "quality", "strand")
    packed = measures.groupBy("locus_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", text.alias("t")))), lambda x: x["t"]), ",").alias("measured_reads"))
    return loci.select("locus_id").join(counts, "locus_id", "left").join(packed, "locus_id", "left").na.fill(0).na.fill("")


#: Fixed values of the read profile: flags left out (unmapped, secondary, failed, duplicate, supplementary), the longest
#: fragment, the low base quality, and how cycles are binned.
LEFT_OUT_FLAGS, LONGEST_FRAGMENT, LOW_QUALITY, CYCLE_BIN, LAST_CYCLE_BIN = 0xF04, 1500, 20, 30, 4


def profiled_reads(reads: DataFrame) -> DataFrame:
    """Paired reads with qualities that no flag leaves out, with ``length``."""
    flag = F.col("flag")
    fine = (flag.bitwiseAND(F.lit(LEFT_OUT_FLAGS)) == 0) & (flag.bitwiseAND(F.lit(1)) != 0) & (F.col("qual") != "*")
    return reads.filter(fine).withColumn("length", F.length("seq"))


def read_profile(reads: DataFrame) -> DataFrame:
    """Most common read length (the shortest of equals), and the mean quality and number of reads of that length."""
    n = F.length("seq")
    mode = reads.groupBy(n.alias("length")).agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "length").limit(1)
    q = F.aggregate(F.transform(F.split("qual", ""), lambda c: F.ascii(c) - 33), F.lit(0), lambda a, x: a + x) / F.length("qual")
    return reads.withColumn("length", n).join(F.broadcast(mode.select("length")), "length").groupBy("length").agg(F.count("*").alias("n_reads"), F.avg(q).alias("mean_quality"))


def _modal_length(kept: DataFrame) -> DataFrame:
    """The most common length, one row."""
    return F.broadcast(kept.groupBy("length").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "length").limit(1).select(F.col("length").alias("_mode")))


def fragment_lengths(reads: DataFrame) -> DataFrame:
    """(fragment, n): how many properly paired first mates have that template length, from the most common read length up
    to ``LONGEST_FRAGMENT``. A histogram in place of the list, so its size has a bound."""
    kept = profiled_reads(reads)
    flag, fragment = F.col("flag"), F.abs("tlen")
    first = kept.filter((flag.bitwiseAND(F.lit(2)) != 0) & (flag.bitwiseAND(F.lit(64)) != 0)).select(fragment.alias("fragment"))
    return first.join(_modal_length(kept), F.col("fragment") >= F.col("_mode")).filter(F.col("fragment").between(1, LONGEST_FRAGMENT)).groupBy("fragment").agg(F.count("*").alias("n"))


def cycle_qualities(reads: DataFrame) -> DataFrame:
    """(first_mate, cycle_bin, n, low_share, mean_quality) of the reads of the most common length, by cycle in sequencing
    order (a reverse read's string is turned round)."""
    kept = profiled_reads(reads)
    text = F.when(F.col("flag").bitwiseAND(F.lit(16)) != 0, F.reverse("qual")).otherwise(F.col("qual"))
    each = kept.join(_modal_length(kept), F.col("length") == F.col("_mode")).select((F.col("flag").bitwiseAND(F.lit(64)) != 0).alias("first_mate"), F.posexplode(F.split(text, "")).alias("cycle", "c"))
    q = F.ascii("c") - 33
    at = F.least(F.floor(F.col("cycle") / CYCLE_BIN), F.lit(LAST_CYCLE_BIN)).cast("int")
    return each.filter("c <> ''").groupBy("first_mate", at.alias("cycle_bin")).agg(F.count("*").alias("n"), F.avg((q < LOW_QUALITY).cast("double")).alias("low_share"), F.avg(q).alias("mean_quality"))
