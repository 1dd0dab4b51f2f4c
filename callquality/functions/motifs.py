"""Unit strings: rotations, canonical form, distances, purity and tilings, as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPLEMENT = ("ACGTN", "TGCAN")


def reverse_complement(m: Column) -> Column:
    return F.reverse(F.translate(m, *COMPLEMENT))


def rotations(m: Column) -> Column:
    """All rotations; the empty string has itself."""
    turned = F.transform(F.sequence(F.lit(1), F.greatest(F.length(m), F.lit(1))), lambda i: F.concat(F.substring(m, i, F.length(m)), F.substring(m, F.lit(1), i - 1)))
    return F.when(m.isNotNull(), turned)


def motif_family(m: Column) -> Column:
    """The smallest rotation of the unit and of its reverse complement."""
    return F.array_min(F.concat(rotations(m), rotations(reverse_complement(m))))


def mismatches(a: Column, b: Column) -> Column:
    """Places at which two strings of one length differ; N fits all."""
    place = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)))

    def differ(i: Column) -> Column:
        x, y = F.substring(a, i, F.lit(1)), F.substring(b, i, F.lit(1))
        return (x != y) & (x != "N") & (y != "N")

    return F.size(F.filter(place, differ))


def motif_distance(a: Column, b: Column) -> Column:
    """Fewest mismatches over the rotations of b; NULL for different lengths."""
    return F.when(F.length(a) == F.length(b), F.array_min(F.transform(rotations(b), lambda r: mismatches(a, r))))


def motifs_match(a: Column, b: Column) -> Column:
    """Whether the units are rotations of each other on either strand."""
    return F.coalesce((motif_distance(a, b) == 0) | (motif_distance(a, reverse_complement(b)) == 0), F.lit(False))


def nearer_strand(motif: Column, reference: Column) -> Column:
    """The unit or its reverse complement, whichever is nearer to the reference unit; ties keep the unit."""
    there, back = motif_distance(motif, reference), motif_distance(reverse_complement(motif), reference)
    return F.when(back < there, reverse_complement(motif)).otherwise(motif)


def gc_share(m: Column) -> Column:
    """Share of G and C, with N as half."""
    n = F.length(m)
    gc, half = n - F.length(F.translate(m, "GC", "")), n - F.length(F.translate(m, "N", ""))
    return F.try_divide(gc + half / 2, n)


#: Bins of the share of G and C.
GC_BINS = ("0", "<=1/3", "<=2/3", ">2/3")


def gc_bin(m: Column) -> Column:
    share = gc_share(m)
    third = 1e-12
    return F.when(share == 0, GC_BINS[0]).when(share <= 1 / 3 + third, GC_BINS[1]).when(share <= 2 / 3 + third, GC_BINS[2]).when(share.isNotNull(), GC_BINS[3])


def tiled(unit: Column, n: Column) -> Column:
    """The first n characters of the endless repetition of a unit."""
    return F.substring(F.repeat(unit, (n / F.greatest(F.length(unit), F.lit(1))).cast("int") + 1), F.lit(1), n)


def is_motif_run(seq: Column, unit: Column) -> Column:
    """Whether a string is the unit repeated, in any phase."""
    return F.exists(rotations(unit), lambda r: tiled(r, F.length(seq)) == seq)


def purity(seq: Column, unit: Column) -> Column:
    """Share of places that agree with the best-fitting phase of the repeated unit; N never agrees."""
    n = F.length(seq)

    def agree(r: Column) -> Column:
        want = tiled(r, n)
        return F.size(F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (F.substring(seq, i, F.lit(1)) == F.substring(want, i, F.lit(1))) & (F.substring(seq, i, F.lit(1)) != "N")))

    return F.when(n > 0, F.array_max(F.transform(rotations(unit), agree)) / n)


def blocks_purity(blocks: Column) -> Column:
    """Purity of an array of (seq, unit), weighted by length."""
    top = F.aggregate(blocks, F.lit(0.0), lambda t, b: t + F.coalesce(purity(b["seq"], b["unit"]) * F.length(b["seq"]), F.lit(0.0)))
    return F.try_divide(top, F.aggregate(blocks, F.lit(0.0), lambda t, b: t + F.coalesce(F.length(b["seq"]).cast("double"), F.lit(0.0))))


#: Sizes that are always tried.
FIXED_SIZES = (150, 225, 300, 450, 600, 900, 1500, 3000, 4500, 6000, 9000, 12000, 18000, 24000)


def reported_sizes(low: Column, high: Column, unit: Column, fixed: tuple[int, ...] = FIXED_SIZES) -> Column:
    """Sizes from the smallest and the largest reported, in whole units: the smallest; the largest if below the last
    fixed size; their middle, with the largest at most the first fixed size, if the smallest is below that."""
    whole = lambda x: F.rint(x / unit).cast("long") * unit.cast("long")
    middle = F.when(low < fixed[0], whole((low + F.least(high, F.lit(fixed[0]))) / 2))
    found = F.array(whole(low), F.when(high < fixed[-1], whole(high)), middle)
    return F.when(low.isNull() | high.isNull(), F.array().cast("array<bigint>")).otherwise(F.array_sort(F.array_distinct(F.array_compact(found))))


def sizes_to_try(own_units: Column, low: Column, high: Column, unit: Column, fixed: tuple[int, ...] = FIXED_SIZES) -> Column:
    """Fixed sizes up to the largest reported, and the reported ones, in whole units rounded down, above the own value."""
    candidates = F.concat(F.filter(F.array(*[F.lit(x).cast("long") for x in fixed]), lambda x: x <= F.coalesce(high, F.lit(-1))), reported_sizes(low, high, unit, fixed))
    copies = F.array_sort(F.array_distinct(F.transform(candidates, lambda x: F.floor(x / unit))))
    return F.transform(F.filter(copies, lambda n: n > own_units), lambda n: n * unit.cast("long"))
