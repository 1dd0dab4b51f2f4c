import pytest
from pyspark.sql import functions as F

from callquality.functions import exprs as E
from callquality.functions import motifs as M
from callquality.functions import parse as P


def values(spark, schema, rows, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_tolerance_tiers(spark):
    got = values(spark, "s double", [(49.9,), (50.0,), (120.0,), (120.5,), (269.0,), (270.0,), (599.0,), (600.0,), (None,)], E.tolerance("s"))
    assert [g[0] for g in got] == [0, 1, 1, 2, 2, 4, 4, 8, None]


def test_direction_and_routing(spark):
    rows = [(12.5, 12.0, 0), (14.0, 12.0, 1), (9.0, 12.0, 2), (None, 1.0, 0)]
    assert [g[0] for g in values(spark, "c double, t double, tol int", rows, E.direction_code("c", "t", F.col("tol")))] == [0, 1, 2, None]
    rows = [("quick", 0), ("full", 1), ("full", 0), ("full", None)]
    assert [g[0] for g in values(spark, "b string, s int", rows, E.regime_of("b", "s"))] == ["quick", "full_spanning", "full_nonspanning", "full_nonspanning"]


def test_rounding_is_half_even_without_negative_zero(spark):
    got = values(spark, "x double", [(2.5,), (-0.4,), (3.5,), (0.0005,)], E.half_even("x"), E.emitted("x"))
    assert [g[0] for g in got] == [2.0, 0.0, 4.0, 0.0] and str(got[1][0]) == "0.0" and got[3][1] == 0.0


def test_bins(spark):
    rows = [(0.0,), (1.0,), (6.0,), (7.0,), (15.0,), (16.0,), (24.0,), (25.0,), (None,)]
    assert [g[0] for g in values(spark, "x double", rows, E.unit_category("x"))] == [0, 0, 5, 6, 6, 7, 7, 8, None]
    rows = [(-40.0,), (-31.0,), (-30.0,), (0.0,), (0.5,), (1.0,), (30.0,), (31.0,), (None,)]
    assert [g[0] for g in values(spark, "x double", rows, E.difference_bin("x"))] == [0, 0, 1, 13, 13, 14, 25, 26, -1]
    assert [g[0] for g in values(spark, "x double", [(-1.0,), (0.0,), (20.0,), (250.0,)], E.size_label("x", E.TRUTH_SIZE_EDGES, E.TRUTH_SIZE_LABELS))] == ["?", "0-20", "20-50", "200+"]
    assert [g[0] for g in values(spark, "x double", [(1.0,), (9.0,)], E.bin_with_gaps("x", [(1, 1), (2, 6)]))] == [0, -1]
    with pytest.raises(ValueError):
        E.bin_index("x", [1], "middle")


def test_interval_features(spark):
    rows = [("10", "8", "14", "6"), ("x", "8", "14", "6"), ("10", None, "14", "6")]
    got = [tuple(r) for r in spark.createDataFrame(rows, "called string, ci_start string, ci_end string, ci_width string").select(*E.interval_features().values()).collect()]
    assert got[0] == (2 / 7, 6 / 11) and got[1] == (None, 0.0) and got[2] == (0.0, 6 / 11)


def test_gate_and_correction(spark):
    rows = [(12.0, 1.2, 0.2), (12.0, 1.2, 0.5), (12.0, 0.0, 0.1), (12.0, None, 0.1), (12.0, 1.2, None)]
    fires = E.gate_fires("p", "f")
    assert [g for g in values(spark, "c double, f double, p double", rows, fires, E.corrected("c", "f", fires))] == [(True, 10.0), (False, 12.0), (False, 12.0), (False, 12.0), (False, 12.0)]


def test_names_and_hashes(spark):
    import hashlib
    import zlib

    got = values(spark, "n string", [("HG1_20x",), ("HG1_spiked_3",), ("HG1",)], E.family_of("n"), E.is_derived("n"), E.hash_fraction(F.lit("all-loci"), "n"), E.sha_fraction("n"))
    assert [g[:2] for g in got] == [("HG1", False), ("HG1", True), ("HG1", False)]
    assert got[2][2] == zlib.crc32(b"all-loci|HG1") / 2**32
    assert got[2][3] == pytest.approx(int(hashlib.sha256(b"HG1").hexdigest()[:16], 16) / 2**64)
    assert values(spark, "k string", [("chr1-5-9-CAG",), ("chrM-1-2-A",)], E.valid_partition("k"), E.key_parts("k"))[0][0] == "1"


def test_sql_functions(spark):
    E.register(spark)
    assert spark.sql("SELECT tolerance(120D), direction_code(14D, 12D, 1), regime_of('full', 0D), unit_category(16D), motif_family('CTG')").first()[:] == (1, 1, "full_nonspanning", 7, "AGC")


def test_motifs(spark):
    rows = [("CAG",), ("AGC",), ("CTG",), ("GCT",)]
    assert {g[0] for g in values(spark, "m string", rows, M.motif_family(F.col("m")))} == {"AGC"}
    m = F.col("m")
    assert values(spark, "m string", [("GCN",), ("AAG",), ("ATTTC",)], M.motifs_match(m, F.lit("GCA")), M.nearer_strand(m, F.lit("AAAAT")))[0][0] is True
    assert values(spark, "m string", [("ATTTC",)], M.nearer_strand(m, F.lit("AAAAT")))[0][0] == "GAAAT"
    assert values(spark, "s string", [("AGCAGCAG",), ("CAGCAT",), ("",)], M.is_motif_run(F.col("s"), F.lit("CAG")), M.purity(F.col("s"), F.lit("CAG"))) == [(True, 1.0), (False, 5 / 6), (True, None)]
    assert [g[0] for g in values(spark, "m string", [("AT",), ("AAG",), ("GC",), ("GCN",)], M.gc_bin(m))] == ["0", "<=1/3", ">2/3", ">2/3"]
    got = values(spark, "low double, high double, unit int", [(60.0, 200.0, 3), (None, 1.0, 3)], M.reported_sizes(F.col("low"), F.col("high"), F.col("unit")), M.sizes_to_try(F.lit(20), F.col("low"), F.col("high"), F.col("unit")))
    assert got[0] == ([60, 105, 201], [105, 150, 201]) and got[1][0] == []


def test_parsing(spark):
    c = F.col("s")
    assert values(spark, "s string", [("(20, 8), (97, 1)",), ("()",), (None,)], P.counts_total(P.parse_counts(c)), P.counts_above(P.parse_counts(c), F.lit(20))) == [(9, 1), (0, 0), (0, 0)]
    assert [g[0] for g in values(spark, "s string", [("20/97",), ("20",), ("./.",), (None,)], P.parse_genotype(c))] == [[20, 97], [20], None, None]
    got = values(spark, "s string", [("20-20/95-153",), ("20-20",), ("x/1-2",)], P.parse_intervals(c, F.lit(2)))
    assert [[tuple(x) for x in g[0]] for g in got] == [[(20, 20), (95, 153)], [(20, 20), (None, None)], [(None, None), (1, 2)]]
    assert values(spark, "s string", [("chr12:1-2",), ("bad",)], P.parse_region(c)["start"]) == [(1,), (None,)]
    assert values(spark, "s string", [("(5, 1), (7, 2), (9, 2)",), ("(5, 1), (6, 1)",), ("()",)], P.counts_mode(P.parse_counts(c))["size"]) == [(7,), (5,), (None,)]
    assert values(spark, "v array<int>", [([10, 20],), ([10, 14, 7],), ([5],)], P.sister_value(F.col("v"), F.lit(0))) == [(20,), (7,), (None,)]
    assert values(spark, "s string", [("10S20M2D5M3I",), (None,)], P.reference_span(c)) == [(27,), (None,)]
    assert values(spark, "s string", [("5I5",)], P.mean_quality(c, F.lit(0), F.lit(2)), P.mean_quality(c, F.lit(1), F.lit(1))) == [(30, -1)]
    read = values(spark, "s string", [("spanning:30:60:35:+,left:9:50:20:-",)], P.parse_measured_reads(c))[0][0]
    assert [tuple(r) for r in read] == [("spanning", 30, 60, 35, "+"), ("left", 9, 50, 20, "-")]
