import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callquality.operators import categories as C
from callquality.operators import compare, components, intervals, joins, metrics, ml, reads, sampling, scoring, splits
from callquality.operators.joins import GuardError
from callquality.sources import io
from callquality.streaming import streams


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# Joins


def test_unique_joins_guard(spark):
    a = frame(spark, "k int, x int", [(1, 1), (2, 2)])
    twice = frame(spark, "k int, y int", [(1, 1), (1, 2)])
    with pytest.raises(GuardError):
        joins.unique_left_join(a, twice, ["k"])
    with pytest.raises(GuardError):
        joins.complete_left_join(a, frame(spark, "k int, y int", [(1, 5)]), ["k"])
    with pytest.raises(GuardError):
        joins.exactly_one(twice, a, ["k"])
    with pytest.raises(GuardError):
        joins.consistent_union([twice], ["k"])
    assert rows(joins.consistent_union([a, a], ["k"]), "k") == [(1, 1), (2, 2)]


def test_replaced_groups_stand_where_the_old_ones_stood(spark):
    cur = frame(spark, "id string, v int, pos long", [("a", 1, 0), ("b", 2, 1), ("b", 3, 2), ("c", 4, 3)])
    new = frame(spark, "id string, v int, pos long", [("d", 9, 0), ("b", 8, 1)])
    out = joins.replace_groups(cur, new, frame(spark, "id string", [("b",), ("d",)]), "id")
    assert [r.id + str(r.v) for r in out.orderBy("place").collect()] == ["a1", "b8", "c4", "d9"]


def test_differences(spark):
    a = frame(spark, "k int, x int, y string", [(1, 1, "a"), (2, None, "b"), (3, 3, "c")])
    b = frame(spark, "k int, x int, y string", [(1, 1, "z"), (2, None, "b"), (4, 4, "d")])
    assert rows(joins.row_differences(a, b, ["k"]), "k") == [(1, "y", "a", "z"), (3, "row", "present", None), (4, "row", None, "present")]
    assert sorted(rows(joins.difference_summary(a, b, ["k"]))) == [("any", 2, 1), ("x", 2, 0), ("y", 2, 1)]


def test_twin_fill_and_ranks(spark):
    df = frame(spark, "g string, o int, p double", [("a", 1, None), ("a", 2, 0.5), ("a", 3, 0.7), ("b", 1, None)])
    assert [r[2] for r in rows(joins.fill_from_twin(df, ["g"], "p", ["o"], F.lit(True)), "g", "o")] == [0.5, 0.5, 0.7, None]
    assert sorted(r[0] for r in rows(df.select(joins.average_rank("o")))) == [1.5, 1.5, 3.0, 4.0]


def test_upsert_and_union(spark):
    old, new = frame(spark, "g int, v int", [(1, 1), (2, 2)]), frame(spark, "g int, v int", [(2, 9)])
    assert rows(joins.upsert_groups(old, new, ["g"]), "g") == [(1, 1), (2, 9)]
    assert rows(joins.aligned_union(old, frame(spark, "g int, w int", [(3, 4)])), "g")[-1] == (3, None, 4)


# Intervals


def test_containment(spark):
    regions = frame(spark, "chrom string, start long, end long", [("1", 200, 300), ("1", 0, 100)])
    probes = [("1", 10, 20, True), ("1", 90, 110, False), ("1", 150, 160, False), ("1", 200, 300, True), ("1", 95, 205, False), ("2", 10, 20, False), ("1", None, None, False)]
    df = frame(spark, "chrom string, start long, end long, want boolean", probes)
    assert all(r.inside == r.want for r in intervals.inside_disjoint(df, regions, width=64).collect())


@pytest.mark.parametrize("width", [7, 64])
def test_overlaps_equal_brute_force(spark, width):
    rnd = np.random.default_rng(3)
    size = lambda: rnd.choice([0, 1, rnd.integers(1, 60), rnd.integers(1, 5000)])
    make = lambda n: [(str(rnd.integers(3)), int(s := rnd.integers(500)), int(s + size()), k) for k in range(n)]
    a, b = make(60), make(80)
    schema = "chrom string, start long, end long, id int"
    got = intervals.overlap_join(frame(spark, schema, a), frame(spark, schema, b), pad=5, width=width).select("id", "r_id")
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[1] - 5 < y[2] and y[1] < x[2] + 5)
    assert sorted(rows(got)) == want
    lonely = intervals.overlap_join(frame(spark, schema, a), frame(spark, schema, b), pad=5, width=width, how="anti")
    assert {r.id for r in lonely.collect()} == {x[3] for x in a} - {i for i, _ in want}
    counts = intervals.count_overlaps(frame(spark, schema, a), frame(spark, schema, b), "id")
    assert {r.id: r.n_overlaps for r in counts.collect()} == {x[3]: sum(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in b) for x in a}


def test_long_intervals_make_few_rows(spark):
    chromosome = frame(spark, "chrom string, start long, end long", [("1", 1, 250_000_001)])
    made = chromosome.select(F.explode(intervals._nested(F.col("start"), F.col("end"), 1 << 14)).alias("c")).select("c.*").collect()
    assert len(made) < 4 * 2 * 15 and sum(16**r.level for r in made) == 250_000_000 // (1 << 14) + 1
    points = spark.range(0, 250_000_000, 1_000_003).select(F.lit("1").alias("chrom"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    assert intervals.overlap_join(points, chromosome).count() == points.count() - 1
    assert intervals.count_overlaps(chromosome.withColumn("k", F.lit(1)), points, "k").head().n_overlaps == points.count() - 1


def test_islands_and_groups(spark):
    df = frame(spark, "chrom string, start long, end long, id int, fam string", [("1", 0, 10, 1, "x"), ("1", 15, 20, 2, "y"), ("1", 40, 50, 3, "x"), ("2", 0, 5, 4, "z")])
    assert [r[-1] for r in rows(intervals.islands(df, gap=10, key="id"), "id")] == [1, 1, 2, 1]
    groups = components.linked_groups(df, intervals.proximity_edges(df, "id", gap=10, same="fam"), "id")
    assert {r.id: r.group for r in groups.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert [r.id for r in intervals.first_of_island(df, gap=10, key="id").orderBy("id").collect()] == [1, 3, 4]


def test_best_overlap_and_pairs(spark):
    left = frame(spark, "chrom string, start long, end long, k int", [("1", 0, 100, 1), ("1", 500, 600, 2)])
    right = frame(spark, "chrom string, start long, end long, o int, good boolean", [("1", 0, 90, 1, False), ("1", 80, 100, 2, True), ("1", 0, 20, 3, True)])
    assert [(r.k, r.r_o) for r in intervals.best_overlap(left, right, "k", F.col("r_good"), "o").collect()] == [(1, 2)]
    mates = frame(spark, "name string, chrom string, start long", [("a", "1", 5), ("a", "1", 50), ("b", "1", 5), ("b", "2", 5)])
    assert rows(intervals.pairs_within(left.select("k", "chrom", "start", "end"), mates, "k", "name")) == [(1, "a")]


# Samples and splits


def test_quota_contract(spark):
    counts = {"a": 100, "b": 10, "c": 3}
    df = frame(spark, "cell string, id int", [(c, k) for c, n in counts.items() for k in range(n)])
    for cap, level in ((50, 37), (20, 8), (1000, 100)):
        got = sampling.quota_sample(df, ["cell"], cap, ["cell", "id"])
        assert {r["cell"]: r["count"] for r in got.groupBy("cell").count().collect()} == {c: min(n, level) for c, n in counts.items()}
    again = sampling.quota_sample(df.repartition(7), ["cell"], 20, ["cell", "id"])
    assert sorted(rows(again)) == sorted(rows(sampling.quota_sample(df.repartition(1), ["cell"], 20, ["cell", "id"])))
    chosen = df.withColumn("chosen", F.col("id") < 5)
    extra = sampling.quota_top_up(chosen, "chosen", ["cell"], 20, ["cell", "id"])
    assert {r["cell"]: r["count"] for r in extra.groupBy("cell").count().collect()} == {"a": 3, "b": 3} and extra.filter("chosen").isEmpty()


def test_caps_cohorts_and_weights(spark):
    df = frame(spark, "e int, id int, d int", [(k // 4, k, k % 3) for k in range(200)])
    assert sampling.cap_rows(df, 30, ["id"]).count() == 30 and sampling.cap_rows(df, 500, ["id"]).count() == 200
    cohort = sampling.entity_cohort(df, "e", F.lit(True), 50)
    assert {r["count"] for r in cohort.groupBy("e").count().collect()} == {4} and cohort.count() == 48
    w = sampling.balancing_weights(frame(spark, "cell int, d int", [(1, 1), (1, 1), (1, 1), (1, 2), (2, 1), (1, 0)]), "cell", "d", 1, 2)
    assert sorted(round(r.weight, 6) for r in w.collect()) == [0.666667, 0.666667, 0.666667, 1.0, 1.0, 2.0]
    pool = df.withColumn("source", F.lit("s")).withColumn("regime", F.lit("q"))
    capped = sampling.cap_per_class(pool, 40, ["d"], ["id"])
    assert capped.filter("representative").count() == 40 and capped.count() == capped.select("id").distinct().count()


def test_bootstrap_brackets_the_mean(spark):
    df = frame(spark, "v double, o int", [(float(k), k) for k in range(20)])
    r = sampling.bootstrap_means(df, "v", "o", 300).first()
    assert r.n == 20 and r.mean == 9.5 and r.low < 9.5 < r.high and r.high - r.low < 8


def test_populations(spark):
    df = frame(spark, "e int, called double, variant boolean, ref double, true double", [(1, 5.0, True, 4.0, 5.0), (2, 500.0, False, 4.0, None), (3, None, False, 4.0, None)])
    rate = F.when(F.col("called") > 100, 1.0).when(F.col("called").isNotNull(), 0.0)
    got = {r.e: r for r in sampling.with_population(df, "e", F.col("variant"), "ref", "true", rate, F.lit("p")).collect()}
    assert set(got) == {1, 2} and got[2].true == 4.0 and got[2].in_pool and got[1].keep_probability == 1.0


def test_splits(spark):
    keys = frame(spark, "c string", [(str(k),) for k in range(24)])
    folds = splits.fold_table(keys, "c", 5, 3)
    assert folds.filter("role = 'test'").count() == 24
    assert {r["count"] for r in folds.filter("role = 'calib'").groupBy("fold").count().collect()} == {3}
    df = frame(spark, "g string, x int", [(f"p{k}_{x}x", x) for k in range(6) for x in (10, 20)] + [("p1_spiked_1", 0)])
    picked = splits.held_out_groups(df, "g", 2)
    marked = splits.mark_held_out(df, "g", picked)
    assert marked.filter("held_out").select("g").distinct().count() in (4, 5)
    with pytest.raises(GuardError):
        splits.refuse_derived(df, "g", frame(spark, "family string", [("p1",)]))
    halves = splits.two_halves(df, "g")
    assert halves.groupBy("g").agg(F.count_distinct("half").alias("n")).filter("n > 1").isEmpty()
    with pytest.raises(GuardError):
        splits.require_disjoint(df, df, "g")
    splits.require_disjoint(df.filter("x = 10"), df.filter("x = 20"), "g")


# Categories


def test_categories(spark):
    data = [(10, 10, 5, "Same"), (12, 10, 5, "2"), (8, 10, 5, "-2"), (14, 10, 5, "3 to 4"), (40, 10, 5, "21 or more"), (3, 10, 5, "Wrong Direction"), (None, 10, 5, "No Call"), (202, 200, 5, "Same"), (5, 10, 5, "Called Hom Ref"), (7, 5, 5, "2")]
    df = frame(spark, "c double, t double, r double, want string", [(None if c is None else float(c), float(t), float(r), w) for c, t, r, w in data])
    ref = F.coalesce(F.col("c") == F.col("r"), F.lit(False))
    got = df.select("want", C.call_category(F.col("c") - F.col("t"), F.col("c"), F.col("t") - F.col("r"), F.col("c") - F.col("r"), ref, ref).alias("got"))
    assert all(r.got == r.want for r in got.collect())


def test_re_pairing_moves_values(spark):
    df = frame(spark, "e int, o int, v double, t double, u string", [(1, 0, 30.0, 10.0, "a"), (1, 1, 12.0, 40.0, "b"), (2, 0, None, 5.0, "c"), (2, 1, 7.0, 9.0, "d")])
    got = rows(C.re_paired(df, ["e"], "v", "t", ["o"], along=["u"]), "e", "o")
    assert got == [(1, 0, 12.0, 10.0, "b"), (1, 1, 30.0, 40.0, "a"), (2, 0, 7.0, 5.0, "d"), (2, 1, None, 9.0, "c")]


def test_ledger(spark):
    df = frame(spark, "x int, ok boolean", [(1, True), (2, False), (None, None), (9, True)])
    kept, ledger = C.drop_ledger(df, {"null": F.col("x").isNull(), "small": F.col("x") < 3, "never": F.lit(None).cast("boolean")})
    assert kept.count() == 1 and rows(ledger.select("reason", "n"), "place" if False else "reason") == [("never", 0), ("null", 1), ("small", 2)]
    assert C.keep_where(df, "ok").count() == 3 and C.keep_where(df, "absent").count() == 4
    assert rows(C.mixed_groups(frame(spark, "g int, v int", [(1, 1), (1, 2), (2, 5), (2, 5)]), "g", "v").select("g")) == [(1,)]


def read(kind, length, n=1, mapq=60, quality=30, strand="+", locus="a"):
    return [(locus, kind, length, mapq, quality, strand)] * n


@pytest.mark.parametrize(
    ("reads_", "short", "long", "want"),
    [
        (read("spanning", 30, 9), 10, 10, "too_few_reads"),
        (read("spanning", 30, 6) + read("spanning", 60, 5), 10, 10, "contradicted_by_spanning"),
        (read("spanning", 30, 3) + read("spanning", 60, 4) + read("left", 9, 5), 10, 20, "not_contradicted"),
        (read("spanning", 30, 6) + read("spanning", 60, 6), 10, 20, "both_supported"),
        (read("spanning", 30, 8) + read("right", 120, 4), 10, 10, "contradicted_by_longer"),
        (read("spanning", 30, 8) + read("left", 120, 4), 10, 10, "not_contradicted"),
        (read("spanning", 30, 8) + read("right", 120, 4, quality=10), 10, 10, "not_contradicted"),
        (read("spanning", 30, 20, mapq=30), 10, 10, "too_few_reads"),
        ([], 10, 10, "too_few_reads"),
    ],
)
def test_verdicts(spark, reads_, short, long, want):
    df = frame(spark, "locus_id string, kind string, length int, mapq int, quality int, strand string", reads_)
    truth = frame(spark, "locus_id string, short double, long double, unit int", [("a", float(short), float(long), 3)])
    assert [r.verdict for r in C.truth_verdicts(df, truth).collect()] == [want]


# Metrics


def test_gated_errors(spark):
    df = frame(spark, "called double, truth double, corrected double, p_ok double", [(12.0, 10.0, 10.0, 0.2), (14.0, 10.0, 10.0, 0.1), (9.0, 10.0, 1.0, 0.9)])
    r = metrics.gated_errors(df).first()
    assert (r.n, r.helped, r.hurt) == (3, 2, 0) and r.mae_raw == pytest.approx(7 / 3) and r.mae_gated == pytest.approx(1 / 3)
    empty = metrics.gated_errors(df.limit(0)).first()
    assert empty.n == 0 and empty.mae_raw is None


def test_ranking_metrics(spark):
    scores = [0.9, 0.5, 0.5, 0.5, 0.1, 0, 0, 0, 0, 0]
    df = frame(spark, "s double, y boolean", [(float(s), k < 2) for k, s in enumerate(scores)])
    assert metrics.tie_aware_recall(df, "s", "y", [0.2]).first().recall == pytest.approx(2 / 3)
    rnd = np.random.default_rng(1)
    s, y = np.round(rnd.random(300), 1), rnd.random(300) < 0.4
    df = frame(spark, "s double, y boolean", list(zip(s.tolist(), y.tolist(), strict=True)))
    pairs = [(a > b) + (a == b) / 2 for a in s[y] for b in s[~y]]
    assert metrics.roc_auc(df, "s", "y").first().auc == pytest.approx(np.mean(pairs))
    assert metrics.roc_auc(df.filter("y"), "s", "y").first().auc is None
    ap = sum((y[s == t].sum() / y.sum()) * y[s >= t].mean() for t in np.unique(s))
    assert metrics.average_precision(df, "s", "y").first().average_precision == pytest.approx(ap)
    at = np.clip((s * 10).astype(int), 0, 9)
    ece = sum((at == b).mean() * abs(s[at == b].mean() - y[at == b].mean()) for b in range(10) if (at == b).any())
    assert metrics.calibration_error(df, "s", "y").first().ece == pytest.approx(ece)


def test_confusion_and_losses(spark):
    df = frame(spark, "y int, a double, b double, c double", [(0, 0.5, 0.5, 0.0), (1, 0.2, 0.3, 0.5), (0, 0.1, 0.1, 0.8)])
    got = {(r.label, r.predicted): (r.n, r.share) for r in metrics.confusion(df, "y", ["a", "b", "c"]).collect()}
    assert got[0, 0] == (1, 0.5) and got[0, 2] == (1, 0.5) and got[2, 2] == (0, 0.0) and len(got) == 9
    want = -np.mean([math.log(0.5), math.log(0.3), math.log(0.1)])
    assert metrics.log_loss(df, "y", ["a", "b", "c"]).first().log_loss == pytest.approx(want)
    assert metrics.origin_log_slope(frame(spark, "x double, r double, w double", [(1.0, 2.0, 1.0), (2.0, 4.0, 1.0)]), "x", "r", "w").first().base == pytest.approx(2)
    assert metrics.origin_log_slope(frame(spark, "x double, r double, w double", [(1.0, 0.0, 1.0)]), "x", "r", "w").first().base == 1


def test_coverage_guard(spark):
    truth = frame(spark, "id int, t double", [(k, float(k)) for k in range(100)])
    found = truth.filter("id >= 5").select("id")
    gaps = metrics.coverage_gaps(truth, found, "id", F.when(F.col("t") < 20, "0-20").otherwise("20+"))
    assert {r.size_bin: r.missing for r in gaps.collect()} == {"all": 5, "0-20": 5, "20+": 0}
    with pytest.raises(GuardError):
        metrics.require_coverage(gaps)
    metrics.require_coverage(gaps, 0.1, 0.3)


def test_measured_reads_one_by_one():
    left, right = "ACGTTGCAAGCTTACGGATC", "TTGACCATGCGATAGGCTAA"
    at = lambda seq, begin=500, ref=520: reads.measured(seq, "I" * len(seq), begin, f"{len(seq)}M", left, right, "CAG", ref, ref + 12)
    assert at(left + "CAG" * 7 + right) == ("spanning", 21, 40)
    assert reads.measured(left + right, "I" * 40, 500, "20M12D20M", left, right, "CAG", 520, 532) == ("spanning", 0, -1)
    assert at(left + "CAG" * 3 + "CAT" + "CAG" * 3) == ("left", 21, 40)  # one interruption, away from the end
    assert at(left + "CAG" * 3 + "TTGA") == ("left", 9, 40)  # ends four bases into the other flank
    assert at(left + "CAG" * 2) is None and at(left + "CAG" * 5 + "TTTTTTTTTTTT") is None
    assert at("AG" + "CAG" * 4 + right, 519) == ("right", 14, 40)
    assert at("GGATC" + "CAG" * 4 + right, 516) == ("right", 12, 40)
    twice = left + "CAG" * 3 + left + "CAG" * 3
    assert reads.measured(twice, "*", 500, "58S", left, right, "CAG", 520, 532) is None  # unaligned: either may be the flank
    assert reads.measured(twice, "*", 500, "20M38S", left, right, "CAG", 520, 532) is None
    assert at(left[:-1] + "A" + "CAG" * 7 + right) is None  # the base beside the repeat differs
    assert at(left + "CAG" * 20) is None  # its alignment covers the right flank
    assert at(left + "CAG" * 7 + right, 560) is None  # aligned far from the locus


def test_islands_over_cells(spark):
    rows = [(k, None if k % 11 == 0 else "ab"[k % 2], None if k % 17 == 0 else (k * 37) % 500, (k * 37) % 500 + 5 + k % 9) for k in range(120)]
    df = frame(spark, "id int, chrom string, start long, end long", rows)
    got = {r.id: r.island for r in intervals.islands(df, gap=3, key="id", width=16).collect()}
    want, last = {}, {}
    for i, c, a, b in sorted(rows, key=lambda r: (str(r[1]), r[2] is not None, r[2] or 0, r[3], r[0])):
        end, n = last.get(c, (None, 0))
        n += end is None or a is None or a - end >= 3
        want[i], last[c] = n, (b, n)
    assert got == want
    assert intervals.islands(df.limit(0)).count() == 0


def test_scores_over_ranges(spark):
    rows = [("a", s, k % 3 == 0) for k, s in enumerate([0.1, 0.5, 0.5, 0.9, float("inf"), 3.0, -2.0, 0.1, None])] + [(None, 1.0, True), (None, 1.0, False), ("c", 7.0, True)]
    table = metrics.score_table(frame(spark, "g string, s double, y boolean", rows), "s", "y", ["g"]).collect()
    for r in table:
        own = [(s, y) for g, s, y in rows if g == r.g and s is not None]
        assert (r.pos, r.neg) == tuple(sum(s == r.score and y is want for s, y in own) for want in (True, False))
        assert (r.pos_above, r.neg_above) == tuple(sum(s > r.score and y is want for s, y in own) for want in (True, False))
        assert (r.n_pos, r.n_neg) == tuple(sum(y is want for _, y in own) for want in (True, False))
    assert len(table) == len({(g, s) for g, s, _ in rows if s is not None})


def test_quota_level_with_equal_cells(spark):
    level = sampling.quota_level(frame(spark, "n long", [(20,), (20,), (20,)]), 40).first().level
    assert level == 13
    counts = frame(spark, "g string, n long", [("a", 5), ("a", 9), ("a", 9), ("a", 9), ("b", 1), ("b", 1)])
    assert {r.g: r.level for r in sampling.quota_level(counts, 23, ["g"]).collect()} == {"a": 6, "b": 1}


def test_comparison(spark):
    sums = lambda x: frame(spark, "s string, g int, n long, sum_gated double", [("a", k, 10, x * 10 + k % 2) for k in range(12)] + [("b", 1, 5, 1.0)])
    got = {r.s: r for r in compare.paired_comparison(sums(2.0), sums(1.0), ["s"], "g", replicates=50).collect()}
    assert got["a"].winner == "new" and got["b"].winner == "too few samples" and got["a"].mean_delta == pytest.approx(-1)
    told = compare.verdict(frame(spark, "winner string", [("new",), ("tie",), ("too few samples",)])).first()
    assert (told.verdict, told.judged) == ("new", 2)
    a = frame(spark, "s string, n long, mae_raw double", [("a", 1, 2.0)])
    compare.require_same_rows(a, a, ["s"])
    with pytest.raises(GuardError):
        compare.require_same_rows(a, a.withColumn("n", F.lit(2)), ["s"])
    assert compare.model_fingerprint(sums(1.0)).first() == compare.model_fingerprint(sums(1.0).repartition(5)).first() != compare.model_fingerprint(sums(2.0)).first()


# Scoring

NODES = "regime string, head string, iter int, class int, node_id int, is_leaf boolean, value double, feature int, threshold double, missing_left boolean, left int, right int"


def toy(spark):
    def tree(head, cls, i, feature, limit, missing, low, high):
        return [("q", head, i, cls, 0, False, None, feature, limit, missing, 1, 2), ("q", head, i, cls, 1, True, low, None, None, None, None, None), ("q", head, i, cls, 2, True, high, None, None, None, None, None)]

    base = [("q", "size", -1, 0, 0, True, 0.1, None, None, None, None, None)]
    return frame(spark, NODES, base + tree("size", 0, 0, 0, 5.0, True, 0.2, -0.3) + tree("size", 0, 1, 1, 1.0, False, 0.05, 0.0) + tree("direction", 0, 0, 0, 5.0, True, 1.0, 0.0) + tree("direction", 1, 0, 1, 0.0, False, 0.5, -0.5) + tree("direction", 2, 0, 0, float("inf"), False, 0.1, 0.9))


def test_scoring_equals_plain_arithmetic(spark):
    knots = frame(spark, "regime string, class int, i int, x double, y double", [("q", 0, 0, 0.2, 0.1), ("q", 0, 1, 0.6, 0.9)])
    data = [("q", 5.0, 2.0), ("q", 6.0, None), ("q", None, 0.0), ("other", 1.0, 1.0)]
    got = scoring.score(frame(spark, "regime string, a double, b double", data), toy(spark), knots, {"q": ["a", "b"], "other": ["a"]}).collect()
    for (regime, a, b), r in zip(data, got, strict=True):
        if regime == "other":
            assert r.factor is None and r.p_0 is None
            continue
        t = 0.1 + (0.2 if a is None or a <= 5 else -0.3) + (0.05 if b is not None and b <= 1 else 0.0)
        z = np.array([1.0 if a is None or a <= 5 else 0.0, 0.5 if b is not None and b <= 0 else -0.5, 0.9 if a is None else 0.1])
        p = np.exp(z) / np.exp(z).sum()
        q = np.array([np.interp(p[0], [0.2, 0.6], [0.1, 0.9]), p[1], p[2]])
        assert r.factor == pytest.approx(round(math.exp(t), 3)) and [r.p_0, r.p_1, r.p_2] == pytest.approx(list(np.round(q / q.sum(), 3)))
    with pytest.raises(GuardError):
        scoring.score(frame(spark, "regime string, a double", [("q", 1.0)]), toy(spark), knots, {"q": ["a", "b"]})


def test_native_calibration(spark):
    k = F.array(F.struct(F.lit(0.2).alias("x"), F.lit(0.1).alias("y")), F.struct(F.lit(0.6).alias("x"), F.lit(0.9).alias("y")))
    df = frame(spark, "p double", [(0.0,), (0.4,), (0.7,)])
    assert [r[0] for r in df.select(scoring.calibrate_column(F.col("p"), k)).collect()] == pytest.approx([0.1, 0.5, 0.9])
    zero = df.limit(1).select(*scoring.renormalised([F.lit(0.0), F.lit(-1.0)])).first()
    assert tuple(zero) == (0.5, 0.5)


# Fitting


@pytest.fixture(scope="module")
def small(spark):
    rnd = np.random.default_rng(5)
    out = []
    for k in range(240):
        a, b = rnd.random(), rnd.random()
        y = 0 if a < 0.4 else 1 if b < 0.5 else 2
        out.append((k, f"g{k % 8}", float(a), float(b) if k % 9 else None, float(2 * a + (0.1 if b > 0.5 else 0)), y))
    return spark.createDataFrame(out, "id int, g string, a double, b double, t double, y int").cache()


def test_heads(spark, small):
    median = ml.fit_median(small, ["a", "b"], "t", iterations=5)
    direction = ml.fit_direction(small, ["a", "b"], "y", trees=5)
    scored = ml.with_predictions(small, ["a", "b"], median, direction)
    assert scored.agg(F.avg(F.abs(F.col("t") - F.col("t_predicted")))).first()[0] < 0.2
    assert metrics.accuracy(scored, "y", ["p_0", "p_1", "p_2"]).first().accuracy > 0.8
    fixed = ml.apply_calibrators(scored, ml.fit_calibrators(scored, "y"))
    r = fixed.agg(F.min(F.col("p_0") + F.col("p_1") + F.col("p_2")), F.max(F.col("p_0") + F.col("p_1") + F.col("p_2"))).first()
    assert r[0] == pytest.approx(1) and r[1] == pytest.approx(1)
    losses = ml.gbt_prefix_losses(median, small, ["a", "b"], "t")
    assert losses.count() == 5 and ml.early_stop(losses, step=1) >= 1
    curve = ml.ablation_curve(small, small, ["a", "b"], "t", [0, 1], iterations=3)
    assert curve.filter("k = 1").first().loss < curve.filter("k = 0").first().loss


def test_importance_and_choice(spark, small):
    off = F.avg(F.abs(F.col("t") - 2 * F.col("a"))).alias("off")
    calls = []
    loss = lambda df, by: calls.append(by) or df.groupBy(*by).agg(off)
    got = {r.feature: r.mean for r in ml.permutation_importance(small, ["a", "b"], ["id"], loss, repeats=2).collect()}
    assert got["a"] > 0.1 and got["b"] == pytest.approx(0) and calls == [["feature", "repeat"]]
    alone = [ml.shuffled_column(small, "a", ["id"], k).agg(off).head()[0] - small.agg(off).head()[0] for k in (0, 1)]
    assert got["a"] == pytest.approx(sum(alone) / 2)
    curve = frame(spark, "s string, k int, v double", [("x", 1, 1.5), ("x", 2, 1.01), ("x", 3, 1.0), ("y", 1, 1.0), ("y", 2, 1.0), ("y", 3, 1.0)])
    assert ml.smallest_within(curve, "s", "k", "v", 0.02).first().k == 2


@pytest.mark.parametrize("width", [1, 7, 64, 1 << 20])
def test_neighbours_across_cells(spark, width):
    rnd = np.random.default_rng(11)
    data = [(k, "ab"[k % 2], int(s), int(s + rnd.integers(0, 30))) for k, s in enumerate(rnd.integers(-300, 300, 120))] + [(500, None, 5, 9), (501, None, 8, 12), (502, "a", None, 3), (503, "a", 3, None)]
    df = frame(spark, "id int, chrom string, start int, end int", data)
    none_first = lambda r: tuple((v is not None, v or 0) for v in (r[2], r[3], r[0]))
    want, firsts = set(), set()
    for by in ("a", "b", None):
        own = sorted((r for r in data if r[1] == by), key=none_first)
        firsts.add(own[0][0])
        for before, r in zip(own, own[1:]):
            known = r[2] is not None and before[3] is not None
            if known and r[2] - before[3] < 4:
                want.add((r[0], before[0]))
            else:
                firsts.add(r[0])
    assert {tuple(r) for r in intervals.proximity_edges(df, "id", gap=4, width=width).collect()} == want
    told = intervals.islands(df, gap=4, key="id", width=width)
    assert {r.id for r in intervals.first_of_island(df, gap=4, key="id").collect()} == firsts
    assert told.select("chrom", "island").distinct().count() == len(firsts)
    assert intervals.first_of_island(df.limit(0), gap=4, key="id").isEmpty()


# Sources, reads, streams


def test_nested_records(spark, tmp_path):
    alleles = [{"AlleleNumber": 1, "AlleleSize": 20, "Depth": 11.0}, {"AlleleNumber": 2, "AlleleSize": 97, "Depth": 9.0}]
    variant = {"RepeatUnit": "CAG", "ReferenceRegion": "chr1:1000-1030", "Genotype": "20/97", "GenotypeConfidenceInterval": "20-20/90-105", "CountsOfSpanningReads": "(20, 8), (97, 1)", "CountsOfFlankingReads": "(98, 2)", "CountsOfInrepeatReads": "(33, 4), (34, 1)", "AlleleQualityMetrics": {"Alleles": alleles}}
    none = {"RepeatUnit": "A", "ReferenceRegion": "chr1:5-9", "Genotype": "./."}
    doc = {"SampleParameters": {"SampleId": "S"}, "LocusResults": {"a": {"LocusId": "a", "Coverage": 30.0, "ReadLength": 150.0, "Variants": {"a": variant}}, "b": {"LocusId": "b", "Coverage": 3.0, "ReadLength": 100.0, "Variants": {"b": none}}}}
    (tmp_path / "x.json").write_text(json.dumps(doc, indent=1))
    calls = io.read_call_documents(spark, str(tmp_path / "x.json"))
    got = {(r.locus_id, r.allele_rank): r for r in io.allele_rows(io.variant_rows(calls)).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("b", 0), ("b", 1)}
    a0, a1 = got["a", 0], got["a", 1]
    assert (a0.called, a1.called, a0.sample_id, a0.spanning_total, a0.flanking_total, a0.flanking_above_called, a1.flanking_above_called) == (20, 97, "S", 9, 2, 2, 2)
    assert (a0.spanning_above_called, a1.spanning_above_called, a0.inrepeat_total, a0.het_gap, a0.num_repeats_in_reference, a1.ci_width) == (1, 0, 5, 77, 10, 15)
    assert (a0.depth, a1.depth, a0.has_own_quality_metrics, a0.support_frac) == (11.0, 9.0, True, 8 / 9)
    assert got["b", 1].called is None and got["b", 1].has_own_quality_metrics is False
    assert io.typical_read_length(calls).first().read_length == 150
    assert {r.sample_id for r in io.variant_rows(calls, "T").collect()} == {"T"}


def test_truth_and_regions(spark, tmp_path):
    head = "LocusId\tChrom\tStart0Based\tEnd\tMotif\tNumRepeatsInReference\tNumRepeatsShortAllele\tNumRepeatsLongAllele\tRepeatPurityShortAllele\tRepeatPurityLongAllele"
    lines = ["1-5-9-A\tchr1\t5\t9\tA\t4\t4\t6\t1\t1"] * 2 + ["2-5-9-A\t2\t5\t9\tA\t4\tNA\t6\t1\t1", "M-1-2-A\tchrM\t1\t2\tA\t1\t1\t1\t1\t1"]
    (tmp_path / "t.tsv").write_text("\n".join([head, *lines]))
    got = io.read_truth(spark, str(tmp_path / "t.tsv"))
    assert sorted((r.LocusId, r.Chrom, r.NumRepeatsShortAllele) for r in got.collect()) == [("1-5-9-A", "1", 4.0), ("2-5-9-A", "2", None)]
    (tmp_path / "r.bed").write_text("chr1\t0\t100\nchr2\t5\t6\n")
    assert rows(io.read_regions(spark, str(tmp_path / "r.bed")), "start") == [("1", 0, 100), ("2", 5, 6)]


def test_contracts_and_parts(spark, tmp_path):
    df = frame(spark, "source string, a double, b float", [("x", 1.0, 2.0), ("y", 3.0, 4.0)])
    io.require_contract(df.schema, ["a"])
    with pytest.raises(GuardError):
        io.require_contract(df.schema, ["a", "b"])
    with pytest.raises(GuardError):
        io.project_features(df, ["a", "b"])
    io.write_parts(df, str(tmp_path / "p"), "source")
    io.write_parts(df.filter("source = 'x'").withColumn("a", F.lit(9.0)), str(tmp_path / "p"), "source")
    assert sorted((r.source, r.a) for r in spark.read.parquet(str(tmp_path / "p")).collect()) == [("x", 9.0), ("y", 3.0)]
    with pytest.raises(GuardError):
        io.union_roots({"r1": df, "r2": df}, "source")
    listing = io.source_listing(spark, str(tmp_path / "p" / "source=x"))
    assert io.changed_sources(listing, listing).isEmpty() and not io.changed_sources(listing, listing.limit(0)).isEmpty()
    assert {r.source: r.hit for r in io.marked(df, df.filter("a = 1"), "source", "hit").collect()} == {"x": True, "y": False}


def test_read_measurement(spark):
    left, right = "ACGTTGCAAGCTTACGGATC", "TTGACCATGCGATAGGCTAA"
    window = "C" * 5 + "GATTACAGATCCATGACTGA" + left + "CAG" * 4 + right + "CCATTGACGGATTTACAGGA"
    start = len("C" * 5 + "GATTACAGATCCATGACTGA") + 20 + 1000
    loci = frame(spark, "locus_id string, chrom string, start long, end long, motif string, window_start long, window_seq string", [("L", "1", start, start + 12, "CAG", 1000, window)])
    spanning = left + "CAG" * 6 + right
    bound = left + "CAG" * 5
    quality = lambda s: "I" * len(s)
    data = [
        ("r1", 0, "1", start - 20, 60, f"32M6I{len(spanning) - 38}M", spanning, quality(spanning)),
        ("r2", 16, "1", start - 20, 60, f"{len(bound)}M", bound, quality(bound)),
        ("r3", 0, "1", start - 20, 5, f"{len(bound)}M", bound, quality(bound)),
        ("r4", 0, "2", start - 20, 60, f"{len(bound)}M", bound, quality(bound)),
    ]
    df = frame(spark, "name string, flag int, chrom string, start long, mapq int, cigar string, seq string, qual string", data)
    got = {r.name: (r.kind, r.length, r.quality, r.strand) for r in reads.measure_reads(df, loci).collect()}
    assert got == {"r1": ("spanning", 18, 40, "+"), "r2": ("left", 15, 40, "-"), "r3": ("left", 15, 40, "+")}
    r = reads.locus_summary(loci, df, reads.measure_reads(df, loci)).first()
    assert (r.n_reads_overlapping, r.n_reads_mapq_below_20, r.measured_reads) == (3, 1, "spanning:18:60:40:+,left:15:60:40:-,left:15:5:40:+")
    assert not reads.unique_flanks(window.replace("A", "N"), 1000, start, start + 12)


def test_streams(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    frame(spark, "k int, v int, ts timestamp", []).write.parquet(src)
    spark.range(10).select((F.col("id") % 2).cast("int").alias("k"), F.col("id").cast("int").alias("v"), F.timestamp_seconds(F.col("id")).alias("ts")).write.mode("append").parquet(src)
    s = streams.arriving(spark, src, "k int, v int, ts timestamp")
    assert sorted((r.k, r.n) for r in streams.drained(streams.running_summary(s, ["k"], F.sum("v").alias("n")), "sums").collect()) == [(0, 20), (1, 25)]
    for _ in range(2):
        streams.append_new_sources(streams.arriving(spark, src, "k int, v int, ts timestamp"), out, str(tmp_path / "cp"), ["k"]).awaitTermination()
    assert spark.read.parquet(out).count() == 10
    once = streams.without_duplicates(streams.arriving(spark, src, "k int, v int, ts timestamp"), "ts", "1 hour", ["k"])
    assert streams.drained(once, "once", "append").count() == 2


# Bounds are met or said


def test_rounds_of_linked_groups(spark):
    chain = spark.range(40).withColumnRenamed("id", "k")
    edges = spark.range(39).selectExpr("id AS a", "id + 1 AS b")
    assert rows(components.linked_groups(chain, edges, "k").groupBy("group").count()) == [(0, 40)]
    with pytest.raises(GuardError):
        components.linked_groups(chain, edges, "k", most_rounds=1)


def test_out_of_fold_refuses_more_folds_than_it_fits(spark):
    folds = spark.range(1001).selectExpr("id AS k", "id AS fold", "'test' AS role")
    with pytest.raises(GuardError):
        ml.out_of_fold(spark.range(3).withColumnRenamed("id", "k"), folds, "k", lambda train: pytest.fail("a fit"))


def test_too_many_knots(spark, monkeypatch):
    monkeypatch.setattr(scoring, "MOST_NODES", 3)
    knots = frame(spark, "regime string, class int, i int, x double, y double", [("r", 0, i, i / 4, i / 4) for i in range(4)])
    with pytest.raises(GuardError):
        scoring.compile_knots(knots)
    assert scoring.compile_knots(knots.limit(3)) == {"r": {0: [(i / 4, i / 4) for i in range(3)]}}


def test_early_stop_reads_all_sizes(spark):
    losses = spark.range(1, 12_001).selectExpr("id AS size", "-CAST(id AS double) AS loss")
    assert ml.early_stop(losses) == 12_000
    assert ml.early_stop(losses.limit(0)) == 0
    assert ml.early_stop(spark.range(1, 12_001).selectExpr("id AS size", "abs(id - 500) / 1D AS loss")) == 500


def test_calibrators_of_all_classes_among_many_labels(spark):
    df = spark.range(400).selectExpr("CAST(id % 200 AS int) AS y", "id / 400D AS p_0", "id / 800D AS p_1", "1 - id / 400D AS p_2")
    assert {r[0] for r in ml.fit_calibrators(df, "y").select("class").distinct().collect()} == {0, 1, 2}
    assert ml.fit_calibrators(df.filter("y = 1"), "y").isEmpty()
