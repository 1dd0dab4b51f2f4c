"""Learning curves, the bundle of a regime, mark runs and model documents, each against plain Python or known values."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from callquality.operators import evaluation, jobs, ml, scoring
from callquality.operators.joins import GuardError
from callquality.sources import models

NODES = "regime string, head string, iter int, class int, node_id int, is_leaf boolean, value double, feature int, threshold double, missing_left boolean, left int, right int"


def stump(head, it, cls, feature, cut, low, high):
    return [("R", head, it, cls, 0, False, None, feature, cut, True, 1, 2), ("R", head, it, cls, 1, True, low, *[None] * 5), ("R", head, it, cls, 2, True, high, *[None] * 5)]


def base(head, cls, value):
    return ("R", head, -1, cls, 0, True, value, *[None] * 5)


@pytest.fixture(scope="module")
def model(spark):
    rows = [base("size", 0, 0.1), *[base("direction", c, 0.2 * c) for c in range(3)]]
    for k in range(6):
        rows += stump("size", k, 0, k % 2, 0.5, -0.1 * k, 0.2)
    for k in range(3):
        for c in range(3):
            rows += stump("direction", k, c, c % 2, 0.3 * (k + 1), 0.5 - c * 0.3, -0.4 + c * 0.2)
    return spark.createDataFrame(rows, NODES)


def value_of(cut, low, high, x):
    return low if x is None or x <= cut else high


def by_hand(x, size, ratio=2):
    t = 0.1 + sum(value_of(0.5, -0.1 * k, 0.2, x[k % 2]) for k in range(min(6, ratio * size)))
    raw = [0.2 * c + sum(value_of(0.3 * (k + 1), 0.5 - c * 0.3, -0.4 + c * 0.2, x[c % 2]) for k in range(min(3, size))) for c in range(3)]
    e = [math.exp(v) for v in raw]
    return t, [v / sum(e) for v in e]


def test_staged_scores(spark, model):
    data = [(1, 0.2, 0.9), (2, None, 0.4), (3, 0.8, 0.7)]
    df = spark.createDataFrame(data, "id int, a double, b double")
    got = {(r.id, r.size): r for r in evaluation.staged_scores(df, model, "R", ["a", "b"], [1, 2, 3, 9]).collect()}
    assert len(got) == 12
    for i, a, b in data:
        for size in (1, 2, 3, 9):
            t, p = by_hand((a, b), size)
            r = got[i, size]
            assert [r.t_predicted, r.p_0, r.p_1, r.p_2] == pytest.approx([t, *p])
    # All iterations are what the scorer gives.
    whole = {r.id: r for r in scoring.score(df.withColumn("regime", F.lit("R")), model, spark.createDataFrame([], "regime string, class int, i int, x double, y double"), {"R": ["a", "b"]}, digits=9).collect()}
    assert all(whole[i].p_0 == pytest.approx(got[i, 9].p_0) and whole[i].factor == pytest.approx(math.exp(got[i, 9].t_predicted)) for i in (1, 2, 3))
    assert evaluation.staged_scores(df.limit(0), model, "R", ["a", "b"], [1]).count() == 0


@pytest.fixture(scope="module")
def rows(spark):
    rnd = np.random.default_rng(3)
    out = []
    for k in range(300):
        a, b = rnd.random(), rnd.random()
        y = 0 if a < 0.5 else 1 if b < 0.6 else 2
        truth = 20.0
        called = truth if y == 0 else 30.0 if y == 1 else 12.0
        out.append((k, f"g{k % 6}", "train" if k % 2 else "new", 1 + k % 2, float(a), float(b), called, truth, math.log(called / truth), y, 2, 1.0 + k % 3))
    return spark.createDataFrame(out, "id int, g string, cell string, unit int, a double, b double, called double, truth double, t double, y int, tol int, w double").cache()


def test_learning_curves(spark, model, rows):
    strata = {"single": F.col("unit") == 1, "longer": F.col("unit") > 1}
    got = {(r.cell, r.stratum, r.size): r for r in evaluation.learning_curves(rows, rows, model, "R", ["a", "b"], [1, 3], "y", "called", "truth", strata, weight="w").collect()}
    assert len(got) == 4 and sum(r.n for k, r in got.items() if k[2] == 1) == 300
    # Recalibrated on the rows themselves, more iterations separate the classes no worse.
    assert got["train", "longer", 3].log_loss < got["train", "longer", 1].log_loss + 0.05
    own = [r for r in rows.collect() if r.cell == "train"]
    raw = sum(r.w * abs(r.called - r.truth) for r in own) / sum(r.w for r in own)
    assert got["train", "longer", 1].mae_raw == pytest.approx(raw) and got["train", "longer", 3].mae_raw == pytest.approx(raw)


def test_learning_curves_without_weights_or_classes(spark, model, rows):
    strata = {"all": F.lit(True)}
    # A single class in the calibration rows: its probabilities pass through.
    got = evaluation.learning_curves(rows, rows.filter("y = 0"), model, "R", ["a", "b"], [2], "y", "called", "truth", strata).collect()
    data = rows.collect()
    for cell in ("train", "new"):
        own = [r for r in data if r.cell == cell]
        raw = sum(abs(r.called - r.truth) for r in own) / len(own)
        new, loss = 0.0, 0.0
        for r in own:
            t, p = by_hand((r.a, r.b), 2)
            factor = round(math.exp(t), 3)
            new += abs((np.rint(r.called / factor) if round(p[0], 3) < 0.5 else r.called) - r.truth) / len(own)
            loss += -math.log(p[r.y]) / len(own)
        (r,) = [g for g in got if g.cell == cell]
        assert (r.n, r.mae_raw, r.mae_gated, r.log_loss) == (len(own), pytest.approx(raw), pytest.approx(new), pytest.approx(loss))


def test_bundle_of_a_regime(spark, rows, tmp_path):
    def fit(train):
        median = ml.fit_median(train, ["a", "b"], "t", iterations=3)
        direction = ml.fit_direction(train, ["a", "b"], "y", trees=5)
        return lambda df: ml.with_predictions(df, ["a", "b"], median, direction)

    folds = spark.createDataFrame([(f"g{g}", f, "test" if g % 2 == f else "train") for g in range(6) for f in range(2)], "g string, fold int, role string")
    found, predictions = evaluation.evaluation_bundle(rows, folds, "g", ["id"], fit, "called", "truth", "t", "y", "tol", rankings=["a", "b"], ablation_sizes=[0, 2])
    got = {(r.part, r.item, r.metric): r.value for r in found.collect()}
    assert got["rows", "", "n_rows"] == 300 and got["size", "", "n"] == 300 and predictions.select("id").distinct().count() == 300
    assert got["direction", "", "accuracy"] > 0.9 and got["gated", "", "mae_gated"] < got["gated", "", "mae_raw"]
    assert sum(v for k, v in got.items() if k[0] == "confusion" and k[2] == "n") == 300
    assert got["importance direction", "a", "mean"] > 0.1
    assert got["ablation direction", "2", "loss"] < got["ablation direction", "0", "loss"]
    evaluation.write_metrics(found, str(tmp_path / "m"), predictions.select("id", "cell", "p_0", "delta"), str(tmp_path / "p"), ["cell"])
    assert spark.read.json(str(tmp_path / "m")).count() == len(got) and spark.read.parquet(str(tmp_path / "p")).count() == 300


def test_model_documents(spark, model):
    knots = spark.createDataFrame([("R", 1, 0, 0.1, 0.0), ("R", 1, 1, 0.9, 1.0)], "regime string, class int, i int, x double, y double")
    (doc,) = models.model_documents(model, knots).collect()
    d = json.loads(doc.document)
    assert d["q_median"]["baseline"] == 0.1 and len(d["q_median"]["trees"]) == 6 and [len(t) for t in d["direction"]["trees"]] == [3, 3, 3]
    assert d["q_median"]["trees"][1]["nodes"] == [{"feature": 1, "threshold": 0.5, "missing_left": True, "left": 1, "right": 2}, {"leaf": True, "value": -0.1}, {"leaf": True, "value": 0.2}]
    assert d["direction"]["calibrators"][0] == {"x": [], "y": [], "increasing": True} and d["direction"]["calibrators"][1]["x"] == [0.1, 0.9]
    nodes, back = models.model_tables(spark.createDataFrame([doc]))
    assert sorted(map(str, nodes.collect())) == sorted(map(str, model.collect())) and sorted(back.collect()) == sorted(knots.collect())
    broken = spark.createDataFrame([("X", "no json"), ("Y", None)], "regime string, document string")
    assert all(t.isEmpty() for t in models.model_tables(broken))
    assert models.model_documents(model.limit(0), knots.limit(0)).isEmpty()


LEFT, RIGHT = "ACGTTGCAAGCTTACGGATC", "TTGACCATGCGATAGGCTAA"


def test_mark_run_from_reads(spark):
    window = "C" * 5 + "GATTACAGATCCATGACTGA" + LEFT + "CAG" * 4 + RIGHT + "CCATTGACGGATTTACAGGA"
    start = 1000 + 45
    loci = spark.createDataFrame([("L", "1", start, start + 12, "CAG", 1000, window), ("N", "2", start, start + 12, "CAG", 1000, window.replace("A", "N"))], "locus_id string, chrom string, start long, end long, motif string, window_start long, window_seq string")
    seq = LEFT + "CAG" * 9 + RIGHT
    same = LEFT + "CAG" * 4 + RIGHT
    # Person 1's reads contradict a truth of 4 repeats, person 2's don't.
    data = [(1, f"r{k}", 0, "1", start - 20, 60, f"32M15I{len(seq) - 47}M", seq, "I" * len(seq)) for k in range(12)]
    data += [(2, f"r{k}", 0, "1", start - 20, 60, f"{len(same)}M", same, "I" * len(same)) for k in range(12)]
    reads = spark.createDataFrame(data, "person_id int, name string, flag int, chrom string, start long, mapq int, cigar string, seq string, qual string")
    rows = [(p, locus, s, rank, 1 if p < 3 else 0, 4.0, 3) for p in (1, 2, 3) for locus in ("L", "N") for s in ("s1", "s2") for rank in (1, 2)]
    calls = spark.createDataFrame(rows, "person_id int, locus_id string, source string, rank int, dir_code int, truth double, unit int")
    wanted = calls.filter("dir_code <> 0").select("person_id", "locus_id")
    measures, unmeasurable = jobs.measured_people(reads, loci, wanted)
    assert {(r.person_id, r.locus_id, r.length) for r in measures.collect()} == {(1, "L", 27), (2, "L", 12)}
    assert {tuple(r) for r in unmeasurable.collect()} == {(1, "N"), (2, "N")}
    marked, judged, ledger = jobs.marked_by_reads(calls, measures, unmeasurable, source="source")
    assert {(r.person_id, r.locus_id) for r in marked.filter("truth_contradicted").collect()} == {(1, "L")} and marked.count() == len(rows) and marked.filter("truth_contradicted").count() == 4
    assert {(r.person_id, r.locus_id): r.verdict for r in judged.collect()} == {(1, "L"): "contradicted_by_spanning", (1, "N"): jobs.NOT_UNIQUE, (2, "L"): "not_contradicted", (2, "N"): jobs.NOT_UNIQUE}
    assert sum(r.n for r in ledger.collect()) == 4
    odd = calls.withColumn("truth", F.when(F.col("source") == "s2", F.lit(5.0)).otherwise(F.col("truth")))
    with pytest.raises(GuardError, match="truth of"):
        jobs.marked_by_reads(odd, measures, unmeasurable, source="source")
    none = jobs.marked_by_reads(calls.limit(0), measures.limit(0))
    assert all(t.isEmpty() for t in none)
