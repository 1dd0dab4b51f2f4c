import hashlib
import zlib

import pytest
from helpers import SCHEMA, clashing, some_docs
from pyspark.sql import functions as F

from callquality.llm import manifest as M
from callquality.llm.queries import op11_manifest


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, bump=0):
    i, text, lang, source, n = row
    n = None if n is None else n + bump
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n, text)])


def tree(digests, fan):
    """Levels, and for each leaf its siblings by level as (left, right)."""
    levels = [list(digests)]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][k : k + fan]) for k in range(0, len(levels[-1]), fan)])
    paths = []
    for k in range(len(digests)):
        path = []
        for level in levels[:-1]:
            run = k - k % fan
            path.append(("".join(level[run:k]), "".join(level[k + 1 : run + fan])))
            k //= fan
        paths.append(path)
    return levels[-1][0], paths


def expected(rows, fan):
    """(leaf, subroot, path) by group, and the root."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        at = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        subs[g] = ([*zip(at, *[tree([leaf_of(r) for r in at], fan)[1]], strict=True)], tree([leaf_of(r) for r in at], fan)[0])
    root, tops = tree([subs[g][1] for g in order], fan)
    return root, [(leaf_of(r), subs[g][1], path + top) for g, top in zip(order, tops, strict=True) for r, path in subs[g][0]]


@pytest.mark.parametrize(("fan", "stride"), [(2, 10), (2, 2), (3, 1)])
def test_proofs_against_a_tree_in_memory(spark, fan, stride):
    rows = some_docs(40, seed=3) + [(7, "x", g, "s", 1) for g in ("ä", "z", "", "Z", "=")]
    docs = clashing(spark.createDataFrame(rows, SCHEMA)).repartition(5).withColumn("pos", F.lit("x")).withColumn("grp", F.lit("x")).withColumn("a b", F.create_map(F.lit("k"), F.lit(1)))
    docs = docs.withColumn("digest", M.row_digest([F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    built = M.build_manifest(docs, "lang", ["doc_id"], keep=["doc_id", "pos", "grp", "digest", "a b"], fan=fan, stride=stride)
    root, want = expected(rows, fan)
    assert built.root == root
    found = M.inclusion_proofs(built).withColumn("again", M.folded(F.col("digest"), F.col("proof"))).withColumn("all", M.proof_digest(F.col("proof"))).collect()
    got = sorted((r["digest"], r["subroot"], tuple((s["left"], s["right"]) for s in r["proof"])) for r in found)
    assert got == sorted((a, b, tuple(c)) for a, b, c in want)
    assert {r["again"] for r in found} == {root}
    assert all(r["all"] == H(*[x for s in r["proof"] for x in s]) and r["row"]["pos"] == "x" for r in found)


def test_written_levels_are_every_stride(spark):
    rows = spark.range(100).select(F.lit("g").alias("g"), "id", F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    built = M.build_manifest(rows, "g", ["id"], stride=3)
    assert [level.count() for level in built.groups.levels] == [100, 13, 2, 1]
    assert [level.count() for level in built.top.levels] == [1, 1]


def test_empty_and_single(spark):
    empty = spark.createDataFrame([], "g string, id long, digest string")
    built = M.build_manifest(empty, "g", ["id"])
    assert built.root is None and M.inclusion_proofs(built).count() == 0
    one = M.build_manifest(spark.createDataFrame([(None, None, "ab")], "g string, id long, digest string"), "g", ["id"])
    assert one.root == "ab" and [list(r["proof"]) for r in M.inclusion_proofs(one).collect()] == [[]]


def test_op11_query(spark, tmp_path):
    rows = some_docs(70, seed=5) + [(-7, "neg", "en", "a", 3), (-7, "neg", "en", "a", 3)]
    clashing(spark.createDataFrame(rows, SCHEMA)).write.parquet(f"{tmp_path}/documents.parquet")
    root, want = expected(rows, 2)
    paths = {(leaf, sub): path for leaf, sub, path in want}
    got = op11_manifest(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    by_leaf = {leaf_of(r): r for r in rows}
    for r in got:
        row = by_leaf[r["leaf"]]
        changed = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
        assert r["doc_id"] == row[0] and r["root"] == root and r["verified"] == (r["folded_root"] == root)
        assert r["verified"] == (not changed or row[4] is None)
        if row[0] != -7 and rows.count(row) == 1:
            path = paths[r["leaf"], r["subroot"]]
            h = leaf_of(row, int(changed))
            for left, right in path:
                h = H(left, h, right)
            assert r["folded_root"] == h and r["proof_sha256"] == H(*[x for s in path for x in s])
