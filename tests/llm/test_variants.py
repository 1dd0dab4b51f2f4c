import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import LOWER, SCHEMA, clashing, some_docs
from pyspark.sql import functions as F

from callquality.llm import variants as V
from callquality.llm.queries import op13_variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def grouped(n):
    """word -> (form, root, n, n_near, form_n)."""
    close = {w: [v for v in n if near(w, v)] for w in n}
    form = {w: min(c, key=lambda v: (-n[v], v)) if (c := close[w]) and max(n[v] for v in c) >= 5 * n[w] else None for w in n}

    def root(w):
        return w if form[w] is None else root(form[w])

    return {w: (form[w], root(w), n[w], len(close[w]), n[form[w]] if form[w] else None) for w in n}


def some_words(seed=2):
    rnd = random.Random(seed)
    base = ["".join(rnd.choice("abcéÿ×") for _ in range(rnd.randint(6, 9))) for _ in range(60)] + ["aaaaaaa", "y" * 64, "y" * 65, "y" * 66, "yé" * 300]
    n = {w: rnd.choice([5, 7, 30, 200, 4000]) for w in base}
    for w in list(n):
        for _ in range(3):
            k, c = rnd.randrange(len(w)), rnd.choice("abcéz")
            v = rnd.choice([w[:k] + c + w[k + 1 :], w[:k] + c + w[k:], w[:k] + w[k + 1 :]])
            if len(v) >= 6:
                n.setdefault(v, rnd.choice([5, 6, 25, 800]))
    return n


@pytest.mark.parametrize("most_bytes", [1 << 20, 128])
def test_variants_against_all_pairs(spark, monkeypatch, most_bytes):
    monkeypatch.setattr(V, "MOST_BYTES", most_bytes)
    monkeypatch.setattr(V, "EDITS", 3000)
    n = some_words()
    found = V.group_variants(spark.createDataFrame(list(n.items()), "word string, n long").repartition(3))
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in found.collect()} == grouped(n)


def test_filters_miss_nothing():
    rnd = random.Random(1)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(8)) for _ in range(500)]
    points = V._points(words, np.arange(len(words)), 8)
    seen = {}
    for size, h, row, place, letter in V._edits(points, V._prefixes(points), np.array([97, 98, 233], np.uint32), 6):
        for x, r, p, c in zip(h.tolist(), row.tolist(), place.tolist(), letter.tolist(), strict=True):
            w = words[r][:p] + (chr(c) if c >= 0 else "") + words[r][p + 1 :]
            assert len(w) == size
            seen[w] = x
    some = list(seen)[:300]
    for w in some:
        assert int(V._hash(V._prefixes(V._points([w], np.arange(1), len(w)))[:, -1], len(w))[0]) == seen[w]


def test_vocabulary_counts(spark):
    rows = [("Straße straße STRASSE",), (None,), ("",), ("naïve, naïve... ÀÉÀ×÷ÿa àéà",)]
    runs = spark.createDataFrame(rows, "text string").select(F.explode(V.letter_runs(F.col("text"))).alias("word"))
    got = {r["word"]: r["n"] for r in V.vocabulary(runs, least_length=3, least_count=1).collect()}
    assert got == {"straße": 2, "strasse": 1, "naïve": 2, "ÀÉÀ×÷ÿa": 1, "àéà": 1}


def test_empty(spark):
    assert V.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    with pytest.raises(ValueError, match="upwards"):
        V.group_variants(spark.createDataFrame([], "word string, n long"), times=1)


def test_op13_query(spark, tmp_path):
    rows = some_docs(80, seed=4)
    n = some_words(9)
    rows += [(5000 + k, ", ".join(w.replace("a", "A") for w in n if k % max(1, 200 // n[w]) == 0), "en", "a", 0) for k in range(200)] + [(6000, "w1" + "abcdefg " * 300, None, None, None)]
    clashing(spark.createDataFrame(rows, SCHEMA)).repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    count = Counter()
    for i, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{i}:{run}".encode()) if i is not None else 1
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    want = grouped({w: k for w, k in count.items() if len(w) >= 6 and k >= 5})
    got = op13_variants(spark, str(tmp_path)).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert any(v[0] for v in want.values())
