"""Brute-force versions and small tables for the training-data operators."""

import hashlib
import random
import re

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return WORD.findall(text or "")


def some_docs(n=60, seed=1):
    """Documents with copies, near copies, shared passages, empty, null and very long texts, and null columns."""
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rnd.choice(pool) for _ in range(60))
    rows = []
    for i in range(n):
        kind = rnd.random()
        text = " ".join(rnd.choice(pool) for _ in range(rnd.randint(1, 150)))
        if kind < 0.2 and rows:
            text = rnd.choice(rows)[1]
        elif kind < 0.4 and rows:
            w = (rnd.choice(rows)[1] or "x").split(" ")
            w[rnd.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind < 0.6:
            text = text[: len(text) // 2] + "\n" + passage + "\n" + text[len(text) // 2 :]
        rows.append((i * 3, text, rnd.choice(["en", "fr", None]), rnd.choice(["a", "b", "ä", None]), len(text)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (1002, "   \n\t ", "en", "b", 6), (None, passage, None, None, None)]
    rows += [(1003, " ".join(rnd.choice(pool) for _ in range(30_000)), "en", "a", None), rows[3], rows[3]]
    return rows


def shingle_set(text, width):
    w = words_of((text or "").translate(LOWER))
    if len(w) >= width:
        return frozenset(tuple(w[k : k + width]) for k in range(len(w) - width + 1))
    return frozenset([tuple(w)]) if w else frozenset()


def linked(rows, width, percent):
    """doc_id -> smallest id reachable."""
    sets = [(r[0], shingle_set(r[1], width)) for r in rows if r[0] is not None]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets:
        for j, t in sets:
            if j < i and s and t and 100 * len(s & t) >= percent * len(s | t):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in parent}


def without_repeats(rows, length=50):
    """doc_id -> (bytes, removed, spans, sha256 of the rest)."""
    first = {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1) if i is not None else ():
            s = data[k : k + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1) if i is not None else ():
            if first[data[k : k + length]] < i:
                gone[k : k + length] = b"\1" * length
        rest = bytes(x for x, y in zip(data, gone, strict=True) if not y)
        out[i] = (len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(rest).hexdigest())
    return out


def clashing(df):
    """The table with more columns, under names that operators use inside."""
    from pyspark.sql import functions as F

    for name in ("doc", "n", "hi", "codes", "rank", "length", "source_size", "_mix_target", "draw", "stats", "component", "first", "bucket", "kept"):
        df = df.withColumn(name, F.lit("x"))
    return df
