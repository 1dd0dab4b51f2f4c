import os
import sys
import zlib
from collections import Counter
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))

from helpers import SCHEMA, linked, some_docs, words_of  # noqa: E402

import corpus_pipeline  # noqa: E402
from callquality.llm.common import scratch, shared_dir, written  # noqa: E402
from callquality.llm.quality import quality_rules  # noqa: E402

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good(rows):
    """Rows with enough words, few repeats, and two stop words, as the fixture breaks no other rule."""
    out = []
    for r in rows:
        w = words_of(r[1])
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [x for x in (r[1] or "").split("\n") if words_of(x)]
        if len(w) >= 50 and 100 * len(covered) <= 50 * len(w) and 2 * (len(lines) - len(set(lines))) <= len(lines) and sum(x == "the" for x in w) >= 2:
            out.append(r)
    return out


def trimmed(rows, length=50):
    first = {}
    for i, text, *_ in rows:
        data = (text or "").encode()
        for k in range(len(data) - length + 1) if i is not None else ():
            first[data[k : k + length]] = min(first.get(data[k : k + length], i), i)
    out = []
    for r in rows:
        data = (r[1] or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1) if r[0] is not None else ():
            if first[data[k : k + length]] < r[0]:
                gone[k : k + length] = b"\1" * length
        rest = bytes(x for x, y in zip(data, gone, strict=True) if not y).decode("utf-8", "ignore")
        out.append((r[0], rest, *r[2:4], len(rest) if any(gone) else r[4]))
    return out


def copies(rows):
    size = Counter()
    for r in rows:
        size[r[3]] += len(words_of(r[1]))
    names = [*sorted((s for s in size if s is not None), key=str.encode), *([None] if None in size else [])]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        rest = 1.5 * sum(size.values()) - sum(2 * size[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 2 * size[s]}
        if not over:
            break
        full |= over
    out = []
    for r in rows:
        rate = share.get(r[3], 2 * size[r[3]]) / size[r[3]] if size[r[3]] else 0
        drawn = int(md5(f"mix-1|{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16) / 2**32
        out += [r] * (int(rate) + (drawn < rate - int(rate)))
    return out


def test_stages_equal_brute_force(spark, tmp_path):
    rows = [(i, t and t.replace("changed", "the the changed"), *rest) for i, t, *rest in some_docs(80, 4)]
    rows = [(i, t and f"the {t} the", *rest) for i, t, *rest in rows]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    as_rows = lambda df: Counter(tuple(r[c] for c in COLUMNS) for r in df.collect())

    kept = good(rows)
    assert as_rows(corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))) == Counter(kept)
    near = linked(kept, 5, 80)
    single = [r for r in kept if r[0] is None or near[r[0]] == r[0]]
    unlike = trimmed(single)
    many = copies(unlike)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = Counter()
    for i, text, *_ in many:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert len(kept) < len(rows) and len(single) < len(kept) and unlike != single
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = Counter()
    for r in got:
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 1024


def test_trimmed_texts_keep_their_own_replacement_characters(spark):
    passage = "".join(chr(97 + k * k % 23) for k in range(70))
    texts = [f"ĩ{passage}é", f"\ufffdé{passage} end", f"begin {passage}è\ufffd", f"{passage} \ufffd\ufffd", f"\ufffd{passage}\ufffd", "\ufffd alone"]
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    want = trimmed(rows)
    assert [r[1] for r in want[1:]] == ["\ufffd end", "begin \ufffd", "\ufffd\ufffd", "\ufffd\ufffd", "\ufffd alone"]
    got = corpus_pipeline.unrepeated_text(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert Counter(tuple(r[c] for c in COLUMNS) for r in got) == Counter(want)


def test_stages_keep_the_columns_and_nulls(spark):
    rows = [(None, "the and " + "word of many kinds " * 3, None, None, None), (1, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == list(COLUMNS)
        assert stage(spark, docs.limit(0), "").count() == 0
    assert corpus_pipeline.STAGES[1][1](spark, docs, "").count() == 2
    assert sorted(r.text is None for r in corpus_pipeline.STAGES[2][1](spark, docs, "").collect()) == [False, True]
    assert quality_rules(docs).filter("quality_rules.kept").count() == 0


def test_stages_with_columns_of_any_name(spark):
    names = ("kept", "Spans", "n_bytes", "no_text", "rules", "away", "doc", "codes", "component_id", "mix", "copies", "size", "sequence_id")
    docs = spark.createDataFrame([(i, *rest) for i, (_, *rest) in enumerate(some_docs(30, 6))], SCHEMA)
    wide = docs
    for n in names:
        wide = wide.withColumn(n, F.concat(F.lit(n), F.col("doc_id")))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got, want = stage(spark, wide, ""), stage(spark, docs, "")
        assert got.columns == [*COLUMNS, *names]
        assert all(r[n] == f"{n}{r.doc_id}" for r in got.collect() for n in names)
        assert Counter(tuple(r[c] for c in COLUMNS) for r in got.collect()) == Counter(tuple(r[c] for c in COLUMNS) for r in want.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, wide, "").count() == corpus_pipeline.STAGES[-1][1](spark, docs, "").count()


def tables_of(spark):
    folder = shared_dir(spark).removeprefix("file:")
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_near_duplicates_leave_only_the_table_of_their_result(spark):
    docs = spark.createDataFrame(some_docs(40, 7), SCHEMA)
    before = tables_of(spark)
    kept = corpus_pipeline.distinct_documents(spark, docs, "")
    left = tables_of(spark) - before
    assert [x.rsplit("-", 1)[0] for x in left] == ["near-duplicates"]
    near = linked(some_docs(40, 7), 5, 80)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(i for i, *_ in some_docs(40, 7) if i is None or near[i] == i)


def test_scratch_tables_go_after_a_failure_too(spark):
    before = tables_of(spark)
    with pytest.raises(RuntimeError), scratch(spark):
        written(spark.range(3), "goes")
        stays = written(spark.range(4), "stays", stay=True)
        raise RuntimeError
    after = written(spark.range(5), "after")
    assert sorted(x.rsplit("-", 1)[0] for x in tables_of(spark) - before) == ["after", "stays"]
    assert (stays.count(), after.count()) == (4, 5)
