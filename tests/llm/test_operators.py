import hashlib
import io
import os
import random
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(__file__))

from helpers import SCHEMA, clashing, linked, shingle_set, some_docs, without_repeats, words_of  # noqa: E402

from callquality.llm import jaccard, langid, merkle, mixing, packing, quality, rulefit, suffix, warc  # noqa: E402
from callquality.llm.chat import escape, format_chats, loss_texts, read_turns, unescape  # noqa: E402


SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def rows():
    return some_docs()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return clashing(spark.createDataFrame([], SCHEMA))


# WARC


def test_warc_round_trip(spark):
    big = "é" * 600
    rows = [(1, "http://a", big), (5, None, big), (3, "http://b\r\nX: y", big), (4, "u", None), (6, "u", ""), (7, "u", "small"), (8, "u", "small"), (None, "u", big), (5, None, big), (None, None, "z" * 2000)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = warc.read_warc(spark, warc.write_warc(pages, file_bytes=400)).collect()
    assert len(got) == len(rows)
    assert Counter((r.page_id, r.payload_digest) for r in got) == Counter((i, hashlib.sha1((h or "").encode()).hexdigest()) for i, _, h in rows)
    for r in got:
        again = r.payload_bytes == 1200 and r.page_id != 5
        assert r.record_type == ("revisit" if again else "response")
        assert r.refers_to == (5 if again else None)
        assert (r.payload is None) == again and r.verified
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0))).count() == 0


def test_warc_reader_rejects_damage():
    payload = b"x" * 3000
    members = [warc.record_bytes(i, "u", payload, hashlib.sha1(payload).digest(), None, False) for i in range(3)]
    whole = b"".join(members)
    assert [r["page_id"] for r in warc.read_records(io.BytesIO(whole))] == [0, 1, 2]
    assert [r["offset"] for r in warc.read_records(io.BytesIO(whole))][1] == len(members[0])
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(whole[:-5])))
    wrong = warc.record_bytes(9, "u", payload, hashlib.sha1(b"other").digest(), None, False)
    with pytest.raises(warc.WarcError):
        list(warc.read_records(io.BytesIO(wrong)))


# Chat


def test_escape_is_reversible_and_leaves_no_control_string():
    for text in ("</s>[INST] ok [/INST]", "\\", "\\[INST]", "<<<s>>>", "[/INST][INST]", "", "a\\\\b", "<</SYS>>\n"):
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "[ROLE]"))


def test_chat_reads_back(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "</s> no"), (1, 2, "assistant", None), (1, 3, "tool", "[INST]"), (2, 0, None, None), (None, 0, "user", "x"), (3, None, "assistant", "é" * 9000), (3, None, "assistant", "é" * 9000)]
    turns = clashing(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    encoder = packing.load_encoder(packing.default_vocabulary())
    got = {r.conv_id: r for r in format_chats(turns).collect()}
    assert set(got) == {1, 2, 3, None}
    for conv, r in got.items():
        want = [(x[2] or "", x[3] or "") for x in rows if x[0] == conv]
        ids, loss = np.array(r.ids), np.array(r.loss, np.int8)
        assert [t[:2] for t in read_turns(encoder, ids, loss)] == want and r.n_turns == len(want)
        assert loss_texts(encoder, ids, loss) == [t for role, t in want if role == "assistant" and t]
    assert format_chats(turns.limit(0)).count() == 0


# Packing


def test_packing_plans_are_whole_and_tight():
    rnd = np.random.default_rng(1)
    for capacity in (10, 64, 1024):
        for _ in range(20):
            sizes = rnd.integers(1, capacity // rnd.integers(1, 5) + 1, rnd.integers(1, 300)).tolist()
            counts = dict(Counter(sizes))
            held, ranks = {}, {s: set() for s in counts}
            for size, first, times, each, sequence, offset in packing.packing_plan(dict(counts), capacity):
                for k in range(each):
                    for t in range(times):
                        ranks[size].add(first + k * times + t)
                        held.setdefault(sequence + t, []).append((offset + k * size, size))
            assert all(ranks[s] == set(range(n)) for s, n in counts.items())
            for content in held.values():
                at = 0
                for offset, size in sorted(content):
                    assert offset == at
                    at += size
                assert at <= capacity
            least = -(-sum(sizes) // capacity)
            assert len(held) <= max(least + 2, least * 11 // 9 + 1, sum(s > capacity // 2 for s in sizes) + 1)


def test_dominance_fixes_perfect_pairs_and_loners():
    fixed, left = packing.reduce_by_dominance({7: 2, 3: 1, 10: 1, 6: 1}, 10)
    assert ((10,), 1) in fixed and ((7, 3), 1) in fixed and ((7,), 1) in fixed and not left


def fewest(sizes, capacity):
    """The least number of sequences, by trying every place of every piece."""
    sizes = sorted(sizes, reverse=True)
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for room in {r for r in rooms if r >= sizes[k]}:
            at = rooms.index(room)
            place(k + 1, (*rooms[:at], room - sizes[k], *rooms[at + 1 :]))
        place(k + 1, (*rooms, capacity - sizes[k]))

    place(0, ())
    return best


def test_fixed_sets_cost_no_sequence():
    sizes = [60, 43, 42, 38, 37, 31, 25, 15]
    assert fewest(sizes, 100) == 3
    assert len({s + t for _, _, times, _, s, _ in packing.packing_plan(Counter(sizes), 100) for t in range(times)}) == 3
    rnd, triples = np.random.default_rng(5), 0
    for k in range(1500):
        capacity = (30, 100)[k % 2]
        sizes = rnd.integers(max(1, capacity // 8), capacity * (5, 7)[k % 3 == 0] // 10, rnd.integers(3, 10)).tolist()
        fixed, left = packing.reduce_by_dominance(Counter(sizes), capacity)
        assert all(sum(content) <= capacity for content, _ in fixed)
        assert Counter(sizes) == Counter([s for content, times in fixed for s in content * times]) + Counter(left)
        assert sum(t for _, t in fixed) + fewest(Counter(left).elements(), capacity) == fewest(sizes, capacity)
        triples += any(len(content) == 3 for content, _ in fixed)
    assert triples > 20


def test_packed_documents(docs, rows, empty):
    from tokenizers import Tokenizer

    import public_tokenizers

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack_documents(docs).collect()
    want = Counter()
    for i, text, *_ in rows:
        ids = np.array([*model.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for content in by.values():
        assert [o for o, _ in sorted(content)] == [sum(n for _, n in sorted(content)[:k]) for k in range(len(content))]
        assert sum(n for _, n in content) <= 1024
    assert packing.pack_documents(empty).count() == 0


def test_added_tokens_in_texts_get_their_own_ids(spark):
    from tokenizers import Tokenizer

    import corpus_pipeline
    import public_tokenizers

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    texts = [end, f"a  {end} b{end}{end}\n\n {end}", f"<|endoftext|{end}|>", "<|endoftext", f"é{end}ü  ", f"one two  {end} three " * 400]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = Counter()
    for i, text in enumerate(texts):
        ids = np.array([*model.encode(text, add_special_tokens=False).ids, 2], "<u4")
        assert (50256 in ids) == (end in text)
        cuts = [0, *range(len(ids) % 1024 or 1024, len(ids) + 1, 1024)] if len(ids) > 1024 else [0, len(ids)]
        want.update((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    for got in (packing.pack_documents(docs), corpus_pipeline.packed(spark, docs, "")):
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got.collect()) == want
    assert 50256 not in packing.load_encoder(packing.default_vocabulary()).encode_ordinary(end)  # plain text in chats


# Fingerprints


def test_merkle_trees_tell_equal_from_edited():
    text = "".join(f"Sentence {k} of many. Another one here, {k * k}.\nA line {k}\n\nSection {k}. " for k in range(40))
    a, b = merkle.merkle_tree(text), merkle.merkle_tree(text[:700] + "XX" + text[702:])
    assert merkle.fingerprint(a) == merkle.fingerprint(merkle.merkle_tree(text)) != merkle.fingerprint(b)
    assert 0.8 < merkle.likeness(a, b) < 1 and merkle.likeness(a, a) == 1
    spans = merkle.edits(a, b)
    assert len(spans) == 1 and spans[0][0] <= 700 < spans[0][1]
    assert merkle.likeness(merkle.merkle_tree(None), merkle.merkle_tree("")) == 1
    assert merkle.likeness(merkle.merkle_tree(""), a) == 0


def test_neighbours_are_the_next_in_order(spark, docs, rows, empty):
    pair = lambda i, t, tree, after, next_tree: (i, t, after)
    schema = "doc_id long, t string, after string"
    got = {(r.doc_id, r.t, r.after) for r in merkle.compare_neighbours(docs.filter("doc_id <> 9"), pair, schema).collect()}
    ordered = sorted((r for r in rows if r[0] not in (None, 9)), key=lambda r: r[0])
    want = {(a[0], a[1] or "", b[1] or "") for a, b in zip(ordered, ordered[1:] + ordered[:1], strict=True)}
    assert {g for g in got if g[0] is not None} == want
    assert merkle.compare_neighbours(empty, pair, schema).count() == 0
    assert merkle.compare_neighbours(docs.filter("doc_id = 0"), pair, schema).count() == 1


def test_fingerprint_query(spark, tmp_path):
    from callquality.llm.queries import op4_fingerprint

    rows = [r for r in some_docs(40, 9) if r[0] is not None]
    rows = list({r[0]: r for r in [*rows, (5000, "twin text. " * 40, None, None, None), (5001, "twin text. " * 40, None, None, None)]}.values())
    clashing(spark.createDataFrame(rows, SCHEMA)).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in op4_fingerprint(spark, str(tmp_path)).collect()}
    ordered = sorted((r[0], r[1] or "") for r in rows)
    assert len(got) == len(rows)
    for (i, text), (_, after) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        trees = [merkle.merkle_tree(t) for t in (text, edited, after)]
        want = (len(text), hashlib.sha256(edited.encode()).hexdigest(), merkle.fingerprint(trees[0]), merkle.fingerprint(trees[1]), merkle.likeness(*trees[:2]), merkle.likeness(trees[0], trees[2]))
        assert (got[i].n_chars, got[i].edited_sha256, got[i].fingerprint, got[i].edited_fingerprint, got[i].near_edited, got[i].near_next) == want
        assert (got[i].fingerprint == got[i].edited_fingerprint) == (text == edited) and 0 <= got[i].near_edited <= 1
    assert got[5000].fingerprint == got[5001].fingerprint and got[5000].near_next == 1


# Language


def test_language(spark, empty):
    rnd = np.random.default_rng(2)
    kinds = {"aa": ["lopo", "mimu", "pelo", "lumi", "popi"], "bb": ["straz", "grzy", "szcz", "trzk", "zgrat"]}
    make = lambda k, n: " ".join("".join(rnd.choice(kinds[k], 2)) for _ in range(n))
    rows = [(i, make(k, 80), k) for i, k in enumerate(["aa", "bb"] * 40)] + [(900, None, "aa"), (901, "12 !!", "aa"), (903, "²½ ①", "aa"), (904, make("aa", 40_000), None), (905, make("bb", 60) + " ²", None), (905, make("bb", 60) + " ²", None), (902, make("bb", 60).upper(), None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    dictionaries = langid.learn_dictionaries(docs.filter("doc_id < 40"), sample_docs=10)
    assert set(dictionaries) == {"aa", "bb"} and all(len(d) <= 1 << 16 for d in dictionaries.values())
    got = {r.doc_id: r.language for r in langid.identify_language(docs, dictionaries).collect()}
    assert all(got[i].best == k for i, _, k in rows[:80]) and got[902].best == "bb"
    assert got[900].best == got[901].best == got[903].best == got[900].lang == "und" and got[900].score == 0
    assert got[904].best == "aa" and got[905].best == "bb"
    assert all(0 <= g.score <= 1 for g in got.values())
    whole = langid.learn_dictionaries(spark.createDataFrame([(1, "la " * 3000 + "fin", "aa")], "doc_id long, text string, lang string"))
    assert b" la fin " in whole["aa"] and b" la la " in whole["aa"]  # the end of a text counts as its middle does
    tied = {"aa": dictionaries["aa"], "zz": dictionaries["aa"]}
    assert langid.identify_language(docs.filter("doc_id = 0"), tied).first().language.best == "aa"
    assert langid.learn_dictionaries(empty) == {}
    assert langid.identify_language(empty, dictionaries).count() == 0


def test_language_of_held_out_documents(spark):
    from callquality.llm.queries import op5_language

    got = {r.doc_id: r for r in op5_language(spark, SF).collect()}
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()
    assert len(got) == len(rows) and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 for i, r in got.items())
    told = [got[r.doc_id].lang_pred == r.lang for r in rows if r.lang is not None and got[r.doc_id].held_out]
    assert len(told) > 200 and sum(told) >= 0.98 * len(told)


# Quality rules and the classifier


def test_quality_statistics(docs, rows, empty):
    got = {r.doc_id: r.quality_rules for r in quality.quality_rules(docs).collect()}
    for i, text, *_ in rows:
        w, text = words_of(text), text or ""
        windows = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {p for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for p in (k, k + 1, k + 2)}
        lines = [line for line in text.split("\n") if words_of(line)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
        if i is not None:
            assert (got[i].n_words, got[i].word_chars, got[i].n_symbols, got[i].n_dup_lines, got[i].n_repeat_words) == want
            assert got[i].base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
            assert not (got[i].base_failed and got[i].kept)
    assert quality.quality_rules(empty).count() == 0


def test_quality_rules_reject_junk_and_run_without_python(spark):
    clean = "The river of the north is long and it was known for a very old bridge that stands on two piers of grey stone near the town where a mill and an inn have been since the time of the first kings who came by ship with many men from the south to trade wool for iron and salt"
    docs = spark.createDataFrame([(1, clean), (2, clean.upper().replace(" ", "!! ")), (3, clean.replace(" ", "### ")), (4, "word " * 90)], "doc_id long, text string")
    found = quality.quality_rules(docs)
    assert {r.doc_id: r.quality_rules.kept for r in found.collect()} == {1: True, 2: False, 3: False, 4: False}
    assert "Python" not in found._jdf.queryExecution().toString()


def test_rule_ensemble(spark, empty):
    words = "the and of in to river stone bridge"
    rows = [(i, (words + (" ### $$$ " if i % 4 == 0 else " ok ")) * (5 + i % 7), int(i % 4 != 0)) for i in range(200)] + [(500, None, 1), (501, "", None)]
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    labels = docs.select("doc_id", "quality").filter("doc_id < 150")
    model = rulefit.fit_rules(rulefit.labelled_examples(docs.drop("quality"), labels))
    assert model.rules
    got = {r.doc_id: r.quality for r in rulefit.score_quality(docs, model).collect()}
    assert len(got) == 202 and all(0 <= g.score <= 1 and g.predicted == int(g.score >= 0.3) for g in got.values())
    assert max(got[i].score for i in range(152, 200, 4)) < min(got[i].score for i in range(150, 200) if i % 4)
    none = rulefit.fit_rules(rulefit.labelled_examples(docs.drop("quality"), labels.limit(0)))
    assert none.rules == () and none.intercept == 0
    assert rulefit.score_quality(empty, none).count() == 0


def test_quality_of_held_out_documents(spark):
    from callquality.llm.queries import op7_quality_classifier

    got = {r.doc_id: r for r in op7_quality_classifier(spark, SF).collect()}
    assert len(got) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r.doc_id in got and r.quality is not None}
    out = [(got[i].score, q) for i, q in labels.items() if got[i].held_out]
    good, bad = [s for s, q in out if q == 1], [s for s, q in out if q == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad)
    assert good and bad and wins >= 0.95 * len(good) * len(bad)


def test_rule_ensemble_with_ties_repeats_and_long_texts(spark):
    rows = [(i % 40, ("and the " * 60 if i % 2 else "# $ ") + "x " * (30_000 if i == 7 else 3), i % 2) for i in range(80)]
    rows += [(i, t, 1 - q) for i, t, q in rows[:4]]  # one document under both labels
    docs = clashing(spark.createDataFrame(rows, "doc_id long, text string, quality int"))
    model = rulefit.fit_rules(rulefit.labelled_examples(docs.drop("quality").dropDuplicates(["doc_id"]), docs.select("doc_id", "quality")))
    got = rulefit.score_quality(docs, model).collect()
    assert len(got) == len(rows) and len({(r.doc_id, r.quality.score) for r in got}) == 40
    assert min(r.quality.score for r in got if r.doc_id % 2) > max(r.quality.score for r in got if r.doc_id % 2 == 0)


def test_tree_paths():
    told = "DecisionTree\n  If (feature 0 <= 3.5)\n   If (feature 2 <= 1.0)\n    Predict: 1.0\n   Else (feature 2 > 1.0)\n    Predict: 0.0\n  Else (feature 0 > 3.5)\n   Predict: 0.0\n"
    assert {len(p) for p in rulefit.tree_paths(told)} == {1, 2} and len(rulefit.tree_paths(told)) == 4


# Mixing


def test_mixing(spark, docs, rows, empty):
    got = mixing.mixing_plan(docs).select("doc_id", "source", "mix.*").collect()
    size = Counter()
    for _, text, _, source, _ in rows:
        size[source] += len(words_of(text))
    names = [*sorted((s for s in size if s is not None), key=lambda s: s.encode()), None]
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    target, total, full = {}, 1.5 * sum(size.values()), set()
    while True:
        rest = total - sum(2 * size[s] for s in full)
        share = {s: rest * weight[s] / sum(weight[x] for x in names if x not in full) for s in names if s not in full}
        over = {s for s in share if share[s] > 2 * size[s]}
        if not over:
            target = {s: share.get(s, 2 * size[s]) for s in names}
            break
        full |= over
    for r in got:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.copies <= 2
    assert sum(r.copies for r in got) == mixing.mix(docs).count()
    assert mixing.mix(docs).columns == docs.columns
    assert {(r.doc_id, r.copies) for r in got} == {(r.doc_id, r.copies) for r in mixing.mixing_plan(docs.repartition(7)).select("doc_id", "mix.*").collect()}
    assert mixing.mix(empty).count() == 0


# Suffix deduplication


@pytest.mark.parametrize("many", [0, 2, 64])
def test_repeated_bytes(spark, docs, rows, empty, many, monkeypatch):
    monkeypatch.setattr(suffix, "MANY_PHRASES", many)
    got = suffix.repeated_bytes(docs, keep=("source",)).collect()
    want = without_repeats(rows)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, hashlib.sha256(r.kept).hexdigest()) == want[r.doc_id]
    assert suffix.repeated_bytes(empty).count() == 0


def test_a_trigger_with_many_phrases_sends_one_a_task_to_its_bucket():
    trigger = np.array([1] * 3 + [2] * 500 + [3] * 200, np.uint64)
    phrase = np.array([7, 8, 9, *range(500), *[5] * 200], np.uint64)
    meet, many = suffix.crowded(trigger, phrase, np.arange(703), 64)
    assert meet.tolist() == [0, 1, 2, 3, *range(503, 703)] and many.tolist() == list(range(3, 503))
    assert [len(x) for x in suffix.crowded(trigger[:0], phrase[:0], np.arange(0), 64)] == [0, 0]


def test_passages_with_many_neighbours(spark, monkeypatch):
    """One passage in all documents, each with other bytes round it: all phrases at its edges differ."""
    rnd = np.random.default_rng(3)
    word = lambda n: "".join(map(chr, rnd.integers(97, 123, n)))
    passage = word(120)
    rows = [(k, word(40) + passage + word(40), "en", "a", 200) for k in range(300)]
    for many in (8, 64):
        monkeypatch.setattr(suffix, "MANY_PHRASES", many)
        got = suffix.repeated_bytes(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(3)).collect()
        want = without_repeats(rows)
        assert {r.doc_id: (r.n_bytes, r.n_bytes - len(r.kept), len(r.spans) // 2, hashlib.sha256(r.kept).hexdigest()) for r in got} == want


def test_texts_are_shuffled_once(spark, docs):
    """The step that sends open phrases and the last one read the same shuffle of the texts."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for keep in ((), ("lang", "source")):
            found = suffix.repeated_bytes(docs, keep=keep)
            found.collect()
            plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
            assert plan.count("SortMergeJoin") == 3
            of_texts = re.findall(r"ReusedExchange \[doc#\w+, text#[^\n]*\], Exchange hashpartitioning", plan)
            assert len(of_texts) == 1 and plan.count("- Exchange hashpartitioning(doc#") == 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_long_texts_are_cut_into_segments_alike(monkeypatch):
    rnd = np.random.default_rng(5)
    data = rnd.integers(97, 101, 6000).astype(np.uint8)
    whole = [(o + p.pos, o + p.first, p.count, p.phrase) for o, p in suffix.phrases(data, np.array([0, 6000]), suffix.Parsing())]
    monkeypatch.setattr(suffix, "SEGMENT_BYTES", 1000)
    cut = [(o + p.pos, o + p.first, p.count, p.phrase) for o, p in suffix.phrases(data, np.array([0, 6000]), suffix.Parsing())]
    strings = lambda found: {s + k: (int(a), int(h)) for pos, first, count, phrase in found for a, s, n, h in zip(pos, first, count, phrase, strict=True) for k in range(n)}
    assert strings(whole) == strings(cut) and len(strings(whole)) == 5951


# Jaccard join


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_components(spark, docs, rows, empty, width, percent):
    got = jaccard.jaccard_components(docs, width=width, percent=percent).collect()
    want = linked(rows, width, percent)
    assert len(got) == len(rows) and len(set(want.values())) < len(want)
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.n_shingles == len(shingle_set(text[r.doc_id], width))
    if width == 5:
        assert jaccard.jaccard_components(empty).count() == 0
        left = jaccard.near_duplicates_dropped(docs, width=width, percent=percent)
        assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == sorted(r[0] for r in rows if r[0] is not None and want[r[0]] == r[0])


def chance_docs(n, seed=3):
    """Texts of 400 words that share n-grams by chance, the last 12 near copies of the first."""
    rnd = random.Random(seed)
    texts = [" ".join(f"w{rnd.randrange(54)}" for _ in range(400)) for _ in range(n - 12)]
    for k in range(12):
        w = texts[0].split(" ")
        w[20 + 30 * k] = "changed"
        texts.append(" ".join(w))
    return [(k, text) for k, text in enumerate(texts)]


def test_full_sketch_leaves_no_lists_of_chance_matches(spark, monkeypatch):
    """With a sketch that tells nothing any more, exact counts keep documents without near copies out of the lists."""
    seen = []
    keep = jaccard.link_components
    monkeypatch.setattr(jaccard, "frequency_sketch", lambda classes: np.zeros(1 << jaccard.SKETCH_BITS, np.uint32))
    monkeypatch.setattr(jaccard, "link_components", lambda postings, *how: seen.append(postings.groupBy("doc").count().collect()) or keep(postings, *how))
    given = chance_docs(120)
    got = jaccard.jaccard_components(spark.createDataFrame(given, "doc_id long, text string").repartition(3), width=3, percent=90).collect()
    assert {r.doc_id: r.component_id for r in got} == linked(given, 3, 90)
    assert sum(r.component_id == 0 for r in got) == 13
    near = {0, *range(108, 120)}
    assert {r.doc for r in seen[0]} >= near
    assert sum(r["count"] for r in seen[0] if r.doc not in near) <= 20


@pytest.mark.parametrize("percent", [100, 90, 60])
def test_spare_n_grams_cost_no_link(spark, percent):
    """Sets of all sizes, where the smaller of two linked ones can spare fewer n-grams than the larger."""
    rnd = random.Random(percent)
    given = []
    for size in (1, 2, 5, 10, 11, 21, 40, 80, 160):
        words = [f"w{rnd.randrange(60)}" for _ in range(size)]
        for cut in range(0, size, max(1, size // 8)):
            given.append((len(given), " ".join(words[: size - cut])))
    got = jaccard.jaccard_components(spark.createDataFrame(given, "doc_id long, text string").repartition(2), width=1, percent=percent).collect()
    assert {r.doc_id: r.component_id for r in got} == linked(given, 1, percent)


def passage_docs(n, seed=11):
    """Texts of one passage, each without one of its words and with 28 words of its own: nearly linked at 80 %, width 1.
    The last 24 are near copies of the first."""
    rnd = random.Random(seed)
    passage = [f"p{k}" for k in range(219)]
    texts = []
    for k in range(n):
        words = [w for w in passage if w != f"p{k % 20}"] + [f"own{k}x{i}" for i in range(28)]
        rnd.shuffle(words)
        texts.append(" ".join(words))
    for k in range(24):
        texts.append(texts[0].replace(f"own0x{k}", "changed"))
    return [(k, text) for k, text in enumerate(texts)]


def test_pairs_do_not_meet_in_each_list_they_share(spark, monkeypatch):
    """All with all: documents of one passage share many n-grams, and linked ones need not meet."""
    seen = []
    keep = jaccard._met

    def met(nodes, pivots, percent):
        pairs = keep(nodes, pivots, percent)
        if pivots is None:
            seen.append(([tuple(r) for r in pairs.collect()], {tuple(r) for r in nodes.select("doc", "comp").collect()}))
        return pairs

    monkeypatch.setattr(jaccard, "_met", met)
    given = passage_docs(40)
    got = jaccard.jaccard_components(spark.createDataFrame(given, "doc_id long, text string").repartition(3), width=1, percent=80).collect()
    want = linked(given, 1, 80)
    assert {r.doc_id: r.component_id for r in got} == want
    assert sum(c == 0 for c in want.values()) == 25 and len(set(want.values())) == 40
    [(pairs, comps)] = seen
    comps = dict(comps)
    assert len(set(pairs)) > 300 and len(pairs) <= 3 * len(set(pairs))
    assert all(comps[a] != comps[b] for a, b in pairs)


@pytest.mark.parametrize("seed", range(3))
def test_ids_with_several_sets_keep_the_links_of_each(spark, seed):
    """The short text of an id shares a rare word with one that the long text of the same id is a near copy of."""
    rnd = random.Random(seed)
    given = []
    for k in range(0, 40, 4):
        base = [f"b{k}x{i}" for i in range(rnd.choice((30, 120, 300)))]
        given.append((k, " ".join([*base, f"rare{k}"])))
        for copy in (1, 2, 3)[: rnd.randrange(1, 4)]:
            given.append((k + copy, " ".join([*base[: -rnd.randrange(1, 4)], *rnd.sample(["changed", "other", "third"], 1)])))
            given.append((k + copy, " ".join([f"rare{k}", *(f"s{k}x{i}" for i in range(rnd.randrange(1, 9)))])))
    got = jaccard.jaccard_components(spark.createDataFrame(given, "doc_id long, text string").repartition(2), width=1, percent=80).collect()
    assert len(got) == len(given)
    assert {r.doc_id: r.component_id for r in got} == linked(given, 1, 80)


def test_buckets_follow_the_texts_not_the_plan(spark, docs, monkeypatch):
    """Sides of joins multiply in Spark's estimates; the number of buckets comes from the bytes that are there."""
    seen = []
    keep = suffix.trigger_rows
    monkeypatch.setattr(suffix, "trigger_rows", lambda d, how, buckets: seen.append(buckets) or keep(d, how, buckets))
    joined = docs
    for _ in range(3):
        joined = joined.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    suffix.repeated_bytes(docs)
    suffix.repeated_bytes(joined)
    assert seen == [suffix.LEAST_BUCKETS] * 2
