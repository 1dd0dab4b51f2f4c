"""Flank search and measuring over batches, against the rule written plainly for one read."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from callquality.operators import flanks, reads
from callquality.operators.flanks import Texts

LEFT, RIGHT = "ACGTTGCAAGCTTACGGATC", "TTGACCATGCGATAGGCTAA"


def near(text, flank):
    return [k for k in range(len(text) - 19) if sum(a != b for a, b in zip(text[k : k + 20], flank, strict=True)) <= 1]


def plainly(seq, qual, start, cigar, left, right, motif, low, high):
    parts = [(int(n), op) for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar or "")]
    places, at = [], start
    for n, op in parts:
        places += [at + k if op in "M=X" else None for k in range(n)] if op in "MIS=X" else []
        at += n if op in "M=XDN" else 0
    if len(places) != len(seq) or not motif:
        return None

    def anchors(flank, inner, want):
        for k in near(seq, flank):
            known = next((j for j in range(20) if places[k + j] is not None), None)
            if seq[k : k + 20][inner] == flank[inner] and (known is None or abs(places[k + known] - known - want) <= 10):
                yield k

    a, b, least = list(anchors(left, slice(15, 20), low - 20)), list(anchors(right, slice(0, 5), high)), max(8, 2 * len(motif))
    if max(len(a), len(b)) > 1 or not a + b:
        return None
    joint = lambda x, y: max(n for n in range(21) if y.startswith(x[len(x) - n :]) and n <= min(len(x), len(y)))
    turns = lambda s: any((motif[p:] + motif * len(s))[: len(s)] == s for p in range(len(motif)))
    if a and b:
        first, last, kind, fine = a[0] + 20, b[0], "spanning", a[0] + 20 <= b[0]
    elif a:
        first, kind = a[0] + 20, "left"
        last = len(seq) - joint(seq[first:], right)
        fine = last - first >= least and turns(seq[last - least : last]) and at < high + 20
    else:
        last, kind = b[0], "right"
        first = joint(left, seq[:last])
        fine = last - first >= least and turns(seq[first : first + least]) and start > low - 20
    values = [ord(c) - 33 for c in (qual or "")[first:last]] if qual != "*" else []
    return (kind, last - first, round(sum(values) / len(values)) if values else -1) if fine else None


def some_reads(n, seed=1):
    rng = random.Random(seed)
    dna = lambda k: "".join(rng.choices("ACGT", k=k))
    for _ in range(n):
        motif = rng.choice(["CAG", "A", "AT", "CAG", "AAAG", "ACACAC", dna(rng.randint(1, 40))])
        core = motif * rng.randint(0, 12) + rng.choice(["", motif[:1], motif + "N", "T"])
        start, seq = 500 + rng.choice([0, 0, 0, 15, -30]), LEFT + core + rng.choice(["", "", motif]) + RIGHT
        cut = rng.random()
        shift = rng.randrange(1, 25) if cut < 0.3 else 0
        seq = seq[shift:] if cut < 0.3 else seq[: -rng.randrange(1, 30)] if cut < 0.6 else dna(5) + seq + dna(3) if cut < 0.7 else seq
        if rng.random() < 0.3 and seq:
            k = rng.randrange(len(seq))
            seq = seq[:k] + rng.choice("ACGTNRé") + seq[k + 1 :] if rng.random() < 0.9 else seq + seq
        size, cigars = len(seq.encode()), ["{0}M", "{0}S", "{1}M{2}I", "{1}M7D{2}M", "2H{1}S{2}M", "{1}={2}X", "{0}M1M", "", "x{0}M", "{1}M3N{2}S"]
        cigar = rng.choice(cigars[: 10 if rng.random() < 0.7 else 1]).format(size, size // 2, size - size // 2)
        qual = rng.choice([None, "*", "I" * size, "".join(chr(33 + rng.randrange(40)) for _ in range(size)), "I" * (size // 2)])
        low = 520
        yield seq, qual, start + shift, cigar, LEFT, RIGHT, rng.choice([motif] * 9 + [""]), low, low + rng.choice([len(core), 0, 300])


def batch(rows):
    cols = list(zip(*rows, strict=True))
    t, x = (lambda k: Texts.of(pa.array(cols[k], pa.string()))), (lambda k: np.array(cols[k], np.int64))
    return t(0), t(1), x(2), t(3), t(4), t(5), t(6), x(7), x(8)


def test_batches_equal_the_rule_for_one_read():
    rows = list(some_reads(6000))
    found = reads.measured_batch(*batch(rows))
    got = {int(r): (k, int(n), int(q)) for r, k, n, q in zip(*found, strict=True)}
    plain = lambda r: (r[0].encode().decode("latin-1"), *r[1:])  # noqa: E731  (bytes are what counts)
    want = {k: v for k, r in enumerate(rows) if "x" not in r[3] and (v := plainly(*plain(r))) is not None}
    assert got == want
    kinds = [k for k, _, _ in want.values()]
    assert all(kinds.count(k) > 100 for k in ("spanning", "left", "right"))


@pytest.mark.parametrize("most", [1, 50, 1 << 20])
def test_unique_flanks_of_many_windows(most, monkeypatch):
    monkeypatch.setattr(flanks, "BLOCK_BYTES", most)
    rng = random.Random(3)
    windows, lows, highs = [None, "", "ACGT"], [0, 0, 2], [0, 0, 2]
    for _ in range(300):
        w = list("".join(rng.choices("ACGT", k=rng.randint(10, 40))) + LEFT + "CAG" * 4 + RIGHT)
        w += rng.choice([[], list(LEFT), list(RIGHT[:19] + "C"), list("N" * 30)])
        if rng.random() < 0.3:
            w[rng.randrange(len(w))] = "N"
        text = "".join(w)
        low = rng.choice([text.find("CAGCAG"), rng.randrange(-5, len(text) + 30)])
        windows.append(text), lows.append(low), highs.append(low + 12)

    def plain(w, low, high):
        a, b = (w or "")[low - 20 : low] if low >= 20 else "", (w or "")[high : high + 20] if high >= 0 else ""
        return len(a) == len(b) == 20 and "N" not in a + b and len(near(w, a)) == 1 and len(near(w, b)) == 1

    got = flanks.unique_in_windows(Texts.of(pa.array(windows, pa.string())), np.array(lows), np.array(highs)).tolist()
    assert got == [plain(*x) for x in zip(windows, lows, highs, strict=True)] and any(got) and not all(got)


def test_texts_of_slices_nulls_and_blocks():
    column = pa.array(["ab", None, "", "xyz", "q"]).slice(1, 3)
    t = Texts.of(column)
    assert t.sizes.tolist() == [0, 0, 3] and t.data.tobytes() == b"xyz" and t.rows(2, 3).at.tolist() == [0, 3]
    assert list(flanks.blocks(np.array([3, 3, 3, 100, 1]), 6)) == [(0, 2), (2, 4), (4, 5)] and list(flanks.blocks(np.array([], int))) == []
    assert len(reads.measured_batch(*(Texts.of(pa.array([], pa.string())) if k not in (2, 7, 8) else np.zeros(0, np.int64) for k in range(9)))[0]) == 0
