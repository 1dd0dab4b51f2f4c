"""Flank search over whole Arrow batches: no loop over rows.

The sequences of a block lie end to end in one buffer. Every window of 20 bases is packed into one 64-bit word (three bits
a base, put together by doubling), so that one XOR a place tells the mismatches with the flank of its row; the few places
that are left are compared byte by byte, so letters outside ACGTN count as any other byte does.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Flank length, of which the part beside the repeat must be exact.
FLANK, INNER = 20, 5
#: Bytes of sequence that are worked on at a time (one longer sequence is a block of its own).
BLOCK_BYTES = 4 << 20

_CODES = np.full(256, 5, np.uint64)
_CODES[np.frombuffer(b"ACGTN", np.uint8)] = np.arange(5, dtype=np.uint64)
_LOW = np.uint64(sum(1 << 3 * k for k in range(FLANK)))
_SPAN = np.arange(FLANK)


class Texts:
    """Strings end to end: row r is ``data[at[r]:at[r + 1]]``. NULL is empty."""

    def __init__(self, data: np.ndarray, at: np.ndarray):
        self.data, self.at = data, at

    @classmethod
    def of(cls, column: pa.Array) -> Texts:
        column = column.cast(pa.large_string()).fill_null("")
        if not len(column):
            return cls(np.zeros(0, np.uint8), np.zeros(1, np.int64))
        _, at, data = column.buffers()
        at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
        held = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        return cls(held[at[0] : at[-1]], at - at[0])

    def __len__(self) -> int:
        return len(self.at) - 1

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.at)

    def rows(self, first: int, last: int) -> Texts:
        return Texts(self.data[self.at[first] : self.at[last]], self.at[first : last + 1] - self.at[first])

    def parts(self, rows: np.ndarray, low: np.ndarray, size: int) -> np.ndarray:
        """A matrix of ``size`` bytes a row, from ``low`` within each row; they must be inside."""
        return self.data[(self.at[rows] + low)[:, None] + np.arange(size)] if len(rows) else np.zeros((0, size), np.uint8)


def blocks(sizes: np.ndarray, most: int | None = None) -> Iterator[tuple[int, int]]:
    """(first, last) of consecutive rows that hold about ``most`` bytes (``BLOCK_BYTES`` by default)."""
    number = np.concatenate([[0], np.cumsum(sizes)])[:-1] // (most or BLOCK_BYTES)
    edges = [0, *(np.flatnonzero(np.diff(number)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(edges, edges[1:], strict=False) if b > a)


def ragged(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place within the row) of each element of rows with these sizes."""
    rows = np.repeat(np.arange(len(sizes)), sizes)
    return rows, np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _packed(codes: np.ndarray) -> np.ndarray:
    """Words of the 20 codes from each place on."""
    two = codes[:-1] << np.uint64(3) | codes[1:]
    four = two[:-2] << np.uint64(6) | two[2:]
    eight = four[:-4] << np.uint64(12) | four[4:]
    sixteen = eight[:-8] << np.uint64(24) | eight[8:]
    return sixteen[:-4] << np.uint64(12) | four[16:]


def near_places(texts: Texts, flanks: np.ndarray, has: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, place, mismatching bases) of all places at which a row's flank (rows of 20 bytes; those that ``has``) occurs with
    at most one mismatch, by row and place."""
    n_windows = np.where(has, np.maximum(texts.sizes - FLANK + 1, 0), 0)
    if not n_windows.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, FLANK), bool)
    words = _packed(_CODES[texts.data])
    wanted = np.bitwise_or.reduce(_CODES[flanks] << (3 * _SPAN[::-1]).astype(np.uint64), axis=1)
    rows, places = ragged(n_windows)
    off = words[texts.at[rows] + places] ^ wanted[rows]
    off = (off | off >> np.uint64(1) | off >> np.uint64(2)) & _LOW
    few = np.flatnonzero(off & (off - np.uint64(1)) == 0)
    rows, places = rows[few], places[few]
    differ = texts.parts(rows, places, FLANK) != flanks[rows]
    fine = differ.sum(axis=1) <= 1
    return rows[fine], places[fine], differ[fine]


def unique_in_windows(windows: Texts, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether the 20 bases before ``low`` and from ``high`` on (places in each window) are whole, without N, and occur once
    in their window with at most one mismatch."""
    fine = (low >= FLANK) & (low <= windows.sizes) & (high >= 0) & (high + FLANK <= windows.sizes)
    out = np.zeros(len(windows), bool)
    for first, last in blocks(windows.sizes):
        block, some = windows.rows(first, last), fine[first:last].copy()
        for at in (low[first:last] - FLANK, high[first:last]):
            flanks = np.zeros((last - first, FLANK), np.uint8)
            chosen = np.flatnonzero(some)
            flanks[chosen] = block.parts(chosen, at[chosen], FLANK)
            some &= ~(flanks == ord("N")).any(axis=1)
            rows, _, _ = near_places(block, flanks, some)
            some &= np.bincount(rows, minlength=last - first) == 1
        out[first:last] = some
    return out


class Alignments:
    """The parsed CIGARs of a block: which reads they fit, where each ends, and the aligned place of bases."""

    def __init__(self, cigars: Texts, starts: np.ndarray, seqs: Texts):
        data, n = cigars.data, len(cigars)
        is_op = np.isin(data, np.frombuffer(b"MIDNSHP=X", np.uint8))
        is_digit = (data >= ord("0")) & (data <= ord("9"))
        at = np.flatnonzero(is_op)
        row = np.searchsorted(cigars.at, at, "right") - 1
        before = np.maximum(np.concatenate([[-1], at[:-1]])[: len(at)], cigars.at[row] - 1)
        digits = at - before - 1
        owner, _ = ragged(digits)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(digits), digits)
        spots = at[owner] + place
        value = np.where(is_digit[spots], data[spots].astype(np.int64) - ord("0"), 0) * 10 ** np.minimum(-1 - place, 17)
        size = np.bincount(owner, value, len(at)).astype(np.int64) if len(at) else np.zeros(0, np.int64)
        odd = np.bincount(np.searchsorted(cigars.at, np.flatnonzero(~is_op & ~is_digit), "right") - 1, minlength=n)
        ends = np.zeros(n, bool)
        full = cigars.sizes > 0
        ends[full] = is_op[cigars.at[1:][full] - 1]
        empty_number = np.bincount(row[digits == 0], minlength=n)
        op = data[at]
        reads, refers = np.isin(op, np.frombuffer(b"MIS=X", np.uint8)) * size, np.isin(op, np.frombuffer(b"MDN=X", np.uint8)) * size
        self.ends = starts + np.bincount(row, refers, n).astype(np.int64)
        self.fits = (odd == 0) & ends & (empty_number == 0) & (np.bincount(row, reads, n).astype(np.int64) == seqs.sizes)
        aligned = np.isin(op, np.frombuffer(b"M=X", np.uint8)) & (size > 0) & self.fits[row]
        within = lambda steps: np.cumsum(steps) - steps - np.repeat(_first_sums(steps, row, n), np.bincount(row, minlength=n))
        self._low = (seqs.at[row] + within(reads))[aligned]
        self._high = self._low + size[aligned]
        self._place = (starts[row] + within(refers))[aligned]

    def first_aligned(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For 20 bases from each place of the buffer on: whether one is aligned, how far in the first such is, its place."""
        run = np.searchsorted(self._high, at, "right")
        there = run < len(self._high)
        run = np.where(there, run, 0)
        low, place = (self._low[run], self._place[run]) if len(self._low) else (at, at)
        skip = np.maximum(low - at, 0)
        return there & (skip < FLANK), skip, place + at + skip - low


def _first_sums(steps: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """What all earlier rows sum to, by row."""
    sums = np.bincount(row, steps, n).astype(np.int64)
    return np.cumsum(sums) - sums


def joints(tails: np.ndarray, heads: np.ndarray, most: np.ndarray) -> np.ndarray:
    """By row the longest end (at most ``most``) of the tail that the head begins with; both have 20 bytes a row."""
    found = np.zeros(len(tails), np.int64)
    for n in range(1, FLANK + 1):
        found[(most >= n) & (tails[:, FLANK - n :] == heads[:, :n]).all(axis=1)] = n
    return found


def repeats(texts: Texts, rows: np.ndarray, low: np.ndarray, sizes: np.ndarray, motifs: Texts) -> np.ndarray:
    """Whether ``sizes`` bytes from ``low`` in these rows are their rows' motif repeated, in any phase; sizes are those of two
    motifs or more.

    First each byte must equal that a motif before; then the first motif's bytes must occur in the motif written twice
    (rows of like motif lengths together, so that padding at most doubles the bytes)."""
    k = motifs.sizes[rows]
    of, place = ragged(sizes - k)
    at = texts.at[rows][of] + low[of] + place
    fine = np.bincount(of[texts.data[at] != texts.data[at + k[of]]], minlength=len(rows)) == 0
    level = np.frexp(k.astype(float))[1]
    for one in np.unique(level[fine]):
        chosen = np.flatnonzero(fine & (level == one))
        width = int(k[chosen].max())
        own, inside = rows[chosen], k[chosen]
        doubled, head = np.zeros((len(chosen), 2 * width), np.uint8), np.zeros((len(chosen), width), np.uint8)
        of, place = ragged(inside)
        letters = motifs.data[motifs.at[own][of] + place]
        doubled[of, place], doubled[of, place + inside[of]] = letters, letters
        head[of, place] = texts.data[texts.at[own][of] + low[chosen][of] + place]
        fine[chosen] = np.strings.find(doubled.view(f"S{2 * width}").ravel(), head.view(f"S{width}").ravel()) >= 0
    return fine
