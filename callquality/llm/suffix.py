"""Repeated byte strings by prefix-free parsing: rolling-hash triggers, a dictionary of phrases, suffix order in depth.

Triggers are chosen by a rolling hash so that each string of ``length`` bytes has one trigger of its own inside it, the
same wherever the string stands. A trigger's phrase is what surrounds it: it holds every such string that has this
trigger. Phrases overlap, so a string never crosses from one to the next, and a document's parse is its sequence of
triggers. Equal phrases are one entry of the dictionary, which a document is compared with once:

1. (trigger, phrase) meet in buckets of the trigger's hash. A phrase that a smaller document has too is repeated as a
   whole. A trigger with two different phrases is left open, as the phrases may still share strings.
2. The open phrases meet in buckets; their suffixes are sorted to the depth of ``length`` bytes, and equal neighbours
   in that order are the strings that documents share. A trigger with very many phrases (say, the edge of a passage
   that a third of all documents quote) sends the hashes of its strings instead, which spread over all buckets. A task
   that holds that many phrases of a trigger itself sends one of them to the trigger's bucket, as a mark.
3. Each document marks the strings found and drops the bytes they cover.

Only packed arrays are shuffled: per task and bucket one row. Equal phrases and strings of a task are combined before
that, so that a bucket gets each at most once a task, however many documents hold it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callquality.llm.common import mixed, prefix_hash, row_blocks, span_hash, text_bytes, written

BLOCK_BYTES = 1 << 18
SEGMENT_BYTES = 1 << 20
#: Entries that a task gathers before it sends them; they bound its memory.
SEND_ENTRIES = 1 << 20
#: A trigger with more phrases than this sends hashes of strings.
MANY_PHRASES = 64
LEAST_BUCKETS, BUCKET_BYTES = 1024, 1 << 26
COVERED, OPEN, MANY = 0, 1, 2


@dataclass(frozen=True)
class Parsing:
    """``length``: bytes of a string; ``trigger``: bytes of a trigger. A trigger is the place, modulo the number of
    places, of the smallest hash of ``inner`` bytes in a string: which is as dense as 3 in 43 bytes by default."""

    length: int = 50
    trigger: int = 30

    @property
    def places(self) -> int:
        return self.length - self.trigger + 1

    @property
    def inner(self) -> int:
        return 4 + (self.trigger - 4) % self.places

    @property
    def around(self) -> int:
        return self.length - self.trigger


@dataclass
class Phrases:
    row: np.ndarray
    pos: np.ndarray  # of the trigger, in the data
    first: np.ndarray  # string that has this trigger, as it starts in the data; the others follow it
    count: np.ndarray
    low: np.ndarray  # of the phrase
    high: np.ndarray
    trigger: np.ndarray
    phrase: np.ndarray


def _block(data: np.ndarray, start: np.ndarray, end: np.ndarray, ok: np.ndarray, rows: np.ndarray, how: Parsing):
    """Phrases of one stretch of bytes; start, end: the document's bounds for each byte; ok: where strings may start."""
    n, t = len(data), how.inner
    if n < how.length:
        return None
    prefix = prefix_hash(data)
    at = np.arange(n - t + 1)
    key = (span_hash(prefix, at, at + t) & ~np.uint64(0xFFFFFFFF)) | at.astype(np.uint64)
    span, have = how.length - t + 1, 1
    while have * 2 <= span:
        key, have = np.minimum(key[:-have], key[have:]), have * 2
    if have < span:
        key = np.minimum(key[: len(key) - (span - have)], key[span - have :])
    begin = np.flatnonzero(ok[: len(key)])
    if not len(begin):
        return None
    smallest = (key[begin] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = begin + (smallest - begin) % how.places
    new = np.ones(len(begin), bool)
    new[1:] = (place[1:] != place[:-1]) | (begin[1:] != begin[:-1] + 1)
    first = np.flatnonzero(new)
    pos = place[first]
    low, high = np.maximum(pos - how.around, start[pos]), np.minimum(pos + how.length, end[pos])
    count = np.diff(np.append(first, len(begin)))
    return Phrases(rows[pos], pos, begin[first], count, low, high, span_hash(prefix, pos, pos + how.trigger), span_hash(prefix, low, high) ^ mixed((pos - low).astype(np.uint64)))


def phrases(data: np.ndarray, offsets: np.ndarray, how: Parsing):
    """Phrases of all rows, in order, block by block: (offset of the block in the data, Phrases)."""
    lengths = np.diff(offsets)
    for a, b in row_blocks(lengths, BLOCK_BYTES):
        base, top = int(offsets[a]), int(offsets[b])
        if b == a + 1 and top - base > SEGMENT_BYTES:
            for cut in range(base, top, SEGMENT_BYTES):
                left, right = max(base, cut - how.length), min(top, cut + SEGMENT_BYTES + 2 * how.length)
                ok = np.zeros(right - left, bool)
                ok[cut - left : max(0, min(cut + SEGMENT_BYTES, top - how.length + 1) - left)] = True
                n = right - left
                if (found := _block(data[left:right], np.zeros(n, np.int64), np.full(n, n), ok, np.full(n, a), how)) is not None:
                    yield left, found
            continue
        rows = np.repeat(np.arange(a, b), lengths[a:b])
        start, end = offsets[rows] - base, offsets[rows + 1] - base
        ok = np.arange(top - base) + how.length <= end
        if (found := _block(data[base:top], start, end, ok, rows, how)) is not None:
            yield base, found


def ordinals(rows: np.ndarray, seen: dict[int, int]) -> np.ndarray:
    """The number of each phrase in its document; ``seen`` carries counts over blocks."""
    if not len(rows):
        return rows
    new = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
    counts = np.diff(np.append(new, len(rows)))
    base = np.array([seen.get(int(r), 0) for r in rows[new]])
    for r, c in zip(rows[new].tolist(), counts.tolist(), strict=True):
        seen[r] = seen.get(r, 0) + c
    return np.arange(len(rows)) - np.repeat(new - base, counts)


def coded(number: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """Number of a phrase in its document and 24 bits of its hash, by which another text under the same id is told."""
    return (number.astype(np.int64) << 24) | (phrase & np.uint64(0xFFFFFF)).astype(np.int64)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes: whole numbers as zstandard of their differences, hashes (unsigned) and bytes as they are."""
    out = []
    for a in arrays:
        raw = np.diff(a, prepend=a.dtype.type(0)).tobytes() if a.dtype == np.int64 else a.tobytes()
        raw = zstandard.compress(raw, 1) if a.dtype == np.int64 else raw
        out += [len(raw).to_bytes(4, "little"), raw]
    return b"".join(out)


def unpack(data: bytes, kinds: tuple) -> list[np.ndarray]:
    out, at = [], 0
    for kind in kinds:
        n = int.from_bytes(data[at : at + 4], "little")
        raw, at = data[at + 4 : at + 4 + n], at + 4 + n
        out.append(np.cumsum(np.frombuffer(zstandard.decompress(raw, max_output_size=1 << 30), np.int64)) if kind == np.int64 else np.frombuffer(raw, kind))
    return out


def first_holders(keys: list[np.ndarray], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by keys and document; where a key begins in it; and the smallest document of each place's key."""
    order = np.lexsort((doc, *keys))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    return order, new, doc[order][np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else doc


def _rows(buckets: list[int], payloads: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(payloads, pa.binary())], ["bucket", "payload"])


def _sorted_groups(bucket: np.ndarray):
    order = np.argsort(bucket, kind="stable")
    edges = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        yield int(bucket[order[a]]), order[a:b]


def crowded(trigger: np.ndarray, phrase: np.ndarray, at: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the entries ``at`` meet in their trigger's bucket, and which have a trigger of over ``most`` phrases
    here: of those one a trigger is among the former too. ``at`` is in order of trigger, then phrase."""
    t, p = trigger[at], phrase[at]
    new = np.ones(len(at), bool)
    new[1:] = t[1:] != t[:-1]
    other = new.copy()
    other[1:] |= p[1:] != p[:-1]
    many = (np.bincount(np.cumsum(new) - 1, weights=other) > most)[np.cumsum(new) - 1]
    return at[~many | new], at[many]


_ENTRY = (np.int64, np.int64, np.uint32, np.uint32, np.uint16, np.int64, np.int64)


def trigger_rows(docs: DataFrame, how: Parsing, buckets: int) -> DataFrame:
    """(bucket, payload) of the phrases of each task: entries for the bucket's grouping, and phrases already known to
    be repeated, which any bucket may hand on."""

    def send(held):
        doc, code, trigger, phrase = (np.concatenate(x) for x in zip(*held, strict=True))
        order, _, low = first_holders([phrase, trigger], doc)
        known = order[doc[order] > low]
        least = order[doc[order] == low]
        entry, rest = crowded(trigger, phrase, least, MANY_PHRASES)
        mark = np.zeros(len(doc), bool)
        mark[rest] = True
        code = np.where(mark, ~code, code)  # below zero: its trigger has many phrases
        known, entry = np.concatenate([known, rest[~np.isin(rest, entry)]]), np.sort(entry)
        bucket = (trigger[entry] >> np.uint64(32)).astype(np.int64) % buckets
        on = {b: known[at] for b, at in _sorted_groups(doc[known] % buckets)}
        numbers, payloads = [], []
        for b, at in _sorted_groups(bucket):
            e, k = entry[at], on.pop(b, known[:0])
            p = phrase[e] >> np.uint64(16)
            numbers.append(b)
            payloads.append(pack(doc[e], code[e], trigger[e].astype(np.uint32), p.astype(np.uint32), (p >> np.uint64(32)).astype(np.uint16), doc[k], code[k]))
        for b, k in on.items():
            numbers.append(b)
            payloads.append(pack(doc[:0], code[:0], *[np.zeros(0, t) for t in _ENTRY[2:5]], doc[k], code[k]))
        return _rows(numbers, payloads)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            ids, seen = batch.column("doc").to_numpy(), {}
            for _, p in phrases(data, offsets, how):
                held.append((ids[p.row], coded(ordinals(p.row, seen), p.phrase), p.trigger, p.phrase))
                size += len(p.row)
                if size >= SEND_ENTRIES:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    return docs.filter("doc IS NOT NULL").select("doc", "text").mapInArrow(run, "bucket int, payload binary")


FOUND = "doc long, code long, kind int, mask int"


def _found(doc, code, kind, mask) -> pa.Table:
    return pa.table([pa.array(doc, pa.int64()), pa.array(code, pa.int64()), pa.array(kind, pa.int32()), pa.array(mask, pa.int32())], ["doc", "code", "kind", "mask"])


def phrases_met(rows: DataFrame) -> DataFrame:
    """For each bucket of triggers: phrases that are repeated as a whole (COVERED) and those left open (OPEN, MANY)."""

    def meet(table: pa.Table) -> pa.Table:
        parts = [unpack(p.as_py(), _ENTRY) for p in table.column("payload")]
        doc, code, trigger, p32, p16, known_doc, known_code = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        phrase = p32.astype(np.uint64) | (p16.astype(np.uint64) << np.uint64(32))
        marked, code = code < 0, np.where(code < 0, ~code, code)
        order, new, low = first_holders([phrase, trigger], doc)
        d, t = doc[order], trigger[order]
        group = np.cumsum(np.concatenate([[True], t[1:] != t[:-1]])) - 1 if len(t) else t
        several = np.bincount(group, weights=new + marked[order] * (MANY_PHRASES + 1)).astype(np.int64) if len(t) else t
        kind = np.where(d > low, COVERED, np.where(several[group] > MANY_PHRASES, MANY, OPEN)) if len(t) else t
        lowest = np.full(len(several), np.iinfo(np.int64).max)
        highest = np.full(len(several), np.iinfo(np.int64).min)
        np.minimum.at(lowest, group, d)
        np.maximum.at(highest, group, d)
        alone = (lowest == highest) & (np.bincount(group, weights=marked[order]) == 0) if len(t) else t  # in one document
        keep = (d > low) | ((several[group] > 1) & ~alone[group]) if len(t) else np.zeros(0, bool)
        known_kind = np.where(known_code < 0, MANY, COVERED)
        known_code = np.where(known_code < 0, ~known_code, known_code)
        return _found(np.concatenate([d[keep], known_doc]), np.concatenate([code[order][keep], known_code]), np.concatenate([kind[keep], known_kind]), np.zeros(int(keep.sum()) + len(known_doc), np.int64))

    return rows.groupBy("bucket").applyInArrow(meet, FOUND)


_OPEN = (np.int64, np.int64, np.int64, np.int64, np.int64, np.uint8, np.uint64, np.int64, np.int64, np.int64, np.int64, np.int64, np.int64)


def open_rows(joined: DataFrame, how: Parsing, buckets: int) -> DataFrame:
    """(bucket, payload) of the open phrases' bytes, and of the hashes of the strings of triggers with many phrases."""

    def send(held):
        doc, code, first, count, size, text, bucket = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in zip(*held["open"], strict=True)) if held["open"] else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, np.uint8), np.zeros(0, np.int64)]
        string, sdoc, scode, place = (np.concatenate(x) for x in zip(*held["many"], strict=True)) if held["many"] else (np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
        order, _, low = first_holders([string], sdoc)
        known, entry = order[sdoc[order] > low], np.sort(order[sdoc[order] == low])
        ends = np.cumsum(size)
        of_open = dict(_sorted_groups(bucket))
        of_many = {b: entry[at] for b, at in _sorted_groups((string[entry] >> np.uint64(40)).astype(np.int64) % buckets)}
        of_known = {b: known[at] for b, at in _sorted_groups(sdoc[known] % buckets)}
        none, payloads, numbers = np.zeros(0, np.int64), [], []
        for b in sorted({*of_open, *of_many, *of_known}):
            o, m, k = of_open.get(b, none), of_many.get(b, none), of_known.get(b, none)
            bytes_of = np.concatenate([text[ends[i] - size[i] : ends[i]] for i in o]) if len(o) else text[:0]
            numbers.append(b)
            payloads.append(pack(doc[o], code[o], first[o], count[o], size[o], bytes_of, string[m], sdoc[m], scode[m], place[m], sdoc[k], scode[k], place[k]))
        return _rows(numbers, payloads)

    def run(batches):
        held, entries = {"open": [], "many": []}, 0
        for batch in batches:
            batch = batch.filter(batch.column("codes").is_valid())
            data, offsets = text_bytes(batch.column("text"))
            ids, seen = batch.column("doc").to_numpy(), {}
            codes, starts = _codes_of(batch)
            for base, p in phrases(data, offsets, how):
                mine = coded(ordinals(p.row, seen), p.phrase)
                kind = _kinds_of(mine, p.row, codes, starts)
                at = np.flatnonzero(kind == OPEN)
                if len(at):
                    size = p.high[at] - p.low[at]
                    where = np.repeat(base + p.low[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
                    held["open"].append((ids[p.row[at]], mine[at], p.first[at] - p.low[at], p.count[at], size, data[where], (p.trigger[at] >> np.uint64(32)).astype(np.int64) % buckets))
                    entries += len(at) * 4
                at = np.flatnonzero(kind == MANY)
                if len(at):
                    prefix = prefix_hash(data[base : base + int(p.high[at].max())])
                    n = p.count[at]
                    begin = np.repeat(p.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    held["many"].append((span_hash(prefix, begin, begin + how.length), np.repeat(ids[p.row[at]], n), np.repeat(mine[at], n), begin - np.repeat(p.first[at], n)))
                    entries += int(n.sum())
                if entries >= SEND_ENTRIES:
                    yield send(held)
                    held, entries = {"open": [], "many": []}, 0
        if entries:
            yield send(held)

    # All columns, and no filter that Spark can move below the join: so the last step reads the shuffle of the texts again.
    return joined.filter("codes IS NOT NULL OR doc IS NULL").mapInArrow(run, "bucket int, payload binary")


def _codes_of(batch):
    """Flat (code << 2 | kind), sorted within the row, and where each row's begin."""
    column = batch.column("codes")
    starts = np.zeros(len(column) + 1, np.int64)
    sizes = np.array([0 if v is None else v for v in column.value_lengths().to_pylist()], np.int64)
    starts[1:] = np.cumsum(sizes)
    return column.flatten().to_numpy(zero_copy_only=False), starts


def _kinds_of(mine: np.ndarray, row: np.ndarray, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The kind found for each phrase, or -1. Codes are sorted within their row; rows of ``mine`` ascend."""
    out = np.full(len(mine), -1, np.int64)
    edges = np.flatnonzero(np.diff(row, prepend=-1, append=-1))
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        own = codes[starts[row[a]] : starts[row[a] + 1]]
        if len(own):
            at = np.minimum(np.searchsorted(own >> 2, mine[a:b]), len(own) - 1)
            out[a:b] = np.where(own[at] >> 2 == mine[a:b], own[at] & 3, -1)
    return out


def suffixes_met(rows: DataFrame, how: Parsing) -> DataFrame:
    """(doc, code, kind, mask): bit k of the mask says that a phrase's k-th string starts in a smaller document too.

    The suffix array, to the depth of one string, of the open phrases in the bucket; and groups of equal hashes."""

    def meet(table: pa.Table) -> pa.Table:
        parts = [unpack(p.as_py(), _OPEN) for p in table.column("payload")]
        doc, code, first, count, size, text, string, sdoc, scode, place, kdoc, kcode, kplace = (np.concatenate(x) for x in zip(*parts, strict=True))
        out = [(kdoc, kcode, kplace)]
        if len(doc):
            begin = np.repeat(np.cumsum(size) - size + first - np.cumsum(count) + count, count) + np.arange(count.sum())
            suffix = np.lib.stride_tricks.sliding_window_view(text, how.length)[begin].copy().view(f"S{how.length}").ravel()
            array = np.argsort(suffix)  # the suffix array of the bucket's dictionary, in depth
            new = np.concatenate([[True], suffix[array[1:]] != suffix[array[:-1]]])  # else a string is common to neighbours
            owner = np.repeat(np.arange(len(doc)), count)
            k = np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)
            holder = doc[owner[array]]
            low = np.minimum.reduceat(holder, np.flatnonzero(new))[np.cumsum(new) - 1]
            hit = array[holder > low]
            out.append((doc[owner[hit]], code[owner[hit]], k[hit]))
        if len(string):
            order, _, low = first_holders([string], sdoc)
            hit = order[sdoc[order] > low]
            out.append((sdoc[hit], scode[hit], place[hit]))
        d, c, k = (np.concatenate(x) for x in zip(*out, strict=True))
        order = np.lexsort((c, d))
        d, c, k = d[order], c[order], k[order]
        new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (c[1:] != c[:-1])])) if len(d) else np.zeros(0, np.int64)
        mask = np.bitwise_or.reduceat(np.left_shift(1, k), new) if len(d) else k
        return _found(d[new], c[new], np.full(len(new), OPEN), mask)

    return rows.groupBy("bucket").applyInArrow(meet, FOUND)


def repeated_bytes(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = 50, keep: tuple[str, ...] = (), whole_characters: bool = False, names: tuple[str, str, str] = ("n_bytes", "spans", "kept")) -> DataFrame:
    """A row a document: doc_id, the columns ``keep``, and under ``names``: n_bytes, spans (start, end, start, end, ... of the maximal
    removed runs) and kept (the remaining bytes; with ``whole_characters`` without those that the runs left of a
    character they cut).

    A byte is removed if a string of ``length`` bytes covers it that also starts in a document with a smaller id; texts
    are judged as they came in, as UTF-8, and strings don't cross documents. Null and empty texts have no bytes. Rows
    with a null id are neither trimmed nor a reason to trim; rows with one id don't trim each other, and repeated rows
    come out as often as they went in. Columns not in ``keep`` aren't read. An empty table gives no rows.
    """
    how = Parsing(length, max(5, length - 20))
    n_bytes = docs.agg(F.sum(F.octet_length(docs[text].cast("string")))).head()[0] or 0
    buckets = max(LEAST_BUCKETS, -(-n_bytes // BUCKET_BYTES))
    given = docs.select(docs[key].cast("long").alias("doc"), docs[text].cast("string").alias("text"), *[docs[c].alias(f"keep_{c}") for c in keep])
    lean = docs.select(docs[key].cast("long").alias("doc"), docs[text].cast("string").alias("text"))
    met = phrases_met(trigger_rows(lean, how, buckets))
    codes = F.array_sort(F.collect_list(F.shiftleft("code", 2).bitwiseOR(F.col("kind").cast("long"))))
    first = written(met.groupBy("doc").agg(codes.alias("codes")), "phrases-met")
    joined = given.join(first, "doc", "left")
    again = suffixes_met(open_rows(joined, how, buckets), how)
    marks = F.collect_list(F.struct("code", "mask"))
    second = again.groupBy("doc", "code").agg(F.bit_or("mask").alias("mask")).groupBy("doc").agg(F.array_sort(marks).alias("marks"))
    both = joined.join(second, "doc", "left")
    both = both.select("doc", "text", *[f"keep_{c}" for c in keep], "codes", F.transform("marks", lambda m: m["code"]).alias("mark_codes"), F.transform("marks", lambda m: m["mask"]).alias("masks"))

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column("text"))
            codes, starts = _codes_of(batch)
            marks = batch.column("mark_codes").to_pylist()
            masks = batch.column("masks").to_pylist()
            gone = np.zeros(len(data) + 1, np.int32)
            seen: dict[int, int] = {}
            for base, p in phrases(data, offsets, how):
                mine = coded(ordinals(p.row, seen), p.phrase)
                at = np.flatnonzero(_kinds_of(mine, p.row, codes, starts) == COVERED)
                np.add.at(gone, base + p.first[at], 1)
                np.add.at(gone, base + p.first[at] + p.count[at] - 1 + how.length, -1)
                edges = np.flatnonzero(np.diff(p.row, prepend=-1, append=-1))
                for a, b in zip(edges[:-1], edges[1:], strict=True):
                    if own := marks[p.row[a]]:
                        where = np.searchsorted(own, mine[a:b])
                        for k in np.flatnonzero(np.array(own)[np.minimum(where, len(own) - 1)] == mine[a:b]):
                            mask = masks[p.row[a]][where[k]]
                            for s in range(int(p.count[a + k])):
                                if mask >> s & 1:
                                    gone[base + p.first[a + k] + s] += 1
                                    gone[base + p.first[a + k] + s + how.length] -= 1
            away = np.cumsum(gone[:-1], out=gone[:-1]) > 0  # in place: a batch holds megabytes of text
            del gone
            spans, kept = [], []
            for a, b in zip(offsets[:-1], offsets[1:], strict=True):
                own = away[a:b]
                if own.any():
                    spans.append(np.flatnonzero(np.diff(own, prepend=False, append=False)))
                    rest = data[a:b][~own].tobytes()
                    kept.append(rest.decode("utf-8", "ignore").encode() if whole_characters else rest)
                else:
                    spans.append(np.zeros(0, np.int64))
                    kept.append(data[a:b].tobytes())
            columns = [batch.column("doc"), *[batch.column(f"keep_{c}") for c in keep], pa.array(np.diff(offsets)), pa.array(spans, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, *names])

    kinds = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in keep)
    return both.mapInArrow(run, f"doc_id long, {kinds}`{names[0]}` long, `{names[1]}` array<long>, `{names[2]}` binary")
