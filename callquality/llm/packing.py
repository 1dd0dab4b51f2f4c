"""Best-fit packing of token pieces: dominance reduction, then best fit, on counts of equal lengths.

Lengths are whole numbers up to the capacity, so the packing problem of any number of pieces is the histogram of their
lengths: at most ``capacity`` numbers. The driver solves that histogram; the plan says which ranks of which length go
to which sequences, and every piece finds its place by its length and its rank among pieces of that length.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from callquality.llm.common import text_bytes, written

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, chunk int, nth long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def load_encoder(path: str):
    """A byte-level BPE encoder from a file of base64 tokens and ranks. Its ids are those of the same vocabulary in
    other formats; control strings in a text are ordinary text."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str) -> dict[str, int]:
    """The tokens, with their ids, that the JSON file of the same vocabulary adds to the ranks; {} without such a file.
    Tokens that also take spaces or whole words around them are refused."""
    whole = os.path.splitext(path)[0] + ".json"
    if not os.path.exists(whole):
        return {}
    with open(whole, encoding="utf-8") as f:
        listed = json.load(f)["added_tokens"]
    if odd := [t["content"] for t in listed if t["lstrip"] or t["rstrip"] or t["single_word"]]:
        raise ValueError(f"added tokens that take in what stands around them: {odd}")
    return {t["content"]: t["id"] for t in listed}


def added_encoder(encoder, added: dict[str, int]):
    """A function from a text to its ids: added tokens (the longest where several begin) get their own id, the runs
    between them are encoded each for itself."""
    if not added:
        return encoder.encode_ordinary
    parts = re.compile("(" + "|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + ")")

    def encode(text: str) -> list[int]:
        runs = parts.split(text)
        if len(runs) == 1:
            return encoder.encode_ordinary(text)
        return [i for k, run in enumerate(runs) for i in ([added[run]] if k % 2 else encoder.encode_ordinary(run))]

    return encode


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Martello-Toth reduction on length classes: sets that dominate all others are fixed, many at once.

    With i the longest length left and j the longest that fits beside it: {i} alone is fixed if nothing fits; {i, j} if
    it fills the sequence or if no two pieces fit beside i; also if j is at least as long as the best two pieces a, b
    that fit beside i, when no three do; else {i, a, b} if a = j and no two pieces besides a, both longer than b, fit
    beside i. Lengths for which none of this holds are left to best fit. Returns the fixed sets with their numbers, and
    the counts left.
    """
    left = {s: n for s, n in counts.items() if n > 0}
    fixed: list[tuple[tuple[int, ...], int]] = []
    present = np.zeros(capacity + 1, bool)
    present[list(left)] = True

    def longest(limit: int, count_self: int = 0) -> int:
        """The longest length up to ``limit`` of which there is a piece besides ``count_self`` of the current one."""
        for s in np.flatnonzero(present[: limit + 1])[::-1]:
            if left[int(s)] > (count_self if int(s) == current else 0):
                return int(s)
        return 0

    def smallest(k: int, above: int = 0, besides: int = 0) -> int:
        """Sum of the k smallest pieces longer than ``above`` left besides the current one and one of ``besides``, or
        more than any capacity."""
        total, need = 0, k
        for s in np.flatnonzero(present[above + 1 :]) + above + 1:
            n = left[int(s)] - (int(s) == current) - (int(s) == besides)
            take = min(n, need)
            total, need = total + take * int(s), need - take
            if not need:
                return total
        return capacity * 2

    def take(pieces: tuple[int, ...]) -> None:
        need: dict[int, int] = defaultdict(int)
        for s in pieces:
            need[s] += 1
        times = min(left[s] // n for s, n in need.items())
        fixed.append((pieces, times))
        for s, n in need.items():
            left[s] -= times * n
            if not left[s]:
                del left[s]
                present[s] = False

    for current in sorted(counts, reverse=True):
        while left.get(current, 0):
            room = capacity - current
            j = longest(room, 1)
            if not j:
                take((current,))
                continue
            if j == room or smallest(2) > room:
                take((current, j))
                continue
            if smallest(3) > room:
                best = best_pair(left, current, room)
                if not best or j >= sum(best):
                    take((current, j))
                    continue
                if best[0] == j and smallest(2, best[1], j) > room:
                    take((current, *best))
                    continue
            break
    return fixed, left


def best_pair(left: dict[int, int], current: int, room: int) -> tuple[int, int] | None:
    """Two pieces besides the current one with the largest sum up to ``room``."""
    have = {s: n - (s == current) for s, n in left.items() if s <= room and n > (s == current)}
    order, best = sorted(have), None
    low, high = 0, len(order) - 1
    while low <= high:
        a, b = order[low], order[high]
        if a + b > room or (low == high and have[a] < 2):
            high -= 1
            continue
        if best is None or a + b > sum(best):
            best = (b, a)
        low += 1
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on length classes: sequences with the same content are kept as one entry and a number."""
    open_by_room: dict[int, list[tuple[tuple[int, ...], int]]] = defaultdict(list)
    for size in sorted(counts, reverse=True):
        n = counts[size]
        while n:
            room = min((r for r in open_by_room if r >= size and open_by_room[r]), default=None)
            if room is None:
                content, times, room = (), n, capacity
            else:
                content, times = open_by_room[room].pop()
            each = min(room // size, n)
            used = min(times, n // each)
            if content and used < times:
                open_by_room[room].append((content, times - used))
            if not content:
                used = max(1, n // each)
            open_by_room[room - each * size].append((content + (size,) * each, used))
            n -= used * each
    return [entry for entries in open_by_room.values() for entry in entries]


def packing_plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first_rank, times, each, first_sequence, offset): ranks first_rank + k * times + t of that length
    go to sequence first_sequence + t at offset + k * length, for t below times and k below each."""
    counts = {s: n for s, n in counts.items() if s > 0 and n > 0}
    full = [((capacity,), counts.pop(capacity))] if capacity in counts else []
    fixed, left = reduce_by_dominance(counts, capacity)
    rows, used, sequence = [], defaultdict(int), 0
    for content, times in [*full, *fixed, *best_fit(left, capacity)]:
        offset = 0
        for size in sorted(set(content), reverse=True):
            each = content.count(size)
            rows.append((size, used[size], times, each, sequence, offset))
            used[size] += times * each
            offset += size * each
        sequence += times
    return rows


def tokenized_pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """The pieces of each document: its token ids, then ``end_id``, cut into pieces of ``capacity`` where longer; the
    first piece takes what is over. ``nth`` counts pieces of a length within ``chunk``, the part of one task. Strings of
    added tokens in a text are those tokens, as ``tokenizers`` has it."""
    vocabulary = vocabulary or default_vocabulary()
    added = added_tokens(vocabulary)

    def run(batches):
        from pyspark import TaskContext

        encode, chunk = added_encoder(load_encoder(vocabulary), added), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1)
            out: list[list] = [[] for _ in range(7)]
            for at, doc in enumerate(keys):
                ids = np.array([*encode(texts[at].as_py() or ""), end_id], np.uint32)
                first = len(ids) % capacity if len(ids) > capacity else len(ids)
                cuts = [0, *range(first or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    for column, v in zip(out, (doc, k, a, b - a, zlib.crc32(ids[a:b].astype("<u4").tobytes()), chunk, seen[b - a]), strict=True):
                        column.append(v)
                    seen[b - a] += 1
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "chunk", "nth"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to a written table of pieces that has ``length``, ``chunk`` and ``nth``.

    To the driver goes the histogram (at most ``capacity`` rows). The plan that comes back has at most one row for each
    length in each distinct content, a number bounded by the capacity, whatever the number of pieces.
    """
    spark = pieces.sparkSession
    per_chunk = pieces.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    per_chunk = written(per_chunk.withColumn("before", before), "piece-counts")
    counts = {r["length"]: r["n"] for r in per_chunk.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = packing_plan(counts, capacity)
    plan = np.array(sorted(rows), np.int64).reshape(-1, 6)
    shared = spark.sparkContext.broadcast(plan)
    ranked = pieces.join(per_chunk.drop("n"), ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("nth")).drop("before", "chunk", "nth")
    names = [c for c in ranked.columns if c != "rank"]

    def place(batches):
        plan = shared.value
        keys = (plan[:, 0] << 44) + plan[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            row = plan[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(plan) else np.zeros((0, 6), np.int64)
            k, t = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(row[:, 4] + t), pa.array(row[:, 5] + k * length)], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, `offset` long")


def pack_documents(docs: DataFrame, key: str = "doc_id", text: str = "text", capacity: int = 1024, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; sequences hold ``capacity`` tokens.

    Null and empty texts are a piece of one token, ``end_id``. A null key stays null, repeated rows are packed as often
    as they occur, other columns are not read. Texts of any length are read whole; a task holds one document's ids.
    An empty table gives no rows. Documents aren't shuffled: only pieces (some 50 bytes each) meet their counts.
    """
    pieces = written(tokenized_pieces(docs, key, text, capacity, end_id, vocabulary), "pieces")
    return pack_pieces(pieces, capacity).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
