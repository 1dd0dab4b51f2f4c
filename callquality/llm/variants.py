"""Spelling variants: words one edit apart, found by probing generated edits against Bloom filters.

Filters are blocked (512 bits a block, a bit in each of its eight words) and sharded by word length. They go to all
tasks in rounds of at most ``MOST_BYTES``; a larger vocabulary takes more rounds. What the filters let through meets the
vocabulary in a shuffle join, which removes what they let through wrongly.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callquality.llm.common import mixed, powers, written

#: Filter bits a word; bytes of filters that are broadcast at once; words longer than this share a shard.
BITS, MOST_BYTES, LONGEST = 16, 64 << 20, 64
#: Edits that a task holds at once.
EDITS = 1 << 19
BLOCK = 512
#: Letters of a run, after A-Z have become a-z.
LETTERS, UPPER, LOWER = r"a-zÀ-ÿ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def letter_runs(text: Column) -> Column:
    """Array of the maximal runs ``[A-Za-z\\u00C0-\\u00FF]+`` of a text, only A-Z in lower case; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), f"[^{LETTERS}]+"), "")


def vocabulary(words: DataFrame, word: str = "word", least_length: int = 6, least_count: int = 5) -> DataFrame:
    """word, n: the distinct words of at least so many code points and occurrences. Null words don't count."""
    kept = words.select(words[word].cast("string").alias("word")).filter(F.char_length("word") >= least_length)
    return kept.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_count)


# Hashes of words and of their edits: the polynomial of the code points (see prefix_hash), its length mixed in.


def _hash(raw: np.ndarray, length: int) -> np.ndarray:
    return mixed(raw + np.uint64(length * 0xD6E8FEB86659FD93 & (1 << 64) - 1))


def _by_length(words: list[str]) -> dict[int, np.ndarray]:
    """Row numbers of the words of each length."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    return {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}


def _points(words: list[str], at: np.ndarray, length: int) -> np.ndarray:
    return np.frombuffer("".join(words[k] for k in at).encode("utf-32-le"), np.uint32).reshape(len(at), length)


def _prefixes(points: np.ndarray) -> np.ndarray:
    """Row-wise polynomial prefixes, one column more than points."""
    out = np.zeros((points.shape[0], points.shape[1] + 1), np.uint64)
    np.cumsum((points.astype(np.uint64) + np.uint64(1)) * powers(points.shape[1])[0][: points.shape[1]], axis=1, out=out[:, 1:])
    return out


def _shard(length: int) -> int:
    return min(length, LONGEST)


def _place(h: np.ndarray, blocks: int) -> np.ndarray:
    """The block of a hash among ``blocks`` of its shard."""
    return ((h >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)).astype(np.int64)


def _bits(h: np.ndarray, word: int) -> np.ndarray:
    """The bit of a hash in one of the eight words of its block."""
    again = mixed(h) if word < 4 else mixed(h ^ np.uint64(0x94D049BB133111EB))
    return np.uint64(1) << (again >> np.uint64(16 * (word % 4)) & np.uint64(63))


def _blocks_of(vocab: DataFrame, blocks: dict[int, int]) -> DataFrame:
    """shard, block, b0 to b7: the filters of all words, a row a block that has any."""

    def run(batches):
        for batch in batches:
            words = batch.column("word").to_pylist()
            for length, at in _by_length(words).items():
                h = _hash(_prefixes(_points(words, at, length))[:, -1], length)
                shard = _shard(length)
                columns = [pa.array(np.full(len(at), shard, np.int32)), pa.array(_place(h, blocks[shard]))]
                columns += [pa.array(_bits(h, k).view(np.int64)) for k in range(8)]
                yield pa.RecordBatch.from_arrays(columns, ["shard", "block", *[f"b{k}" for k in range(8)]])

    rows = vocab.select("word").mapInArrow(run, "shard int, block long, " + ", ".join(f"b{k} long" for k in range(8)))
    return rows.groupBy("shard", "block").agg(*[F.bit_or(f"b{k}").alias(f"b{k}") for k in range(8)])


def _edits(points: np.ndarray, prefixes: np.ndarray, alphabet: np.ndarray, least: int):
    """Hashes of one-letter edits of words of one length, in blocks: (length, hashes, word row, place, letter or -1).

    Each pair of words one edit apart is met once: the longer word meets the shorter, and of two of one length the one
    with the smaller letter meets the other. A letter equal to the one before it is not deleted: that gives the same.
    """
    n, length = points.shape
    up, down = powers(length + 1)
    step = max(1, EDITS // max(1, n * len(alphabet)))
    for a in range(0, length, step):
        z = min(length, a + step)
        own = points[:, a:z]
        row, place, letter = np.nonzero(alphabet[None, None, :] > own[:, :, None])
        change = (alphabet[letter].astype(np.int64) - own[row, place].astype(np.int64)).astype(np.uint64)
        yield length, _hash(prefixes[row, -1] + change * up[a + place], length), row, a + place, alphabet[letter].astype(np.int64)
        if length > least:
            before = points[:, a - 1 : z - 1] if a else np.concatenate([np.full((n, 1), -1, np.int64), points[:, : z - 1]], axis=1)
            row, place = np.nonzero(own != before)
            raw = prefixes[row, a + place] + (prefixes[row, -1] - prefixes[row, a + place + 1]) * down[1]
            yield length - 1, _hash(raw, length - 1), row, a + place, np.full(len(row), -1)


def near_pairs(vocab: DataFrame, least_length: int = 6) -> DataFrame:
    """word, near, n, near_n: each pair of words of a written vocabulary (word, n) one inserted, deleted or replaced code
    point apart, once. Words are distinct, of ``least_length`` code points or more."""
    spark = vocab.sparkSession
    alphabet = np.array(sorted(ord(r[0]) for r in vocab.select(F.explode(F.split("word", ""))).distinct().collect() if r[0]), np.uint32)
    counts = {r["shard"]: r["n"] for r in vocab.groupBy(F.least(F.char_length("word"), F.lit(LONGEST)).alias("shard")).agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {shard: max(1, math.ceil(n * BITS / BLOCK)) for shard, n in counts.items()}
    starts = dict(zip(blocks, np.cumsum([0, *blocks.values()])[:-1].tolist(), strict=True))
    total, most = sum(blocks.values()), MOST_BYTES // (BLOCK // 8)
    built = written(_blocks_of(vocab, blocks), "variants-filters") if total else None
    schema, found = "candidate string, word string, n long", None
    for first in range(0, total, most):
        end = min(total, first + most)
        at = F.col("block")
        offset = F.coalesce(*[F.when(F.col("shard") == s, F.lit(v)) for s, v in starts.items()])
        part = built.withColumn("block", offset + at).filter((F.col("block") >= first) & (F.col("block") < end)).drop("shard").toArrow()
        bits = np.zeros((8, end - first), np.uint64)
        bits[:, part.column("block").to_numpy() - first] = [part.column(f"b{k}").to_numpy().view(np.uint64) for k in range(8)]
        held = spark.sparkContext.broadcast(bits)

        def probe(batches, held=held, first=first, end=end):
            bits = held.value
            for batch in batches:
                words, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
                for length, rows in _by_length(words).items():
                    width = max(1, EDITS // (len(alphabet) + 1))
                    for k in range(0, len(rows), width):
                        yield _positives(words, n, rows[k : k + width], length, bits, first, end)

        def _positives(words, n, rows, length, bits, first, end):
            points = _points(words, rows, length)
            candidates, whence = [], []
            for size, h, row, place, letter in _edits(points, _prefixes(points), alphabet, least_length):
                shard = _shard(size)
                if shard not in blocks:
                    continue
                block = starts[shard] + _place(h, blocks[shard])
                left = np.flatnonzero((block >= first) & (block < end))
                for word in range(8):
                    left = left[bits[word, block[left] - first] & _bits(h[left], word) != 0]
                for r, p, c in zip(rows[row[left]].tolist(), place[left].tolist(), letter[left].tolist(), strict=True):
                    candidates.append(words[r][:p] + (chr(c) if c >= 0 else "") + words[r][p + 1 :])
                    whence.append(r)
            columns = [pa.array(candidates, pa.string()), pa.array([words[r] for r in whence], pa.string()), pa.array(n[whence] if whence else [], pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["candidate", "word", "n"])

        positives = vocab.select("word", "n").mapInArrow(probe, schema)
        found = positives if found is None else found.unionByName(positives)
    found = spark.createDataFrame([], schema) if found is None else found
    exact = vocab.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(exact, F.col("candidate") == F.col("near")).select("word", "near", "n", "near_n")


def group_variants(vocab: DataFrame, times: int = 5, least_length: int = 6) -> DataFrame:
    """word, form, root, n, n_near, form_n of a vocabulary (word, n) with distinct words.

    form: the near word with the largest n (ties: the smallest in code-point order) if that is ``times`` the word's n or
    more, else null. root: where the forms lead in the end, the word itself without one. Forms can't lead in a circle, as
    n grows; so the steps to a root, and the rounds of doubling that find it, are bounded by the logarithm of the largest n.
    """
    if times < 2:
        raise ValueError("times must be 2 or more, so that forms lead upwards")
    vocab = written(vocab.select("word", "n"), "variants-words")
    pairs = near_pairs(vocab, least_length)
    side = F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))
    other = F.struct((-F.col("n")).alias("less"), F.col("word").alias("near"))
    both = pairs.select(F.explode(F.array(F.struct("word", side.alias("best")), F.struct(F.col("near").alias("word"), other.alias("best")))).alias("x")).select("x.*", F.lit(None).cast("long").alias("n"))
    alone = vocab.select("word", F.lit(None).cast("struct<less:bigint,near:string>").alias("best"), "n")
    stats = both.unionByName(alone).groupBy("word").agg(F.max("n").alias("n"), F.count("best").alias("n_near"), F.min("best").alias("best"))
    has = -F.col("best.less") >= times * F.col("n")
    stats = written(stats.select("word", F.when(has, F.col("best.near")).alias("form"), "n", "n_near", F.when(has, -F.col("best.less")).alias("form_n")), "variants-forms")
    top, low = stats.agg(F.max("n"), F.min("n")).head()
    steps = math.ceil(math.log(max(top / low, 2), times)) + 1 if top else 1
    links = stats.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(steps))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        links = written(links.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root")), "variants-roots")
    return stats.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
