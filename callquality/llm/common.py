"""What the training-data operators share: tables, the shared folder, word expressions and word hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The bytes that separate words, as a Java/RE2 class and as characters.
SPACE_CHARS = " \t\n\x0b\f\r"
WORD, SPACES = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a temporary folder does
    if Spark runs in one process (as in tests); a cluster must name one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        held = spark.sparkContext.getCheckpointDir()
        if held is None:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
            held = spark.sparkContext.getCheckpointDir()
        base = held
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


_SCRATCH: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """The tables that ``written`` makes inside are deleted at the end, but for those that are to ``stay``."""
    paths: list[str] = []
    outer = _SCRATCH.set(paths)
    try:
        yield
    finally:
        _SCRATCH.reset(outer)
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def written(df: DataFrame, label: str, stay: bool = False) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    if not stay and (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_side(df: DataFrame, most_rows: int = 50_000) -> DataFrame:
    """A broadcast hint for a written table that has been counted and found small; else the table as it is."""
    return F.broadcast(df) if df.count() <= most_rows else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once a row, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Array of the words ``[^\\x20\\x09-\\x0D]+`` of a text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def word_count(text: Column) -> Column:
    """Number of words, without building them."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


_SPACE = np.zeros(256, bool)
_SPACE[[ord(c) for c in SPACE_CHARS]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Odd multipliers of the polynomial and window hashes, modulo 2**64.
_BASE = 0x9E3779B97F4A7C15
_STEP = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a hash depend on all bits of the polynomial."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, modulo 2**64."""
    global _POWERS
    if len(_POWERS[0]) < n:
        n = max(n, 2 * len(_POWERS[0]), 1 << 16)
        up, down = np.empty(n, np.uint64), np.empty(n, np.uint64)
        up[0] = down[0] = 1
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        _POWERS = (np.multiply.accumulate(up), np.multiply.accumulate(down))
    return _POWERS


_POWERS: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def prefix_hash(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the polynomial of data[i:j] times base**i."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans; equal bytes give equal hashes wherever they stand."""
    down = powers(len(prefix))[1]
    raw = (prefix[end] - prefix[start]) * down[start]
    return mixed(raw + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_bytes(array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and the offsets of its rows (null: empty), without copying."""
    import pyarrow as pa

    array = array.cast(pa.large_binary()) if not pa.types.is_large_binary(array.type) else array
    if array.null_count:
        array = array.fill_null(b"")
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    if len(array) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if array.buffers()[2] is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def row_blocks(lengths: np.ndarray, most: int):
    """Row ranges of at most ``most`` bytes each; a longer row is a range of its own."""
    ends, start = np.cumsum(lengths), 0
    while start < len(lengths):
        base = ends[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
        yield start, end
        start = end


def shingle_hashes(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the ``width``-word shingles of each row, and their row numbers.

    A-Z count as a-z. A row with fewer words has one shingle, its whole word sequence; one without words has none.
    """
    low = _LOWER[data]
    word = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True  # a word ends with its row
    first = word & (np.concatenate([[True], ~word[:-1]]) | edge[:-1]) if len(data) else word
    last = word & (np.concatenate([~word[1:], [True]]) | edge[1:]) if len(data) else word
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    h = span_hash(prefix_hash(low), start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(row, minlength=len(offsets) - 1)
    full = np.zeros(0, np.uint64)
    at = np.zeros(0, np.int64)
    if len(h) >= width:
        at = np.flatnonzero(row[: len(row) - width + 1] == row[width - 1 :])
        full = np.full(len(at), width, np.uint64)
        for k in range(width):
            full = mixed(full * _STEP[0] + h[at + k] * _STEP[1 + k % 4] + np.uint64(k))
    short = np.flatnonzero((count > 0) & (count < width))
    begin = np.concatenate([[0], np.cumsum(count)])[:-1]
    tail = count[short].astype(np.uint64)
    for k in range(width - 1):
        has = count[short] > k
        tail[has] = mixed(tail[has] * _STEP[0] + h[begin[short[has]] + k] * _STEP[1 + k % 4] + np.uint64(k))
    return np.concatenate([full, tail]), np.concatenate([row[at], short])
