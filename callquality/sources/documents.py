"""Call documents as a stream of loci: a Spark data source that reads a document of any size in bounded memory.

A task reads one file in pieces, inflates them, follows strings, escapes and depth in them with array operations, and
cuts out the members of ``LocusResults`` one by one. What it holds is a piece and the member that is being read.
"""

from __future__ import annotations

import fnmatch
import json
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from callquality.sources.io import LOCUS

#: Bytes of a piece, compressed or not; bytes of members that make a batch.
PIECE, BATCH = 1 << 20, 1 << 22
_KEY = re.compile(rb'\s*("(?:[^"\\]|\\.)*")\s*:\s*', re.S)
_KIND = np.zeros(256, np.int8)
for _c, _k in ((b"{", 1), (b"[", 1), (b"}", 2), (b"]", 2), (b",", 3), (b":", 3)):
    _KIND[_c[0]] = _k


class MemberSplitter:
    """Cuts the members of one object on the second level of a JSON document out of its bytes, piece by piece.

    ``feed`` gives the values of the members of ``section`` that end in a piece. ``kept`` has the texts of members of the
    document itself that were asked for. Other members are skipped, not held. ``close`` raises ValueError if the document
    did not end. Repeated keys give each of their values."""

    def __init__(self, section: str, wanted: Iterable[str] = ()):
        self.section, self.wanted, self.kept = section, set(wanted), {}
        self._depth, self._string, self._slashes = 0, False, 0
        self._pending: list[bytes] = []
        self._holding, self._key, self._inside = True, None, False
        self._done = False

    def feed(self, piece: bytes) -> Iterator[bytes]:
        data = np.frombuffer(piece, np.uint8)
        if not len(data):
            return
        at = np.arange(len(data))
        slash = data == 0x5C
        # length of the run of backslashes that ends before each byte, on from the piece before
        last = np.maximum.accumulate(np.where(slash, -1, at))
        run = np.where(last < 0, at + 1 + self._slashes, at - last)
        before = np.concatenate([[self._slashes], run[:-1]])
        quote = (data == 0x22) & (before % 2 == 0)
        inside = (np.cumsum(quote) + self._string) % 2 == 1  # true from an opening quote to before its closing one
        kind = np.where(inside | quote, 0, _KIND[data])
        depth = self._depth + np.cumsum(np.where(kind == 1, 1, np.where(kind == 2, -1, 0)))
        events = np.flatnonzero(((kind == 3) & (depth <= 2)) | ((kind == 1) & (depth <= 2)) | ((kind == 2) & (depth <= 1)))
        self._slashes, self._string, self._depth = int(run[-1]), bool(inside[-1]), int(depth[-1])
        start = 0
        for k in events.tolist():
            c, d = piece[k : k + 1], int(depth[k])
            if c == b":" and d == 1 and self._key is None:
                self._key = json.loads(self._take(piece, start, k))
                self._holding = self._key in self.wanted
                start = k + 1
            elif c == b"{" and d == 1 or c == b"{" and d == 2 and self._key == self.section:
                self._take(piece, start, k)
                self._inside, self._holding, start = d == 2, True, k + 1
            elif c in b",}" and self._inside and (d == 2 or c == b"}" and d == 1):
                text = self._take(piece, start, k)
                start = k + 1
                if text.strip():
                    yield text[m.end() :] if (m := _KEY.match(text)) else text
                if c == b"}":
                    self._inside = self._holding = False
            elif c in b",}" and d == (1 if c == b"," else 0):
                text = self._take(piece, start, k)
                if self._key in self.wanted:
                    self.kept[self._key] = text
                self._key, self._holding, start = None, True, k + 1
                self._done = c == b"}"
        if self._holding and start < len(piece):
            self._pending.append(piece[start:])

    def _take(self, piece: bytes, start: int, end: int) -> bytes:
        out = b"".join([*self._pending, piece[start:end]]) if self._holding else b""
        self._pending.clear()
        return out

    def close(self) -> None:
        if not self._done:
            raise ValueError("the document ends early or is no JSON object")


def pieces(stream, size: int = PIECE) -> Iterator[bytes]:
    """Bytes of a stream, inflated where it is gzip (one member or several), at most about ``size`` at a time."""
    head = stream.read(2)
    if head != b"\x1f\x8b":
        while head:
            yield head
            head = stream.read(size)
        return
    inflate, given = zlib.decompressobj(31), head
    while given:
        yield inflate.decompress(given, size)
        given = inflate.unconsumed_tail
        if inflate.eof:
            given = inflate.unused_data or stream.read(size)
            inflate = zlib.decompressobj(31) if given else inflate
        elif not given:
            given = stream.read(size)
    if not inflate.eof:
        raise ValueError("the gzip stream ends early")


def read_members(open_stream, section: str = "LocusResults", size: int = PIECE) -> Iterator[tuple[str | None, bytes]]:
    """(sample id, text of a member) of one document. Where the sample's parameters come after the loci, the document is
    first read for them."""
    splitter, sample, known = MemberSplitter(section, ["SampleParameters"]), None, False

    def of(kept):
        return (json.loads(kept["SampleParameters"]) or {}).get("SampleId") if "SampleParameters" in kept else None

    with open_stream() as stream:
        for piece in pieces(stream, size):
            for text in splitter.feed(piece):
                if not known:
                    known = True
                    if "SampleParameters" in splitter.kept:
                        sample = of(splitter.kept)
                    else:
                        ahead = MemberSplitter(section, ["SampleParameters"])
                        with open_stream() as again:
                            for p in pieces(again, size):
                                for _ in ahead.feed(p):
                                    pass
                        sample = of(ahead.kept)
                yield sample, text
    splitter.close()


class _File(InputPartition):
    def __init__(self, uri: str):
        self.uri = uri


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _files(path: str) -> list[str]:
    """The files of a folder (not those that begin with . or _), of a pattern, or the file itself, in order of names."""
    from pyarrow import fs

    system, inner = _filesystem(path)
    prefix = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    if any(c in inner for c in "*?["):
        base = re.split(r"[*?\[]", inner)[0].rpartition("/")[0] or "."
        found = [f.path for f in system.get_file_info(fs.FileSelector(base, recursive=True)) if f.type == fs.FileType.File and fnmatch.fnmatchcase(f.path, inner)]
    else:
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = [inner] if info.type == fs.FileType.File else [f.path for f in system.get_file_info(fs.FileSelector(inner)) if f.type == fs.FileType.File and f.base_name[0] not in "._"]
    return [(prefix or ("file://" if isinstance(system, fs.LocalFileSystem) else "")) + f for f in sorted(found)]


class _DocumentReader(DataSourceReader):
    def __init__(self, path: str, section: str):
        self.path, self.section = path, section

    def partitions(self):
        return [_File(uri) for uri in _files(self.path)]

    def read(self, partition):
        if not isinstance(partition, _File):  # no files
            return
        system, inner = _filesystem(partition.uri)
        held, size = [], 0

        def batch():
            samples, texts = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays([pa.array([partition.uri] * len(held), pa.string()), pa.array(samples, pa.string()), pa.array([t.decode() for t in texts], pa.string())], ["source_file", "sample_id", "member"])

        for sample, text in read_members(lambda: system.open_input_stream(inner, compression=None), self.section):
            held.append((sample, text))
            size += len(text)
            if size >= BATCH:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class CallDocuments(DataSource):
    """``spark.read.format("call_documents").load(path)``: a row a member of ``LocusResults``, a partition a file."""

    @classmethod
    def name(cls) -> str:
        return "call_documents"

    def schema(self) -> str:
        return "source_file string, sample_id string, member string"

    def reader(self, schema) -> DataSourceReader:
        return _DocumentReader(self.options["path"], self.options.get("section", "LocusResults"))


def stream_call_documents(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, sample_id, locus) as ``read_call_documents`` gives, with memory that doesn't grow with a document.

    ``path``: a file, a folder or a pattern, local or of a store that Arrow reads; gzip or not. A document that ends early
    raises. Loci are parsed by Spark; a locus that is no JSON object of the schema gives NULLs."""
    spark.dataSource.register(CallDocuments)
    rows = spark.read.format("call_documents").load(path)
    return rows.select("source_file", "sample_id", F.from_json("member", LOCUS).alias("locus"))
