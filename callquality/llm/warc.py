"""WARC archives: a writer, and a sequential reader of one gzip member a record.

Tasks write archives to a shared folder through a file-system URI and report them in a manifest; only archives named in
the manifest are read, so a lost or repeated attempt leaves at most a file that nobody reads.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callquality.llm.common import new_path, written

#: Fixed values of the format.
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, n_records long, n_bytes long"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, verified boolean, path string, `offset` long"


def clean_uri(url: str | None) -> str:
    """A header value: control characters are percent-encoded; null is empty."""
    return "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "").strip()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(value: str | None) -> int | None:
    number = (value or "")[len("<urn:page:") : -1]
    return int(number) if number else None


def sha1_header(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member. A revisit holds the HTTP header, with the payload's length, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id)),
        ("WARC-Target-URI", clean_uri(url)),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", sha1_header(hashlib.sha1(block).digest())),
        ("WARC-Payload-Digest", sha1_header(digest)),
        *([("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(refers_to))] if revisit else []),
        ("Content-Length", str(len(block))),
    ]
    lines = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + b"\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(lines) + packer.compress(block) + packer.compress(b"\r\n\r\n") + packer.flush()


class WarcError(ValueError):
    """The archive does not hold what its headers say."""


def read_members(stream, chunk: int = 1 << 18) -> Iterator[tuple[int, "MemberReader"]]:
    """Offset and reader of each gzip member, one after the other; at most ``chunk`` bytes are read ahead."""
    ahead, offset = stream.read(chunk), 0
    while ahead:
        member = MemberReader(stream, ahead, chunk)
        yield offset, member
        member.drain()
        offset += member.consumed
        ahead = member.rest or stream.read(chunk)


class MemberReader:
    """Reads one gzip member incrementally."""

    def __init__(self, stream, ahead: bytes, chunk: int):
        self._zip, self._stream, self._chunk = zlib.decompressobj(31), stream, chunk
        self._raw, self._out, self.rest, self.consumed, self.ended = ahead, bytearray(), b"", 0, False

    def _more(self) -> bool:
        if self.ended:
            return False
        raw = self._raw or self._stream.read(self._chunk)
        if not raw:
            raise WarcError("the archive ends inside a gzip member")
        self._out += self._zip.decompress(raw, 4 * self._chunk)
        self._raw = self._zip.unconsumed_tail
        if self._zip.eof:
            self.ended, self.rest = True, self._zip.unused_data
            self._raw = b""
        self.consumed += len(raw) - len(self._raw) - len(self.rest)
        return True

    def line(self) -> bytes:
        while (at := self._out.find(b"\r\n")) < 0:
            if not self._more():
                raise WarcError("a header line has no end")
        out = bytes(self._out[:at])
        del self._out[: at + 2]
        return out

    def read(self, most: int) -> bytes:
        while not self._out and self._more():
            pass
        out = bytes(self._out[:most])
        del self._out[:most]
        return out

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not (part := self.read(n)):
                raise WarcError("the block is shorter than its Content-Length")
            n -= len(part)
            yield part

    def drain(self) -> int:
        n = 0
        while part := self.read(1 << 20):
            n += len(part)
        return n


def headers(member: MemberReader) -> dict[str, str]:
    found: dict[str, str] = {}
    while line := member.line():
        name, _, value = line.partition(b":")
        found[name.decode().strip().lower()] = value.decode().strip()
    return found


def read_records(stream) -> Iterator[dict]:
    """The records of an archive, each checked: framing, block digest, and a response's payload digest."""
    for offset, member in read_members(stream):
        if (version := member.line()) != VERSION:
            raise WarcError(f"not a WARC record at byte {offset}: {version[:20]!r}")
        named = headers(member)
        block, left = hashlib.sha1(), int(named["content-length"])
        inner = bytearray()
        for part in member.exactly(left):
            block.update(part)
            inner += part
        if member.drain() != 4:
            raise WarcError(f"the record at byte {offset} isn't closed by two line ends")
        if sha1_header(block.digest()) != named["warc-block-digest"]:
            raise WarcError(f"block digest differs at byte {offset}")
        cut = inner.find(b"\r\n\r\n") + 4
        revisit = named["warc-type"] == "revisit"
        http = dict(line.lower().split(b": ", 1) for line in bytes(inner[:cut]).split(b"\r\n")[1:] if b": " in line)
        payload = None if revisit else bytes(inner[cut:])
        size = int(http[b"content-length"])
        if payload is not None and (len(payload) != size or sha1_header(hashlib.sha1(payload).digest()) != named["warc-payload-digest"]):
            raise WarcError(f"payload digest differs at byte {offset}")
        yield {
            "page_id": page_of(named["warc-record-id"]), "url": named["warc-target-uri"], "record_type": named["warc-type"],
            "refers_to": page_of(named.get("warc-refers-to")), "payload_bytes": size,
            "payload_digest": base64.b32decode(named["warc-payload-digest"].removeprefix("sha1:")).hex(),
            "payload": payload, "verified": True, "offset": offset,
        }


def write_warc(pages: DataFrame, folder: str | None = None, key: str = "page_id", url: str = "url", html: str = "html", least: int = 1000, file_bytes: int = 1 << 27) -> DataFrame:
    """Writes a record per row of ``pages`` and returns the written manifest (path, n_records, n_bytes).

    Payload: the html in UTF-8; null and empty ones are empty. Of rows whose payloads are equal and have ``least``
    bytes or more, those with the largest key are responses, the others revisits that refer to it; equal rows with
    that key are all responses. Null keys are below all others; rows whose group has null keys only are responses. A
    null url is empty. Other columns are not read. No rows: no archives, an empty manifest.

    Groups are found on digests, combined before the shuffle; payloads of ``least`` bytes or more move once, to meet
    the groups that have at least two rows, in a join whose hot keys Spark can split. Smaller ones stay where they are.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    data = F.encode(F.coalesce(pages[html].cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(pages[key].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), data.alias("payload"), F.unhex(F.sha1(data)).alias("digest"))
    large = rows.filter(F.length("payload") >= least)
    groups = large.groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first_id")).filter("n > 1 AND first_id IS NOT NULL")
    small = rows.filter(F.length("payload") < least).withColumn("first_id", F.lit(None).cast("long"))
    joined = large.join(groups.select("digest", "first_id"), "digest", "left").unionByName(small)
    revisit = F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False))
    ready = joined.select("page_id", "url", "payload", "digest", "first_id", revisit.alias("revisit"))

    def run(batches):
        files: list[tuple[str, int, int]] = []
        fs, root = pafs.FileSystem.from_uri(folder if ":" in folder else f"file://{folder}")
        out, held = None, [0, 0]
        for batch in batches:
            columns = [batch.column(c) for c in range(6)]
            for at in range(batch.num_rows):
                page_id, link, payload, digest, first_id, again = (c[at].as_py() for c in columns)
                if out is None:
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                member = record_bytes(page_id, link, payload, digest, first_id, again)
                out.write(member)
                held[0], held[1] = held[0] + 1, held[1] + len(member)
                if held[1] >= file_bytes:
                    out.close()
                    files.append((f"{folder.rstrip('/')}/{name}", *held))
                    out, held = None, [0, 0]
        if out is not None:
            out.close()
            files.append((f"{folder.rstrip('/')}/{name}", *held))
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in files], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "n_records", "n_bytes"])

    return written(ready.mapInArrow(run, MANIFEST), "warc-manifest")


def read_warc(spark: SparkSession, manifest: DataFrame, batch_bytes: int = 1 << 22) -> DataFrame:
    """All records of the archives in ``manifest``, read sequentially and checked; archives are spread over the tasks.

    A torn or changed archive raises; so does one with fewer records than the manifest says.
    """

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.string(), pa.int64()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload", "verified", "path", "offset"]
        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("n_records").to_pylist(), strict=True):
                fs, at = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
                rows, size, seen = [], 0, 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for record in read_records(stream):
                        rows.append(record | {"path": path})
                        size, seen = size + len(record["payload"] or b"") + 200, seen + 1
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds, strict=True)], names)
                            rows, size = [], 0
                if seen != n:
                    raise WarcError(f"{path} has {seen} records instead of {n}")
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(names, kinds, strict=True)], names)

    files = max(1, manifest.count())
    return manifest.repartition(min(files, 10_000), "path").mapInArrow(run, RECORDS)
