"""Document fingerprints: a Merkle tree over sections, paragraphs and pieces of a text.

Equal texts have equal roots; where roots differ, the branches that differ locate the edit.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callquality.llm.common import written

#: A piece ends with a sentence or a line, or after so many characters.
_PIECE = re.compile(r"[^.!?\n]{0,64}[.!?\n ]*")
#: A section ends at an empty line, or after a paragraph whose hash ends in this many zero bits.
SECTION_BITS = 3


@dataclass(frozen=True)
class Node:
    """hash: of a piece's text, or of the children's hashes; size: code points below it; count: pieces below it."""

    hash: bytes
    size: int
    children: tuple["Node", ...] = ()


def _join(mark: bytes, children: list[Node]) -> Node:
    return Node(blake2b(mark + b"".join(c.hash for c in children), digest_size=16).digest(), sum(c.size for c in children), tuple(children))


def merkle_tree(text: str | None) -> Node:
    """The tree of a text: root, sections, paragraphs (lines), pieces (sentences); null is the empty text."""
    sections: list[Node] = []
    paragraphs: list[Node] = []
    pieces: list[Node] = []
    for piece in _PIECE.findall(text or ""):
        if not piece:
            continue
        pieces.append(Node(blake2b(piece.encode("utf-8", "surrogatepass"), digest_size=16).digest(), len(piece)))
        lines = piece.count("\n")
        if lines:
            paragraphs.append(_join(b"p", pieces))
            pieces = []
            if lines > 1 or not paragraphs[-1].hash[-1] & ((1 << SECTION_BITS) - 1):
                sections.append(_join(b"s", paragraphs))
                paragraphs = []
    if pieces:
        paragraphs.append(_join(b"p", pieces))
    if paragraphs:
        sections.append(_join(b"s", paragraphs))
    return _join(b"r", sections)


def fingerprint(tree: Node) -> str:
    return tree.hash.hex()


def _unmatched(a: list[Node], b: list[Node]) -> tuple[int, list[Node], list[Node]]:
    """Size of what both have, and the children of what one has alone."""
    have = Counter(n.hash for n in b)
    shared, left, gone = 0, [], Counter()
    for n in a:
        if have[n.hash] > gone[n.hash]:
            gone[n.hash] += 1
            shared += n.size
        else:
            left.extend(n.children)
    right = []
    for n in b:
        if gone[n.hash]:
            gone[n.hash] -= 1
        else:
            right.extend(n.children)
    return shared, left, right


def likeness(a: Node, b: Node) -> float:
    """0 to 1: the share of both texts in branches that both trees have; 1 if and only if the roots are equal."""
    if a.hash == b.hash:
        return 1.0
    shared, left, right = 0, list(a.children), list(b.children)
    while left and right:
        more, left, right = _unmatched(left, right)
        shared += more
    return min(2 * shared / (a.size + b.size), 0.999999) if a.size + b.size else 0.0


def edits(a: Node, b: Node) -> list[tuple[int, int]]:
    """Spans (start, end) in code points of a's pieces that lie in differing branches and that b lacks."""
    if a.hash == b.hash:
        return []
    have = Counter(p.hash for s in b.children for q in s.children for p in q.children)
    whole = {s.hash for s in b.children} | {q.hash for s in b.children for q in s.children}
    spans, at = [], 0
    for section in a.children:
        for paragraph in section.children:
            for piece in paragraph.children:
                if section.hash not in whole and paragraph.hash not in whole and not have[piece.hash]:
                    if spans and spans[-1][1] == at:
                        spans[-1] = (spans[-1][0], at + piece.size)
                    else:
                        spans.append((at, at + piece.size))
                at += piece.size
    return spans


def document_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: doc_id, fingerprint, sections (hashes in order). Null texts are empty; nothing is shuffled."""

    def run(batches):
        for batch in batches:
            trees = [merkle_tree(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), pa.array([fingerprint(t) for t in trees], pa.string()), pa.array([[s.hash.hex() for s in t.children] for t in trees], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fingerprint", "sections"])

    return docs.select(docs[key].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, fingerprint string, sections array<string>")


def compare_neighbours(docs: DataFrame, compare, schema: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``compare(doc_id, text, tree, next_text, next_tree)`` of each document and the next in ascending order of key,
    the first after the last; rows of ``schema``.

    Null keys come first; equal keys are in order of a hash of their texts. Documents are sorted by ranges of keys, one
    shuffle of the texts; each task pairs the documents of its range, and hands over its first and its last one. Only
    these, two a task, meet once more.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    given = docs.select(docs[key].cast("long").alias("doc"), docs[text].cast("string").alias("text"))
    ranges = given.repartitionByRange(n, F.col("doc")).sortWithinPartitions("doc", F.xxhash64("text"))
    names = [part.strip().split(" ")[0] for part in schema.split(",")]
    probe = spark.createDataFrame([], schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    kinds = [to_arrow_schema(probe.schema).field(c).type for c in names]
    bounds = "task int, place int, doc long, text string"

    def rows_of(rows, edges):
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)] + [pa.nulls(len(rows), t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.string())]
        yield pa.RecordBatch.from_arrays(columns, [*names, "task", "place", "doc", "text"])
        if edges:
            columns = [pa.nulls(len(edges), t) for t in kinds] + [pa.array([e[k] for e in edges], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "task", "place", "doc", "text"])

    def run(batches):
        from pyspark import TaskContext

        task, last = TaskContext.get().partitionId(), None
        for batch in batches:
            out, edges = [], []
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                tree = merkle_tree(text)
                if last is None:
                    edges.append((task, 0, doc, text))
                else:
                    out.append(compare(*last, text, tree))
                last = (doc, text, tree)
            yield from rows_of(out, edges)
        if last is not None:
            yield from rows_of([], [(task, 1, last[0], last[1])])

    def close(batches):
        for batch in batches:
            out = []
            for doc, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc", "text", "next_text")), strict=True):
                out.append(compare(doc, text, merkle_tree(text), after, merkle_tree(after)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    found = written(ranges.mapInArrow(run, f"{schema}, {bounds}"), "neighbours")
    from pyspark.sql import Window as W

    firsts = found.filter("place = 0")
    order = W.orderBy("task")
    after = firsts.select("task").withColumn("follows", F.coalesce(F.lead("task").over(order), F.first("task").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))))
    ends = found.filter("place = 1").select("task", "doc", "text").join(after, "task").join(firsts.select(F.col("task").alias("follows"), F.col("text").alias("next_text")), "follows")
    return found.filter("task IS NULL").select(*names).unionByName(ends.select("doc", "text", "next_text").mapInArrow(close, schema))
