"""Merkle manifest of a dataset: a tree a group over the digests of its rows, a tree over the groups' roots.

Checkpoint and recompute: of each tree only every ``stride``-th level is written. Between two written levels lie aligned
subtrees of at most fan**stride nodes; a task rebuilds the interior of one from its stored lower nodes, hands the
siblings on, and forgets it. Work and shuffles are one row a leaf; upper levels are smaller by fan**stride each.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType

from callquality.llm.common import small_side, written

#: A proof, bottom to top: digests of the run left and right of the node's own place, each joined as text.
PROOF = "array<struct<left:string,right:string>>"


def field_text(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, a colon and the value as text."""
    text = value.cast("string")
    return F.when(text.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def row_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field_text(v) for v in values]), 256)


def digest_of(parts: Sequence[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def interior(digests: list[str], fan: int, height: int) -> list[list[str]]:
    """The levels of a subtree, the given one first; a last run of fewer nodes, even of one, becomes its digest too."""
    levels = [digests]
    for _ in range(height):
        below = levels[-1]
        levels.append([digest_of(below[k : k + fan]) for k in range(0, len(below), fan)])
    return levels


def siblings(levels: list[list[str]], place: int, fan: int) -> list[tuple[str, str]]:
    """What stands left and right of a node in its run, level by level below the subtree's root."""
    out = []
    for level in levels[:-1]:
        run = place - place % fan
        out.append(("".join(level[run:place]), "".join(level[place + 1 : run + fan])))
        place //= fan
    return out


@dataclass(frozen=True)
class Tree:
    """levels: written tables (grp, pos, digest; leaves also row), every ``stride``-th level of all trees, roots last; sizes: nodes a group on the lowest level."""

    levels: list[DataFrame]
    sizes: DataFrame
    fan: int
    stride: int

    @property
    def roots(self) -> DataFrame:
        """grp, digest: one row a group."""
        return self.levels[-1].select("grp", "digest")


@dataclass(frozen=True)
class Manifest:
    """leaves: the written leaves with their groups and places; groups: the trees of all groups; top: the tree over their roots."""

    groups: Tree
    top: Tree

    @property
    def root(self) -> str | None:
        """The digest of the whole dataset; None for an empty one."""
        row = self.top.roots.head()
        return row["digest"] if row else None


def numbered(rows: DataFrame, order: Sequence[str], label: str) -> tuple[DataFrame, DataFrame]:
    """The rows with ``pos``, their place in their ``grp`` by ``order`` from 0, and the sizes of the groups.

    Tasks sort ranges of (grp, order), whatever the size of a group, number their own rows and add what earlier ranges
    of the group hold. Rows that are equal in all of ``order`` stand next to each other, in any order.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = ["grp", *order]
    ranged = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    columns = [*rows.columns, "task", "local"]

    def number(batches):
        from pyspark import TaskContext

        task, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column("grp").dictionary_encode()
            at = codes.indices.to_numpy()
            starts = np.concatenate([[0], np.flatnonzero(np.diff(at)) + 1])
            local = np.arange(len(at)) - np.repeat(starts, np.diff(np.concatenate([starts, [len(at)]])))
            if codes.dictionary[int(at[0])].as_py() == last:
                first = starts[1] if len(starts) > 1 else len(at)
                local[:first] += held
            last, held = codes.dictionary[int(at[-1])].as_py(), int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(at), task, np.int32)), pa.array(local)], columns)

    local = written(ranged.mapInArrow(number, StructType(list(rows.schema)).add("task", IntegerType()).add("local", LongType())), f"{label}-sorted")
    counts = written(local.groupBy("grp", "task").agg(F.count(F.lit(1)).alias("n")), f"{label}-counts")
    before = W.partitionBy("grp").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("grp", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    offsets = small_side(written(offsets, f"{label}-offsets"))
    placed = local.join(offsets, ["grp", "task"]).withColumn("pos", F.col("offset") + F.col("local")).drop("task", "local", "offset")
    return written(placed, f"{label}-placed"), written(counts.groupBy("grp").agg(F.sum("n").alias("size")), f"{label}-sizes")


def _height(size: Column, fan: int, stride: int) -> Column:
    """Levels of a subtree whose group has ``size`` nodes on the subtree's lowest level: all of the tree if it fits."""
    out = F.lit(stride)
    for k in reversed(range(stride)):
        out = F.when(size <= fan**k, k).otherwise(out)
    return out


def _subtrees(nodes: DataFrame, sizes: DataFrame, fan: int, stride: int, level: int, keep: Sequence[str] = ()) -> DataFrame:
    """One row a subtree: grp, block, height, nodes in any order (at most fan**stride)."""
    width, below = fan**stride, fan ** (stride * level)
    size = F.ceil(F.col("size") / below)
    grouped = nodes.groupBy("grp", F.floor(F.col("pos") / width).cast("long").alias("block")).agg(F.collect_list(F.struct("pos", "digest", *keep)).alias("nodes"))
    return grouped.join(small_side(sizes), "grp").select("grp", "block", _height(size, fan, stride).cast("int").alias("height"), "nodes")


def _in_order(nodes) -> pa.StructArray:
    """The nodes of one subtree by their places."""
    return nodes.values.take(pa.array(np.argsort(nodes.values.field("pos").to_numpy())))


def grow(nodes: DataFrame, sizes: DataFrame, fan: int, stride: int, label: str) -> Tree:
    """The trees over written nodes (grp, pos, digest); writes every ``stride``-th level until each group has one node."""
    top = sizes.agg(F.max("size")).head()[0] or 0
    levels, level = [nodes], 0

    def roots(batches):
        for batch in batches:
            found = []
            for height, below in zip(batch.column("height").to_pylist(), batch.column("nodes"), strict=True):
                found.append(interior(_in_order(below).field("digest").to_pylist(), fan, height)[-1][0])
            yield pa.RecordBatch.from_arrays([batch.column("grp"), batch.column("block"), pa.array(found, pa.string())], ["grp", "pos", "digest"])

    while level == 0 or top > fan ** (stride * level):
        below = levels[-1].select("grp", "pos", "digest")
        levels.append(written(_subtrees(below, sizes, fan, stride, level).mapInArrow(roots, "grp string, pos long, digest string"), f"{label}-level"))
        level += 1
    return Tree(levels, sizes, fan, stride)


def build_manifest(rows: DataFrame, group: str, order: Sequence[str], digest: str = "digest", keep: Sequence[str] = (), fan: int = 2, stride: int = 10) -> Manifest:
    """The manifest of ``rows``, whose column ``digest`` holds each row's digest as lower-case hex.

    A tree a value of ``group`` (null is one, and comes first), leaves ascending by ``order`` (nulls first; ties by
    digest; rows equal in all that are interchangeable). While several nodes remain, every ``fan`` consecutive ones
    become their digest. The roots of the groups, in order of the group's text by UTF-8 bytes, likewise give the root.
    The columns ``keep``, of any name and type, stay with the leaves as ``row``. An empty table gives empty tables and no
    root. Null digests are not allowed.
    """
    places = [f"o{k}" for k in range(len(order))]
    given = rows.select(
        F.coalesce(F.concat(F.lit("="), rows[group].cast("string")), F.lit("")).alias("grp"), *[rows[c].alias(o) for c, o in zip(order, places, strict=True)], rows[digest].alias("digest"),
        F.struct(*[rows[c] for c in keep] or [F.lit(True).alias("leaf")]).alias("row"),
    )
    leaves, sizes = numbered(written(given, "manifest-leaves"), [*places, "digest"], "manifest")
    groups = grow(leaves, sizes, fan, stride, "manifest")
    tops = groups.roots.select(F.lit("").alias("grp"), F.col("grp").alias("key"), "digest")
    placed, count = numbered(tops, ["key"], "manifest-top")
    return Manifest(groups, grow(placed, count, fan, stride, "manifest-top"))


def _descend(tree: Tree, roots: DataFrame, keep: str) -> DataFrame:
    """The lowest nodes of the trees, their column ``keep``, and ``proof`` up to their roots and on along the roots' own proofs.

    ``roots``: grp, pos = 0, subroot, proof. From the top written level down, each subtree meets the proof of its root,
    one row a subtree, and its interior is rebuilt from the nodes below.
    """
    above, fan = roots, tree.fan
    for level in reversed(range(len(tree.levels) - 1)):
        names = [keep] if level == 0 else []
        nested = _subtrees(tree.levels[level].select("grp", "pos", "digest", *names), tree.sizes, fan, tree.stride, level, names)
        met = nested.join(above.select("grp", F.col("pos").alias("block"), "subroot", "proof"), ["grp", "block"])
        schema = StructType(list(met.select("grp", F.lit(0).cast("long").alias("pos"), F.lit("").alias("digest"), "subroot", "proof", *[F.get("nodes", F.lit(0))[c].alias(c) for c in names]).schema))

        def proofs(batches, names=names):
            for batch in batches:
                for k in range(batch.num_rows):
                    below = _in_order(batch.column("nodes")[k])
                    digests = below.field("digest").to_pylist()
                    levels = interior(digests, fan, batch.column("height")[k].as_py())
                    on = [(s["left"], s["right"]) for s in batch.column("proof")[k].as_py()]
                    left, right, ends = [], [], [0]
                    for place in range(len(digests)):
                        for a, b in (*siblings(levels, place, fan), *on):
                            left.append(a)
                            right.append(b)
                        ends.append(len(left))
                    pairs = pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], ["left", "right"])
                    n = len(digests)
                    columns = [pa.array([batch.column(c)[k].as_py()] * n, pa.string()) for c in ("grp", "subroot")]
                    columns = [columns[0], below.field("pos"), below.field("digest"), columns[1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), *[below.field(c) for c in names]]
                    yield pa.RecordBatch.from_arrays(columns, ["grp", "pos", "digest", "subroot", "proof", *names])

        above = met.mapInArrow(proofs, schema)
        if level:
            above = written(above, "manifest-proofs")
    return above


def inclusion_proofs(manifest: Manifest) -> DataFrame:
    """A row a leaf: grp, pos, digest, subroot (its group's), proof (to the root of the whole), row (the columns kept).

    A proof lists, level by level from the leaf, the digests left and right of the node in its run; a run of one has
    none. Interior nodes that were not written are rebuilt a subtree at a time.
    """
    top = manifest.top
    start = top.roots.select("grp", F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), F.expr(f"CAST(array() AS {PROOF})").alias("proof"))
    above = _descend(top, start, "key")
    roots = written(above.select(F.col("key").alias("grp"), F.lit(0).cast("long").alias("pos"), F.col("digest").alias("subroot"), "proof"), "manifest-proofs")
    return _descend(manifest.groups, roots, "row")


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof give."""
    return F.aggregate(proof, leaf, lambda h, s: F.sha2(F.concat(s["left"], h, s["right"]), 256))


def proof_digest(proof: Column) -> Column:
    """Digest of a proof's siblings, bottom to top, left to right."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(s["left"], s["right"])), ""), 256)
