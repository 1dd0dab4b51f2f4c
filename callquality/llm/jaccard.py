"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters; pairs verified once.

Prefixes are half as long again as they need to be, by a sketch of all frequencies; exact counts then drop from each
what is most common, so that lists stay short however full the sketch is.

The components of all links come out, without all pairs going in: documents with equal sets are one node, each posting
list first compares its members with its most central one, and what that links is one component from then on. Two nodes
of one component need no comparison, so the later rounds meet across components only, until every pair of a list was
compared, filtered out or linked by others. Lists with the same members, as a shared passage makes them, are one list, a
pair meets once for each run of lists that both are in, and the largest component of a list does not meet itself.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from operator import add, and_

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callquality.llm.common import fresh, row_blocks, scratch, shingle_hashes, small_side, text_bytes, written

#: Counters of the frequency sketch that orders n-grams: a fixed number, whatever the corpus.
SKETCH_BITS, CHUNK = 22, 1 << 16
BLOCK_BYTES = 1 << 20
#: Members that a long posting list compares with all others before all meet with all.
PIVOTS = 32
#: Members of a list that one task compares with the list, and members of a hub that one task verifies.
SPLIT, HUB_MEMBERS = 2048, 128
ID_ROWS = 500_000
#: The parts of a hash partition of each set whose sizes are kept modulo 2, as bits of so many longs.
WORDS = 8
PARITY = [f"w{k}" for k in range(WORDS)]
#: What ``_live`` tells of a posting list.
LIST = ("size", "most", "few")


def _sets(texts, width: int):
    """Row number and distinct sorted n-gram hashes of each row that has any; and blocks keep memory bounded."""
    data, offsets = text_bytes(texts)
    for first, last in row_blocks(np.diff(offsets), BLOCK_BYTES):
        h, row = shingle_hashes(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], width)
        order = np.argsort(row, kind="stable")
        h, ends = h[order], np.cumsum(np.bincount(row, minlength=last - first))
        for k in range(last - first):
            yield first + k, np.unique(h[ends[k - 1] if k else 0 : ends[k]])


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _given(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(docs[key].cast("long").alias("doc"), docs[text].cast("string").alias("text"))


def set_classes(docs: DataFrame, key: str, text: str, width: int) -> DataFrame:
    """A row a document: doc, n (size of its set), hi and lo (its set's 128-bit digest); and rows of the frequency
    sketch of each task: chunk, counts."""

    def run(batches):
        counts = np.zeros(1 << SKETCH_BITS, np.int32)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        names = ["doc", "n", "hi", "lo", "chunk", "counts"]
        for batch in batches:
            n, digest = [], []
            for _, s in _sets(batch.column("text"), width):
                n.append(len(s))
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                np.add.at(counts, _bucket(s), 1)
            d = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            none = [pa.nulls(len(n), t) for t in kinds[4:]]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(n, pa.int64()), pa.array(d[:, 0]), pa.array(d[:, 1]), *none], names)
        chunks = [k for k in range(len(counts) // CHUNK) if counts[k * CHUNK : (k + 1) * CHUNK].any()]
        # A task's counts stop at 65535: they only order n-grams, and any order gives the same pairs.
        rows = [pa.array(chunks, pa.int32()), pa.array([zstandard.compress(np.minimum(counts[k * CHUNK : (k + 1) * CHUNK], 65535).astype("<u2").tobytes(), 1) for k in chunks], pa.binary())]
        yield pa.RecordBatch.from_arrays([*[pa.nulls(len(chunks), t) for t in kinds[:4]], *rows], names)

    return _given(docs, key, text).mapInArrow(run, "doc long, n long, hi long, lo long, chunk int, counts binary")


def frequency_sketch(classes: DataFrame) -> np.ndarray:
    """How many documents hold an n-gram of each bucket: 2**SKETCH_BITS numbers, the same size for any corpus."""

    def add(rows: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for c in rows.column("counts"):
            total += np.frombuffer(zstandard.decompress(c.as_py()), "<u2")
        counts = pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())
        return pa.table([rows.column("chunk").slice(0, 1), counts], ["chunk", "counts"])

    sums = np.zeros(1 << SKETCH_BITS, np.uint32)
    for r in classes.filter("chunk IS NOT NULL").select("chunk", "counts").groupBy("chunk").applyInArrow(add, "chunk int, counts binary").collect():
        sums[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["counts"], "<u4")
    return sums


def _extra(n: int, percent: int) -> int:
    """N-grams that a prefix of a set of n holds beyond those it needs: more for larger sets, fewer than any pair shares."""
    least = -(-percent * n // 100)
    return max(0, min((n - least) // 2, least - 1))


def prefixes(docs: DataFrame, key: str, text: str, width: int, percent: int, sketch: np.ndarray) -> DataFrame:
    """doc, n, grams (the prefix, rarest first by the sketch), spare (how many of them may go) and w0, w1, ... (a bit
    for each part of a hash partition of the set: whether its size is odd).

    The prefixes of linked sets, each ``_extra`` longer than needed, share one n-gram more than the smaller ``_extra``
    of both. The smallest set that links with one of n has the least overlap of n, so its ``_extra`` is spare: whichever
    order the spare n-grams are last in, the first that both share in it stays with both."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches):
        counts = shared.value
        for batch in batches:
            docs, out = batch.column("doc").to_pylist(), []
            for row, s in _sets(batch.column("text"), width):
                n = len(s)
                if n and docs[row] is not None:
                    least = -(-percent * n // 100)
                    keep = n - least + 1 + _extra(n, percent)
                    order = np.lexsort((s, counts[_bucket(s)]))[:keep]
                    odd = np.bincount((s & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
                    out.append((docs[row], n, s[order].view(np.int64), _extra(least, percent), *np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int32(), *[pa.int64()] * WORDS)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc", "n", "grams", "spare", *PARITY])

    return _given(docs, key, text).mapInArrow(run, "doc long, n long, grams array<long>, spare int" + "".join(f", {w} long" for w in PARITY))


def _alike_in_size(percent: int) -> Column:
    """Length and suffix filter of rows l and r: parts whose sizes differ in parity differ by an n-gram at least, so
    their number is a lower bound on the n-grams that only one set has."""
    n, m = F.col("l.n"), F.col("r.n")
    apart = reduce(add, [F.bit_count(F.col(f"l.{w}").bitwiseXOR(F.col(f"r.{w}"))) for w in PARITY])
    need = F.ceil(percent * (n + m) / F.lit(100 + percent))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (apart <= n + m - 2 * need)


def _in_reach(percent: int) -> Column:
    """Positional filter of rows l and r that share an n-gram: what may come before it and after it can be enough."""
    n, m, p, q = F.col("l.n"), F.col("r.n"), F.col("l.pos"), F.col("r.pos")
    return (100 + percent) * (F.least(p, q) + F.least(n - p, m - q)) >= percent * (n + m)


def _pair(x: Column, y: Column) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, width: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are as alike as asked, from the whole texts of the documents that the pairs name.

    Of each pair the document with more pairs is the hub. A task gets a hub's text once and streams the texts of its
    members past it; a hub with many members is several hubs."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("doc"))
    degree = small_side(written(ends.groupBy("doc").agg(F.count("*").alias("d")), "pair-ids"), ID_ROWS)
    of = lambda end: degree.select(F.col("doc").alias(end), F.col("d").alias(f"d_{end}"))
    first = F.col("d_a") >= F.col("d_b")
    split = F.pmod(F.xxhash64(F.when(first, F.col("b")).otherwise(F.col("a"))), F.ceil(F.greatest("d_a", "d_b") / F.lit(HUB_MEMBERS))).alias("part")
    hubs = pairs.join(of("a"), "a").join(of("b"), "b").select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("hub"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("doc"), split)
    hubs = written(hubs, "hubs")
    asked = hubs.select("doc", "hub", "part", F.lit(1).alias("member")).unionByName(hubs.select(F.col("hub").alias("doc"), "hub", "part", F.lit(0).alias("member")).distinct())
    asked = small_side(written(asked, "asked"), ID_ROWS)
    texts = _given(docs, key, text).join(asked, "doc").repartition("hub", "part").sortWithinPartitions("hub", "part", "member")

    def run(batches):
        now, hub_sets = None, {}
        for batch in batches:
            keys = list(zip(batch.column("hub").to_pylist(), batch.column("part").to_pylist(), strict=True))
            members, doc, out = batch.column("member").to_pylist(), batch.column("doc").to_pylist(), []
            for row, s in _sets(batch.column("text"), width):
                if keys[row] != now:
                    now, hub_sets = keys[row], {}
                if not members[row]:
                    hub_sets[s.tobytes()] = s
                elif len(s) and any(_linked(s, h, percent) for h in hub_sets.values()):
                    out.append(sorted((now[0], doc[row])))
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return texts.select("hub", "part", "member", "doc", "text").mapInArrow(run, "a long, b long").distinct()


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
        return False
    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
    common = int((y[at] == x).sum())
    return 100 * common >= percent * (len(x) + len(y) - common)


def components(links: DataFrame) -> DataFrame:
    """(doc, component) of every document with a link: the smallest id it reaches, by large-star and small-star steps
    until all edges lead to the smallest document of their component."""
    edges = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(small_side(written(low, "lowest"), ID_ROWS), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, "large-star")
        small = written(large.groupBy("u").agg(F.min("v").alias("m")), "small-star")
        step = large.join(small_side(small, ID_ROWS), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.withColumnRenamed("m", "v"))
        edges = written(step.filter("u <> v").distinct(), "edges")
        inner = edges.join(edges.select(F.col("v").alias("u")), "u", "left_semi")
        forked = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
        if inner.isEmpty() and forked.isEmpty():
            return edges.select(F.col("u").alias("doc"), F.col("v").alias("component"))


def rare_postings(own: DataFrame) -> DataFrame:
    """Postings (doc, n, pos, gram, several) of the n-grams that a node's prefix shares with others, without the spare
    ones that are in most prefixes. The counts are exact: a sketch that fills up leaves chance matches at the front, and
    a node that shares no more than it can spare links with nothing.

    Where several sets have one id (``several``), the least of their spares goes: that keeps more, never less."""
    nodes = own.select("doc", "n", "spare", F.posexplode("grams").alias("pos", "gram"))
    counts = written(nodes.groupBy("gram").agg(F.count("*").alias("nodes")).filter("nodes > 1"), "gram-counts")
    found = F.sort_array(F.collect_list(F.struct("nodes", "gram", "pos", "n")))
    of_doc = nodes.join(counts, "gram").groupBy("doc").agg(F.min("spare").alias("spare"), found.alias("all")).filter(F.size("all") > F.col("spare"))
    several = written(own.groupBy("doc").agg(F.count("*").alias("sets")).filter("sets > 1").select("doc", F.lit(True).alias("several")), "several-sets")
    of_doc = of_doc.join(small_side(several, ID_ROWS), "doc", "left").withColumn("several", F.coalesce("several", F.lit(False)))
    return of_doc.select("doc", "several", F.inline(F.slice("all", 1, F.size("all") - F.col("spare")))).select("doc", "n", "pos", "gram", "several")


def shared_groups(nodes: DataFrame) -> DataFrame:
    """(gram, low, high, nodes, room, same) of the n-grams in the postings of at least two nodes. N-grams with the same
    nodes, by a 128-bit digest, make the same pairs: the least stands for all ``same`` of them. Those of an id with
    several sets stay as they are, since their positions count in different sets."""
    halves = [half for seed in (0, 1) for h in [F.xxhash64("doc", F.lit(seed))] for half in (F.shiftright(h, 32), h.bitwiseAND(F.lit(0xFFFFFFFF)))]
    digest = {f"d{k}": F.sum(half) for k, half in enumerate(halves)}  # sums of halves don't overflow
    room = F.min("pos") + F.min(F.col("n") - F.col("pos"))
    of_all = {"low": F.min("doc"), "high": F.max("doc"), "nodes": F.count("*"), "room": room, "several": F.bool_or("several")} | digest
    lists = nodes.groupBy("gram").agg(*[v.alias(k) for k, v in of_all.items()]).filter("low < high")
    merged = lists.groupBy("low", "high", "nodes", *digest, F.when(F.col("several"), F.col("gram")).alias("own"))
    return merged.agg(F.min("gram").alias("gram"), F.min("room").alias("room"), F.count("*").alias("same")).select("gram", "low", "high", "nodes", "room", "same")


def lone_pairs(groups: DataFrame, own: DataFrame, percent: int) -> DataFrame:
    """(a, b) of the n-grams that two nodes share: pairs at once, if the filters let them pass."""
    sizes = own.select("doc", "n", *PARITY)
    pairs = groups.filter("nodes = 2").select(F.col("low").alias("a"), F.col("high").alias("b"), "room")
    ends = written(sizes.join(small_side(written(pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), "lone-ids"), ID_ROWS), "doc", "left_semi"), "lone-sizes")
    ends = small_side(ends)
    met = pairs.join(ends.alias("l"), F.col("a") == F.col("l.doc")).join(ends.alias("r"), F.col("b") == F.col("r.doc"))
    reach = (100 + percent) * F.col("room") >= percent * (F.col("l.n") + F.col("r.n"))
    return met.filter(reach & _alike_in_size(percent)).select("a", "b")


def shared_postings(nodes: DataFrame, own: DataFrame, groups: DataFrame) -> DataFrame:
    """Postings (gram, pos, prev, doc, n, score, w0, ...) of the lists of more than two nodes. The score of a node is how
    often others have its n-grams: the text that near-copies were made from has the highest. ``prev`` is the list before
    this one among the node's own, lists of the same size and ends side by side; null for the first, and for an id with
    several sets."""
    kept = nodes.select("doc", "pos", "gram", "several").join(groups.filter("nodes > 2").select("gram", "nodes", "low", "high", "same"), "gram")
    all_lists = F.sort_array(F.collect_list(F.struct("nodes", "low", "high", "gram", "pos"))).alias("all")
    of_doc = kept.groupBy("doc", "several").agg(F.sum(F.col("nodes") * F.col("same")).alias("score"), all_lists)
    before = lambda k: F.when(~F.col("several") & (k > 0), F.get("all", k - 1)["gram"]).alias("prev")
    of_doc = of_doc.withColumn("all", F.transform("all", lambda x, k: F.struct(x["gram"].alias("gram"), x["pos"].alias("pos"), before(k))))
    return of_doc.join(own.select("doc", "n", *PARITY), "doc").select("doc", "n", "score", *PARITY, F.inline("all"))


def _met(nodes: DataFrame, pivots: int | None, percent: int) -> DataFrame:
    """(a, b) of the members of different components that meet in a list: with its ``pivots`` most central members, one
    for each of as many salts, or (None) all with all.

    All with all: who isn't of the list's largest component meets all members, so that a large component never meets
    itself; if they are over ``SPLIT``, they are dealt to several tasks. Two nodes meet in the first list that both are
    in, and in others only if the lists before those differ."""
    if pivots:
        fields = [c for c in nodes.columns if c not in ("gram", "prev", *LIST)]
        salt = F.pmod(F.xxhash64("doc"), F.lit(pivots))
        best = F.max_by(F.struct(*fields), F.struct("score", -F.col("doc"))).alias("p")
        others, on = nodes.groupBy("gram", salt.alias("salt")).agg(best).select("gram", "p.*"), F.lit(True)
    else:
        parts = F.ceil(F.col("few") / F.lit(SPLIT)).cast("int")
        others = nodes.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
        nodes = nodes.filter("comp <> most").withColumn("part", F.pmod(F.xxhash64("doc"), parts).cast("int"))
        once = (F.col("r.comp") == F.col("r.most")) | (F.col("l.doc") < F.col("r.doc"))
        on = (F.col("l.part") == F.col("r.part")) & once & F.coalesce(F.col("l.prev") != F.col("r.prev"), F.lit(True))
    on = reduce(and_, [F.col("l.gram") == F.col("r.gram"), on, F.col("l.comp") != F.col("r.comp"), _in_reach(percent), _alike_in_size(percent)])
    return nodes.alias("l").join(others.alias("r"), on).select(*_pair(F.col("l.doc"), F.col("r.doc")))


def _live(postings: DataFrame, labels: DataFrame) -> DataFrame:
    """The postings of lists that hold two components or more, each with comp and of its list: size, most (the component
    with most members) and few (the members that aren't in it)."""
    named = postings.join(labels, "doc", "left").withColumn("comp", F.coalesce("component", "doc")).drop("component")
    of_comp = named.groupBy("gram", "comp").agg(F.count("*").alias("own"))
    live = of_comp.groupBy("gram").agg(F.sum("own").alias("size"), F.max_by("comp", F.struct("own", "comp")).alias("most"), (F.sum("own") - F.max("own")).alias("few")).filter("few > 0")
    return written(named.join(live, "gram"), "live-postings")


def link_components(postings: DataFrame, ready: DataFrame, verify, percent: int) -> DataFrame:
    """(doc, component) of the linked nodes, from their shared postings and the pairs (a, b) known beforehand: lists
    compare one member with all, then the long ones ``PIVOTS`` members, then all members of different components."""
    seen, links = [], []

    def labelled(pairs: DataFrame) -> DataFrame:
        # Written first: else the joins with earlier pairs are done below distinct, for each meeting of a pair.
        pairs = written(pairs.distinct(), "met")
        for earlier in seen:
            pairs = pairs.join(earlier, ["a", "b"], "left_anti")
        seen.append(written(pairs, "pairs"))
        links.append(written(verify(seen[-1]), "links"))
        return small_side(written(components(reduce(DataFrame.unionByName, links)), "labels"), ID_ROWS)

    postings = written(postings, "postings")
    labels = labelled(_met(postings.withColumn("comp", F.col("doc")), 1, percent).unionByName(ready))
    nodes = _live(postings, labels)
    long = nodes.filter(F.col("size") > 2 * PIVOTS)
    if not long.isEmpty():
        labels = labelled(_met(long, PIVOTS, percent))
        nodes = _live(nodes.drop("comp", *LIST), labels)
    return labels if nodes.isEmpty() else labelled(_met(nodes, None, percent))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """A row a document: doc_id, n_shingles, component_id.

    A document's set: the distinct ``width``-word shingles of its whole text, A-Z as a-z; with fewer words, the whole
    word sequence; without words (or null) the set is empty and links with nothing. Two documents link when their
    sets' Jaccard likeness is ``percent`` hundredths or more; component_id is the smallest id reachable by links.

    Rows with one id count as one document with the links of each; rows with a null id have a null component. Repeated
    rows come out as often as they went in, other columns aren't read, an empty table gives no rows.
    """
    classes = written(set_classes(docs, key, text, width), "set-classes")
    sets = classes.filter("chunk IS NULL").select("doc", "n", "hi", "lo")
    firsts = sets.filter("n > 0 AND doc IS NOT NULL").groupBy("hi", "lo").agg(F.min("doc").alias("first"))
    firsts = written(firsts, "set-firsts")
    own = prefixes(docs, key, text, width, percent, frequency_sketch(classes))
    copies = sets.filter("n > 0 AND doc IS NOT NULL").select("doc").distinct().join(firsts.select(F.col("first").alias("doc")), "doc", "left_anti")
    own = written(own.join(small_side(written(copies, "copies"), ID_ROWS), "doc", "left_anti"), "prefixes")
    nodes = written(rare_postings(own), "rare-postings")
    groups = written(shared_groups(nodes), "shared-groups")
    labels = link_components(shared_postings(nodes, own, groups), lone_pairs(groups, own, percent), lambda pairs: verified(pairs, docs, key, text, width, percent), percent)
    named = sets.join(firsts, ["hi", "lo"], "left").join(labels.withColumnRenamed("doc", "first"), "first", "left")
    whole = F.when(F.col("n") > 0, F.least(F.coalesce("component", "first"), F.col("doc"))).otherwise(F.col("doc"))
    return named.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), whole).alias("component_id"))


def near_duplicates_dropped(docs: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents without those that a document with a smaller id in their component stands for; rows with a null
    id stay. Equal ids stay together."""
    own = fresh(docs, "away")
    with scratch(docs.sparkSession):
        found = jaccard_components(docs, key, text, **how)
        away = found.filter("component_id < doc_id").select(F.col("doc_id").alias(own)).distinct()
        away = written(away, "near-duplicates", stay=True)
    away = small_side(away, ID_ROWS)
    return docs.join(away, docs[key].cast("long") == F.col(own), "left_anti")
