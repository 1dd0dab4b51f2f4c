"""Language identification by compression: the language whose dictionary makes a text smallest."""

from __future__ import annotations

import re
from dataclasses import dataclass

import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNKNOWN = "und"
_OTHER = re.compile(r"[\W\d_]+")


def normal(text: str | None) -> bytes:
    """Lower-case letters with single spaces between their runs; empty if there is no letter."""
    bare = _OTHER.sub(" ", (text or "").lower()).strip()
    if not bare.replace(" ", "a").isalpha():  # numbers such as superscripts count as parts of words in a pattern
        bare = " ".join("".join(c if c.isalpha() else " " for c in bare).split())
    return f" {bare} ".encode("utf-8", "ignore") if bare else b""


def learn_dictionaries(docs: DataFrame, lang: str = "lang", text: str = "text", key: str = "doc_id", sample_docs: int = 256, dictionary_bytes: int = 1 << 16) -> dict[str, bytes]:
    """Raw-content dictionaries of at most ``dictionary_bytes`` (64 KB): the word pairs that most of the examples have,
    the most common last, where the compressor reaches them best.

    The sample: of each language ``sample_docs`` documents, those with the smallest hashes of their keys among those
    that have a letter; all pairs of their whole texts are counted, once a document. A null language or text is no
    example. Pairs with equal counts go by their bytes. Languages with more examples come first.
    """
    given = docs.select(docs[lang].cast("string").alias("lang"), docs[text].cast("string").alias("text"), F.xxhash64(docs[key].cast("string"), docs[lang]).alias("draw"))
    given = given.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r["lang"]: r["n"] for r in given.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    # About four times as many as asked for have a draw this small; the exact choice is among them.
    top = F.lit(None).cast("double")
    for name, n in sorted(counts.items()):
        top = F.when(F.col("lang") == name, F.lit(-(2.0**63) + 2.0**64 * min(1.0, (4 * sample_docs + 50) / n))).otherwise(top)
    drawn = given.filter(F.col("draw").cast("double") <= top)
    ranked = drawn.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("draw", F.xxhash64("text")))).filter(F.col("rank") <= sample_docs)
    words = F.array_remove(F.split(F.lower("text"), r"[^\p{L}]+"), "")
    pairs = F.transform("words", lambda w, i: F.concat_ws(" ", w, F.get(F.col("words"), i + 1)))
    each = ranked.select("lang", words.alias("words")).select("lang", F.explode(F.array_distinct(pairs)).alias("pair"))
    common = each.groupBy("lang", "pair").agg(F.count("*").alias("n")).filter(F.octet_length("pair") < dictionary_bytes)
    order = W.partitionBy("lang").orderBy(F.desc("n"), "pair")
    first = common.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= dictionary_bytes // 2)
    kept = first.withColumn("upto", F.sum(F.octet_length("pair") + 1).over(order.rowsBetween(W.unboundedPreceding, W.currentRow))).filter(F.col("upto") < dictionary_bytes)
    found: dict[str, list[bytes]] = {}
    for r in kept.select("lang", "rank", "pair").collect():
        found.setdefault(r["lang"], []).append((r["rank"], r["pair"].encode("utf-8", "ignore")))
    return {name: b" ".join([b"", *[pair for _, pair in sorted(found[name], reverse=True)], b""]) for name in sorted(found, key=lambda x: (-counts[x], x))}


#: A margin below this is looked at again with a stronger compressor.
CLOSE = 0.05
#: Bytes of the dictionary that are compressed before a text in the second look, for the sake of their letter statistics.
PRIMER_BYTES = 4096
#: Texts are compressed in blocks of so many bytes, each against the whole dictionary, however long the text is.
BLOCK_BYTES = 1 << 16


def blocks(data: bytes) -> list[bytes]:
    return [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]


@dataclass(frozen=True)
class Packer:
    name: str
    quick: zstandard.ZstdCompressor
    strong: zstandard.ZstdCompressor
    primer: bytes

    def size(self, data: bytes) -> int:
        return sum(len(self.quick.compress(b)) for b in blocks(data))

    def primed_size(self, data: bytes) -> int:
        """What the text adds to a frame that holds the primer already."""
        total = 0
        for b in blocks(data):
            frame = self.strong.compressobj()
            frame.compress(self.primer)
            frame.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK)
            total += len(frame.compress(b) + frame.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK))
        return total


def packers_of(dictionaries: dict[str, bytes]) -> list[Packer]:
    plain = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
    quick = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_DFAST, min_match=4, hash_log=15, chain_log=15, window_log=19, **plain)
    strong = zstandard.ZstdCompressionParameters.from_level(12, strategy=zstandard.STRATEGY_BTULTRA2, min_match=3, window_log=18, **plain)
    out = []
    for name, data in dictionaries.items():
        raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        out.append(Packer(name, *(zstandard.ZstdCompressor(dict_data=raw, compression_params=p) for p in (quick, strong)), data[-PRIMER_BYTES:]))
    return out


def _verdict(sizes: list[tuple[int, str]]) -> tuple[str, float, float]:
    # A stable sort: of equal sizes the first dictionary wins, that of the language with more examples.
    (best, name), *others = sorted(sizes, key=lambda x: x[0])
    score = 1.0 / (1.0 + sum(2.0 ** -min(size - best, 1000) for size, _ in others))
    return name, score, (others[0][0] - best) / max(1, others[0][0]) if others else 1.0


def classify(packers: list[Packer], text: str | None) -> tuple[str, float, float]:
    """The best language, its score (0 to 1) and its margin: how much smaller than the second, as a share.

    The score is the best language's among weights of one half for each byte above the best."""
    data = normal(text)
    if not data or not packers:
        return UNKNOWN, 0.0, 0.0
    first = _verdict([(p.size(data), p.name) for p in packers])
    if first[2] >= CLOSE:
        return first
    return _verdict([(p.primed_size(data), p.name) for p in packers])


def identify_language(docs: DataFrame, dictionaries: dict[str, bytes], text: str = "text", out_col: str = "language", least_margin: float = 0.005) -> DataFrame:
    """All columns of ``docs`` and the struct ``out_col``: best, score, margin, rejected, lang.

    ``lang`` is ``best`` unless the margin is below ``least_margin``, then ``und``; both are ``und``, with score 0, for
    null texts and texts without a letter, or with no dictionaries. Whole texts are compressed; nothing is shuffled. A
    column that is already named ``out_col`` is replaced. The dictionaries are broadcast, of the size that
    ``learn_dictionaries`` bounds.
    """
    kept = docs.drop(out_col)
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    @F.pandas_udf("best string, score double, margin double")
    def found(texts):
        import pandas as pd

        packers = packers_of(shared.value)
        return pd.DataFrame([classify(packers, t) for t in texts], columns=["best", "score", "margin"])

    at: Column = F.col(out_col)
    scored = kept.withColumn(out_col, found(kept[text].cast("string")))
    rejected = (at["best"] == UNKNOWN) | (at["margin"] < least_margin)
    return scored.withColumn(out_col, F.struct(at["best"].alias("best"), at["score"].alias("score"), at["margin"].alias("margin"), rejected.alias("rejected"), F.when(rejected, F.lit(UNKNOWN)).otherwise(at["best"]).alias("lang")))
