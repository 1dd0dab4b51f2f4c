"""The corpus pipeline: quality rules, near-duplicate removal, repeated-passage removal, mixing, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callquality.llm.common import fresh, table, written
from callquality.llm.jaccard import near_duplicates_dropped
from callquality.llm.mixing import mix
from callquality.llm.packing import pack_documents
from callquality.llm.quality import quality_rules
from callquality.llm.suffix import repeated_bytes


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    own = fresh(docs, "rules")
    return quality_rules(docs, out_col=own).filter(F.col(own)["kept"]).drop(own)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group that near-copies link: 5-word shingles, 0.8 alike."""
    return near_duplicates_dropped(docs, width=5, percent=80)


def unrepeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of passages that a document with a smaller id has too; n_chars follows.

    A span may begin or end inside a character; what is left of such a character goes too. A null text stays null.
    """
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    own, n_bytes, spans, kept = (fresh(docs, c) for c in ("no_text", "n_bytes", "spans", "kept"))
    found = repeated_bytes(docs.withColumn(own, docs["text"].isNull()), keep=(*others, own), whole_characters=True, names=(n_bytes, spans, kept))
    found = found.withColumn("text", F.when(~F.col(own), F.col(kept).cast("string")))
    if "n_chars" in others:
        found = found.withColumn("n_chars", F.when(F.size(spans) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return found.withColumn("doc_id", F.col("doc_id").cast(docs.schema["doc_id"].dataType)).select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents, each with its sequence and place."""
    return pack_documents(docs)


STAGES = [("quality rules", good_documents), ("near duplicates", distinct_documents), ("repeated passages", unrepeated_text), ("mixing", mixed_sources), ("packing", packed)]

#: Tokenisation and hashes of the stages have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{k}-{name.replace(' ', '-')}")
    return docs
