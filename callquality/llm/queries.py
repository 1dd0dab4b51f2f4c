"""The registered queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callquality.llm.chat import format_chats, loss_texts, read_turns
from callquality.llm.common import table
from callquality.llm.html import extract_main_text, labelled_pages
from callquality.llm.jaccard import jaccard_components
from callquality.llm.langid import identify_language, learn_dictionaries
from callquality.llm.layouts import fit_on_pages
from callquality.llm.manifest import build_manifest, folded, inclusion_proofs, proof_digest, row_digest
from callquality.llm.merkle import compare_neighbours, fingerprint, likeness, merkle_tree
from callquality.llm.mixing import mixing_plan
from callquality.llm.oracles import ORACLES
from callquality.llm.packing import default_vocabulary, load_encoder, pack_documents
from callquality.llm.quality import quality_rules
from callquality.llm.rulefit import fit_rules, labelled_examples, score_quality
from callquality.llm.suffix import repeated_bytes
from callquality.llm.variants import group_variants, letter_runs, vocabulary
from callquality.llm.warc import read_warc, write_warc


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_warc(table(spark, sf_dir, "pages"))
    return read_warc(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column is read back from the formatted ids, mask and text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")], turns.schema)
    vocabulary = default_vocabulary()

    def digest(batches):
        encoder = load_encoder(vocabulary)
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for conv_id, text, ids, loss in zip(batch.column("conv_id").to_pylist(), batch.column("text").to_pylist(), batch.column("ids"), batch.column("loss"), strict=True):
                ids, loss = ids.values.to_numpy(), loss.values.to_numpy()
                turns = read_turns(encoder, ids, loss)
                kept = "".join(loss_texts(encoder, ids, loss))
                whole = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t, _ in turns).encode()).hexdigest()
                for column, v in zip(out, (conv_id, len(turns), whole, len(kept), hashlib.sha256(kept.encode()).hexdigest(), len(text)), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    chats = format_chats(turns.unionByName(extra), vocabulary).select("conv_id", "text", "ids", "loss")
    return chats.mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op3_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    def compare(doc_id, text, tree, after, next_tree):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        other = merkle_tree(edited)
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return doc_id, len(text), digest, fingerprint(tree), fingerprint(other), likeness(tree, other), likeness(tree, next_tree)

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return compare_neighbours(table(spark, sf_dir, "documents"), compare, schema)


def _held_out(folds: int, fold: int):
    """Whether a document is kept from learning; one without an id is."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds)) == fold, F.lit(True))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best language is the prediction, also where the operator would reject it for its margin."""
    docs = table(spark, sf_dir, "documents")
    dictionaries = learn_dictionaries(docs.filter(~_held_out(4, 2)))
    found = identify_language(docs.select("doc_id", "text"), dictionaries)
    return found.select("doc_id", _held_out(4, 2).alias("held_out"), F.col("language.best").alias("lang_pred"), F.col("language.score").alias("score"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return found.select("doc_id", *[F.col("quality_rules")[n].alias(n) for n in names])


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = fit_rules(labelled_examples(docs, labels.filter(~_held_out(5, 0))))
    found = score_quality(docs, model)
    return found.select("doc_id", _held_out(5, 0).alias("held_out"), F.col("quality.score").alias("score"), F.col("quality.predicted").alias("predicted"))


def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    at = F.col("mix")
    return plan.select("doc_id", at["size"].alias("size"), at["source_size"].alias("source_size"), at["target"].alias("target"), (at["copies"] * at["size"]).alias("taken"))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.col("n_bytes") - F.length("kept")
    return found.select("doc_id", "n_bytes", removed.cast("long").alias("n_removed"), (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), width=3, percent=90)


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs are those of the untampered rows; a tampered row folds with them to another root."""
    docs = table(spark, sf_dir, "documents")
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    tampered = (F.crc32(F.col("doc_id").cast("string")) % 7 == 0) & F.col("n_chars").isNotNull()
    changed = F.when(tampered, row_digest([F.col(c) + 1 if c == "n_chars" else F.col(c) for c in fields]))
    rows = docs.select("doc_id", "lang", row_digest([F.col(c) for c in fields]).alias("digest"), changed.alias("changed"))
    manifest = build_manifest(rows, "lang", ["doc_id"], keep=["doc_id", "changed"])
    root = F.lit(manifest.root)
    proofs = inclusion_proofs(manifest).withColumn("folded_root", folded(F.coalesce("row.changed", "digest"), F.col("proof")))
    return proofs.select("row.doc_id", F.col("digest").alias("leaf"), "subroot", root.alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"))


def op12_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract_main_text(pages, fit_on_pages(labelled_pages(pages)))
    text = F.array_join("main", " ")
    return found.select("page_id", "url", text.alias("text"), F.char_length(text).cast("long").alias("n_chars"))


def op13_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some runs lose a letter first, by a hash of document and run; in a document without an id none does."""
    runs = table(spark, sf_dir, "documents").select("doc_id", F.explode(letter_runs(F.col("text"))).alias("run"))
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run")))
    place = (F.col("h") % F.char_length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), place), F.substring("run", place + 2, F.char_length("run")))
    words = runs.filter(F.char_length("run") >= 6).withColumn("h", h).select(F.when(F.col("h") % 199 == 0, shorter).otherwise(F.col("run")).alias("word"))
    return group_variants(vocabulary(words))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_chat_format": op2_chat_format,
    "op3_pack": op3_pack,
    "op4_fingerprint": op4_fingerprint,
    "op5_language": op5_language,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_mix": op8_mix,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_jaccard_join": op10_jaccard_join,
    "op11_manifest": op11_manifest,
    "op12_html": op12_html,
    "op13_variants": op13_variants,
}

__all__ = ["ORACLES", "QUERIES"]
