"""A corpus pipeline of five stages, each of which applies one of the training-data operators.

Language ID (rejected documents go), SimHash near-dedup (one document of each group stays),
benchmark decontamination (documents that hold an item go), secret scans (secrets are
replaced by a mark) and SentencePiece encoding (ids are added and decoded again as a check).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from countloom.llm import decontaminate, langid, secrets, sentencepiece_scan, simhash_dedup
from countloom.llm.common import stage, table
from countloom.sources.storage import discard, discard_since, mark


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in a language that the labelled ones teach; ``lang`` itself is left as it is.

    Models are trained on all labelled rows of the given documents: op5 holds a fold out, this stage none. Only texts that are null, have no
    letter or lie far from every language are rejected.
    """
    return langid.without_rejected(docs, langid.train(docs))


def simhash_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least doc_id of each group of near-duplicates: five-word shingles, a similarity of 0.8 or more.

    Rows that repeat a doc_id and text count once. Rows with a null doc_id cannot be named and stay. Null and empty texts are
    near-duplicates of each other. An empty table stays empty.
    """
    got = simhash_dedup.near_duplicates(docs, width=5, similarity=0.8)
    kept = stage(got.where("doc_id = component_id").select("doc_id").distinct(), "kept")
    # the same strategy at every size: texts move once, nothing that grows with the corpus is broadcast
    named = docs.join(kept.hint("merge"), "doc_id", "left_semi").select(docs.columns)
    text = F.xxhash64("text")
    repeats = docs.where("doc_id is not null").groupBy("doc_id", text.alias("text_hash")).agg(F.count("*").alias("n")).where("n > 1")
    if not repeats.isEmpty():
        # numbered within (doc_id, text), whatever the other columns are called
        first = F.row_number().over(Window.partitionBy("doc_id", text).orderBy(text))
        named = named.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), first.alias("place")).where("place = 1").select("doc.*")
    return named.unionByName(docs.where("doc_id is null"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops every document that holds an item of the benchmark; null and empty texts hold none and stay, an empty table stays empty."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document; secrets in it are replaced by a mark. Null and empty texts stay as they are, an empty table stays empty."""
    return secrets.redact(docs)


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and whether they decode to its text (U+2581 reads as a space).

    Null and empty texts have no ids; an empty table gives no rows.
    """
    done = sentencepiece_scan.encode(docs, decoded=True)
    same = F.col("decoded").eqNullSafe(F.translate(F.coalesce("text", F.lit("")), "▁", " "))
    return done.select("doc_id", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"), F.size("ids").cast("long").alias("n_tokens"), same.alias("round_trip"), "ids")


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup_stage),
    ("benchmark_decontamination", decontamination),
    ("secret_scans", secret_scan),
    ("sentencepiece", sentencepiece_stage),
]

#: The stages hold trained models and byte-pair encodings, which SQL cannot express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables between the stages are deleted as soon as the next stage's is written."""
    docs = table(spark, sf_dir, "documents")
    for name, apply in STAGES[:-1]:
        began = mark()
        last = docs
        docs = stage(apply(spark, docs, sf_dir), name)
        discard_since(spark, began, keep=(docs,))
        if hasattr(last, "staged_path"):
            discard(spark, last.staged_path)
    return STAGES[-1][1](spark, docs, sf_dir)
