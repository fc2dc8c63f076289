"""The registered queries of the training-data operators: thin digests of what the operators return."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, cover_dedup, decontaminate, hard_negatives, langid, page_text, rlbwt_dedup, secrets, sentencepiece_scan, simhash_dedup, spelling, sql, training_order, vector_graph
from .common import shared_dir, stage, table


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = rlbwt_dedup.dedup_bytes(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_graph.near_duplicates(table(spark, sf_dir, "embeddings"))


def embedding_recall_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of op2 over all rows whose id 100 divides, by brute force against all rows."""
    vectors = table(spark, sf_dir, "embeddings")
    return vector_graph.audit_recall(vectors, stage(vector_graph.near_duplicates(vectors), "near-vectors"))


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = simhash_dedup.simhash_components(table(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: A conversation whose texts hold the control strings of common templates.
PROBE = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(probe)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.held_out(F.col("doc_id"))
    model = langid.train(docs.where(~out))
    return langid.predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sentencepiece_scan.decode(sentencepiece_scan.encode(table(spark, sf_dir, "documents").select("doc_id", "text")))
    same = F.col("decoded").eqNullSafe(F.translate(F.coalesce("text", F.lit("")), "\u2581", " "))
    ids = F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256")
    return got.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids, F.sha2("decoded", 256).alias("decoded_sha256"), same.alias("round_trip"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/countloom/training-order-{uuid.uuid4().hex}"
    training_order.materialise(table(spark, sf_dir, "documents"), path)
    got = training_order.read(spark, path)
    return got.select("slot", "sequence", "n_tokens", F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = cover_dedup.dedup_windows(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["kind"] != "random")
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return got.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.count_words(table(spark, sf_dir, "documents"), change=spelling.slipped()))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"), label=label)


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_embedding_dedup, op3_simhash_dedup, op4_chat_formatting, op5_language_id, op6_sentencepiece, op7_benchmark_decontamination, op8_training_order, op9_substring_dedup, op10_secret_scans, op11_spelling_variants, op12_hard_negatives, op13_html_extraction, embedding_recall_audit)}
#: Queries that hash with XXH64, encode with a vocabulary, train a model or search windows by similarity have no twin; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": sql.OP1, "op2_embedding_dedup": sql.OP2, "op4_chat_formatting": sql.OP4, "op9_substring_dedup": sql.OP9, "op11_spelling_variants": sql.OP11, "op12_hard_negatives": sql.OP12}
