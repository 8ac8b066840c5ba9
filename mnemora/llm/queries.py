"""Queries of the corpus problems (1, 4, 6 to 10) and their SQL where SQL can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora import workspace
from mnemora.llm import ingest_dedup, language, leaks, neighbours, pii, tokens, toxicity
from mnemora.sources.tables import spread, table


def _personal_texts(spark: SparkSession, d: str) -> DataFrame:
    chat = table(spark, d, "chat_messages").select(F.lit("chat_messages").alias("rec_table"), F.col("msg_id").cast("string").alias("rec_id"), "content")
    nodes = table(spark, d, "memory_nodes").select(F.lit("memory_nodes").alias("rec_table"), F.col("node_id").alias("rec_id"), "content")
    return chat.unionByName(nodes)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    texts = spread(_personal_texts(spark, d))
    items = pii.find_pii(texts, "content", ["rec_table", "rec_id"], pii.learn_given(texts, "content"))
    return items.select("rec_table", "rec_id", "kind", "start_pos").distinct()


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    texts = spread(_personal_texts(spark, d))
    return pii.redact(texts, "content", pii.learn_given(texts, "content")).distinct()


def _speech(spark: SparkSession, d: str) -> DataFrame:
    chat = table(spark, d, "chat_messages").select(F.lit("chat_messages").alias("rec_table"), F.col("msg_id").alias("rec_id"), F.col("content").alias("text"), "lang")
    rubq = table(spark, d, "rubq_records").select(F.lit("rubq_records").alias("rec_table"), "rec_id", F.col("context").alias("text"), "lang")
    return chat.unionByName(rubq)


def _stretches(spark: SparkSession, d: str) -> DataFrame:
    rows = spread(_speech(spark, d))
    return language.find_stretches(rows, "text", language.fit(rows))


def _segments(found: DataFrame) -> DataFrame:
    return found.select("rec_table", "rec_id", F.inline("stretches")).select("rec_table", "rec_id", "seg", F.col("lang"), "confidence")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _segments(language.wrong_or_mixed(_stretches(spark, d))).select("rec_table", "rec_id", "seg", "lang").distinct()


def p1_segments(spark: SparkSession, d: str) -> DataFrame:
    return _segments(_stretches(spark, d)).withColumn("confidence", F.round("confidence", 6)).distinct()


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "memory_nodes").select(F.col("content").alias("text"))
    items = table(spark, d, "batch_ingest").select("request_id", F.posexplode("contents").alias("pos", "text"))
    history = ingest_dedup.History(spark, workspace.new_dir(spark, "history")).accept(spread(nodes))
    cases = history.check(spread(items.select(ingest_dedup.order_of("request_id", "pos").alias("id"), "text")))
    return cases.select(F.expr("id div 16777216").alias("request_id"), F.expr("id % 16777216").alias("pos"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(table(spark, d, "node_vectors"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.find_leaks(spread(table(spark, d, "documents").select("doc_id", "text")), table(spark, d, "eval_items")).distinct()


def _scored(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    return toxicity.score(spread(docs), toxicity.fit(docs, table(spark, d, "doc_labels")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.flagged(_scored(spark, d), "doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(_scored(spark, d))


QUERIES = {
    "p1_found": p1_found,
    "p1_segments": p1_segments,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p9_found": p9_found,
    "p10_found": p10_found,
    "p10_rates": p10_rates,
    "p4_found": p4_found,
    "p4_redacted": p4_redacted,
}
SQL: dict[str, str] = {}
