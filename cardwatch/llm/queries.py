"""Registered queries of the package, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardwatch.llm import (
    chat_tools, decontaminate, html_text, line_runs, merkle_log, ngram_join, piece_codec, pii, prefix_trie, quality_gam,
    quality_rules, toxicity, url_filter,
)
from cardwatch.llm.base import prepare, table

URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


ANSWER_TOOL = [("answer", [("prompt", "string", True), ("turn", "integer", True)])]


def op1_chat_tool_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's turns have no markup, so their plain turns are read as calls and results, too."""
    messages = table(spark, sf_dir, "conversations")
    tools = spark.createDataFrame(ANSWER_TOOL, "name string, parameters array<struct<name:string,type:string,required:boolean>>")
    return chat_tools.link(
        chat_tools.turn_calls(messages).unionByName(chat_tools.marked_calls(messages)),
        chat_tools.turn_results(messages).unionByName(chat_tools.marked_results(messages)),
        tools,
        every=True,
    )


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.similarity_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


def op5_quality_gam(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held_out = table(spark, sf_dir, "documents"), toxicity.fold(4, 2)
    model = quality_gam.fit(documents, table(spark, sf_dir, "labels").where(~held_out))
    return quality_gam.scores(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_gam.THRESHOLD).cast("int").alias("predicted")
    )


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def _tagged(spans: str) -> str:
    return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = pii.personal_spans(table(spark, sf_dir, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = '{kind}')) as long)").alias(f"n_{kind}") for kind in pii.KINDS]
    return spans.select(
        "doc_id", *counts,
        F.sha2(F.expr(_tagged("base")), 256).alias("base_sha256"),
        F.expr(_tagged("concat(base, found)")).alias("spans"),
    )


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to the very text."""
    vocabulary = piece_codec.read_vocabulary()
    encoded = piece_codec.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary)
    decoded = piece_codec.decode(encoded, vocabulary)
    return decoded.select("doc_id", "n_tokens", "token_ids", F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, held_out = table(spark, sf_dir, "documents"), toxicity.fold(3, 1)
    model = toxicity.fit(documents, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.scores(documents, model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted")
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).selectExpr(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated",
        "array_join(transform(spans, s -> concat(s.start, ':', s.end)), ',') as removal_spans",
    )


def op11_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_log.proofs(table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.drop_lines(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_chat_tool_links, op2_ngram_jaccard_join, op3_url_filters, op4_quality_rules, op5_quality_gam, op6_html_extraction, op7_pii,
        op8_sentencepiece, op9_toxicity, op10_decontamination, op11_conversation_prefix_trie, op12_merkle_manifest, op13_line_dedup,
    )
    return {f.__name__: (lambda spark, sf_dir, f=f: f(prepare(spark), sf_dir)) for f in every}
