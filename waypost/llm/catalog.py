"""Queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waypost.llm import (
    decontaminate, html_text, infill, mixing, near_dup, oracles, quality, secrets, substring, token_files, tool_calls, toxicity,
    turn_repair, warc
)
from waypost.llm.shared import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path() -> str:
    """The default vocabulary: where the public tokenizers are installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = token_files.tokens_of(spark, table(spark, sf_dir, "documents"), tokenizer_path())
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_text.main_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.link(table(spark, sf_dir, "documents"), shingle_words=2, percent=80)


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(table(spark, sf_dir, "documents"), weights=(3, 1, 2), ratio=1.5, cap=2)
    return taken.select("doc_id", "size", "source_size", "target", "taken")


#: Schemas of the tools that op5's calls are checked against.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer"}, "unit": {"type": "string", "enum": ["km", "m"]}}, "required": ["query"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"]},
    "fetch": {
        "type": "object",
        "properties": {"url": {"type": "string"}, "options": {"type": "object", "properties": {"depth": {"type": "integer"}, "tags": {"type": "array", "items": {"type": "string"}}}}},
        "required": ["url"],
    },
}


def op5_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table has no calls of its own, so answers of the assistant make some and messages of the user answer them."""
    messages = table(spark, sf_dir, "conversations").selectExpr(
        *[f"{sql} AS {name}" for name, sql in oracles.TOOL_MESSAGES.items()]
    )
    return tool_calls.events(messages, tool_calls.tool_schemas(spark, TOOLS))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.summaries(warc.write_archive(table(spark, sf_dir, "pages")))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=10)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.remove_repeats(table(spark, sf_dir, "documents"), k=50)
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.host_rules(table(spark, sf_dir, "documents"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ).select("doc_id", "held_out", "score", "predicted")


def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_repair.repair(turn_repair.damaged(table(spark, sf_dir, "conversations")), F.col("present"))


def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select(
        "doc.doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    of_kinds = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in secrets.BASE]
    return found.select(
        "doc.doc_id", *counts, F.sha2(secrets.shown(of_kinds(*secrets.BASE)), 256).alias("base_sha256"),
        secrets.shown(F.col("spans")).alias("spans")
    )


_ALL = (
    op1_token_files, op2_main_text, op3_minhash, op4_mixing, op5_tool_calls, op6_warc, op7_decontaminate, op8_substring,
    op9_quality, op10_toxicity, op11_turn_repair, op12_infill, op13_secrets
)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return dict(oracles.SQL)
