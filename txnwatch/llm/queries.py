"""Registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from txnwatch.llm.chat_format import chat_report
from txnwatch.llm.decontaminate import leak_report
from txnwatch.llm.html_text import extract
from txnwatch.llm.language import language_id
from txnwatch.llm.line_dedup import line_report
from txnwatch.llm.mixing import mix_sources
from txnwatch.llm.near_dedup import component_report
from txnwatch.llm.passages import quality_scores
from txnwatch.llm.quality_rules import quality_rules
from txnwatch.llm.spelling import spelling_report
from txnwatch.llm.sql import SQL as SQL
from txnwatch.llm.suffixes import repeat_report
from txnwatch.llm.turn_repair import repair_report
from txnwatch.llm.url_filter import filter_urls


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": lambda s, d: quality_rules(_table(s, d, "documents")).drop("text"),
    "op2_mixing": lambda s, d: mix_sources(_table(s, d, "documents")),
    "op3_minhash": lambda s, d: component_report(_table(s, d, "documents")),
    "op4_html_text": lambda s, d: extract(_table(s, d, "pages")),
    "op5_suffixes": lambda s, d: repeat_report(_table(s, d, "documents")),
    "op6_language_id": lambda s, d: language_id(_table(s, d, "documents")),
    "op7_decontamination": lambda s, d: leak_report(_table(s, d, "documents"), _table(s, d, "benchmark")),
    "op8_quality_classifier": lambda s, d: quality_scores(_table(s, d, "documents"), _table(s, d, "labels")),
    "op10_line_dedup": lambda s, d: line_report(_table(s, d, "documents")),
    "op11_spelling_variants": lambda s, d: spelling_report(_table(s, d, "documents")),
    "op12_turn_repair": lambda s, d: repair_report(_table(s, d, "conversations")),
    "op13_chat_format": lambda s, d: chat_report(_table(s, d, "conversations")),
    "op9_url_filter": lambda s, d: filter_urls(_table(s, d, "pages")),
}
