"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from aquila.llm import bpe, chat, decontamination, html_extraction, jaccard_join, line_dedup, quality_classifier, quality_rules, sharding, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_sharding": sharding.op3_sharding,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_warc": warc.op5_warc,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_decontamination": decontamination.op7_decontamination,
    "op8_html_extraction": html_extraction.op8_html_extraction,
    "op9_bpe": bpe.op9_bpe,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}
SQL: dict[str, str] = {"op1_line_dedup": line_dedup.SQL, "op2_quality_rules": quality_rules.SQL, "op4_chat_formatting": chat.SQL, "op5_warc": warc.SQL, "op10_jaccard_join": jaccard_join.SQL}
