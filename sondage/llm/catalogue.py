"""Queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, htmltext, langid, licenses, mixing, pii, quality, repeats, simhash, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": langid.query,
    "op2_html_main_text": htmltext.query,
    "op3_license_spans": licenses.query,
    "op4_maximal_repeats": repeats.query,
    "op5_personal_data": pii.query,
    "op6_exact_top_k": topk.query,
    "op7_simhash_near_dedup": simhash.query,
    "op8_decontaminate": decontaminate.query,
    "op9_line_quality": quality.query,
    "op10_source_mix": mixing.query,
}
SQL: dict[str, str] = {
    "op3_license_spans": licenses.SQL,
    "op6_exact_top_k": topk.SQL,
    "op8_decontaminate": decontaminate.SQL,
}
