"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import brown, html_text, langid, mixing, packing, quality, repeats, secrets, simhash, sql, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": html_text.op1_html,
    "op2_repeats": repeats.op2_repeats,
    "op3_packing": packing.op3_packing,
    "op4_topk": topk.op4_topk,
    "op5_brown": brown.op5_brown,
    "op6_secrets": secrets.op6_secrets,
    "op7_mixing": mixing.op7_mixing,
    "op8_langid": langid.op8_langid,
    "op9_quality": quality.op9_quality,
    "op10_simhash": simhash.op10_simhash,
}
ORACLE_SQL: dict[str, str] = {"op4_topk": sql.TOPK, "op6_secrets": sql.SECRETS, "op9_quality": sql.QUALITY}
