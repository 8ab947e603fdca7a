"""Queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chat, decontaminate, html_text, langid, mixing, pii, simhash, tokencount, tokenids, topk

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": pii.op1_pii,
    "op2_simhash": simhash.op2_simhash,
    "op3_langid": langid.op3_langid,
    "op4_token_counts": tokencount.op4_token_counts,
    "op5_chat": chat.op5_chat,
    "op6_topk": topk.op6_topk,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_mixing": mixing.op8_mixing,
    "op9_token_ids": tokenids.op9_token_ids,
    "op10_html_text": html_text.op10_html_text,
}

ORACLE_SQL: dict[str, str] = {
    "op5_chat": chat.ORACLE_SQL,
    "op6_topk": topk.ORACLE_SQL,
    "op7_decontaminate": decontaminate.ORACLE_SQL,
}
