"""The operators' queries, by name, and the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, fertility, lines, minhash, packing, quality, suffixes, token_orc, toxicity, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": packing.query,
    "op2_warc_archive": warc.query,
    "op3_line_dedup": lines.query,
    "op4_toxicity": toxicity.query,
    "op5_minhash": minhash.query,
    "op6_quality_classifier": quality.query,
    "op7_repeated_passages": suffixes.query,
    "op8_token_orc": token_orc.query,
    "op9_decontamination": decontaminate.query,
    "op10_fertility": fertility.query,
}

ORACLE_SQL: dict[str, str] = {
    "op2_warc_archive": warc.ORACLE,
    "op7_repeated_passages": suffixes.ORACLE,
    "op9_decontamination": decontaminate.ORACLE,
}
