"""Queries of the training-data operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from . import decontaminate, langid, mixing, quality, secrets, simhash, substring, toxicity, urlfilter, warc

QUERIES: dict[str, Callable] = {
    "op1_simhash_near_dedup": simhash.op1,
    "op2_benchmark_decontamination": decontaminate.op2,
    "op3_url_filters": urlfilter.op3,
    "op4_language_id": langid.op4,
    "op5_toxicity": toxicity.op5,
    "op6_substring_dedup": substring.op6,
    "op7_mixing": mixing.op7,
    "op8_secret_scans": secrets.op8,
    "op9_quality_rules": quality.op9,
    "op10_warc": warc.op10,
}
ORACLES: dict[str, str] = {
    "op2_benchmark_decontamination": decontaminate.ORACLE,
    "op7_mixing": mixing.ORACLE,
    "op8_secret_scans": secrets.ORACLE,
    "op10_warc": warc.ORACLE,
}
