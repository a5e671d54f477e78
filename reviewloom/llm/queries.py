"""Registered queries of the pipeline operators and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from reviewloom.llm import decontaminate, fill_middle, importance, near_dup, vectors
from reviewloom.llm.decontaminate import op1_decontaminate
from reviewloom.llm.fill_middle import op12_fill_middle
from reviewloom.llm.importance import op11_importance
from reviewloom.llm.katz import op3_katz
from reviewloom.llm.mixture import op13_language
from reviewloom.llm.near_dup import op2_near_dup
from reviewloom.llm.packing import op5_packing
from reviewloom.llm.pii import op6_pseudonyms
from reviewloom.llm.quality import op9_quality
from reviewloom.llm.secret_scan import op8_secret_scan
from reviewloom.llm.token_files import op7_token_files
from reviewloom.llm.toxicity import op4_toxicity
from reviewloom.llm.vectors import op10_near_vectors

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_near_dup": op2_near_dup,
    "op3_katz": op3_katz,
    "op4_toxicity": op4_toxicity,
    "op5_packing": op5_packing,
    "op6_pseudonyms": op6_pseudonyms,
    "op7_token_files": op7_token_files,
    "op8_secret_scan": op8_secret_scan,
    "op9_quality": op9_quality,
    "op10_near_vectors": op10_near_vectors,
    "op11_importance": op11_importance,
    "op12_fill_middle": op12_fill_middle,
    "op13_language": op13_language,
    "pipeline": corpus_pipeline.run,
}

ORACLES: dict[str, str] = {
    "op1_decontaminate": decontaminate.ORACLE,
    "op2_near_dup": near_dup.ORACLE,
    "op10_near_vectors": vectors.ORACLE,
    "op11_importance": importance.ORACLE,
    "op12_fill_middle": fill_middle.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Query name to a function of the session and a folder of parquet tables."""
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the same columns and rows as the query of the same name."""
    return dict(ORACLES)
