"""The registered queries of this subpackage, their SQL, and the corpus pipeline."""

from __future__ import annotations

import corpus_pipeline
from gridloom.llm import classifier, decontaminate, lines, mixing, quality, secrets, simhash, substring, tokenfiles, warc

_OPERATORS = {
    "op1_secret_scan": secrets,
    "op2_decontamination": decontaminate,
    "op3_substring_dedup": substring,
    "op4_token_files": tokenfiles,
    "op5_quality_classifier": classifier,
    "op6_line_dedup": lines,
    "op7_source_mixing": mixing,
    "op8_warc_revisits": warc,
    "op9_quality_rules": quality,
    "op10_simhash": simhash,
}


def queries() -> dict:
    return {name: module.query for name, module in _OPERATORS.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = {name: sql for name, module in _OPERATORS.items() if (sql := getattr(module, "SQL", None))}
    return found | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
