"""One query for each operator, over its whole table, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import corpus_pipeline
from usage_trace.llm import ann, decontaminate, html_extract, language_id, license_scan, lm_scoring, mixing, simhash, substring_dedup, token_counts
from usage_trace.llm.common import table

QUERIES = {
    "op1_mixing": lambda spark, d: mixing.query(table(spark, d, "documents")),
    "op2_token_counts": lambda spark, d: token_counts.query(table(spark, d, "documents")),
    "op3_license_scan": lambda spark, d: license_scan.query(table(spark, d, "documents")),
    "op4_lm_scores": lambda spark, d: lm_scoring.query(table(spark, d, "documents")),
    "op5_html_extract": lambda spark, d: html_extract.query(table(spark, d, "pages")),
    "op6_simhash": lambda spark, d: simhash.query(table(spark, d, "documents")),
    "op7_substring_dedup": lambda spark, d: substring_dedup.query(table(spark, d, "documents")),
    "op8_language_id": lambda spark, d: language_id.query(table(spark, d, "documents")),
    "op9_decontaminate": lambda spark, d: decontaminate.query(table(spark, d, "documents"), table(spark, d, "benchmark")),
    "op10_ann": lambda spark, d: ann.query(table(spark, d, "embeddings")),
    "pipeline": corpus_pipeline.run,
}

ORACLES = {
    "op1_mixing": mixing.ORACLE,
}
