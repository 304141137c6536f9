"""Queries of the subpackage and of the pipeline, with their SQL texts."""

from __future__ import annotations

from importlib import import_module

import corpus_pipeline
from cohortspark.llm.common import ORACLES, QUERIES

for _name in (
    "pii_crf",
    "tool_calls",
    "packing",
    "ngram_join",
    "language_id",
    "decontamination",
    "quality_cnn",
    "substring_dedup",
    "embedding_dedup",
    "license_scan",
    "collocations",
    "mixing",
    "spelling",
):
    import_module(f"cohortspark.llm.{_name}")

QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL

__all__ = ["ORACLES", "QUERIES"]
