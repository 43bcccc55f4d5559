"""Queries of the training-data operators, one ``opN_<name>`` each, and the pipeline."""

from __future__ import annotations

from roadpulse.llm import queries as q
from roadpulse.llm import sql


def queries() -> dict:
    import corpus_pipeline

    return {**q.QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    import corpus_pipeline

    found = dict(sql.ORACLES)
    if corpus_pipeline.ORACLE_SQL:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
