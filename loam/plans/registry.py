"""All registered queries and their DuckDB equivalents, by name."""

from __future__ import annotations

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with SQL for the same rows where SQL can say it."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


from loam.plans import accounting_queries, corpus_queries, ingest_queries, retrieval_queries, source_queries, table_queries, text_queries, turn_queries  # noqa: E402,F401
