"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import audits, flows, history, index, records, resolution, retrieval, reviews, rules, text

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = retrieval.QUERIES | text.QUERIES | audits.QUERIES | records.QUERIES | rules.QUERIES | history.QUERIES | index.QUERIES | resolution.QUERIES | flows.QUERIES | reviews.QUERIES
SQL: dict[str, str] = retrieval.SQL | text.SQL | audits.SQL | records.SQL | rules.SQL | history.SQL | index.SQL | resolution.SQL | flows.SQL | reviews.SQL
