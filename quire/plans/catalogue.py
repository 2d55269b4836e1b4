"""Queries over the driver's tables, by name, and the SQL that must give the same rows.

documents stand for chunks (doc_id is the key and the order they came in, lang the class, source the tenant), benchmark for
evaluation queries, labels for review flags, conversations for ordered lines, events for status changes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quire.plans import exam, questions, relational, retrieval

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

for _module in (retrieval, questions, exam, relational):
    QUERIES |= _module.BOOK.queries
    ORACLE_SQL |= _module.BOOK.sql
