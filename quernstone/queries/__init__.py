"""The driver's registry: each query with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import code, more

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**code.QUERIES, **more.QUERIES}
ORACLE_SQL: dict[str, str] = {**code.ORACLE_SQL, **more.ORACLE_SQL}
ENTRY = "content_search_ranked"
