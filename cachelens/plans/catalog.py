"""Registry of the named queries and of the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cachelens.plans import policy_queries, sketch_queries, state_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = state_queries.QUERIES | sketch_queries.QUERIES | policy_queries.QUERIES
ORACLE: dict[str, str] = state_queries.ORACLE | sketch_queries.ORACLE | policy_queries.ORACLE
