"""All queries of the library's own operators, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from timeloom.plans import check_queries, extensions, stream_queries, table_queries, text_queries, time_queries

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

for _part in (time_queries, text_queries, table_queries, check_queries, extensions, stream_queries):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
