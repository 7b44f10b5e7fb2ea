"""All registered queries with their SQL, gathered from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bytelens.plans import catalog_queries, dex_queries, flow_queries, more_queries, pass_queries, stream_queries, wide

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**flow_queries.QUERIES, **catalog_queries.QUERIES, **wide.QUERIES, **more_queries.QUERIES, **dex_queries.QUERIES, **pass_queries.QUERIES, **stream_queries.QUERIES}
SQL: dict[str, str] = {**flow_queries.SQL, **catalog_queries.SQL, **wide.SQL, **more_queries.SQL, **dex_queries.SQL, **pass_queries.SQL, **stream_queries.SQL}
