"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..operators import aggregates, axis_queries, delivery, lists, matching_queries, ordering_views, plan, predicates_joins, readmodels, reports, scalars, search, text_queries
from ..sources import io_queries, queries as source_queries
from ..streaming import queries as streaming_queries
from . import catalog

Query = Callable[[SparkSession, str], DataFrame]

#: Modules whose queries are one SQL text for both engines, but for those that have a text of Spark's own in SPARK.
SQL_MODULES = (readmodels, predicates_joins, aggregates, ordering_views)
#: Modules with QUERIES (name -> function) and ORACLES (name -> SQL).
FRAME_MODULES = (scalars, reports, lists, text_queries, axis_queries, delivery, matching_queries, search, plan, streaming_queries, source_queries, io_queries)


def _run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return catalog.run(spark, sf_dir, sql)


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for m in SQL_MODULES:
        out |= {name: partial(_run, sql=sql) for name, sql in (m.QUERIES | getattr(m, "SPARK", {})).items()}
    for m in FRAME_MODULES:
        out |= m.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in SQL_MODULES:
        out |= {name: catalog.oracle_text(sql) for name, sql in m.QUERIES.items()}
    for m in FRAME_MODULES:
        out |= m.ORACLES
    return out


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each category's product families with their best unit price and number of suppliers."""
    return catalog.run(spark, sf_dir, readmodels.QUERIES["q12_category_listing"])
