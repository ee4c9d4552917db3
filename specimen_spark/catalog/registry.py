"""Registered queries and their reference SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specimen_spark.catalog.views import sql_with_views
from specimen_spark.session import RECOMMENDED_CONF

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


LIMIT = "spark.sql.codegen.hugeMethodLimit"


def in_compiled_methods(fn):
    """The query in a session whose generated methods stay small enough for the JVM to compile; see ``session``."""

    @functools.wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        spark.conf.set(LIMIT, RECOMMENDED_CONF[LIMIT])
        return fn(spark, sf_dir)

    return run


def query(name: str, oracle: str | None = None):
    """Register a query; view names used by ``oracle`` are put in front as CTEs."""

    def wrap(fn):
        QUERIES[name] = in_compiled_methods(fn)
        if oracle:
            ORACLES[name] = sql_with_views(oracle)
        return fn

    return wrap
