"""Named queries over the test tables and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` as ``name``, with its SQL if there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE[name] = sql
        return f

    return put


from outlyr.plans import catalog as _catalog  # noqa: E402,F401  (registers its queries)
from outlyr.plans import spatial_catalog as _spatial_catalog  # noqa: E402,F401
from outlyr.plans import model_catalog as _model_catalog  # noqa: E402,F401
from outlyr.plans import map_catalog as _map_catalog  # noqa: E402,F401
from outlyr.plans import graph_catalog as _graph_catalog  # noqa: E402,F401
