"""Registry: query key -> Spark callable, and key -> DuckDB oracle SQL.

Each registration pairs the Spark job (``fn(mart) -> DataFrame``) with an
ANSI SQL statement over the same domain tables; the domain tables are
prepended to the SQL as CTEs built from the driver's parquet views, so the
oracle reads exactly what the Spark job reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tipflow.session import tune
from tipflow.sources.mart import duckdb_prelude, mart

# Fixed run parameters for the registered queries.  The period spans all
# credit, batch and redemption dates of the data, so every query reads its
# whole tables; ``AS_OF`` replaces CURRENT_DATE.
START = "1995-01-01"
END = "2001-12-31"
AS_OF = "2000-01-01"
AS_OF_TS = "2000-01-01 00:00:00"

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLE: dict[str, str] = {}


def register(key: str, needs=(), sql: str | None = None):
    """Register ``fn(mart) -> DataFrame`` under ``key`` with its oracle SQL."""

    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            tune(spark)  # UTC session time, AQE, measured-size broadcast limit
            return fn(mart(spark, sf_dir))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        _QUERIES[key] = run
        if sql is not None:
            _ORACLE[key] = (duckdb_prelude(needs) if needs else "") + sql
        return fn

    return deco


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLE)


def _load():
    # importing the modules runs their @register decorators
    from tipflow.plans import q_dashboard, q_reports, q_topups, q_people, q_changes, q_access, q_text  # noqa: F401
