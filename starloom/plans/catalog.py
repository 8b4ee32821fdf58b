"""Registry of named queries: (spark, sf_dir) -> DataFrame, with an
optional DuckDB oracle SQL.  ``__spark_entry__`` exposes it to the driver."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
# Query name -> decimal output columns (exact inside, double at the edge).
MONEY_OUTPUTS: dict[str, list[str]] = {
    "payments_per_order": ["payment_value"],
    "fact_orders": ["price", "freight_value", "payment_value"],
    "fact_orders_streamed": ["price", "freight_value", "payment_value"],
    "monthly_sales": ["total_revenue", "total_freight"],
    "sales_by_category": ["total_revenue"],
    "sales_by_state": ["total_revenue"],
    "daily_sales": ["revenue"],
    "kpi_overview": ["total_revenue"],
    "top_categories": ["total_revenue"],
    "adhoc_sql_top_categories": ["total_revenue"],
    "review_features": ["price", "freight_value", "payment_value"],
    "review_features_complete": ["price", "freight_value", "payment_value"],
    "daily_sales_trimmed": ["revenue"],
    "daily_sales_summary": ["total", "peak"],
}


def money_as_double(df: DataFrame) -> DataFrame:
    """Decimal columns -> double in the final projection.  Sums and
    products stay exact decimals up to here; one correctly rounded cast at
    the edge gives the same double in any engine."""
    if not any(isinstance(f.dataType, DecimalType) for f in df.schema.fields):
        return df
    return df.select(*[F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, DecimalType)
                       else F.col(f.name) for f in df.schema.fields])


def _oracle_money_as_double(name: str, sql: str) -> str:
    cols = MONEY_OUTPUTS.get(name)
    if not cols:
        return sql
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n) AS q"


def register(name: str, oracle: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"query {name!r} registered twice")

        @functools.wraps(fn)
        def query(spark, sf_dir):
            return money_as_double(fn(spark, sf_dir))

        QUERIES[name] = query
        if oracle is not None:
            ORACLES[name] = _oracle_money_as_double(name, oracle)
        return fn
    return deco


def load_all() -> None:
    """Import every module that registers queries."""
    from ..queries import core, features, models  # noqa: F401
