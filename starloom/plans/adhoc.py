"""Ad-hoc SQL over the registered warehouse views.

SQL text arriving from outside is untrusted.  It is parsed by Spark (never run
before it passes): the plan, with all its subqueries, may hold query nodes only,
may read the registered views and its own CTEs only (no files, no other
tables), and may call no function that reaches outside of SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .warehouse import VIEW_NAMES

SAMPLE_ROWS = 20
QUERY_NODES = frozenset((
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Limit LimitAll Offset Tail Distinct Union Except Intersect Join Window "
    "WithWindowDefinition Generate Expand Pivot Unpivot LateralJoin SubqueryAlias OneRowRelation LocalRelation "
    "UnresolvedWith UnresolvedHaving UnresolvedRelation UnresolvedInlineTable UnresolvedSubqueryColumnAliases "
    "UnresolvedOrdinal AggregateWithHaving GroupingSets Deduplicate").split())
SUBQUERIES = frozenset("ScalarSubquery ListQuery Exists LateralSubquery FunctionTableSubqueryArgumentExpression".split())
OUTSIDE_FUNCTIONS = frozenset("java_method reflect try_reflect input_file_name input_file_block_start input_file_block_length".split())
VIEWS = frozenset(VIEW_NAMES.values()) | {"vw_monthly_sales", "vw_sales_by_category", "vw_sales_by_state"}


def _items(seq):
    return [seq.apply(i) for i in range(seq.size())]


def check_select(spark: SparkSession, sql: str, relations=VIEWS) -> str:
    """The text, if it is one query over ``relations``; ValueError otherwise."""
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:  # Spark's parse error
        raise ValueError(f"not one SQL query: {str(e).splitlines()[0]}") from None
    names = {r.lower() for r in relations}

    def expression(e, known):
        kind = e.getClass().getSimpleName()
        if kind == "UnresolvedFunction" and _items(e.nameParts())[-1].lower() in OUTSIDE_FUNCTIONS:
            raise ValueError("a function outside of SQL is called")
        if kind in SUBQUERIES:
            query(e.plan(), known)
        for child in _items(e.children()):
            expression(child, known)

    def query(node, known):
        kind = node.getClass().getSimpleName()
        if kind not in QUERY_NODES:
            raise ValueError(f"only queries are accepted, not {kind}")
        if kind == "UnresolvedWith":
            for pair in _items(node.cteRelations()):
                query(pair._2(), known)
                known = known | {pair._1().lower()}
        if kind == "UnresolvedRelation":
            parts = _items(node.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in known:
                raise ValueError(f"unknown relation {'.'.join(parts)}")
        for e in _items(node.expressions()):
            expression(e, known)
        for child in _items(node.children()):
            query(child, known)

    query(plan, names)
    return sql


def adhoc_sql(spark: SparkSession, wh, sql: str, cap: int | None = None) -> DataFrame:
    """One query over the warehouse views, whole by default.  With a ``cap``,
    at most that many rows and a column ``truncated`` that tells whether there
    were more."""
    text = check_select(spark, sql)
    wh.register_views()
    rows = spark.sql(text)
    if cap is None:
        return rows
    more = F.broadcast(rows.limit(cap + 1).agg((F.count(F.lit(1)) > cap).alias("truncated")))  # one row
    return rows.limit(cap).join(more, F.lit(True), "left")


def result_sample(df: DataFrame, n: int = SAMPLE_ROWS, keep: list[str] | None = None) -> DataFrame:
    """The first ``n`` rows, each also as one JSON text (``row_json``)."""
    head = df.limit(n)
    return head.select(*(keep or []), F.to_json(F.struct(*df.columns)).alias("row_json"))


def schema_catalog(spark: SparkSession, wh) -> DataFrame:
    """Tables and views ad-hoc SQL may use, with their columns in order:
    (object_name, object_type, position, column_name, data_type).  Read from
    Spark's catalog after registering the warehouse views; one row per
    column, so it is bounded by the schema, not by the data."""
    names = wh.register_views()
    rows = []
    for name in names:
        kind = "view" if name.startswith("vw_") else "table"
        for i, col in enumerate(spark.catalog.listColumns(name)):
            rows.append((name, kind, i + 1, col.name, col.dataType))
    return spark.createDataFrame(
        rows, "object_name string, object_type string, position int, column_name string, data_type string")
