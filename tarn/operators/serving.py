"""Read-only serving: guarded SQL and table previews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.lake.sqltext import ParsedQuery, parsed_query

# Row cap of a served query, and functions that reach outside the lake.
MAX_ROWS = 500
REFUSED_FUNCTIONS = ("reflect", "java_method", "try_reflect")
REFUSED_NODES = ("org.apache.spark.sql.catalyst.plans.logical.Command", "org.apache.spark.sql.catalyst.plans.logical.ParsedStatement")


class RefusedQuery(PermissionError):
    pass


@dataclass(frozen=True)
class Served:
    """The rows of a query up to the cap; ``truncated`` asks whether there were more."""

    rows: DataFrame
    _beyond: DataFrame

    @property
    def truncated(self) -> bool:
        return not self._beyond.isEmpty()


def check_read_only(spark, text: str) -> ParsedQuery:
    """Refuse anything Spark parses as a command or a data change, files, and foreign functions.

    Functions must be built in; those that run code outside the plan are refused by name.
    """
    query = parsed_query(spark, text)
    forName = spark._jvm.java.lang.Class.forName
    refused = [forName(name) for name in REFUSED_NODES]
    for node in query.nodes:
        if any(kind.isInstance(node) for kind in refused):
            raise RefusedQuery(f"read-only SQL: {node.nodeName()} is not allowed")
    known = {r["function"].lower() for r in spark.sql("SHOW SYSTEM FUNCTIONS").collect()} if query.functions else set()
    for name in query.functions:
        if name in REFUSED_FUNCTIONS or name not in known:
            raise RefusedQuery(f"read-only SQL: the function {name} is not allowed")
    for relation in query.relations:
        if len(relation) > 1:
            raise RefusedQuery(f"read-only SQL: {'.'.join(relation)} is no table of the lake")
    return query


def run_sql(lake, text: str, max_rows: int = MAX_ROWS) -> Served:
    """SELECT over the lake's tables (``<layer>_<table>``), at most ``max_rows`` rows.

    Only the tables that the text names are opened. Without ORDER BY it is open which rows
    are served; ``truncated`` tells whether the cap cut any.
    """
    query = check_read_only(lake.spark, text)
    names = [r[0] for r in query.relations if r[0].lower() not in query.defined]
    missing = set(names) - set(lake.register_views(names))
    if missing:
        raise RefusedQuery(f"read-only SQL: {', '.join(sorted(missing))} is no table of the lake")
    rows = lake.spark.sql(text)
    return Served(rows.limit(max_rows), rows.offset(max_rows).limit(1))


def matches_search(df: DataFrame, search: str):
    """Condition: some text column contains ``search``, ignoring case."""
    escaped = search.replace("\\", "\\\\").replace("%", r"\%").replace("_", r"\_")
    hit = F.lit(False)
    for field in df.schema:
        if isinstance(field.dataType, T.StringType):
            hit = hit | F.coalesce(F.col(field.name).ilike(f"%{escaped}%"), F.lit(False))
    return hit


def preview(
    df: DataFrame,
    pk: str,
    search: str | None = None,
    sort: str | None = None,
    desc: bool = False,
    page: int = 1,
    size: int = 50,
) -> DataFrame:
    """One page of the searched and sorted table, in a total order (sort column, key)."""
    if search:
        df = df.where(matches_search(df, search))
    order = []
    if sort:
        order.append(F.col(sort).desc_nulls_last() if desc else F.col(sort).asc_nulls_last())
    order.append(F.col(pk).asc_nulls_last())
    # Spark keeps the first rows of each task only, as many as the page ends at.
    return df.orderBy(*order).offset((page - 1) * size).limit(size)
