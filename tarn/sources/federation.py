"""External tables read in place. Each way returns an ordinary, lazy DataFrame.

A remote is anything with ``relation(name)`` and ``query(sql)``: a JDBC database, a
catalog registered in the session, or a folder of open-format tables. ``federate``
offers the three addressing modes over them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from tarn.sources.files import read_open_table
from tarn.sources.jdbc import increment_query, jdbc_options, read_increment


@dataclass
class JdbcRemote:
    """A database; ``query`` runs there, ``relation`` gets filters and columns pushed."""

    spark: SparkSession
    url: str
    options: dict[str, str] = field(default_factory=dict)

    def relation(self, name: str) -> DataFrame:
        opts = jdbc_options(self.url, table=name, **self.options)
        return self.spark.read.format("jdbc").options(**opts).load()

    def query(self, text: str) -> DataFrame:
        opts = jdbc_options(self.url, query=text, **self.options)
        return self.spark.read.format("jdbc").options(**opts).load()

    def qualified(self, schema: str, table: str) -> str:
        return f"{schema}.{table}"

    def increment(self, name: str, cursor: str, watermark: object) -> DataFrame:
        return self.query(increment_query(name, cursor, watermark))


@dataclass
class CatalogRemote:
    """A catalog registered as ``spark.sql.catalog.<name>`` (JDBC, Iceberg, ...).

    A JDBC catalog also pushes aggregates and group-by to the source.
    """

    spark: SparkSession
    catalog: str

    @staticmethod
    def settings(name: str, url: str, **options: str) -> dict[str, str]:
        """Session settings that register a JDBC database as a catalog."""
        prefix = f"spark.sql.catalog.{name}"
        return {
            prefix: "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog",
            f"{prefix}.url": url,
            f"{prefix}.pushDownAggregate": "true",
            **{f"{prefix}.{k}": v for k, v in options.items()},
        }

    def relation(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.catalog}.{name}")

    def qualified(self, schema: str, table: str) -> str:
        return f"{schema}.{table}"

    def query(self, text: str) -> DataFrame:
        return self.spark.sql(text)


@dataclass
class FolderRemote:
    """A customer's lake: one folder or file per table, in Parquet, Delta or Iceberg."""

    spark: SparkSession
    root: str
    table_format: str = "parquet"
    suffix: str = ""

    def relation(self, name: str) -> DataFrame:
        path = f"{self.root.rstrip('/')}/{name}{self.suffix}"
        if self.table_format == "parquet":
            return self.spark.read.parquet(path)
        return read_open_table(self.spark, path, self.table_format)

    def qualified(self, schema: str, table: str) -> str:
        return f"{schema}/{table}"

    def query(self, text: str, **tables: str) -> DataFrame:
        """SQL over the remote's tables, named in braces: ``SELECT * FROM {orders}``."""
        return self.spark.sql(text, **{k: self.relation(v) for k, v in tables.items()})


Remote = JdbcRemote | CatalogRemote | FolderRemote


def federate(
    remote: Remote,
    query: str | None = None,
    relation: str | None = None,
    schema: str | None = None,
    table: str | None = None,
    watermark: object | None = None,
    cursor: str = "updated_at",
    **tables: str,
) -> DataFrame:
    """Read in place by query text, by ``relation``, or by declared ``schema`` and ``table``.

    With a ``watermark`` only rows with ``cursor > watermark`` leave the source.
    """
    if query is not None:
        df = remote.query(query, **tables) if tables else remote.query(query)
    elif relation is not None:
        if watermark is not None and isinstance(remote, JdbcRemote):
            return remote.increment(relation, cursor, watermark)
        df = remote.relation(relation)
    elif table is not None:
        df = remote.relation(remote.qualified(schema, table) if schema else table)
    else:
        raise ValueError("give a query, a relation, or a schema and table")
    return read_increment(df, cursor, watermark)
