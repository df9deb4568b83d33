"""Quality gate: declared checks, quarantine with reasons, report, and its evaluation."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions.identity import is_valid_cpf, is_valid_email
from tarn.session import cut_lineage

REASONS = "reasons"


@dataclass(frozen=True)
class RowCheck:
    """A condition on one row; ``failed`` is true for a bad row."""

    name: str
    failed: Column


@dataclass(frozen=True)
class UniqueCheck:
    """No two rows share the (non-NULL) key."""

    name: str
    columns: tuple[str, ...]


@dataclass(frozen=True)
class ReferenceCheck:
    """A non-NULL value must exist in another table."""

    name: str
    column: str
    parent: DataFrame
    parent_column: str


Check = RowCheck | UniqueCheck | ReferenceCheck


def _filled(column: str, bad: Column) -> Column:
    """Checks other than not-null let NULL pass."""
    return F.col(column).isNotNull() & F.coalesce(bad, F.lit(True))


def not_null(column: str) -> RowCheck:
    return RowCheck(f"not_null:{column}", F.col(column).isNull())


def in_range(column: str, low: object, high: object) -> RowCheck:
    return RowCheck(f"range:{column}", _filled(column, ~F.col(column).between(low, high)))


def email_format(column: str) -> RowCheck:
    return RowCheck(f"email:{column}", _filled(column, ~is_valid_email(column)))


def cpf_format(column: str) -> RowCheck:
    return RowCheck(f"cpf:{column}", _filled(column, ~is_valid_cpf(column)))


def of_type(column: str, data_type: str) -> RowCheck:
    cast = F.expr(f"try_cast(`{column}` AS {data_type})")
    return RowCheck(f"type:{column}", _filled(column, cast.isNull()))


def one_of(column: str, values: Sequence[object]) -> RowCheck:
    return RowCheck(f"enum:{column}", _filled(column, ~F.col(column).isin(*values)))


def matches(column: str, pattern: str) -> RowCheck:
    return RowCheck(f"regex:{column}", _filled(column, ~F.col(column).rlike(pattern)))


def length_between(column: str, low: int, high: int) -> RowCheck:
    size = F.length(F.col(column))
    return RowCheck(f"length:{column}", _filled(column, ~size.between(low, high)))


def fresh_since(column: str, oldest: object) -> RowCheck:
    return RowCheck(f"freshness:{column}", _filled(column, F.col(column) < F.lit(oldest)))


def unique(*columns: str) -> UniqueCheck:
    return UniqueCheck(f"unique:{'+'.join(columns)}", columns)


def references(column: str, parent: DataFrame, parent_column: str) -> ReferenceCheck:
    return ReferenceCheck(f"reference:{column}", column, parent, parent_column)


# How a check is spelled in a table's configuration.
CONFIG_CHECKS = {
    "not_null": not_null, "range": in_range, "email": email_format, "cpf": cpf_format,
    "type": of_type, "enum": one_of, "regex": matches, "length": length_between,
    "freshness": fresh_since, "unique": unique, "reference": references,
}


def suite_from_config(config: Sequence[dict], parents: dict[str, DataFrame] | None = None) -> list[Check]:
    """``[{"check": "range", "args": ["amount", 0, 100]}, ...]`` to checks.

    A reference check names its parent table, looked up in ``parents``.
    """
    suite: list[Check] = []
    for entry in config:
        kind, args = entry["check"], list(entry["args"])
        if kind not in CONFIG_CHECKS:
            raise ValueError(f"unknown check: {kind}")
        if kind == "reference":
            args[1] = (parents or {})[args[1]]
        suite.append(CONFIG_CHECKS[kind](*args))
    return suite


def flag(df: DataFrame, suite: Sequence[Check]) -> DataFrame:
    """``df`` plus ``reasons``: the names of the failed checks (empty for a good row).

    Row checks cost no shuffle. Repeated keys and dangling references are first reduced to
    the offending values, over the key column alone and with partial aggregation, and
    written. That list is normally short: marking the rows with it leaves them in place,
    and a long one, or one value on a third of the rows, is an ordinary skew-split join.
    """
    marks: list[Column] = []
    columns = df.columns
    if sum(not isinstance(c, RowCheck) for c in suite) > 1:
        df = cut_lineage(df)  # read once more for each of these checks, so computed only once
    for i, check in enumerate(suite):
        if isinstance(check, RowCheck):
            bad = check.failed
        else:
            offending = cut_lineage(_offending(df, check))
            keys = check.columns if isinstance(check, UniqueCheck) else (check.column,)
            marked = offending.select(
                *[F.col(c).alias(f"_c{i}_{c}") for c in keys], F.lit(True).alias(f"_c{i}")
            )
            df = df.join(marked, [F.col(c) == F.col(f"_c{i}_{c}") for c in keys], "left")
            bad = F.col(f"_c{i}").isNotNull()
        marks.append(F.when(bad, F.lit(check.name)))
    return df.select(*columns, F.array_compact(F.array(*marks)).alias(REASONS))


def _offending(df: DataFrame, check: UniqueCheck | ReferenceCheck) -> DataFrame:
    """Distinct keys that are repeated, or values without a parent; never NULL ones."""
    if isinstance(check, UniqueCheck):
        filled = " AND ".join(f"`{c}` IS NOT NULL" for c in check.columns)
        counted = df.select(*check.columns).where(filled).groupBy(*check.columns).count()
        return counted.where("count > 1").drop("count")
    values = df.select(check.column).where(F.col(check.column).isNotNull()).distinct()
    known = check.parent.select(F.col(check.parent_column).alias("_known"))
    return values.join(known, F.col(check.column) == F.col("_known"), "left_anti")


def split_flagged(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that passed, quarantined rows with their reasons)."""
    passed = flagged.where(F.size(REASONS) == 0).drop(REASONS)
    return passed, flagged.where(F.size(REASONS) > 0)


def gate(df: DataFrame, suite: Sequence[Check]) -> tuple[DataFrame, DataFrame]:
    return split_flagged(flag(df, suite))


def gate_into(lake, table: str, df: DataFrame, suite: Sequence[Check], **write_options) -> dict[str, int]:
    """Staging -> raw or quarantine. The checks run once: both outputs read the staged rows."""
    staged = lake.write("state", f"{table}__staging", flag(df, suite), "overwrite")
    passed, bad = split_flagged(lake.read(("state", f"{table}__staging"), snapshot=staged.version))
    good = lake.write("raw", table, passed, **write_options)
    held = lake.write("state", f"{table}__quarantine", bad, "append")
    return {"passed": good.changed_rows, "quarantined": held.changed_rows}


def gate_report(quarantined: DataFrame) -> DataFrame:
    """Rows per failed check."""
    return (
        quarantined.select(F.explode(REASONS).alias("check_name"))
        .groupBy("check_name")
        .agg(F.count("*").alias("failed_rows"))
    )


def confusion(df: DataFrame, is_bad: Column, caught: Column) -> DataFrame:
    """Recall and precision of a gate: one row of counts and ratios."""
    counts = df.agg(
        F.count_if(is_bad & caught).alias("true_positive"),
        F.count_if(~is_bad & caught).alias("false_positive"),
        F.count_if(is_bad & ~caught).alias("false_negative"),
        F.count_if(~is_bad & ~caught).alias("true_negative"),
    )
    tp = F.col("true_positive")
    return counts.withColumns(
        {
            "recall": tp / F.nullif(tp + F.col("false_negative"), F.lit(0)),
            "precision": tp / F.nullif(tp + F.col("false_positive"), F.lit(0)),
        }
    )


def inject_dirty(
    df: DataFrame, pk: str, faults: dict[str, tuple[Column, int]], seed: int | None = 7
) -> DataFrame:
    """Spoil rows for an evaluation: ``faults[column] = (bad value, one row in n)``.

    Rows are chosen by a hash of the key (``seed=None``: by the key itself), so a rerun
    spoils the same ones. ``injected`` lists the columns spoiled in each row.
    """
    spoiled = {}
    for i, (column, (value, every)) in enumerate(faults.items()):
        base = F.col(pk).cast("bigint") if seed is None else F.xxhash64(F.col(pk), F.lit(seed + i))
        spoiled[column] = (F.pmod(base, F.lit(every)) == 0, value)
    columns = [
        F.when(spoiled[c][0], spoiled[c][1]).otherwise(F.col(c)).alias(c) if c in spoiled else F.col(c)
        for c in df.columns
    ]
    marks = [F.when(hit, F.lit(c)) for c, (hit, _) in spoiled.items()]
    return df.select(*columns, F.array_compact(F.array(*marks)).alias("injected"))
