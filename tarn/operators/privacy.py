"""Personal data handling when a clean table is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def protect(df: DataFrame, rules: dict[str, str], salt: str = "") -> DataFrame:
    """``drop`` a column or ``hash`` it (salted sha-256, so equal values stay joinable)."""
    for column, rule in rules.items():
        if column not in df.columns:
            raise ValueError(f"no such column: {column}")
        if rule not in ("drop", "hash"):
            raise ValueError(f"unknown rule for {column}: {rule}")
    kept = [c for c in df.columns if rules.get(c) != "drop"]
    return df.select(
        *[
            F.sha2(F.concat(F.lit(salt), F.col(c).cast("string")), 256).alias(c)
            if rules.get(c) == "hash"
            else F.col(c)
            for c in kept
        ]
    )
