"""The clean models: typed, normalised, deduplicated tables with their contract."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.functions import (
    age_in_days,
    email_domain,
    external_id,
    normalize_email,
    tier_of,
    to_utc,
)
from tarn.operators.merge import keep_latest, require_columns, union_relaxed
from tarn.operators.privacy import protect
from tarn.operators.windows import rank_in_group


def clean_customers(
    raw: DataFrame,
    partners: DataFrame,
    as_of: dt.date | str,
    partner_of: Column | None = None,
    passthrough: Sequence[str] = (),
) -> DataFrame:
    """The wide model: normalised fields, tier, partner terms and rank in the segment.

    ``raw`` has id, email, name, segment, balance and created_at; ``passthrough``
    columns are kept as they are. ``partner_of`` gives the partner of a customer. The
    partner table joins by its size: broadcast while small, shuffled beyond that.
    """
    require_columns(raw, ["id", "email", "name", "segment", "balance", "created_at"], "raw column")
    if partner_of is None:
        partner_of = F.pmod(F.xxhash64("id"), F.lit(1000)) + 1
    rows = raw.where("id IS NOT NULL").withColumn("_partner", partner_of)
    ranked = rank_in_group(rows, ["segment"], "balance", "balance_rank_in_segment")
    terms = partners.select("partner_id", "partner_name", "partner_tier", "commission_rate")
    commission = F.col("balance").cast("decimal(18,2)") * F.col("commission_rate").cast("decimal(10,3)")
    return ranked.join(terms, F.col("_partner") == F.col("partner_id"), "left").select(
        F.col("id").alias("external_id"),
        normalize_email("email").alias("email"),
        email_domain("email").alias("email_domain"),
        F.trim("name").alias("name"),
        *passthrough,
        "segment",
        "balance",
        to_utc("created_at").alias("created_at_utc"),
        age_in_days("created_at", as_of).alias("account_age_days"),
        tier_of("balance").alias("balance_tier"),
        "partner_name",
        "partner_tier",
        "commission_rate",
        F.round(commission, 2).cast("double").alias("commission_value"),
        "balance_rank_in_segment",
    )


def clean_orders(raw: DataFrame, cursor_type: str = "timestamp_ntz") -> DataFrame:
    """Typed orders, the latest row per id; numbers and timestamps may arrive as text.

    Values that do not cast become NULL, for the gate to catch.
    """
    columns = [
        F.expr("try_cast(id AS bigint)").alias("external_id"),
        F.expr("try_cast(amount AS double)").alias("amount"),
        F.expr(f"try_cast(updated_at AS {cursor_type})").alias("updated_at"),
    ]
    if "email" in raw.columns:
        columns.insert(1, normalize_email("email").alias("email"))
    return keep_latest(raw.select(*columns), "external_id", "updated_at")


def clean_order_lines(orders: DataFrame, products: DataFrame) -> DataFrame:
    """Own orders enriched with a federated product master; money keeps its decimal type."""
    return orders.join(products, F.col("product_sku") == F.col("sku")).select(
        "order_id",
        "customer_email",
        "product_sku",
        "product_name",
        "category",
        "qty",
        "unit_price",
        (F.col("qty") * F.col("unit_price")).alias("line_total"),
        *(["order_ts"] if "order_ts" in orders.columns else []),
    )


def clean_contracts(contracts: DataFrame, products: DataFrame) -> DataFrame:
    """Contracts with their product's name; an unknown product leaves it NULL."""
    names = products.select(F.col("product_id").alias("_product"), "product_name", "category")
    return contracts.join(names, F.col("product_id") == F.col("_product"), "left").drop("_product")


def without_match(df: DataFrame, column: str) -> DataFrame:
    """Quality count: total rows and rows whose joined column stayed empty."""
    return df.agg(
        F.count("*").alias("total_rows"), F.count_if(F.col(column).isNull()).alias("unmatched_rows")
    )


def contract_parties(
    contracts: DataFrame, users: DataFrame, first: str, second: str, user_pk: str, user_name: str
) -> DataFrame:
    """One user table joined under two roles."""
    a = users.select(F.col(user_pk).alias("_a"), F.col(user_name).alias("first_party_name"))
    b = users.select(F.col(user_pk).alias("_b"), F.col(user_name).alias("second_party_name"))
    return (
        contracts.join(a, F.col(first) == F.col("_a"), "left")
        .join(b, F.col(second) == F.col("_b"), "left")
        .drop("_a", "_b")
    )


def referenced_rows(rows: DataFrame, pk: str, users_of: DataFrame, *party_columns: str) -> DataFrame:
    """Only the rows some party column refers to."""
    parties = [users_of.select(F.col(c).alias(pk)) for c in party_columns]
    wanted = parties[0]
    for extra in parties[1:]:
        wanted = wanted.unionByName(extra)
    return rows.join(wanted.distinct(), pk, "left_semi")


def hybrid_clean(
    federated: DataFrame, enriched: DataFrame, key: str, struct_col: str = "profile"
) -> DataFrame:
    """Federated rows LEFT JOIN their enrichment, flattened."""
    fields = enriched.schema[struct_col].dataType.names
    side = enriched.select(key, *[F.col(f"{struct_col}.{f}").alias(f) for f in fields])
    return federated.join(side, key, "left")


def unify_sources(
    sources: Mapping[str, DataFrame], pk: Mapping[str, str], columns: Mapping[str, Mapping[str, str]]
) -> DataFrame:
    """One clean table out of N sources.

    ``columns[source]`` maps common names to the source's own; ``external_id`` is minted
    as ``<source>:<pk>`` so equal keys of two sources stay apart.
    """
    frames = []
    for name, df in sources.items():
        picked = [
            (normalize_email(own) if common == "email" else F.col(own)).alias(common)
            for common, own in columns[name].items()
        ]
        frames.append(
            df.select(external_id(name, [pk[name]]).alias("external_id"), F.lit(name).alias("source"), *picked)
        )
    return union_relaxed(*frames)


def synthesize_clean(
    df: DataFrame, pk: Sequence[str], cursor: str | None = None, pii: Mapping[str, str] | None = None
) -> DataFrame:
    """Generated clean table of a dynamic schema: key, cursor, personal data, rest as is."""
    require_columns(df, [*pk, *([cursor] if cursor else [])], "declared column")
    key = F.col(pk[0]) if len(pk) == 1 else F.concat_ws(":", *pk)
    taken = {*pk, cursor}
    if "external_id" in taken | set(df.columns) and pk != ["external_id"]:
        raise ValueError("external_id is already a column")
    rest = [c for c in df.columns if c not in taken]
    stamped = df.select(
        key.alias("external_id"), *rest, *([F.col(cursor).alias("updated_at")] if cursor else [])
    )
    return protect(stamped, dict(pii or {}))


def contract_violations(df: DataFrame, key: str = "external_id", cursor: str = "updated_at") -> DataFrame:
    """Clean contract in one row: NULL keys, repeated keys, NULL cursors, cursor present."""
    has_cursor = cursor in df.columns
    per_key = df.groupBy(key).agg(
        F.count("*").alias("_n"),
        (F.count_if(F.col(cursor).isNull()) if has_cursor else F.lit(0)).alias("_no_cursor"),
    )
    return per_key.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("total_rows"),
        F.coalesce(F.sum(F.when(F.col(key).isNull(), F.col("_n"))), F.lit(0)).alias("null_keys"),
        F.count_if(F.col(key).isNotNull() & (F.col("_n") > 1)).alias("repeated_keys"),
        F.coalesce(F.sum("_no_cursor"), F.lit(0)).cast("bigint").alias("null_cursors"),
        F.lit(has_cursor).alias("has_cursor"),
    )


def check_contract(df: DataFrame, key: str = "external_id", cursor: str = "updated_at") -> None:
    """Raise when the clean contract is broken."""
    found = contract_violations(df, key, cursor).first()
    broken = [n for n in ("null_keys", "repeated_keys", "null_cursors") if found[n]]
    if not found["has_cursor"]:
        broken.append("no cursor column")
    if broken:
        raise ValueError(f"clean contract broken: {', '.join(broken)}")


def status_totals(df: DataFrame, status: str, amount: str) -> DataFrame:
    """Count and rounded sum per status, most frequent first."""
    total = F.round(F.sum(F.col(amount).cast("decimal(18,2)")), 2).cast("double")
    return (
        df.groupBy(status)
        .agg(F.count("*").alias("n_rows"), total.alias("total_amount"))
        .orderBy(F.desc("n_rows"), F.asc(status))
    )


def duplicate_keys(df: DataFrame, *pk: str) -> DataFrame:
    """Keys held by more than one row."""
    return df.groupBy(*pk).agg(F.count("*").alias("n_rows")).where("n_rows > 1")
