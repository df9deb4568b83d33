"""The published single-node workloads at their own row counts, on local Spark.

usage: python tools/published_workloads.py [scale]   (scale 1.0 = 2M users, 1M contracts)
Prints one JSON line per stage. Data is generated, so this is a timing tool, not a query.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tarn import LakeStore, build_session  # noqa: E402
from tarn.graph.ontology import parse_ontology  # noqa: E402
from tarn.graph.project import build_graph  # noqa: E402
from tarn.graph.query import edge_quality  # noqa: E402
from tarn.operators.merge import fabricate_delta  # noqa: E402
from tarn.plans import clean  # noqa: E402
from tarn.plans.models import Model, has_changes, run_model  # noqa: E402
from tarn.session import scratch_path  # noqa: E402
from tarn.sources.generate import gen_contracts, gen_customers, gen_partners, gen_products  # noqa: E402
from tarn.streaming.config import ResourceConfig  # noqa: E402
from tarn.streaming.sync import sync_resource  # noqa: E402

USERS = ResourceConfig("postgres", "users", "incremental", "updated_at", ("id",))
CONTRACTS = ResourceConfig("mongodb", "contracts", "incremental", "updated_at", ("contract_id",))
LATER = "2026-06-01 00:00:00"

ONTOLOGY = {
    "nodes": [
        {"label": "User", "source": "clean/slice_users", "id_field": "external_id", "properties": ["full_name"]},
        {"label": "Contract", "source": "clean/slice_contracts", "id_field": "external_id", "properties": ["status", "value"]},
        {"label": "Product", "source": "clean/products", "id_field": "product_id", "properties": ["product_name"]},
    ],
    "edges": [
        {"type": "FIRST_PARTY", "source": "clean/slice_contracts", "from_label": "Contract", "from_key": "external_id", "to_label": "User", "to_key": "first_party"},
        {"type": "SECOND_PARTY", "source": "clean/slice_contracts", "from_label": "Contract", "from_key": "external_id", "to_label": "User", "to_key": "second_party"},
        {"type": "ABOUT", "source": "clean/slice_contracts", "from_label": "Contract", "from_key": "external_id", "to_label": "Product", "to_key": "product_id"},
    ],
}


def timed(stage: str, rows: int, action) -> object:
    started = time.perf_counter()
    result = action()
    seconds = time.perf_counter() - started
    print(json.dumps({"stage": stage, "rows": rows, "seconds": round(seconds, 2), "rows_per_s": round(rows / seconds)}), flush=True)
    return result


def later(df, key: str, count: int, value: str):
    """The source after ``count`` rows changed and became newer."""
    stamp = F.lit(LATER).cast("timestamp_ntz")
    return fabricate_delta(df, F.col(key) < count, {value: F.col(value) + 1, "updated_at": stamp})


def users_model() -> Model:
    def build(raw):
        return raw.select(
            F.col("id").alias("external_id"), F.lower(F.trim("email")).alias("email"),
            F.trim("name").alias("full_name"), "balance", "segment", "updated_at",
        )

    return Model("users", ["raw/postgres__users"], build, materialized="incremental", unique_key=("external_id",))


def contracts_model() -> Model:
    def build(raw, products):
        return clean.clean_contracts(raw.withColumnRenamed("contract_id", "external_id"), products)

    return Model(
        "contracts", ["raw/mongodb__contracts", "clean/products"], build, materialized="incremental",
        unique_key=("external_id",),
    )


def main() -> None:
    scale = float(sys.argv[1]) if len(sys.argv) > 1 else 1.0
    spark = build_session("published", "local[8]", 8)
    spark.sparkContext.setLogLevel("ERROR")
    lake = LakeStore(spark, scratch_path(spark, "published")).bootstrap()
    n_users, n_contracts = int(2_000_000 * scale), int(1_000_000 * scale)
    users, contracts = gen_customers(spark, n_users), gen_contracts(spark, n_contracts, n_users)
    lake.write("raw", "mongodb__products", gen_products(spark))
    lake.write("clean", "products", lake.read("raw/mongodb__products"))

    timed("ingest users", n_users, lambda: sync_resource(lake, users, USERS))
    timed("ingest contracts", n_contracts, lambda: sync_resource(lake, contracts, CONTRACTS))
    timed("clean users", n_users, lambda: run_model(lake, users_model()))
    timed("clean contracts (join)", n_contracts, lambda: run_model(lake, contracts_model()))

    few_users, few_contracts = n_users // 20, n_contracts // 20
    timed("incremental users", few_users, lambda: sync_resource(lake, later(users, "id", few_users, "balance"), USERS))
    timed("incremental contracts", few_contracts, lambda: sync_resource(lake, later(contracts, "contract_id", few_contracts, "value"), CONTRACTS))
    timed("clean incremental users", few_users, lambda: run_model(lake, users_model()))
    timed("clean incremental contracts", few_contracts, lambda: run_model(lake, contracts_model()))
    timed("skip check", 1, lambda: has_changes(lake, users_model()))
    counts = (lake.count("clean/users"), lake.count("clean/contracts"))
    print(json.dumps({"users": counts[0], "contracts": counts[1],
                      "duplicates": clean.duplicate_keys(lake.read("clean/users"), "external_id").count()}))

    raw = lake.read("raw/postgres__users").where(F.col("id") < n_users // 2).withColumn("created_at", F.col("updated_at"))
    wide = clean.clean_customers(raw, gen_partners(spark), "2026-06-27")
    timed("wide clean model", n_users // 2, lambda: lake.write("clean", "wide", wide))

    part = lake.read("clean/contracts").where(F.col("external_id") < n_contracts // 10)
    lake.write("clean", "slice_contracts", part)
    lake.write("clean", "slice_users", clean.referenced_rows(
        lake.read("clean/users"), "external_id", lake.read("clean/slice_contracts"), "first_party", "second_party"))
    size = lake.count("clean/slice_users") + 4 * part.count() + 500
    graph = timed("graph build", size, lambda: build_graph(lake, parse_ontology(ONTOLOGY)))
    print(json.dumps({r.type: [r.resolved_edges, r.total_edges] for r in edge_quality(graph).collect()}))


if __name__ == "__main__":
    main()
