"""Staging projections: the columns each source contributes, nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.commerce import SCHEMAS

SOURCE_OF = {
    "stg_customers": "raw_customers",
    "stg_orders": "raw_orders",
    "stg_order_items": "raw_order_items",
    "stg_order_payments": "raw_order_payments",
    "stg_order_reviews": "raw_order_reviews",
    "stg_products": "raw_products",
    "stg_sellers": "raw_sellers",
    "stg_category_translation": "raw_product_category_name_translation",
}


def columns_of(name: str) -> list[str]:
    return [part.strip().split(" ")[0] for part in SCHEMAS[SOURCE_OF[name]].replace("(12,2)", "").split(",")]


def staging(raw: DataFrame, name: str) -> DataFrame:
    return raw.select(*columns_of(name))


def stage_all(raw: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All staging tables from a mapping of source tables."""
    return {name: staging(raw[source], name) for name, source in SOURCE_OF.items()}
