"""The table tests declared for the commerce tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators.quality import TableChecks


@dataclass(frozen=True)
class Declared:
    """Tests of one table by name; ``bind`` attaches the tables themselves."""

    table: str
    not_null: Sequence[str] = ()
    unique: Sequence[str] = ()
    accepted: dict[str, Sequence] = field(default_factory=dict)
    relationships: Sequence[tuple[str, str, str]] = ()

    def bind(self, frames: Callable[[str], DataFrame]) -> TableChecks:
        parents = [(column, frames(parent), key) for column, parent, key in self.relationships]
        return TableChecks(self.table, frames(self.table), self.not_null, self.unique, self.accepted, parents)


def _to(parent: str, key: str) -> tuple[str, str, str]:
    return (key, parent, key)


def commerce_checks() -> list[Declared]:
    orders, customers = _to("stg_orders", "order_id"), _to("stg_customers", "customer_id")
    products, sellers = _to("stg_products", "product_id"), _to("stg_sellers", "seller_id")
    return [
        Declared("stg_category_translation", ["product_category_name", "product_category_name_english"],
                 ["product_category_name"]),
        Declared("stg_customers", ["customer_id", "customer_unique_id", "customer_state"], ["customer_id"]),
        Declared("stg_orders", ["order_id", "customer_id", "order_status"], ["order_id"], relationships=[customers]),
        Declared("stg_order_items", ["order_id", "order_item_id", "product_id", "seller_id"],
                 relationships=[orders, products, sellers]),
        Declared("stg_order_payments", ["order_id"], relationships=[orders]),
        Declared("stg_order_reviews", ["order_id", "review_id"], relationships=[orders]),
        Declared("stg_products", ["product_id"], ["product_id"]),
        Declared("stg_sellers", ["seller_id", "seller_state"], ["seller_id"]),
        Declared("int_order_reviews_one_row", ["order_id", "review_id"], ["order_id"], relationships=[orders]),
        Declared("int_orders_experience", ["order_id", "customer_id"], ["order_id"],
                 relationships=[orders, customers]),
        Declared("int_order_items_enriched", ["order_id", "order_item_id", "customer_id", "seller_id", "product_id"],
                 relationships=[orders, customers, sellers, products]),
        Declared("int_customer_order_sequence",
                 ["customer_unique_id", "order_id", "order_num", "is_first_order_flag"],
                 accepted={"is_first_order_flag": [0, 1]}, relationships=[orders]),
        Declared("fct_order_financials", ["order_id", "customer_id"], ["order_id"], relationships=[customers]),
        Declared("mart_kpis_weekly", ["week_start", "orders"], ["week_start"]),
        Declared("mart_category_weekly", ["week_start"]),
        Declared("mart_new_vs_returning_weekly", ["week_start"], ["week_start"]),
        Declared("mart_geo_state_flows_weekly", ["week_start", "seller_state", "customer_state"]),
        Declared("mart_experience_retention_90d", ["late_delivery", "customers", "repeat_rate_90d"]),
        Declared("mart_cohort_ltv_monthly",
                 ["cohort_month", "month_index", "cohort_size", "active_customers", "orders", "gross_revenue",
                  "retention_rate", "revenue_per_cohort_customer", "cumulative_revenue_per_cohort_customer"]),
    ]


# Documented grains; each can be passed to ``grain_unique``.
GRAINS = {
    "stg_customers": ["customer_id"],
    "stg_orders": ["order_id"],
    "stg_order_items": ["order_id", "order_item_id"],
    "stg_order_payments": ["order_id", "payment_sequential"],
    "stg_order_reviews": ["review_id", "order_id"],
    "stg_products": ["product_id"],
    "stg_sellers": ["seller_id"],
    "stg_category_translation": ["product_category_name"],
    "int_order_reviews_one_row": ["order_id"],
    "int_orders_experience": ["order_id"],
    "int_order_items_enriched": ["order_id", "order_item_id"],
    "int_customer_order_sequence": ["order_id"],
    "fct_order_financials": ["order_id"],
    "mart_kpis_weekly": ["week_start"],
    "mart_category_weekly": ["week_start", "product_category_name", "product_category_name_english"],
    "mart_geo_state_flows_weekly": ["week_start", "seller_state", "customer_state"],
    "mart_new_vs_returning_weekly": ["week_start"],
    "mart_experience_retention_90d": ["late_delivery", "review_bucket"],
    "mart_cohort_ltv_monthly": ["cohort_month", "month_index"],
}
