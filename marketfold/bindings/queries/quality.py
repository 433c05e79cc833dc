"""Table tests and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ...operators import quality
from ...plans.checks import commerce_checks
from ...sources.sinks import append_run_log, create_as, current, full_refresh, shared_folder
from ..registry import query

_COUNTED = "table_name varchar, check_name varchar, column_name varchar, failures bigint"


@query("dq_not_null", "check_name varchar, column_name varchar, failures bigint", """
    select 'not_null' as check_name, unnest(['order_id', 'order_purchase_timestamp', 'order_delivered_customer_date'])
             as column_name, unnest([count(*) - count(order_id), count(*) - count(order_purchase_timestamp),
             count(*) - count(order_delivered_customer_date)]) as failures from raw_orders""")
def dq_not_null(t):
    return quality.not_null(
        t.stg["stg_orders"], ["order_id", "order_purchase_timestamp", "order_delivered_customer_date"])


@query("dq_unique", "failures bigint", """
    select count(*) as failures from (select order_id from raw_order_payments where order_id is not null
                                      group by order_id having count(*) > 1) as d""")
def dq_unique(t):
    return quality.unique(t.stg["stg_order_payments"], "order_id")


@query("dq_relationships", "failures bigint", """
    select count(*) as failures from raw_orders where order_id not in (select order_id from raw_order_payments)""")
def dq_relationships(t):
    return quality.relationships(t.stg["stg_orders"], "order_id", t.stg["stg_order_payments"], "order_id")


@query("dq_accepted_values", "failures bigint", """
    select count(*) as failures from raw_products where product_category_name not in ('medium', 'large', 'promo')""")
def dq_accepted_values(t):
    return quality.accepted_values(t.stg["stg_products"], "product_category_name", ["medium", "large", "promo"])


@query("dq_grain_unique", "failures bigint", """
    select count(*) as failures from (select order_id, order_item_id from raw_order_items
                                      group by 1, 2 having count(*) > 1) as d""")
def dq_grain_unique(t):
    return quality.grain_unique(t.stg["stg_order_items"], ["order_id", "order_item_id"])


def _report_sql() -> str:
    """One statement per declared test, over the checking engine's own tables."""
    source = {
        "stg_customers": "raw_customers", "stg_orders": "raw_orders", "stg_order_items": "raw_order_items",
        "stg_order_payments": "raw_order_payments", "stg_order_reviews": "raw_order_reviews",
        "stg_products": "raw_products", "stg_sellers": "raw_sellers",
        "stg_category_translation": "raw_product_category_name_translation",
        "int_order_reviews_one_row": "x_review", "int_orders_experience": "x_experience",
        "int_order_items_enriched": "x_enriched",
        "int_customer_order_sequence": "(select *, case when order_num = 1 then 1 else 0 end as is_first_order_flag "
                                       "from x_sequence) as s",
        "fct_order_financials": "x_fin", "mart_kpis_weekly": "x_kpis", "mart_category_weekly": "x_category",
        "mart_new_vs_returning_weekly": "(select distinct week_start from x_customer_week) as w",
        "mart_geo_state_flows_weekly": "x_flow_rows", "mart_experience_retention_90d": "x_retention",
        "mart_cohort_ltv_monthly": "x_cohort",
    }
    parts = []
    for c in commerce_checks():
        table = source[c.table]
        rows = [(check, col, f"count(*) filter ({test})") for check, col, test in (
            [("not_null", col, f"{col} is null") for col in c.not_null]
            + [("accepted_values", col, f"{col} not in ({', '.join(map(str, vs))})") for col, vs in c.accepted.items()])]
        for check, col, count in rows:
            parts.append(f"select '{c.table}' as table_name, '{check}' as check_name, '{col}' as column_name, "
                         f"{count} as failures from {table}")
        for col in c.unique:
            parts.append(f"select '{c.table}', 'unique', '{col}', count(*) from (select {col} from {table} "
                         f"where {col} is not null group by 1 having count(*) > 1) as d")
        for col, parent, key in c.relationships:
            parts.append(f"select '{c.table}', 'relationships', '{col}', count(*) from {table} "
                         f"where {col} not in (select {key} from {source[parent]})")
    # A mart that groups rows is NULL in a key exactly where some of its rows are.
    return " union all ".join(parts)


@query("dq_report", _COUNTED, _report_sql())
def dq_report(t):
    return quality.report([c.bind(t.built) for c in commerce_checks()])


# --- sinks ------------------------------------------------------------------------------------

def _target(t, name: str) -> str:
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("sink_full_refresh", "order_id bigint, order_status varchar", "select order_id, order_status from raw_orders")
def sink_full_refresh(t):
    rows, target = t.stg["stg_orders"].select("order_id", "order_status"), _target(t, "orders")
    full_refresh(rows, target)
    # The second refresh reads the version that it replaces.
    return full_refresh(current(t.spark, target), target)


@query("sink_create_as_select", "order_id bigint, payment_total double",
       "select order_id, sum(payment_value) as payment_total from raw_order_payments group by order_id")
def sink_create_as_select(t):
    totals = t.stg["stg_order_payments"].groupBy("order_id").agg(F.sum("payment_value").alias("payment_total"))
    path = _target(t, "payment_totals")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    create_as(totals, name, path, only_schema=True)
    created = create_as(totals, name, path)
    t.spark.sql(f"drop table {name}")
    return created


@query("sink_run_log", "run_timestamp timestamp, status varchar, details varchar", """
    select timestamp '2025-12-08 09:30:00' as run_timestamp, 'SUCCESS' as status,
           concat(count(*), ' orders') as details from raw_orders
    union all select timestamp '2025-12-08 09:31:00', 'FAILURE', concat(count(*), ' payments') from raw_order_payments""")
def sink_run_log(t):
    target = _target(t, "run_log")
    orders, payments = t.stg["stg_orders"].count(), t.stg["stg_order_payments"].count()
    for _ in range(2):  # a retry changes nothing
        append_run_log(t.spark, target, "SUCCESS", f"{orders} orders", "2025-12-08 09:30:00")
    return append_run_log(t.spark, target, "FAILURE", f"{payments} payments", "2025-12-08 09:31:00")
