"""Commerce layer: order experience, enrichment, sequences, financials and marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import count_where, money_avg, or_zero, rate, sum_or_zero, sum_where
from ..functions.text import has_text
from ..functions.times import days_between, month_index, month_start, week_start, within_interval
from ..operators.ranking import first_per_key, order_nulls, rollup_avg, sequence


def order_reviews_one_row(reviews: DataFrame) -> DataFrame:
    """The latest review of each order, with a flag for any comment text."""
    flagged = reviews.select(
        "order_id", "review_id", "review_score", "review_creation_date", "review_answer_timestamp",
        has_text(F.col("review_comment_title"), F.col("review_comment_message")).alias("has_comment_flag"))
    return first_per_key(flagged, ["order_id"], [
        F.desc_nulls_last("review_answer_timestamp"), F.desc_nulls_last("review_creation_date"),
        F.desc_nulls_last("review_id")])


def orders_experience(orders: DataFrame, reviews_one: DataFrame) -> DataFrame:
    """Order times, delivery delay against purchase and estimate, and the review."""
    purchased, delivered, estimated = (F.col(c) for c in (
        "order_purchase_timestamp", "order_delivered_customer_date", "order_estimated_delivery_date"))
    timed = orders.select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
        days_between(delivered, purchased).alias("delivery_days"),
        (delivered.cast("date") > estimated.cast("date")).alias("late_delivery"),
        days_between(delivered, estimated).alias("days_vs_estimated"))
    review = reviews_one.select(
        "order_id", "review_score", "review_creation_date", "review_answer_timestamp", "has_comment_flag")
    return timed.join(review, "order_id", "left")


def _named_products(products: DataFrame, translation: DataFrame) -> DataFrame:
    """Products with both names of their category: the dimensions meet before the facts come in."""
    return products.select("product_id", "product_category_name").join(
        translation.select("product_category_name", "product_category_name_english"), "product_category_name", "left")


def order_items_enriched(items: DataFrame, orders: DataFrame, customers: DataFrame, sellers: DataFrame,
                         products: DataFrame, translation: DataFrame) -> DataFrame:
    """Items with customer, seller and category attributes; orphans drop out.

    Each side takes its own dimensions before the two meet on order_id, so the result
    stays partitioned by order_id for whatever aggregates per order next.
    """
    described = (
        items.select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
        .join(_named_products(products, translation), "product_id")
        .join(sellers.select("seller_id", "seller_state"), "seller_id"))
    placed = (
        orders.select("order_id", "customer_id", "order_purchase_timestamp", "order_status")
        .join(customers.select("customer_id", "customer_state"), "customer_id"))
    return described.join(placed, "order_id").select(
        "order_id", "order_item_id", "customer_id", "customer_state", "seller_id", "seller_state", "product_id",
        "product_category_name", "product_category_name_english", "price", "freight_value",
        F.round(or_zero(F.col("price")) + or_zero(F.col("freight_value")), 2).alias("item_gmv"),
        "order_purchase_timestamp", "order_status")


def identified_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Purchased orders with their stable customer identity, any status."""
    known = customers.filter(F.col("customer_unique_id").isNotNull()).select("customer_id", "customer_unique_id")
    placed = orders.filter(F.col("order_purchase_timestamp").isNotNull())
    return placed.select("customer_id", "order_id", "order_purchase_timestamp").join(known, "customer_id")


def customer_order_sequence(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders numbered per customer by (time, order_id), with first and previous time."""
    numbered = sequence(
        identified_orders(orders, customers), "customer_unique_id", "order_purchase_timestamp", ["order_id"],
        number="order_num", first="first_order_timestamp", previous="prev_order_timestamp")
    return numbered.select(
        "customer_id", "customer_unique_id", "order_id", "order_purchase_timestamp", "order_num",
        "first_order_timestamp", "prev_order_timestamp",
        days_between(F.col("order_purchase_timestamp"), F.col("prev_order_timestamp")).alias(
            "days_since_previous_order"),
        F.when(F.col("order_num") == 1, 1).otherwise(0).alias("is_first_order_flag"))


def customer_first_orders(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Each customer's first order and the time of the next one.

    Only two orders per customer survive the group limit, on the map side already.
    """
    place = F.row_number().over(
        Window.partitionBy("customer_unique_id").orderBy("order_purchase_timestamp", "order_id"))
    two = identified_orders(orders, customers).withColumn("_place", place).filter(F.col("_place") <= 2)
    first, second = F.col("_place") == 1, F.col("_place") == 2
    return two.groupBy("customer_unique_id").agg(
        F.max(F.when(first, F.col("order_id"))).alias("order_id"),
        F.max(F.when(first, F.col("order_purchase_timestamp"))).alias("first_order_timestamp"),
        F.max(F.when(second, F.col("order_purchase_timestamp"))).alias("next_order_timestamp"))


def _item_sums(items: DataFrame, *extra: Column) -> DataFrame:
    return items.groupBy("order_id").agg(
        F.count("*").alias("item_rows"), F.sum(or_zero(F.col("price"))).alias("item_sum"),
        F.sum(or_zero(F.col("freight_value"))).alias("freight_sum"), *extra)


def order_financials(orders: DataFrame, items: DataFrame, payments: DataFrame) -> DataFrame:
    """One row per order: item and payment rollups, aggregated before they are joined.

    Each distinct count has an aggregate of its own: two in one would triple the item
    rows before the exchange. All rollups end up partitioned by order_id and meet there.
    """
    sold = _item_sums(items, F.countDistinct("product_id").alias("distinct_products")).join(
        items.groupBy("order_id").agg(F.countDistinct("seller_id").alias("distinct_sellers")), "order_id")
    return _with_payments(orders, sold, payments, ["distinct_products", "distinct_sellers"])


def order_values(orders: DataFrame, items: DataFrame) -> DataFrame:
    """The part of the financials that weekly and cohort metrics need.

    Leaves out distinct counts and payments, which cost more than all the rest.
    """
    return _with_payments(orders, _item_sums(items), None, [])


def _with_payments(orders: DataFrame, sold: DataFrame, payments: DataFrame | None, kept: list[str]) -> DataFrame:
    joined = orders.join(sold, "order_id", "left")
    paid = []
    if payments is not None:
        rollup = payments.groupBy("order_id").agg(
            F.count("*").alias("payment_rows"), F.sum(or_zero(F.col("payment_value"))).alias("payment_sum"))
        joined = joined.join(rollup, "order_id", "left")
        paid = ["payment_rows", F.round("payment_sum", 2).alias("payment_total")]
    item, freight = or_zero(F.col("item_sum")), or_zero(F.col("freight_sum"))
    return joined.select(
        "order_id", "customer_id", "order_status", "order_purchase_timestamp", "order_approved_at",
        "order_delivered_carrier_date", "order_delivered_customer_date", "order_estimated_delivery_date",
        F.coalesce("item_rows", F.lit(0)).alias("item_rows"), *kept,
        F.round(item, 2).alias("item_revenue"), F.round(freight, 2).alias("freight_revenue"), *paid,
        F.round(item + freight, 2).alias("gross_order_value"))


def kpis_weekly(financials: DataFrame, rows: int = 4) -> DataFrame:
    """Weekly volume, revenue, order economics and status mix, with rolling averages."""
    gross, item, freight = (F.col(c) for c in ("gross_order_value", "item_revenue", "freight_revenue"))
    weekly = (
        financials.filter(F.col("order_purchase_timestamp").isNotNull())
        .groupBy(week_start(F.col("order_purchase_timestamp")).alias("week_start")).agg(
            F.count("*").alias("orders"),
            F.round(F.sum(gross), 2).alias("gross_revenue"),
            F.round(F.sum(item), 2).alias("item_revenue"),
            F.round(F.sum(freight), 2).alias("freight_revenue"),
            money_avg(item).alias("aov"),
            money_avg(gross).alias("order_value_incl_shipping"),
            money_avg(freight).alias("shipping_per_order"),
            rate(F.sum(freight), F.sum(gross)).alias("shipping_share"),
            money_avg(F.col("item_rows")).alias("items_per_order"),
            rate(count_where(F.col("order_status") == "delivered"), F.count("*")).alias("delivered_rate"),
            rate(count_where(F.col("order_status") == "canceled"), F.count("*")).alias("canceled_rate")))
    rolled = rollup_avg(weekly, "week_start", {
        "orders_4wk_avg": "orders", "revenue_4wk_avg": "gross_revenue", "aov_4wk_avg": "aov"}, rows)
    return rolled.orderBy("week_start")


def category_sales(orders: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame,
                   status: str | None = "delivered") -> DataFrame:
    """Purchased item rows with their week and category, of one status or of all."""
    placed = orders.filter(F.col("order_purchase_timestamp").isNotNull())
    if status is not None:
        placed = placed.filter(F.col("order_status") == status)
    described = (
        items.select("order_id", "product_id", "price", "freight_value")
        .join(_named_products(products, translation), "product_id"))
    week = week_start(F.col("order_purchase_timestamp")).alias("week_start")
    return described.join(placed.select("order_id", week), "order_id")


def category_weekly(orders: DataFrame, items: DataFrame, products: DataFrame, translation: DataFrame,
                    status: str = "delivered") -> DataFrame:
    """Orders, items and revenue per week and category; grouping precedes 'unknown'."""
    keys = ["week_start", "product_category_name", "product_category_name_english"]
    weekly = category_sales(orders, items, products, translation, status).groupBy(*keys).agg(
        F.countDistinct("order_id").alias("orders"), F.count("*").alias("items"),
        sum_or_zero(F.col("price")).alias("item_revenue"), sum_or_zero(F.col("freight_value")).alias("freight_revenue"))
    named = weekly.select(
        "week_start",
        F.coalesce("product_category_name", F.lit("unknown")).alias("product_category_name"),
        F.coalesce("product_category_name_english", F.lit("unknown")).alias("product_category_name_english"),
        "orders", "items",
        F.round(F.col("item_revenue") + F.col("freight_revenue"), 2).alias("gross_revenue"),
        "item_revenue", "freight_revenue")
    return order_nulls(named, ("week_start", "asc"), ("gross_revenue", "desc"))


def state_flows_weekly(items_enriched: DataFrame, experience: DataFrame) -> DataFrame:
    """Weekly seller-to-customer state flows; averages and rates weigh item rows.

    Item rows are first folded per (flow, order): that turns the three distinct order
    counts into plain counts and shrinks what is shuffled by flow.
    """
    flow = ["week_start", "seller_state", "customer_state"]
    seen = experience.select("order_id", "delivery_days", "late_delivery", "review_score")
    rows = (
        items_enriched.filter(F.col("order_purchase_timestamp").isNotNull())
        .select("order_id", week_start(F.col("order_purchase_timestamp")).alias("week_start"), "seller_state",
                "customer_state", "item_gmv")
        .join(seen, "order_id", "left"))
    per_order = rows.groupBy(*flow, "order_id").agg(
        F.sum("item_gmv").alias("gmv"),
        F.sum("delivery_days").alias("days"), F.count("delivery_days").alias("timed"),
        count_where(F.col("late_delivery")).alias("late"), F.count("late_delivery").alias("judged"),
        F.sum("review_score").alias("score"), F.count("review_score").alias("scored"))
    orders = F.count("*")
    flows = per_order.groupBy(*flow).agg(
        orders.alias("orders"),
        F.round(F.sum("gmv"), 2).alias("gross_revenue"),
        rate(F.sum("gmv"), orders, 2).alias("aov_proxy"),
        count_where(F.col("timed") > 0).alias("delivered_orders"),
        count_where(F.col("scored") > 0).alias("reviewed_orders"),
        rate(F.sum("days"), F.sum("timed"), 2).alias("avg_delivery_days"),
        rate(F.sum("late"), F.sum("judged"), 4).alias("late_delivery_rate"),
        rate(F.sum("score"), F.sum("scored"), 2).alias("avg_review_score"))
    return order_nulls(flows, *[(c, "asc") for c in flow])


def customer_weeks(placed: DataFrame, financials: DataFrame) -> DataFrame:
    """One row per customer and active week: revenue and whether it is the first week.

    ``placed`` holds order_id, customer_unique_id and order_purchase_timestamp: the
    identified orders, or the order sequence. Orders are folded per week before the
    first week is sought, so the window sees a customer's weeks, not their orders.
    Orders without financials count for the first week only.
    """
    value = financials.select("order_id", F.lit(1).alias("_valued"), "gross_order_value")
    weeks = (
        placed.select("order_id", "customer_unique_id",
                      week_start(F.col("order_purchase_timestamp")).alias("week_start"))
        .join(value, "order_id", "left")
        .groupBy("customer_unique_id", "week_start").agg(
            F.sum(or_zero(F.col("gross_order_value"))).alias("revenue"), F.count("_valued").alias("_orders")))
    first = F.min("week_start").over(Window.partitionBy("customer_unique_id"))
    return weeks.withColumn("is_new", F.col("week_start") == first).filter(F.col("_orders") > 0).drop("_orders")


def new_vs_returning_weekly(placed: DataFrame, financials: DataFrame) -> DataFrame:
    """Customers and revenue per week, new (first week) against returning."""
    new = F.col("is_new")
    return customer_weeks(placed, financials).groupBy("week_start").agg(
        count_where(new).alias("new_customers"), count_where(~new).alias("returning_customers"),
        rate(count_where(new), F.count("*")).alias("new_customer_share"),
        sum_where(F.col("revenue"), new).alias("new_customer_revenue"),
        sum_where(F.col("revenue"), ~new).alias("returning_customer_revenue"))


def review_bucket(score):
    return (
        F.when(score.isNull(), "no_review").when(score.isin(1, 2), "low_1_2").when(score == 3, "mid_3")
        .otherwise("high_4_5"))


def experience_retention(first_orders: DataFrame, experience: DataFrame, days: int = 90) -> DataFrame:
    """90-day repeat rate by lateness and review of a delivered first order."""
    seen = experience.filter(F.col("order_delivered_customer_date").isNotNull()).select(
        "order_id", "late_delivery", review_bucket(F.col("review_score")).alias("review_bucket"))
    again = F.coalesce(within_interval(F.col("next_order_timestamp"), F.col("first_order_timestamp"), days), F.lit(False))
    groups = first_orders.withColumn("_again", again).join(seen, "order_id").groupBy(
        "late_delivery", "review_bucket").agg(
        F.count("*").alias("customers"), rate(count_where(F.col("_again")), F.count("*")).alias("repeat_rate_90d"))
    bucket = F.col("review_bucket")
    place = F.when(bucket == "no_review", 0).when(bucket == "low_1_2", 1).when(bucket == "mid_3", 2).otherwise(3)
    return groups.orderBy(F.asc_nulls_last("late_delivery"), place)


def cohort_ltv_monthly(orders: DataFrame, customers: DataFrame, financials: DataFrame,
                       status: str = "delivered") -> DataFrame:
    """Retention and lifetime value per acquisition month and months since.

    Orders are folded per (customer, month) first, so finding a customer's first month
    looks at one row per active month instead of joining the orders to themselves.
    """
    bought = (
        orders.filter(F.col("order_purchase_timestamp").isNotNull() & (F.col("order_status") == status))
        .select("order_id", "customer_id", month_start(F.col("order_purchase_timestamp")).alias("order_month"))
        .join(customers.filter(F.col("customer_unique_id").isNotNull()).select("customer_id", "customer_unique_id"),
              "customer_id")
        .join(financials.select("order_id", "gross_order_value"), "order_id", "left"))
    active = bought.groupBy("customer_unique_id", "order_month").agg(
        F.countDistinct("order_id").alias("orders"), F.sum(or_zero(F.col("gross_order_value"))).alias("revenue"))
    cohorts = active.withColumn("cohort_month", F.min("order_month").over(Window.partitionBy("customer_unique_id")))
    monthly = (
        cohorts.withColumn("month_index", month_index(F.col("order_month"), F.col("cohort_month")))
        .groupBy("cohort_month", "month_index").agg(
            F.count("*").alias("active_customers"), F.sum("orders").alias("orders"),
            F.round(F.sum("revenue"), 2).alias("gross_revenue")))
    acquired = F.max(F.when(F.col("month_index") == 0, F.col("active_customers"))).over(
        Window.partitionBy("cohort_month"))
    # A cohort has a row per month at most.
    upto = Window.partitionBy("cohort_month").orderBy("month_index").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sized = monthly.withColumns({"cohort_size": acquired, "_cumulative": F.sum("gross_revenue").over(upto)})
    return sized.select(
        "cohort_month", "month_index", "cohort_size", "active_customers", "orders", "gross_revenue",
        rate(F.col("active_customers"), F.col("cohort_size"), 4).alias("retention_rate"),
        rate(F.col("gross_revenue"), F.col("cohort_size"), 2).alias("revenue_per_cohort_customer"),
        rate(F.col("_cumulative"), F.col("cohort_size"), 2).alias("cumulative_revenue_per_cohort_customer"),
    ).orderBy("cohort_month", "month_index")


def build(stg: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All intermediate tables and marts from the staging tables, lazily."""
    orders, items, customers = stg["stg_orders"], stg["stg_order_items"], stg["stg_customers"]
    products, translation = stg["stg_products"], stg["stg_category_translation"]
    reviews_one = order_reviews_one_row(stg["stg_order_reviews"])
    experience = orders_experience(orders, reviews_one)
    enriched = order_items_enriched(items, orders, customers, stg["stg_sellers"], products, translation)
    numbered = customer_order_sequence(orders, customers)
    values = order_values(orders, items)
    return {
        "int_order_reviews_one_row": reviews_one,
        "int_orders_experience": experience,
        "int_order_items_enriched": enriched,
        "int_customer_order_sequence": numbered,
        "fct_order_financials": order_financials(orders, items, stg["stg_order_payments"]),
        "mart_kpis_weekly": kpis_weekly(values),
        "mart_category_weekly": category_weekly(orders, items, products, translation),
        "mart_geo_state_flows_weekly": state_flows_weekly(enriched, experience),
        "mart_new_vs_returning_weekly": new_vs_returning_weekly(identified_orders(orders, customers), values),
        "mart_experience_retention_90d": experience_retention(customer_first_orders(orders, customers), experience),
        "mart_cohort_ltv_monthly": cohort_ltv_monthly(orders, customers, values),
    }
