"""Reported questions: commerce concentration, corridors, retention; rents and supply."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import count_where, money_avg, or_zero, quantized, rate
from ..operators.quantiles import percentiles
from ..operators.ranking import top_k_share


def commerce_headline(financials: DataFrame) -> DataFrame:
    gross, freight = F.sum("gross_order_value"), F.sum("freight_revenue")
    return financials.agg(
        F.count("*").alias("orders"), F.round(gross, 2).alias("gross_revenue"),
        money_avg(F.col("item_revenue")).alias("item_aov"), rate(freight, gross).alias("shipping_share"))


def category_concentration(category_weekly: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Revenue share of the k largest categories."""
    shares = top_k_share(category_weekly, "product_category_name", "gross_revenue", ks)
    return shares.select("k", "top_total", "grand_total", rate(F.col("top_total"), F.col("grand_total")).alias("share"))


def state_order_share(items_enriched: DataFrame, orders: DataFrame, customers: DataFrame) -> DataFrame:
    """Share of orders per customer state and per seller state."""
    by_customer = orders.join(customers, "customer_id").groupBy(F.col("customer_state").alias("state")).agg(
        F.countDistinct("order_id").alias("orders")).withColumn("side", F.lit("customer"))
    by_seller = items_enriched.groupBy(F.col("seller_state").alias("state")).agg(
        F.countDistinct("order_id").alias("orders")).withColumn("side", F.lit("seller"))
    both = by_customer.unionByName(by_seller)
    whole = F.sum("orders").over(Window.partitionBy("side"))
    return both.select("side", "state", "orders", rate(F.col("orders"), whole).alias("share"))


def order_corridors(items_enriched: DataFrame, experience: DataFrame) -> DataFrame:
    """Distinct (order, seller state) with the order's customer state and delivery outcome."""
    pairs = items_enriched.select("order_id", "seller_state", "customer_state").distinct()
    return pairs.join(experience.select("order_id", "delivery_days", "late_delivery"), "order_id")


def _delivery(df: DataFrame, by: list) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count("*").alias("orders"),
        rate(F.sum("delivery_days"), F.count("delivery_days"), 2).alias("avg_delivery_days"),
        rate(count_where(F.col("late_delivery")), F.count("late_delivery")).alias("late_rate"))


def in_state_vs_cross_state(corridors: DataFrame) -> DataFrame:
    route = F.when(F.col("seller_state") == F.col("customer_state"), "in_state").otherwise("cross_state")
    grouped = _delivery(corridors, [route.alias("route")])
    return grouped.withColumn("order_share", rate(F.col("orders"), F.sum("orders").over(Window.partitionBy())))


def corridor_late_rate(corridors: DataFrame, min_orders: int = 1) -> DataFrame:
    return _delivery(corridors, ["seller_state", "customer_state"]).filter(F.col("orders") >= min_orders)


def peak_week_multiple(kpis: DataFrame) -> DataFrame:
    peak = kpis.agg(
        F.max("gross_revenue").alias("peak_revenue"),
        # The earliest of several weeks with the same revenue.
        F.max_by("week_start", F.struct("gross_revenue", -F.unix_date("week_start"))).alias("peak_week"),
        F.round(F.avg(F.col("gross_revenue").cast("decimal(28,8)")), 2).alias("mean_revenue"))
    return peak.withColumn("multiple", rate(F.col("peak_revenue"), F.col("mean_revenue"), 4))


def weighted_month1_retention(cohorts: DataFrame) -> DataFrame:
    """Active customers one month on, over the acquired customers of all cohorts."""
    index = F.col("month_index")
    return cohorts.agg(
        F.coalesce(F.sum(F.when(index == 1, F.col("active_customers"))), F.lit(0)).alias("active_month1"),
        F.sum(F.when(index == 0, F.col("cohort_size"))).alias("acquired")).withColumn(
        "retention", rate(F.col("active_month1"), F.col("acquired")))


def ltv_lift(cohorts: DataFrame, max_index: int = 6) -> DataFrame:
    """Cumulative value at the last index up to ``max_index`` against index 0, per cohort."""
    value, index = F.col("cumulative_revenue_per_cohort_customer"), F.col("month_index")
    per_cohort = cohorts.filter(index <= max_index).groupBy("cohort_month").agg(
        F.max("cohort_size").alias("cohort_size"), F.max(F.when(index == 0, value)).alias("ltv_start"),
        F.max_by(value, index).alias("ltv_end"))
    return per_cohort.withColumn(
        "lift", F.round(rate(F.col("ltv_end"), F.col("ltv_start"), 6) - F.lit(1), 4))


def repeat_rate_overall(retention: DataFrame) -> DataFrame:
    weighted = F.sum(F.col("repeat_rate_90d") * F.col("customers"))
    return retention.agg(F.sum("customers").alias("customers"), rate(weighted, F.sum("customers")).alias("repeat_rate"))


def category_aov_vs_revenue(sales: DataFrame) -> DataFrame:
    """Orders, revenue and revenue per order of each category."""
    value = or_zero(F.col("price")) + or_zero(F.col("freight_value"))
    name = F.coalesce("product_category_name", F.lit("unknown")).alias("category")
    return sales.groupBy(name).agg(
        F.countDistinct("order_id").alias("orders"), F.round(F.sum(value), 2).alias("revenue"),
        rate(F.sum(value), F.countDistinct("order_id"), 2).alias("revenue_per_order"))


# --- listings, over the published contract -------------------------------------------

def _median(df: DataFrame, value: str, by: list[str], out: str, count: str | None = None) -> DataFrame:
    return percentiles(df, value, {out: 0.5}, by, count=count).withColumn(out, quantized(F.col(out)))


def area(df: DataFrame) -> DataFrame:
    """Listings with the area used for comparison inside a city: borough, else neighborhood."""
    return df.withColumns({
        "city": F.col("City"), "area": F.coalesce("Borough", "Neighborhood"), "rent": F.col("Rent")})


def rent_median_by_city(listings: DataFrame) -> DataFrame:
    """Median rent per city and its premium over the cheapest city."""
    medians = _median(area(listings), "rent", ["city"], "median_rent")
    lowest = F.min("median_rent").over(Window.partitionBy())
    return medians.withColumn("premium", F.round(F.col("median_rent") / lowest - F.lit(1), 4))


def rent_by_bedrooms(listings: DataFrame, base: str = "Boston", other: str = "New York City") -> DataFrame:
    """Listings and median rent per bedroom count in two cities, and their ratio."""
    rows = area(listings).withColumn("beds", F.col("Beds").cast("double"))
    both = _median(rows, "rent", ["city", "beds"], "median_rent", count="listings")
    in_base, in_other = F.col("city") == base, F.col("city") == other
    wide = both.groupBy("beds").agg(
        F.max(F.when(in_base, F.col("listings"))).alias("base_listings"),
        F.max(F.when(in_other, F.col("listings"))).alias("other_listings"),
        F.max(F.when(in_base, F.col("median_rent"))).alias("base_median"),
        F.max(F.when(in_other, F.col("median_rent"))).alias("other_median"))
    return wide.withColumn("ratio", F.round(F.col("other_median") / F.col("base_median"), 4))


def rent_per_bed(listings: DataFrame) -> DataFrame:
    rows = area(listings).filter(F.col("Beds") > 0).withColumn("unit_rent", F.col("rent") / F.col("Beds").cast("double"))
    return _median(rows, "unit_rent", ["city", "area"], "median_rent_per_bed")


def rent_per_sqft(listings: DataFrame) -> DataFrame:
    rows = area(listings).filter(F.col("SqFt") > 0).withColumn("unit_rent", F.col("rent") / F.col("SqFt").cast("double"))
    return _median(rows, "unit_rent", ["city", "area"], "median_rent_per_sqft")


def supply_concentration(listings: DataFrame) -> DataFrame:
    """Listing share per area, its place in the city and the share down to that place."""
    counts = area(listings).groupBy("city", "area").agg(F.count("*").alias("listings"))
    city = Window.partitionBy("city")
    ranked = city.orderBy(F.desc("listings"), F.asc_nulls_last("area"))
    upto = ranked.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = F.sum("listings").over(city)
    return counts.select(
        "city", "area", "listings", F.row_number().over(ranked).alias("place"),
        rate(F.col("listings"), whole).alias("share"),
        rate(F.sum("listings").over(upto), whole).alias("cumulative_share"))


def affordable_at_budget(listings: DataFrame, budget: int = 1500) -> DataFrame:
    """Listings within budget per city and area, and the city's share of all of them."""
    counts = area(listings).groupBy("city", "area").agg(
        F.count("*").alias("listings"), count_where(F.col("rent") <= budget).alias("affordable"))
    in_city = F.sum("affordable").over(Window.partitionBy("city"))
    return counts.withColumns({
        "affordable_rate": rate(F.col("affordable"), F.col("listings")),
        "city_affordable": in_city,
        "city_share_of_affordable": rate(in_city, F.sum("affordable").over(Window.partitionBy()))})


def pet_policy_premium(listings: DataFrame) -> DataFrame:
    """Median rent per pet policy against the city's no-pets listings; unknown stays NULL."""
    rows = area(listings).select("city", F.col("`Cats Allowed`").alias("cats"), F.col("`Dogs Allowed`").alias("dogs"), "rent")
    medians = _median(rows, "rent", ["city", "cats", "dogs"], "median_rent")
    none = F.max(F.when(~F.col("cats") & ~F.col("dogs"), F.col("median_rent"))).over(Window.partitionBy("city"))
    return medians.withColumn("premium", F.round(F.col("median_rent") / none - F.lit(1), 4))


def days_on_market(listings: DataFrame) -> DataFrame:
    """Median days from list date to refresh per area; undated listings are left out."""
    rows = area(listings).filter(F.col("`List Date`").isNotNull()).withColumn(
        "days", F.datediff(F.col("`Last Updated`").cast("date"), F.col("`List Date`")))
    return _median(rows, "days", ["city", "area"], "median_days", count="listings").select(
        "city", "area", "listings", "median_days")
