"""Filters, joins, aggregations, windows, sorts, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.numbers import count_where, money_avg, rate, sum_or_zero, sum_where, within
from ...functions.text import empty_as_key
from ...functions.times import month_start, week_start, within_interval
from ...operators.distinct import count_sets, distinct_sets, merge_sets
from ...operators.joins import band_join, salted_join, union_by_name, unmatched, with_scalar
from ...operators.quantiles import column_percentiles, percentiles
from ...operators.ranking import first_per_key, order_nulls, rolling_avg, running_sum, sequence, top_k_share
from ...plans.commerce import customer_first_orders, customer_weeks, identified_orders
from ...plans.listings import left_over, match_listings
from ...sources.sinks import stage
from ..registry import STEPS, money, query, ratio

# --- filters --------------------------------------------------------------------------------


@query("filter_equality", "order_id bigint, order_status varchar",
       "select order_id, order_status from raw_orders where order_status = 'delivered'")
def filter_equality(t):
    return t.stg["stg_orders"].filter(F.col("order_status") == "delivered").select("order_id", "order_status")


@query("filter_not_null", "listing_id varchar, zip_code varchar, neighborhood varchar, sqft integer", """
    select listing_id, zip_code, neighborhood, sqft from bos_feed_a left join x_neighborhoods on zip = zip_code
    where listing_id is not null and zip_code is not null and neighborhood is not null and url is not null
      and sqft is not null""")
def filter_not_null(t):
    return t.feeds("boston")[0].dropna(subset=["listing_id", "zip_code", "neighborhood", "url", "sqft"]).select(
        "listing_id", "zip_code", "neighborhood", "sqft")


@query("filter_between", "listing_id varchar, sqft integer, list_price integer", """
    select listing_id, sqft, list_price from ny_feed_a where sqft between 500 and 1500 and list_price <= 4000""")
def filter_between(t):
    return t.input("ny_feed_a").filter(F.col("sqft").between(500, 1500) & (F.col("list_price") <= 4000)).select(
        "listing_id", "sqft", "list_price")


@query("filter_in_list", "review_id varchar, review_score integer",
       "select review_id, review_score from raw_order_reviews where review_score in (1, 2)")
def filter_in_list(t):
    return t.stg["stg_order_reviews"].filter(F.col("review_score").isin(1, 2)).select("review_id", "review_score")


@query("filter_abs_band", "listing_id varchar, latitude double, longitude double, list_price integer", """
    select listing_id, latitude, longitude, list_price from ny_feed_a
    where cast(abs(latitude - cast(40.6 as float)) as double) <= cast(0.02 as double)
      and cast(abs(longitude - cast(-73.9 as float)) as double) <= cast(0.02 as double)
      and abs(list_price - 2500) <= 300""")
def filter_abs_band(t):
    near = (within(F.col("latitude"), F.lit(40.6).cast("float"), 0.02)
            & within(F.col("longitude"), F.lit(-73.9).cast("float"), 0.02)
            & within(F.col("list_price"), F.lit(2500), 300))
    return t.input("ny_feed_a").filter(near).select("listing_id", "latitude", "longitude", "list_price")


@query("filter_interval", "order_id bigint, next_order_timestamp timestamp", """
    select order_id, next_order_timestamp from x_sequence
    where next_order_timestamp <= order_purchase_timestamp + interval '90' day""")
def filter_interval(t):
    numbered = sequence(_identified(t), "customer_unique_id", "order_purchase_timestamp", ["order_id"],
                        following="next_order_timestamp")
    soon = within_interval(F.col("next_order_timestamp"), F.col("order_purchase_timestamp"), 90)
    return numbered.filter(soon).select("order_id", "next_order_timestamp")


def _identified(t):
    return identified_orders(t.stg["stg_orders"], t.stg["stg_customers"])


@query("aggregate_filter", "order_status varchar, small_orders bigint, small_value double, none_value double", """
    select order_status, count(*) filter (gross_order_value < 50000) as small_orders,
           sum(gross_order_value) filter (gross_order_value < 50000) as small_value,
           sum(gross_order_value) filter (gross_order_value < 0) as none_value from x_fin group by order_status""")
def aggregate_filter(t):
    value = F.col("gross_order_value")
    return t.values.groupBy("order_status").agg(
        count_where(value < 50000).alias("small_orders"), sum_where(value, value < 50000).alias("small_value"),
        sum_where(value, value < 0).alias("none_value"))


# --- joins ----------------------------------------------------------------------------------

@query("join_inner_equi", "order_id bigint, order_item_id integer, product_id bigint, seller_state varchar, "
       "customer_state varchar", """
    select order_id, order_item_id, product_id, seller_state, customer_state
    from raw_order_items join raw_orders using (order_id) join raw_customers using (customer_id)
    join raw_sellers using (seller_id)""")
def join_inner_equi(t):
    s = t.stg
    placed = s["stg_orders"].join(s["stg_customers"], "customer_id").select("order_id", "customer_state")
    sold = s["stg_order_items"].join(s["stg_sellers"], "seller_id")
    return sold.join(placed, "order_id").select(
        "order_id", "order_item_id", "product_id", "seller_state", "customer_state")


@query("join_inner_using", "order_id bigint, payment_value double, order_status varchar",
       "select order_id, payment_value, order_status from raw_order_payments join raw_orders using (order_id)")
def join_inner_using(t):
    return t.stg["stg_order_payments"].join(t.stg["stg_orders"], "order_id").select(
        "order_id", "payment_value", "order_status")


@query("join_left", "product_id bigint, product_category_name varchar, product_category_name_english varchar", """
    select product_id, p.product_category_name, product_category_name_english from raw_products as p
    left join raw_product_category_name_translation as tr on tr.product_category_name = p.product_category_name""")
def join_left(t):
    return t.stg["stg_products"].join(t.stg["stg_category_translation"], "product_category_name", "left").select(
        "product_id", "product_category_name", "product_category_name_english")


@query("join_left_null_filter_anti", "order_id bigint, order_status varchar", """
    select o.order_id, order_status from raw_orders as o
    left join raw_order_payments as p on p.order_id = o.order_id where p.order_id is null""")
def join_left_null_filter_anti(t):
    return unmatched(t.stg["stg_orders"], t.stg["stg_order_payments"], ["order_id"]).select("order_id", "order_status")


@query("join_equi_plus_band", "a_id varchar, b_id varchar, rent integer, price_avg integer", """
    select a.listing_id as a_id, b.listing_id as b_id, a.list_price as rent, b.price_avg
    from x_ny_a as a join x_ny_b as b on a.zip_code = b.zip_code and a.address_line_1 = b.address_line_1
     and coalesce(a.address_line_2, '') = coalesce(b.address_line_2, '')
     and abs(a.list_price - b.price_avg) <= 300
     and cast(abs(a.latitude - b.latitude) as double) <= cast(0.0002 as double)
     and cast(abs(a.longitude - b.longitude) as double) <= cast(0.0002 as double)""")
def join_equi_plus_band(t):
    a, b = t.clean("new_york")
    left = a.select(F.col("listing_id").alias("a_id"), F.col("list_price").alias("rent"), "zip_code", "address_line_1",
                    empty_as_key(F.col("address_line_2")).alias("unit"), "latitude", "longitude")
    right = b.select(
        F.col("listing_id").alias("b_id"), "price_avg", F.col("zip_code").alias("b_zip"),
        F.col("address_line_1").alias("b_street"), empty_as_key(F.col("address_line_2")).alias("b_unit"),
        F.col("latitude").alias("b_lat"), F.col("longitude").alias("b_lon"))
    pairs = band_join(left, right, {"zip_code": "b_zip", "address_line_1": "b_street", "unit": "b_unit"},
                      {("latitude", "b_lat"): 0.0002, ("longitude", "b_lon"): 0.0002, ("rent", "price_avg"): 300})
    return pairs.select("a_id", "b_id", "rent", "price_avg")


@query("join_null_as_empty_key", "a_id varchar, b_id varchar, unit varchar", """
    select a.listing_id as a_id, b.listing_id as b_id, a.address_line_2 as unit from x_ny_a as a join x_ny_b as b
      on a.address_line_1 = b.address_line_1 and coalesce(a.address_line_2, '') = coalesce(b.address_line_2, '')""")
def join_null_as_empty_key(t):
    a, b = t.clean("new_york")
    left = a.select(F.col("listing_id").alias("a_id"), F.col("address_line_2").alias("unit"),
                    F.col("address_line_1").alias("street"), empty_as_key(F.col("address_line_2")).alias("key"))
    right = b.select(F.col("listing_id").alias("b_id"), F.col("address_line_1").alias("street"),
                     empty_as_key(F.col("address_line_2")).alias("key"))
    return salted_join(stage(left, "keyed"), right, ["street", "key"]).select("a_id", "b_id", "unit")


@query("join_cross_scalar", "order_id bigint, share_of_max double", f"""
    select order_id, {ratio('payment_value / (select max(payment_value) from raw_order_payments)')} as share_of_max
    from raw_order_payments where payment_value >= (select avg(payment_value) from raw_order_payments)""")
def join_cross_scalar(t):
    paid = t.stg["stg_order_payments"]
    summary = paid.agg(F.max("payment_value").alias("top"), F.avg("payment_value").alias("mean"))
    return with_scalar(paid, summary, "all").filter(F.col("payment_value") >= F.col("all.mean")).select(
        "order_id", rate(F.col("payment_value"), F.col("all.top")).alias("share_of_max"))


@query("join_self_sequence", "customer_unique_id varchar, order_id bigint, late_delivery boolean, "
       "next_order_timestamp timestamp", """
    select customer_unique_id, order_id, late_delivery, next_order_timestamp from x_sequence join
      (select order_id, late_delivery from x_experience where order_delivered_customer_date is not null) as e
    using (order_id) where order_num = 1""")
def join_self_sequence(t):
    firsts = customer_first_orders(t.stg["stg_orders"], t.stg["stg_customers"])
    seen = t.model["int_orders_experience"].filter(F.col("order_delivered_customer_date").isNotNull())
    return firsts.join(seen.select("order_id", "late_delivery"), "order_id").select(
        "customer_unique_id", "order_id", "late_delivery", "next_order_timestamp")


# --- aggregations -----------------------------------------------------------------------------

@query("agg_count_star", "order_id bigint, item_rows bigint",
       "select order_id, count(*) as item_rows from raw_order_items group by order_id")
def agg_count_star(t):
    return t.stg["stg_order_items"].groupBy("order_id").agg(F.count("*").alias("item_rows"))


@query("agg_count_distinct", "seller_id bigint, orders bigint, products bigint", """
    select seller_id, count(distinct order_id) as orders, count(distinct product_id) as products
    from raw_order_items group by seller_id""")
def agg_count_distinct(t):
    return t.stg["stg_order_items"].groupBy("seller_id").agg(
        F.countDistinct("order_id").alias("orders"), F.countDistinct("product_id").alias("products"))


@query("agg_count_distinct_merged", "year date, orders bigint, products bigint, sellers bigint, busiest_month_orders bigint", """
    with monthly as (
        select date_trunc('year', shipping_limit_date) as year, count(distinct order_id) as orders
        from raw_order_items group by 1, date_trunc('month', shipping_limit_date)),
    busiest as (select year, max(orders) as busiest_month_orders from monthly group by year),
    yearly as (
        select date_trunc('year', shipping_limit_date) as year, count(distinct order_id) as orders,
               count(distinct product_id) as products, count(distinct seller_id) as sellers
        from raw_order_items group by 1)
    select cast(year as date) as year, orders, products, sellers, busiest_month_orders from yearly join busiest using (year)""")
def agg_count_distinct_merged(t):
    """Sets per month, written once; the years come from the sets, not from the rows."""
    items = t.stg["stg_order_items"].withColumn("month", month_start(F.col("shipping_limit_date")))
    sets = stage(distinct_sets(items, ["month"], {"orders": "order_id", "products": "product_id", "sellers": "seller_id"}), "sets")
    year = F.trunc("month", "year").alias("year")
    months = count_sets(sets, ["month"], ["orders"])
    busiest = months.groupBy(year).agg(F.max("orders").alias("busiest_month_orders"))
    total = count_sets(merge_sets(sets, [year]), ["year"], ["orders", "products", "sellers"])
    return total.join(busiest, "year")


@query("agg_count_distinct_case", "seller_id bigint, dear_orders bigint", """
    select seller_id, count(distinct case when price > 30000 then order_id end) as dear_orders
    from raw_order_items group by seller_id""")
def agg_count_distinct_case(t):
    return t.stg["stg_order_items"].groupBy("seller_id").agg(
        F.countDistinct(F.when(F.col("price") > 30000, F.col("order_id"))).alias("dear_orders"))


@query("agg_sum_coalesce", "order_id bigint, item_revenue double, freight_revenue double", """
    select order_id, round(sum(coalesce(price, 0)), 2) as item_revenue,
           round(sum(coalesce(freight_value, 0)), 2) as freight_revenue from raw_order_items group by order_id""")
def agg_sum_coalesce(t):
    return t.stg["stg_order_items"].groupBy("order_id").agg(
        sum_or_zero(F.col("price")).alias("item_revenue"), sum_or_zero(F.col("freight_value")).alias("freight_revenue"))


@query("agg_avg", "order_id bigint, avg_price double",
       f"select order_id, {money('avg(price)')} as avg_price from raw_order_items group by order_id")
def agg_avg(t):
    return t.stg["stg_order_items"].groupBy("order_id").agg(money_avg(F.col("price")).alias("avg_price"))


@query("agg_min_max", "customer_id bigint, first_month date, last_delivered timestamp", """
    select customer_id, min(cast(date_trunc('month', order_purchase_timestamp) as date)) as first_month,
           max(case when order_status = 'delivered' then order_purchase_timestamp end) as last_delivered
    from raw_orders group by customer_id""")
def agg_min_max(t):
    bought = F.col("order_purchase_timestamp")
    return t.stg["stg_orders"].groupBy("customer_id").agg(
        F.min(month_start(bought)).alias("first_month"),
        F.max(F.when(F.col("order_status") == "delivered", bought)).alias("last_delivered"))


@query("agg_conditional_rate", "customer_id bigint, delivered_rate double", f"""
    select customer_id, {ratio("sum(case when order_status = 'delivered' then 1 else 0 end) / nullif(count(*), 0)")}
             as delivered_rate from raw_orders group by customer_id""")
def agg_conditional_rate(t):
    return t.stg["stg_orders"].groupBy("customer_id").agg(
        rate(count_where(F.col("order_status") == "delivered"), F.count("*")).alias("delivered_rate"))


@query("agg_ratio_of_sums", "seller_id bigint, shipping_share double", f"""
    select seller_id, {ratio('sum(freight_value) / nullif(sum(coalesce(price, 0) + freight_value), 0)')} as shipping_share
    from raw_order_items group by seller_id""")
def agg_ratio_of_sums(t):
    total = F.coalesce("price", F.lit(0)) + F.col("freight_value")
    return t.stg["stg_order_items"].groupBy("seller_id").agg(
        rate(F.sum("freight_value"), F.sum(total)).alias("shipping_share"))


@query("agg_percentile_cont", "zip_code varchar, p05 double, p50 double, p95 double", """
    select zip_code, cast(quantile_cont(list_price, 0.05) as decimal(38,6)) as p05,
           cast(quantile_cont(list_price, 0.5) as decimal(38,6)) as p50,
           cast(quantile_cont(list_price, 0.95) as decimal(38,6)) as p95 from ny_feed_a group by zip_code""")
def agg_percentile_cont(t):
    qs = {"p05": 0.05, "p50": 0.5, "p95": 0.95}
    cuts = percentiles(t.input("ny_feed_a"), "list_price", qs, ["zip_code"])
    return cuts.select("zip_code", *[F.col(q).cast("decimal(38,6)").alias(q) for q in qs])


@query("agg_percentile_cont_global", "price_p50 double, value_p05 double, value_p95 double", """
    select cast(quantile_cont(price, 0.5) as decimal(38,6)) as price_p50,
           cast(quantile_cont(freight_value, 0.05) as decimal(38,6)) as value_p05,
           cast(quantile_cont(price, 0.95) as decimal(38,6)) as value_p95
    from (select cast(price as double) as price, cast(freight_value as double) as freight_value from raw_order_items) as i""")
def agg_percentile_cont_global(t):
    wanted = {"price_p50": ("price", 0.5), "value_p05": ("freight_value", 0.05), "value_p95": ("price", 0.95)}
    cuts = column_percentiles(t.stg["stg_order_items"], wanted)
    return cuts.select(*[F.col(c).cast("decimal(38,6)").alias(c) for c in wanted])


@query("agg_two_phase", "week_start date, customers bigint, revenue double, avg_customer_revenue double", f"""
    select week_start, count(*) as customers, sum(revenue) as revenue, {money('avg(revenue)')} as avg_customer_revenue
    from x_customer_week group by week_start""")
def agg_two_phase(t):
    return customer_weeks(_identified(t), t.values).groupBy("week_start").agg(
        F.count("*").alias("customers"), F.sum("revenue").alias("revenue"),
        money_avg(F.col("revenue")).alias("avg_customer_revenue"))


@query("agg_distinct_on", "zip_code varchar, listing_id varchar, list_date date", """
    select zip_code, listing_id, list_date from ny_feed_a
    qualify row_number() over (partition by zip_code order by list_date desc nulls last, listing_id) = 1""")
def agg_distinct_on(t):
    return first_per_key(t.input("ny_feed_a"), ["zip_code"], [F.desc_nulls_last("list_date"), F.asc("listing_id")]).select(
        "zip_code", "listing_id", "list_date")


# --- windows ----------------------------------------------------------------------------------

def _sequenced(t, **kinds):
    return sequence(_identified(t), "customer_unique_id", "order_purchase_timestamp", ["order_id"], **kinds)


@query("win_row_number_sequence", "order_id bigint, order_num bigint", "select order_id, order_num from x_sequence")
def win_row_number_sequence(t):
    return _sequenced(t, number="order_num").select("order_id", "order_num")


@query("win_row_number_latest", "order_id bigint, review_id varchar", "select order_id, review_id from x_review")
def win_row_number_latest(t):
    return t.model["int_order_reviews_one_row"].select("order_id", "review_id")


@query("win_min_partition", "order_id bigint, first_order_timestamp timestamp",
       "select order_id, first_order_timestamp from x_sequence")
def win_min_partition(t):
    return _sequenced(t, first="first_order_timestamp").select("order_id", "first_order_timestamp")


@query("win_lag", "order_id bigint, prev_order_timestamp timestamp", "select order_id, prev_order_timestamp from x_sequence")
def win_lag(t):
    return _sequenced(t, previous="prev_order_timestamp").select("order_id", "prev_order_timestamp")


@query("win_lead", "order_id bigint, next_order_timestamp timestamp", "select order_id, next_order_timestamp from x_sequence")
def win_lead(t):
    return _sequenced(t, following="next_order_timestamp").select("order_id", "next_order_timestamp")


STEPS["x_week_items"] = """
    select cast(date_trunc('week', order_purchase_timestamp) as date) as week_start, count(*) as items,
           sum(coalesce(price, 0)) as revenue
    from raw_orders join raw_order_items using (order_id) where order_purchase_timestamp is not null group by 1"""


def _week_items(t):
    placed = t.stg["stg_orders"].filter(F.col("order_purchase_timestamp").isNotNull()).select(
        "order_id", week_start(F.col("order_purchase_timestamp")).alias("week_start"))
    return t.stg["stg_order_items"].join(placed, "order_id").groupBy("week_start").agg(
        F.count("*").alias("items"), F.sum(F.coalesce("price", F.lit(0))).alias("revenue"))


@query("win_rolling_rows_avg", "week_start date, items bigint, items_avg double, revenue_avg double", f"""
    select week_start, items, {money('avg(items) over last4')} as items_avg, {money('avg(revenue) over last4')} as revenue_avg
    from x_week_items window last4 as (order by week_start rows between 3 preceding and current row)""")
def win_rolling_rows_avg(t):
    return rolling_avg(_week_items(t), "week_start", {"items_avg": "items", "revenue_avg": "revenue"}).select(
        "week_start", "items", "items_avg", "revenue_avg")


@query("win_running_sum", "year integer, week_start date, running double", """
    select year(week_start) as year, week_start,
           sum(revenue) over (partition by year(week_start) order by week_start rows unbounded preceding) as running
    from x_week_items""")
def win_running_sum(t):
    weekly = _week_items(t).withColumn("year", F.year("week_start"))
    return running_sum(weekly, "week_start", "revenue", ["year"], "running").select("year", "week_start", "running")


# --- sorts and top-k --------------------------------------------------------------------------

@query("sort_multi", "product_id bigint, product_category_name varchar, product_length_cm integer", """
    select product_id, product_category_name, product_length_cm from raw_products
    order by product_category_name nulls last, product_length_cm desc nulls first, product_id""")
def sort_multi(t):
    return order_nulls(
        t.stg["stg_products"], ("product_category_name", "asc"), ("product_length_cm", "desc"),
        ("product_id", "asc")).select("product_id", "product_category_name", "product_length_cm")


@query("sort_case_rank", "order_status varchar, orders bigint", """
    select order_status, count(*) as orders from raw_orders group by 1
    order by case order_status when 'delivered' then 0 when 'shipped' then 1 else 2 end""")
def sort_case_rank(t):
    status = F.col("order_status")
    return t.stg["stg_orders"].groupBy("order_status").agg(F.count("*").alias("orders")).orderBy(
        F.when(status == "delivered", 0).when(status == "shipped", 1).otherwise(2))


@query("top_k_share", "k integer, top_total double, grand_total double, share double", f"""
    with totals as (select product_id as name, sum(freight_value) as total from raw_order_items group by 1),
         ranked as (select *, row_number() over (order by total desc, name) as place from totals)
    select k, sum(total) filter (place <= k) as top_total, sum(total) as grand_total,
           {ratio('sum(total) filter (place <= k) / sum(total)')} as share
    from ranked cross join (values (5), (10), (100)) as ks(k) group by k""")
def top_k_share_query(t):
    shares = top_k_share(t.stg["stg_order_items"], "product_id", "freight_value", [5, 10, 100])
    return shares.withColumn("share", rate(F.col("top_total"), F.col("grand_total")))


# --- set operations ---------------------------------------------------------------------------

@query("union_all_three", "origin varchar, listing_id varchar, rent integer", """
    select 'both' as origin, a_key as listing_id, rent from x_ny_pairs
    union all select 'a', md5(url), list_price from x_ny_a where url not in (select a_url from x_ny_pairs)
    union all select 'b', md5(url), price_avg from x_ny_b where url not in (select b_url from x_ny_pairs)""")
def union_all_three(t):
    a, b, matches = t.matched("new_york")
    a_left, b_left = left_over(a, b, matches)
    shape = lambda df, origin, key, rent: df.select(
        F.lit(origin).alias("origin"), F.md5(key).alias("listing_id"), F.col(rent).alias("rent"))
    return union_by_name([
        shape(match_listings(a, b, "borough", matches=matches), "both", "a_url", "rent"),
        shape(a_left, "a", "url", "list_price"), shape(b_left, "b", "url", "price_avg")])


@query("union_all_cities", "city varchar, listing_id varchar, zip_code varchar", """
    select 'Boston' as city, listing_id, zip_code from bos_feed_a
    union all select 'New York City', listing_id, zip_code from ny_feed_a""")
def union_all_cities(t):
    return union_by_name([
        t.input(feed).select(F.lit(city).alias("city"), "listing_id", "zip_code")
        for city, feed in (("Boston", "bos_feed_a"), ("New York City", "ny_feed_a"))])
