"""Scalar functions, each over a whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions import numbers, text, times
from ...plans.commerce import review_bucket
from ..registry import query

_BOUGHT = "order_purchase_timestamp"


@query("fn_date_trunc_week", "order_id bigint, week_start date",
       f"select order_id, cast(date_trunc('week', {_BOUGHT}) as date) as week_start from raw_orders")
def fn_date_trunc_week(t):
    return t.stg["stg_orders"].select("order_id", times.week_start(F.col(_BOUGHT)).alias("week_start"))


@query("fn_date_trunc_month", "order_id bigint, month_start date",
       f"select order_id, cast(date_trunc('month', {_BOUGHT}) as date) as month_start from raw_orders")
def fn_date_trunc_month(t):
    return t.stg["stg_orders"].select("order_id", times.month_start(F.col(_BOUGHT)).alias("month_start"))


@query("fn_month_index", "order_id bigint, month_index integer", f"""
    select order_id, (year({_BOUGHT}) - 1995) * 12 + month({_BOUGHT}) - 3 as month_index from raw_orders""")
def fn_month_index(t):
    origin = F.lit("1995-03-15").cast("date")
    return t.stg["stg_orders"].select("order_id", times.month_index(F.col(_BOUGHT), origin).alias("month_index"))


@query("fn_date_diff_days", "order_id bigint, delivery_days integer", f"""
    select order_id, date_diff('day', cast({_BOUGHT} as date), cast(order_delivered_customer_date as date))
             as delivery_days from raw_orders""")
def fn_date_diff_days(t):
    return t.stg["stg_orders"].select(
        "order_id", times.days_between(F.col("order_delivered_customer_date"), F.col(_BOUGHT)).alias("delivery_days"))


@query("fn_coalesce_nullif_trim", "review_id varchar, title varchar, has_comment integer", """
    select review_id, nullif(trim(coalesce(review_comment_title, '')), '') as title,
           case when nullif(trim(coalesce(review_comment_title, '')), '') is null then 0 else 1 end as has_comment
    from raw_order_reviews""")
def fn_coalesce_nullif_trim(t):
    title = F.col("review_comment_title")
    return t.stg["stg_order_reviews"].select(
        "review_id", text.blank_to_null(title).alias("title"), text.has_text(title).alias("has_comment"))


@query("fn_case", "review_id varchar, bucket varchar, weight integer", """
    select review_id, case when review_score in (1, 2) then 'low_1_2' when review_score = 3 then 'mid_3'
                           when review_score is null then 'no_review' else 'high_4_5' end as bucket,
           case review_score when 1 then 10 when 5 then 50 else 0 end as weight from raw_order_reviews""")
def fn_case(t):
    score = F.col("review_score")
    return t.stg["stg_order_reviews"].select(
        "review_id", review_bucket(score).alias("bucket"),
        F.when(score == 1, 10).when(score == 5, 50).otherwise(0).alias("weight"))


@query("fn_round_numeric", "order_id bigint, order_item_id integer, eighth double", """
    select order_id, order_item_id, cast((2 * cast(price * 100 as bigint) + 8) // 16 as double) / 100 as eighth
    from raw_order_items""")
def fn_round_numeric(t):
    # An eighth of a price in cents often ends in a half: ties go away from zero.
    return t.stg["stg_order_items"].select(
        "order_id", "order_item_id", F.round(F.col("price") / F.lit(8).cast("decimal(1,0)"), 2).alias("eighth"))


@query("fn_midpoint_int", "listing_id varchar, price_avg integer, sqft_avg integer", """
    select listing_id, (price_min + price_max) // 2 as price_avg, (sqft_min + sqft_max) // 2 as sqft_avg from ny_feed_b""")
def fn_midpoint_int(t):
    return t.input("ny_feed_b").select(
        "listing_id", numbers.midpoint_int(F.col("price_min"), F.col("price_max")).alias("price_avg"),
        numbers.midpoint_int(F.col("sqft_min"), F.col("sqft_max")).alias("sqft_avg"))


@query("fn_midpoint_float", "listing_id varchar, beds_avg double", """
    select listing_id, cast(beds_min + beds_max as double) / 2 as beds_avg from ny_feed_b""")
def fn_midpoint_float(t):
    return t.input("ny_feed_b").select(
        "listing_id", numbers.midpoint_float(F.col("beds_min"), F.col("beds_max")).alias("beds_avg"))


@query("fn_strip_non_numeric", "ordinal bigint, baths double", """
    select ordinal, try_cast(nullif(regexp_replace(baths, '[^0-9.]', '', 'g'), '') as float) as baths from landed_a""")
def fn_strip_non_numeric(t):
    return t.input("landed_a").select("ordinal", numbers.strip_non_numeric(F.col("baths")).alias("baths"))


@query("fn_position_substring", "listing_id varchar, marker integer, before varchar, after varchar", """
    select listing_id, strpos(address_line, 'Main') as marker,
           substring(address_line, 1, strpos(address_line, 'Main') - 1) as before,
           substring(address_line, strpos(address_line, 'Main')) as after from ny_feed_a""")
def fn_position_substring(t):
    line = F.col("address_line")
    at = F.instr(line, "Main")
    return t.input("ny_feed_a").select(
        "listing_id", at.alias("marker"), F.substring(line, F.lit(1), at - 1).alias("before"),
        F.substring(line, at, F.length(line)).alias("after"))


@query("fn_regexp_replace_flags", "listing_id varchar, letters varchar, no_unit varchar", r"""
    select listing_id, regexp_replace(address_line, '[^a-zA-Z0-9\s]', '', 'g') as letters,
           regexp_replace(address_line, '(^|\s)(APT|UNIT)\s*', '', 'gi') as no_unit from ny_feed_a""")
def fn_regexp_replace_flags(t):
    line = F.col("address_line")
    return t.input("ny_feed_a").select(
        "listing_id", F.regexp_replace(line, r"[^a-zA-Z0-9\s]", "").alias("letters"),
        F.regexp_replace(line, r"(?i)(^|\s)(APT|UNIT)\s*", "").alias("no_unit"))


@query("fn_lower_trim", "customer_id bigint, state_key varchar",
       "select customer_id, lower(trim(concat('  ', customer_state, ' '))) as state_key from raw_customers")
def fn_lower_trim(t):
    padded = F.concat(F.lit("  "), "customer_state", F.lit(" "))
    return t.stg["stg_customers"].select("customer_id", F.lower(F.trim(padded)).alias("state_key"))


@query("fn_md5_key", "listing_id varchar, key varchar", "select listing_id, md5(url) as key from ny_feed_a")
def fn_md5_key(t):
    return t.input("ny_feed_a").select("listing_id", text.listing_key(F.col("url")).alias("key"))


@query("fn_abs", "listing_id varchar, gap integer", "select listing_id, abs(list_price - 2500) as gap from ny_feed_a")
def fn_abs(t):
    return t.input("ny_feed_a").select("listing_id", F.abs(F.col("list_price") - 2500).alias("gap"))


@query("fn_typed_null", "listing_id varchar, pet_cats boolean, list_date date, url varchar", """
    select listing_id, null as pet_cats, null as list_date, null as url from ny_feed_b""")
def fn_typed_null(t):
    return t.input("ny_feed_b").select(
        "listing_id", F.lit(None).cast("boolean").alias("pet_cats"), F.lit(None).cast("date").alias("list_date"),
        F.lit(None).cast("string").alias("url"))


@query("fn_round_half_even_int", "listing_id varchar, half double, rounded integer", """
    select listing_id, cast(price_max as double) / 2 as half,
           cast(round_even(cast(price_max as double) / 2, 0) as integer) as rounded from ny_feed_b""")
def fn_round_half_even_int(t):
    half = F.col("price_max").cast("double") / 2
    return t.input("ny_feed_b").select(
        "listing_id", half.alias("half"), numbers.round_half_even_int(half).alias("rounded"))


@query("fn_refresh_stamp", "order_id bigint, stamp timestamp", """
    select o_orderkey as order_id, date_trunc('second', o_orderdate + (o_orderkey % 1000) * interval '1' millisecond
             + interval '500' millisecond) as stamp from orders""")
def fn_refresh_stamp(t):
    at = F.expr("o_orderdate + (o_orderkey % 1000) * interval '0.001' second")
    return t.table("orders").select(F.col("o_orderkey").alias("order_id"), times.refresh_stamp(at).alias("stamp"))
