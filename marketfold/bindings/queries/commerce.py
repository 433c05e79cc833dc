"""Staging, intermediate tables and marts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...plans.staging import SOURCE_OF, columns_of
from ...sources.commerce import SOURCE_TABLES
from ..registry import STEPS, money, query, ratio

_STAGING_TYPES = {
    "stg_customers": "bigint varchar varchar varchar varchar",
    "stg_orders": "bigint bigint varchar timestamp timestamp timestamp timestamp timestamp",
    "stg_order_items": "bigint integer bigint bigint timestamp double double",
    "stg_order_payments": "bigint integer varchar integer double",
    "stg_order_reviews": "varchar bigint integer varchar varchar timestamp timestamp",
    "stg_products": "bigint varchar integer integer integer integer integer integer integer",
    "stg_sellers": "bigint varchar varchar varchar",
    "stg_category_translation": "varchar varchar",
}


def _register_staging() -> None:
    for name, types in _STAGING_TYPES.items():
        names = columns_of(name)
        columns = ", ".join(f"{c} {kind}" for c, kind in zip(names, types.split()))
        query(name, columns, f"select {', '.join(names)} from {SOURCE_OF[name]}")(lambda t, n=name: t.stg[n])


_register_staging()


@query("src_tables", "table_name varchar, row_count bigint", " union all ".join(
    f"select '{n}' as table_name, count(*) as row_count from {n}" for n in SOURCE_TABLES))
def src_tables(t):
    counts = [t.raw[n].agg(F.count("*").alias("row_count")).select(F.lit(n).alias("table_name"), "row_count")
              for n in SOURCE_TABLES]
    result = counts[0]
    for c in counts[1:]:
        result = result.unionByName(c)
    return result


STEPS["x_review"] = """
    select order_id, review_id, review_score, review_creation_date, review_answer_timestamp,
           case when trim(coalesce(review_comment_title, '')) <> '' or trim(coalesce(review_comment_message, '')) <> ''
                then 1 else 0 end as has_comment_flag
    from raw_order_reviews
    qualify row_number() over (partition by order_id order by review_answer_timestamp desc nulls last,
                               review_creation_date desc nulls last, review_id desc) = 1"""
STEPS["x_experience"] = """
    select orders_in.*, date_diff('day', cast(order_purchase_timestamp as date),
                                  cast(order_delivered_customer_date as date)) as delivery_days,
           cast(order_delivered_customer_date as date) > cast(order_estimated_delivery_date as date) as late_delivery,
           date_diff('day', cast(order_estimated_delivery_date as date),
                     cast(order_delivered_customer_date as date)) as days_vs_estimated,
           review_score, review_creation_date, review_answer_timestamp, has_comment_flag
    from raw_orders as orders_in left join x_review using (order_id)"""
STEPS["x_enriched"] = """
    select order_id, order_item_id, customer_id, customer_state, seller_id, seller_state, product_id,
           raw_products.product_category_name, product_category_name_english, price, freight_value,
           coalesce(price, 0) + coalesce(freight_value, 0) as item_gmv, order_purchase_timestamp, order_status
    from raw_orders join raw_customers using (customer_id) join raw_order_items using (order_id)
    join raw_sellers using (seller_id) join raw_products using (product_id)
    left join raw_product_category_name_translation as tr
      on tr.product_category_name = raw_products.product_category_name"""
STEPS["x_sequence"] = """
    select customer_id, customer_unique_id, order_id, order_purchase_timestamp,
           row_number() over by_time as order_num,
           min(order_purchase_timestamp) over (partition by customer_unique_id) as first_order_timestamp,
           lag(order_purchase_timestamp) over by_time as prev_order_timestamp,
           lead(order_purchase_timestamp) over by_time as next_order_timestamp
    from raw_orders join raw_customers using (customer_id)
    where customer_unique_id is not null and order_purchase_timestamp is not null
    window by_time as (partition by customer_unique_id order by order_purchase_timestamp, order_id)"""
STEPS["x_item_sums"] = """
    select order_id, count(*) as item_rows, count(distinct product_id) as distinct_products,
           count(distinct seller_id) as distinct_sellers, sum(coalesce(price, 0)) as item_sum,
           sum(coalesce(freight_value, 0)) as freight_sum
    from raw_order_items group by order_id"""
STEPS["x_fin"] = """
    select raw_orders.*, coalesce(item_rows, 0) as item_rows, distinct_products, distinct_sellers,
           coalesce(item_sum, 0) as item_revenue, coalesce(freight_sum, 0) as freight_revenue,
           payment_rows, payment_total, coalesce(item_sum, 0) + coalesce(freight_sum, 0) as gross_order_value
    from raw_orders left join x_item_sums using (order_id)
    left join (select order_id, count(*) as payment_rows, sum(coalesce(payment_value, 0)) as payment_total
               from raw_order_payments group by order_id) as pay using (order_id)"""
STEPS["x_kpis"] = f"""
    select cast(date_trunc('week', order_purchase_timestamp) as date) as week_start, count(*) as orders,
           sum(gross_order_value) as gross_revenue, sum(item_revenue) as item_revenue,
           sum(freight_revenue) as freight_revenue, {money('avg(item_revenue)')} as aov,
           {money('avg(gross_order_value)')} as order_value_incl_shipping,
           {money('avg(freight_revenue)')} as shipping_per_order,
           {ratio('sum(freight_revenue) / nullif(sum(gross_order_value), 0)')} as shipping_share,
           {money('avg(item_rows)')} as items_per_order,
           {ratio("count(*) filter (order_status = 'delivered') / count(*)")} as delivered_rate,
           {ratio("count(*) filter (order_status = 'canceled') / count(*)")} as canceled_rate
    from x_fin where order_purchase_timestamp is not null group by 1"""
STEPS["x_category"] = """
    select cast(date_trunc('week', order_purchase_timestamp) as date) as week_start,
           raw_products.product_category_name as category, product_category_name_english as english,
           count(distinct order_id) as orders, count(*) as items, sum(coalesce(price, 0)) as item_revenue,
           sum(coalesce(freight_value, 0)) as freight_revenue
    from raw_orders join raw_order_items using (order_id) join raw_products using (product_id)
    left join raw_product_category_name_translation as tr
      on tr.product_category_name = raw_products.product_category_name
    where order_purchase_timestamp is not null and order_status = 'delivered' group by all"""
STEPS["x_flow_rows"] = """
    select cast(date_trunc('week', x_enriched.order_purchase_timestamp) as date) as week_start, seller_state,
           customer_state, order_id, item_gmv, delivery_days, late_delivery, review_score
    from x_enriched left join (select order_id, delivery_days, late_delivery, review_score from x_experience) as e
    using (order_id) where order_purchase_timestamp is not null"""
STEPS["x_retention"] = f"""
    select late_delivery,
           case when review_score is null then 'no_review' when review_score in (1, 2) then 'low_1_2'
                when review_score = 3 then 'mid_3' else 'high_4_5' end as review_bucket,
           count(*) as customers,
           {ratio('''count(*) filter (next_order_timestamp <= s.order_purchase_timestamp + interval '90' day)
                     / count(*)''')} as repeat_rate_90d
    from x_sequence as s join x_experience using (order_id)
    where order_num = 1 and order_delivered_customer_date is not null group by 1, 2"""
STEPS["x_bought"] = """
    select customer_unique_id, order_id, cast(date_trunc('month', order_purchase_timestamp) as date) as order_month,
           min(cast(date_trunc('month', order_purchase_timestamp) as date)) over (partition by customer_unique_id)
             as cohort_month, gross_order_value
    from x_fin join raw_customers using (customer_id)
    where order_purchase_timestamp is not null and customer_unique_id is not null and order_status = 'delivered'"""
STEPS["x_cohort"] = f"""
    select *, {ratio('active_customers / cohort_size')} as retention_rate,
           {money('gross_revenue / cohort_size')} as revenue_per_cohort_customer,
           {money('sum(gross_revenue) over (partition by cohort_month order by month_index) / cohort_size')}
             as cumulative_revenue_per_cohort_customer
    from (select cohort_month, month_index, active_customers, orders, gross_revenue,
                 max(active_customers) filter (month_index = 0) over (partition by cohort_month) as cohort_size
          from (select cohort_month, date_diff('month', cohort_month, order_month) as month_index,
                       count(distinct customer_unique_id) as active_customers, count(distinct order_id) as orders,
                       sum(gross_order_value) as gross_revenue
                from x_bought group by 1, 2) as m) as sized"""


@query("int_order_reviews_one_row", "order_id bigint, review_id varchar, review_score integer, "
       "review_creation_date timestamp, review_answer_timestamp timestamp, has_comment_flag integer",
       "select * from x_review")
def int_order_reviews_one_row(t):
    return t.model["int_order_reviews_one_row"]


@query("int_orders_experience", "order_id bigint, customer_id bigint, order_status varchar, "
       "order_purchase_timestamp timestamp, order_approved_at timestamp, order_delivered_carrier_date timestamp, "
       "order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp, delivery_days integer, "
       "late_delivery boolean, days_vs_estimated integer, review_score integer, review_creation_date timestamp, "
       "review_answer_timestamp timestamp, has_comment_flag integer", "select * from x_experience")
def int_orders_experience(t):
    return t.model["int_orders_experience"]


@query("int_order_items_enriched", "order_id bigint, order_item_id integer, customer_id bigint, customer_state varchar, "
       "seller_id bigint, seller_state varchar, product_id bigint, product_category_name varchar, "
       "product_category_name_english varchar, price double, freight_value double, item_gmv double, "
       "order_purchase_timestamp timestamp, order_status varchar", "select * from x_enriched")
def int_order_items_enriched(t):
    return t.model["int_order_items_enriched"]


@query("int_customer_order_sequence", "customer_id bigint, customer_unique_id varchar, order_id bigint, "
       "order_purchase_timestamp timestamp, order_num bigint, first_order_timestamp timestamp, "
       "prev_order_timestamp timestamp, days_since_previous_order integer, is_first_order_flag integer",
       """select *, date_diff('day', cast(prev_order_timestamp as date), cast(order_purchase_timestamp as date))
                 as days_since_previous_order, case when order_num = 1 then 1 else 0 end as is_first_order_flag
          from x_sequence""")
def int_customer_order_sequence(t):
    return t.model["int_customer_order_sequence"]


@query("fct_order_financials", "order_id bigint, customer_id bigint, order_status varchar, "
       "order_purchase_timestamp timestamp, order_approved_at timestamp, order_delivered_carrier_date timestamp, "
       "order_delivered_customer_date timestamp, order_estimated_delivery_date timestamp, item_rows bigint, "
       "distinct_products bigint, distinct_sellers bigint, item_revenue double, freight_revenue double, "
       "payment_rows bigint, payment_total double, gross_order_value double", "select * from x_fin")
def fct_order_financials(t):
    return t.model["fct_order_financials"]


@query("mart_kpis_weekly", "week_start date, orders bigint, gross_revenue double, item_revenue double, "
       "freight_revenue double, aov double, order_value_incl_shipping double, shipping_per_order double, "
       "shipping_share double, items_per_order double, delivered_rate double, canceled_rate double, "
       "orders_4wk_avg double, revenue_4wk_avg double, aov_4wk_avg double",
       f"""select *, {money('avg(orders) over last4')} as orders_4wk_avg,
                  {money('avg(gross_revenue) over last4')} as revenue_4wk_avg,
                  {money('avg(aov) over last4')} as aov_4wk_avg
           from x_kpis window last4 as (order by week_start rows between 3 preceding and current row)""")
def mart_kpis_weekly(t):
    return t.model["mart_kpis_weekly"]


@query("mart_category_weekly", "week_start date, product_category_name varchar, product_category_name_english varchar, "
       "orders bigint, items bigint, gross_revenue double, item_revenue double, freight_revenue double",
       """select week_start, coalesce(category, 'unknown') as product_category_name,
                 coalesce(english, 'unknown') as product_category_name_english, orders, items,
                 item_revenue + freight_revenue as gross_revenue, item_revenue, freight_revenue from x_category""")
def mart_category_weekly(t):
    return t.model["mart_category_weekly"]


@query("mart_geo_state_flows_weekly", "week_start date, seller_state varchar, customer_state varchar, orders bigint, "
       "gross_revenue double, aov_proxy double, delivered_orders bigint, reviewed_orders bigint, "
       "avg_delivery_days double, late_delivery_rate double, avg_review_score double",
       f"""select week_start, seller_state, customer_state, count(distinct order_id) as orders,
                  sum(item_gmv) as gross_revenue, {money('sum(item_gmv) / count(distinct order_id)')} as aov_proxy,
                  count(distinct case when delivery_days is not null then order_id end) as delivered_orders,
                  count(distinct case when review_score is not null then order_id end) as reviewed_orders,
                  {money('avg(delivery_days)')} as avg_delivery_days,
                  {ratio('count(*) filter (late_delivery) / nullif(count(late_delivery), 0)')} as late_delivery_rate,
                  {money('avg(review_score)')} as avg_review_score
           from x_flow_rows group by all""")
def mart_geo_state_flows_weekly(t):
    return t.model["mart_geo_state_flows_weekly"]


STEPS["x_customer_week"] = """
    select cast(date_trunc('week', s.order_purchase_timestamp) as date) as week_start, s.customer_unique_id,
           cast(date_trunc('week', min(first_order_timestamp)) as date)
             = cast(date_trunc('week', s.order_purchase_timestamp) as date) as is_new, sum(gross_order_value) as revenue
    from x_sequence as s join x_fin using (order_id)
    group by cast(date_trunc('week', s.order_purchase_timestamp) as date), s.customer_unique_id"""
_NEW_RETURNING = f"""
    select week_start, count(*) filter (is_new) as new_customers, count(*) filter (not is_new) as returning_customers,
           {ratio('count(*) filter (is_new) / count(*)')} as new_customer_share,
           sum(revenue) filter (is_new) as new_customer_revenue,
           sum(revenue) filter (not is_new) as returning_customer_revenue
    from x_customer_week group by week_start"""


@query("mart_new_vs_returning_weekly", "week_start date, new_customers bigint, returning_customers bigint, "
       "new_customer_share double, new_customer_revenue double, returning_customer_revenue double", _NEW_RETURNING)
def mart_new_vs_returning_weekly(t):
    return t.model["mart_new_vs_returning_weekly"]


@query("mart_experience_retention_90d", "late_delivery boolean, review_bucket varchar, customers bigint, "
       "repeat_rate_90d double", "select * from x_retention")
def mart_experience_retention_90d(t):
    return t.model["mart_experience_retention_90d"]


@query("mart_cohort_ltv_monthly", "cohort_month date, month_index integer, cohort_size bigint, active_customers bigint, "
       "orders bigint, gross_revenue double, retention_rate double, revenue_per_cohort_customer double, "
       "cumulative_revenue_per_cohort_customer double", "select * from x_cohort")
def mart_cohort_ltv_monthly(t):
    return t.model["mart_cohort_ltv_monthly"]
