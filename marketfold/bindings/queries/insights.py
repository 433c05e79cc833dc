"""Reported commerce questions."""

from __future__ import annotations

from ...plans import insights
from ...plans.commerce import category_sales
from ..registry import STEPS, money, query, ratio


def _corridors(t):
    return insights.order_corridors(t.model["int_order_items_enriched"], t.model["int_orders_experience"])


STEPS["x_corridor"] = """
    select * from (select distinct order_id, seller_state, customer_state from x_enriched) as p
    join (select order_id, delivery_days, late_delivery from x_experience) as e using (order_id)"""
_DELIVERY = f"""count(*) as orders, {money('avg(delivery_days)')} as avg_delivery_days,
    {ratio('count(*) filter (late_delivery) / nullif(count(late_delivery), 0)')} as late_rate"""


@query("commerce_headline", "orders bigint, gross_revenue double, item_aov double, shipping_share double",
       f"""select count(*) as orders, sum(gross_order_value) as gross_revenue, {money('avg(item_revenue)')} as item_aov,
                  {ratio('sum(freight_revenue) / sum(gross_order_value)')} as shipping_share from x_fin""")
def commerce_headline(t):
    return insights.commerce_headline(t.values)


@query("category_concentration", "k integer, top_total double, grand_total double, share double", f"""
    with totals as (select coalesce(category, 'unknown') as name, sum(item_revenue + freight_revenue) as total
                    from x_category group by 1),
         ranked as (select *, row_number() over (order by total desc, name) as place from totals)
    select k, sum(total) filter (place <= k) as top_total, sum(total) as grand_total,
           {ratio('sum(total) filter (place <= k) / sum(total)')} as share
    from ranked cross join (values (5), (10)) as ks(k) group by k""")
def category_concentration(t):
    return insights.category_concentration(t.model["mart_category_weekly"])


@query("state_order_share", "side varchar, state varchar, orders bigint, share double", f"""
    select side, state, orders, {ratio('orders / sum(orders) over (partition by side)')} as share
    from (select 'customer' as side, customer_state as state, count(distinct order_id) as orders
          from raw_orders join raw_customers using (customer_id) group by 2
          union all select 'seller', seller_state, count(distinct order_id) from x_enriched group by 2) as s""")
def state_order_share(t):
    return insights.state_order_share(t.model["int_order_items_enriched"], t.stg["stg_orders"], t.stg["stg_customers"])


@query("in_state_vs_cross_state", "route varchar, orders bigint, avg_delivery_days double, late_rate double, "
       "order_share double", f"""
    select *, {ratio('orders / sum(orders) over ()')} as order_share
    from (select case when seller_state = customer_state then 'in_state' else 'cross_state' end as route, {_DELIVERY}
          from x_corridor group by 1) as r""")
def in_state_vs_cross_state(t):
    return insights.in_state_vs_cross_state(_corridors(t))


@query("corridor_late_rate", "seller_state varchar, customer_state varchar, orders bigint, avg_delivery_days double, "
       "late_rate double",
       f"select * from (select seller_state, customer_state, {_DELIVERY} from x_corridor group by 1, 2) as c "
       "where orders >= 20")
def corridor_late_rate(t):
    return insights.corridor_late_rate(_corridors(t), min_orders=20)


@query("peak_week_multiple", "peak_revenue double, peak_week date, mean_revenue double, multiple double", f"""
    select peak_revenue, peak_week, mean_revenue, {ratio('peak_revenue / mean_revenue')} as multiple
    from (select max(gross_revenue) as peak_revenue, (select min(week_start) from x_kpis where gross_revenue = (select max(gross_revenue) from x_kpis)) as peak_week,
                 {money('avg(gross_revenue)')} as mean_revenue from x_kpis) as p""")
def peak_week_multiple(t):
    return insights.peak_week_multiple(t.model["mart_kpis_weekly"])


@query("weighted_month1_retention", "active_month1 bigint, acquired bigint, retention double", f"""
    select *, {ratio('active_month1 / acquired')} as retention
    from (select coalesce(sum(active_customers) filter (month_index = 1), 0) as active_month1,
                 sum(cohort_size) filter (month_index = 0) as acquired from x_cohort) as r""")
def weighted_month1_retention(t):
    return insights.weighted_month1_retention(t.model["mart_cohort_ltv_monthly"])


@query("ltv_lift_6m", "cohort_month date, cohort_size bigint, ltv_start double, ltv_end double, lift double", """
    select *, round(round(cast(ltv_end / nullif(ltv_start, 0) as decimal(38,10)), 6) - 1, 4) as lift
    from (select cohort_month, max(cohort_size) as cohort_size,
                 max(cumulative_revenue_per_cohort_customer) filter (month_index = 0) as ltv_start,
                 arg_max(cumulative_revenue_per_cohort_customer, month_index) as ltv_end
          from x_cohort where month_index <= 6 group by cohort_month) as c""")
def ltv_lift_6m(t):
    return insights.ltv_lift(t.model["mart_cohort_ltv_monthly"])


@query("repeat_rate_90d_overall", "customers bigint, repeat_rate double", f"""
    select sum(customers) as customers, {ratio('sum(repeat_rate_90d * customers) / sum(customers)')} as repeat_rate
    from x_retention""")
def repeat_rate_90d_overall(t):
    return insights.repeat_rate_overall(t.model["mart_experience_retention_90d"])


@query("category_aov_vs_revenue", "category varchar, orders bigint, revenue double, revenue_per_order double", f"""
    select coalesce(product_category_name, 'unknown') as category, count(distinct order_id) as orders,
           sum(item_gmv) as revenue, {money('sum(item_gmv) / count(distinct order_id)')} as revenue_per_order
    from raw_order_items join raw_products using (product_id)
    join (select order_id from raw_orders where order_purchase_timestamp is not null) as o using (order_id)
    cross join lateral (select coalesce(price, 0) + coalesce(freight_value, 0) as item_gmv) as g group by 1""")
def category_aov_vs_revenue(t):
    sales = category_sales(t.stg["stg_orders"], t.stg["stg_order_items"], t.stg["stg_products"],
                           t.stg["stg_category_translation"], status=None)
    return insights.category_aov_vs_revenue(sales)
