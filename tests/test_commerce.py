from __future__ import annotations

import datetime as dt
from decimal import Decimal as D

import pytest

from conftest import rows
from marketfold.plans import commerce, staging

T = dt.datetime
ORDERS = ("order_id string, customer_id string, order_status string, order_purchase_timestamp timestamp_ntz, "
          "order_approved_at timestamp_ntz, order_delivered_carrier_date timestamp_ntz, "
          "order_delivered_customer_date timestamp_ntz, order_estimated_delivery_date timestamp_ntz")
ITEMS = ("order_id string, order_item_id int, product_id string, seller_id string, price decimal(12,2), "
         "freight_value decimal(12,2)")
PAYMENTS = "order_id string, payment_value decimal(12,2)"
REVIEWS = ("order_id string, review_id string, review_score int, review_comment_title string, "
           "review_comment_message string, review_creation_date timestamp_ntz, review_answer_timestamp timestamp_ntz")
CUSTOMERS = "customer_id string, customer_unique_id string, customer_state string"


def order(order_id, customer="c", bought=T(2024, 1, 1), status="delivered", delivered=None, estimated=None):
    return (order_id, customer, status, bought, None, None, delivered, estimated)


def item(order_id, price, freight=0, n=1, product="p", seller="s"):
    return (order_id, n, product, seller, None if price is None else D(price), None if freight is None else D(freight))


def test_latest_review(frame):
    early, late = T(2024, 1, 1), T(2024, 1, 2)
    reviews = frame(
        REVIEWS,
        ("a", "r1", 1, " ", None, early, late), ("a", "r2", 2, None, "hm", late, late),
        ("b", "r3", 3, "x", None, late, None), ("b", "r4", 4, None, "  ", early, early),
        ("c", "r5", 5, None, None, early, early), ("c", "r6", 1, "t", None, early, early))
    out = commerce.order_reviews_one_row(reviews)
    assert rows(out, "order_id", "review_id", "has_comment_flag") == [("a", "r2", 1), ("b", "r4", 0), ("c", "r6", 1)]


def test_experience_compares_dates(frame):
    orders = frame(
        ORDERS,
        order("same_day", delivered=T(2024, 1, 5, 20), estimated=T(2024, 1, 5, 8)),
        order("late", bought=T(2024, 1, 1, 23, 59), delivered=T(2024, 1, 6, 0, 1), estimated=T(2024, 1, 5)),
        order("no_estimate", delivered=T(2024, 1, 5)), order("open", estimated=T(2024, 1, 5)),
        order("no_purchase", bought=None, delivered=T(2024, 1, 4), estimated=T(2024, 1, 5)))
    out = commerce.orders_experience(orders, commerce.order_reviews_one_row(frame(REVIEWS)))
    assert rows(out, "order_id", "delivery_days", "late_delivery", "days_vs_estimated", "review_score") == [
        ("late", 5, True, 1, None), ("no_estimate", 4, None, None, None), ("no_purchase", None, False, -1, None),
        ("open", None, None, None, None), ("same_day", 4, False, 0, None)]


def test_sequence_quirks(frame):
    customers = frame(CUSTOMERS, ("c1", "u", "X"), ("c2", "u", "X"), ("c3", None, "X"))
    orders = frame(
        ORDERS, order("o2", "c1", T(2024, 1, 1, 23, 59)), order("o1", "c2", T(2024, 1, 1, 23, 59)),
        order("o3", "c1", T(2024, 1, 2, 0, 1), status="canceled"), order("o4", "c1", None), order("o5", "c3"))
    out = commerce.customer_order_sequence(orders, customers)
    assert rows(out, "order_id", "order_num", "days_since_previous_order", "is_first_order_flag") == [
        ("o1", 1, None, 1), ("o2", 2, 0, 0), ("o3", 3, 1, 0)]


def test_financials_without_items_or_payments(frame):
    orders = frame(ORDERS, order("a"), order("b"), order("c"))
    items = frame(ITEMS, item("a", "10.10", "1.05", 1, "p1"), item("a", None, "2", 2, "p2"), item("b", "1", None))
    payments = frame(PAYMENTS, ("a", D("5")), ("a", None))
    out = commerce.order_financials(orders, items, payments)
    assert rows(out, "order_id", "item_rows", "distinct_products", "distinct_sellers", "item_revenue",
                "freight_revenue", "payment_rows", "payment_total", "gross_order_value") == [
        ("a", 2, 2, 1, D("10.10"), D("3.05"), 2, D("5.00"), D("13.15")),
        ("b", 1, 1, 1, D("1.00"), D("0.00"), None, None, D("1.00")),
        ("c", 0, None, None, D("0.00"), D("0.00"), None, None, D("0.00"))]


def test_values_agree_with_financials(tables):
    full = tables.model["fct_order_financials"]
    columns = tables.values.columns
    assert full.select(*columns).exceptAll(tables.values).count() == 0


def test_repeat_within_ninety_days(frame):
    first = T(2024, 1, 1, 12)
    edge = first + dt.timedelta(days=90)
    customers = frame(CUSTOMERS, *[(f"c{i}", f"u{i}", "X") for i in range(4)])
    done = dict(delivered=T(2024, 1, 9), estimated=T(2024, 1, 8))
    orders = frame(
        ORDERS, order("a1", "c0", first, **done), order("a2", "c0", edge, "canceled"),
        order("b1", "c1", first, **done), order("b2", "c1", edge + dt.timedelta(microseconds=1)),
        order("d1", "c2", first, **done), order("e1", "c3", first, "canceled"), order("e2", "c3", edge, **done))
    experience = commerce.orders_experience(orders, commerce.order_reviews_one_row(frame(REVIEWS)))
    out = commerce.experience_retention(commerce.customer_first_orders(orders, customers), experience)
    assert rows(out) == [(True, "no_review", 3, D("0.3333"))]


@pytest.mark.parametrize("score, bucket", [
    (None, "no_review"), (1, "low_1_2"), (2, "low_1_2"), (3, "mid_3"), (4, "high_4_5"), (5, "high_4_5"), (0, "high_4_5")])
def test_review_bucket(frame, score, bucket):
    from pyspark.sql import functions as F
    assert frame("s int", (score,)).select(commerce.review_bucket(F.col("s"))).first()[0] == bucket


def test_cohorts_have_no_rows_for_idle_months(frame):
    customers = frame(CUSTOMERS, ("c1", "u1", "X"), ("c2", "u2", "X"))
    orders = frame(ORDERS, order("a", "c1", T(2023, 11, 5)), order("b", "c1", T(2024, 2, 1)),
                   order("c", "c2", T(2023, 11, 30)), order("d", "c2", T(2023, 10, 1), "canceled"))
    items = frame(ITEMS, item("a", "10"), item("b", "6"), item("c", "5"))
    out = commerce.cohort_ltv_monthly(orders, customers, commerce.order_values(orders, items))
    assert rows(out) == [
        (dt.date(2023, 11, 1), 0, 2, 2, 2, D("15.00"), D("1.0000"), D("7.50"), D("7.50")),
        (dt.date(2023, 11, 1), 3, 2, 1, 1, D("6.00"), D("0.5000"), D("3.00"), D("10.50"))]


def test_new_and_returning(frame):
    customers = frame(CUSTOMERS, ("c1", "u1", "X"), ("c2", "u2", "X"))
    orders = frame(ORDERS, order("a", "c1", T(2024, 1, 1)), order("b", "c1", T(2024, 1, 7)),
                   order("c", "c1", T(2024, 1, 8)), order("d", "c2", T(2024, 1, 8)))
    values = commerce.order_values(orders, frame(ITEMS, item("a", "1"), item("b", "2"), item("c", "4")))
    numbered = commerce.customer_order_sequence(orders, customers)
    identified = commerce.identified_orders(orders, customers)
    assert rows(commerce.new_vs_returning_weekly(numbered, values)) == rows(
        commerce.new_vs_returning_weekly(identified, values)) == [
        (dt.date(2024, 1, 1), 1, 0, D("1.0000"), D("3.00"), None),
        (dt.date(2024, 1, 8), 1, 1, D("0.5000"), D("0.00"), D("4.00"))]


def test_unknown_categories_stay_apart(frame):
    orders = frame(ORDERS, order("a"), order("b"), order("c", status="shipped"))
    products = frame("product_id string, product_category_name string", ("p", None), ("q", "toys"), ("r", "unknown"))
    translation = frame("product_category_name string, product_category_name_english string", ("other", "x"))
    items = frame(ITEMS, item("a", "1", 1, 1, "p"), item("a", "2", 0, 2, "q"), item("b", "3", 0, 1, "r"), item("c", "9"))
    out = commerce.category_weekly(orders, items, products, translation)
    week = dt.date(2024, 1, 1)
    # A missing category and one that is called unknown are two groups with one name.
    assert sorted(rows(out, "week_start", "product_category_name", "product_category_name_english", "gross_revenue")) == [
        (week, "toys", "unknown", D("2.00")), (week, "unknown", "unknown", D("2.00")), (week, "unknown", "unknown", D("3.00"))]


def test_flows_weigh_item_rows(frame):
    orders = frame(ORDERS, order("a", delivered=T(2024, 1, 11), estimated=T(2024, 1, 9)),
                   order("b", delivered=T(2024, 1, 2), estimated=T(2024, 1, 9)), order("d"))
    items = frame(ITEMS, item("a", "1", n=1), item("a", "2", n=2), item("b", "3"), item("d", "4"))
    enriched = commerce.order_items_enriched(
        items, orders, frame(CUSTOMERS, ("c", "u", "RJ")), frame("seller_id string, seller_state string", ("s", "SP")),
        frame("product_id string, product_category_name string", ("p", None)),
        frame("product_category_name string, product_category_name_english string"))
    reviews = commerce.order_reviews_one_row(frame(REVIEWS, ("a", "r", 5, None, None, None, None),
                                                   ("b", "q", 1, None, None, None, None)))
    out = commerce.state_flows_weekly(enriched, commerce.orders_experience(orders, reviews))
    assert rows(out) == [(dt.date(2024, 1, 1), "SP", "RJ", 3, D("10.00"), D("3.33"), 2, 2, D("7.00"), D("0.6667"), D("3.67"))]


def test_staging_columns():
    assert staging.columns_of("stg_order_items") == [
        "order_id", "order_item_id", "product_id", "seller_id", "shipping_limit_date", "price", "freight_value"]
    assert len(staging.columns_of("stg_products")) == 9


def test_invariants(tables):
    from pyspark.sql import functions as F
    kpis, weeks = tables.model["mart_kpis_weekly"], tables.model["mart_new_vs_returning_weekly"]
    dated = tables.stg["stg_orders"].filter("order_purchase_timestamp is not null").count()
    assert kpis.agg(F.sum("orders")).first()[0] == dated
    pairs = commerce.customer_weeks(tables.model["int_customer_order_sequence"], tables.values).count()
    assert weeks.agg(F.sum(F.col("new_customers") + F.col("returning_customers"))).first()[0] == pairs
    cohorts = tables.model["mart_cohort_ltv_monthly"]
    assert cohorts.filter("month_index = 0 and retention_rate <> 1").count() == 0
