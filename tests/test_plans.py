"""What the optimizer makes of the operators."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from marketfold.operators.quantiles import percentiles
from marketfold.operators.ranking import sequence, top_k_share
from marketfold.plans import commerce, listings


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_cartesian(tables):
    for name in ("mart_kpis_weekly", "mart_category_weekly", "mart_geo_state_flows_weekly", "mart_cohort_ltv_monthly",
                 "mart_experience_retention_90d", "mart_new_vs_returning_weekly", "fct_order_financials"):
        text = plan(tables.model[name])
        assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text, name
    text = plan(tables.published("new_york"))
    assert "Python" not in text and "Cartesian" not in text and "NestedLoop" not in text


def test_weekly_kpis_read_only_what_they_need(tables):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(tables.model["mart_kpis_weekly"]))
    read = {c.split(":")[0] for s in schemas for c in s.split(",")}
    assert read == {"o_orderkey", "o_orderstatus", "o_orderdate", "l_orderkey", "l_extendedprice", "l_quantity"}


def test_filter_reaches_the_scan(spark, tables, tmp_path):
    path = str(tmp_path / "orders")
    tables.stg["stg_orders"].write.parquet(path)
    text = plan(commerce.category_sales(
        spark.read.parquet(path), tables.stg["stg_order_items"], tables.stg["stg_products"],
        tables.stg["stg_category_translation"]))
    assert "EqualTo(order_status,delivered)" in text


def test_latest_per_key_is_limited_before_the_exchange(tables):
    text = plan(tables.model["int_order_reviews_one_row"])
    assert text.count("WindowGroupLimit") == 2


def test_distinct_counts_multiply_no_rows(tables):
    for name in ("mart_geo_state_flows_weekly", "fct_order_financials", "mart_cohort_ltv_monthly"):
        assert "Expand" not in plan(tables.model[name]), name


def test_orders_are_not_joined_to_themselves(tables):
    text = plan(tables.model["mart_cohort_ltv_monthly"])
    assert text.count("orders.parquet") <= 2  # orders, and orders again inside their values


def test_scalar_cutoffs_are_a_subquery(tables):
    text = plan(listings.trim_listings(tables.filled("new_york")[0]).select(F.col("rent")))
    assert "Subquery" in text and "NestedLoop" not in text


def test_percentiles_read_a_written_histogram(spark, frame, tmp_path):
    path = str(tmp_path / "values")
    frame("g string, v double", *[("a", float(i)) for i in range(50)]).write.parquet(path)
    text = plan(percentiles(spark.read.parquet(path), "v", {"low": 0.05, "mid": 0.5, "high": 0.95}, ["g"], count="n"))
    assert path not in text  # read once, before the histogram was written
    assert text.count("FileScan") == 2 and text.count("Exchange") <= 8 and "NestedLoop" not in text


def test_sequences_have_no_window_without_a_segment(spark, frame, tmp_path):
    path = str(tmp_path / "events")
    frame("k string, t timestamp_ntz, id int").write.parquet(path)
    text = plan(sequence(spark.read.parquet(path), "k", "t", ["id"], number="n", first="f", previous="p", following="x"))
    assert path not in text and "SinglePartition" not in text and "_scan_part" in text


def test_top_k_share_takes_the_total_from_the_groups(spark, frame, tmp_path):
    path = str(tmp_path / "sales")
    frame("g string, v double", ("a", 1.0)).write.parquet(path)
    assert path not in plan(top_k_share(spark.read.parquet(path), "g", "v", [1]))


def test_product_names_meet_before_the_facts(tables):
    for name in ("int_order_items_enriched", "mart_category_weekly"):
        text = plan(tables.model[name])
        assert text.count("lineitem.parquet") == 1, name
