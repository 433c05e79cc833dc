"""Mergeable distinct counts against plain ones."""

from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from marketfold.operators.distinct import count_sets, distinct_sets, merge_sets, numbered
from test_plans import plan


def lines(spark):
    """A key with a third of the rows, negative and far ids, NULL keys and ids."""
    n = F.col("id")
    return spark.range(9000).select(
        F.when(n % 3 == 0, "hot").when(n % 97 == 0, None).otherwise((n % 7).cast("string")).alias("shop"),
        (n % 5).alias("month"), F.when(n % 11 != 0, (n * n) % 70_001 - 1000).alias("order"), (n % 13 * 100_000).alias("product"))


def counted(df, *keys):
    return df.groupBy(*keys).agg(F.countDistinct("order").alias("orders"), F.countDistinct("product").alias("products"))


def test_sets_by_month_merge_to_all_months(spark):
    df = lines(spark)
    monthly = distinct_sets(df, ["shop", "month"], {"orders": "order", "products": "product"})
    names = ["orders", "products"]
    assert rows(count_sets(monthly, ["shop", "month"], names)) == rows(counted(df, "shop", "month"))
    assert rows(count_sets(merge_sets(monthly, ["shop"]), ["shop"], names)) == rows(counted(df, "shop"))
    assert rows(count_sets(merge_sets(monthly, []), [], names)) == rows(counted(df))
    # Parts of a table made at different times.
    parts = [distinct_sets(df.where(F.col("month") % 2 == i), ["shop"], {"orders": "order", "products": "product"}) for i in (0, 1)]
    assert rows(count_sets(merge_sets(parts[0].union(parts[1]), ["shop"]), ["shop"], names)) == rows(counted(df, "shop"))


def test_groups_without_ids(frame):
    df = frame("shop string, id long", ("a", None), ("b", 1), ("b", 1), ("b", 0), ("b", -32768))
    assert rows(count_sets(distinct_sets(df, ["shop"], {"ids": "id"}), ["shop"], ["ids"])) == [("b", 3)]
    assert count_sets(distinct_sets(df.limit(0), ["shop"], {"ids": "id"}), ["shop"], ["ids"]).count() == 0


def test_text_ids_are_numbered_once(frame):
    df = frame("shop string, name string", ("a", "x"), ("a", "y"), ("b", "x"), ("b", None), ("b", ""), ("a", "x"))
    numbers = numbered(df, "name", "number")
    assert numbers.count() == 3 == numbers.select("number").distinct().count()
    sets = distinct_sets(df.join(numbers, "name"), ["shop"], {"names": "number"})
    assert rows(count_sets(sets, ["shop"], ["names"])) == [("a", 2), ("b", 2)]


def test_one_pass_without_expand(spark, tables):
    items = tables.input("raw_order_items")
    shown = plan(distinct_sets(items, ["seller_id"], {"orders": "order_id", "products": "product_id"}))
    assert "Expand" not in shown and shown.count("Scan parquet") <= plan(items).count("Scan parquet") and shown.count("Exchange") == 1
