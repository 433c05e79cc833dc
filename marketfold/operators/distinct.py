"""Exact distinct counts that can be merged: weeks to months, parts of a table to the whole.

The ids of a group are bitmaps, one for each range of 32,768 ids that it touches. A bitmap
is built with map-side combine, so what is shuffled and kept grows with the groups and the
ranges they touch, 4 KB each, not with the rows; several columns are counted in one pass over the rows.
Made for groups with hundreds of ids in a range, such as months: with one id per group and range
a plain distinct count is far smaller. ``numbered`` gives ids that lie close together to text keys or scattered ones.
NULL ids are not counted; NULL keys are a group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.sinks import stage


def numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): a number for each distinct non-NULL value, in runs without gaps. It is written, so that
    every reader sees the same numbers."""
    found = df.select(column).where(F.col(column).isNotNull()).distinct()
    return stage(found.withColumn(name, F.monotonically_increasing_id()), "numbered")


def distinct_sets(df: DataFrame, keys: Sequence[str], columns: dict[str, str]) -> DataFrame:
    """(keys, counted, bucket, members): the ids in ``columns`` (name of the count to integer column) per group."""
    each = F.explode(F.array(*[
        F.struct(F.lit(name).alias("counted"), F.col(column).cast("long").alias("id")) for name, column in columns.items()]))
    rows = df.select(*keys, each.alias("_c")).where("_c.id is not null")
    return rows.groupBy(*keys, F.col("_c.counted").alias("counted"), F.bitmap_bucket_number("_c.id").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_c.id")).alias("members"))


def merge_sets(sets: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """Sets of coarser groups: ``keys`` are some of the keys of ``sets``, or columns made from them."""
    return sets.groupBy(*keys, "counted", "bucket").agg(F.bitmap_or_agg("members").alias("members"))


def count_sets(sets: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """One row per group that has a set, and one column per count; 0 where a group lacks a set."""
    size = F.bitmap_count("members")
    return sets.groupBy(*keys).agg(*[
        F.coalesce(F.sum(F.when(F.col("counted") == name, size)), F.lit(0)).alias(name) for name in names])
