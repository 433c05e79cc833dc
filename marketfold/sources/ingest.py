"""From landed pages to the raw contract of each city, and what does not fit into it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import landing, lookups

AREA = {"boston": "neighborhood", "new_york": "borough"}
POSITION = ("query_zip", "page", "pos")
BROKEN = "_broken"


def ingest(pages: DataFrame, feed: str, city: str, plan: DataFrame | None = None) -> DataFrame:
    """Pages (query_zip, page, and those of ``landing.parse_pages``) to one typed row per listing id.

    A listing that several queries return counts as fetched by the first: ZIP codes in the order of
    ``plan`` (query_zip, query_area, ordinal), then page, then position. That order is data, so the
    first row of an id is a minimum, taken on the map side too, and no id is sorted in one task. Pages
    of ZIP codes outside of the plan are left out, as are records without an id.

    New York rows bear the borough of the *queried* ZIP, Boston rows the neighborhood of their own.
    """
    spark = pages.sparkSession
    plan = lookups.fetch_plan(spark, city, feed) if plan is None else plan
    landed = landing.land_pages(pages, feed, ("query_zip", "page")).join(plan, "query_zip")
    typed = landing.typed_listings(landed, feed, ("ordinal", "page", "pos", "query_area"), city)
    contract = list(landing.CONTRACT_A if feed == "a" else landing.CONTRACT_B)
    row, place = F.struct(*contract, "query_area"), F.struct("ordinal", "page", "pos")
    first = typed.where("listing_id is not null").groupBy("listing_id").agg(F.min_by(row, place).alias("_row"))
    kept = first.select(*[F.col(f"_row.{c}").alias(c) for c in contract], F.col("_row.query_area").alias("query_area"))
    if city != "boston":
        return kept.withColumnRenamed("query_area", AREA[city])
    own = lookups.zip_to_neighborhood(spark).withColumnRenamed("zip", "zip_code")
    return kept.drop("query_area").join(own, "zip_code", "left").select(*contract, AREA[city])


def quarantine(pages: DataFrame, feed: str, city: str) -> DataFrame:
    """What landing would turn into NULL: (query_zip, page, pos, column_name, value).

    One row per value that does not fit its contract type, with its source position; a whole page that
    is no JSON of its feed is one row without position and column. ``pages`` come from
    ``parse_pages_strictly``.
    """
    broken = pages.where(F.col(BROKEN).isNotNull()).select(
        "query_zip", "page", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("column_name"),
        F.col(BROKEN).alias("value"))
    landed = landing.land_pages(pages.where(F.col(BROKEN).isNull()), feed, ("query_zip", "page"))
    contract = landing.CONTRACT_A if feed == "a" else landing.CONTRACT_B
    given, after = landing.normalize_listings(landed, feed, POSITION), landing.typed_columns(feed, city)
    cells = F.array(*[F.struct(
        F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value"), after[c].isNull().alias("lost")) for c in contract])
    lost = given.select(*POSITION, F.explode(cells).alias("c")).where("c.lost and trim(c.value) <> ''").select(
        *POSITION, "c.column_name", "c.value")
    return lost.unionByName(broken)


def parse_pages_strictly(df: DataFrame, body: str, feed: str) -> DataFrame:
    """As ``landing.parse_pages``; a body that is no page of the feed is kept in ``_broken``."""
    schema = f"{landing.FEEDS[feed]['page']}, {BROKEN} string"
    others = [c for c in df.columns if c != body]
    parsed = df.withColumn("_page", F.from_json(body, schema, {"columnNameOfCorruptRecord": BROKEN}))
    return parsed.select(*others, "_page.*")
