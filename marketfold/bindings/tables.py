"""Lazy access to test tables and to everything derived from them."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import enrich_lookup
from ..plans import commerce, listings
from ..plans.staging import SOURCE_OF, staging
from ..session import prepare
from ..sources import ingest, landing, lookups
from ..sources.boundaries import boundary_polygons
from ..sources.sinks import stage
from .inputs import STATEMENTS, TABLES

REFRESHED_AT = "2025-12-08 09:30:00.6"


class _Lazy(dict):
    """Builds an entry the first time it is asked for."""

    def __init__(self, build):
        super().__init__()
        self._build = build

    def __missing__(self, name: str) -> DataFrame:
        self[name] = self._build(name)
        return self[name]


class Tables:
    """Plans over one directory, and the steps already written for it."""

    _shared: dict[tuple[str, str], Tables] = {}

    def __init__(self, spark: SparkSession, root: str):
        self.spark = prepare(spark)
        self.root = root.rstrip("/")
        self._written: dict[str, DataFrame] = {}

    @classmethod
    def shared(cls, spark: SparkSession, root: str) -> Tables:
        """One instance per application and directory."""
        key = (spark.sparkContext.applicationId, root)
        if key not in cls._shared:
            cls._shared[key] = cls(spark, root)
        return cls._shared[key]

    @classmethod
    def forget(cls) -> None:
        """Drop shared instances, so that the next query computes every step again."""
        cls._shared.clear()

    @cached_property
    def _sources(self) -> _Lazy:
        return _Lazy(lambda name: self.spark.read.parquet(f"{self.root}/{name}.parquet"))

    def table(self, name: str) -> DataFrame:
        return self._sources[name]

    def sql(self, statement: str, **frames: DataFrame) -> DataFrame:
        used = {n: self.table(n) for n in TABLES if f"{{{n}}}" in statement}
        return self.spark.sql(statement, **used, **frames)

    def input(self, name: str) -> DataFrame:
        return self.sql(STATEMENTS[name])

    # commerce
    @cached_property
    def raw(self) -> _Lazy:
        return _Lazy(self.input)

    @cached_property
    def stg(self) -> _Lazy:
        return _Lazy(lambda name: staging(self.raw[SOURCE_OF[name]], name))

    @cached_property
    def values(self) -> DataFrame:
        return commerce.order_values(self.stg["stg_orders"], self.stg["stg_order_items"])

    @cached_property
    def model(self) -> _Lazy:
        return _Lazy(self._model)

    def built(self, name: str) -> DataFrame:
        """A model as a table would hold it: intermediate steps are written once."""
        if name.startswith("stg_"):
            return self.stg[name]
        if name.startswith("int_"):
            return self._once(name, lambda: stage(self.model[name], name))
        return self.model[name]

    def _step(self, name: str) -> DataFrame:
        """A model as another one reads it: the written step where there is one."""
        return self._written[name] if name in self._written else self.model[name]

    def _model(self, name: str) -> DataFrame:
        s, step = self.stg, self._step
        return {
            "int_order_reviews_one_row": lambda: commerce.order_reviews_one_row(s["stg_order_reviews"]),
            "int_orders_experience": lambda: commerce.orders_experience(
                s["stg_orders"], step("int_order_reviews_one_row")),
            "int_order_items_enriched": lambda: commerce.order_items_enriched(
                s["stg_order_items"], s["stg_orders"], s["stg_customers"], s["stg_sellers"], s["stg_products"],
                s["stg_category_translation"]),
            "int_customer_order_sequence": lambda: commerce.customer_order_sequence(
                s["stg_orders"], s["stg_customers"]),
            "fct_order_financials": lambda: commerce.order_financials(
                s["stg_orders"], s["stg_order_items"], s["stg_order_payments"]),
            "mart_kpis_weekly": lambda: commerce.kpis_weekly(self.values),
            "mart_category_weekly": lambda: commerce.category_weekly(
                s["stg_orders"], s["stg_order_items"], s["stg_products"], s["stg_category_translation"]),
            "mart_geo_state_flows_weekly": lambda: commerce.state_flows_weekly(
                step("int_order_items_enriched"), step("int_orders_experience")),
            "mart_new_vs_returning_weekly": lambda: commerce.new_vs_returning_weekly(
                commerce.identified_orders(s["stg_orders"], s["stg_customers"]), self.values),
            "mart_experience_retention_90d": lambda: commerce.experience_retention(
                commerce.customer_first_orders(s["stg_orders"], s["stg_customers"]), step("int_orders_experience")),
            "mart_cohort_ltv_monthly": lambda: commerce.cohort_ltv_monthly(
                s["stg_orders"], s["stg_customers"], self.values),
        }[name]()

    # listings
    def feeds(self, city: str) -> tuple[DataFrame, DataFrame]:
        """Raw feeds A and B of a city with the area label of their ZIP."""
        if city == "boston":
            names = lookups.zip_to_neighborhood(self.spark)
            return tuple(enrich_lookup(self.input(n), names, {"zip_code": "zip"}, ["neighborhood"])
                         for n in ("bos_feed_a", "bos_feed_b"))
        return (
            enrich_lookup(self.input("ny_feed_a"), lookups.zip_to_borough(self.spark, "a"), {"zip_code": "zip"},
                          ["borough"]),
            enrich_lookup(self.input("ny_feed_b"), lookups.zip_to_borough(self.spark, "b"), {"zip_code": "zip"},
                          ["borough"]))

    def clean(self, city: str) -> tuple[DataFrame, DataFrame]:
        a, b = self.feeds(city)
        if city == "boston":
            return (listings.clean_a(a, listings.STRICT, "neighborhood", True),
                    listings.clean_b(b, listings.STRICT, "neighborhood", True))
        return listings.clean_a(a, listings.LOOSE, "borough"), listings.clean_b(b, listings.LOOSE, "borough")

    # The cleaned feeds, matches, listings alone, medians and the unified table are written once and then
    # read, as a weekly refresh would do, however many queries follow.
    def cleaned(self, city: str) -> tuple[DataFrame, DataFrame]:
        """Cleaned feeds with their classes."""
        return self._once(f"cleaned-{city}", lambda: self._clean(city))

    def matched(self, city: str) -> tuple[DataFrame, DataFrame, listings.Matches]:
        """Cleaned feeds with their classes, and the matches in factors."""
        return self._once(f"matched-{city}", lambda: self._match(city))

    def merged(self, city: str) -> tuple[DataFrame, listings.Matches]:
        """Merged rows with matches in factors, and the factors."""
        return self._once(f"merged-{city}", lambda: self._merge(city))

    def filled(self, city: str) -> tuple[DataFrame, listings.Matches]:
        merged, matches = self.merged(city)
        return self._once(f"filled-{city}", lambda: listings.fill_sqft(merged)), matches

    def unified(self) -> DataFrame:
        return self._once("unified", lambda: listings.publish_unified(self.both_cities(), REFRESHED_AT))

    def both_cities(self) -> list[DataFrame]:
        """The published cities, written. They are cleaned and merged at the same time, but matched and published
        in turn: those steps shuffle most, and what they shuffle is gone when they end."""
        cities = ["boston", "new_york"]
        with ThreadPoolExecutor(len(cities)) as pool:
            list(pool.map(self.cleaned, cities))
            for city in cities:
                self.matched(city)
            list(pool.map(self.filled, cities))
        return [self._once(f"published-{c}", lambda c=c: stage(self.published(c), "listings")) for c in cities]

    def _once(self, name: str, build) -> DataFrame:
        if name not in self._written:
            self._written[name] = build()
        return self._written[name]

    def _clean(self, city: str) -> tuple[DataFrame, DataFrame]:
        a, b = self.feeds(city)
        if city == "boston":
            return listings.clean_feeds(a, b, listings.STRICT, "neighborhood", True)
        return listings.clean_feeds(a, b, listings.LOOSE, "borough", False)

    def _match(self, city: str) -> tuple[DataFrame, DataFrame, listings.Matches]:
        a, b = self.cleaned(city)
        return a, b, listings.factorise(a, b)

    def _merge(self, city: str) -> tuple[DataFrame, listings.Matches]:
        a, b, matches = self.matched(city)
        return listings.merge_listings(a, b, matches, ingest.AREA[city]), matches

    def every_pair(self, step, city: str = "new_york") -> DataFrame:
        """``step`` of a city's filled rows, with every pair."""
        filled, matches = self.filled(city)
        return listings.expand(step(filled), matches, ingest.AREA[city])

    @cached_property
    def polygons(self) -> DataFrame:
        """Neighborhood areas from projected vertices and padded attributes, assembled once."""
        return self._once("polygons", lambda: stage(
            boundary_polygons(self.input("area_text"), self.input("area_vertices")), "polygons"))

    def published(self, city: str) -> DataFrame:
        if city == "boston":
            return listings.publish_boston(*self.filled(city), "best")
        return listings.publish_new_york(*self.filled(city), self.polygons, "best")

    # landed pages
    def pages(self, feed: str) -> DataFrame:
        """(query_zip, page, body): records nested and packed into JSON pages."""
        pages = self._packed(f"landed_{feed}", feed)
        if feed == "a":
            return pages.select("query_zip", "page", F.to_json(F.struct(F.col("items").alias("properties"))).alias("body"))
        total = self.input("announced_b")
        return pages.join(total, "query_zip").select("query_zip", "page", F.to_json(F.struct(
            F.col("total").alias("totalResultCount"), F.col("items").alias("data"))).alias("body"))

    def _packed(self, name: str, feed: str) -> DataFrame:
        """(query_zip, page, items): the records of each page in order."""
        record = _record_a() if feed == "a" else _record_b()
        packed = self.input(name).select("query_zip", "page", F.struct("ordinal", record.alias("record")).alias("r"))
        ordered = F.transform(F.array_sort(F.collect_list("r")), lambda r: r["record"])
        return packed.groupBy("query_zip", "page").agg(ordered.alias("items"))

    def fetched(self, city: str, feed: str) -> DataFrame:
        """Parsed pages of a city's fetch."""
        items = F.struct(F.col("items").alias(landing.FEEDS[feed]["list"]))
        bodies = self._packed(f"fetched_{city}_{feed}", feed).select("query_zip", "page", F.to_json(items).alias("body"))
        return landing.parse_pages(bodies, "body", feed)

    def ingested(self, city: str, feed: str) -> DataFrame:
        return self._once(f"ingested-{city}-{feed}", lambda: stage(ingest.ingest(self.fetched(city, feed), feed, city), "ingested"))

    def published_from_pages(self) -> DataFrame:
        """New York listings, all the way from its pages."""
        return listings.new_york(self.ingested("new_york", "a"), self.ingested("new_york", "b"), self.polygons, "best")

    def suspicious_pages(self, feed: str) -> DataFrame:
        """Pages parsed strictly, broken bodies among them."""
        bodies = self.pages(feed).unionByName(self.input("broken_pages"))
        return ingest.parse_pages_strictly(bodies, "body", feed)

    def all_pages(self, feed: str) -> DataFrame:
        """Parsed pages, empty ones among them."""
        empty = self.input(f"empty_{feed}")
        body = F.struct(F.col("total").alias("totalResultCount")) if feed == "b" else F.struct(F.array().cast("array<string>").alias("properties"))
        bodies = self.pages(feed).unionByName(empty.select("query_zip", "page", F.to_json(body).alias("body")))
        return landing.parse_pages(bodies, "body", feed)

    def landed(self, feed: str) -> DataFrame:
        parsed = landing.parse_pages(self.pages(feed), "body", feed)
        return landing.land_pages(parsed, feed, ("query_zip", "page"))


def _record_a():
    c = F.col
    coordinate = F.when(c("latitude").isNotNull(), F.struct(c("latitude").alias("lat"), c("longitude").alias("lon")))
    address = F.when(c("address_line").isNotNull(), F.struct(
        c("zip_code").alias("postal_code"), c("address_line").alias("line"), coordinate.alias("coordinate")))
    description = F.when(c("beds").isNotNull(), F.struct(
        c("beds"), c("baths").alias("baths_consolidated"), c("sqft")))
    pets = F.when(c("pet_dogs").isNotNull(), F.struct(c("pet_cats").alias("cats"), c("pet_dogs").alias("dogs")))
    return F.struct(
        "listing_id", c("list_price").cast("int").alias("list_price"), "list_date", "permalink",
        description.alias("description"), F.struct(address.alias("address")).alias("location"), pets.alias("pet_policy"))


def _record_b():
    c = F.col

    def span(name):
        return F.struct(c(f"{name}_min").alias("min"), c(f"{name}_max").alias("max"))

    info = F.when(c("address_line").isNotNull(), F.struct(
        c("zip_code").alias("zip"), c("address_line").alias("formattedStreetLine"),
        F.struct(F.struct("latitude", "longitude").alias("centroid")).alias("centroid")))
    return F.struct(
        F.struct(c("path").alias("url"), info.alias("addressInfo")).alias("homeData"),
        F.struct(c("listing_id").alias("rentalId"), span("price").alias("rentPriceRange"), span("beds").alias("bedRange"),
                 span("baths").alias("bathRange"), span("sqft").alias("sqftRange")).alias("rentalExtension"))
