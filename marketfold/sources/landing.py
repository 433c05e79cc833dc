"""Landed JSON pages of the two listing feeds, and their flat, typed form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import extract_number, strip_plus
from ..functions.text import sanitize_zip
from ..functions.times import coerce_date
from ..operators.ranking import first_per_key
from ..operators.scan import scan

# The shape of a record of each feed.
# Fields that may hold text or a number ("2+", "Studio", 1.5) are read as text.
RECORD_A = (
    "struct<listing_id: string, list_price: string, list_date: string, permalink: string, "
    "description: struct<beds: string, baths_consolidated: string, sqft: string>, "
    "location: struct<address: struct<postal_code: string, line: string, "
    "coordinate: struct<lat: double, lon: double>>>, "
    "pet_policy: struct<cats: boolean, dogs: boolean>>")
_RANGE = "struct<min: string, max: string>"
RECORD_B = (
    "struct<homeData: struct<url: string, addressInfo: struct<zip: string, formattedStreetLine: string, "
    "centroid: struct<centroid: struct<latitude: double, longitude: double>>>>, "
    f"rentalExtension: struct<rentalId: string, rentPriceRange: {_RANGE}, bedRange: {_RANGE}, "
    f"bathRange: {_RANGE}, sqftRange: {_RANGE}>>")

# Per feed: the list inside a page, the page type and the expected-total field.
FEEDS = {
    "a": {"list": "properties", "page": f"properties array<{RECORD_A}>", "total": None},
    "b": {"list": "data", "page": f"totalResultCount long, data array<{RECORD_B}>",
          "total": "totalResultCount"},
}
# What the feeds put before a listing path, and the page size of feed A.
URL_PREFIX = {"a": "https://www.realtor.com/rentals/details/", "b": "https://www.redfin.com"}
PAGE_LIMIT = 200

# Where each column stands in a record of its feed, and the types of the contract.
FIELDS_A = {
    "listing_id": "listing_id",
    "list_price": "list_price",
    "beds": "description.beds",
    "baths": "description.baths_consolidated",
    "sqft": "description.sqft",
    "list_date": "list_date",
    "zip_code": "location.address.postal_code",
    "latitude": "location.address.coordinate.lat",
    "longitude": "location.address.coordinate.lon",
    "address_line": "location.address.line",
    "pet_cats": "pet_policy.cats",
    "pet_dogs": "pet_policy.dogs",
}
FIELDS_B = {
    "listing_id": "rentalExtension.rentalId",
    "price_min": "rentalExtension.rentPriceRange.min",
    "price_max": "rentalExtension.rentPriceRange.max",
    "beds_min": "rentalExtension.bedRange.min",
    "beds_max": "rentalExtension.bedRange.max",
    "baths_min": "rentalExtension.bathRange.min",
    "baths_max": "rentalExtension.bathRange.max",
    "sqft_min": "rentalExtension.sqftRange.min",
    "sqft_max": "rentalExtension.sqftRange.max",
    "zip_code": "homeData.addressInfo.zip",
    "latitude": "homeData.addressInfo.centroid.centroid.latitude",
    "longitude": "homeData.addressInfo.centroid.centroid.longitude",
    "address_line": "homeData.addressInfo.formattedStreetLine",
}
URL_PATH = {"a": "permalink", "b": "homeData.url"}

CONTRACT_A = {
    "listing_id": "string", "list_price": "int", "beds": "float", "baths": "float", "sqft": "int",
    "list_date": "date", "zip_code": "string", "latitude": "float", "longitude": "float",
    "address_line": "string", "url": "string", "pet_cats": "boolean", "pet_dogs": "boolean",
}
CONTRACT_B = {
    "listing_id": "string", "price_min": "int", "price_max": "int", "beds_min": "float", "beds_max": "float",
    "baths_min": "float", "baths_max": "float", "sqft_min": "int", "sqft_max": "int", "zip_code": "string",
    "latitude": "float", "longitude": "float", "address_line": "string", "url": "string",
}


def safe_get(path: str, under: str | None = None) -> Column:
    """Nested field of any depth; NULL as soon as a level is missing or NULL."""
    return F.col(f"{under}.{path}" if under else path)


def pick(df: DataFrame, fields: dict[str, str], under: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *[safe_get(path, under).alias(out) for out, path in fields.items()])


def read_pages(spark: SparkSession, path: str, feed: str, one_page_per_line: bool = True) -> DataFrame:
    """Landed page files with the page schema.

    Line-delimited files are splittable; pages stored one per file need
    ``one_page_per_line=False``. Partition directories such as ``query_zip=…/page=…``
    become columns.
    """
    reader = spark.read.schema(FEEDS[feed]["page"])
    return reader.option("multiLine", not one_page_per_line).json(path)


def parse_pages(df: DataFrame, body: str, feed: str) -> DataFrame:
    """Pages held as JSON text in column ``body``; all other columns are kept."""
    others = [c for c in df.columns if c != body]
    return df.withColumn("_page", F.from_json(body, FEEDS[feed]["page"])).select(*others, "_page.*")


def land_pages(pages: DataFrame, feed: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per listing with its position; a missing or empty list gives no row."""
    total = FEEDS[feed]["total"]
    extra = [F.col(total).alias("total_result_count")] if total else []
    return pages.select(*keep, *extra, F.posexplode(FEEDS[feed]["list"]).alias("pos", "record"))


def normalize_listings(landed: DataFrame, feed: str, keep: tuple[str, ...] = (), record: str = "record",
                       url_prefix: str | None = None) -> DataFrame:
    """Nested records to flat columns, still untyped where the feed mixes types."""
    fields = FIELDS_A if feed == "a" else FIELDS_B
    prefix = URL_PREFIX[feed] if url_prefix is None else url_prefix
    flat = pick(landed.withColumn("_path", safe_get(URL_PATH[feed], record)), fields, record, (*keep, "_path"))
    return flat.withColumn("url", F.concat(F.lit(prefix), F.coalesce("_path", F.lit("")))).drop("_path")


def lenient_cast(df: DataFrame, schema: dict[str, str]) -> DataFrame:
    """Cast to the contract; a value that does not fit becomes NULL, other columns stay."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c, kind in schema.items() if c in df.columns})


def dedupe_by_id_keep_first(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """First row per id in fetch order. Rows without an id are kept out (see cleaning)."""
    return first_per_key(df.filter(F.col(key).isNotNull()), [key], [F.col(c).asc_nulls_last() for c in order])


def landing_completeness(pages: DataFrame, feed: str, group: list[str], page: str | None = None,
                         page_limit: int = PAGE_LIMIT) -> DataFrame:
    """Rows fetched per group and whether the fetch ended where it should.

    Works on pages, so empty ones count: a missing or empty list is a page of 0 rows. Where
    the feed announces a total (feed B), a group is complete once it holds the total of its
    first page. Otherwise (feed A) its last page must be shorter than the limit, and no page
    number between its first and its last one may be missing. A NULL page number comes before
    all others.
    """
    held, total = F.col(FEEDS[feed]["list"]), FEEDS[feed]["total"]
    number = F.coalesce(F.col(page), F.lit(-1)) if page else F.lit(1)
    per_page = pages.groupBy(*group, number.alias("_page")).agg(
        F.sum(F.coalesce(F.when(held.isNotNull(), F.size(held)), F.lit(0))).alias("_rows"),
        *([F.max(total).alias("_expected")] if total else []))
    out = per_page.groupBy(*group).agg(
        F.sum("_rows").alias("fetched"), F.count("*").alias("pages"),
        F.max_by("_rows", "_page").alias("last_page_rows"),
        (F.max("_page") - F.min(F.when(F.col("_page") >= 0, F.col("_page"))) + 1
         - F.count(F.when(F.col("_page") >= 0, 1))).alias("missing_pages"),
        *([F.min_by("_expected", "_page").alias("expected")] if total else []))
    if total:
        return out.drop("missing_pages").withColumn("complete", F.col("fetched") >= F.col("expected"))
    whole = F.coalesce("missing_pages", F.lit(0)) == 0
    return out.withColumns({"missing_pages": F.coalesce("missing_pages", F.lit(0)).cast("long"),
                            "complete": (F.col("last_page_rows") < page_limit) & whole})


def page_gaps(pages: DataFrame, group: list[str], page: str) -> DataFrame:
    """Runs of missing page numbers: (group, first_missing, last_missing), by a segmented scan."""
    numbers = pages.where(F.col(page).isNotNull()).select(*group, page).distinct()
    after = scan(numbers, group, [page], previous={"_before": page})
    return after.where(F.col(page) > F.col("_before") + 1).select(
        *group, (F.col("_before") + 1).alias("first_missing"), (F.col(page) - 1).alias("last_missing"))


def typed_listings(landed: DataFrame, feed: str, keep: tuple[str, ...] = (), city: str = "boston",
                   url_prefix: str | None = None) -> DataFrame:
    """Landed records to the contract types of their feed.

    The cities clean different fields: Boston takes the first number out of beds and
    baths, New York strips the plus sign of baths and shortens feed B ZIP codes.
    """
    flat = normalize_listings(landed, feed, keep, url_prefix=url_prefix)
    return flat.withColumns(typed_columns(feed, city))


def typed_columns(feed: str, city: str) -> dict[str, Column]:
    """The contract columns of a feed, cleaned as the city does; what does not fit becomes NULL."""
    contract = CONTRACT_A if feed == "a" else CONTRACT_B
    cleaned = {c: F.col(c) for c in contract}
    if feed == "a":
        cleaned["list_date"] = coerce_date(F.col("list_date"))
        if city == "boston":
            cleaned |= {"beds": extract_number(F.col("beds")), "baths": extract_number(F.col("baths"))}
        else:
            cleaned["baths"] = strip_plus(F.col("baths"))
    elif city != "boston":
        cleaned["zip_code"] = sanitize_zip(F.col("zip_code"))
    return {c: cleaned[c].try_cast(kind) for c, kind in contract.items()}
