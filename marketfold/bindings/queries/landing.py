"""Landed pages, record fields, cleaning functions and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.numbers import extract_number, strip_plus
from ...functions.text import sanitize_zip
from ...functions.times import coerce_date
from ...operators.joins import enrich_lookup, union_by_name
from ...sources import landing, lookups
from ...sources.boundaries import ATTRIBUTES, nta_attributes
from ..registry import STEPS, query

STEPS["x_landed_a"] = """
    select *, row_number() over (partition by query_zip, page order by ordinal) - 1 as pos from landed_a"""
STEPS["x_landed_b"] = """
    select *, row_number() over (partition by query_zip, page order by ordinal) - 1 as pos
    from landed_b join announced_b using (query_zip)"""


@query("land_pages_a", "query_zip varchar, page bigint, pos integer, listing_id varchar, list_price varchar, "
       "permalink varchar", "select query_zip, page, pos, listing_id, list_price, permalink from x_landed_a")
def land_pages_a(t):
    return t.landed("a").select("query_zip", "page", "pos", "record.listing_id", "record.list_price", "record.permalink")


@query("land_pages_b", "query_zip varchar, page bigint, total_result_count bigint, pos integer, rental_id varchar, "
       "url varchar", "select query_zip, page, total as total_result_count, pos, listing_id as rental_id, path as url "
       "from x_landed_b")
def land_pages_b(t):
    return t.landed("b").select(
        "query_zip", "page", "total_result_count", "pos", F.col("record.rentalExtension.rentalId").alias("rental_id"),
        F.col("record.homeData.url").alias("url"))


@query("landing_completeness", "query_zip varchar, fetched bigint, pages bigint, last_page_rows bigint, expected bigint, "
       "complete boolean", """
    select query_zip, sum(n) as fetched, count(*) as pages, arg_max(n, page) as last_page_rows, any_value(total) as expected,
           sum(n) >= any_value(total) as complete
    from (select query_zip, page, count(*) as n, any_value(total) as total from x_landed_b group by 1, 2
          union all select query_zip, page, 0, total from empty_b) as p
    group by query_zip""")
def landing_completeness(t):
    return landing.landing_completeness(t.all_pages("b"), "b", ["query_zip"], "page")


@query("landing_completeness_by_page", "query_zip varchar, fetched bigint, pages bigint, last_page_rows bigint, "
       "missing_pages bigint, complete boolean", """
    select query_zip, sum(n) as fetched, count(*) as pages, arg_max(n, page) as last_page_rows,
           max(page) - min(page) + 1 - count(*) as missing_pages,
           arg_max(n, page) < 20 and max(page) - min(page) + 1 = count(*) as complete
    from (select query_zip, page, count(*) as n from x_landed_a group by 1, 2
          union all select query_zip, page, 0 from empty_a) as p group by query_zip""")
def landing_completeness_by_page(t):
    return landing.landing_completeness(t.all_pages("a"), "a", ["query_zip"], "page", page_limit=20)


@query("landing_page_gaps", "query_zip varchar, first_missing bigint, last_missing bigint", """
    select query_zip, before + 1 as first_missing, page - 1 as last_missing
    from (select query_zip, page, lag(page) over (partition by query_zip order by page) as before
          from (select distinct query_zip, page from landed_a union select query_zip, page from empty_a) as d) as g
    where page > before + 1""")
def landing_page_gaps(t):
    return landing.page_gaps(t.all_pages("a"), ["query_zip"], "page")


@query("safe_get", "event_id bigint, k integer, missing varchar",
       "select event_id, cast(props->>'$.k' as integer) as k, cast(null as varchar) as missing from events")
def safe_get(t):
    parsed = t.table("events").withColumn("p", F.from_json("props", "k int, deep struct<level: struct<name: string>>"))
    return parsed.select("event_id", landing.safe_get("k", "p").alias("k"),
                         landing.safe_get("deep.level.name", "p").alias("missing"))


@query("normalize_a", "query_zip varchar, listing_id varchar, list_price varchar, beds varchar, baths varchar, "
       "sqft varchar, list_date varchar, zip_code varchar, latitude double, longitude double, address_line varchar, "
       "pet_cats boolean, pet_dogs boolean, url varchar", """
    select query_zip, listing_id, list_price, beds, baths, sqft, list_date, zip_code, latitude, longitude, address_line,
           pet_cats, pet_dogs, concat('https://www.realtor.com/rentals/details/', permalink) as url from landed_a""")
def normalize_a(t):
    return landing.normalize_listings(t.landed("a"), "a", ("query_zip",))


@query("normalize_b", "query_zip varchar, listing_id varchar, price_min varchar, price_max varchar, beds_min varchar, "
       "beds_max varchar, baths_min varchar, baths_max varchar, sqft_min varchar, sqft_max varchar, zip_code varchar, "
       "latitude double, longitude double, address_line varchar, url varchar", """
    select query_zip, listing_id, price_min, price_max, beds_min, beds_max, baths_min, baths_max, sqft_min, sqft_max,
           zip_code, latitude, longitude, address_line, concat('https://www.redfin.com', path) as url from landed_b""")
def normalize_b(t):
    return landing.normalize_listings(t.landed("b"), "b", ("query_zip",))


_NUMBER = "try_cast(nullif(regexp_extract({c}, '([0-9.]+)', 1), '') as double)"


@query("extract_number", "ordinal bigint, beds double, baths double",
       f"select ordinal, {_NUMBER.format(c='beds')} as beds, {_NUMBER.format(c='baths')} as baths from landed_a")
def extract_number_query(t):
    return t.input("landed_a").select(
        "ordinal", extract_number(F.col("beds")).alias("beds"), extract_number(F.col("baths")).alias("baths"))


@query("strip_plus", "ordinal bigint, baths double",
       "select ordinal, try_cast(trim(replace(baths, '+', '')) as double) as baths from landed_a")
def strip_plus_query(t):
    return t.input("landed_a").select("ordinal", strip_plus(F.col("baths")).alias("baths"))


@query("coerce_date", "ordinal bigint, list_date timestamp",
       "select ordinal, try_cast(list_date as timestamp) as list_date from landed_a")
def coerce_date_query(t):
    return t.input("landed_a").select("ordinal", coerce_date(F.col("list_date")).alias("list_date"))


@query("zip_to_neighborhood", "listing_id varchar, zip_code varchar, neighborhood varchar",
       "select listing_id, zip_code, neighborhood from bos_feed_a left join x_neighborhoods on zip = zip_code")
def zip_to_neighborhood(t):
    return t.feeds("boston")[0].select("listing_id", "zip_code", "neighborhood")


_QUERY_ZIP = "cast(10001 + (o_orderkey * 7) % 1700 as varchar(5))"


@query("zip_to_borough", "order_id bigint, query_zip varchar, borough_a varchar, borough_b varchar", f"""
    select o_orderkey as order_id, {_QUERY_ZIP} as query_zip, a.borough as borough_a, b.borough as borough_b
    from orders left join x_boroughs_a as a on a.zip = {_QUERY_ZIP} left join x_boroughs_b as b on b.zip = {_QUERY_ZIP}""")
def zip_to_borough(t):
    rows = t.table("orders").select(F.col("o_orderkey").alias("order_id"), F.expr(_QUERY_ZIP).alias("query_zip"))
    for feed in ("a", "b"):
        boroughs = lookups.zip_to_borough(t.spark, feed).withColumnRenamed("borough", f"borough_{feed}")
        rows = enrich_lookup(rows, boroughs, {"query_zip": "zip"}, [f"borough_{feed}"])
    return rows


@query("sanitize_zip", "ordinal bigint, zip_code varchar",
       "select ordinal, trim(substr(zip_code, 1, 5)) as zip_code from landed_b")
def sanitize_zip_query(t):
    return t.input("landed_b").select("ordinal", sanitize_zip(F.col("zip_code")).alias("zip_code"))


@query("dedupe_by_id_keep_first", "listing_id varchar, query_zip varchar, page bigint, pos integer", """
    select listing_id, query_zip, page, pos from x_landed_a where listing_id is not null
    qualify row_number() over (partition by listing_id order by query_zip, page, pos) = 1""")
def dedupe_by_id_keep_first(t):
    rows = t.landed("a").select("record.listing_id", "query_zip", "page", "pos")
    return landing.dedupe_by_id_keep_first(rows, "listing_id", ["query_zip", "page", "pos"])


@query("lenient_cast", "listing_id varchar, query_zip varchar, list_price integer, beds double, baths double, sqft integer, "
       "list_date date, zip_code varchar, latitude double, longitude double, address_line varchar, url varchar, "
       "pet_cats boolean, pet_dogs boolean", f"""
    select listing_id, query_zip, try_cast(list_price as integer) as list_price,
           cast({_NUMBER.format(c='beds')} as float) as beds, cast({_NUMBER.format(c='baths')} as float) as baths,
           try_cast(sqft as integer) as sqft, cast(try_cast(list_date as timestamp) as date) as list_date, zip_code,
           cast(latitude as float) as latitude, cast(longitude as float) as longitude, address_line,
           concat('https://www.realtor.com/rentals/details/', permalink) as url, pet_cats, pet_dogs from landed_a""")
def lenient_cast(t):
    return landing.typed_listings(t.landed("a"), "a", ("query_zip",), city="boston")


@query("lenient_cast_b", "listing_id varchar, query_zip varchar, price_min integer, price_max integer, beds_min double, "
       "beds_max double, baths_min double, baths_max double, sqft_min integer, sqft_max integer, zip_code varchar, "
       "latitude double, longitude double, address_line varchar, url varchar", """
    select listing_id, query_zip, try_cast(price_min as integer) as price_min, try_cast(price_max as integer) as price_max,
           try_cast(beds_min as float) as beds_min, try_cast(beds_max as float) as beds_max,
           try_cast(baths_min as float) as baths_min, try_cast(baths_max as float) as baths_max,
           try_cast(sqft_min as integer) as sqft_min, try_cast(sqft_max as integer) as sqft_max,
           trim(substr(zip_code, 1, 5)) as zip_code, cast(latitude as float) as latitude,
           cast(longitude as float) as longitude, address_line, concat('https://www.redfin.com', path) as url
    from landed_b""")
def lenient_cast_b(t):
    return landing.typed_listings(t.landed("b"), "b", ("query_zip",), city="new_york")


@query("nta_attributes", ", ".join(f"{c} {dict(int='integer', string='varchar').get(k, k)}" for c, k in ATTRIBUTES.items()),
       "select " + ", ".join(f"rtrim({c}) as {c}" if k == "string" else f"trim({c}) as {c}" for c, k in ATTRIBUTES.items())
       + " from boundary_text")
def nta_attributes_query(t):
    return nta_attributes(t.input("boundary_text"))


@query("union_zip_frames", "query_zip varchar, listing_id varchar, list_price varchar, price_min varchar", """
    select query_zip, listing_id, list_price, null as price_min from landed_a
    union all select query_zip, listing_id, null, price_min from landed_b""")
def union_zip_frames(t):
    a = t.landed("a").select("query_zip", "record.listing_id", "record.list_price")
    b = t.landed("b").select(
        F.col("record.rentalExtension.rentPriceRange.min").alias("price_min"), "query_zip",
        F.col("record.rentalExtension.rentalId").alias("listing_id"))
    return union_by_name([a, b], fill_missing=True)
