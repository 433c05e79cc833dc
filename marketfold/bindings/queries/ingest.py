"""From pages to the contract of each city, to published listings, and to the quarantine."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...sources import ingest, landing, lookups
from ..registry import STEPS, query
from .listings import CONTRACT, LOCATED, clean_steps, publish_sql

_NUMBER = "cast(try_cast(nullif(regexp_extract({c}, '([0-9.]+)', 1), '') as double) as float)"
_PLAIN = "try_cast({c} as {kind})"
_KINDS = {"int": "integer", "string": "varchar"}


def _typed_sql(feed: str, city: str) -> dict[str, str]:
    """Each contract column from its text, in the checking dialect."""
    contract = landing.CONTRACT_A if feed == "a" else landing.CONTRACT_B
    typed = {c: _PLAIN.format(c=c, kind=_KINDS.get(kind, kind)) for c, kind in contract.items()}
    typed["url"] = f"concat('{landing.URL_PREFIX[feed]}', {'permalink' if feed == 'a' else 'path'})"
    if feed == "a":
        typed["list_date"] = "cast(try_cast(list_date as timestamp) as date)"
        typed["baths"] = "cast(try_cast(trim(replace(baths, '+', '')) as double) as float)"
        if city == "boston":
            typed |= {c: _NUMBER.format(c=c) for c in ("beds", "baths")}
    elif city != "boston":
        typed["zip_code"] = "trim(substr(zip_code, 1, 5))"
    return typed


def _plan_values(city: str, feed: str) -> str:
    return ", ".join(f"('{z}', '{area}', {i})" for z, area, i in lookups.plan_rows(city, feed))


for _city, _area in ingest.AREA.items():
    for _feed in ("a", "b"):
        _columns = ", ".join(f"{sql} as {c}" for c, sql in _typed_sql(_feed, _city).items())
        _name = f"x_ingest_{_city}_{_feed}"
        STEPS[f"{_name}_plan"] = f"select * from (values {_plan_values(_city, _feed)}) as v(query_zip, query_area, place)"
        STEPS[f"{_name}_first"] = f"""
            select {_columns}, query_area from fetched_{_city}_{_feed} join {_name}_plan using (query_zip)
            where listing_id is not null
            qualify row_number() over (partition by listing_id order by place, page, ordinal) = 1"""
        STEPS[_name] = (f"select * exclude (query_area), query_area as borough from {_name}_first" if _city == "new_york" else
                        f"select f.* exclude (query_area), neighborhood from {_name}_first as f left join x_neighborhoods on zip = zip_code")

_A = ("listing_id varchar, list_price integer, beds double, baths double, sqft integer, list_date date, zip_code varchar, "
      "latitude double, longitude double, address_line varchar, url varchar, pet_cats boolean, pet_dogs boolean")
_B = ("listing_id varchar, price_min integer, price_max integer, beds_min double, beds_max double, baths_min double, "
      "baths_max double, sqft_min integer, sqft_max integer, zip_code varchar, latitude double, longitude double, "
      "address_line varchar, url varchar")


@query("ingest_boston_a", _A + ", neighborhood varchar", "select * from x_ingest_boston_a")
def ingest_boston_a(t):
    return t.ingested("boston", "a")


@query("ingest_boston_b", _B + ", neighborhood varchar", "select * from x_ingest_boston_b")
def ingest_boston_b(t):
    return t.ingested("boston", "b")


@query("ingest_new_york_a", _A + ", borough varchar", "select * from x_ingest_new_york_a")
def ingest_new_york_a(t):
    return t.ingested("new_york", "a")


@query("ingest_new_york_b", _B + ", borough varchar", "select * from x_ingest_new_york_b")
def ingest_new_york_b(t):
    return t.ingested("new_york", "b")


clean_steps("in", "borough", "x_ingest_new_york_a", "x_ingest_new_york_b", False, "")
STEPS["x_in_located"] = LOCATED.format(trimmed="x_in_trimmed")
STEPS["x_in_final"] = publish_sql("New York City", "x_in_located", "borough", "nta2020", "nta_name")


@query("publish_from_pages", CONTRACT, "select * from x_in_final")
def publish_from_pages(t):
    return t.published_from_pages()


def _lost_sql(feed: str, city: str) -> str:
    """Values that their contract column cannot take."""
    typed = _typed_sql(feed, city)
    parts = [f"select query_zip, page, pos, '{c}' as column_name, cast({c} as varchar) as value from x_landed_{feed} "
             f"where {typed[c]} is null and trim(cast({c} as varchar)) <> ''" for c in typed if c != "url"]
    return " union all ".join(parts)


_LOST = "query_zip varchar, page bigint, pos integer, column_name varchar, value varchar"


@query("landing_quarantine", _LOST, f"""
    select * from ({_lost_sql('a', 'new_york')}) as l
    union all select query_zip, page, null, null, body from broken_pages where body is not null""")
def landing_quarantine(t):
    return ingest.quarantine(t.suspicious_pages("a"), "a", "new_york")


@query("landing_quarantine_b", _LOST, f"""
    select * from ({_lost_sql('b', 'new_york')}) as l
    union all select query_zip, page, null, null, body from broken_pages where body is not null""")
def landing_quarantine_b(t):
    return ingest.quarantine(t.suspicious_pages("b"), "b", "new_york")


@query("landing_balance", "column_name varchar, landed bigint, good bigint, rejected bigint", " union all ".join(f"""
    select '{c}' as column_name, count(nullif(trim({c}), '')) as landed, count(nullif(trim({c}), '')) - count(lost) as good,
           count(lost) as rejected
    from (select {c}, case when {sql} is null and trim({c}) <> '' then 1 end as lost from landed_a) as l"""
    for c, sql in _typed_sql("a", "new_york").items() if c in ("list_price", "beds", "baths", "sqft", "list_date")))
def landing_balance(t):
    """Per column: filled values landed, kept by the typed rows, and in quarantine."""
    columns = ["list_price", "beds", "baths", "sqft", "list_date"]
    pages = t.suspicious_pages("a")
    landed = landing.land_pages(pages.where(F.col(ingest.BROKEN).isNull()), "a", ("query_zip", "page"))
    def tall(df, name):
        counts = df.agg(*[F.count(F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))).alias(c) for c in columns])
        return counts.select(F.explode(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(c))])).alias("column_name", name))
    rejected = ingest.quarantine(pages, "a", "new_york").groupBy("column_name").agg(F.count("*").alias("rejected"))
    counts = tall(landing.normalize_listings(landed, "a"), "landed").join(
        tall(landing.typed_listings(landed, "a", city="new_york"), "good"), "column_name")
    return counts.join(rejected, "column_name", "left").withColumn("rejected", F.coalesce("rejected", F.lit(0)))
