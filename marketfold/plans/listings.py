"""Rental listings: cleaning, matching two feeds, merging, filling, trimming, publishing."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import midpoint_float, midpoint_int, round_half_even_int, strip_non_numeric
from ..functions.text import AddressRules, LOOSE, STRICT, empty_as_key, listing_key, natural_key, row_name, split_address
from ..functions.times import refresh_stamp
from ..operators.joins import band_join, union_by_name, unmatched
from ..operators.quantiles import impute_group_median, trim_outliers
from ..operators.ranking import first_per_key
from ..operators.spatial import make_point, points_in_polygons
from ..sources.sinks import stage as write_once

Stage = Callable[[DataFrame, str], DataFrame]

# Match tolerances in degrees and dollars, and trim percentiles.
GEO_TOLERANCE = 0.0002
PRICE_TOLERANCE = 300
SQFT_FENCE = (0.05, 0.95)
UPPER_CAP = 0.95


def _rest(raw: DataFrame, first: str) -> list:
    """All columns as tie-breakers, so that the order is total."""
    return [F.asc_nulls_last(c) for c in [first, *sorted(set(raw.columns) - {first})]]


def clean_a(raw: DataFrame, rules: AddressRules, area: str, require_area: bool = False,
            nulls_newest: bool = False) -> DataFrame:
    """Newest usable record per id of the single-price feed, with street and unit keys.

    ``nulls_newest`` lets a record without a date win, as a descending sort in
    PostgreSQL would; by default a dated record is preferred.
    """
    required = ["listing_id", "zip_code", "url"] + ([area] if require_area else [])
    date = F.desc_nulls_first("list_date") if nulls_newest else F.desc_nulls_last("list_date")
    newest = first_per_key(raw.dropna(subset=required), ["listing_id"], [date, F.asc("url"), *_rest(raw, "list_price")])
    return split_address(newest, "address_line", rules).select(
        "listing_id", "list_price", "beds", strip_non_numeric(F.col("baths")).alias("baths"), "sqft", "zip_code", area,
        "address_line_1", "address_line_2", "latitude", "longitude", "url", "pet_cats", "pet_dogs", "list_date")


def clean_b(raw: DataFrame, rules: AddressRules, area: str, require_area: bool = False) -> DataFrame:
    """One record per id of the range feed, ranges reduced to their midpoint."""
    required = ["listing_id", "zip_code", "url"] + ([area] if require_area else [])
    one = first_per_key(raw.dropna(subset=required), ["listing_id"], [F.asc("url"), *_rest(raw, "price_min")])
    return split_address(one, "address_line", rules).select(
        "listing_id",
        midpoint_int(F.col("price_min"), F.col("price_max")).alias("price_avg"),
        midpoint_float(F.col("beds_min"), F.col("beds_max")).alias("beds_avg"),
        midpoint_float(F.col("baths_min"), F.col("baths_max")).alias("baths_avg"),
        midpoint_int(F.col("sqft_min"), F.col("sqft_max")).alias("sqft_avg"),
        "zip_code", area, "address_line_1", "address_line_2", "latitude", "longitude", "url")


def _b_named(b: DataFrame) -> DataFrame:
    """Feed B under names of its own."""
    return b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns])


def _in_band(left: DataFrame, right: DataFrame, geo_tol: float, price_tol: float) -> DataFrame:
    return band_join(
        left, right,
        equi={"zip_code": "b_zip_code", "address_line_1": "b_address_line_1", "unit": "b_unit"},
        bands={("latitude", "b_latitude"): geo_tol, ("longitude", "b_longitude"): geo_tol,
               ("list_price", "b_price_avg"): price_tol})


# What decides whether a listing matches and how well, and what a match takes from it besides.
A_PROFILE = ["zip_code", "address_line_1", "unit", "latitude", "longitude", "list_price"]
B_PROFILE = ["b_zip_code", "b_address_line_1", "b_unit", "b_latitude", "b_longitude", "b_price_avg"]
A_VALUES = ["beds", "baths", "sqft"]
B_VALUES = ["b_beds_avg", "b_baths_avg", "b_sqft_avg"]


@dataclass(frozen=True)
class Matches:
    """All matches of two feeds, in factors.

    Listings that agree in everything that matters to a match are one class. ``pairs`` has a row
    per pair of matching classes, with ``weight``, the number of pairs of listings it stands for,
    and the least url of its B class; ``a`` and ``b`` are the listings with their classes. n copies
    facing m copies are n + m rows and one pair until something asks for each of them.
    """

    pairs: DataFrame
    a: DataFrame
    b: DataFrame


def _class_name(columns: Sequence[str]) -> Column:
    return row_name(*[F.col(c) for c in columns])


def _classed(feed: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    """The listings with the key form of their unit and the name of their class, unless they have them.

    A name is 16 bytes: they sort by their first ones, where a struct is compared field by field.
    """
    if name in feed.columns:
        return feed
    known = feed.withColumn("unit", empty_as_key(F.col("address_line_2")))
    return known.withColumn(name, _class_name(columns))


def classed_a(a: DataFrame) -> DataFrame:
    return _classed(a, "a_class", A_PROFILE + A_VALUES)


def classed_b(b: DataFrame) -> DataFrame:
    return _classed(b, "class", [c.removeprefix("b_") for c in B_PROFILE + B_VALUES])


def factorise(a: DataFrame, b: DataFrame, geo_tol: float = GEO_TOLERANCE, price_tol: float = PRICE_TOLERANCE,
              stage: Stage = write_once) -> Matches:
    """Matches of the two feeds with equal ZIP, street and unit inside all tolerances."""
    left, right = classed_a(a), _b_named(classed_b(b))
    # Names are no part of the exchanges, which they would fill by a fifth; a pair has the values to name its classes.
    a_classes = left.groupBy(*A_PROFILE, *A_VALUES).agg(F.count("*").alias("times_a"))
    b_classes = right.groupBy(*B_PROFILE, *B_VALUES).agg(F.count("*").alias("times_b"), F.min("b_url").alias("b_url"))
    pairs = _in_band(a_classes, b_classes, geo_tol, price_tol).select(
        _class_name(A_PROFILE + A_VALUES).alias("a_class"), _class_name(B_PROFILE + B_VALUES).alias("b_class"),
        (F.col("times_a") * F.col("times_b")).alias("weight"), "zip_code", *_values_of_pair(), "b_url")
    return Matches(stage(pairs, "pairs"), left, right)


def _values_of_pair() -> list:
    """What a match shows: position and known sizes from B, the rest from A."""
    return [
        F.col("b_latitude").alias("latitude"), F.col("b_longitude").alias("longitude"), F.col("list_price").alias("rent"),
        F.coalesce("b_beds_avg", F.col("beds").cast("double")).alias("beds"),
        F.coalesce("b_baths_avg", F.col("baths").cast("double")).alias("baths"),
        F.coalesce("b_sqft_avg", "sqft").alias("sqft"),
        F.abs(F.col("list_price") - F.col("b_price_avg")).alias("price_gap")]


def match_listings(a: DataFrame, b: DataFrame, area: str, geo_tol: float = GEO_TOLERANCE,
                   price_tol: float = PRICE_TOLERANCE, matches: Matches | None = None) -> DataFrame:
    """Every pair of the two feeds with equal ZIP, street and unit inside all tolerances.

    Copies of one listing on both sides pair off with each other in full, which is what
    "every pair" means; ``Matches`` holds them in factors.
    """
    found = factorise(a, b, geo_tol, price_tol) if matches is None else matches
    every = found.pairs.select("a_class", "b_class").join(found.a, "a_class").join(found.b, "b_class")
    return every.select(
        listing_key(F.col("url")).alias("a_key"), listing_key(F.col("b_url")).alias("b_key"),
        "address_line_1", "address_line_2", "zip_code", area, *_values_of_pair(),
        "pet_cats", "pet_dogs", "list_date", F.col("url").alias("a_url"), F.col("b_url").alias("b_url"))


MERGED = ["listing_id", "zip_code", "latitude", "longitude", "rent", "beds", "baths", "sqft", "pet_cats", "pet_dogs",
          "list_date", "url", "price_gap", "match_url"]
COMPLETE = ["rent", "beds", "baths", "latitude", "longitude"]
FACTORS = ["weight", "a_class", "b_class"]


def left_over(a: DataFrame, b: DataFrame, matches: Matches) -> tuple[DataFrame, DataFrame]:
    """Listings of each feed whose url is in no match. Classes tell which ones are; no pair is made for it."""
    consumed = matches.a.join(matches.pairs.select("a_class"), "a_class", "left_semi").select("url")
    taken = matches.b.join(matches.pairs.select("b_class"), "b_class", "left_semi").select(F.col("b_url").alias("url"))
    return unmatched(a, consumed, ["url"]), unmatched(b, taken, ["url"])


def merge_listings(a: DataFrame, b: DataFrame, matches: Matches, area: str, stage: Stage = write_once) -> DataFrame:
    """Matched classes, A without a match, B without a match; incomplete rows dropped.

    Being matched is decided by url, so two ids that share one url are both consumed. Matches stay
    in factors: their rows have a weight and no listing until ``expand`` or ``best`` names it. Only the
    listings alone are written, as ``matches`` are already.
    """
    columns = [*MERGED[:2], area, *MERGED[2:]]
    a_left, b_left = left_over(a, b, matches)
    a_only = a_left.select(
        "zip_code", area, "latitude", "longitude",
        F.col("list_price").alias("rent"), F.col("beds").cast("double").alias("beds"),
        F.col("baths").cast("double").alias("baths"), "sqft", "pet_cats", "pet_dogs", "list_date", "url")
    b_only = b_left.select(
        "zip_code", area, "latitude", "longitude",
        F.col("price_avg").alias("rent"), F.col("beds_avg").alias("beds"), F.col("baths_avg").alias("baths"),
        F.col("sqft_avg").alias("sqft"), "url")
    alone = stage(union_by_name([a_only, b_only], fill_missing=True).dropna(subset=COMPLETE), "alone").withColumns(
        {"listing_id": listing_key(F.col("url")), "weight": F.lit(1).cast("long")})
    paired = matches.pairs.withColumnRenamed("b_url", "match_url")
    return paired.unionByName(alone, allowMissingColumns=True).select(*columns, *FACTORS).dropna(subset=COMPLETE)


def _with_listing(rows: DataFrame, members: DataFrame, area: str) -> DataFrame:
    """Rows of classes with each A listing of theirs."""
    of_listing = [area, "pet_cats", "pet_dogs", "list_date", "url"]
    return _with_key(rows.drop("listing_id", *of_listing).join(members.select("a_class", *of_listing), "a_class"))


def expand(folded: DataFrame, matches: Matches, area: str) -> DataFrame:
    """A row for every pair and every listing alone; ``folded`` may have been filled, trimmed or located."""
    columns = [c for c in folded.columns if c not in FACTORS]
    paired = folded.filter(F.col("a_class").isNotNull()).drop("match_url")
    urls = matches.b.select("b_class", F.col("b_url").alias("match_url"))
    every = _with_listing(paired, matches.a, area).join(urls, "b_class")
    return folded.filter(F.col("a_class").isNull()).select(*columns).unionByName(every.select(*columns))


def best(folded: DataFrame, matches: Matches, area: str) -> DataFrame:
    """A row for every A listing with a partner, the best of those still in ``folded``, and every listing alone.

    The best partner has the smallest price gap, then the smallest url. As it is chosen among
    rows that are still there, a listing is lost only if all its pairs are.
    """
    columns = [c for c in folded.columns if c not in FACTORS]
    paired = folded.filter(F.col("a_class").isNotNull())
    order = [F.asc_nulls_last(c) for c in ("price_gap", "match_url", "latitude", "longitude", "beds", "baths", "sqft")]
    chosen = _with_listing(first_per_key(paired, ["a_class"], order), matches.a, area)
    return folded.filter(F.col("a_class").isNull()).select(*columns).unionByName(chosen.select(*columns))


def _weight(df: DataFrame) -> str | None:
    return "weight" if "weight" in df.columns else None


def fill_sqft(merged: DataFrame) -> DataFrame:
    """Missing sizes filled with the median of their group, over all pairs."""
    return impute_group_median(merged, "sqft", ["zip_code", "beds", "baths"], "sqft_filled", weight=_weight(merged))


def trim_listings(filled: DataFrame) -> DataFrame:
    """Rows inside the cutoffs, which are taken over all pairs."""
    return trim_outliers(filled, {"sqft_filled": SQFT_FENCE}, {"rent": UPPER_CAP, "beds": UPPER_CAP, "baths": UPPER_CAP},
                         weight=_weight(filled))


def locate(trimmed: DataFrame, polygons: DataFrame, edges: str = "edges") -> DataFrame:
    """Listings with the attributes of the neighborhood polygon that holds them."""
    points = make_point(trimmed, "longitude", "latitude")
    named = polygons.select(
        F.col("boroname").alias("borough_name"), F.col("ntaname").alias("nta_name"),
        F.col("ntaabbrev").alias("nta_abbrev"), "nta2020", edges)
    return points_in_polygons(points, named, "point_lon", "point_lat", edges,
                              ["borough_name", "nta_name", "nta_abbrev", "nta2020"])


# The published column names and their types.
CONTRACT = {
    "Listing ID": "string", "City": "string", "Borough": "string", "NTA2020": "string", "ZIP Code": "string",
    "Neighborhood": "string", "Latitude": "float", "Longitude": "float", "Rent": "int", "Beds": "float",
    "Baths": "float", "SqFt": "int", "Cats Allowed": "boolean", "Dogs Allowed": "boolean", "List Date": "date",
    "URL": "string",
}


def _or_fail(df: DataFrame) -> DataFrame:
    """The same rows, one per listing id; evaluating a repeated id raises an error."""
    rest = [c for c in df.columns if c != "listing_id"]
    grouped = df.groupBy("listing_id").agg(
        F.count("*").alias("_copies"), F.any_value(F.struct(*rest)).alias("_row"))
    complaint = F.concat(
        F.lit("listing id "), F.col("listing_id"), F.lit(" occurs "), F.col("_copies"), F.lit(" times"))
    checked = F.when(F.col("_copies") > 1, F.raise_error(complaint).cast("string")).otherwise(F.col("listing_id"))
    return grouped.select(checked.alias("listing_id"), "_row.*")


def _with_key(df: DataFrame) -> DataFrame:
    return df.withColumn("listing_id", listing_key(F.col("url")))


def publish_city(df: DataFrame, city: str, areas: dict[str, str], on_duplicate: str = "error") -> DataFrame:
    """The sixteen-column contract of one city; areas without a column become NULL.

    A listing id must be unique. ``error`` makes the job fail on a repeated id, when the
    result is read or written; ``best`` keeps the pair with the smallest price gap, then
    the smallest url; ``keep`` publishes all rows. Without a ``listing_id``, it is the key of the url:
    then urls are compared, and their keys, twice as long, are made of what is left.
    """
    keyed = "listing_id" in df.columns
    if on_duplicate == "error":
        df = df if keyed else _with_key(df)
        df = _or_fail(df)
    elif on_duplicate == "best":
        rest = [c for c in df.columns if c not in ("listing_id", "price_gap", "match_url")]
        order = [F.asc_nulls_last("price_gap"), F.asc_nulls_last("match_url"), *[F.asc_nulls_last(c) for c in rest]]
        if keyed:
            df = first_per_key(df, ["listing_id"], order)
        else:  # urls begin alike: a hash before them
            df = first_per_key(df.withColumn("_hash", F.xxhash64("url")), ["_hash", "url"], order).drop("_hash")
    elif on_duplicate != "keep":
        raise ValueError(f"unknown on_duplicate: {on_duplicate}")
    df = df if "listing_id" in df.columns else _with_key(df)
    source = {
        "Listing ID": F.col("listing_id"), "City": F.lit(city), "ZIP Code": F.col("zip_code"),
        "Latitude": F.col("latitude"), "Longitude": F.col("longitude"), "Rent": F.col("rent"), "Beds": F.col("beds"),
        "Baths": F.col("baths"), "SqFt": round_half_even_int(F.col("sqft_filled")), "Cats Allowed": F.col("pet_cats"),
        "Dogs Allowed": F.col("pet_dogs"), "List Date": F.col("list_date"), "URL": F.col("url"),
    }
    for name in ("Borough", "NTA2020", "Neighborhood"):
        source[name] = F.col(areas[name]) if name in areas else F.lit(None)
    return df.filter(F.col("sqft_filled").isNotNull()).select(
        *[source[name].cast(kind).alias(name) for name, kind in CONTRACT.items()])


def clean_feeds(raw_a: DataFrame, raw_b: DataFrame, rules: AddressRules, area: str, require_area: bool,
                stage: Stage = write_once) -> tuple[DataFrame, DataFrame]:
    """One city's cleaned feeds with their classes.

    ``stage`` writes what is read again: cleaned feeds, matched classes and listings alone.
    Left lazy, those reads multiply into a dozen runs of the match, each from the raw feeds.
    """
    return (stage(classed_a(clean_a(raw_a, rules, area, require_area)), "clean_a"),
            stage(classed_b(clean_b(raw_b, rules, area, require_area)), "clean_b"))


def merge_feeds(raw_a: DataFrame, raw_b: DataFrame, rules: AddressRules, area: str, require_area: bool,
                stage: Stage = write_once) -> tuple[DataFrame, Matches]:
    """Clean, match and merge one city's feeds; matches stay in factors."""
    a, b = clean_feeds(raw_a, raw_b, rules, area, require_area, stage)
    matches = factorise(a, b, stage=stage)
    return merge_listings(a, b, matches, area, stage), matches


def _publish(folded: DataFrame, matches: Matches, area: str, city: str, areas: dict[str, str], on_duplicate: str) -> DataFrame:
    rows = best(folded, matches, area) if on_duplicate == "best" else expand(folded, matches, area)
    return publish_city(rows.drop("listing_id"), city, areas, on_duplicate)


def publish_boston(filled: DataFrame, matches: Matches, on_duplicate: str = "error") -> DataFrame:
    return _publish(trim_listings(filled), matches, "neighborhood", "Boston", {"Neighborhood": "neighborhood"}, on_duplicate)


def publish_new_york(filled: DataFrame, matches: Matches, polygons: DataFrame, on_duplicate: str = "error") -> DataFrame:
    areas = {"Borough": "borough", "NTA2020": "nta2020", "Neighborhood": "nta_name"}
    return _publish(locate(trim_listings(filled), polygons), matches, "borough", "New York City", areas, on_duplicate)


def boston(raw_a: DataFrame, raw_b: DataFrame, on_duplicate: str = "error", stage: Stage = write_once) -> DataFrame:
    """Published Boston listings; raw feeds carry a ``neighborhood``."""
    merged, matches = merge_feeds(raw_a, raw_b, STRICT, "neighborhood", True, stage)
    return publish_boston(fill_sqft(merged), matches, on_duplicate)


def new_york(raw_a: DataFrame, raw_b: DataFrame, polygons: DataFrame, on_duplicate: str = "error",
             stage: Stage = write_once) -> DataFrame:
    """Published New York listings; raw feeds carry a ``borough``, areas come from polygons."""
    merged, matches = merge_feeds(raw_a, raw_b, LOOSE, "borough", False, stage)
    return publish_new_york(fill_sqft(merged), matches, polygons, on_duplicate)


def publish_unified(cities: Sequence[DataFrame], refreshed_at: str | None = None) -> DataFrame:
    """All cities in one table with the refresh time, rounded to the second."""
    at = F.lit(refreshed_at) if refreshed_at is not None else F.current_timestamp()
    return union_by_name(list(cities)).withColumn("Last Updated", refresh_stamp(at))


GEOGRAPHY = {"city": "City", "borough": "Borough", "neighborhood": "Neighborhood", "zip_code": "ZIP Code",
             "nta2020": "NTA2020"}
UNIT = {"beds": "Beds", "baths": "Baths"}
PET_POLICY = {"cats_allowed": "Cats Allowed", "dogs_allowed": "Dogs Allowed"}


def star(listings: DataFrame) -> dict[str, DataFrame]:
    """Fact and dimensions. Keys are hashes of the natural key, so no join builds them."""
    def key(columns: dict[str, str]):
        return natural_key(*[F.col(f"`{c}`") for c in columns.values()])

    def dim(columns: dict[str, str], name: str) -> DataFrame:
        parts = listings.select(*[F.col(f"`{c}`").alias(out) for out, c in columns.items()]).distinct()
        return parts.select(natural_key(*[F.col(c) for c in columns]).alias(name), *columns)

    fact = listings.select(
        F.col("`Listing ID`").alias("listing_id"), key(GEOGRAPHY).alias("geography_key"), key(UNIT).alias("unit_key"),
        key(PET_POLICY).alias("pet_policy_key"), F.col("Rent").alias("rent"), F.col("SqFt").alias("sqft"),
        F.col("`List Date`").alias("list_date"), F.col("`Last Updated`").alias("last_updated"),
        F.col("Latitude").alias("latitude"), F.col("Longitude").alias("longitude"))
    return {"fact_listings": fact, "dim_geography": dim(GEOGRAPHY, "geography_key"),
            "dim_unit": dim(UNIT, "unit_key"), "dim_pet_policy": dim(PET_POLICY, "pet_policy_key")}
