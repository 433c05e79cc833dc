"""Listing cleaning, matching, publishing and the questions asked of the result."""

from __future__ import annotations

from pyspark.sql import functions as F

from ...functions.text import LOOSE, STRICT, register_split_address, split_address
from ...operators.spatial import make_point, points_in_polygons, reproject_vertices
from ...plans import insights, listings
from ...sources import lookups
from ..registry import STEPS, money, query
from ..tables import REFRESHED_AT


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" for v in row) + ")" for row in rows)


STEPS["x_neighborhoods"] = f"select * from (values {_values(lookups.neighborhood_rows())}) as v(zip, neighborhood)"
STEPS["x_boroughs_a"] = f"select * from (values {_values(lookups.borough_rows('a'))}) as v(zip, borough)"
STEPS["x_boroughs_b"] = f"select * from (values {_values(lookups.borough_rows('b'))}) as v(zip, borough)"


def split_sql(column: str, strict: bool) -> tuple[str, str]:
    """Street and unit of an address in the checking dialect."""
    gap = " " if strict else ""
    at = (f"coalesce(case when strpos({column}, 'Unit{gap}') > 0 then strpos({column}, 'Unit') end, "
          f"case when strpos({column}, 'Apt{gap}') > 0 then strpos({column}, 'Apt') end, "
          + ", ".join(f"nullif(strpos({column}, '{m}'), 0)" for m in ("Ste ", "Ph ", "Fl ", "#")) + ")")
    kept = r"[^a-zA-Z0-9\s.'']" if strict else r"[^a-zA-Z0-9\s]"
    return (f"lower(trim(regexp_replace(case when {at} is null then {column} else left({column}, ({at} - 1)::int) end, "
            f"'{kept}', '', 'g')))",
            f"lower(trim(regexp_replace(substr({column}, {at}), '(^|\\s)(Apt|Unit|Ste|Ph|Fl|#)\\s*', '', 'gi')))")


def clean_steps(city: str, area: str, source_a: str, source_b: str, strict: bool, required: str) -> None:
    street, unit = split_sql("address_line", strict)
    STEPS[f"x_{city}_a"] = f"""
        select listing_id, list_price, beds,
               cast(nullif(regexp_replace(cast(baths as varchar), '[^0-9.]', '', 'g'), '') as float) as baths, sqft,
               zip_code, {area}, {street} as address_line_1, {unit} as address_line_2, latitude, longitude, url,
               pet_cats, pet_dogs, list_date
        from {source_a}
        where listing_id is not null and zip_code is not null and url is not null {required}
        qualify row_number() over (partition by listing_id order by list_date desc nulls last, url) = 1"""
    STEPS[f"x_{city}_b"] = f"""
        select listing_id, (price_min + price_max) // 2 as price_avg,
               cast(beds_min + beds_max as double) / 2 as beds_avg, cast(baths_min + baths_max as double) / 2 as baths_avg,
               (sqft_min + sqft_max) // 2 as sqft_avg, zip_code, {area}, {street} as address_line_1,
               {unit} as address_line_2, latitude, longitude, url
        from {source_b}
        where listing_id is not null and zip_code is not null and url is not null {required}
        qualify row_number() over (partition by listing_id order by url) = 1"""
    STEPS[f"x_{city}_pairs"] = f"""
        select md5(a.url) as a_key, md5(b.url) as b_key, a.address_line_1, a.address_line_2, a.zip_code, a.{area},
               b.latitude, b.longitude, list_price as rent, coalesce(beds_avg, cast(beds as double)) as beds,
               coalesce(baths_avg, cast(baths as double)) as baths, coalesce(sqft_avg, sqft) as sqft, pet_cats, pet_dogs,
               list_date, a.url as a_url, b.url as b_url, abs(list_price - price_avg) as price_gap
        from x_{city}_a as a join x_{city}_b as b
          on a.zip_code = b.zip_code and a.address_line_1 = b.address_line_1
         and coalesce(a.address_line_2, '') = coalesce(b.address_line_2, '')
         and cast(abs(a.latitude - b.latitude) as double) <= cast(0.0002 as double)
         and cast(abs(a.longitude - b.longitude) as double) <= cast(0.0002 as double)
         and abs(list_price - price_avg) <= 300"""
    STEPS[f"x_{city}_merged"] = f"""
        select * from (
            select a_key as listing_id, zip_code, {area}, latitude, longitude, rent, beds, baths, sqft, pet_cats, pet_dogs,
                   list_date, a_url as url, price_gap, b_url as match_url from x_{city}_pairs
            union all
            select md5(url), zip_code, {area}, latitude, longitude, list_price, beds, baths, sqft, pet_cats, pet_dogs,
                   list_date, url, null, null from x_{city}_a where url not in (select a_url from x_{city}_pairs)
            union all
            select md5(url), zip_code, {area}, latitude, longitude, price_avg, beds_avg, baths_avg, sqft_avg, null, null,
                   null, url, null, null from x_{city}_b where url not in (select b_url from x_{city}_pairs)) as u
        where rent is not null and beds is not null and baths is not null and latitude is not null
          and longitude is not null"""
    STEPS[f"x_{city}_filled"] = f"""
        select m.*, coalesce(sqft, middle) as sqft_filled
        from x_{city}_merged as m left join (
            select zip_code, beds, baths, quantile_cont(sqft, 0.5) as middle from x_{city}_merged
            where sqft is not null group by all) as g using (zip_code, beds, baths)
        where coalesce(sqft, middle) is not null"""
    STEPS[f"x_{city}_trimmed"] = f"""
        select f.* from x_{city}_filled as f cross join (
            select quantile_cont(sqft_filled, 0.05) as s05, quantile_cont(sqft_filled, 0.95) as s95,
                   quantile_cont(rent, 0.95) as r95, quantile_cont(beds, 0.95) as d95,
                   quantile_cont(baths, 0.95) as t95 from x_{city}_filled) as c
        where sqft_filled between s05 and s95 and rent <= r95 and beds <= d95 and baths <= t95"""


def _labelled(feed: str, lookup: str) -> str:
    return f"{feed} left join {lookup} on zip = zip_code"


clean_steps("ny", "borough", _labelled("ny_feed_a", "x_boroughs_a"), _labelled("ny_feed_b", "x_boroughs_b"), False, "")
clean_steps("bos", "neighborhood", _labelled("bos_feed_a", "x_neighborhoods"), _labelled("bos_feed_b", "x_neighborhoods"), True,
            "and neighborhood is not null")

STEPS["x_areas"] = """
    select rtrim(nta2020) as nta2020, rtrim(boroname) as boroname, rtrim(ntaname) as ntaname, rtrim(ntaabbrev) as ntaabbrev from area_text"""
STEPS["x_edges"] = """
    select nta2020, lon as x1, lat as y1,
           coalesce(lead(lon) over ring, first_value(lon) over ring) as x2,
           coalesce(lead(lat) over ring, first_value(lat) over ring) as y2
    from x_area_corners window ring as (partition by nta2020, part, ring order by corner)"""
LOCATED = """
    select t.*, boroname as borough_name, ntaname as nta_name, ntaabbrev as nta_abbrev, nta2020
    from {trimmed} as t
    join (select latitude, longitude, nta2020
          from (select distinct latitude, longitude from {trimmed}) as p, x_edges
          where (y1 > cast(latitude as double)) <> (y2 > cast(latitude as double))
            and cast(longitude as double) < (x2 - x1) * (cast(latitude as double) - y1) / (y2 - y1) + x1
          group by all having count(*) % 2 = 1) as h using (latitude, longitude)
    join x_areas using (nta2020)"""
STEPS["x_ny_located"] = LOCATED.format(trimmed="x_ny_trimmed")


# Listings of one id: the best partner, then all columns in turn.
_ORDER = ", ".join(f"{c} nulls last" for c in (
    "price_gap", "match_url", "zip_code", "{area}", "latitude", "longitude", "rent", "beds", "baths", "sqft", "pet_cats", "pet_dogs",
    "list_date", "url"))


def publish_sql(city: str, source: str, borough: str, nta: str, hood: str) -> str:
    area = "neighborhood" if hood == "neighborhood" else "borough"
    return f"""
        select listing_id as "Listing ID", '{city}' as "City", {borough} as "Borough", {nta} as "NTA2020",
               zip_code as "ZIP Code", {hood} as "Neighborhood", latitude as "Latitude", longitude as "Longitude",
               rent as "Rent", cast(beds as float) as "Beds", cast(baths as float) as "Baths",
               cast(round_even(sqft_filled, 0) as integer) as "SqFt", pet_cats as "Cats Allowed",
               pet_dogs as "Dogs Allowed", list_date as "List Date", url as "URL"
        from {source}
        qualify row_number() over (partition by listing_id order by {_ORDER.format(area=area)}) = 1"""


STEPS["x_ny_final"] = publish_sql("New York City", "x_ny_located", "borough", "nta2020", "nta_name")
STEPS["x_bos_final"] = publish_sql("Boston", "x_bos_trimmed", "cast(null as varchar)", "cast(null as varchar)",
                                "neighborhood")
STEPS["x_unified"] = """
    select *, timestamp '2025-12-08 09:30:01' as "Last Updated"
    from (select * from x_bos_final union all select * from x_ny_final) as u"""

_CLEAN_A = ("listing_id varchar, list_price integer, beds double, baths double, sqft integer, zip_code varchar, "
            "{area} varchar, address_line_1 varchar, address_line_2 varchar, latitude double, longitude double, "
            "url varchar, pet_cats boolean, pet_dogs boolean, list_date date")
_CLEAN_B = ("listing_id varchar, price_avg integer, beds_avg double, baths_avg double, sqft_avg integer, zip_code varchar, "
            "{area} varchar, address_line_1 varchar, address_line_2 varchar, latitude double, longitude double, url varchar")
_MERGED = ("listing_id varchar, zip_code varchar, borough varchar, latitude double, longitude double, rent integer, "
           "beds double, baths double, sqft integer, pet_cats boolean, pet_dogs boolean, list_date date, url varchar, "
           "price_gap integer, match_url varchar")
CONTRACT = ("Listing ID: varchar, City varchar, Borough varchar, NTA2020 varchar, ZIP Code: varchar, "
             "Neighborhood varchar, Latitude double, Longitude double, Rent integer, Beds double, Baths double, "
             "SqFt integer, Cats Allowed: boolean, Dogs Allowed: boolean, List Date: date, URL varchar")
_SPLIT = "listing_id varchar, address_line_1 varchar, address_line_2 varchar"


def _split_check(strict: bool) -> str:
    street, unit = split_sql("address_line", strict)
    return f"select listing_id, {street} as address_line_1, {unit} as address_line_2 from ny_feed_a"


@query("split_address_strict", _SPLIT, _split_check(True))
def split_address_strict(t):
    return split_address(t.input("ny_feed_a"), "address_line", STRICT).select(
        "listing_id", "address_line_1", "address_line_2")


@query("split_address_loose", _SPLIT, _split_check(False))
def split_address_loose(t):
    return split_address(t.input("ny_feed_a"), "address_line", LOOSE).select(
        "listing_id", "address_line_1", "address_line_2")


@query("join_lateral_udtf", _SPLIT, _split_check(False))
def join_lateral_udtf(t):
    register_split_address(t.spark, "split_address_loose", LOOSE)
    return t.sql("select l.listing_id, s.address_line_1, s.address_line_2 "
                 "from {listings} as l, lateral split_address_loose(l.address_line) as s",
                 listings=t.input("ny_feed_a"))


@query("clean_listings_a", _CLEAN_A.format(area="borough"), "select * from x_ny_a")
def clean_listings_a(t):
    return t.clean("new_york")[0]


@query("clean_listings_b", _CLEAN_B.format(area="borough"), "select * from x_ny_b")
def clean_listings_b(t):
    return t.clean("new_york")[1]


@query("clean_listings_a_strict", _CLEAN_A.format(area="neighborhood"), "select * from x_bos_a")
def clean_listings_a_strict(t):
    return t.clean("boston")[0]


@query("clean_listings_b_strict", _CLEAN_B.format(area="neighborhood"), "select * from x_bos_b")
def clean_listings_b_strict(t):
    return t.clean("boston")[1]


@query("match_listings", "a_key varchar, b_key varchar, address_line_1 varchar, address_line_2 varchar, zip_code varchar, "
       "borough varchar, latitude double, longitude double, rent integer, beds double, baths double, sqft integer, "
       "pet_cats boolean, pet_dogs boolean, list_date date, a_url varchar, b_url varchar, price_gap integer",
       "select * from x_ny_pairs")
def match_listings(t):
    a, b, matches = t.matched("new_york")
    return listings.match_listings(a, b, "borough", matches=matches)


@query("merge_listings", _MERGED, "select * from x_ny_merged")
def merge_listings(t):
    return listings.expand(*t.merged("new_york"), "borough")


_BEST = ("price_gap nulls last, match_url nulls last, zip_code, latitude nulls last, longitude nulls last, rent nulls last, "
         "beds nulls last, baths nulls last, sqft nulls last")


@query("merge_listings_best", _MERGED, f"""
    select * from x_ny_merged qualify row_number() over (partition by listing_id order by {_BEST}) = 1""")
def merge_listings_best(t):
    return listings.best(*t.merged("new_york"), "borough")


@query("match_pairs_folded", "zip_code varchar, price_gap integer, pairs bigint", """
    select zip_code, price_gap, count(*) as pairs from x_ny_pairs group by zip_code, price_gap""")
def match_pairs_folded(t):
    """Pairs counted from their factors, without any of them being made."""
    return t.matched("new_york")[2].pairs.groupBy("zip_code", "price_gap").agg(F.sum("weight").alias("pairs"))


@query("impute_group_median", _MERGED + ", sqft_filled double", "select * from x_ny_filled")
def impute_group_median(t):
    return t.every_pair(lambda filled: filled)


@query("trim_outliers", _MERGED + ", sqft_filled double", "select * from x_ny_trimmed")
def trim_outliers(t):
    return t.every_pair(listings.trim_listings)


@query("make_point", "listing_id varchar, point_lon double, point_lat double", """
       select listing_id, cast(longitude as double) as point_lon, cast(latitude as double) as point_lat
       from ny_feed_a where longitude is not null and latitude is not null""")
def make_point_query(t):
    return make_point(t.input("ny_feed_a"), "longitude", "latitude").select("listing_id", "point_lon", "point_lat")


_HELD = """
    select listing_id, nta2020 from (
        select url, listing_id, nta2020 from ny_feed_a, x_edges
        where (y1 > cast(latitude as double)) <> (y2 > cast(latitude as double))
          and cast(longitude as double) < (x2 - x1) * (cast(latitude as double) - y1) / (y2 - y1) + x1
        group by all having count(*) % 2 = 1) as h"""


@query("join_spatial_within", "listing_id varchar, nta2020 varchar", _HELD)
def join_spatial_within(t):
    points = make_point(t.input("ny_feed_a"), "longitude", "latitude")
    return points_in_polygons(points, t.polygons, "point_lon", "point_lat", "edges", ["nta2020"]).select(
        "listing_id", "nta2020")


@query("spatial_join_points_polygons", "listing_id varchar, borough_name varchar, nta_name varchar, nta_abbrev varchar, "
       "nta2020 varchar, rent integer",
       "select listing_id, borough_name, nta_name, nta_abbrev, nta2020, rent from x_ny_located")
def spatial_join_points_polygons(t):
    return t.every_pair(lambda filled: listings.locate(listings.trim_listings(filled), t.polygons)).select(
        "listing_id", "borough_name", "nta_name", "nta_abbrev", "nta2020", "rent")


def _inverse_conic_sql(source: str, kept: str) -> str:
    """The projection inverse in the checking dialect, from its textbook formulas."""
    e2 = "(2 / 298.257222101::double - 1 / (298.257222101::double * 298.257222101::double))"

    def m(phi):
        return f"cos({phi}) / sqrt(1 - k.e * k.e * sin({phi}) * sin({phi}))"

    def t(phi):
        return f"tan(pi() / 4 - ({phi}) / 2) / pow((1 - k.e * sin({phi})) / (1 + k.e * sin({phi})), k.e / 2)"

    step = "pi() / 2 - 2 * atan(t * pow((1 - e * sin(phi)) / (1 + e * sin(phi)), e / 2))"
    inner = "select *, pi() / 2 - 2 * atan(t) as phi from polar"
    for _ in range(6):
        inner = f"select * replace ({step} as phi) from ({inner}) as p"
    return f"""
        with k0 as (select sqrt({e2}) as e, radians(40.16666666666666::double) as p0,
                           radians(40.66666666666666::double) as p1, radians(41.03333333333333::double) as p2),
             k1 as (select *, (ln({m('k.p1')}) - ln({m('k.p2')})) / (ln({t('k.p1')}) - ln({t('k.p2')})) as n from k0 as k),
             k2 as (select *, 6378137.0::double * ({m('k.p1')}) / (k.n * pow({t('k.p1')}, k.n)) as f from k1 as k),
             k3 as (select *, k.f * pow({t('k.p0')}, k.n) as r0 from k2 as k),
             plane as (select {kept}, (x - 984250) * 0.3048006096012192::double as dx,
                              r0 - y * 0.3048006096012192::double as dy, e, n, f from {source}, k3),
             polar as (select *, pow(sqrt(dx * dx + dy * dy) / f, 1 / n) as t from plane)
        select {kept}, degrees(atan2(dx, dy)) / n - 74 as lon, degrees(phi) as lat from ({inner}) as p"""


STEPS["x_area_corners"] = _inverse_conic_sql("area_vertices", "nta2020, part, ring, corner")


@query("reproject_boundaries", "area_id bigint, corner integer, lon double, lat double", f"""
    select area_id, corner, round(lon, 8) as lon, round(lat, 8) as lat
    from ({_inverse_conic_sql('projected_vertices', 'area_id, corner')}) as v""")
def reproject_boundaries(t):
    return reproject_vertices(t.input("projected_vertices"), "x", "y").select(
        "area_id", "corner", F.round("lon", 8).alias("lon"), F.round("lat", 8).alias("lat"))


@query("publish_city", CONTRACT, "select * from x_ny_final")
def publish_city(t):
    return t.published("new_york")


@query("publish_city_strict", CONTRACT, "select * from x_bos_final")
def publish_city_strict(t):
    return t.published("boston")


@query("publish_unified", CONTRACT + ", Last Updated: timestamp", "select * from x_unified")
def publish_unified(t):
    return listings.publish_unified(t.both_cities(), REFRESHED_AT)


def _key_sql(*columns: str) -> str:
    parts = ", ".join(f"coalesce(length(cast({c} as varchar)) || ':' || cast({c} as varchar), '~')" for c in columns)
    return f"md5(concat_ws('|', {parts}))"


_GEO = ('"City"', '"Borough"', '"Neighborhood"', '"ZIP Code"', '"NTA2020"')
STEPS["x_dims"] = f"""
    select 'dim_geography' as dim, {_key_sql(*_GEO)} as key, concat_ws('/', {', '.join(_GEO)}) as label
    from x_unified group by all
    union all select 'dim_unit', {_key_sql('"Beds"', '"Baths"')}, concat_ws('/', "Beds", "Baths") from x_unified group by all
    union all select 'dim_pet_policy', {_key_sql('"Cats Allowed"', '"Dogs Allowed"')},
                     concat_ws('/', "Cats Allowed", "Dogs Allowed") from x_unified group by all"""


@query("star_dims", "dim varchar, key varchar, label varchar", "select * from x_dims")
def star_dims(t):
    parts = listings.star(t.unified())
    shaped = []
    for dim in ("dim_geography", "dim_unit", "dim_pet_policy"):
        key, *attributes = parts[dim].columns
        shaped.append(parts[dim].select(
            F.lit(dim).alias("dim"), F.col(key).alias("key"),
            F.concat_ws("/", *[F.col(a).cast("string") for a in attributes]).alias("label")))
    return shaped[0].unionByName(shaped[1]).unionByName(shaped[2])


@query("star_fact", "listing_id varchar, geography_key varchar, unit_key varchar, pet_policy_key varchar, rent integer, "
       "sqft integer, list_date date, last_updated timestamp, latitude double, longitude double",
       f"""select "Listing ID" as listing_id, {_key_sql(*_GEO)} as geography_key,
                  {_key_sql('"Beds"', '"Baths"')} as unit_key,
                  {_key_sql('"Cats Allowed"', '"Dogs Allowed"')} as pet_policy_key, "Rent" as rent, "SqFt" as sqft,
                  "List Date" as list_date, "Last Updated" as last_updated, "Latitude" as latitude,
                  "Longitude" as longitude from x_unified""")
def star_fact(t):
    return listings.star(t.unified())["fact_listings"]


# --- questions over the unified table ----------------------------------------------------
STEPS["x_area"] = """
    select "City" as city, coalesce("Borough", "Neighborhood") as area, "Rent" as rent, cast("Beds" as double) as beds,
           "SqFt" as sqft, "Cats Allowed" as cats, "Dogs Allowed" as dogs, "List Date" as listed,
           "Last Updated" as updated from x_unified"""


def _median(x: str) -> str:
    return f"cast(quantile_cont({x}, 0.5) as decimal(38,6))"


def _premium(x: str, base: str) -> str:
    return f"round(cast(cast({x} as double) / cast({base} as double) as decimal(38,6)) - 1, 4)"


@query("rent_median_by_city", "city varchar, median_rent double, premium double", f"""
    select city, median_rent, {_premium('median_rent', 'min(median_rent) over ()')} as premium
    from (select city, {_median('rent')} as median_rent from x_area group by city) as m""")
def rent_median_by_city(t):
    return insights.rent_median_by_city(t.unified())


@query("rent_by_bedrooms", "beds double, base_listings bigint, other_listings bigint, base_median double, "
       "other_median double, ratio double", f"""
    select *, round(cast(cast(other_median as double) / cast(base_median as double) as decimal(38,6)), 4) as ratio
    from (select beds, nullif(count(*) filter (city = 'Boston'), 0) as base_listings,
                 nullif(count(*) filter (city = 'New York City'), 0) as other_listings,
                 cast(quantile_cont(rent, 0.5) filter (city = 'Boston') as decimal(38,6)) as base_median,
                 cast(quantile_cont(rent, 0.5) filter (city = 'New York City') as decimal(38,6)) as other_median
          from x_area group by beds) as w""")
def rent_by_bedrooms(t):
    return insights.rent_by_bedrooms(t.unified())


@query("rent_per_bed", "city varchar, area varchar, median_rent_per_bed double",
       f"select city, area, {_median('rent / beds')} as median_rent_per_bed from x_area where beds > 0 group by 1, 2")
def rent_per_bed(t):
    return insights.rent_per_bed(t.unified())


@query("rent_per_sqft", "city varchar, area varchar, median_rent_per_sqft double",
       f"""select city, area, {_median('rent / cast(sqft as double)')} as median_rent_per_sqft
           from x_area where sqft > 0 group by 1, 2""")
def rent_per_sqft(t):
    return insights.rent_per_sqft(t.unified())


@query("supply_concentration", "city varchar, area varchar, listings bigint, place integer, share double, "
       "cumulative_share double", """
    select city, area, listings, row_number() over ranked as place,
           round(cast(listings / sum(listings) over (partition by city) as decimal(38,10)), 4) as share,
           round(cast(sum(listings) over (ranked rows unbounded preceding) / sum(listings) over (partition by city)
                      as decimal(38,10)), 4) as cumulative_share
    from (select city, area, count(*) as listings from x_area group by 1, 2) as c
    window ranked as (partition by city order by listings desc, area nulls last)""")
def supply_concentration(t):
    return insights.supply_concentration(t.unified())


@query("affordable_at_budget", "city varchar, area varchar, listings bigint, affordable bigint, affordable_rate double, "
       "city_affordable bigint, city_share_of_affordable double", """
    select *, round(cast(affordable / listings as decimal(38,10)), 4) as affordable_rate,
           sum(affordable) over (partition by city) as city_affordable,
           round(cast(sum(affordable) over (partition by city) / sum(affordable) over () as decimal(38,10)), 4)
             as city_share_of_affordable
    from (select city, area, count(*) as listings, count(*) filter (rent <= 1500) as affordable
          from x_area group by 1, 2) as c""")
def affordable_at_budget(t):
    return insights.affordable_at_budget(t.unified(), budget=1500)


@query("pet_policy_premium", "city varchar, cats boolean, dogs boolean, median_rent double, premium double", f"""
    select city, cats, dogs, median_rent,
           {_premium('median_rent', 'max(median_rent) filter (not cats and not dogs) over (partition by city)')} as premium
    from (select city, cats, dogs, {_median('rent')} as median_rent from x_area group by 1, 2, 3) as m""")
def pet_policy_premium(t):
    return insights.pet_policy_premium(t.unified())


@query("days_on_market", "city varchar, area varchar, listings bigint, median_days double", f"""
    select city, area, count(*) as listings, {_median("date_diff('day', listed, cast(updated as date))")} as median_days
    from x_area where listed is not null group by 1, 2""")
def days_on_market(t):
    return insights.days_on_market(t.unified())
