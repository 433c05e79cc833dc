from __future__ import annotations

import datetime as dt

import pytest

from conftest import rows
from marketfold.functions.text import LOOSE
from marketfold.operators.joins import unmatched
from marketfold.plans import listings
from marketfold.sources.sinks import stage

A = ("listing_id string, list_price int, beds float, baths float, sqft int, list_date date, zip_code string, "
     "latitude float, longitude float, address_line string, url string, pet_cats boolean, pet_dogs boolean, borough string")
B = ("listing_id string, price_min int, price_max int, beds_min float, beds_max float, baths_min float, baths_max float, "
     "sqft_min int, sqft_max int, zip_code string, latitude float, longitude float, address_line string, url string, "
     "borough string")


def a(listing_id, price=1000, address="1 Elm", url=None, date=None, zip_code="10001", lat=40.5, sqft=500, beds=1.0):
    return (listing_id, price, beds, 1.0, sqft, date, zip_code, lat, -74.0, address, url or f"a/{listing_id}", True, None,
            "Manhattan")


def b(listing_id, price=1000, address="1 Elm", url=None, lat=40.5, sqft=(600, 601), beds=(1.0, 2.0)):
    return (listing_id, price, price, *beds, 1.0, 1.0, *sqft, "10001", lat, -74.0, address, url or f"b/{listing_id}", None)


def cleaned(frame, left, right):
    return (listings.clean_a(frame(A, *left), LOOSE, "borough"), listings.clean_b(frame(B, *right), LOOSE, "borough"))


def merged(frame, left, right):
    ca, cb = cleaned(frame, left, right)
    matches = listings.factorise(ca, cb)
    return stage(listings.expand(listings.merge_listings(ca, cb, matches, "borough"), matches, "borough"), "merged")


def pairs(frame, left, right):
    return rows(listings.match_listings(*cleaned(frame, left, right), "borough"), "a_url", "b_url")


def test_one_listing_can_have_two_partners(frame):
    assert pairs(frame, [a("1")], [b("1"), b("2")]) == [("a/1", "b/1"), ("a/1", "b/2")]


def test_price_band_is_inclusive(frame):
    assert pairs(frame, [a("1", 1000)], [b("1", 1300), b("2", 1301), b("3", 700), b("4", 699)]) == [
        ("a/1", "b/1"), ("a/1", "b/3")]


def test_missing_units_match_and_missing_addresses_do_not(frame):
    assert pairs(frame, [a("1", address="1 Elm")], [b("1", address="1 Elm")]) == [("a/1", "b/1")]
    assert pairs(frame, [a("1", address=None)], [b("1", address=None)]) == []
    assert pairs(frame, [a("1", address="1 Elm Apt 2")], [b("1", address="1 Elm"), b("2", address="1 Elm #2")]) == [
        ("a/1", "b/2")]


def test_match_takes_known_sizes_from_b(frame):
    ca, cb = cleaned(frame, [a("1", lat=40.5, sqft=500)], [b("1", lat=40.5001, sqft=(600, None))])
    row = listings.match_listings(ca, cb, "borough").first()
    assert (row["beds"], row["sqft"], row["rent"], row["borough"]) == (1.5, 500, 1000, "Manhattan")
    assert row["latitude"] == pytest.approx(40.5001, abs=1e-5)


def test_newest_record_wins(frame):
    old, new = dt.date(2024, 1, 1), dt.date(2024, 2, 1)
    raw = frame(A, a("1", 1, date=old, url="x"), a("1", 2, date=new, url="y"), a("1", 3, date=None, url="z"))
    assert rows(listings.clean_a(raw, LOOSE, "borough"), "list_price") == [(2,)]
    assert rows(listings.clean_a(raw, LOOSE, "borough", nulls_newest=True), "list_price") == [(3,)]


def test_required_columns(frame):
    raw = frame(A, a("1"), a(None), a("2", zip_code=None), a("3")[:-1] + (None,))
    assert rows(listings.clean_a(raw, LOOSE, "borough"), "listing_id") == [("1",), ("3",)]
    assert rows(listings.clean_a(raw, LOOSE, "borough", require_area=True), "listing_id") == [("1",)]


def test_shared_url_consumes_both_ids(frame):
    # Ids 1 and 2 share a url; only id 1 has a partner, so neither is listed as unmatched.
    left = [a("1", url="same"), a("2", url="same", address="9 Oak"), a("3", address="8 Oak")]
    out = merged(frame, left, [b("1"), b("2", address="7 Oak")])
    assert rows(out, "url", "match_url") == [("a/3", None), ("b/2", None), ("same", "b/1")]


def test_best_partner_equals_best_of_all_pairs(spark):
    import random
    from pyspark.sql import functions as F
    rng = random.Random(4)
    # A third of each feed are copies of one listing.
    left = [a(str(i), 1000 if i % 3 == 0 else rng.randint(700, 1700), url=f"a/{i // 2 if i % 7 == 0 else i}")
            for i in range(60)]
    right = [b(str(i), 1000 if i % 3 == 0 else rng.randint(400, 2500), address="1 Elm" if i % 5 else "2 Elm")
             for i in range(60)]
    ca = listings.clean_a(spark.createDataFrame(left, A), LOOSE, "borough")
    cb = listings.clean_b(spark.createDataFrame(right, B), LOOSE, "borough")
    every = stage(listings.match_listings(ca, cb, "borough"), "every")
    matches = listings.factorise(ca, cb)
    assert matches.pairs.agg(F.sum("weight")).first()[0] == every.count() > 2 * matches.pairs.count()
    folded = stage(listings.merge_listings(ca, cb, matches, "borough"), "folded")
    full = stage(listings.expand(folded, matches, "borough"), "full")
    assert full.filter("match_url is not null").count() == every.count()
    # Medians and cutoffs are those of all pairs; the best partner is one of those that they leave.
    filled = stage(listings.fill_sqft(folded), "filled")
    wanted_fill = stage(listings.fill_sqft(full), "w")
    assert rows(listings.expand(filled, matches, "borough"), *wanted_fill.columns) == rows(wanted_fill)
    wanted = stage(listings.trim_listings(wanted_fill), "t")
    trimmed = listings.trim_listings(filled)
    assert rows(listings.expand(trimmed, matches, "borough"), *wanted.columns) == rows(wanted)
    got = listings.best(trimmed, matches, "borough").filter("match_url is not null")
    columns = ["url", "rent", "match_url", "price_gap", "sqft_filled"]
    assert set(rows(got, *columns)) <= set(rows(wanted, *columns))
    best_gap = wanted.filter("match_url is not null").groupBy("url", "rent").agg(F.min("price_gap").alias("price_gap"))
    assert set(rows(got.groupBy("url", "rent").agg(F.min("price_gap").alias("price_gap")))) == set(rows(best_gap))


def test_classes_have_short_names_and_urls_sort_by_a_hash(frame):
    left = [a("1"), a("2"), a("3", beds=None), a("4", sqft=None)]
    ca, cb = listings.clean_a(frame(A, *left), LOOSE, "borough"), listings.clean_b(frame(B, b("1")), LOOSE, "borough")
    matches = listings.factorise(ca, cb)
    kinds = dict(matches.pairs.dtypes)
    assert (kinds["a_class"], kinds["b_class"]) == ("binary", "binary")
    assert len({bytes(r["a_class"]) for r in matches.a.collect()}) == 3  # a missing value is none of the others
    assert rows(matches.pairs, "weight") == [(1,), (1,), (2,)]
    alone = unmatched(ca, cb, ["url"])
    assert "xxhash64(url" in alone._jdf.queryExecution().optimizedPlan().toString() and set(alone.columns) == set(ca.columns)
    numbers = unmatched(frame("k int", (1,), (2,), (None,)), frame("k long", (1,)), ["k"])
    assert rows(numbers) == [(2,), (None,)]


def test_a_listing_keeps_a_partner_that_is_complete(frame):
    # The nearest partner has no beds; the next one completes the listing.
    left, right = [a("1", beds=None)], [b("1", 1000, beds=(None, None)), b("2", 1100, beds=(1.0, 2.0))]
    ca, cb = listings.clean_a(frame(A, *left), LOOSE, "borough"), listings.clean_b(frame(B, *right), LOOSE, "borough")
    matches = listings.factorise(ca, cb)
    out = listings.best(listings.merge_listings(ca, cb, matches, "borough"), matches, "borough")
    assert rows(out, "url", "match_url", "beds", "price_gap") == [("a/1", "b/2", 1.5, 100)]


def test_imputed_size_counts_every_partner(frame):
    left = [a("1"), a("9", address="3 Oak", sqft=None, beds=1.5)]
    right = [b("1", sqft=(600, 600)), b("2", sqft=(1000, 1000))]
    ca = listings.clean_a(frame(A, *left), LOOSE, "borough")
    cb = listings.clean_b(frame(B, *right), LOOSE, "borough")
    matches = listings.factorise(ca, cb)
    filled = listings.fill_sqft(listings.merge_listings(ca, cb, matches, "borough"))
    assert rows(listings.expand(filled, matches, "borough").filter("url = 'a/9'"), "sqft_filled") == [(800.0,)]


def test_merge_covers_every_row_once(tables):
    from pyspark.sql import functions as F
    # Every complete row of either feed is in the result, in a pair or alone; ids may repeat.
    ca, cb = tables.clean("new_york")
    out = listings.expand(*tables.merged("new_york"), "borough")
    complete_a = ca.dropna(subset=["list_price", "beds", "baths", "latitude", "longitude"]).select("url")
    complete_b = cb.dropna(subset=["price_avg", "beds_avg", "baths_avg", "latitude", "longitude"]).select("url")
    named = out.select("url").union(out.select(F.col("match_url").alias("url"))).distinct()
    assert complete_a.join(named, "url", "left_anti").count() == 0
    assert complete_b.join(named, "url", "left_anti").count() == 0
    partners = out.filter("match_url is not null").groupBy("url").count()
    assert partners.filter("count > 1").count() > 0  # several partners are in the test data
    assert out.filter("match_url is not null").select("price_gap").distinct().count() > 20


def test_incomplete_rows_drop_out(frame):
    assert merged(frame, [a("1", beds=None), a("2", lat=None)], [b("9", address="3 Oak", beds=(1.0, None))]).count() == 0


def test_publish_rounds_half_to_even_and_pads(frame):
    df = frame("listing_id string, zip_code string, latitude float, longitude float, rent int, beds double, baths double, "
               "sqft_filled double, pet_cats boolean, pet_dogs boolean, list_date date, url string, price_gap int, "
               "match_url string",
               ("1", "z", 1.0, 2.0, 3, 1.5, 1.0, 2.5, None, True, None, "u", None, None),
               ("2", "z", 1.0, 2.0, 3, 1.5, 1.0, 3.5, None, True, None, "u", None, None))
    out = listings.publish_city(df, "Boston", {})
    assert rows(out, "`Listing ID`", "SqFt", "Borough", "NTA2020", "City") == [
        ("1", 2, None, None, "Boston"), ("2", 4, None, None, "Boston")]
    assert out.columns == list(listings.CONTRACT)
    assert dict(out.dtypes) == listings.CONTRACT


def test_duplicate_ids(frame):
    filled = stage(listings.fill_sqft(merged(frame, [a("1", 1000)], [b("1", 1100), b("2", 1050), b("3", 1050)])), "f")
    with pytest.raises(Exception, match="occurs 3 times"):
        listings.publish_city(filled, "Boston", {}).collect()
    best = listings.publish_city(filled.withColumnRenamed("borough", "n"), "Boston", {"Neighborhood": "n"}, "best")
    assert best.count() == 1
    assert listings.publish_city(filled, "Boston", {}, "keep").count() == 3


def test_city_plans_end_to_end(tables, spark):
    fa, fb = tables.feeds("boston")
    assert listings.boston(fa, fb, "best").exceptAll(tables.published("boston")).count() == 0
    fa, fb = tables.feeds("new_york")
    ny = listings.new_york(fa, fb, tables.polygons, "best")
    assert ny.exceptAll(tables.published("new_york")).count() == 0


def test_star_keys_find_their_dimension(tables):
    parts = listings.star(tables.unified())
    fact = parts["fact_listings"]
    for dim, key in (("dim_geography", "geography_key"), ("dim_unit", "unit_key"), ("dim_pet_policy", "pet_policy_key")):
        assert fact.join(parts[dim], key, "left_anti").count() == 0
        assert parts[dim].count() == parts[dim].select(key).distinct().count()


def test_shares_sum_to_one(tables):
    from pyspark.sql import functions as F
    from marketfold.plans import insights
    supply = insights.supply_concentration(tables.unified())
    for row in supply.groupBy("city").agg(F.max("cumulative_share").alias("s"), F.sum("share").alias("t")).collect():
        assert float(row["s"]) == 1.0 and abs(float(row["t"]) - 1) < 0.01


def test_questions_of_matches_read_written_feeds(tables):
    from marketfold.bindings.registry import REGISTRY
    fresh = type(tables)(tables.spark, tables.root)
    for name in ("union_all_three", "match_listings"):
        files = REGISTRY[name].build(fresh).inputFiles()
        assert files and not [f for f in files if f.endswith("/orders.parquet")]


def test_rows_are_written_once_and_without_their_keys(frame):
    written = {}

    def keep(df, name):
        written[name] = df.columns
        return stage(df, name)
    feeds = frame(A, a("1"), a("2", address="2 Elm", zip_code="10002")), frame(B, b("1"), b("2", address="3 Oak"))
    out = listings.new_york(*feeds, frame("boroname string, ntaname string, ntaabbrev string, nta2020 string, "
                                          "edges array<struct<x1: double, y1: double, x2: double, y2: double>>"), "best", keep)
    assert rows(out) == []
    assert set(written) == {"clean_a", "clean_b", "pairs", "alone"}
    assert not {"listing_id", "weight", "a_class", "b_class"} & set(written["alone"])


def test_class_names_stay_out_of_the_exchanges_of_a_match(frame):
    plans = []

    def keep(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stage(df, name)
    ca, cb = (stage(c, "c") for c in (listings.classed_a(listings.clean_a(frame(A, a("1")), LOOSE, "borough")),
                                      listings.classed_b(listings.clean_b(frame(B, b("1")), LOOSE, "borough"))))
    matches = listings.factorise(ca, cb, stage=keep)
    assert not [line for line in plans[0].splitlines() if "Aggregate" in line and "class" in line]
    assert rows(matches.pairs, "a_class") == rows(ca, "a_class") and rows(matches.pairs, "b_class") == rows(cb, "class")


def test_both_zeros_are_one_class(frame):
    left = [a("1", lat=0.0), a("2", lat=-0.0)]
    found = listings.factorise(*cleaned(frame, left, [b("1", lat=-0.0), b("2", lat=0.0)]))
    assert rows(found.pairs, "weight") == [(4,)]
    assert pairs(frame, left, [b("1", lat=-0.0), b("2", lat=0.0)]) == [
        ("a/1", "b/1"), ("a/1", "b/2"), ("a/2", "b/1"), ("a/2", "b/2")]


def test_without_an_id_rows_are_published_by_url(frame):
    left = [a("1", 1000), a("2", 1000, url="a/1"), a("3", 1000, address="7 Elm")]
    ca, cb = cleaned(frame, left, [b("1", 1100), b("2", 1050, url="b/x"), b("3", 1050), b("4", address="8 Elm", url="a/3")])
    matches = listings.factorise(ca, cb)
    filled = stage(listings.fill_sqft(listings.expand(listings.merge_listings(ca, cb, matches, "borough"), matches, "borough")), "f")
    assert filled.count() > filled.select("listing_id").distinct().count()
    for way in ("best", "keep"):
        wanted = listings.publish_city(filled, "New York City", {"Borough": "borough"}, way)
        assert rows(listings.publish_city(filled.drop("listing_id"), "New York City", {"Borough": "borough"}, way)) == rows(wanted)
    with pytest.raises(Exception, match="occurs"):
        listings.publish_city(filled.drop("listing_id"), "New York City", {"Borough": "borough"}).collect()


def test_cities_share_what_is_written(tables):
    fresh = type(tables)(tables.spark, tables.root)
    first = fresh.both_cities()
    assert [sorted(d.inputFiles()) for d in fresh.both_cities()] == [sorted(d.inputFiles()) for d in first]
    assert not [f for d in first for f in d.inputFiles() if "/listings-" not in f]
    assert fresh.unified().exceptAll(tables.unified()).count() == tables.unified().exceptAll(fresh.unified()).count() == 0
