from __future__ import annotations

import json

import pytest

from conftest import rows
from marketfold.sources import commerce, ingest, landing, lookups, sinks

PAGE_A = {"properties": [
    {"listing_id": "1", "list_price": 2000, "list_date": "2024-05-01T00:00:00", "permalink": "p1",
     "description": {"beds": "2+", "baths_consolidated": "1+", "sqft": 700},
     "location": {"address": {"postal_code": "02108", "line": "1 Elm", "coordinate": {"lat": 42.3, "lon": -71.0}}},
     "pet_policy": {"cats": True, "dogs": False}},
    {"listing_id": "2", "list_date": "soon", "description": None, "location": {"address": None}},
    {"listing_id": "3", "description": {"beds": "Studio"}, "location": None, "permalink": None},
]}
PAGE_B = {"totalResultCount": 3, "data": [
    {"homeData": {"url": "/x", "addressInfo": {"zip": "10001-0042", "formattedStreetLine": "1 Elm",
                                               "centroid": {"centroid": {"latitude": 40.7, "longitude": -74.0}}}},
     "rentalExtension": {"rentalId": "r1", "rentPriceRange": {"min": 1, "max": 2}, "bedRange": {"min": 0, "max": 1},
                         "bathRange": None}},
    {"homeData": None, "rentalExtension": {"rentalId": "r2", "rentPriceRange": None}},
]}


def landed(frame, feed, *pages):
    df = frame("query_zip string, page int, body string", *[(z, n, json.dumps(p)) for z, n, p in pages])
    return landing.land_pages(landing.parse_pages(df, "body", feed), feed, ("query_zip", "page"))


def test_missing_and_null_objects_a(frame):
    out = landing.typed_listings(landed(frame, "a", ("02108", 1, PAGE_A)), "a", ("query_zip",))
    got = {r["listing_id"]: r.asDict() for r in out.collect()}
    assert (got["1"]["beds"], got["1"]["baths"], got["1"]["sqft"], got["1"]["pet_dogs"]) == (2.0, 1.0, 700, False)
    assert str(got["1"]["list_date"]) == "2024-05-01" and got["1"]["url"] == landing.URL_PREFIX["a"] + "p1"
    assert got["2"]["list_date"] is None and got["2"]["zip_code"] is None and got["2"]["url"] == landing.URL_PREFIX["a"]
    assert got["3"]["beds"] is None and got["3"]["latitude"] is None


def test_missing_and_null_objects_b(frame):
    out = landing.typed_listings(landed(frame, "b", ("10001", 1, PAGE_B)), "b", ("query_zip",), city="new_york")
    got = {r["listing_id"]: r.asDict() for r in out.collect()}
    assert (got["r1"]["zip_code"], got["r1"]["beds_max"], got["r1"]["baths_min"]) == ("10001", 1.0, None)
    assert got["r2"]["price_min"] is None and got["r2"]["url"] == landing.URL_PREFIX["b"]


def test_empty_and_broken_pages_give_no_rows(frame):
    pages = [("1", 1, {}), ("1", 2, {"properties": []}), ("1", 3, {"properties": None})]
    assert landed(frame, "a", *pages).count() == 0


def test_first_fetched_wins(frame):
    one = {"properties": [{"listing_id": "1", "permalink": "x"}, {"listing_id": None}]}
    df = landed(frame, "a", ("02109", 1, one), ("02108", 2, one), ("02108", 1, one))
    kept = landing.dedupe_by_id_keep_first(
        df.select("record.listing_id", "query_zip", "page", "pos"), "listing_id", ["query_zip", "page", "pos"])
    assert rows(kept) == [("1", "02108", 1, 0)]


def pages(frame, feed, *found):
    df = frame("query_zip string, page int, body string", *[(z, n, json.dumps(p)) for z, n, p in found])
    return landing.parse_pages(df, "body", feed)


def test_completeness(frame):
    df = pages(frame, "b", ("10001", 1, PAGE_B), ("10002", 1, {"totalResultCount": 1, "data": [PAGE_B["data"][0]]}),
               ("10003", 1, {"totalResultCount": 50}), ("10004", 1, {"totalResultCount": 0, "data": []}))
    out = landing.landing_completeness(df, "b", ["query_zip"], "page")
    assert rows(out, "query_zip", "fetched", "expected", "complete") == [
        ("10001", 2, 3, False), ("10002", 1, 1, True), ("10003", 0, 50, False), ("10004", 0, 0, True)]


def test_an_empty_last_page_ends_a_fetch(frame):
    full = {"properties": [{"listing_id": str(i)} for i in range(3)]}
    df = pages(frame, "a", ("02108", 1, full), ("02108", 2, {"properties": []}), ("02109", 1, full), ("02110", 1, {}))
    out = landing.landing_completeness(df, "a", ["query_zip"], "page", page_limit=3)
    assert rows(out, "query_zip", "fetched", "pages", "complete") == [
        ("02108", 3, 2, True), ("02109", 3, 1, False), ("02110", 0, 1, True)]


def test_pages_from_files(spark, tmp_path):
    (tmp_path / "query_zip=02108").mkdir()
    (tmp_path / "query_zip=02108" / "page1.json").write_text(json.dumps(PAGE_A, indent=1))
    whole = landing.read_pages(spark, str(tmp_path), "a", one_page_per_line=False)
    assert landing.land_pages(whole, "a", ("query_zip",)).count() == 3
    lines = tmp_path / "lines"
    lines.mkdir()
    (lines / "pages.json").write_text("\n".join([json.dumps(PAGE_A)] * 2))
    assert landing.land_pages(landing.read_pages(spark, str(lines), "a"), "a").count() == 6


def test_lookup_sizes():
    assert len(lookups.neighborhood_rows()) == 28
    assert (len(lookups.borough_rows("a")), len(lookups.borough_rows("b"))) == (171, 148)


@pytest.mark.parametrize("fmt", ["parquet", "csv", "json", "orc"])
def test_load_formats(spark, tables, tmp_path, fmt):
    source = tables.raw["raw_sellers"].select(
        *[c if c != "seller_id" else tables.raw["raw_sellers"][c].cast("string").alias(c) for c in tables.raw["raw_sellers"].columns])
    writer = source.write.option("header", True) if fmt == "csv" else source.write
    writer.format(fmt).save(str(tmp_path / "raw_sellers"))
    assert commerce.load(spark, str(tmp_path), "raw_sellers", fmt).exceptAll(source).count() == 0


def test_sinks(spark, frame, tmp_path):
    df = frame("a int, b string", (1, "x"), (2, "y"))
    target = str(tmp_path / "t")
    sinks.full_refresh(df, target)
    assert rows(sinks.full_refresh(df, target)) == [(1, "x"), (2, "y")]
    assert rows(sinks.full_refresh(df.filter("a = 1"), target, ["b"]), "a", "b") == [(1, "x")]
    empty = sinks.create_as(df, "shape_only_test", str(tmp_path / "c"), only_schema=True)
    assert empty.count() == 0 and empty.columns == ["a", "b"]
    assert sinks.create_as(df, "shape_only_test", str(tmp_path / "c")).count() == 2
    spark.sql("drop table shape_only_test")
    log = str(tmp_path / "log")
    sinks.append_run_log(spark, log, "SUCCESS", "", "2025-01-01 00:00:00")
    assert sinks.append_run_log(spark, log, "FAILURE", "why", "2025-01-08 00:00:00").count() == 2
    assert rows(sinks.stage(df, "step")) == rows(df)


def fetched(frame, feed, *pages):
    df = frame("query_zip string, page int, body string", *[(z, n, p if isinstance(p, str) else json.dumps(p)) for z, n, p in pages])
    return landing.parse_pages(df, "body", feed)


def record_a(listing_id, own_zip, permalink):
    return {"listing_id": listing_id, "permalink": permalink, "location": {"address": {"postal_code": own_zip}}}


def test_ingest_keeps_the_first_fetched_and_the_queried_borough(frame):
    # Queens is fetched before Brooklyn, although its ZIP codes are greater.
    pages = fetched(
        frame, "a", ("11201", 1, {"properties": [record_a("1", "11201", "brooklyn"), record_a("2", "10001", "b2")]}),
        ("11354", 2, {"properties": [record_a("1", "11201", "late")]}),
        ("11354", 1, {"properties": [record_a(None, "11354", "none"), record_a("1", "10001", "queens")]}),
        ("99999", 1, {"properties": [record_a("3", "10001", "unplanned")]}))
    out = ingest.ingest(pages, "a", "new_york")
    assert rows(out, "listing_id", "zip_code", "url", "borough") == [
        ("1", "10001", landing.URL_PREFIX["a"] + "queens", "Queens"), ("2", "10001", landing.URL_PREFIX["a"] + "b2", "Brooklyn")]


def test_ingest_of_boston_labels_by_the_own_zip(frame):
    pages = fetched(frame, "a", ("02108", 1, {"properties": [record_a("1", "02128", "x"), record_a("2", "02128-0042", "y")]}))
    assert rows(ingest.ingest(pages, "a", "boston"), "listing_id", "neighborhood") == [("1", "East Boston"), ("2", None)]


def test_quarantine_has_every_value_that_would_vanish(frame):
    df = frame("query_zip string, page int, body string", ("10001", 1, json.dumps(PAGE_A)), ("10002", 1, "cut {"), ("10003", 1, None))
    pages = ingest.parse_pages_strictly(df, "body", "a")
    assert rows(ingest.quarantine(pages, "a", "new_york")) == [
        ("10001", 1, 0, "beds", "2+"), ("10001", 1, 1, "list_date", "soon"), ("10001", 1, 2, "beds", "Studio"),
        ("10002", 1, None, None, "cut {")]


def test_a_lost_page_makes_a_fetch_incomplete(frame):
    full = {"properties": [{"listing_id": str(i)} for i in range(2)]}
    short = {"properties": [{"listing_id": "9"}]}
    pages = fetched(frame, "a", ("1", 1, full), ("1", 2, full), ("1", 3, short), ("2", 1, full), ("2", 3, short), ("3", 1, full))
    out = landing.landing_completeness(pages, "a", ["query_zip"], "page", page_limit=2)
    assert rows(out, "query_zip", "missing_pages", "complete") == [("1", 0, True), ("2", 1, False), ("3", 0, False)]
    assert rows(landing.page_gaps(pages, ["query_zip"], "page")) == [("2", 2, 2)]
