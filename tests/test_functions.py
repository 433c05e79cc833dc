from __future__ import annotations

import datetime as dt
import re
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from marketfold.functions import numbers, text, times
from marketfold.plans.listings import classed_a


@pytest.mark.parametrize("address, street, unit", [
    ("12 Oak St. Apt 4 Unit B", "12 oak st apt 4", "b"),
    ("United Nations Plaza", "", "ed nations plaza"),
    ("Unit 9", "", "9"),
    ("5 O'Neil Rd #2", "5 oneil rd", "2"),
    ("7 Elm", "7 elm", None),
    ("1 Fleet St Fl 2", "1 fleet st", "2"),
    ("9 Bay Apt #5", "9 bay", "#5"),
    ("9 Bay Unit 3 Floor 2", "9 bay", "3oor 2"),
    (None, None, None),
])
def test_loose_split(frame, address, street, unit):
    df = text.split_address(frame("a string", (address,)), "a", text.LOOSE)
    assert tuple(df.first())[1:] == (street, unit)


@pytest.mark.parametrize("address, street, unit", [
    ("12 Oak St. Apt 4 Unit B", "12 oak st. apt 4", "b"),
    ("UnitA, Unit 3", "", "a,3"),
    ("United Nations Plaza", "united nations plaza", None),
    ("5 O'Neil Rd. #2", "5 o'neil rd.", "2"),
])
def test_strict_split(frame, address, street, unit):
    df = text.split_address(frame("a string", (address,)), "a", text.STRICT)
    assert tuple(df.first())[1:] == (street, unit)


@pytest.mark.parametrize("rules", [text.LOOSE, text.STRICT])
def test_split_keeps_the_class_without_ranges(frame, rules):
    df = text.split_address(frame("a string", *[(f"<{chr(i)}>",) for i in range(1, 300) if chr(i) != "#"]), "a", rules)
    assert "a-z" not in df._jdf.queryExecution().optimizedPlan().toString()
    kept = re.compile(f"[^{rules.keep}]", re.ASCII)
    assert all(r["address_line_1"] == kept.sub("", r["a"]).strip(" ").lower() for r in df.collect())
    assert text._listed(r"\w-z") == r"\w-z"


def test_split_as_table_function(spark, frame):
    text.register_split_address(spark, "split_strict_test", text.STRICT)
    out = spark.sql("select s.* from {t} as t, lateral split_strict_test(t.a) as s",
                    t=frame("a string", ("3 Elm Unit 7",), (None,)))
    assert rows(out) == [("3 elm", "7"), (None, None)]


def test_midpoints(frame):
    df = frame("a int, b int, x float, y float", (1001, 1002, 1.0, 2.0), (1, None, None, 2.0), (-3, 0, 0.0, 0.0))
    out = df.select(numbers.midpoint_int(F.col("a"), F.col("b")), numbers.midpoint_float(F.col("x"), F.col("y")))
    assert [tuple(r) for r in out.collect()] == [(1001, 1.5), (None, None), (-1, 0.0)]


def test_half_even(frame):
    df = frame("x double", (2.5,), (3.5,), (2.4,), (None,))
    assert [r[0] for r in df.select(numbers.round_half_even_int(F.col("x"))).collect()] == [2, 4, 2, None]


def test_numbers_from_text(frame):
    df = frame("t string", ("2+",), ("Studio",), ("1.5 bd",), ("1.2.3",), (None,), (" 3+ ",), ("",))
    assert [r[0] for r in df.select(numbers.extract_number(F.col("t"))).collect()] == [2.0, None, 1.5, None, None, 3.0, None]
    assert [r[0] for r in df.select(numbers.strip_plus(F.col("t"))).collect()] == [2.0, None, None, None, None, 3.0, None]


def test_rate_guards_zero(frame):
    df = frame("n int, d int", (1, 3), (1, 0), (2, None))
    assert [r[0] for r in df.select(numbers.rate(F.col("n"), F.col("d"))).collect()] == [Decimal("0.3333"), None, None]


def test_dates(frame):
    df = frame("t string", ("2024-02-30",), ("soon",), ("2024-02-29T10:00:00",), (None,))
    assert [r[0] for r in df.select(times.coerce_date(F.col("t"))).collect()] == [
        None, None, dt.datetime(2024, 2, 29, 10), None]


def test_interval_edge(frame):
    start = dt.datetime(2024, 1, 1, 5)
    edge = start + dt.timedelta(days=90)
    df = frame("a timestamp_ntz, b timestamp_ntz", (edge, start), (edge + dt.timedelta(microseconds=1), start))
    assert [r[0] for r in df.select(times.within_interval(F.col("a"), F.col("b"), 90)).collect()] == [True, False]


def test_refresh_stamp_rounds(frame):
    df = frame("t string", ("2025-12-08 09:30:00.499",), ("2025-12-08 09:30:00.5",))
    assert [r[0].second for r in df.select(times.refresh_stamp(F.col("t"))).collect()] == [0, 1]


def test_month_index_counts_calendar_months(frame):
    df = frame("m date, o date", (dt.date(2024, 1, 1), dt.date(2023, 12, 1)), (dt.date(2024, 1, 1), dt.date(2024, 1, 1)))
    assert [r[0] for r in df.select(times.month_index(F.col("m"), F.col("o"))).collect()] == [1, 0]


def test_natural_key_tells_null_from_empty(frame):
    df = frame("a string, b string", (None, "x"), ("", "x"), ("~", "x"))
    assert len({r[0] for r in df.select(text.natural_key(F.col("a"), F.col("b"))).collect()}) == 3


def test_row_name_tells_rows_apart_without_texts_of_numbers(frame):
    df = frame("a string, b string, x float, n int",
               (None, "x", 1.5, 1), ("x", None, 1.5, 1), ("", "x", 1.5, 1), ("x", "", 1.5, 1), ("x", "x", None, 1), ("x", "x", 1.5, None),
               ("x", "x", 1.5, 1), ("x", "x", 1.5, 1), ("xx", "", 1.5, 1), ("x", "x", 1.0, 1), ("x", "x", 1.0, 0), (None, None, None, None))
    named = df.select("*", text.row_name(*[F.col(c) for c in df.columns]).alias("name"))
    found = named.collect()
    assert {len(r["name"]) for r in found} == {16}
    assert len({bytes(r["name"]) for r in found}) == len({tuple(r)[:4] for r in found}) == 11


def test_classes_are_named_by_hashes_of_the_values(frame):
    df = frame("zip_code string, address_line_1 string, address_line_2 string, latitude float, longitude float, list_price int, "
               "beds float, baths float, sqft int", ("1", "s", None, 1.0, 2.0, 3, 1.0, 1.0, None), ("1", "s", "", 1.0, 2.0, 3, 1.0, 1.0, None))
    plan = classed_a(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "md5" not in plan and "cast(" not in plan
    assert len({bytes(r["a_class"]) for r in classed_a(df).collect()}) == 1
