"""The segmented scan against a plain loop, with a hot key over many partitions."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from marketfold.operators.scan import scan

SCHEMA = "k string, t int, id int, v bigint"


def by_hand(rows, order):
    """Expected columns per id, from a list per key."""
    found = {}
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=order)
        total = 0
        for i, (_, t, row_id, v) in enumerate(mine):
            total += v or 0
            found[row_id] = (i + 1, mine[0][1], mine[i - 1][1] if i else None, mine[i + 1][1] if i + 1 < len(mine) else None,
                             total, [m[3] for m in mine[max(0, i - 3):i + 1]])
    return found


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_scan_equals_a_loop(frame, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot"] * 6 + [None, "a", "b", "c"]), rng.choice([None, *range(30)]), i, rng.choice([None, *range(50)]))
            for i in range(400)]
    got = scan(frame(SCHEMA, *rows), ["k"], [F.asc_nulls_last("t"), F.desc("id")], number="n", first={"f": "t"},
               previous={"p": "t"}, following={"x": "t"}, running={"s": "v"}, frames={"w": ("v", 4)}, parts=parts)
    expected = by_hand(rows, lambda r: (r[1] is None, r[1] or 0, -r[2]))
    seen = {r["id"]: (r["n"], r["f"], r["p"], r["x"], r["s"], [w["v"] for w in r["w"]]) for r in got.collect()}
    assert seen == expected


def test_scan_without_keys_and_of_nothing(frame):
    rows = [("x", t, t, 1) for t in range(50)]
    got = scan(frame(SCHEMA, *rows), [], ["t"], number="n", running={"s": "v"}, parts=7)
    assert sorted((r["t"], r["n"], r["s"]) for r in got.collect()) == [(t, t + 1, t + 1) for t in range(50)]
    assert scan(frame(SCHEMA, ("a", 1, 1, 1)).where("false"), ["k"], ["t"], number="n", frames={"w": ("v", 2)}).count() == 0


def test_equal_rows_of_a_hot_key_spread_over_partitions(frame):
    got = scan(frame(SCHEMA, *[("hot", 1, 1, 1)] * 500), ["k"], ["t"], number="n", parts=8)
    assert sorted(r["n"] for r in got.collect()) == list(range(1, 501))
    from marketfold.operators.scan import PART, placed
    sizes = [r["count"] for r in placed(frame(SCHEMA, *[("hot", 1, 1, 1)] * 500), ["k"], ["t"], 8).groupBy(PART).count().collect()]
    assert len(sizes) > 4 and max(sizes) < 200
