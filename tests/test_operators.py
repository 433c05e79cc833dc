from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from conftest import rows
from marketfold.operators import joins, quantiles, ranking, spatial


def test_percentiles_against_numpy(spark):
    rng = random.Random(7)
    data = []
    for i in range(4000):
        # A third of all rows are in one group, and a third of those are one value.
        group = "hot" if i % 3 == 0 else rng.choice(["a", "b", None])
        value = rng.choice([None, 0.0, -rng.random() * 10 ** rng.randint(-3, 5), rng.random() * 10 ** rng.randint(-3, 5),
                            float(rng.randint(-5, 1000)), 999.9999999999999, 1000.0])
        data.append((group, 5.0 if group == "hot" and i % 9 == 0 else value))
    data.append(("single", 42.0))
    df = spark.createDataFrame(data, "g string, v double")
    qs = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "low": 0.0, "high": 1.0}
    got = {r["g"]: r for r in quantiles.percentiles(df, "v", qs, ["g"]).collect()}
    assert set(got) == {"hot", "a", "b", None, "single"}
    for group in got:
        values = [v for g, v in data if g == group and v is not None]
        for name, q in qs.items():
            assert got[group][name] == pytest.approx(np.percentile(values, q * 100), rel=1e-12, abs=1e-12)


def test_percentiles_of_nothing(frame):
    assert quantiles.percentiles(frame("g string, v int", ("a", None)), "v", {"m": 0.5}, ["g"]).count() == 0


def test_column_percentiles(frame):
    df = frame("x int, y double", (1, 10.0), (2, 20.0), (3, None), (4, 40.0))
    out = quantiles.column_percentiles(df, {"xm": ("x", 0.5), "y0": ("y", 0.0), "ym": ("y", 0.5)})
    assert rows(out) == [(2.5, 10.0, 20.0)]


def test_impute_group_median(frame):
    df = frame("id int, z string, sqft int", *[(i, "a", v) for i, v in enumerate([1, 2, 4, 100, None])],
               (9, "b", None), (10, None, None), (11, None, 7))
    out = quantiles.impute_group_median(df, "sqft", ["z"], "filled")
    got = {r["id"]: r["filled"] for r in out.collect()}
    # Group b has no value and a missing key finds no group: both rows without a value drop out.
    assert got == {0: 1.0, 1: 2.0, 2: 4.0, 3: 100.0, 4: 3.0, 11: 7.0}


def test_few_medians_are_broadcast_and_rows_stay(frame):
    df = frame("id int, z string, sqft int", *[(i, "ab"[i % 2], v) for i, v in enumerate([1, 2, 3, 20, None, None])])
    out = quantiles.impute_group_median(df, "sqft", ["z"], "filled")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan and "hashpartitioning" not in plan
    assert {r["id"]: r["filled"] for r in out.collect()} == {0: 1.0, 1: 2.0, 2: 3.0, 3: 20.0, 4: 2.0, 5: 11.0}


def test_trim_uses_cutoffs_of_the_whole_input(frame):
    df = frame("a int, b int", *[(i, 100 - i) for i in range(101)])
    out = quantiles.trim_outliers(df, {"a": (0.05, 0.95)}, {"b": 0.5})
    assert sorted(r["a"] for r in out.collect()) == list(range(50, 96))


def test_sequence_equals_plain_window(spark):
    rng = random.Random(3)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{rng.randint(0, 40)}"
        data.append((key, f"2024-0{rng.randint(1, 3)}-{rng.randint(1, 9):02d} {rng.randint(0, 3):02d}:00:00", i))
    df = spark.createDataFrame(data, "k string, t string, id int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = ranking.sequence(df.repartition(5), "k", "t", ["id"], number="n", first="f", previous="p", following="x")
    w = Window.partitionBy("k").orderBy("t", "id")
    want = df.select("*", F.row_number().over(w).cast("bigint").alias("n"),
                     F.min("t").over(Window.partitionBy("k")).alias("f"), F.lag("t").over(w).alias("p"),
                     F.lead("t").over(w).alias("x"))
    assert rows(got) == rows(want)


def test_sequence_places_missing_times_and_keys(spark):
    data = [("a", None, 1), ("a", "2024-01-02 00:00:00", 2), ("a", None, 0), ("a", "2024-01-01 00:00:00", 3), (None, None, 4),
            (None, "2024-01-01 00:00:00", 5)]
    df = spark.createDataFrame(data, "k string, t string, id int").withColumn("t", F.col("t").cast("timestamp_ntz"))
    got = ranking.sequence(df, "k", "t", ["id"], number="n", first="f", previous="p", following="x")
    w = Window.partitionBy("k").orderBy(F.asc_nulls_last("t"), "id")
    want = df.select("*", F.row_number().over(w).cast("bigint").alias("n"), F.min("t").over(Window.partitionBy("k")).alias("f"),
                     F.lag("t").over(w).alias("p"), F.lead("t").over(w).alias("x"))
    assert rows(got) == rows(want)


def test_percentiles_of_a_narrow_range_open_few_rows(spark):
    df = spark.range(20_000).select((F.lit(40.5) + F.pmod(F.hash("id"), F.lit(1 << 20)) / (1 << 20) * 0.4).alias("v"))
    got = quantiles.percentiles(df, "v", {"m": 0.5, "h": 0.95})
    want = df.select(F.percentile("v", F.lit(0.5)).alias("m"), F.percentile("v", F.lit(0.95)).alias("h"))
    assert rows(got.select(F.round("m", 9), F.round("h", 9))) == rows(want.select(F.round("m", 9), F.round("h", 9)))
    assert "repartition" not in got._jdf.queryExecution().logical().toString().lower()


def test_weighted_percentiles(frame):
    df = frame("g string, v double, w long", ("a", 1.0, 3), ("a", 5.0, 1), ("a", 9.0, 2), ("b", None, 4), ("b", 2.0, 1))
    assert rows(quantiles.percentiles(df, "v", {"m": 0.5, "h": 0.9}, ["g"], "w")) == [("a", 3.0, 9.0), ("b", 2.0, 2.0)]


def test_band_join_against_brute_force(spark):
    rng = random.Random(11)

    def side(n, first):
        return [(first + i, "" if i % 3 == 0 else rng.choice("xy"), np.float32(40 + rng.randint(0, 12) * 0.0001).item(),
                 None if i % 10 == 9 else rng.randint(-1200, 1200)) for i in range(n)]

    a, b = side(150, 0), side(150, 1000)
    left = spark.createDataFrame(a, "id int, k string, x float, p int")
    right = spark.createDataFrame(b, "bid int, bk string, bx float, bp int")
    got = joins.band_join(left, right, {"k": "bk"}, {("x", "bx"): 0.0002, ("p", "bp"): 300})
    want = sorted(
        (l[0], r[0]) for l in a for r in b if l[1] == r[1] and None not in (l[3], r[3]) and abs(l[3] - r[3]) <= 300
        and float(abs(np.float32(l[2]) - np.float32(r[2]))) <= 0.0002)
    assert sorted((r["id"], r["bid"]) for r in got.select("id", "bid").collect()) == want
    assert len(want) > 100

def test_band_join_sorts_by_a_hash_of_keys_of_one_type(frame):
    left, right = frame("k string, n int, x float", ("s", 1, 1.0), (None, 2, 1.0)), frame("bk string, bn long, bx float", ("s", 1, 1.1), (None, 2, 1.0))
    got = joins.band_join(left, right, {"k": "bk", "n": "bn"}, {("x", "bx"): 0.2})
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64(k" in plan and "xxhash64(bk" in plan
    assert rows(got, "k", "n", "bn") == [("s", 1, 1)]
    assert rows(joins.band_join(left, right, {"n": "bn"}, {}), "n", "bn") == [(1, 1), (2, 2)]


def test_with_scalar_joins_nothing(frame):
    df = frame("x int", (1,), (5,))
    out = joins.with_scalar(df, df.agg(F.max("x").alias("top")), "s").select("x", "s.top")
    assert rows(out) == [(1, 5), (5, 5)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def test_unmatched_keeps_null_keys(frame):
    out = joins.unmatched(frame("k int", (1,), (2,), (None,)), frame("k int", (1,)), ["k"])
    assert rows(out) == [(2,), (None,)]


def test_union_fills_missing_columns(frame):
    out = joins.union_by_name([frame("a int, b int", (1, 2)), frame("b int", (3,))], fill_missing=True)
    assert rows(out) == [(1, 2), (None, 3)]


def test_first_per_key_ignores_input_order(spark):
    data = [(i % 7, (i * 37) % 11 or None, i) for i in range(200)]
    shuffled = data[:]
    random.Random(5).shuffle(shuffled)
    order = [F.desc_nulls_last("v"), F.asc("id")]
    one = ranking.first_per_key(spark.createDataFrame(data, "k int, v int, id int"), ["k"], order)
    two = ranking.first_per_key(spark.createDataFrame(shuffled, "k int, v int, id int").repartition(6), ["k"], order)
    assert rows(one) == rows(two)


def test_rolling_average_skips_missing_weeks(frame):
    df = frame("w int, v int", (1, 10), (2, 20), (4, 30), (5, 40), (6, 50))
    out = ranking.rolling_avg(df, "w", {"m": "v"})
    assert [float(r["m"]) for r in out.orderBy("w").collect()] == [10, 15, 20, 25, 35]


def test_top_k_share_breaks_ties_by_name(frame):
    df = frame("g string, v int", ("b", 5), ("a", 5), ("c", 10), ("d", 1))
    assert rows(ranking.top_k_share(df, "g", "v", [1, 2])) == [(1, 10, 21), (2, 15, 21)]
    assert [r["g"] for r in ranking.top_k(df, "g", "v", 2).collect()] == ["c", "a"]


def test_order_nulls(frame):
    df = frame("a int, b int", (1, None), (1, 2), (None, 1), (1, 3))
    out = ranking.order_nulls(df, ("a", "asc"), ("b", "desc"))
    assert [tuple(r) for r in out.collect()] == [(1, None), (1, 3), (1, 2), (None, 1)]


def test_points_in_polygons_against_brute_force(spark):
    rng = random.Random(2)
    # A concave ring, and a square with a square hole: both rings in one edge list.
    rings = {
        "concave": [[(0, 0), (0.5, 0), (0.5, 0.5), (0.2, 0.3), (0, 0.5)]],
        "holed": [[(0.1, 0.6), (0.9, 0.6), (0.9, 1.0), (0.1, 1.0)], [(0.3, 0.7), (0.6, 0.7), (0.6, 0.9), (0.3, 0.9)]],
    }
    edges = {n: [(*p, *q) for r in rs for p, q in zip(r, r[1:] + r[:1])] for n, rs in rings.items()}
    points = [(i, rng.random(), rng.random() * 1.1) for i in range(2000)]
    # A third of all points are copies of one.
    points += [(10000 + i, 0.11, 0.12) for i in range(1000)]
    polygons = spark.createDataFrame(
        [(n, [tuple(float(v) for v in e) for e in es]) for n, es in edges.items()],
        "name string, edges array<struct<x1: double, y1: double, x2: double, y2: double>>")
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = spatial.points_in_polygons(df, polygons, "x", "y", "edges", ["name"], most=3)

    def inside(x, y, es):
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in es) % 2

    want = sorted((i, n) for i, x, y in points for n, es in edges.items() if inside(x, y, es))
    assert sorted((r["id"], r["name"]) for r in got.select("id", "name").collect()) == want
    assert len({n for _, n in want}) == 2


def wheel(n, radius=0.3, centre=(0.4, 0.4)):
    """Edges of a star with n corners."""
    import math
    corners = [(centre[0] + r * math.cos(a), centre[1] + r * math.sin(a)) for a, r in (
        (2 * math.pi * i / n, radius * (0.7 + 0.3 * (i % 2))) for i in range(n))]
    return [(*p, *q) for p, q in zip(corners, corners[1:] + corners[:1])]


def test_cells_have_few_edges_and_give_the_same_rows(spark):
    rng = random.Random(5)
    shapes = {"star": wheel(1000), "small": wheel(40, 0.02, (0.35, 0.41)), "holed": wheel(200) + wheel(60, 0.1)}
    polygons = spark.createDataFrame(
        [(n, es) for n, es in shapes.items()], "name string, edges array<struct<x1: double, y1: double, x2: double, y2: double>>")
    cells = spatial.polygon_cells(polygons, "edges", ["name"], most=8)
    assert cells.filter(F.size("edges") > 8).count() == 0
    assert cells.filter((F.size("edges") == 0) & (F.col("inside") == 1)).count() > 10  # no test at all there
    assert cells.select("level").distinct().count() > 2
    points = [(i, rng.random(), rng.random()) for i in range(3000)]
    df = spark.createDataFrame(points, "id int, x double, y double")
    got = spatial.points_in_polygons(df, polygons, "x", "y", "edges", ["name"], most=8)

    def inside(x, y, es):
        return sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for x1, y1, x2, y2 in es) % 2
    want = sorted((i, n) for i, x, y in points for n, es in shapes.items() if inside(x, y, es))
    assert sorted((r["id"], r["name"]) for r in got.select("id", "name").collect()) == want


def test_points_in_no_polygon(spark, frame):
    none = spark.createDataFrame([], "name string, edges array<struct<x1: double, y1: double, x2: double, y2: double>>")
    assert spatial.points_in_polygons(frame("x double, y double", (0.0, 0.0)), none, "x", "y", "edges", ["name"]).count() == 0


def test_assembly_closes_rings_and_keeps_parts_apart(frame):
    from marketfold.sources.boundaries import assemble_edges
    square = [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)]
    vertices = [("a", 1, 1, i, *p) for i, p in enumerate(square)]
    vertices += [("a", 1, 2, i, *p) for i, p in enumerate([*square, square[0]])]  # closed already
    vertices += [("a", 2, 1, i, p[0] + 5, p[1]) for i, p in enumerate(square)]
    vertices += [("b", 1, 1, 0, 0.0, 0.0), ("b", 1, 1, 1, 1.0, 1.0)]  # no ring
    df = frame("area string, part int, ring int, i int, x double, y double", *vertices)
    out = {r["area"]: r["edges"] for r in assemble_edges(df, "area", ["part", "ring"], "i", "x", "y").collect()}
    assert set(out) == {"a"} and len(out["a"]) == 9
    edges = sorted(tuple(e) for e in out["a"])
    one = [(0.0, 0.0, 1.0, 0.0), (1.0, 0.0, 1.0, 1.0), (1.0, 1.0, 0.0, 0.0)]
    assert edges == sorted(one + one + [(x1 + 5, y1, x2 + 5, y2) for x1, y1, x2, y2 in one])


def test_reprojection_of_known_points(frame):
    # The origin of the projection, and a round trip by the forward formulas.
    import math
    p = spatial.NEW_YORK_LONG_ISLAND_FEET
    f = 1 / p.inverse_flattening
    e = math.sqrt(2 * f - f * f)
    m = lambda a: math.cos(a) / math.sqrt(1 - (e * math.sin(a)) ** 2)
    t = lambda a: math.tan(math.pi / 4 - a / 2) / ((1 - e * math.sin(a)) / (1 + e * math.sin(a))) ** (e / 2)
    a0, a1, a2 = (math.radians(d) for d in (p.latitude_of_origin, p.parallel_1, p.parallel_2))
    n = math.log(m(a1) / m(a2)) / math.log(t(a1) / t(a2))
    big = p.semi_major * m(a1) / (n * t(a1) ** n)

    def forward(lon, lat):
        rho = big * t(math.radians(lat)) ** n
        theta = n * math.radians(lon - p.central_meridian)
        return (rho * math.sin(theta) / p.metres_per_unit + p.false_easting,
                (big * t(a0) ** n - rho * math.cos(theta)) / p.metres_per_unit + p.false_northing)

    places = [(-74.0, 40.16666666666666), (-73.9857, 40.7484), (-74.2, 40.5), (-73.7, 40.9)]
    df = frame("x double, y double", *[forward(*place) for place in places])
    got = spatial.reproject_vertices(df, "x", "y").select("lon", "lat").collect()
    for (lon, lat), r in zip(places, got):
        assert (r["lon"], r["lat"]) == (pytest.approx(lon, abs=1e-10), pytest.approx(lat, abs=1e-10))


def test_salted_join_splits_a_heavy_key(spark, frame):
    rng = random.Random(7)
    # A third of the left rows share one key; all its rows are equal, too.
    left_rows = [("hot", 0)] * 1000 + [(rng.choice(["a", "b", "c", None]), i) for i in range(2000)]
    right_rows = [("hot", 1), ("hot", 2), ("a", 3), ("z", 4), (None, 5)]
    left, right = joins_stage(frame("k string, i int", *left_rows)), frame("k string, j int", *right_rows)
    for how in ("inner", "left"):
        got = joins.salted_join(left, right, ["k"], how, share=0.05, least=100)
        assert rows(got, "k", "i", "j") == rows(left.join(right, "k", how), "k", "i", "j")
    heavy = {r["k"]: r["_salts"] for r in joins.heavy_keys(left, ["k"], 0.05, 100).collect()}
    assert heavy["hot"] == 7 and len(heavy) <= 20
    plain = joins.salted_join(left, right, ["k"], share=0.9, least=100)
    assert plain.count() == left.join(right, "k").count()


def joins_stage(df):
    from marketfold.sources.sinks import stage
    return stage(df, "left")
