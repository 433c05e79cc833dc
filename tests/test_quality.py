from __future__ import annotations

from conftest import rows
from marketfold.operators import quality
from marketfold.plans.checks import GRAINS, commerce_checks


def test_nulls_pass_where_they_should(frame):
    child = frame("k int, v int", (1, 0), (None, None), (None, 1), (7, 9), (7, 1))
    parent = frame("k int", (1,), (2,))
    assert quality.unique(child, "k").first()[0] == 1
    assert quality.unique(frame("k int", (None,), (None,)), "k").first()[0] == 0
    assert quality.relationships(child, "k", parent, "k").first()[0] == 2
    assert quality.accepted_values(child, "v", [0, 1]).first()[0] == 1
    assert rows(quality.not_null(child, ["k", "v"])) == [("not_null", "k", 2), ("not_null", "v", 1)]
    assert quality.grain_unique(child, ["k"]).first()[0] == 2


def test_report_in_one_pass_per_table(frame):
    df = frame("k int, v int", (1, 0), (1, None), (None, 5), (None, 5), (2, 1))
    checks = [
        quality.TableChecks("t", df, ["k", "v"], ["k"], {"v": [0, 1]}, [("k", frame("p int", (1,)), "p")]),
        quality.TableChecks("u", df, ["v"]),
        quality.TableChecks("w", df, unique=["k", "v"])]
    assert rows(quality.report(checks)) == sorted([
        ("t", "unique", "k", 1), ("t", "not_null", "k", 2), ("t", "not_null", "v", 1), ("t", "accepted_values", "v", 2),
        ("t", "relationships", "k", 1), ("u", "not_null", "v", 1), ("w", "unique", "k", 1), ("w", "unique", "v", 1)], key=repr)


def test_report_of_an_empty_table(frame):
    empty = frame("k int, v int")
    checks = [quality.TableChecks("t", empty, ["k"], ["k"], {"v": [1]}, [("k", empty, "k")])]
    assert {r["failures"] for r in quality.report(checks).collect()} == {0}


def test_declared_counts():
    def total(kind, *prefixes):
        return sum(len(getattr(c, kind)) for c in commerce_checks() if c.table.startswith(prefixes))

    kinds = ("not_null", "unique", "relationships", "accepted")
    assert [total(k, "stg") for k in kinds] == [18, 5, 6, 0]
    assert [total(k, "int") for k in kinds] == [13, 2, 8, 1]
    assert [total(k, "fct", "mart") for k in kinds] == [21, 3, 1, 0]
    assert {c.table for c in commerce_checks()} == set(GRAINS)


def test_model_grains(tables):
    for name in ("fct_order_financials", "mart_kpis_weekly", "mart_category_weekly", "mart_cohort_ltv_monthly",
                 "mart_experience_retention_90d", "int_customer_order_sequence", "int_orders_experience"):
        assert quality.grain_unique(tables.model[name], GRAINS[name]).first()[0] == 0


def test_marts_read_the_steps_that_were_written(tables):
    fresh = type(tables)(tables.spark, tables.root)
    for c in commerce_checks():
        if c.table.startswith("int_"):
            fresh.built(c.table)
    flows = fresh.built("mart_geo_state_flows_weekly").inputFiles()
    assert flows and not [f for f in flows if f.startswith(f"file:{tables.root}") or f.startswith(f"file://{tables.root}")]
    kept = fresh.built("mart_experience_retention_90d").inputFiles()
    assert not [f for f in kept if f.endswith("lineitem.parquet")]
