"""Every registered query against its checking SQL, on the smallest directory."""

from __future__ import annotations

import pytest

import __spark_entry__ as contract
from marketfold.bindings.registry import REGISTRY
from conftest import SMALL
from parity import compare, database


@pytest.fixture(scope="module")
def con(tables):
    return database(SMALL)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query(spark, con, name):
    problem, _, _ = compare(spark, con, SMALL, name)
    assert problem == ""


def test_entry(spark, tables):
    assert contract.entry(spark).count() > 0
