"""Query registry: a callable, its output columns and the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .inputs import STATEMENTS, TABLES
from .tables import Tables


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    columns: str
    sql: str | None

    def run(self, spark: SparkSession, root: str) -> DataFrame:
        return _plain_numbers(self.build(Tables.shared(spark, root)))

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        casts = ", ".join(f'cast("{n}" as {kind}) as "{n}"' for n, kind in parse_columns(self.columns))
        return with_steps(f"select {casts} from ({self.sql.strip()}) as result")


REGISTRY: dict[str, Query] = {}
# Named steps of the checking SQL; the inputs of both engines come first.
STEPS: dict[str, str] = {n: s.format(**{t: t for t in TABLES}) for n, s in STATEMENTS.items()}


def query(name: str, columns: str, sql: str | None = None):
    """Register a query. ``columns`` is ``"name type, ..."`` in the checking dialect."""
    def add(build: Callable[[Tables], DataFrame]):
        if name in REGISTRY:
            raise ValueError(f"query {name} registered twice")
        REGISTRY[name] = Query(name, build, columns, sql)
        return build
    return add


def parse_columns(text: str) -> list[tuple[str, str]]:
    """``"a bigint, List Date: date"`` to pairs; a colon ends a name with spaces."""
    pairs = []
    for part in re.split(r",\s*(?![^(]*\))", text.strip()):
        name, kind = part.rsplit(":", 1) if ":" in part else part.rsplit(" ", 1)
        pairs.append((name.strip(), kind.strip()))
    return pairs


def with_steps(sql: str) -> str:
    """Prefix the named steps a statement uses, directly or through other steps."""
    wanted: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"[a-z_0-9]+", text):
            if word in STEPS and word not in wanted:
                visit(STEPS[word])
                if word not in wanted:
                    wanted.append(word)

    visit(sql)
    if not wanted:
        return sql
    return "with " + ",\n".join(f"{n} as ({STEPS[n].strip()})" for n in wanted) + "\n" + sql


def _plain_numbers(df: DataFrame) -> DataFrame:
    """Decimals and floats as doubles, the one number type both engines return alike."""
    plain = []
    for name, kind in df.dtypes:
        column = F.col(f"`{name}`")
        plain.append(column.cast("double").alias(name) if kind.startswith("decimal") or kind == "float" else column)
    return df.select(*plain)


# Rounding helpers of the checking SQL: quantize the engine's double, then round.
def money(x: str, scale: int = 2) -> str:
    return f"round(cast({x} as decimal(38,6)), {scale})"


def ratio(x: str, scale: int = 4) -> str:
    return f"round(cast({x} as decimal(38,10)), {scale})"
