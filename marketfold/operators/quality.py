"""Table tests. Every test yields (table, check, column, failures)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL count per column; all columns are counted in one pass."""
    counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(f"f{i}") for i, c in enumerate(columns)])
    return _tall(counts, [(f"f{i}", "not_null", c) for i, c in enumerate(columns)])


def duplicated(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, ignoring keys with a NULL part."""
    present = F.lit(True)
    for c in columns:
        present = present & F.col(c).isNotNull()
    return df.filter(present).groupBy(*columns).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)


def unique(df: DataFrame, column: str) -> DataFrame:
    return duplicated(df, [column]).agg(F.count("*").alias("failures"))


def grain_unique(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Key combinations, NULL parts included, that occur more than once."""
    return (
        df.groupBy(*columns).agg(F.count("*").alias("copies")).filter(F.col("copies") > 1)
        .agg(F.count("*").alias("failures"))
    )


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Child rows whose non-NULL key has no parent."""
    keys = parent.select(F.col(key).alias("_parent"))
    return child.filter(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")


def relationships(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Orphan rows, counted. Child keys are counted before the join, so a hot key is one row."""
    keys = child.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_rows"))
    lost = orphans(keys, column, parent, key)
    return lost.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("failures"))


def outside(column: str, values: Sequence) -> Column:
    """True for a non-NULL value that is not in the list."""
    return F.col(column).isNotNull() & ~F.col(column).isin(list(values))


def accepted_values(df: DataFrame, column: str, values: Sequence) -> DataFrame:
    return df.filter(outside(column, values)).agg(F.count("*").alias("failures"))


def _tall(counts: DataFrame, cells: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Turn one row of counts into one row per check."""
    packed = F.array(*[F.struct(
        F.lit(check).alias("check_name"), F.lit(column).alias("column_name"), F.col(name).alias("failures"))
        for name, check, column in cells])
    return counts.select(F.explode(packed).alias("c")).select("c.*")


@dataclass
class TableChecks:
    """The tests declared for one table."""

    table: str
    frame: DataFrame
    not_null: Sequence[str] = ()
    unique: Sequence[str] = ()
    accepted: dict[str, Sequence] = field(default_factory=dict)
    relationships: Sequence[tuple[str, DataFrame, str]] = ()

    def results(self) -> list[DataFrame]:
        parts = []
        if self.unique:
            # The first unique column groups the pass that also counts the rest.
            lead, *others = self.unique
            parts.append(self._row_checks(lead))
            parts += [unique(self.frame, c).select(
                F.lit("unique").alias("check_name"), F.lit(c).alias("column_name"), "failures") for c in others]
        elif self.not_null or self.accepted:
            parts.append(self._row_checks(None))
        for column, parent, key in self.relationships:
            parts.append(relationships(self.frame, column, parent, key).select(
                F.lit("relationships").alias("check_name"), F.lit(column).alias("column_name"), "failures"))
        return [p.select(F.lit(self.table).alias("table_name"), "*") for p in parts]

    def _row_checks(self, lead: str | None) -> DataFrame:
        cells, counts = [], []
        for c in self.not_null:
            cells.append((f"f{len(cells)}", "not_null", c))
            counts.append(F.count(F.when(F.col(c).isNull(), 1)))
        for c, values in self.accepted.items():
            cells.append((f"f{len(cells)}", "accepted_values", c))
            counts.append(F.count(F.when(outside(c, values), 1)))
        named = [n.alias(cell[0]) for n, cell in zip(counts, cells)]
        if lead is None:
            return _tall(self.frame.agg(*named), cells)
        per_key = self.frame.groupBy(F.col(lead).alias("_lead")).agg(F.count("*").alias("_copies"), *named)
        repeated = F.count(F.when(F.col("_lead").isNotNull() & (F.col("_copies") > 1), 1))
        totals = per_key.agg(
            repeated.alias("_dup"), *[F.coalesce(F.sum(cell[0]), F.lit(0)).alias(cell[0]) for cell in cells])
        return _tall(totals, [("_dup", "unique", lead), *cells])


def report(checks: Sequence[TableChecks]) -> DataFrame:
    """All tests of all tables as (table_name, check_name, column_name, failures)."""
    parts = [p for c in checks for p in c.results()]
    result = parts[0]
    for p in parts[1:]:
        result = result.unionByName(p)
    return result
