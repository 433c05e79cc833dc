"""First-per-key, order sequences, rolling and running windows, top-k shares."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import stage
from .scan import scan


def first_per_key(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column]) -> DataFrame:
    """One row per key: the first under ``order_by``, which must be total.

    Spark plans the rank filter as a group limit on both sides of the exchange, so a
    hot key sends one row per map task, not all of its rows.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order_by)))
    return ranked.filter(F.col("_rank") == 1).drop("_rank")


def sequence(df: DataFrame, key: str, ts: str, ties: Sequence[str], *, number: str | None = None,
             first: str | None = None, previous: str | None = None, following: str | None = None) -> DataFrame:
    """Number each key's rows by ``(ts, ties)``; add first, previous and next time.

    A segmented scan: the input is read once, and a key that owns a third of all rows is
    spread over as many tasks as its rows have range partitions. Rows without a time come
    last within their key and are numbered by ``ties``; a NULL key is a key like any other.
    """
    def of_time(out: str | None) -> dict[str, str]:
        return {out: ts} if out else {}

    return scan(df, [key], [F.asc_nulls_last(ts), *ties], number=number, first=of_time(first),
                previous=of_time(previous), following=of_time(following))


def rolling_avg(df: DataFrame, order: str, columns: dict[str, str], rows: int = 4, by: Sequence[str] = (),
                scale: int = 2) -> DataFrame:
    """Rounded average of ``{out: column}`` over the current and ``rows - 1`` preceding rows.

    Counts rows, not calendar periods; NULLs count for nothing. For tables of any length, with or
    without ``by``; ``rollup_avg`` is shorter work for a rollup that is known to be small.
    """
    exact = {f"_v_{out}": F.col(c).cast("decimal(28,8)") for out, c in columns.items()}
    framed = scan(df.withColumns(exact), by, [order], frames={f"_f_{out}": (f"_v_{out}", rows) for out in columns})
    zero = F.lit(0).cast("decimal(38,8)")
    averages = {}
    for out in columns:
        held = F.filter(F.col(f"_f_{out}"), lambda x: x["v"].isNotNull())
        total = F.aggregate(held, zero, lambda s, x: (s + x["v"]).cast("decimal(38,8)"))
        averages[out] = F.round(F.when(F.size(held) > 0, total.cast("decimal(30,8)") / F.size(held)), scale)
    return framed.withColumns(averages).drop(*exact, *[f"_f_{out}" for out in columns])


def rollup_avg(df: DataFrame, order: str, columns: dict[str, str], rows: int = 4, scale: int = 2) -> DataFrame:
    """``rolling_avg`` of a rollup with one row per period, a few thousand at most, in one task."""
    frame = Window.partitionBy().orderBy(order).rowsBetween(1 - rows, Window.currentRow)
    return df.withColumns({
        out: F.round(F.avg(F.col(c).cast("decimal(28,8)")).over(frame), scale) for out, c in columns.items()})


def running_sum(df: DataFrame, order: str, column: str, by: Sequence[str], out: str) -> DataFrame:
    """Sum of ``column`` up to and with each row along ``order``, for keys of any size."""
    return scan(df, by, [order], running={out: column})


def order_nulls(df: DataFrame, *spec: tuple[str, str]) -> DataFrame:
    """Sort by (column, direction) pairs: ascending puts NULL last, descending first."""
    return df.orderBy(*[
        F.col(c).desc_nulls_first() if way == "desc" else F.col(c).asc_nulls_last() for c, way in spec])


def top_k(df: DataFrame, by: str, value: str, k: int) -> DataFrame:
    """The ``k`` groups with the largest total; the name breaks ties."""
    return _leaders(df.groupBy(by).agg(F.sum(value).alias("total")), by, k)


def _leaders(totals: DataFrame, by: str, k: int) -> DataFrame:
    return totals.orderBy(F.desc_nulls_last("total"), F.asc_nulls_last(by)).limit(k)


def top_k_share(df: DataFrame, by: str, value: str, ks: Sequence[int]) -> DataFrame:
    """Share of the grand total held by the ``k`` largest groups, one row per ``k``.

    Both the largest groups, from a distributed top-k, and the grand total come from the totals
    per group; only ``max(ks)`` rows are ranked.
    """
    totals = stage(df.groupBy(by).agg(F.sum(value).alias("total")), "totals")
    leaders = _leaders(totals, by, max(ks))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("total"), F.asc_nulls_last(by)))
    whole = totals.agg(F.sum("total")).scalar()
    cuts = F.explode(F.array(*[F.lit(k) for k in ks])).alias("k")
    return (
        leaders.withColumn("_place", place).select("total", "_place", cuts)
        .groupBy("k").agg(F.sum(F.when(F.col("_place") <= F.col("k"), F.col("total"))).alias("top_total"))
        .withColumn("grand_total", whole)
    )
