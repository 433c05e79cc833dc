"""Exact interpolated percentiles from one written, range-partitioned histogram."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import stage
from .scan import KEY, PART, SEGMENT, placed


def _renamed(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed({n: f"_r_{n}" for n in names})


def percentiles(df: DataFrame, value: str, qs: dict[str, float], by: Sequence[str] = (),
                weight: str | None = None, count: str | None = None) -> DataFrame:
    """Exact continuous percentiles of ``value`` per group; one output column per ``qs``.

    1. Rows become a histogram (group, value, count) with map-side combine; ``weight`` is
       the number of times a row counts. It is dealt by range of (group, value) and written.
    2. Each segment, the part of a group inside one partition, has a total. Running totals
       along a group, at most one row per partition, name the segments that hold the wanted ranks.
    3. Only those segments are opened: running counts inside them find the values, which are
       then interpolated.

    The input is read once, whatever the number of percentiles, and a group is never gathered in
    one task. ``count`` names an output with the number of counted values. Groups without any
    value are absent, as with a grouped percentile over non-NULL rows.
    """
    by = list(by)
    counted = F.sum(weight) if weight else F.count("*")
    histogram = (
        df.select(*by, F.col(value).cast("double").alias("_v"), *([weight] if weight else [])).filter(F.col("_v").isNotNull())
        .groupBy(*by, "_v").agg(counted.alias("_n")))
    dealt = placed(histogram, by, ["_v"])

    across = Window.partitionBy(KEY)
    upto = F.sum("_held").over(across.orderBy(PART).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    segments = dealt.groupBy(*SEGMENT).agg(F.sum("_n").alias("_held")).select(
        *SEGMENT, (upto - F.col("_held")).alias("_before"), upto.alias("_upto"), F.sum("_held").over(across).alias("_total"))

    def rank(q: float) -> Column:
        return (F.col("_total") - 1) * F.lit(q)

    holds = F.lit(False)
    for q in qs.values():
        holds = holds | ((F.col("_before") <= F.ceil(rank(q))) & (F.floor(rank(q)) < F.col("_upto")))
    opened = dealt.select(*SEGMENT, "_v", "_n").join(segments.filter(holds).drop("_upto"), SEGMENT)
    inside = Window.partitionBy(*SEGMENT).orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spans = opened.withColumn("_end", F.col("_before") + F.sum("_n").over(inside))

    def at(place: Column) -> Column:
        here = (F.col("_end") - F.col("_n") <= place) & (place < F.col("_end"))
        return F.max(F.when(here, F.col("_v")))

    found = spans.groupBy(KEY).agg(
        F.max("_total").alias("_total"),
        *[c for i, q in enumerate(qs.values()) for c in (
            at(F.floor(rank(q))).alias(f"_low{i}"), at(F.ceil(rank(q))).alias(f"_high{i}"))])
    results = [
        (F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (rank(q) - F.floor(rank(q)))).alias(name)
        for i, (name, q) in enumerate(qs.items())]
    return found.select(
        *[F.col(KEY)[f"k{i}"].alias(b) for i, b in enumerate(by)], *results,
        *([F.col("_total").alias(count)] if count else []))


def column_percentiles(df: DataFrame, wanted: dict[str, tuple[str, float]], weight: str | None = None) -> DataFrame:
    """One row of percentiles over several columns: ``{out: (column, q)}``."""
    columns = sorted({c for c, _ in wanted.values()})
    pairs = F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))
    kept = [weight] if weight else []
    tall = df.select(pairs.alias("p"), *kept).select(F.col("p.column").alias("column"), F.col("p.value").alias("value"), *kept)
    qs = {f"q{i}": q for i, q in enumerate(sorted({q for _, q in wanted.values()}))}
    label = {q: name for name, q in qs.items()}
    per_column = percentiles(tall, "value", qs, by=["column"], weight=weight)
    return per_column.agg(*[
        F.max(F.when(F.col("column") == c, F.col(label[q]))).alias(out) for out, (c, q) in wanted.items()])


def impute_group_median(df: DataFrame, column: str, by: Sequence[str], out: str, over: DataFrame | None = None,
                        weight: str | None = None) -> DataFrame:
    """Fill ``column`` with the median of its group; drop rows that stay empty.

    Medians are taken over ``over`` (``df`` itself by default), whose rows count ``weight``
    times. A NULL in a grouping column never finds its group, as in an SQL equality join. The medians
    are written first, so that Spark knows their size before it plans the join: few of them are
    broadcast, and the rows stay where they are.
    """
    source = df if over is None else over
    medians = stage(percentiles(source.dropna(subset=list(by)), column, {"_median": 0.5}, by, weight), "medians")
    condition = F.lit(True)
    for b in by:
        condition = condition & (F.col(b) == F.col(f"_r_{b}"))
    filled = df.join(_renamed(medians, by), condition, "left")
    return (
        filled.withColumn(out, F.coalesce(F.col(column).cast("double"), F.col("_median")))
        .filter(F.col(out).isNotNull()).select(*df.columns, out)
    )


def trim_outliers(df: DataFrame, fences: dict[str, tuple[float, float]], caps: dict[str, float],
                  over: DataFrame | None = None, weight: str | None = None) -> DataFrame:
    """Keep rows inside every fence and at or below every cap.

    All cutoffs are taken once over the whole of ``over`` (``df`` itself by default), whose
    rows count ``weight`` times, and enter the filter as one scalar subquery.
    """
    wanted: dict[str, tuple[str, float]] = {}
    for c, (low, high) in fences.items():
        wanted[f"{c}_low"] = (c, low)
        wanted[f"{c}_high"] = (c, high)
    for c, high in caps.items():
        wanted[f"{c}_cap"] = (c, high)
    cutoffs = column_percentiles(df if over is None else over, wanted, weight)
    cut = cutoffs.select(F.struct(*cutoffs.columns)).scalar()
    keep = F.lit(True)
    for c in fences:
        keep = keep & F.col(c).between(cut[f"{c}_low"], cut[f"{c}_high"])
    for c in caps:
        keep = keep & (F.col(c) <= cut[f"{c}_cap"])
    return df.filter(keep)
