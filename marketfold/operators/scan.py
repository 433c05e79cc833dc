"""Segmented prefix scan: numbers, neighbours, running sums and rolling frames along sorted keys.

Rows are dealt by range of (keys, order), sorted, and written once with their place. A segment
is the part of one key that lies in one range partition. Only the first and the last key of a
partition can go on in another one, so at most two segments per partition leave a carry row
(count, sums, edge values); that table is bounded by twice the number of partitions. All other
work is inside a segment: a key that owns most of the rows is spread over as many tasks as it
has segments, and no window is without a partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.sinks import stage

PART, KEY, SEQ = "_scan_part", "_scan_key", "_scan_seq"
SEGMENT = [PART, KEY]


def placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], parts: int | None = None) -> DataFrame:
    """``df`` written in the order of (keys, order): ``SEQ`` ascends with it, ``PART`` is the partition.

    Rows equal in ``order`` get an arbitrary place, settled by being written; a tie number lets
    them spread over partitions.
    """
    parts = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order, "_scan_tie"]
    tied = df.withColumn("_scan_tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("_scan_tie")
    # A struct is equal to another when their NULLs are, so joins and windows agree on keys.
    key = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("all"))
    return stage(dealt.withColumns({PART: F.spark_partition_id(), SEQ: F.monotonically_increasing_id(), KEY: key}), "scan")


def scan(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], *, number: str | None = None,
         first: dict[str, str] | None = None, previous: dict[str, str] | None = None,
         following: dict[str, str] | None = None, running: dict[str, str] | None = None,
         frames: dict[str, tuple[str, int]] | None = None, parts: int | None = None) -> DataFrame:
    """``df`` with columns that depend on a row's place among the rows of its ``keys``.

    ``number`` counts from 1. ``first``, ``previous`` and ``following`` map an output to the
    column whose value it takes from the key's first row and from the neighbours (NULL past the
    ends). ``running`` maps an output to the numeric column it sums up to and with the row; NULLs
    add nothing, and a sum of NULLs only is 0. ``frames`` maps an output to (column, rows): an
    array of structs ``v`` of that column over the ``rows - 1`` rows before and the row itself.

    NULL is a key like any other; with no ``keys`` all rows are one sequence. Each row of ``df``
    gives one row.
    """
    first, previous, following, running, frames = (x or {} for x in (first, previous, following, running, frames))
    dealt = placed(df, keys, order, parts)
    inside = Window.partitionBy(*SEGMENT).orderBy(SEQ)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    across = Window.partitionBy(KEY).orderBy(PART)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)

    ends = dealt.groupBy(PART).agg(F.min_by(KEY, SEQ).alias("low"), F.max_by(KEY, SEQ).alias("high"))
    edges = ends.select(PART, F.explode(F.array_distinct(F.array("low", "high"))).alias(KEY))
    edge_rows = dealt.join(F.broadcast(edges), SEGMENT)
    values = sorted({*first.values(), *previous.values(), *following.values()})
    carries = edge_rows.groupBy(*SEGMENT).agg(
        F.count("*").alias("_rows"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(f"_sum_{o}") for o, c in running.items()],
        *[F.min_by(F.struct(F.col(c).alias("v")), SEQ).alias(f"_low_{c}") for c in values],
        *[F.max_by(F.struct(F.col(c).alias("v")), SEQ).alias(f"_high_{c}") for c in values])
    carried = carries.select(
        *SEGMENT, F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_before"),
        *[F.coalesce(F.sum(f"_sum_{o}").over(earlier), F.lit(0)).alias(f"_run_{o}") for o in running],
        *[F.first(f"_low_{c}").over(across).alias(f"_first_{o}") for o, c in first.items()],
        *[F.lag(f"_high_{c}").over(across).alias(f"_prev_{o}") for o, c in previous.items()],
        *[F.lead(f"_low_{c}").over(across).alias(f"_next_{o}") for o, c in following.items()])
    for out, (column, rows) in frames.items():
        carried = carried.join(_tails(edge_rows, column, rows, across, f"_tail_{out}"), SEGMENT)

    one = {c: F.struct(F.col(c).alias("v")) for c in {*values, *[c for c, _ in frames.values()]}}
    local = {"_n": F.row_number().over(inside)} if number else {}
    local |= {f"_own_{o}": F.coalesce(F.sum(c).over(upto), F.lit(0)) for o, c in running.items()}
    local |= {f"_start_{o}": F.first(one[c]).over(upto) for o, c in first.items()}
    local |= {f"_lag_{o}": F.lag(one[c]).over(inside) for o, c in previous.items()}
    local |= {f"_lead_{o}": F.lead(one[c]).over(inside) for o, c in following.items()}
    local |= {f"_near_{o}": F.collect_list(one[c]).over(inside.rowsBetween(1 - k, 0)) for o, (c, k) in frames.items()}
    found = dealt.withColumns(local).join(F.broadcast(carried), SEGMENT, "left")

    final: dict[str, Column] = {}
    if number:
        final[number] = F.col("_n") + F.coalesce("_before", F.lit(0))
    for o in running:
        final[o] = F.col(f"_own_{o}") + F.coalesce(f"_run_{o}", F.lit(0))
    for o in first:
        final[o] = F.coalesce(f"_first_{o}", f"_start_{o}")["v"]
    for o in previous:
        final[o] = F.coalesce(f"_lag_{o}", f"_prev_{o}")["v"]
    for o in following:
        final[o] = F.coalesce(f"_lead_{o}", f"_next_{o}")["v"]
    for o, (_, k) in frames.items():
        whole = F.concat(F.coalesce(F.col(f"_tail_{o}"), F.array().cast(f"array<{_kind(df, frames[o][0])}>")), F.col(f"_near_{o}"))
        final[o] = F.slice(whole, F.greatest(F.size(whole) - k, F.lit(0)) + 1, k)
    return found.select(*df.columns, *[c.alias(o) for o, c in final.items()])


def _kind(df: DataFrame, column: str) -> str:
    return f"struct<v:{df.schema[column].dataType.simpleString()}>"


def _tails(edge_rows: DataFrame, column: str, rows: int, across, out: str) -> DataFrame:
    """For each carry segment the last ``rows - 1`` values of its key before it."""
    last = F.max(SEQ).over(Window.partitionBy(*SEGMENT))
    near = edge_rows.select(*SEGMENT, SEQ, F.struct(F.col(column).alias("v")).alias("_one"), last.alias("_last")).where(
        F.col("_last") - F.col(SEQ) < rows - 1)
    # A segment has a row at least, so that many segments before it hold enough.
    own = near.groupBy(*SEGMENT).agg(F.array_sort(F.collect_list(F.struct(SEQ, "_one"))).alias("_own"))
    before = F.flatten(F.collect_list("_own").over(across.rowsBetween(1 - rows, -1)))
    kept = own.withColumn("_all", before)
    last_ones = F.slice("_all", F.greatest(F.size("_all") - (rows - 1), F.lit(0)) + 1, rows - 1)
    return kept.select(*SEGMENT, F.transform(last_ones, lambda x: x["_one"]).alias(out))
