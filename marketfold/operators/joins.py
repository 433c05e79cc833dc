"""Joins beyond plain equality: tolerance bands, lookups, unmatched rows, scalars."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import within
from ..sources.sinks import stage


def band_join(left: DataFrame, right: DataFrame, equi: dict[str, str], bands: dict[tuple[str, str], float],
              widen: int = 8) -> DataFrame:
    """Inner join on equal keys and ``abs(left - right) <= tolerance`` per band.

    Each band also becomes an equality on a grid cell ``widen`` tolerances wide: a left
    row has one cell per band, a right row the one or two its tolerance reaches. A
    matching pair meets in exactly one cell, so nothing has to be removed afterwards,
    and rows that share one hot key (an empty street, say) are paired only with their
    neighbours instead of with every row of that key. Column names must not overlap.

    A hash of the keys is the first one, so that sorts compare numbers before texts that begin alike.
    """
    alike = [(l, r) for l, r in equi.items() if left.schema[l].dataType == right.schema[r].dataType]
    on = [F.col(l) == F.col(r) for l, r in equi.items()]
    helpers = []
    for i, ((l, r), tolerance) in enumerate(bands.items()):
        width = tolerance * widen
        reach = tolerance * 1.001
        value = F.col(r).cast("double")
        left = left.withColumn(f"_lc{i}", F.floor(F.col(l).cast("double") / width))
        right = right.withColumn(f"_rc{i}", F.explode(
            F.sequence(F.floor((value - reach) / width), F.floor((value + reach) / width))))
        on += [F.col(f"_lc{i}") == F.col(f"_rc{i}"), within(F.col(l), F.col(r), tolerance)]
        helpers += [f"_lc{i}", f"_rc{i}"]
    hashed = alike + [(f"_lc{i}", f"_rc{i}") for i in range(len(bands))]
    if hashed:
        on.insert(0, F.xxhash64(*[l for l, _ in hashed]) == F.xxhash64(*[r for _, r in hashed]))
    condition = on[0]
    for extra in on[1:]:
        condition = condition & extra
    return left.join(right, condition).drop(*helpers)


def unmatched(df: DataFrame, matched: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of ``df`` without a partner in ``matched``.

    Text keys go behind a hash: urls begin alike, so a sort by them alone compares them whole. It is
    computed where it is needed, not sent along.
    """
    texts = [c for c in on if isinstance(df.schema[c].dataType, T.StringType) and isinstance(matched.schema[c].dataType, T.StringType)]
    if not texts:
        return df.join(matched.select(*on), list(on), "left_anti")
    others = matched.select(*[F.col(c).alias(f"_m_{c}") for c in on])
    condition = F.xxhash64(*texts) == F.xxhash64(*[f"_m_{c}" for c in texts])
    for c in on:
        condition = condition & (F.col(c) == F.col(f"_m_{c}"))
    return df.join(others, condition, "left_anti")


def with_scalar(df: DataFrame, one_row: DataFrame, name: str) -> DataFrame:
    """Attach the single row of ``one_row`` as a struct column.

    Planned as a scalar subquery: it is computed once, never joined, and the job fails
    if it holds more than one row.
    """
    return df.withColumn(name, one_row.select(F.struct(*one_row.columns)).scalar())


def enrich_lookup(df: DataFrame, lookup: DataFrame, on: dict[str, str], out: Sequence[str]) -> DataFrame:
    """Left join of lookup columns. Spark broadcasts the lookup if its size allows it."""
    renamed = lookup.select(*[F.col(r).alias(f"_k_{r}") for r in on.values()], *out)
    condition = None
    for l, r in on.items():
        part = F.col(l) == F.col(f"_k_{r}")
        condition = part if condition is None else condition & part
    return df.join(renamed, condition, "left").drop(*[f"_k_{r}" for r in on.values()])


def union_by_name(frames: Sequence[DataFrame], fill_missing: bool = False) -> DataFrame:
    result = frames[0]
    for frame in frames[1:]:
        result = result.unionByName(frame, allowMissingColumns=fill_missing)
    return result


HEAVY_SHARE, HEAVY_LEAST = 0.001, 10_000


def heavy_keys(df: DataFrame, on: Sequence[str], share: float = HEAVY_SHARE, least: int = HEAVY_LEAST) -> DataFrame:
    """Keys with more than ``share`` of all rows (and more than ``least``), and ``_salts``, the number of
    parts that bring each below that. There are at most 1 / ``share`` of them, however large the table."""
    total = df.agg(F.count("*")).scalar()
    limit = F.greatest(total * F.lit(share), F.lit(float(least)))
    counts = df.groupBy(*on).agg(F.count("*").alias("_rows"))
    return counts.filter(F.col("_rows") > limit).select(*on, F.ceil(F.col("_rows") / limit).cast("int").alias("_salts"))


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", share: float = HEAVY_SHARE,
                least: int = HEAVY_LEAST) -> DataFrame:
    """Equi join whose heavy keys on the left are dealt over several tasks; ``how`` is inner or left.

    Keys are counted first. Rows of a heavy key get one of its salts in turn, and the right rows of
    those keys, only those, are repeated once per salt. ``left`` is read twice, so it should be a
    written step. The heavy keys, at most 1 / ``share``, are broadcast.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"a salted join is inner or left, not {how}")
    on = list(on)
    heavy = F.broadcast(stage(heavy_keys(left, on, share, least), "heavy"))
    turn = F.pmod(F.monotonically_increasing_id(), F.col("_salts"))
    salted = left.join(heavy, on, "left").withColumn("_salt", F.coalesce(turn, F.lit(0)).cast("int")).drop("_salts")
    repeated = right.join(heavy, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
