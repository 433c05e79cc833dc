"""Text keys, blank tests and the street/unit address split."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))


def has_text(*columns: Column) -> Column:
    """1 when any of the texts holds something besides spaces, else 0."""
    filled = F.lit(False)
    for c in columns:
        filled = filled | blank_to_null(c).isNotNull()
    return F.when(filled, F.lit(1)).otherwise(F.lit(0))


def sanitize_zip(c: Column, n: int = 5) -> Column:
    return F.trim(F.substring(c.cast("string"), 1, n))


def empty_as_key(c: Column) -> Column:
    """Key form in which a missing text equals a missing text."""
    return F.coalesce(c, F.lit(""))


def listing_key(url: Column) -> Column:
    return F.md5(url)


def natural_key(*columns: Column) -> Column:
    """md5 over the parts, each with its length before it; a missing part is ``~``."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.char_length(t).cast("string"), F.lit(":"), t), F.lit("~")) for t in texts]
    return F.md5(F.concat_ws("|", *parts))


def row_name(*columns: Column) -> Column:
    """16 bytes that name the values of a row: two 64-bit hashes of the values and of which are missing.

    For joins inside a job. The values are hashed as they are; making texts of numbers and md5 of those takes
    three times as long.
    """
    missing = [c.isNull() for c in columns]
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns, *missing)), 16, "0") for seed in (1, 2)]
    return F.unhex(F.concat(*halves))


@dataclass(frozen=True)
class AddressRules:
    """How one city splits an address line.

    ``markers`` are tried in order: when the first text of a pair occurs, the line is
    cut at the first occurrence of the second text. ``keep`` is the class of
    characters the street part may hold.
    """

    markers: tuple[tuple[str, str], ...]
    keep: str


# Unit markers in priority order and the characters a street keeps.
STRICT = AddressRules(
    markers=(("Unit ", "Unit"), ("Apt ", "Apt"), ("Ste ", "Ste "), ("Ph ", "Ph "), ("Fl ", "Fl "), ("#", "#")),
    keep=r"a-zA-Z0-9\s.'",
)
LOOSE = AddressRules(
    markers=(("Unit", "Unit"), ("Apt", "Apt"), ("Ste ", "Ste "), ("Ph ", "Ph "), ("Fl ", "Fl "), ("#", "#")),
    keep=r"a-zA-Z0-9\s",
)
UNIT_PREFIX = r"(?i)(^|\s)(Apt|Unit|Ste|Ph|Fl|#)\s*"


def _listed(keep: str) -> str:
    """A class of characters with its ranges written out.

    Java looks single characters up in a table, but tests a range by a chain of calls per character.
    """
    if re.search(r"\\[^s]", keep):
        return keep
    return re.sub("([0-9A-Za-z])-([0-9A-Za-z])", lambda m: "".join(map(chr, range(ord(m[1]), ord(m[2]) + 1))), keep)


def _split_sql(arg: str, rules: AddressRules) -> tuple[str, str]:
    """SQL text of the street and the unit part of ``arg``."""
    whens = " ".join(f"when instr({arg}, '{seen}') > 0 then instr({arg}, '{cut}')" for seen, cut in rules.markers)
    at = f"(case {whens} else 0 end)"
    street = f"case when {at} = 0 then {arg} else substring({arg}, 1, {at} - 1) end"
    unit = f"case when {at} > 0 then substring({arg}, {at}) end"
    return (
        f'lower(trim(regexp_replace({street}, r"[^{_listed(rules.keep)}]", "")))',
        f'lower(trim(regexp_replace({unit}, r"{UNIT_PREFIX}", "")))',
    )


def split_address(df: DataFrame, column: str, rules: AddressRules, street: str = "address_line_1",
                  unit: str = "address_line_2") -> DataFrame:
    """Add the normalized street and unit part of ``column``."""
    first, second = _split_sql(f"`{column}`", rules)
    return df.withColumns({street: F.expr(first), unit: F.expr(second)})


def register_split_address(spark: SparkSession, name: str, rules: AddressRules) -> None:
    """The same split as a SQL table function for ``FROM t, LATERAL name(t.address)``."""
    first, second = _split_sql("full_address", rules)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(full_address STRING) "
        f"RETURNS TABLE (address_line_1 STRING, address_line_2 STRING) "
        f"RETURN SELECT {first}, {second}"
    )
