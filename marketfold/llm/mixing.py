"""Mixing sources to target weights by temperature, realised as block permutations.

A source with share p of the tokens gets the weight p**a / sum(p**a). The exponent a is
the smallest in [0, 1] (the flattest mixture) at which no source is repeated more than
``repeat`` times and the entropy of the weights is at most ``entropy`` times that of a
uniform mixture; it is found by bisection, four halvings for each distributed pass over
the source totals. The budget is the number of tokens at which the source used least
sparingly of all is still used once, so nothing is left out.

Each source's documents are dealt into blocks by a hash. In each epoch a source goes
through a permutation of its blocks, an affine map of the block numbers; its last epoch
stops with the block at which the source's budget is spent. The place of a block is the
share of its source's budget that lies before it, so every stretch of the mixture has
nearly the target weights. Hashes are taken from md5, so that other engines agree.

Defined results: a null source is a source of its own named ''. Tokens are words; null
and empty texts count 0 and are dealt like others, a source without tokens is used once.
Repeated rows are dealt each. Columns epoch, block and place are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

REPEAT = 2.0  # epochs over the tokens of any source, at most
ENTROPY = 1.0  # of the uniform mixture's entropy
BLOCK_TOKENS = 20_000
PASSES, CUTS = 6, 16
EXPONENT_DIGITS, WEIGHT_DIGITS = 4, 6


def tokens(text) -> F.Column:
    """Number of words."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", "     "))
    return F.size(F.filter(F.split(plain, " +"), lambda w: w != "")).cast("long")


def hashed(*parts) -> F.Column:
    """A number below 2**32 from the md5 of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")


def _mixtures(totals: DataFrame, exponents: list[float]) -> list:
    """For each exponent: the largest repetition at the budget, and the relative entropy."""
    grid = F.explode(F.array(*[F.lit(a) for a in exponents])).alias("a")
    p = F.col("tokens") / F.sum("tokens").over(Window.partitionBy(F.lit(0)))
    # The window spans one row per source; rows per source and exponent follow.
    part = totals.where("tokens > 0").select("tokens", p.alias("p")).select("p", grid)
    ratio = F.pow("p", F.col("a") - 1)
    return part.groupBy("a").agg(
        (F.max(ratio) / F.min(ratio)).alias("repeat"),
        F.sum(F.pow("p", "a")).alias("z"), F.sum(F.pow("p", "a") * F.log("p") * F.col("a")).alias("s"),
        F.count("*").alias("n")).select(
        "a", "repeat", ((F.log("z") - F.col("s") / F.col("z")) / F.greatest(F.log("n"), F.lit(1e-12))).alias("entropy")
    ).orderBy("a").collect()


def exponent(totals: DataFrame, repeat: float = REPEAT, entropy: float = ENTROPY) -> float:
    """The least exponent in [0, 1] that meets both limits; 1 where none does."""
    low, high = 0.0, 1.0
    for number in range(PASSES):
        cuts = [low + (high - low) * i / CUTS for i in range(CUTS + 1)]
        rows = _mixtures(totals, cuts)
        good = [r.a for r in rows if r.repeat <= repeat * (1 + 1e-12) and r.entropy <= entropy + 1e-9]
        if not rows:
            return 1.0
        at = cuts.index(min(good)) if good else CUTS
        if at == 0:
            return cuts[0]
        low, high = cuts[at - 1], cuts[at]
    scale = 10 ** EXPONENT_DIGITS
    return math.ceil(high * scale - 1e-3) / scale


def plan(docs: DataFrame, repeat: float = REPEAT, entropy: float = ENTROPY) -> DataFrame:
    """One row per source: tokens, docs, weight, budget, blocks, and the step of its permutations."""
    counted = docs.groupBy(F.coalesce("source", F.lit("")).alias("source_name")).agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    totals = save(counted, "sources")
    a = exponent(totals, repeat, entropy)
    everything = Window.partitionBy(F.lit(0))  # one row per source
    power = F.pow(F.col("tokens") / F.sum("tokens").over(everything), F.lit(a))
    powered = totals.withColumn("power", F.when(F.col("tokens") > 0, power))
    scaled = powered.withColumn("exact", F.col("power") / F.sum("power").over(everything))
    # The budget at which tokens * epochs = budget * weight with epochs of 1 for the scarcest use.
    unit = F.max(F.col("tokens") / F.col("exact")).over(everything)
    rounded = F.round("exact", WEIGHT_DIGITS)
    sized = scaled.withColumn("budget", F.greatest(F.floor(F.col("exact") * unit), F.col("tokens"))).withColumn(
        # Only what is reported is rounded, and a weight too small for the digits isn't.
        "weight", F.when(rounded > 0, rounded).otherwise(F.col("exact"))).withColumn(
        "blocks", F.least(F.greatest(F.ceil(F.col("tokens") / BLOCK_TOKENS), F.lit(1)), F.col("docs")))
    return sized.select("source_name", "tokens", "docs", "weight", F.coalesce("budget", F.lit(0)).cast("long").alias("budget"), "blocks")


def mix(docs: DataFrame, repeat: float = REPEAT, entropy: float = ENTROPY) -> DataFrame:
    """``docs`` with a row for each time a document is used: epoch, block and place (0 to 1)."""
    names = [c for c in docs.columns if c.lower() not in ("epoch", "block", "place")]
    slim = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), "doc_id", "source",
                       tokens(F.col("text")).alias("n_tokens"))
    sources = save(plan(slim.select("source", "n_tokens"), repeat, entropy), "plan")
    dealt = slim.withColumn("source_name", F.coalesce("source", F.lit(""))).join(sources, "source_name").withColumn(
        "block", F.pmod(hashed(F.lit("block"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.col("blocks")))
    # Epochs 0 .. full - 1 use every block; the last one uses blocks in permuted order while
    # fewer blocks than its share of the budget are out.
    full = F.floor(F.col("budget") / F.greatest("tokens", F.lit(1)))
    rest = F.when(F.col("tokens") > 0, F.col("budget") / F.col("tokens") - full).otherwise(0.0)
    last = F.round(rest * F.col("blocks")).cast("long")
    epochs = dealt.withColumn("full", F.greatest(full, F.lit(1))).withColumn("last", last).withColumn(
        "epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full"))))
    # Affine permutation: an odd multiplier made prime to the number of blocks by going to the
    # next power of two, with places beyond the blocks left out by order only.
    size = F.pow(F.lit(2), F.ceil(F.log2(F.col("blocks").cast("double")))).cast("long")
    step = 2 * F.pmod(hashed(F.lit("step"), F.col("source_name"), F.col("epoch")), F.lit(1 << 20)) + 1
    shift = F.pmod(hashed(F.lit("shift"), F.col("source_name"), F.col("epoch")), F.lit(1 << 20))
    order = F.pmod(F.col("block") * step + shift, size)
    ordered = epochs.withColumn("order", order).withColumn("size", size)
    used = ordered.where((F.col("epoch") < F.col("full")) |
                         (F.col("order") * F.col("blocks") < F.col("last") * F.col("size")))
    total = F.col("full") + F.col("last") / F.col("blocks")
    place = F.least((F.col("epoch") + F.col("order") / F.col("size")) / total, F.lit(1.0))
    return used.select("row", "source_name", "n_tokens", "weight", "epoch", "block", F.round(place, 9).alias("place"))


def schedule(docs: DataFrame) -> DataFrame:
    """doc_id, source, n_tokens, weight, epoch, block and place of each use, without texts."""
    used = mix(docs.select("doc_id", "source", "text"))
    return used.select(F.col("row.doc_id").alias("doc_id"), F.col("row.source").alias("source"), "n_tokens",
                       "weight", "epoch", "block", "place")


def mixed(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns, a row for each use, in no particular order: sort by place."""
    used = mix(docs)
    kept = [f.name for f in used.schema["row"].dataType.fields]
    return used.select(*[F.col(f"row.`{c}`").alias(c) for c in kept], "epoch", "block", "place")
