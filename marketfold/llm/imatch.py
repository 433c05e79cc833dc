"""I-Match fingerprints: hashes of a text's terms inside randomised lexicons.

A term is a lower-cased run of letters and digits. The lexicon is the set of terms whose
document frequency lies in a band: terms in more than ``MOST`` of all texts say little, terms
in fewer than ``LEAST`` of them break with every edit. A text has at most as many of these as
its distinct terms, so the lexicon has at most (mean distinct terms) / LEAST entries however
large the corpus; that many 64-bit term names go to each task.

A text's distinct lexicon terms are sorted, and hashed once whole and once for each of
``SUBSETS`` random subsets of the lexicon on each of ``LEVELS`` levels, which keep a quarter,
a sixteenth, ... of it. A text without lexicon terms uses all its terms. Likeness is 1 if the
whole hashes agree; else the largest share, over the levels, of subset hashes that agree
among those that are not empty for both, of ``SUBSETS`` at least a half. Everything is
built-in expressions.

Defined results: null counts as empty; empty texts and texts without terms have the same
fingerprint, and are like each other only. Rows that share a doc_id have the same next
document; a null doc_id comes after all others and has no next document. Of several rows
with the next id, the least text stands for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import save

LEAST, MOST = 0.01, 0.2
LEVELS, SUBSETS = 4, 8
SEED = 20240229
HEX = 8  # digits of a subset's hash


def terms(text) -> F.Column:
    """Names of the distinct terms."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w, F.lit(SEED)))


def lexicon(docs: DataFrame) -> DataFrame:
    """(term, frequency) inside the band, over all texts of ``docs``."""
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("frequency"))
    total = docs.agg(F.count("*").alias("texts"))
    share = F.col("frequency") / total.scalar()
    return counts.where((share >= LEAST) & (share <= MOST))


def with_fingerprint(docs: DataFrame, text: str, name: str, known) -> DataFrame:
    """``docs`` with hex hashes of all lexicon terms, then of each subset; zeros for an empty one.

    Each step is a projection of its own, so that what later steps use often is made once.
    """
    steps = docs.withColumn("__own", terms(F.col(text))).withColumn("__inside", F.array_intersect("__own", known))
    steps = steps.withColumn("__values", F.array_sort(F.when(F.size("__inside") > 0, F.col("__inside")).otherwise(F.col("__own"))))
    levels = {level: min(SUBSETS, 4 ** level) for level in range(1, LEVELS + 1)}
    steps = steps.withColumns({
        f"__{level}": _picked(F.col("__values"), level, 0, count) for level, count in levels.items()})
    parts = [_hash(F.col("__values"))]
    for level, count in levels.items():
        parts += [_hash(_picked(F.col(f"__{level}"), level, s, s + 1)) for s in range(count)]
    return steps.withColumn(name, F.concat(*parts)).drop("__own", "__inside", "__values", *[f"__{k}" for k in levels])


def _picked(values, level: int, first: int, last: int) -> F.Column:
    """The terms in subsets first .. last - 1 of a level: subset s has those whose bits are s."""
    def inside(term):
        bits = F.shiftrightunsigned(term, 8 * level).bitwiseAND(4 ** level - 1)
        return (bits >= first) & (bits < last)
    return F.filter(values, inside)


def _hash(values) -> F.Column:
    found = F.substring(F.lpad(F.lower(F.hex(F.xxhash64(values))), 16, "0"), 17 - HEX, HEX)
    return F.when(F.size(values) > 0, found).otherwise("0" * HEX)


def likeness(a, b) -> F.Column:
    """Of two fingerprints, 0 to 1."""
    shares, at = [], HEX + 1
    for level in range(1, LEVELS + 1):
        count = min(SUBSETS, 4 ** level)
        agree = both = F.lit(0)
        for _ in range(count):
            x, y = F.substring(a, at, HEX), F.substring(b, at, HEX)
            agree += ((x == y) & (x != "0" * HEX)).cast("int")
            both += ((x != "0" * HEX) | (y != "0" * HEX)).cast("int")
            at += HEX
        shares.append(agree / F.greatest(both, F.lit(count // 2)))
    whole = F.substring(a, 1, HEX) == F.substring(b, 1, HEX)
    return F.when(whole, 1.0).when(a.isNull() | b.isNull(), 0.0).otherwise(F.greatest(*shares))


def neighbours(docs: DataFrame) -> DataFrame:
    """(doc_id, next_id, previous_id, previous_chars) of the distinct ids in ascending order; the
    last is followed by the first. Ids are dealt out by range, so no task sees them all."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.max("n_chars").alias("n"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = save(ids.repartitionByRange(parts, "doc_id").withColumn("part", F.spark_partition_id()), "ids")
    inside = Window.partitionBy("part").orderBy("doc_id")
    ordered = ranged.withColumn("next_id", F.lead("doc_id").over(inside)).withColumn(
        "previous_id", F.lag("doc_id").over(inside)).withColumn("previous_n", F.lag("n").over(inside))
    # One row per range: its ends, and those of the ranges around it.
    ends = ranged.groupBy("part").agg(F.min("doc_id").alias("first"), F.max(F.struct("doc_id", "n")).alias("last"))
    all_ = Window.partitionBy(F.lit(0))
    order = all_.orderBy("part")
    ends = ends.select(
        "part", F.coalesce(F.lead("first").over(order), F.min("first").over(all_)).alias("after"),
        F.coalesce(F.lag("last").over(order), F.max("last").over(all_)).alias("before"))
    return ordered.join(ends, "part").select(
        "doc_id", F.coalesce("next_id", "after").alias("next_id"),
        F.coalesce("previous_id", F.col("before.doc_id")).alias("previous_id"),
        F.coalesce("previous_n", F.col("before.n")).alias("previous_n"))


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited versions, whose last quarter gives way to the
    beginning of the next document; likeness of the text to the edited one and to the next."""
    # An alias that changes nothing is kept in one copy of a plan only, and would keep exchanges apart.
    number = F.col("doc_id") if docs.schema["doc_id"].dataType == T.LongType() else F.col("doc_id").cast("long").alias("doc_id")
    base = docs.select(number, F.coalesce("text", F.lit("")).alias("text"))
    known = save(lexicon(base), "lexicon").agg(F.sort_array(F.collect_list("term")).alias("terms")).scalar()
    around = save(neighbours(base.withColumn("n_chars", F.char_length("text").cast("long"))), "neighbours")
    # Both uses of the marked texts have the same columns and filters: one exchange serves them.
    named = with_fingerprint(base.where("doc_id is not null"), "text", "fingerprint", known)
    heads = named.join(around.select("doc_id", "previous_id", "previous_n"), "doc_id").groupBy("previous_id").agg(F.min(F.struct(
        F.expr("substring(text, 1, cast(previous_n div 4 as int))").alias("head"), "fingerprint")).alias("next"))
    joined = named.join(heads.withColumnRenamed("previous_id", "doc_id"), "doc_id", "left")
    joined = joined.select("doc_id", "text", "fingerprint", F.col("next.head").alias("head"), F.col("next.fingerprint").alias("following"))
    alone = with_fingerprint(base.where("doc_id is null"), "text", "fingerprint", known).withColumns(
        {"head": F.lit(None).cast("string"), "following": F.lit(None).cast("string")})
    both = joined.unionByName(alone).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.expr("cast(n_chars div 4 as int)")
    edited = F.concat(F.expr("substring(text, 1, cast(n_chars - n_chars div 4 as int))"),
                      F.substring(F.coalesce(F.col("head"), F.lit("")), F.lit(1), cut))
    return with_fingerprint(both.withColumn("edited", edited), "edited", "edited_fingerprint", known).select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("following")).alias("near_next"))
