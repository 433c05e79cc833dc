"""Merkle dataset manifest: a hash tree per language over the documents, and one over their roots.

The leaves of a tree are numbered by range partitions (``operators.scan``) and cut into
superblocks of 2 ** ``BITS`` leaves, aligned to the tree. Going up, a superblock is reduced to its
top node, tops are numbered within their tree and cut again, until each tree has one node. Going
down, each superblock is cogrouped with its outer nodes: the siblings on the way from its top
to the root. One ``applyInPandas`` call per superblock then finishes the local reduction, joins
local and outer siblings into the proofs, and folds tampered leaves to a root. No task holds
more than a superblock and a path, which has one node per level.

H is the lower-case hex SHA-256 of its inputs, concatenated as UTF-8. Each ``FAN`` consecutive
nodes become one; a last run may be shorter, and a single node there is hashed alone.

Defined results: leaves with equal doc_id ascend by leaf; a null doc_id comes first, and is never
tampered with, as it has no decimal form. Repeated rows are leaves of their own. An empty
table has no rows. A null lang is a language of its own, before all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketfold.operators.scan import scan

from .common import crc_of_id, save

BITS = 10  # levels of a superblock: it has 2 ** BITS nodes
FAN = 2
WHOLE = -1  # levels of a tree inside one superblock: as many as lead to one node
TAMPERED = 7  # documents whose crc32 this number divides
OUTER = "tree string, block long, top string, root string, outer array<struct<place:int,other:string>>"


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def framed(column: Column) -> Column:
    """`-` for null, else the byte count, a colon and the value."""
    text = column.cast("string")
    return F.when(column.isNull(), "-").otherwise(F.concat(F.octet_length(text), F.lit(":"), text))


def leaf(n_chars: Column) -> Column:
    return F.sha2(F.concat(*[framed(F.col(c)) for c in ("doc_id", "source", "lang")], framed(n_chars), framed(F.col("text"))), 256)


def reduce_block(nodes: list[str], levels: int) -> list[list[str]]:
    """All levels over ``nodes``: ``levels`` of them, or up to a single node where that is WHOLE."""
    found = [nodes]
    while len(found) <= levels if levels != WHOLE else len(found[-1]) > 1:
        last = found[-1]
        found.append([digest(*last[i:i + FAN]) for i in range(0, len(last), FAN)])
    return found


def path(levels: list[list[str]], place: int) -> list[tuple[int, str | None]]:
    """(place in its run, sibling) per level; None where the run has one node."""
    found = []
    for level in levels[:-1]:
        other = place ^ 1
        found.append((place & 1, level[other] if other < len(level) else None))
        place >>= 1
    return found


def fold(node: str, steps: Iterable[tuple[int, str | None]]) -> str:
    for at, other in steps:
        node = digest(node) if other is None else digest(other, node) if at else digest(node, other)
    return node


def _tops(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("place")
    levels = reduce_block(pdf["node"].tolist(), int(pdf["levels"].iloc[0]))
    first = pdf.iloc[0]
    return pd.DataFrame({"tree": [first["tree"]], "place": [first["block"]], "node": [levels[-1][0]]})


def _descend(nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """The outer nodes of each node of a superblock, from those of the superblock."""
    nodes = nodes.sort_values("place")
    levels = reduce_block(nodes["node"].tolist(), int(nodes["levels"].iloc[0]))
    above = outer.iloc[0]
    beyond = [(s["place"], s["other"]) for s in above["outer"]]
    paths = [path(levels, i) + beyond for i in range(len(nodes))]
    return pd.DataFrame({
        "tree": nodes["tree"].tolist(), "block": nodes["place"].tolist(), "top": above["top"], "root": above["root"],
        "outer": [[{"place": p, "other": o} for p, o in steps] for steps in paths]})


PROOF = ("doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, "
         "siblings long")


def _prove(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    leaves = leaves.sort_values("place")
    levels = reduce_block(leaves["node"].tolist(), int(leaves["levels"].iloc[0]))
    above = outer.iloc[0]
    beyond = [(s["place"], s["other"]) for s in above["outer"]]
    proofs, folded, counts = [], [], []
    for i, changed in enumerate(leaves["changed"]):
        steps = path(levels, i) + beyond
        others = [o for _, o in steps if o is not None]
        proofs.append(digest(*others))
        counts.append(len(others))
        folded.append(fold(changed, steps))
    return pd.DataFrame({
        "doc_id": leaves["doc_id"].astype("Int64"), "leaf": leaves["node"], "subroot": above["top"], "root": above["root"],
        "proof_sha256": proofs, "folded_root": folded, "verified": [f == above["root"] for f in folded], "siblings": counts})


def _cut(nodes: DataFrame, bits: int) -> DataFrame:
    """Nodes (tree, place, ...) with their superblock and its levels."""
    sizes = nodes.groupBy("tree").agg(F.when(F.max("place") < 1 << bits, WHOLE).otherwise(bits).alias("levels"))
    return nodes.join(sizes, "tree").withColumn("block", F.shiftright("place", bits))


def _reduced(nodes: DataFrame) -> DataFrame:
    return nodes.select("tree", "place", "node", "levels", "block").groupBy("tree", "block").applyInPandas(
        _tops, "tree string, place long, node string")


def climb(nodes: DataFrame, bits: int) -> list[DataFrame]:
    """Rounds of (tree, place, node, levels, block), from the given nodes to one superblock per tree."""
    rounds = [save(_cut(nodes, bits), "round")]
    while rounds[-1].where(F.col("levels") != WHOLE).limit(1).count():
        rounds.append(save(_cut(save(_reduced(rounds[-1]), "tops"), bits), "round"))
    return rounds


def _down(rounds: list[DataFrame], outer: DataFrame) -> DataFrame:
    """Outer nodes of the superblocks of the first round, from those of whole trees."""
    for nodes in reversed(rounds[1:]):
        outer = save(nodes.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(_descend, OUTER), "outer")
    return outer


def manifest(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per document: leaf, subroot, root, proof hash, and the root folded from the tampered leaf."""
    tampered = F.col("doc_id").isNotNull() & (F.pmod(crc_of_id(), F.lit(TAMPERED)) == 0)
    chars = F.col("n_chars").cast("long")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "n_chars", "text")
    # Without a language the name is empty, with one it begins with a mark: null sorts first.
    leaves = save(base.select(
        F.coalesce(F.concat(F.lit("="), F.col("lang")), F.lit("")).alias("tree"), "doc_id", leaf(F.col("n_chars")).alias("node"),
        F.when(tampered, leaf(chars + 1)).alias("other")), "leaves")
    placed = scan(leaves, ["tree"], [F.asc_nulls_first("doc_id"), "node"], number="place").select(
        "tree", (F.col("place") - 1).alias("place"), "doc_id", "node", F.coalesce("other", "node").alias("changed"))
    rounds = climb(save(placed, "places"), bits)
    subroots = save(_reduced(rounds[-1]).select("tree", "node"), "subroots")

    # The subroots are the nodes of one more tree, named by no language.
    ranks = scan(subroots, [], ["tree"], number="place").select(
        F.lit("").alias("tree"), (F.col("place") - 1).alias("place"), "node", F.col("tree").alias("name"))
    upper = climb(save(ranks, "ranks"), bits)
    root = save(_reduced(upper[-1]), "root").select(F.col("node").alias("root"))
    start = upper[-1].select("tree", "block").distinct().select(
        "tree", "block", F.lit("").alias("top"), root.scalar().alias("root"),
        F.array().cast("array<struct<place:int,other:string>>").alias("outer"))
    found = _down(upper, start)
    per_root = upper[0].groupBy("tree", "block").cogroup(found.groupBy("tree", "block")).applyInPandas(_descend, OUTER)
    # Outer nodes of a language's top superblock: those of its subroot.
    named = upper[0].select("tree", F.col("place").alias("block"), "name", "node").join(per_root, ["tree", "block"]).select(
        F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), F.col("node").alias("top"), "root", "outer")
    outer = _down(rounds, save(named, "outer"))
    return rounds[0].groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(_prove, PROOF)
