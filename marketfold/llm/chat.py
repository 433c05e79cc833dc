"""Chat formatting with minimum-cost role repair.

A legal conversation is an optional system turn followed by user and assistant in turns, from
a user to an assistant. Its automaton has a state for the role of the last turn. Each
given turn may be kept, merged into a turn of its role before it, relabelled, or preceded by
empty turns, each at a cost; dynamic programming finds the cheapest way from the start
to an assistant's turn. A stretch of turns is a matrix of the cheapest costs between
states, and matrices multiply, so long conversations are cut into blocks of ``BLOCK`` rows,
whatever their turn numbers: rows are dealt by range of conversation and order, counted along
each range, and the counts of a range's first conversation go on from the ranges before. Blocks become matrices in parallel, one small row each; a pass over the blocks of a
conversation fixes the states between them; then blocks are repaired in parallel. The
repaired turns are rendered one per row; joined in order they are the conversation.

Defined results: turns go by number (null last), equal numbers by role and text (null first,
as empty). A null text is empty. Roles other than the three are no role and are relabelled
at a lower cost. Repeated rows are turns of their own. Rows with a null conv_id are one
conversation. Ties in cost go to the first of keep, merge, relabel, insert. ``<|`` inside
a text becomes ``< |``, so that no text can open a turn.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import save

BLOCK = 256
ROLES = ["system", "user", "assistant"]
START, SYSTEM, USER, ASSISTANT = range(4)  # states; a role's state is its place + 1
STATES = 4
LEGAL = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, NAME, INSERT = 1.0, 2.0, 1.5, 3.0  # costs; NAME: giving a role to a turn without one
FAR = 1e18


def inserts() -> dict[tuple[int, int], list[int]]:
    """Shortest runs of empty turns that make each state legal after each other one."""
    found = {(s, s): [] for s in range(STATES)}
    paths = [[s] for s in range(STATES)]
    while paths:
        longer = [p + [t] for p in paths for t in LEGAL[p[-1]] if (p[0], t) not in found or t == p[0] and len(p) > 1]
        for p in longer:
            found.setdefault((p[0], p[-1]), p[1:])
        paths = [p for p in longer if found[p[0], p[-1]] == p[1:] and p[0] != p[-1]]
    return found


PATHS = inserts()  # (from, to): the states passed, the last included


def moves(role: int) -> list[tuple[int, int, float, str, list[int]]]:
    """(from, to, cost, action, inserted turns) for a turn of a role: 0 none, 1 .. 3."""
    found = []
    for at, new in product(range(STATES), (SYSTEM, USER, ASSISTANT)):
        change = 0.0 if new == role else RELABEL if role else NAME
        if at == new:
            found.append((at, new, change + MERGE, "merge" if not change else "relabel+merge", []))
        for before in range(STATES):  # the state after the inserted turns
            if new in LEGAL[before] and (at, before) in PATHS:
                empty = PATHS[at, before]
                action = ("relabel" if change else "keep") if not empty else ("insert+relabel" if change else "insert")
                found.append((at, new, change + INSERT * len(empty), action, empty))
    return found


def _rank(action: str) -> int:
    return ["keep", "merge", "relabel", "relabel+merge", "insert", "insert+relabel"].index(action)


# The best move of each role between each two states.
BEST: list[dict[tuple[int, int], tuple[float, str, list[int]]]] = []
for _role in range(STATES):
    _table: dict = {}
    for _at, _to, _cost, _action, _empty in sorted(moves(_role), key=lambda m: (m[2], _rank(m[3]))):
        _table.setdefault((_at, _to), (_cost, _action, _empty))
    BEST.append(_table)
COST = np.full((STATES, STATES, STATES), FAR)
for _role, _table in enumerate(BEST):
    for (_at, _to), (_cost, _, _) in _table.items():
        COST[_role, _at, _to] = _cost
CLOSE = np.array([0.0] + [INSERT * len(PATHS[s, ASSISTANT]) if s != ASSISTANT else 0.0 for s in range(1, STATES)])


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The min-plus product."""
    return np.minimum((a[:, :, None] + b[None, :, :]).min(axis=1), FAR)


def unit() -> np.ndarray:
    return np.where(np.eye(STATES, dtype=bool), 0.0, FAR)


def matrix(roles: list[int]) -> np.ndarray:
    found = unit()
    for r in roles:
        found = times(found, COST[r])
    return found


def repair(roles: list[int], first: int, last: int) -> list[tuple[int, str, list[int], float]]:
    """(state, action, inserted, cost) of each turn on the cheapest way from state to state."""
    costs = [np.where(np.arange(STATES) == first, 0.0, FAR)]
    for r in roles:
        costs.append((costs[-1][:, None] + COST[r]).min(axis=0))
    steps, state = [], last
    for i in range(len(roles) - 1, -1, -1):
        total = costs[i] + COST[roles[i]][:, state]
        at = int(total.argmin())
        cost, action, empty = BEST[roles[i]][at, state]
        steps.append((state, action, empty, cost))
        state = at
    return steps[::-1]


def _groups(batches, names: list[str]):
    """(key, rows) of sorted rows; a row is a tuple of the columns, the key its first two."""
    key, held = None, []
    for batch in batches:
        for row in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)):
            if row[:2] != key:
                if held:
                    yield key, held
                key, held = row[:2], []
            held.append(row)
    if held:
        yield key, held


def _counted(batches):
    """The rows of a range with its number and their place, from 0, in their conversation's part of it."""
    part, conv, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for c in batch.column(batch.schema.get_field_index("conv")).to_pylist():
            conv, n = c, n + 1 if c == conv else 0
            places.append(n)
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array([part] * len(places), pa.int32()), pa.array(places, pa.int64())],
            names=[*batch.schema.names, "part", "within"])


def in_blocks(turns: DataFrame) -> DataFrame:
    """``turns`` with block and seat: their row number in the conversation over ``BLOCK``, and the rest.

    Only the first and last conversation of a range can go on in another one; the table of their
    counts, at most two rows per range, goes to every task.
    """
    order = ["conv", F.col("turn").asc_nulls_last(), "role", "text", "tie"]
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The tie number lets equal rows spread over ranges.
    tied = turns.withColumn("tie", F.monotonically_increasing_id())
    dealt = tied.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("tie")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in turns.schema.fields)
    counted = save(dealt.mapInArrow(_counted, f"{kinds}, part int, within long"), "turns")
    ends = counted.groupBy("part").agg(F.min("conv").alias("low"), F.max("conv").alias("high"))
    edges = ends.select("part", F.explode(F.array_distinct(F.array("low", "high"))).alias("conv"))
    sizes = counted.join(F.broadcast(edges), ["part", "conv"]).groupBy("part", "conv").agg(F.count("*").alias("size"))
    earlier = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("part", "conv", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before"))
    number = F.col("within") + F.coalesce("before", F.lit(0))
    return counted.join(F.broadcast(before), ["part", "conv"], "left").select(
        *turns.columns, F.floor(number / BLOCK).cast("long").alias("block"), (number % BLOCK).cast("int").alias("seat"))


def _tables(rows, names, kinds, size=4096):
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _matrices(batches):
    def rows():
        for (conv, block), turns in _groups(batches, ["conv", "block", "role_no"]):
            yield conv, block, matrix([t[2] for t in turns]).ravel().tolist()
    yield from _tables(rows(), ["conv", "block", "costs"], [pa.string(), pa.int64(), pa.list_(pa.float64())])


def _between(batches):
    """States at both ends of each block of a conversation."""
    def rows():
        current, blocks = None, []
        for batch in batches:
            for conv, block, costs in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != current and blocks:
                    yield from settle(current, blocks)
                    blocks = []
                current = conv
                blocks.append((block, np.array(costs).reshape(STATES, STATES)))
        if blocks:
            yield from settle(current, blocks)

    def settle(conv, blocks):
        at = [np.where(np.arange(STATES) == START, 0.0, FAR)]
        for _, m in blocks:
            at.append(np.minimum((at[-1][:, None] + m).min(axis=0), FAR))
        state, out = int((at[-1] + CLOSE).argmin()), []
        for i in range(len(blocks) - 1, -1, -1):
            before = int((at[i] + blocks[i][1][:, state]).argmin())
            out.append((conv, blocks[i][0], before, state, i == len(blocks) - 1))
            state = before
        yield from reversed(out)

    yield from _tables(rows(), ["conv", "block", "first", "last", "final"],
                       [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()])


OUT = ["conv", "conv_id", "turn", "block", "place", "role", "action", "cost", "rendered"]
OUT_KINDS = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.string()]


def render(role: int, text: str, first: bool) -> str:
    return f"{'' if first else '<|end|>'}<|{ROLES[role - 1]}|>{text}"


def _repaired(batches):
    def rows():
        names = ["conv", "block", "role_no", "first", "last", "final", "conv_id", "turn", "text"]
        for (conv, block), turns in _groups(batches, names):
            state, place = turns[0][3], 0
            last = len(turns) - 1
            for i, (turn, (to, action, empty, cost)) in enumerate(zip(turns, repair([t[2] for t in turns], turns[0][3], turns[0][4]))):
                conv_id, number, text = turn[6], turn[7], (turn[8] or "").replace("<|", "< |")
                for e in empty:
                    yield conv, conv_id, number, block, place, ROLES[e - 1], "empty", INSERT, render(e, "", state == START)
                    state, place = e, place + 1
                merged = action.endswith("merge")
                out = "\n" + text if merged else render(to, text, state == START)
                state = to
                closing = PATHS[to, ASSISTANT] if i == last and turn[5] and to != ASSISTANT else []
                end = "<|end|>" if i == last and turn[5] and not closing else ""
                yield (conv, conv_id, number, block, place, ROLES[to - 1], action.removeprefix("insert+").replace("insert", "keep"),
                       cost - INSERT * len(empty), out + end)
                place += 1
                for k, e in enumerate(closing):
                    end = "<|end|>" if k == len(closing) - 1 else ""
                    yield conv, conv_id, number, block, place, ROLES[e - 1], "empty", INSERT, render(e, "", False) + end
                    place += 1
    yield from _tables(rows(), OUT, OUT_KINDS)


def formatted(turns: DataFrame) -> DataFrame:
    """One row per turn of the repaired conversations: conv_id, turn (of the given turn it is, or
    stands next to), block and place (the order), role, action, cost and the rendered text."""
    number = F.col("turn").cast("long")
    role = F.coalesce(sum((F.when(F.col("role") == r, i + 1).otherwise(0) for i, r in enumerate(ROLES)), F.lit(0)), F.lit(0))
    base = turns.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), F.col("conv_id").cast("long").alias("conv_id"),
        number.alias("turn"), role.cast("int").alias("role_no"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    base, order = in_blocks(base), ["conv", "block", "seat"]
    dealt = base.select(*order, "role_no").repartition("conv", "block").sortWithinPartitions(*order)
    matrices = save(dealt.select("conv", "block", "role_no").mapInArrow(_matrices, "conv string, block long, costs array<double>"), "matrices")
    states = matrices.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(
        _between, "conv string, block long, first int, last int, final boolean")
    joined = base.join(save(states, "states"), ["conv", "block"]).repartition("conv", "block").sortWithinPartitions(*order)
    kinds = "conv string, conv_id long, turn long, block long, place long, role string, action string, cost double, rendered string"
    return joined.select("conv", "block", "role_no", "first", "last", "final", "conv_id", "turn", "text").mapInArrow(
        _repaired, kinds).drop("conv")
