"""Prefix trie of conversations, with count-min screening of prefixes.

A prefix of a conversation is named by a running sum: each turn's SHA-256 is hashed again with
its depth, and four 32-bit lanes are added up along the conversation. Equal sequences have equal
sums, the sums fit a long up to 2**31 turns, and the scan that adds them splits a long conversation
over tasks. A node is (depth, 128 bits).

Screening: every prefix counts in two rows of a count-min sketch of ``width`` counters, made by an
aggregation; of the counters only "more than one" is kept, in bitmaps of 4 KB. The sketch never
counts too little, so a counter of one proves that a prefix belongs to one conversation: its node
is known where it stands (one member, one leaf, nothing saved) and is emitted from there. The first
node of such a tail only asks for its parent's name. Prefixes that may be shared are grouped
exactly; a false alarm costs a row in that shuffle, nothing else. The bitmaps have at most
2 * 2**``WIDEST`` bits (4 MB); beyond some 2**``WIDEST`` prefixes more singletons go the exact way.

Subtree sums need no walk over depths. A node is represented by its smallest member, and a
conversation that represents a node represents all deeper nodes on its way. So the leaves and savings
below a node are the sums, over its members, of what each represents, less what the node's own
representative has above it.

Defined results: turns go by number (null first), then role, then SHA-256 of role and text; repeated
rows are turns of their own. Null roles and texts are empty. Rows without conv_id belong to no
conversation. An empty table has no nodes, not even a root.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketfold.operators.scan import KEY, PART, SEQ, placed, scan

from .common import save

FAMILY, HEADS = 100, 6  # a conversation shares crc32 % HEADS first turns of the first one of its FAMILY
LANES = [f"lane{i}" for i in range(4)]
BITS = 15  # of a bitmap: 2**15 counters
WIDEST = 24
PIECE = 12  # 2**12 ids make one string
NODE = ["depth", "high", "low"]


def _lanes(hexed: Column) -> list[Column]:
    return [F.conv(F.substring(hexed, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(len(LANES))]


def _packed(a: Column, b: Column) -> Column:
    """Two sums modulo 2**32 in one long."""
    return F.shiftleft(a.bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(b.bitwiseAND(0xFFFFFFFF))


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, n, turn_hash, chars) of the given turns."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    hashed = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.sha2(F.concat(F.octet_length(role), F.lit(":"), role, text), 256).alias("turn_hash"), F.length(text).cast("long").alias("chars"))
    found = scan(save(hashed, "turns"), ["conv_id"], [F.asc_nulls_first("turn"), "role", "turn_hash"], number="n")
    return save(found.select("conv_id", F.col("n").cast("long").alias("n"), "turn_hash", "chars"), "numbered")


def rebuilt(given: DataFrame) -> DataFrame:
    """(conv_id, depth, turn_hash, chars): each conversation after the first turns of its family's
    first one. Depth 0 is a row without a turn for every conversation."""
    head = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(HEADS))
    sizes = given.groupBy("conv_id").agg(F.max("n").alias("turns"))
    convs = save(sizes.select("conv_id", "turns", head.alias("head"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family")), "convs")
    # Fewer than HEADS turns of a conversation are ever shared, with fewer than 2 * FAMILY others.
    heads = given.where(F.col("n") < HEADS).select(F.col("conv_id").alias("family"), "n", "turn_hash", "chars")
    shared = convs.join(heads, "family").where("n <= head").select("conv_id", F.col("n").alias("depth"), "turn_hash", "chars")
    # Where the first one is shorter than the head, own turns move up.
    bases = convs.select(F.col("conv_id").alias("family"), F.col("turns").alias("base"))
    moved = convs.join(bases, "family", "left").select(
        "conv_id", (F.least("head", F.coalesce("base", F.lit(0))) - F.col("head")).alias("move")).where("move < 0")
    own = given.where(F.col("n") > head).join(moved, "conv_id", "left").select(
        "conv_id", (F.col("n") + F.coalesce("move", F.lit(0))).alias("depth"), "turn_hash", "chars")
    start = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("turn_hash"),
                         F.lit(0).cast("long").alias("chars"))
    return start.unionByName(shared).unionByName(own)


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, high, low, up_high, up_low, chars, last): a row per prefix, with its parent's name."""
    again = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn_hash")), 256)
    rows = rebuilt(numbered(turns)).withColumn("again", F.when(F.col("depth") > 0, again).otherwise("0" * 64))
    rows = rows.select("conv_id", "depth", "chars", *[c.alias(n) for n, c in zip(LANES, _lanes(F.col("again")))])
    sums = {f"sum{i}": n for i, n in enumerate(LANES)}
    found = scan(save(rows, "rebuilt"), ["conv_id"], ["depth"], running=sums, following={"next": "depth"})
    total, above = [F.col(s) for s in sums], [F.col(s) - F.col(n) for s, n in sums.items()]
    return save(found.select(
        "conv_id", "depth", _packed(*total[:2]).alias("high"), _packed(*total[2:]).alias("low"),
        _packed(*above[:2]).alias("up_high"), _packed(*above[2:]).alias("up_low"), "chars",
        F.col("next").isNull().alias("last")), "prefixes")


def sketch(rows: DataFrame, width_bits: int) -> DataFrame:
    """One row: the bitmaps of all counters above one, of both rows of the sketch, in order."""
    width = 1 << width_bits
    counters = rows.select(F.explode(F.array(*_places("high", "low", width))).alias("place")).groupBy("place").count()
    marked = counters.where("count > 1").groupBy(F.shiftright("place", BITS).alias("id")).agg(
        F.expr(f"bitmap_construct_agg(place & {(1 << BITS) - 1})").alias("bits"))
    spark = rows.sparkSession
    empty = F.expr(f"unhex('{'00' * (1 << BITS - 3)}')")
    dense = spark.range(2 * width >> BITS).join(marked, "id", "left").select("id", F.coalesce("bits", empty).alias("bits"))
    held = dense.agg(F.array_sort(F.collect_list(F.struct("id", "bits"))).alias("all"))
    return save(held.select(F.transform("all", lambda x: x["bits"]).alias("bitmaps")), "sketch")


def _places(high: str, low: str, width: int) -> list[Column]:
    return [F.col(high).bitwiseAND(width - 1), F.col(low).bitwiseAND(width - 1) + width]


def estimate_is_one(bitmaps: Column, high: str, low: str, width: int) -> Column:
    """True if a counter of the prefix proves that it occurs once."""
    def marked(place):
        at = place.bitwiseAND((1 << BITS) - 1)
        bitmap = F.element_at(bitmaps, (F.shiftright(place, BITS) + 1).cast("int"))
        byte = F.conv(F.hex(F.substring(bitmap, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("long")
        return F.getbit(byte, at.bitwiseAND(7).cast("int")) == 1
    first, second = (marked(p) for p in _places(high, low, width))
    return ~(first & second)


def screened(rows: DataFrame) -> DataFrame:
    """``prefixes`` with ``alone`` (surely of one conversation) and ``up_alone``, that of the parent."""
    count = rows.count()
    width_bits = min(max((4 * count).bit_length(), BITS), WIDEST)
    bitmaps = sketch(rows, width_bits).scalar()
    width = 1 << width_bits
    return save(rows.withColumns({
        "alone": estimate_is_one(bitmaps, "high", "low", width),
        "up_alone": (F.col("depth") > 0) & estimate_is_one(bitmaps, "up_high", "up_low", width)}), "screened")


def _hashed(batches):
    """SHA-256 of the pieces of each node, in order; a node's pieces stand together."""
    key, state, found = None, None, []
    for batch in batches:
        for *node, piece in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 4))):
            if node != key:
                if key is not None:
                    found.append((*key, state.hexdigest()))
                key, state = node, hashlib.sha256(piece.encode())
            else:
                state.update(("," + piece).encode())
        if len(found) > 4096:
            yield _batch(found)
            found = []
    if key is not None:
        found.append((*key, state.hexdigest()))
    yield _batch(found)


def _batch(rows):
    columns = list(zip(*rows)) or [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()])], names=[*NODE, "ends"])


def ends(members: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ascending ids of the members that end at a node.

    Ids are dealt by range and joined into strings of at most 4,096; one task streams the strings of a
    node, as the hash needs them in order.
    """
    dealt = placed(members.where("last").select(*NODE, "conv_id"), NODE, ["conv_id"])
    pieces = dealt.groupBy(PART, KEY, F.shiftright(SEQ, PIECE).alias("no")).agg(
        F.min(SEQ).alias("at"), F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("piece"))
    named = pieces.select(F.col(f"{KEY}.k0").alias("depth"), F.col(f"{KEY}.k1").alias("high"), F.col(f"{KEY}.k2").alias("low"), "at", "piece")
    return named.repartition(*NODE).sortWithinPartitions(*NODE, "at").mapInArrow(
        _hashed, "depth long, high long, low long, ends string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    rows = screened(prefixes(turns))
    single, maybe = rows.where("alone"), rows.where("not alone")
    nothing = F.sha2(F.lit(""), 256)

    nodes = save(maybe.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("chars").alias("chars"),
        F.max("up_high").alias("up_high"), F.max("up_low").alias("up_low"),
        F.sum(F.col("last").cast("long")).alias("n_ends")).withColumn("saved", (F.col("n_convs") - 1) * F.col("chars")), "nodes")
    along = save(scan(nodes, ["conv_id"], ["depth"], running={"upto": "saved"}), "along")

    # What each conversation represents: savings of its nodes, and at most one leaf.
    leaf = (F.col("n_ends") == F.col("n_convs")).cast("long")
    own = nodes.select("conv_id", "saved", leaf.alias("leaf")).unionByName(
        single.where("last").select("conv_id", F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf")))
    share = own.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaf").alias("leaf")).where("saved > 0 or leaf > 0")
    below = maybe.select(*NODE, "conv_id").join(share, "conv_id").groupBy(*NODE).agg(
        F.sum("saved").alias("all_saved"), F.sum("leaf").alias("n_leaves"))
    up = [(F.col("depth") - 1).alias("depth"), F.col("up_high").alias("high"), F.col("up_low").alias("low")]
    tops = single.where("not up_alone and depth > 0")
    children = nodes.where("depth > 0").select(*up).unionByName(tops.select(*up)).groupBy(*NODE).agg(F.count("*").alias("n_children"))

    known = along.join(below, NODE, "left").join(children, NODE, "left").join(ends(maybe), NODE, "left").select(
        "conv_id", "depth", "up_high", "up_low", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        F.coalesce("n_leaves", F.lit(0)).cast("long").alias("n_leaves"),
        (F.coalesce("all_saved", F.lit(0)) - F.col("upto") + F.col("saved")).cast("long").alias("saved_tokens"),
        F.coalesce("ends", nothing).alias("ends_sha256"))
    tail = [
        F.lit(1).cast("long").alias("n_convs"), (~F.col("last")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(F.col("last"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(nothing).alias("ends_sha256")]
    asking = known.unionByName(tops.select("conv_id", "depth", "up_high", "up_low", *tail))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("high").alias("up_high"), F.col("low").alias("up_low"),
                           F.col("conv_id").alias("parent"))
    # A node that was grouped on a false alarm may stand below one that was emitted: both are of one conversation.
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    answered = asking.join(parents, ["depth", "up_high", "up_low"], "left").withColumn("parent_conv_id", parent)
    local = single.where("up_alone or depth = 0").select("conv_id", "depth", "up_high", "up_low", *tail).withColumn(
        "parent_conv_id", F.when(F.col("depth") > 0, F.col("conv_id")))
    return answered.drop("parent").unionByName(local).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
