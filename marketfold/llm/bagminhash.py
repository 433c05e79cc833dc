"""Near-duplicate documents by BagMinHash signatures of weighted word shingles.

A text is the multiset of its runs of ``SHINGLE`` words (a shorter text: one run of all its
words). The likeness of two texts is the weighted Jaccard of these multisets. For each
signature component, every unit of weight of every shingle owns a Poisson process of
rate 1; the component is the earliest point of all processes of the text, so two texts
agree on it with a probability equal to their likeness. The processes are laid out in a
hierarchy over the discretised weight axis: [0, 1), [1, 2), [2, 4), [4, 8), ...; one
process serves a whole interval and all components, its points come in ascending order,
each with a component and a place in the interval, and points beyond the text's weight
are thinned out. A time horizon ends all processes early; where some component is then
still empty, the horizon doubles.

Bands of ``ROWS`` components put candidates into buckets. The member of a bucket that shares
most buckets with others is its centre and is compared with the other members; verified
links join components. In buckets whose members are then not all in one component, the
members outside of the centre's are compared with those of other components by long
sketches. Pairs with at least 0.8 fall into a common bucket with probability
1 - (1 - 0.8**5)**32 > 1 - 4e-6 and pass the sketches with 1 - 1e-9 (to a centre) or
1 - 4e-5. Every link is verified on the exact multisets.

Defined results: equal texts are copies, null counts as empty; texts without words link to
nothing but their copies. Rows that share a doc_id are one document; a row with a null id
is known by the hash of its text. Other columns pass through untouched.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, save
from .graph import components
from .words import U, Words, lists, mix, slices

SHINGLE = 5
LIKENESS = 0.8
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
# The share of agreeing components below which a pair of likeness 0.8 is not expected: 0.8
# less six standard deviations of the estimate.
ESTIMATE = 0.8 - 6 * (0.8 * 0.2 / SIZE) ** 0.5
# Two bits each of a longer signature; 0.8 less four standard deviations of its estimate.
LONG = 2048
SLICE, ROOM = 1 << 19, 1 << 20  # bytes of text and places of signatures that a task works on at once
SIEVE = 8_388_593  # bits of the filter that keeps texts out of an exchange; a prime
LONG_ESTIMATE = 0.8 - 4 * (0.85 * 0.15 / LONG) ** 0.5 / 0.75


def shingles(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles with multiplicities, text by text: hashes, weights, offsets."""
    h, n = words.hashes(), words.counts
    size = np.where(n >= SHINGLE, n - SHINGLE + 1, np.minimum(n, 1))
    text = np.repeat(np.arange(len(n)), size)
    first = words.word_at[:-1][text] + np.arange(len(text)) - np.repeat(np.cumsum(size) - size, size)
    found = np.zeros(len(text), U)
    reach = np.minimum(SHINGLE, n)[text]
    padded = np.concatenate([h, np.zeros(SHINGLE, U)])
    for k in range(SHINGLE):
        found = np.where(reach > k, mix(found + padded[first + k] * U(2 * k + 1) + U(k)), found)
    order = np.lexsort((found, text))
    found, text = found[order], text[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    weight = np.diff(np.append(at, len(found)))
    return found[at], weight, np.searchsorted(text[at], np.arange(len(n) + 1))


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> U(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def signatures(element: np.ndarray, weight: np.ndarray, at: np.ndarray, size: int = SIZE) -> np.ndarray:
    """(texts, size) array of 64-bit names of earliest points; a text without elements has zeros."""
    n = len(at) - 1
    text = np.repeat(np.arange(n), np.diff(at))
    total = np.bincount(text, weight, minlength=n)
    levels = np.ones(len(weight), np.int64)
    some = weight > 1
    levels[some] = np.floor(np.log2(weight[some] - 1)).astype(np.int64) + 2
    level = np.arange(levels.sum()) - np.repeat(np.cumsum(levels) - levels, levels)
    text, limit = np.repeat(text, levels), np.repeat(weight, levels)
    key = mix(np.repeat(element, levels) + level.astype(U) * U(0xA24BAED4963EE407))
    width = np.where(level > 1, 1 << np.maximum(level - 1, 0), 1)
    low = np.where(level > 0, width, 0)
    rate = width.astype(float) * size
    horizon = (np.log(size) + 3) / np.maximum(total, 1)
    best = np.full(n * size, np.inf)
    name = np.zeros(n * size, U)
    step = np.zeros(len(key), U)
    now = -np.log(_uniform(mix(key + U(1)))) / rate
    live = total > 0
    while True:
        going = np.flatnonzero((now <= horizon[text]) & live[text])
        while len(going):
            point = mix(key[going] ^ mix(step[going] + U(0x5851F42D4C957F2D)))
            slot = text[going] * size + ((point >> U(33)) % U(size)).astype(np.int64)  # names' low bits stay free
            place = low[going] + np.floor(_uniform(mix(point)) * width[going])
            inside = place < limit[going]
            where, when, who = slot[inside], now[going][inside], point[inside]
            np.minimum.at(best, where, when)
            won = best[where] == when
            name[where[won]] = who[won]
            step[going] += U(1)
            now[going] -= np.log(_uniform(mix(key[going] + step[going] * U(0xD1342543DE82EF95) + U(1)))) / rate[going]
            going = going[now[going] <= horizon[text[going]]]
        live &= np.isinf(best.reshape(n, size)).any(axis=1)
        if not live.any():
            return name.reshape(n, size)
        horizon[live] *= 2


def bands(signature: np.ndarray) -> np.ndarray:
    parts = signature.reshape(len(signature), BANDS, ROWS)
    found = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U), parts.shape[:2]).copy()
    for k in range(ROWS):
        found = mix(found * U(0x9FB21C651E98DF25) + parts[:, :, k])
    return found


def _sign(batches):
    for batch in batches:
        for part in slices(batch, "text", SLICE, ROOM // SIZE):
            words = Words(part.column("text"))
            signature = signatures(*shingles(words))
            some = words.counts > 0
            bytes_ = np.ascontiguousarray((signature & U(255)).astype(np.uint8))
            flat = bands(signature)[some].ravel().view(np.int64)
            size = np.where(some, BANDS, 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("copy_of"),
                 pa.array([row.tobytes() for row in bytes_], pa.binary()),
                 lists(flat, np.concatenate([[0], np.cumsum(size)]), pa.int64())],
                names=["id", "copy_of", "sketch", "bands"])


def _bag(batches):
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            element, weight, at = shingles(Words(part.column("text")))
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), lists(element.view(np.int64), at, pa.int64()),
                 lists(weight.astype(np.int32), at, pa.int32())], names=["id", "element", "weight"])


def _long_sketch(batches):
    for batch in batches:
        for part in slices(batch, "text", SLICE // 2, ROOM // LONG):
            signature = signatures(*shingles(Words(part.column("text"))), LONG)
            columns = []
            for bit in range(2):
                plane = ((signature >> U(bit)) & U(1)).astype(np.uint8)
                columns.append(np.packbits(plane, axis=1).view(np.int64))
            planes = np.concatenate(columns, axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), *[pa.array(np.ascontiguousarray(c)) for c in planes.T]],
                names=["id", *[f"{side}{i}" for side in "lh" for i in range(LONG // 64)]])


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(name)
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def _verify(batches):
    """Weighted Jaccard of the two bags of each row."""
    for batch in batches:
        (ea, at), (wa, _) = _flat(batch, "element_a"), _flat(batch, "weight_a")
        (eb, bt), (wb, _) = _flat(batch, "element_b"), _flat(batch, "weight_b")
        found = np.zeros(batch.num_rows)
        for i in range(batch.num_rows):
            a, b = slice(at[i], at[i + 1]), slice(bt[i], bt[i + 1])
            # Elements of a bag are sorted as unsigned numbers; a common order is all it takes.
            _, p, q = np.intersect1d(ea[a], eb[b], assume_unique=True, return_indices=True)
            both = np.minimum(wa[a][p], wb[b][q]).sum()
            found[i] = both / max(wa[a].sum() + wb[b].sum() - both, 1)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(found)],
                                         names=["a", "b", "likeness"])


def _agreement(batches):
    for batch in batches:
        a = np.frombuffer(b"".join(batch.column("sketch_a").to_pylist()), np.uint8).reshape(-1, SIZE)
        b = np.frombuffer(b"".join(batch.column("sketch_b").to_pylist()), np.uint8).reshape(-1, SIZE)
        likely = (a == b).mean(axis=1) >= ESTIMATE
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(
            pa.array(likely))


def _with(pairs: DataFrame, side: str, table: DataFrame, *columns: str) -> DataFrame:
    return pairs.join(table.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in columns]), side)


def _sieved(base: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents whose id is in ``wanted``, once each.

    A bitmap of id remainders, ``SIEVE`` bits however many ids there are, drops most other
    texts before they would be shuffled; the join drops the rest.
    """
    place = F.pmod(F.col("id"), F.lit(SIEVE))
    words = wanted.groupBy(F.floor(place / 64).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))).alias("bits"))
    bitmap = np.zeros(SIEVE // 64 + 1, np.int64)
    for row in words.collect():
        bitmap[row.word] = row.bits
    shared = base.sparkSession.sparkContext.broadcast(bitmap)

    def keep(batches):
        for batch in batches:
            at = np.mod(batch.column("id").to_numpy(), SIEVE)
            yield batch.filter(pa.array((shared.value[at // 64] >> (at % 64)) & 1 == 1))

    few = base.mapInArrow(keep, base.schema)
    return few.join(wanted, "id", "left_semi").dropDuplicates(["id"])


def _verified(pairs: DataFrame, base: DataFrame) -> DataFrame:
    """The pairs (a, b) whose likeness is enough, by their multisets."""
    wanted = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    bags = save(_sieved(base, wanted).mapInArrow(
        _bag, "id long, element array<long>, weight array<int>"), "bags")
    both = _with(_with(pairs, "a", bags, "element", "weight"), "b", bags, "element", "weight")
    checked = both.select("a", "b", "element_a", "weight_a", "element_b", "weight_b").mapInArrow(
        _verify, "a long, b long, likeness double")
    return save(checked.where(F.col("likeness") >= LIKENESS).select("a", "b"), "links")


def classes(docs: DataFrame) -> DataFrame:
    """(id, class_id, links) per document; class_id is the least id of its component, links
    the number of verified links between its text and others (those found while joining
    components; links inside a component need not all be enumerated)."""
    base = docs.select(row_key().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = save(base.withColumn("copy_of", F.unhex(F.md5("text"))).mapInArrow(
        _sign, "id long, copy_of binary, sketch binary, bands array<long>"), "signatures")
    copies = signed.groupBy("copy_of").agg(F.min("id").alias("node"))
    rows = save(signed.select("id", "copy_of").join(copies, "copy_of").select("id", "node").distinct(), "copies")
    nodes = signed.join(rows.where("id = node").select("id").distinct(), "id", "left_semi").select("id", F.explode("bands").alias("bucket"))
    full = nodes.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1")
    members = save(nodes.join(full, "bucket").select("bucket", "id", "size").distinct(), "members")
    # The centre of a bucket is the member that shares most buckets with most others: the text
    # that the others are versions of, if there is one.
    degree = members.groupBy("id").agg(F.sum("size").alias("degree"))
    centre = members.join(degree, "id").groupBy("bucket").agg(F.max(F.struct("degree", "id")).alias("most"))
    centred = save(members.join(centre.select("bucket", F.col("most.id").alias("centre")), "bucket"), "centred")
    pairs = centred.where("id <> centre").select(
        F.least("id", "centre").alias("a"), F.greatest("id", "centre").alias("b")).distinct()
    likely = save(_with(_with(pairs, "a", signed, "sketch"), "b", signed, "sketch")
                  .select("a", "b", "sketch_a", "sketch_b").mapInArrow(_agreement, "a long, b long").distinct(), "likely")
    links = _verified(likely, base)
    roots = components(links)
    further = _verified(save(_further(centred, roots, base), "further"), base)
    if not further.isEmpty():
        links = links.union(further)
        roots = components(links)
    ends = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    out = rows.join(roots, "node", "left").join(ends, "node", "left")
    return out.groupBy("id").agg(F.min(F.coalesce("root", "node")).alias("class_id"),
                                 F.max(F.coalesce("links", F.lit(0))).cast("long").alias("links"))


def _further(centred: DataFrame, roots: DataFrame, base: DataFrame) -> DataFrame:
    """Likely pairs in buckets whose members are not all in one component: each member that is
    not in its centre's component against all that are not in its own. Long sketches are
    compared inside the join, so that only likely pairs leave it."""
    known = roots.toDF("id", "root")
    at = centred.join(known, "id", "left").withColumn("root", F.coalesce("root", "id"))
    middle = known.toDF("centre", "centre_root")
    at = at.join(middle, "centre", "left").select("bucket", "id", "root", F.coalesce("centre_root", "centre").alias("main"))
    opened = at.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n")).where(
        "low < high and n > 2").select("bucket")
    at = save(at.join(opened, "bucket"), "open")
    planes = [f"{side}{i}" for side in "lh" for i in range(LONG // 64)]
    sketched = save(_sieved(base, at.select("id").distinct()).mapInArrow(
        _long_sketch, "id long, " + ", ".join(f"{p} long" for p in planes)), "long_sketches")
    held = at.join(sketched, "id")
    left = held.where("root <> main").alias("x")
    differ = " + ".join(f"bit_count((x.l{i} ^ y.l{i}) | (x.h{i} ^ y.h{i}))" for i in range(LONG // 64))
    found = left.join(held.alias("y"), F.expr(
        f"x.bucket = y.bucket and x.root <> y.root and (y.root = y.main or x.id < y.id) and {differ} <= {int(LONG * 0.75 * (1 - LONG_ESTIMATE))}"))
    return found.select(F.expr("least(x.id, y.id)").alias("a"), F.expr("greatest(x.id, y.id)").alias("b")).distinct()


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each class, that with the least id, with all its columns."""
    kept = classes(docs).where("id = class_id").select(F.col("id").alias("__id"))
    held = docs.withColumn("__id", row_key()).join(kept, "__id", "left_semi")
    return held.dropDuplicates(["__id"]).drop("__id")
