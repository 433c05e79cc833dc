"""Benchmark decontamination by subsequences, with latent semantic likeness.

A document leaks an item if the longest common subsequence of the item's words with a stretch
of text half as long again holds ``COPIED`` of them, or ``REPHRASED`` of them and the item's
answer, its last ``ANSWER`` words, as well.

Passages of the documents (``BLOCK`` words each) and the items are vectors of term frequency
times squared inverse passage frequency over the words of the benchmark. A randomised SVD of
all passages, one distributed pass over a random test matrix with a Nystrom step on the driver,
gives a latent space of ``RANK`` dimensions. The items count in it as much as all documents
together, so that rare words of theirs keep a place in it.

Candidates are windows of adjacent cells of ``GRID`` words, as many as any stretch for an item
of its length can touch, whose cosine with the item is at least ``COSINE``. Of an item that
the space holds less than ``CAPTURED`` of, candidates are the windows in which enough places hold
a word of the item. A subsequence is no longer than the number of the item's places whose
word the window holds, so candidates in which that is below ``REPHRASED`` are passed over; in the
others all stretches are compared. Against the comparison of all stretches, planted
paraphrases that keep 0.55 to 0.75 of an item were found with a recall of 0.97 and more.

The benchmark is a stated query set: it is taken in blocks of about ``ITEMS`` items of usual
length, and what reaches the driver and the broadcast is bounded by the words of one block of it.

Defined results: null and empty texts leak nothing; items without a word are ignored,
repeated ones are reported each. Upper and lower case and ASCII punctuation do not count.
An empty benchmark leaves all documents clean. A row with a null doc_id is known by the
hash of its text.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_key, save
from .words import U, Words, lists, slices

BLOCK = 16
RANK = 128
EXTRA = 8  # further columns of the random test matrix
ITEMS = 500
GRID = 8
CELLS, PAIRS = 1024, 8192  # cells, and windows with an item, that are held at once
PIECE = 512  # blocks summed at once
COSINE = 0.35
CAPTURED = 0.1  # share of an item's squared length in the latent space, below which it is sought by counts
COPIED = 0.75
REPHRASED = 0.55
ANSWER = 5


@dataclass
class Space:
    terms: np.ndarray  # sorted hashes of the benchmark's words
    items: list  # ids
    words: list[np.ndarray]  # their words, as places in terms from 1
    weights: np.ndarray | None = None  # latent coordinates of one occurrence of a term
    latent: np.ndarray | None = None  # unit vectors of the items
    captured: np.ndarray | None = None  # share of each item's squared length that they hold

    def places(self, hashes: np.ndarray) -> np.ndarray:
        """From 1; 0 for a word that the benchmark lacks."""
        if not len(self.terms):
            return np.zeros(len(hashes), np.int32)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at + 1, 0).astype(np.int32)

    @cached_property
    def index(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The number of each word among an item's words from 0, by item and place (their number if
        it has none of them); whether an item has a word, by place and item; how often it has it."""
        own = [np.unique(w, return_counts=True) for w in self.words]
        width = max(len(w) for w, _ in own)
        number = np.full((len(own), len(self.terms) + 1), width, np.int32)
        times = np.zeros((len(own), width + 1), np.int32)
        for k, (word, n) in enumerate(own):
            number[k, word], times[k, :len(word)] = np.arange(len(word)), n
        return number, np.ascontiguousarray((number[:, 1:] < width).T.astype(np.uint8)), times

    @cached_property
    def least(self) -> np.ndarray:
        """Words of each item that a leak has in common with it, at least."""
        return np.ceil(REPHRASED * np.array([len(w) for w in self.words]) - 1e-9).astype(int)

    @cached_property
    def classes(self) -> list[tuple[int, np.ndarray]]:
        """Cells that a stretch can touch, up to the next of 1, 2, 3, 4, 6, 8, 12, ..., and the items for which it is so."""
        cells = np.array([-(-(stretch(len(w)) - 1) // GRID) + 1 for w in self.words])
        half = 2 ** np.floor(np.log2(cells)).astype(int)
        cells = np.where(cells == half, half, np.where(2 * cells <= 3 * half, (3 * half + 1) // 2, 2 * half))
        return [(int(m), np.flatnonzero(cells == m)) for m in np.unique(cells)]


def stretch(n: int) -> int:
    """Words of text that are compared with an item of n words."""
    return n + n // 2


def read_items(rows: list) -> Space:
    words = Words(pa.array([r.text for r in rows], pa.string()), plain=True)
    h = words.hashes()
    space = Space(np.unique(h), [], [])
    for r, a, b in zip(rows, words.word_at[:-1], words.word_at[1:]):
        if b > a:
            space.items.append(r.item_id)
            space.words.append(space.places(h[a:b]))
    return space


def passages(places: np.ndarray, word_at: np.ndarray, size: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Known words and the passage of each; the first passage of each text, then their number."""
    n = np.diff(word_at)
    blocks = -(-n // size)
    block_at = np.concatenate([[0], np.cumsum(blocks)])
    text = np.repeat(np.arange(len(n)), n)
    block = block_at[text] + (np.arange(len(places)) - word_at[text]) // size
    known = places > 0
    return places[known] - 1, block[known], block_at


def summed(rows: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by ascending group."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    if len(group):
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        out[group[head]] = np.add.reduceat(rows, head, axis=0)
    return out


def block_sums(rows: np.ndarray, term: np.ndarray, block: np.ndarray, n: int, size: int) -> np.ndarray:
    """Sums of the rows of terms by block of at most ``size`` known words, made in pieces that
    stay in the cache."""
    count = np.bincount(block, minlength=n)
    at = np.cumsum(count) - count
    padded = np.concatenate([rows, np.zeros((1, rows.shape[1]), rows.dtype)])
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    last = max(len(term) - 1, 0)
    for low in range(0, n, PIECE):
        first, have = at[low:low + PIECE], count[low:low + PIECE]
        for i in range(min(size, int(have.max()))):
            out[low:low + PIECE] += padded[np.where(have > i, term[np.minimum(first + i, last)], len(rows))]
    return out


def term_sums(total: np.ndarray, rows: np.ndarray, term: np.ndarray, block: np.ndarray):
    """Adds the row of each occurrence's block to its term."""
    order = np.argsort(term, kind="stable")
    term, block = term[order], block[order]
    for low in range(0, len(term), 8 * PIECE):
        t = term[low:low + 8 * PIECE]
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        total[t[head]] += np.add.reduceat(rows[block[low:low + 8 * PIECE]], head, axis=0)


def _encode(shared):
    def run(batches):
        space = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"), plain=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), lists(space.places(words.hashes()), words.word_at, pa.int32())],
                    names=["id", "places"])
    return run


def _coded(batches):
    for batch in batches:
        column = batch.column("places")
        size = column.value_lengths().to_numpy(zero_copy_only=False)
        at = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        first = 0
        while first < len(size):
            last = max(first + 1, int(np.searchsorted(at, at[first] + (1 << 18), "right")) - 1)
            yield batch.slice(first, last - first), flat[at[first]:at[last]], at[first:last + 1] - at[first]
            first = last


def _frequencies(n: int):
    def run(batches):
        found = np.zeros(n, np.int64)
        total = 0
        for _, places, word_at in _coded(batches):
            term, block, block_at = passages(places, word_at)
            pairs = np.unique(block.astype(np.int64) * n + term)
            found += np.bincount(pairs % n, minlength=n)
            total += int(block_at[-1])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, n)), pa.array(np.append(total, found))],
                                         names=["term", "passages"])
    return run


def _sketch(shared, width: int):
    names = ["term", *[f"c{i}" for i in range(width)]]

    def run(batches):
        idf, test = shared.value
        test = (test * idf[:, None]).astype(np.float32)
        total = np.zeros((len(idf), width))
        for _, places, word_at in _coded(batches):
            term, block, block_at = passages(places, word_at)
            z = block_sums(test, term, block, int(block_at[-1]), BLOCK)
            term_sums(total, z, term, block)
        total *= idf[:, None]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(idf))), *[pa.array(c) for c in total.T.copy()]], names=names)
    return run


def fit(docs: DataFrame, space: Space, seed: int = 0) -> tuple[Space, DataFrame]:
    """The latent space of all passages of ``docs`` (id, text); the texts as places of words."""
    spark, n = docs.sparkSession, len(space.terms)
    coded = save(docs.mapInArrow(_encode(spark.sparkContext.broadcast(space)), "id long, places array<int>"), "coded")
    counted = coded.mapInArrow(_frequencies(n), "term long, passages long").groupBy("term").agg(F.sum("passages"))
    found = np.zeros(n + 1)
    for term, passages_ in counted.collect():  # a row for each word of the benchmark
        found[term + 1] = passages_
    idf = np.log(1 + (found[0] + 1) / (found[1:] + 1)) ** 2  # above 0 for every word, however common
    width = min(RANK + EXTRA, n)
    test = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    schema = "term long, " + ", ".join(f"c{i} double" for i in range(width))
    parts = coded.mapInArrow(_sketch(spark.sparkContext.broadcast((idf, test)), width), schema).groupBy("term").agg(
        *[F.sum(f"c{i}").alias(f"c{i}") for i in range(width)])
    image = np.zeros((n, width))
    for row in parts.collect():  # a row for each word of the benchmark
        image[row[0]] = row[1:]
    # The items are passages too, with as much weight together as all those of the documents.
    held = np.zeros((len(space.words), n))
    for k, w in enumerate(space.words):
        np.add.at(held[k], w - 1, idf[w - 1])
    own = held.T @ (held @ test)
    image += own * (max(np.trace(test.T @ image), 1e-9) / max(np.trace(test.T @ own), 1e-9))
    shift = 1e-9 * max(np.linalg.norm(image), 1e-9)
    image += shift * test
    middle = test.T @ image
    lower = np.linalg.cholesky((middle + middle.T) / 2 + shift * np.eye(width))
    left, size, _ = np.linalg.svd(np.linalg.solve(lower, image.T).T, full_matrices=False)
    rank = max(1, min(RANK, int((size > 1e-6 * size[0]).sum())))
    space.weights = (idf[:, None] * left[:, :rank]).astype(np.float32)
    vectors = held @ left[:, :rank]
    length = np.linalg.norm(vectors, axis=1)
    space.captured = (length / np.maximum(np.linalg.norm(held, axis=1), 1e-12)) ** 2
    space.latent = (vectors / np.maximum(length, 1e-12)[:, None]).astype(np.float32)
    return space, coded


def common_subsequence(item: dict[int, int], text: np.ndarray, length: int) -> int:
    """Length of the longest common subsequence; ``item`` maps words to bit sets of places."""
    ones = (1 << length) - 1
    v = ones
    for w in text.tolist():
        m = item.get(w)
        if m is not None:
            u = v & m
            v = ((v + u) | (v - u)) & ones
    return length - v.bit_count()


def bits(words: np.ndarray) -> dict[int, int]:
    found: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        found[w] = found.get(w, 0) | 1 << i
    return found


def accepts(share: float, answer: float) -> bool:
    return share >= COPIED or share >= REPHRASED and answer >= 0.8


def compare(item: np.ndarray, text: np.ndarray) -> tuple[float, float, int]:
    """Of the stretches of ``text``, one that leaks the item if there is any, of those the one
    with the largest share of the item's words in a common subsequence: that share, that of
    its answer's words, and the place."""
    n, tail = len(item), min(len(item), ANSWER)
    whole, answer = bits(item), bits(item[-ANSWER:])
    span, step = stretch(n), max(1, n // 4)
    best = (False, 0.0, 0.0, 0)
    for at in range(0, max(len(text) - span, 0) + step, step):
        piece = text[at:at + span]
        share = common_subsequence(whole, piece, n) / n
        if share >= REPHRASED:
            held = common_subsequence(answer, piece, tail) / tail
            best = max(best, (accepts(share, held), share, held, -at))
    return best[1], best[2], -best[3]


def windows(space: Space, places: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, item, first word and end of the windows near an item in the latent space, or, for
    items that the space does not hold, with enough of the item's words, which also all others must have."""
    number, member, times = space.index
    term, cell, cell_at = passages(places, word_at, GRID)
    n, found = int(cell_at[-1]), [np.zeros((4, 0), np.int64)]
    text_of = np.repeat(np.arange(len(word_at) - 1), np.diff(cell_at))
    first = word_at[text_of] + (np.arange(n) - cell_at[text_of]) * GRID
    hidden = space.captured < CAPTURED
    member, column = np.ascontiguousarray(member[:, hidden]), np.cumsum(hidden) - 1
    vectors = block_sums(space.weights, term, cell, n, GRID)
    widest = space.classes[-1][0]
    cells = max(CELLS, widest)

    def running(rows, kind):
        return np.cumsum(np.concatenate([np.zeros((1, rows.shape[1]), kind), rows]), axis=0, dtype=kind)

    for base in range(0, n, cells):
        last = min(n, base + cells + widest)
        starts = np.arange(base, min(base + cells, n))
        sums = running(vectors[base:last], np.float32)
        if hidden.any():
            some = slice(*np.searchsorted(cell, (base, last)))
            counts = running(summed(member[term[some]], cell[some] - base, last - base), np.int32)
        for m, items in space.classes:
            begin, end = starts - base, np.minimum(starts + m, cell_at[text_of[starts] + 1]) - base
            window = sums[end] - sums[begin]
            length = np.sqrt(np.einsum("ij,ij->i", window, window))
            near = window @ space.latent[items].T >= COSINE * np.maximum(length, 1e-6)[:, None]
            some = np.flatnonzero(hidden[items])
            if len(some):
                near[:, some] = (counts[end] - counts[begin])[:, column[items[some]]] >= space.least[items[some]]
            at, k = np.nonzero(near)
            at, k, width = starts[at], items[k], m * GRID
            step = max(1, PAIRS * 64 // max(width, times.shape[1]))
            for low in range(0, len(at), step):
                a, i = at[low:low + step], k[low:low + step]
                where, end = first[a, None] + np.arange(width), np.minimum(first[a] + width, word_at[text_of[a] + 1])
                word = np.where(where < end[:, None], places[np.minimum(where, len(places) - 1)], 0)
                there = np.zeros((len(a), times.shape[1]), bool)
                there[np.arange(len(a))[:, None], number[i[:, None], word]] = True
                good = (there * times[i]).sum(axis=1) >= space.least[i]
                found.append(np.stack([text_of[a[good]], i[good], first[a[good]], end[good]]))
    text, item, first, end = np.concatenate(found, axis=1)
    return text, item, first, end


def leaks(space: Space, places: np.ndarray, word_at: np.ndarray) -> list[tuple[int, int, float, float, float]]:
    """(text, item, cosine, share, answer) for each item that a text leaks, best stretch of each."""
    if not len(places) or not space.items:
        return []
    text, item, first, end = windows(space, places, word_at)
    order = np.lexsort((first, item, text))
    text, item, first, end = text[order], item[order], first[order], end[order]
    # Windows that overlap are compared as one piece.
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (first[1:] > end[:-1])
    head = np.flatnonzero(new)
    found: dict[tuple[int, int], tuple[bool, float, float, int]] = {}
    for a, b in zip(head, np.append(head[1:], len(text)) - 1):
        share, answer, at = compare(space.words[item[a]], places[first[a]:end[b]])
        if accepts(share, answer):
            key = int(text[a]), int(item[a])
            found[key] = max(found.get(key, (0.0, 0.0, 0)), (share, answer, int(first[a]) + at))
    return [(t, k, cosine(space, k, places[at:min(at + stretch(len(space.words[k])), int(word_at[t + 1]))]), share, answer)
            for (t, k), (share, answer, at) in sorted(found.items())]


def cosine(space: Space, item: int, piece: np.ndarray) -> float:
    vector = space.weights[piece[piece > 0] - 1].sum(axis=0)
    return float(vector @ space.latent[item] / max(np.linalg.norm(vector), 1e-12))


def _spaces(benchmark: DataFrame):
    """The blocks of the benchmark, by items and by characters."""
    items, characters = benchmark.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    blocks = max(1, -(-items // ITEMS), -(-characters // (ITEMS * 500)))
    numbered = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").withColumn(
        "block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for number in range(blocks):
        space = read_items(numbered.where(F.col("block") == number).orderBy("item_id", "text").collect())
        if space.items:
            yield space


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, cosine, share, answer): the items that documents leak."""
    base = docs.select(row_key().alias("id"), "text")
    schema = "doc_id long, item_id long, cosine double, share double, answer double"
    arrow = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()),
                       ("share", pa.float64()), ("answer", pa.float64())])
    found = docs.sparkSession.createDataFrame([], schema)
    for space in _spaces(benchmark):
        space, coded = fit(base, space)
        shared = docs.sparkSession.sparkContext.broadcast(space)

        def run(batches, shared=shared):
            space = shared.value
            for part, places, word_at in _coded(batches):
                hits, ids = leaks(space, places, word_at), part.column("id").to_numpy()
                yield pa.RecordBatch.from_pylist(
                    [{"doc_id": int(ids[t]), "item_id": space.items[k], "cosine": c, "share": s, "answer": a}
                     for t, k, c, s, a in hits], arrow)
        found = found.union(coded.mapInArrow(run, schema))
    return found.groupBy("doc_id", "item_id").agg(F.max("cosine").alias("cosine"), F.max("share").alias("share"),
                                                  F.max("answer").alias("answer"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that leak no item, with all their columns; texts don't move."""
    base = docs.select(row_key().alias("id"), "text")
    for space in _spaces(benchmark):
        space, _ = fit(base, space)
        shared = docs.sparkSession.sparkContext.broadcast(space)

        def run(batches, shared=shared):
            space = shared.value
            for batch in batches:
                for part in slices(batch, "text"):
                    words = Words(part.column("text"), plain=True)
                    clean = np.ones(part.num_rows, bool)
                    clean[[hit[0] for hit in leaks(space, space.places(words.hashes()), words.word_at)]] = False
                    yield part.filter(pa.array(clean))
        docs = docs.mapInArrow(run, docs.schema)
    return docs
