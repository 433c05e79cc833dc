"""Removing long repeated passages, found by recompression of the word sequences.

Recompression rewrites a text in rounds: runs of one symbol become one symbol, then pairs
of neighbours whose names fall into opposite halves of a partition become one. Names are
hashes of what they stand for, so all tasks name alike without talking to each other.
Whether two neighbours merge hangs on nothing but their names. Each boundary carries the
range of words on which its survival hangs, and so does each symbol; a symbol whose range
lies inside a window of ``WINDOW`` words is the same in every other place where that
window stands. Of these the window takes the one with the least rank as its anchor.
A window that no such symbol fits into (inside a long run, say) is its own anchor.

Spark then finds the anchors that several texts share, the windows on shared anchors, and
the windows that also stand in a document with a smaller id; a window's hash over all its
words verifies the repeat. Copies of whole texts are settled beforehand by their hash.

Defined results: a null text has no words. Rows that share a doc_id never count as
repeating each other; a null doc_id is replaced by the hash of the text. Texts below
``WINDOW`` words lose nothing. Other columns pass through untouched.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import row_key, save
from .words import U, Words, lists, mix, powers, slices

WINDOW = 50
ROUNDS = 5
RUN_ROUNDS = (1,)  # rounds that begin with naming runs
LONGEST = 10  # words of a symbol
LEAST = 4  # symbols of fewer words are anchors only where nothing longer fits


class Symbols:
    """Symbols of many texts: names, and boundaries with what they hang on.

    Boundary i lies left of symbol i. ``low`` and ``high`` bound the words that decide
    whether it survives. Before the first round all boundaries hang on nothing; after it,
    the ends of a text hang on words outside of it, so no window determines them.
    """

    def __init__(self, hashes: np.ndarray, word_at: np.ndarray):
        n = len(hashes)
        self.name = hashes
        self.at = np.arange(n + 1)
        self.low, self.high = np.arange(n + 1), np.arange(n + 1)
        self.end = np.zeros(n + 1, bool)
        self.end[word_at] = True

    def _keep(self, gone: np.ndarray, low: np.ndarray, high: np.ndarray, name: np.ndarray) -> None:
        """Drop boundaries; a symbol takes its name from its first part."""
        stay = np.flatnonzero(~gone)
        self.low, self.high = low[stay], high[stay]
        self.at, self.end = self.at[stay], self.end[stay]
        self.name = name[stay[:-1]]

    def _around(self) -> tuple[np.ndarray, np.ndarray]:
        """What the left end of the symbol before, the right end of the symbol after hang on."""
        before, after = np.concatenate([self.low[:1], self.low[:-1]]), np.concatenate([self.high[1:], self.high[-1:]])
        return np.where(self.end, self.at - 1, before), np.where(self.end, self.at + 1, after)

    def runs(self) -> None:
        n = len(self.name)
        new = self.end[:-1].copy()
        new[1:] |= self.name[1:] != self.name[:-1]
        head = np.flatnonzero(new)
        count = np.diff(np.append(head, n))
        run = np.cumsum(new) - 1
        short = (self.at[np.append(head, n)[1:]] - self.at[head]) <= LONGEST
        inside = np.append(~new, False)
        gone = inside.copy()
        gone[:-1] &= short[run]
        low, high = self._around()
        # A boundary inside a run that stays hangs on the whole run and both neighbours.
        tail = np.append(head, n)[1:]
        low[:-1], high[:-1] = (np.where(~new, low[head][run], low[:-1]), np.where(~new, high[tail][run], high[:-1]))
        name = self.name.copy()
        joined = head[(count > 1) & short]
        name[joined] = mix(name[joined] * U(0x9E3779B97F4A7C15) + count[(count > 1) & short].astype(U))
        self._keep(gone, low, high, name)

    def pairs(self, number: int) -> None:
        n = len(self.name)
        right = (mix(self.name + mix(np.full(1, number, U))) & U(1)).astype(bool)
        opposite = np.zeros(n + 1, bool)
        opposite[1:-1] = ~right[:-1] & right[1:]
        gone = opposite & ~self.end
        gone[1:-1] &= self.at[2:] - self.at[:-2] <= LONGEST
        low, high = self._around()
        # A left half on the right decides alone; any other boundary hangs on both symbols. The
        # rule must not look at what the boundary doesn't hang on, else places would differ.
        low = np.where(np.append(~right, False) & ~self.end, self.low, low)
        name = self.name.copy()
        first = np.flatnonzero(gone) - 1
        name[first] = mix(name[first] * U(0xFF51AFD7ED558CCD) + mix(self.name[first + 1] + U(number)))
        self._keep(gone, low, high, name)


def recompress(hashes: np.ndarray, word_at: np.ndarray) -> Symbols:
    found = Symbols(hashes, word_at)
    if len(hashes):
        for number in range(1, ROUNDS + 1):
            if number in RUN_ROUNDS:
                found.runs()
            found.pairs(number)
    return found


def windows(hashes: np.ndarray, word_at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First words and hashes of all windows."""
    n = np.maximum(np.diff(word_at) - WINDOW + 1, 0)
    first = np.repeat(word_at[:-1], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    up, down = powers(len(hashes) + 1)
    total = np.concatenate([np.zeros(1, U), np.cumsum(hashes * up[:-1])]) if len(hashes) else np.zeros(1, U)
    return first, mix((total[first + WINDOW] - total[first]) * down[first])


def anchors(hashes: np.ndarray, word_at: np.ndarray, first: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The name of each window's anchor."""
    s = recompress(hashes, word_at)
    if not len(first):
        return own
    low, high = s.low[:-1], s.high[1:]
    rank = (mix(s.name ^ U(0x2545F4914F6CDD1D)) >> U(1)) | (np.diff(s.at) < LEAST).astype(U) << U(63)
    at = np.searchsorted(low, first, "left")
    to = np.searchsorted(high, first + WINDOW, "right")
    best = np.full(len(first), np.iinfo(np.uint64).max, U)
    level = np.floor(np.log2(np.maximum(to - at, 1))).astype(np.int64)  # two blocks of 2**level cover the range
    level[at >= to] = -1
    least = rank
    for k in range(level.max() + 1):
        here = np.flatnonzero(level == k)
        best[here] = np.minimum(least[at[here]], least[to[here] - (1 << k)])
        least = np.minimum(least[:max(len(least) - (1 << k), 0)], least[1 << k:])
    return np.where(at < to, mix(best + U(1)), mix(own + U(2)))


def _distinct(values: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, and their offsets."""
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    values, text = values[new], text[new]
    order = np.lexsort((values, text))
    values, text = values[order], text[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (text[1:] != text[:-1])
    return values[new], np.searchsorted(text[new], np.arange(n + 1))


def _text_of(first: np.ndarray, word_at: np.ndarray) -> np.ndarray:
    return np.searchsorted(word_at, first, "right") - 1


def _name(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            h = words.hashes()
            first, own = windows(h, words.word_at)
            found, at = _distinct(anchors(h, words.word_at, first, own), _text_of(first, words.word_at), part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("id"), part.column("copy_of"), lists(found.view(np.int64), at, pa.int64())],
                names=["id", "copy_of", "anchors"])


def _member(values: np.ndarray, text: np.ndarray, wanted: pa.Array, seed: int = 0) -> np.ndarray:
    """Whether each value is in the list of its text."""
    sizes = wanted.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    listed = wanted.flatten().to_numpy(zero_copy_only=False).view(U)
    owner = np.repeat(np.arange(len(sizes)), sizes).astype(U)
    return np.isin(mix(values + mix(text.astype(U) + U(7))), mix(listed + mix(owner + U(7))))


def _open(batches):
    """Windows on shared anchors."""
    for batch in batches:
        for part in slices(batch, "text"):
            words = Words(part.column("text"))
            h = words.hashes()
            first, own = windows(h, words.word_at)
            text = _text_of(first, words.word_at)
            hit = _member(anchors(h, words.word_at, first, own), text, part.column("shared"))
            found, at = _distinct(own[hit], text[hit], part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(part.column("id").to_numpy(), np.diff(at))), pa.array(found.view(np.int64))],
                names=["id", "window"])


def _cut(with_text: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                first, own = windows(words.hashes(), words.word_at)
                hit = _member(own, _text_of(first, words.word_at), part.column("windows"))
                cover = np.zeros(len(words.starts) + 1, np.int64)
                np.add.at(cover, first[hit], 1)
                np.add.at(cover, first[hit] + WINDOW, -1)
                gone = np.cumsum(cover)[:-1] > 0
                copied = np.asarray(part.column("copied").fill_null(False).to_pylist(), bool)
                gone |= np.repeat(copied & (words.counts >= WINDOW), words.counts)
                kept, removed = [], np.zeros(part.num_rows, np.int64)
                data, texts = words.data.tobytes(), part.column("text")
                for i in range(part.num_rows):
                    a, b = words.word_at[i], words.word_at[i + 1]
                    removed[i] = gone[a:b].sum()
                    if with_text and not removed[i]:
                        kept.append(texts[i].as_py())
                        continue
                    at = a + np.flatnonzero(~gone[a:b])
                    line = b" ".join([data[x:y] for x, y in zip(words.starts[at].tolist(), words.ends[at].tolist())])
                    kept.append(line.decode("utf-8") if with_text else hashlib.sha256(line).hexdigest())
                if with_text:
                    text = part.schema.get_field_index("text")
                    columns = [pa.array(kept, pa.string()) if i == text else c for i, c in enumerate(part.columns)]
                    yield pa.RecordBatch.from_arrays(
                        [*columns, pa.array(words.counts.astype(np.int64)), pa.array(removed)],
                        names=[*part.schema.names, "n_words", "n_removed"]).drop_columns(["windows", "copied", "id"])
                else:
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(words.counts.astype(np.int64)), pa.array(removed),
                         pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])
    return run


def _repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with id, and what each row repeats of documents with smaller ids: window
    hashes, and whether its whole text is a copy."""
    base = docs.select(row_key().alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    named = save(base.withColumn("copy_of", F.unhex(F.md5("text"))).mapInArrow(
        _name, "id long, copy_of binary, anchors array<long>"), "named")
    copies = named.groupBy("copy_of").agg(F.min("id").alias("least"))
    copied = save(named.select("id", "copy_of").join(copies, "copy_of").select(
        "id", "copy_of", (F.col("id") > F.col("least")).alias("copied")).distinct(), "copied")
    firsts = named.join(copied.where("not copied"), ["id", "copy_of"], "left_semi").select("id", F.explode("anchors").alias("anchor"))
    firsts = save(firsts, "anchors")
    shared = firsts.groupBy("anchor").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("anchor")
    asked = save(firsts.join(shared, "anchor").groupBy("id").agg(F.collect_set("anchor").alias("shared")), "shared")
    opened = save(base.join(asked, "id").mapInArrow(_open, "id long, window long").distinct()
                  if _has_repeated_ids(copied) else base.join(asked, "id").mapInArrow(_open, "id long, window long"), "windows")
    least = opened.groupBy("window").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high")
    late = opened.join(least.select("window", "low"), "window").where("id > low").groupBy("id").agg(
        F.collect_set("window").alias("windows"))
    late = save(late, "late")
    whole = copied.where("copied").groupBy("id").agg(F.collect_set("copy_of").alias("copies"))
    info = late.join(whole, "id", "full_outer")
    return docs.withColumn("id", row_key()).join(info, "id", "left").withColumn(
        "copied", F.coalesce(F.array_contains("copies", F.unhex(F.md5(F.coalesce("text", F.lit(""))))), F.lit(False))).drop("copies")


def _has_repeated_ids(copied: DataFrame) -> bool:
    return not copied.groupBy("id").count().where("count > 1").isEmpty()


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the sha256 of the kept words joined by one space."""
    found = _repeats(docs.select("doc_id", "text")).select("doc_id", "text", "windows", "copied")
    return found.mapInArrow(_cut(False), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the kept words as text. A text that loses nothing stays as it is, spacing
    included; a document that loses all its words goes."""
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "doc_id", "text")
    found = _repeats(held).select("row", "doc_id", "text", "windows", "copied", "id")
    out = T.StructType([f for f in held.select("row", "doc_id", "text").schema.fields] +
                       [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])
    cut = found.mapInArrow(_cut(True), out).where("n_removed = 0 or n_removed < n_words")
    return cut.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
