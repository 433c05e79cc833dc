"""Language identification by cross-parsing entropy.

A suffix automaton holds every substring of a language's sample. A text is cut greedily
into the longest phrases that occur in the sample (each phrase costs one pointer into
it); the language that needs the fewest phrases, each weighted with the logarithm of its
sample's length, wins. Texts are parsed in blocks of ``BLOCK`` symbols, all blocks of a
batch side by side, one table lookup per symbol and language.

Symbols are lower-cased letters; everything between letters is one separator, so digits,
punctuation and spacing have no influence.

Defined results: a null text or one without a letter is ``und`` with score 0. A row
without a language or a text teaches nothing. Without any labelled row every text is
``und``. Equal costs go to the language first in the alphabet. Rows are kept as they are,
repeated ones too; columns named ``lang_pred`` and ``score`` are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import slices, text_buffers

BLOCK = 256
MISS = 1 << 30
UNKNOWN = "und"


@dataclass
class Model:
    languages: list[str]
    symbol: np.ndarray  # by code point: 0 no letter, 1 a letter no sample has, from 2 letters
    tables: list[np.ndarray]  # by language: next state, times the width; MISS where a phrase ends
    width: int
    cost: np.ndarray  # of a phrase


def sample(docs: DataFrame, docs_per_language: int = 64, chars_per_document: int = 320) -> DataFrame:
    """The bounded training sample: pieces of documents chosen by a hash of text and language."""
    chosen = F.xxhash64("text", "lang")
    order = Window.partitionBy("lang").orderBy("h", "text")
    start = F.pmod(F.col("h"), F.greatest(F.length("text") - chars_per_document, F.lit(0)) + 1) + 1
    return (docs.where("lang is not null and text is not null").select("lang", "text", chosen.alias("h"))
            .withColumn("n", F.row_number().over(order)).where(F.col("n") <= docs_per_language)
            .select("lang", "n", F.substring(F.col("text"), start.cast("int"), F.lit(chars_per_document)).alias("text")))


def letters() -> np.ndarray:
    """By code point: the code point of the lower-case letter, 0 for no letter."""
    found = np.zeros(0x110000, np.int32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            low = c.lower()
            found[cp] = ord(low[0])
    return found


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions by state; state 0 is the start."""
    steps, link, longest, last = [{}], [-1], [0], 0
    for c in symbols:
        new = len(steps)
        steps.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        p = last
        while p >= 0 and c not in steps[p]:
            steps[p][c] = new
            p = link[p]
        if p >= 0:
            q = steps[p][c]
            if longest[q] == longest[p] + 1:
                link[new] = q
            else:
                twin = len(steps)
                steps.append(dict(steps[q]))
                link.append(link[q])
                longest.append(longest[p] + 1)
                while p >= 0 and steps[p].get(c) == q:
                    steps[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return steps


def train(docs: DataFrame, docs_per_language: int = 64, chars_per_document: int = 320) -> Model:
    """Automata of a sample of at most docs_per_language * chars_per_document characters each."""
    rows = sample(docs, docs_per_language, chars_per_document).orderBy("lang", "n").collect()
    lower, texts = letters(), {}
    for r in rows:
        texts.setdefault(r.lang, []).append(r.text)
    flat = {k: _separated(lower[np.frombuffer(" ".join(v).encode("utf-32-le"), np.uint32)]) for k, v in texts.items()}
    known = np.unique(np.concatenate([*flat.values(), np.zeros(0, np.int32)]))
    known = known[known > 0]
    symbol = np.where(lower > 0, 1, 0).astype(np.uint16)
    place = np.searchsorted(known, lower)
    hit = (lower > 0) & (place < len(known))
    hit[hit] = known[place[hit]] == lower[hit]
    symbol[hit] = place[hit] + 2
    width = len(known) + 3  # the last symbol fills up blocks
    tables, cost, names = [], [], []
    for lang, codes in sorted(flat.items()):
        if not (codes > 0).any():
            continue
        steps = suffix_automaton([int(s) for s in np.where(codes > 0, np.searchsorted(known, codes) + 2, 0)])
        table = np.empty((len(steps), width), np.int32)
        start = np.full(width, MISS, np.int32)  # a symbol that the sample lacks is a phrase of its own
        for s, to in steps[0].items():
            start[s] = to * width
        table[:] = start | MISS
        for at, to in enumerate(steps):
            for s, state in to.items():
                table[at, s] = state * width
        table[:, -1] = 0
        tables.append(table.ravel())
        cost.append(np.log2(len(codes) + 1))
        names.append(lang)
    return Model(names, symbol, tables, width, np.array(cost))


def _separated(codes: np.ndarray) -> np.ndarray:
    """One 0 for each run of zeros."""
    keep = codes > 0
    keep[1:] |= codes[:-1] > 0
    return codes[keep]


def parse(model: Model, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cost per symbol by text and language; whether the text has a letter."""
    n = len(at) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    head = np.cumsum(np.concatenate([[0], (data & 0xC0) != 0x80]))[at]  # code points before each text
    codes = model.symbol[points]
    text = np.repeat(np.arange(n), np.diff(head))
    keep = codes > 0
    some = np.bincount(text[keep], minlength=n) > 0
    if len(codes):
        keep[1:] |= (codes[:-1] > 0) & (text[1:] == text[:-1])
    codes, text = codes[keep], text[keep]
    size = np.bincount(text, minlength=n)
    inside = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    blocks = -(-size // BLOCK)
    row = np.repeat(np.cumsum(blocks) - blocks, size) + inside // BLOCK
    grid = np.full((BLOCK, int(blocks.sum())), model.width - 1, np.int32)
    grid[inside % BLOCK, row] = codes
    owner = np.repeat(np.arange(n), blocks)
    cost = np.empty((n, len(model.languages)))
    for k, table in enumerate(model.tables):
        state = np.zeros(grid.shape[1], np.int32)
        phrases = np.ones(grid.shape[1], np.int32)  # the first, which no miss announces
        for symbols in grid:
            state = table[state + symbols]
            phrases += state >> 30
            state &= MISS - 1
        cost[:, k] = np.bincount(owner, phrases, minlength=n) * model.cost[k]
    return cost / np.maximum(size, 1)[:, None], some


def with_language(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and score: the runner-up's cost over that of both, 0.5 to 1."""
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("lang_pred", "score")])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text"):
                n = part.num_rows
                if model.languages:
                    cost, some = parse(model, *text_buffers(part.column(part.schema.get_field_index("text"))))
                    best = cost.argmin(axis=1)
                    least = cost[np.arange(n), best]
                    cost[np.arange(n), best] = np.inf
                    second = cost.min(axis=1)
                    score = np.where(np.isinf(second), 1.0, 1 / (1 + least / np.where(np.isinf(second), 1, second)))
                else:
                    some, best, score = np.zeros(n, bool), np.zeros(n, int), np.zeros(n)
                names = [model.languages[b] if s else UNKNOWN for b, s in zip(best, some)]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(names, pa.string()), pa.array(np.where(some, score, 0.0))],
                    names=[*part.schema.names, "lang_pred", "score"])

    out = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                        T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(run, out)


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents in a language that the model knows, with their own columns."""
    mark, score = "lang_pred", "score"
    clash = {c: f"__kept_{i}" for i, c in enumerate(docs.columns) if c.lower() in (mark, score)}
    held = docs.select(*[F.col(f"`{c}`").alias(clash.get(c, c)) for c in docs.columns])
    found = with_language(held, model).where(F.col(mark) != UNKNOWN)
    return found.select(*[F.col(f"`{clash.get(c, c)}`").alias(c) for c in docs.columns])
