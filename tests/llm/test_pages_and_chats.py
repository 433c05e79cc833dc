"""Archives, page extraction and chat repair against brute force and odd rows."""

from __future__ import annotations

import base64
import hashlib
import random
import re

import numpy as np
import pytest

from pyspark.sql import functions as F

from marketfold.llm import chat, dom, labelled, warc


def test_archive_round_trip(spark):
    rows = [(3, "http://a", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (2, "u", ""), (9, None, None), (5, "http://c", "é\r\n\r\nWARC/1.1\r\n"),
            (7, "http://d", "y" * 300_000), (8, "http://d", "y" * 300_000), (11, "k", "<p>x</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    first = {}
    for page, _, text in sorted(rows):
        first.setdefault(text or "", page)
    for page, _, text in rows:
        data, r = (text or "").encode(), got[page]
        assert (r.payload_bytes, r.payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if first[text or ""] == page else ("revisit", first[text or ""]))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archive_of_chosen_records(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"page {i} " * (i + 1)) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    index = warc.write(warc.decide(pages, least=1 << 20), str(tmp_path / "archive"))
    chosen = warc.read(index.where("page_id % 3 = 0"), str(tmp_path / "archive")).collect()
    assert {r.page_id: r.payload.decode() for r in chosen} == {i: t for i, _, t in rows if i % 3 == 0}


def test_ranges_join_neighbours():
    rows = [("a", 0, 10), ("a", 10, 5), ("a", 15 + warc.GAP + 1, 5), ("b", 20, 5)]
    assert warc.ranges(rows) == [("a", 0, 15, 2), ("a", 15 + warc.GAP + 1, 5, 1), ("b", 20, 5, 1)]


@pytest.fixture(scope="module")
def model():
    return dom.fit(labelled.pages())


def test_extraction_of_held_out_layouts(model):
    pages = labelled.pages(4, seed=99)
    trees = [dom.read(p) for p in pages]
    forest = dom.Forest(trees)
    label = np.array([x or 0 for t in trees for x in t.labels])
    assert ((model.marginals(forest)[forest.runs] >= 0.5) == label).mean() > 0.97


def test_extraction_details(model):
    text = "A sentence with quite some words in it, and more of them after the comma. Another one follows here."
    page = (f"<nav><ul><li><a href='/a'>Menu</a></ul></nav><div class='cookie-notice'>We use cookies.</div><article><h1>Title &amp; more</h1>"
            f"<p>{text}  a\n b&nbsp;&lt;c&gt;<!-- <p>no</p> --><p><b>{text}</b><script>var p='</p>';</script></article><form>Search {text}</form>"
            f"<section class='comments'><p>{text}</p></section><footer>{text}")
    assert dom.extract(model, [page]) == [f"Title & more\n{text} a b <c>\n{text}"]
    assert dom.extract(model, [None, "", "<p", "no markup", "<<>>&", "</p></div>"])[:2] == ["", ""]


def test_messages_equal_enumeration():
    rng = np.random.default_rng(1)
    trees = [dom.read("<div><p>a</p><ul><li>b<li>c</ul></div>")]
    forest = dom.Forest(trees)
    n = len(forest.parent)
    unary, pair = rng.normal(size=n), rng.normal(size=(dom.EDGES, 2))
    total, ones = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = np.array([code >> i & 1 for i in range(n)])
        log = (unary * y).sum()
        for child in np.flatnonzero(~forest.root):
            a, b = y[forest.parent[child]], y[child]
            log += pair[forest.edge[child], 0] * (a < b) + pair[forest.edge[child], 1] * (a > b)
        total += np.exp(log)
        ones += np.exp(log) * y
    held, _, _ = forest.beliefs(unary, pair)
    assert np.allclose(1 / (1 + np.exp(-held)), ones / total)


def test_extraction_query(spark, model):
    pages = spark.createDataFrame([(1, "u", None), (None, None, ""), (1, "u", None)], "page_id long, url string, html string")
    assert [(r.text, r.n_chars) for r in dom.main_text(pages, model).collect()] == [("", 0)] * 3
    assert dom.main_text(pages.limit(0), model).count() == 0


def cheapest(roles):
    best = {chat.START: 0.0}
    for role in roles:
        after = {}
        for at, to, cost, *_ in chat.moves(role):
            if at in best:
                after[to] = min(after.get(to, 1e18), best[at] + cost)
        best = after
    return min(k + chat.CLOSE[s] for s, k in best.items())


def test_repair_is_cheapest_and_legal(spark):
    rng, rows, want = random.Random(1), [], {}
    for conv in range(30):
        roles = [rng.choice(["system", "user", "assistant", "tool", None]) for _ in range(rng.choice((1, 2, 3, 6, 700)))]
        rows += [(conv, i, r, f"t{i}") for i, r in enumerate(roles)]
        want[conv] = cheapest([chat.ROLES.index(r) + 1 if r in chat.ROLES else 0 for r in roles])
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    out = out.sort_values(["conv_id", "block", "place"])
    assert out.groupby("conv_id").cost.sum().round(6).to_dict() == {k: round(v, 6) for k, v in want.items()}
    for _, turns in out.groupby("conv_id"):
        text = "".join(turns.rendered)
        roles = re.findall(r"<\|(system|user|assistant)\|>", text)
        assert re.fullmatch("S?(UA)+", "".join(r[0].upper() for r in roles)) and text.count("<|end|>") == len(roles) and text.endswith("<|end|>")
        found = re.findall(r"t\d+", text)
        assert found == [f"t{i}" for i in range(len(found))]


def test_chat_of_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "<|x|>"), (5, 2, "assistant", ""), (5, 2, "assistant", ""), (5, None, "user", "end")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.formatted(turns).toPandas().sort_values(["block", "place"])
    assert "< |x|>" in "".join(out[out.conv_id.isna()].rendered) and (out.action != "empty").sum() == 5
    assert chat.formatted(turns.limit(0)).count() == 0


def test_hot_conversation_without_turn_numbers(spark):
    rng = random.Random(3)
    roles = [rng.choice(["user", "assistant", "tool"]) for _ in range(900)]
    rows = [(None, rng.choice([None, 7]), r, "same") for r in roles] + [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    base = turns.select(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("conv"), "turn", "role", "text")
    blocks = chat.in_blocks(base).toPandas()
    hot = blocks[blocks.conv == ""]
    assert hot.groupby("block").size().to_dict() == {0: 256, 1: 256, 2: 256, 3: 132}
    assert sorted(hot.block * 256 + hot.seat) == list(range(900))
    out = chat.formatted(turns).toPandas()
    ordered = sorted(rows[:900], key=lambda r: (r[1] is None, r[1] or 0, r[2]))
    want = cheapest([chat.ROLES.index(r[2]) + 1 if r[2] in chat.ROLES else 0 for r in ordered])
    assert round(out[out.conv_id.isna()].cost.sum(), 6) == round(want, 6)
    assert out[out.conv_id == 1].action.tolist() == ["keep", "keep"]


def test_matrices_multiply():
    rng = random.Random(2)
    roles = [rng.randint(0, 3) for _ in range(40)]
    assert np.allclose(chat.times(chat.matrix(roles[:17]), chat.matrix(roles[17:])), chat.matrix(roles))
