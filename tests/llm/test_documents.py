"""Document operators against brute force, and on rows that are odd in every way."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marketfold.llm import backoff, bagminhash, imatch, langid, latent, mixing, recompress
from marketfold.llm.common import crc_of_id
from marketfold.llm.words import Words, slices

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id long, score double, block string, "
          "copied boolean, windows string, lang_pred string, place string, row string")
RNG = random.Random(3)
VOCABULARY = ["".join(RNG.choices("abcdefghijklmnoprstu", k=RNG.randint(2, 7))) for _ in range(900)]


def prose(n, seed):
    return " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", text or "") if w]


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, nulls, empty and very long texts, repeated rows."""
    first, passage = prose(120, 1), prose(60, 2)
    changed = " ".join(w if i != 40 else "other" for i, w in enumerate(first.split()))
    texts = {0: first, 1: prose(150, 3) + " " + passage, 2: first, 3: changed, 4: passage + "\n" + prose(90, 4), 5: None, 6: "", 7: " \t ",
             8: "word " * 300, 9: "word " * 200, 10: prose(30_000, 5), 11: "###", 12: "a", 13: prose(4, 6), 14: prose(4, 6),
             15: prose(70, 7), 16: "ab cd " * 80, 17: "ab cd " * 60, 18: passage}
    found = [(d, t, None if d % 5 == 4 else "xx" if d % 2 else "yy", None if d == 3 else f"s{d % 2}", None if t is None else len(t),
              1, 0.5, "b", True, "w", "q", "p", "r") for d, t in texts.items()]
    return found + [found[0], (None, prose(80, 8), "xx", "s0", 1, None, None, None, None, None, None, None, None),
                    (None, None, None, None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def benchmark(spark):
    items = [(1, prose(40, 100)), (2, prose(25, 101)), (3, None), (4, ""), (None, prose(20, 102)), (2, prose(25, 101))]
    return spark.createDataFrame(items, "item_id long, text string")


def test_words_and_slices():
    column = pa.array(["a  b\tc", None, "", " x ", "é  ü"])
    words = Words(column)
    assert words.counts.tolist() == [3, 0, 0, 1, 2]
    h = words.hashes()
    assert h[0] == Words(pa.array(["zz a"])).hashes()[1] and len(set(h.tolist())) == 6
    batch = pa.RecordBatch.from_arrays([pa.array([None, "x" * 50, "", "y"])], names=["text"])
    assert [p.num_rows for p in slices(batch, "text", 10)] == [1, 1, 2]


def test_fingerprints(spark, docs, none, rows):
    got = imatch.compare_edited(docs).collect()
    assert len(got) == len(rows)
    texts = {d: t or "" for d, t, *_ in rows if d is not None}
    ids = sorted(texts)
    by_text = collections.defaultdict(set)
    for r in got:
        if r.doc_id is None:
            assert r.near_next == 0.0
            continue
        text, next_ = texts[r.doc_id], texts[ids[(ids.index(r.doc_id) + 1) % len(ids)]]
        n = len(text) // 4
        edited = text[:len(text) - n] + next_[:n]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        by_text[text].add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and by_text[texts[0]] != by_text[texts[15]]
    assert imatch.compare_edited(none).count() == 0


def test_mixture(spark, docs, none):
    out = mixing.mixed(docs)
    assert out.columns[:5] == docs.columns[:5] and out.columns[-3:] == ["epoch", "block", "place"]
    used = out.groupBy("doc_id", "text").count().collect()
    assert len(used) == docs.select("doc_id", "text").distinct().count() and max(r["count"] for r in used) <= 2 * 3
    assert mixing.mixed(none).count() == 0


def test_a_very_small_source_keeps_its_weight(spark):
    sizes = {"hot": 10 ** 11, "other": 5 * 10 ** 10, "small": 1500, "none": 0}
    planned = {r.source_name: r for r in mixing.plan(spark.createDataFrame(list(sizes.items()), "source string, n_tokens long")).collect()}
    assert planned["none"].weight is None and planned["none"].budget == 0
    assert all(planned[k].weight > 0 and n <= planned[k].budget <= 2.001 * n for k, n in sizes.items() if n)
    assert planned["small"].budget > 1.9 * sizes["small"] and planned["small"].weight == pytest.approx(2e-8, rel=0.05)
    assert planned["hot"].budget == pytest.approx(sizes["hot"], rel=1e-9)


@pytest.mark.parametrize("entropy, least", [(1.0, 0.0), (0.6, 0.5)])
def test_exponent(spark, entropy, least):
    totals = spark.createDataFrame([(str(i), 10 ** (2 + i)) for i in range(5)], "source_name string, tokens long")
    a = mixing.exponent(totals, repeat=2.0, entropy=entropy)
    p = np.array([10.0 ** (2 + i) for i in range(5)])
    p /= p.sum()
    assert a >= least and (p ** (a - 1)).max() / (p ** (a - 1)).min() <= 2.0 * (1 + 1e-9)
    w = p ** a / (p ** a).sum()
    assert -(w * np.log(w)).sum() / np.log(5) <= entropy + 1e-6
    assert a == 1 or (p ** (a - 2e-4 - 1)).max() / (p ** (a - 2e-4 - 1)).min() > 2.0 or entropy < 1


def likeness(a, b):
    bags = [collections.Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1))) for w in (split(a), split(b))]
    both = sum((bags[0] & bags[1]).values())
    return both / (sum(bags[0].values()) + sum(bags[1].values()) - both)


def test_near_duplicates(spark, docs, none, rows):
    got = {r.id: r.class_id for r in bagminhash.classes(docs).collect()}
    known = {d: t for d, t, *_ in rows if d is not None}
    for a in known:
        for b in known:
            if a < b and split(known[a]) and split(known[b]) and likeness(known[a], known[b]) >= 0.8:
                assert got[a] == got[b]
    assert got[0] == got[2] == got[3] == 0 and got[13] == got[14] and got[15] == 15 and got[7] == 7 and got[5] == got[6]
    kept = bagminhash.keep_one(docs)
    assert kept.columns == docs.columns and {2, 3, 14, 6} & {r.doc_id for r in kept.collect()} == set()
    assert kept.count() == len(set(got.values()))
    assert bagminhash.classes(none).count() == 0 and bagminhash.keep_one(none).count() == 0


def test_many_versions_of_one_text(spark):
    """Versions near the original and far from each other are one class; farther ones are left alone."""
    base = prose(300, 50).split()
    rng, rows = random.Random(9), [(1000, " ".join(base))]
    for i in range(60):
        edits = 5 if i < 40 else 60
        words = list(base)
        for at in rng.sample(range(300), edits):
            words[at] = f"e{i}x{at}"
        rows.append((i, " ".join(words)))
    got = {r.id: r.class_id for r in bagminhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    near = {d for d in texts if likeness(texts[d], texts[1000]) >= 0.8}
    assert len(near) > 35 and {got[d] for d in near} == {min(near)} and all(got[d] == d for d in texts if d not in near)


def test_signatures_are_unbiased():
    rng = np.random.default_rng(0)
    element = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    a, b = rng.integers(1, 9, 300), rng.integers(1, 9, 300)
    s = bagminhash.signatures(np.concatenate([element[:200], element[100:]]), np.concatenate([a[:200], b[100:]]),
                              np.array([0, 200, 400]), 4096)
    weights = np.zeros((2, 300))
    weights[0, :200], weights[1, 100:] = a[:200], b[100:]
    true = weights.min(axis=0).sum() / weights.max(axis=0).sum()
    assert abs((s[0] == s[1]).mean() - true) < 5 * (true * (1 - true) / 4096) ** 0.5


def removed(rows):
    first = {}
    for d, t in sorted(rows):
        w = split(t)
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i:i + 50]), d)
    out = {}
    for d, t in rows:
        w = split(t)
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - 49):
            if first[tuple(w[i:i + 50])] < d:
                gone[i:i + 50] = True
        out[d] = [x for x, g in zip(w, gone) if not g], int(gone.sum()), len(w)
    return out


def test_substrings(spark, docs, none, rows):
    known = {d: t for d, t, *_ in rows if d is not None}
    want = removed(list(known.items()))
    for r in recompress.digest(docs).where("doc_id is not null").collect():
        kept, n, words = want[r.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (words, n, hashlib.sha256(" ".join(kept).encode()).hexdigest())
    left = {r.doc_id: r.text for r in recompress.without_repeats(docs).collect()}
    assert left[0] == known[0] and 2 not in left and 18 not in left and left[7] == known[7] and left[4] == " ".join(want[4][0])
    assert recompress.without_repeats(docs).columns == docs.columns
    assert recompress.digest(none).count() == 0 and recompress.without_repeats(none).count() == 0


def test_equal_windows_have_equal_anchors():
    """Whatever surrounds it, a window chooses the same anchor."""
    rng = random.Random(4)
    pool = [" ".join(rng.choices(VOCABULARY[:200], k=rng.randint(55, 90))) for _ in range(10)] + ["x y " * 60, "z " * 80, "a a b " * 40]
    texts = [" ".join(rng.choices(VOCABULARY[:50], k=rng.randint(0, 9)) + [rng.choice(pool)] + rng.choices(VOCABULARY[:50], k=rng.randint(0, 9)))
             for _ in range(400)]
    words = Words(pa.array(texts))
    h = words.hashes()
    first, own = recompress.windows(h, words.word_at)
    names = recompress.anchors(h, words.word_at, first, own)
    seen = {}
    for window, name in zip(own.tolist(), names.tolist()):
        assert seen.setdefault(window, name) == name
    alone = np.concatenate([recompress.anchors(w.hashes(), w.word_at, *recompress.windows(w.hashes(), w.word_at))
                            for w in (Words(pa.array([t])) for t in texts)])
    assert (alone == names).all()


def test_scores(spark, docs, none, rows):
    held_out = F.pmod(crc_of_id(), F.lit(7)) == 2
    got = backoff.scores(docs.select("doc_id", "text"), held_out).collect()
    count, total = collections.Counter(), 0
    tokens = lambda t: split(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + ["\0end"]
    for d, t, *_ in rows:
        if zlib.crc32(("" if d is None else str(d)).encode()) % 7 != 2:
            count.update(tokens(t))
            total += len(tokens(t))
    texts = {d: t for d, t, *_ in rows if d is not None}
    assert len(got) == len(rows)
    for r in got:
        assert r.train_tokens == total and r.score <= 0
        if r.doc_id is not None:
            w = tokens(texts[r.doc_id])
            base = sum(np.log10((count[x] + 1) / (total + len(count) + 1)) for x in w)
            assert (r.n_tokens, r.n_known) == (len(w), sum(count[x] > 0 for x in w)) and abs(r.base_score - base) < 1e-6 * abs(base)
    assert backoff.scores(none.select("doc_id", "text"), held_out).count() == 0


def test_automaton_is_a_distribution_and_matches_recursion(spark, docs):
    model, _ = backoff.train(docs.select("text"))
    arcs = {int(k): (int(n), float(g)) for k, n, g in zip(model.keys, model.next, model.gain)}

    def fall(state, word):
        total = 0.0
        while (state << 32 | word) not in arcs and state:
            total, state = total + model.weight[state], int(model.fail[state])
        return total, state

    rest = 1 - (10 ** model.base(model.counts)).sum()
    for state in range(0, len(model.fail), max(1, len(model.fail) // 15)):
        total = sum(10 ** (lambda t: t[0] + arcs[t[1] << 32 | w][1])(fall(state, w)) for w in range(len(model.words)))
        assert total + 10 ** fall(state, 1 << 31)[0] * rest == pytest.approx(1, abs=1e-6)
    for text in ("", prose(120, 1) + " unseen " + prose(700, 5), "word word word"):
        hashes, at = backoff.tokens(pa.array([text]))
        places, state, want = model.places(hashes), int(model.places(backoff.END)[0]) + 1, 0.0
        for w in places.tolist():
            gain, state = fall(state, w if w >= 0 else 1 << 31)
            want += gain
            if w >= 0:
                want, state = want + arcs[state << 32 | w][1], arcs[state << 32 | w][0]
        assert backoff.traverse(model, places, at)[0] == pytest.approx(want)


def test_scores_keep_every_ngram_that_occurs_twice(spark, docs, monkeypatch):
    """Scores are those of the automaton of all kept n-grams, also where hardly a key is broadcast."""
    lines = [(i, prose(12, 900) + " " + prose(150, 1000 + i)) for i in range(40)] + [(r.doc_id, r.text) for r in docs.collect()]
    frame = spark.createDataFrame(lines, "doc_id long, text string")
    model, _ = backoff.train(frame.select("text"))
    hashes, at = backoff.tokens(pa.array([t for _, t in lines]))
    want = sorted(zip([-1 if d is None else d for d, _ in lines], backoff.traverse(model, model.places(hashes), at)))
    for share in (1e-6, 3e-3, 1.0):
        monkeypatch.setattr(backoff, "SHARE", share)
        got = backoff.scores(frame, F.lit(False)).collect()
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.score) for r in got)
        assert [d for d, _ in got] == [d for d, _ in want]
        assert np.allclose([s for _, s in got], [s for _, s in want])


def test_leaks(spark, benchmark, docs, none):
    item = prose(40, 100).split()
    rephrased = [w if i % 7 else "instead" for i, w in enumerate(item)]
    texts = [(i, prose(200, 200 + i)) for i in range(30)]
    texts += [(100, prose(90, 300) + " " + " ".join(item) + " " + prose(50, 301)), (101, " ".join(rephrased) + " " + prose(80, 302)),
              (102, prose(25, 101).upper().replace(" ", ", ")), (103, " ".join(item[:8]) + " " + prose(100, 303)), (104, None), (105, "")]
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    assert {(r.doc_id, r.item_id) for r in latent.search(frame, benchmark).collect()} == {(100, 1), (101, 1), (102, 2)}
    kept = {r.doc_id for r in latent.without_leaks(frame, benchmark).collect()}
    assert kept == {d for d, _ in texts} - {100, 101, 102}
    assert latent.without_leaks(docs, benchmark).columns == docs.columns
    assert latent.search(none, benchmark).count() == 0 and latent.search(docs, benchmark.limit(0)).count() == 0


def test_recall_of_candidates(spark):
    """Paraphrases that keep 0.55 to 0.75 of short and long items, wherever they stand, against
    the comparison of all stretches of the text: by cosine, and by counts for items outside of the space."""
    rng = random.Random(21)
    items = [rng.choices(VOCABULARY, k=n) for n in (15, 20, 31, 45, 59, 59, 110, 240)]
    row = collections.namedtuple("row", "item_id text")
    space = latent.read_items([row(i, " ".join(w)) for i, w in enumerate(items)])
    texts, want = [], set()
    for t in range(240):
        k, kept = t % len(items), (0.55, 0.6, 0.65, 0.75)[t // len(items) % 4]
        body = items[k][:-5]
        stay = set(rng.sample(range(len(body)), max(0, -int(-kept * len(items[k]) // 1) + 1 - 5)))
        texts.append(" ".join(rng.choices(VOCABULARY, k=rng.randint(0, 200)) + [w if i in stay else "other" for i, w in enumerate(body)]
                              + items[k][-5:] + rng.choices(VOCABULARY, k=rng.randint(0, 200))))
        want.add((t, k))
    latent.fit(spark.createDataFrame(list(enumerate(texts)), "id long, text string"), space)
    words = Words(pa.array(texts), plain=True)
    places = space.places(words.hashes())
    held = space.captured
    some = range(0, 240, 3)
    leaked = {(t, k) for t in some for k in range(len(items))
              if latent.accepts(*latent.compare(space.words[k], places[words.word_at[t]:words.word_at[t + 1]])[:2])}
    for captured, least in ((np.ones(len(items)), 0.97), (np.zeros(len(items)), 1), (held, 0.97)):
        space.captured = captured
        found = {(t, k) for t, k, *_ in latent.leaks(space, places, words.word_at)}
        assert len(want & found) >= 0.97 * len(want)
        assert len(leaked & found) >= least * len(leaked) > 0


def test_rare_items_keep_a_place_in_the_latent_space(spark):
    """One copy of each of many items whose words stand nowhere else is found among many texts."""
    rare = [" ".join(f"w{k}x{i}" for i in range(24)) for k in range(300)]
    texts = [(i, prose(120, 3000 + i)) for i in range(400)] + [(1000 + k, f"{prose(30, k)} {t} {prose(30, k + 9)}") for k, t in enumerate(rare)]
    items = spark.createDataFrame([(k, t) for k, t in enumerate(rare)] + [(900, prose(30, 99_077))], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in latent.search(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()}
    assert got == {(1000 + k, k) for k in range(300)}


def test_sums_by_block_and_term():
    rng = np.random.default_rng(4)
    rows, n = rng.integers(0, 9, (40, 5)).astype(np.float32), 1500
    block = np.sort(rng.permutation(np.repeat(np.arange(n), 16))[:9000])
    term = rng.integers(0, 40, 9000)
    want = np.zeros((n, 5), np.float32)
    np.add.at(want, block, rows[term])
    got = latent.block_sums(rows, term, block, n, 16)
    assert (got == want).all() and latent.block_sums(rows, term[:0], block[:0], 3, 16).sum() == 0
    total, back = np.zeros((40, 5)), np.zeros((40, 5))
    latent.term_sums(total, got, term, block)
    np.add.at(back, term, want[block])
    assert np.allclose(total, back)


def test_leaks_of_an_item_in_many_documents_and_of_common_words(spark):
    """How often an item or its words occur doesn't hide it."""
    common = [f"c{i}" for i in range(40)]
    rng = random.Random(12)
    frequent = rng.sample(common, 30)
    text = lambda i: prose(70, 400 + i) + " " + " ".join(rng.sample(common, 40)) + " " + prose(40, 800 + i)
    texts = [(i, prose(50, 1400 + i) + " " + prose(40, 100) + " " + prose(40, 1800 + i) if i % 3 == 0 else text(i)) for i in range(150)]
    texts += [(500, prose(60, 501) + " " + " ".join(frequent) + " " + prose(60, 502))]
    items = spark.createDataFrame([(1, prose(40, 100)), (2, " ".join(frequent))], "item_id long, text string")
    got = latent.search(spark.createDataFrame(texts, "doc_id long, text string"), items).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(i, 1) for i in range(0, 150, 3)} | {(500, 2)}
    assert all(r.share < 1 or r.cosine > 0 for r in got)


def test_common_subsequence():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = rng.integers(1, 6, rng.integers(1, 20)), rng.integers(0, 6, rng.integers(0, 30))
        t = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
        assert latent.common_subsequence(latent.bits(a), b, len(a)) == t[-1, -1]


def test_language(spark, docs, none):
    sides = {"aa": "abcde", "bb": "fghij", "cc": "vwxyz"}
    rng = random.Random(8)
    make = lambda k: " ".join("".join(rng.choices(sides[k], k=5)) for _ in range(60))
    rows = [(i, make(k), k) for i, k in enumerate(list(sides) * 20)]
    frame = spark.createDataFrame(rows + [(900, None, "aa"), (901, "", "bb"), (902, "12 ##", "cc"), (903, make("aa").upper(), None)],
                                  "doc_id long, text string, lang string")
    model = langid.train(frame.where("doc_id >= 30"))
    got = {r.doc_id: r for r in langid.with_language(frame, model).collect()}
    assert all(got[d].lang_pred == k for d, _, k in rows) and got[903].lang_pred == "aa"
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902)) and all(0 <= r.score <= 1 for r in got.values())
    known = langid.train(docs)
    assert langid.accepted(docs, known).columns == docs.columns
    kept = langid.accepted(docs, known).collect()
    assert {5, 6, 7, 11} & {r.doc_id for r in kept} == set() and all(r.score in (0.5, None) for r in kept)
    assert langid.with_language(none, langid.train(none)).count() == 0
    assert langid.with_language(docs, langid.train(none)).where("lang_pred <> 'und'").count() == 0


def test_phrases_are_longest_matches():
    """Within a block: each phrase is the longest prefix of the rest that the sample holds."""
    rng = random.Random(5)
    sample = "".join(rng.choices("abc", k=400))
    steps = langid.suffix_automaton([ord(c) - 95 for c in sample])
    text = "".join(rng.choices("abc", k=250))
    symbol = np.zeros(0x110000, np.uint16)
    symbol[[97, 98, 99]] = [2, 3, 4]
    table = np.empty((len(steps), 6), np.int32)
    start = np.full(6, langid.MISS, np.int32)
    for s, to in steps[0].items():
        start[s] = to * 6
    table[:] = start | langid.MISS
    for at, to in enumerate(steps):
        for s, state in to.items():
            table[at, s] = state * 6
    table[:, -1] = 0
    model = langid.Model(["x"], symbol, [table.ravel()], 6, np.ones(1))
    data = np.frombuffer(text.encode(), np.uint8)
    cost, some = langid.parse(model, data, np.array([0, len(data)]))
    phrases, at = 0, 0
    while at < len(text):
        size = 1
        while at + size < len(text) and text[at:at + size + 1] in sample:
            size += 1
        phrases, at = phrases + 1, at + size
    assert some[0] and round(cost[0, 0] * len(text)) == phrases


def test_pipeline_on_odd_rows(spark, tmp_path, rows, benchmark):
    folder = str(tmp_path)
    names = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([r[:5] for r in rows], names).write.parquet(f"{folder}/documents.parquet")
    benchmark.write.parquet(f"{folder}/benchmark.parquet")
    out = corpus_pipeline.run(spark, folder)
    ids = {r.doc_id for r in out.collect()}
    assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert {0, 1, 4, 10, 12, 15} <= ids and {2, 3, 5, 6, 7, 11, 14, 18}.isdisjoint(ids)
