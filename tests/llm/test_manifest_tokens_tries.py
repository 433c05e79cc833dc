"""Merkle manifest, byte-level BPE and prefix trie against plain versions on small tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from marketfold.llm import bpe, merkle, trie

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# --- manifest -------------------------------------------------------------------------

def leaf(row, more=0):
    values = [row[0], row[1], row[2], None if row[3] is None else row[3] + more, row[4]]
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in values])


def tree(nodes):
    """(top, [(side, sibling or None), ...] per leaf)."""
    paths, places = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, at in enumerate(places):
            other = at ^ 1
            paths[i].append((at & 1, nodes[other] if other < len(nodes) else None))
        nodes = [sha(*nodes[i:i + 2]) for i in range(0, len(nodes), 2)]
        places = [p // 2 for p in places]
    return nodes[0], paths


def manifest_by_hand(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        mine = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = (mine, *tree([leaf(r) for r in mine]))
    root, upper = tree([trees[lang][1] for lang in langs])
    out = []
    for i, lang in enumerate(langs):
        mine, top, paths = trees[lang]
        for row, path in zip(mine, paths):
            way = path + upper[i]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0
            node = leaf(row, 1 if tampered else 0)
            for side, other in way:
                node = sha(node) if other is None else sha(other, node) if side else sha(node, other)
            out.append((row[0], leaf(row), top, root, sha(*[o for _, o in way if o is not None]), node, node == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [1, 2, 10])
def test_manifest_equals_a_plain_tree(frame, bits):
    rng = random.Random(bits)
    rows = [(rng.choice([None, *range(60)]), rng.choice(["a", None]), rng.choice(["en"] * 5 + [None, "", "dé", "z"]),
             rng.choice([None, 5, 70]), rng.choice([None, "", "plain", "é€"])) for _ in range(61)]
    rows += [rows[0]] * 3 + [(7, "s", "lone", 1, "x" * 200_000)]
    docs = frame(DOCS, *rows).withColumns({"leaf": F.lit(1), "root": F.lit("clash"), "place": F.lit(0)})
    got = merkle.manifest(docs, bits).drop("siblings")
    assert sorted((tuple(r) for r in got.collect()), key=repr) == manifest_by_hand(rows)


def test_manifest_of_one_leaf_and_of_none(frame):
    row = (0, None, None, None, None)
    got = merkle.manifest(frame(DOCS, row)).collect()[0]
    assert got["leaf"] == got["subroot"] == got["root"] == leaf(row) and got["proof_sha256"] == sha("") and got["verified"]
    assert merkle.manifest(frame(DOCS, row).where("false")).count() == 0


# --- tokens ---------------------------------------------------------------------------

@pytest.fixture(scope="module")
def tokenizer_file():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


ODD = [None, "", " ", "  two  spaces ", "don't we'll I'M x's", "a<|endoftext|>b <|endoftext|>", "<|endoftext", "tab\t\n\n mix \r\n",
       "naïve café 北京大学 10²³ ½ Ⅻ", "emoji 👩‍👩‍👧 🎉!!", "҈ ք unassigned ͸ ꟑ 𐞂 𞤟", "\u0085   x y ​ \x1c\x1d\x00",
       "x" * 30_000, "word " * 40_000, "é" * 999, "same text", "same text"]


def test_bpe_equals_the_library(frame, tokenizer_file):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_file)
    rows = [(i if i % 5 else None, t, 0) for i, t in enumerate(ODD)]
    docs = frame("doc_id long, text string, ids int", *rows).withColumn("word", F.lit("clash"))
    for size in (60, bpe.CHUNK):
        got = bpe.round_trip(docs, tokenizer_file, size).collect()
        expected = []
        for doc_id, text, _ in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            expected.append((doc_id, ids, library.decode(ids, skip_special_tokens=False)))
        assert sorted((tuple(r) for r in got), key=repr) == sorted(expected, key=repr)
    assert bpe.round_trip(docs.where("false"), tokenizer_file).count() == 0


def test_agreed_characters_split_as_the_library_does():
    import regex
    from tokenizers import pre_tokenizers

    library, one, rule = pre_tokenizers.ByteLevel(add_prefix_space=False), regex.compile(bpe.AGREED), regex.compile(bpe.RULE)
    for c in map(chr, range(0xD800)):
        if one.fullmatch(c):
            text = f"a{c}{c} {c}1{c}  {c}!{c}"
            assert [s for _, s in library.pre_tokenize_str(text)] == [m.span() for m in rule.finditer(text)], hex(ord(c))


def test_equal_words_of_all_chunks_share_a_bucket(spark, frame, tokenizer_file):
    spec = spark.sparkContext.broadcast(open(tokenizer_file, encoding="utf-8").read())
    docs = frame("doc_id long, text string", *[(i, "the same words again and again") for i in range(200)])
    rows = bpe.split(docs, spec, 7, 100).where("bucket is not null").collect()
    found = defaultdict(set)
    for row in rows:
        lengths, content = bpe.unpack_lists(row["packed"], row["n"])
        ends = lengths.cumsum().tolist()
        for a, b in zip([0, *ends], ends):
            found[content[a:b]].add(row["bucket"])
    assert len({r["chunk"] for r in rows}) > 10
    assert sorted(found) == [b" again", b" and", b" same", b" words", b"the"] and all(len(b) == 1 for b in found.values())


# --- trie -----------------------------------------------------------------------------

def trie_by_hand(rows):
    given = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            given[conv].append((turn, role or "", text or ""))
    for conv, turns in given.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], sha(f"{len(t[1].encode())}:", t[1], t[2])))
    convs = {}
    for conv, turns in given.items():
        head = zlib.crc32(str(conv).encode()) % 6
        base = given.get(conv - conv % 100, [])
        convs[conv] = tuple((r, t) for _, r, t in base[:head] + turns[head:])
    members = defaultdict(list)
    for conv, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
    out = []
    for prefix, inside in members.items():
        below = [p for p in members if p[:len(prefix)] == prefix]
        kids = [p for p in below if len(p) == len(prefix) + 1]
        leaves = sum(not any(q[:-1] == p for q in below if len(q) == len(p) + 1) for p in below)
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = sorted(c for c in inside if convs[c] == prefix)
        out.append((min(inside), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(inside), len(kids), leaves, saved,
                    sha(",".join(map(str, ends)))))
    return sorted(out, key=repr)


TURNS = "conv_id long, turn long, role string, text string"


def conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [0, 1, 2, 3, 4, 5, 100, 101, 105, 207, 208, 300, 399]:
        for turn in range(rng.randrange(0, 7)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 2]), rng.choice(["user", "assistant", None]), rng.choice(["hi", "é", None, "ho"])))
    same = [(t, "user", f"turn {t}") for t in range(8)]
    rows += [(c, *turn) for c in range(1000, 1400, 7) for turn in same]  # a large group of copies
    rows += [(2000, t, "user", f"long {t}") for t in range(150)] + [(2001, t, "user", f"long {t}") for t in range(149)]
    rows += [(None, 0, "user", "nobody"), (None, None, None, None)]
    return rows + rows[:3]


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_equals_a_plain_one(frame, seed):
    rows = conversations(seed)
    turns = frame(TURNS, *rows).withColumns({"depth": F.lit(1), "n": F.lit(2), "high": F.lit("clash")})
    assert sorted((tuple(r) for r in trie.trie(turns).collect()), key=repr) == trie_by_hand(rows)


def test_trie_does_not_hang_on_the_screening(frame, monkeypatch):
    rows = conversations(3)
    monkeypatch.setattr(trie, "estimate_is_one", lambda *_: F.lit(False))
    assert sorted((tuple(r) for r in trie.trie(frame(TURNS, *rows)).collect()), key=repr) == trie_by_hand(rows)


def test_screening_proves_singletons_only(frame):
    rows = trie.prefixes(frame(TURNS, *conversations(4)))
    seen = trie.screened(rows)
    counts = seen.groupBy(*trie.NODE).agg(F.count("*").alias("n"), F.max(F.col("alone").cast("int")).alias("alone"))
    assert counts.where("alone = 1 and n > 1").count() == 0
    assert counts.where("alone = 1").count() > 0.9 * counts.where("n = 1").count() > 0


def test_trie_of_nothing_and_of_turnless_conversations(frame):
    assert trie.trie(frame(TURNS, (1, 1, "a", "b")).where("false")).count() == 0
    lone = next(c for c in range(1, 99) if zlib.crc32(str(c).encode()) % 6 == 5)
    rows = [(lone, 0, "user", "gone")]  # its head of five turns would come from conversation 0, which is absent
    assert sorted((tuple(r) for r in trie.trie(frame(TURNS, *rows)).collect()), key=repr) == trie_by_hand(rows)
