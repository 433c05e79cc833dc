"""Byte-level BPE over a corpus: each distinct word is encoded once.

1. Tasks split texts into words by the tokenizer's rule and number the distinct words of each
   chunk of about ``CHUNK`` characters, bucket by bucket of a hash; a text becomes the numbers
   of its words, and a chunk leaves one row of words per bucket. Lists are packed.
2. The rows of a bucket, from all chunks, meet in one partition, in a table of the bucket's
   distinct words; each is encoded when it is first seen, and every row gets its ids.
3. Each chunk is cogrouped with its rows of ids: ids by position of the words, then pieces by id.
   The table of pieces, with a row per id of the vocabulary, goes to every task.

A word is sent once per chunk, however often it occurs, so frequent words are no hot keys, and no
row per token is ever shuffled. A chunk has a bounded size; only a text longer than ``CHUNK`` makes
a longer one. There are ``BUCKETS`` buckets per shuffle partition, so the words held at once are a
share of the corpus's distinct words that falls with the width of the job.

The tokenizer is the content of a ``tokenizers`` JSON file with a BPE model behind byte-level
splitting; strings of its added tokens are found in texts first, as that library does. Ids,
splits and decoded texts are those of the library.

Defined results: null counts as empty; an empty text has no ids and decodes to an empty text. Each
row is treated on its own, whatever its doc_id; an empty table gives no rows. Ids that do not
form UTF-8 decode to replacement characters.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import save_bucketed
from .words import slices

CHUNK = 32 << 20
BUCKETS = 4

# The published splitting rule of this kind of byte-level BPE.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Characters that every version of Unicode in use puts into the same classes; texts with others
# are split by the library itself, which may know fewer or more letters.
AGREED = r"[\x00-\u0530\u0561-\u0587\u2000-\u2064\u20A0-\u20B5\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FA5\uAC00-\uD7A3]*"

SPLIT = "chunk long, bucket int, doc_id long, n long, packed binary"


class Split:
    """Splits texts into words and added tokens."""

    def __init__(self, spec: dict):
        from tokenizers import pre_tokenizers

        before = spec["pre_tokenizer"]
        if spec["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or spec["model"]["type"] != "BPE":
            raise ValueError("not a byte-level BPE tokenizer without normalisation")
        added = [a["content"] for a in spec["added_tokens"]]
        if any(a["lstrip"] or a["rstrip"] or a["single_word"] for a in spec["added_tokens"]):
            raise ValueError("added tokens that take their surroundings are not handled")
        longest = sorted(added, key=len, reverse=True)
        self.added = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if added else None
        self.rule, self.agreed = regex.compile(RULE), regex.compile(AGREED)
        self.library = pre_tokenizers.ByteLevel(add_prefix_space=False)

    def plain(self, text: str) -> list[str]:
        if self.agreed.fullmatch(text):
            return self.rule.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenize_str(text)]

    def __call__(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.plain(text)
        found = []
        for i, piece in enumerate(self.added.split(text)):
            found += [piece] if i % 2 else self.plain(piece)
        return found


def pack(numbers) -> bytes:
    """Numbers by byte plane, compressed."""
    planes = np.asarray(numbers, "<u4").view(np.uint8).reshape(-1, 4).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(packed: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(packed, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, n).T).view("<u4").ravel()


def pack_lists(lengths, content: bytes) -> bytes:
    """Lengths of lists and what they hold, one after the other."""
    sizes = pack(lengths)
    return b"".join([len(sizes).to_bytes(4, "little"), len(content).to_bytes(8, "little"), sizes,
                     pa.compress(content, codec="zstd", asbytes=True)])


def unpack_lists(packed: bytes, n: int) -> tuple[np.ndarray, bytes]:
    sizes, length = int.from_bytes(packed[:4], "little"), int.from_bytes(packed[4:12], "little")
    return unpack(packed[12:12 + sizes], n), pa.decompress(packed[12 + sizes:], decompressed_size=length, codec="zstd", asbytes=True)


def _rows(schema: pa.Schema, *rows) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


class Numbers(dict):
    """Numbers of distinct words: the k-th word of bucket b has the number k * buckets + b."""

    def __init__(self, buckets: int):
        self.words: list[list[bytes]] = [[] for _ in range(buckets)]

    def __missing__(self, word: str) -> int:
        raw = word.encode()
        bucket = zlib.crc32(raw) % len(self.words)
        self[word] = number = len(self.words[bucket]) * len(self.words) + bucket
        self.words[bucket].append(raw)
        return number


def _splitter(spec, buckets: int, size: int):
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("doc_id", pa.int64()), ("n", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        split, chunk = Split(json.loads(spec.value)), TaskContext.get().partitionId() << 32
        known, held = Numbers(buckets), 0

        def dictionary():
            rows = [(chunk, b, None, len(w), pack_lists([len(x) for x in w], b"".join(w))) for b, w in enumerate(known.words) if w]
            return _rows(schema, *rows)
        for batch in batches:
            for piece in slices(batch, "text", min(size, 2 << 20)):
                rows = []
                for doc_id, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist()):
                    places = [known[w] for w in split(text or "")]
                    rows.append((chunk, None, doc_id, len(places), pack(places)))
                    held += len(text or "")
                yield _rows(schema, *rows)
                if held >= size:
                    if known:
                        yield dictionary()
                    known, held, chunk = Numbers(buckets), 0, chunk + 1
        if known:
            yield dictionary()
    return run


def _encoder(spec):
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("n", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        plan = json.loads(spec.value)
        added = {a["content"].encode(): [a["id"]] for a in plan["added_tokens"]}
        # Words are split already: only the bytes are still to be mapped.
        plan["pre_tokenizer"]["use_regex"], plan["added_tokens"] = False, []
        tokenizer = Tokenizer.from_str(json.dumps(plan))
        ids_of, current = {}, None
        for batch in batches:
            for chunk, bucket, n, packed in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if bucket != current:
                    ids_of, current = dict(added), bucket
                lengths, content = unpack_lists(packed, n)
                ends = np.cumsum(lengths).tolist()
                words = [content[a:b] for a, b in zip([0, *ends], ends)]
                new = [w for w in words if w not in ids_of]
                for word, found in zip(new, tokenizer.encode_batch([w.decode() for w in new], add_special_tokens=False)):
                    ids_of[word] = found.ids
                lists = [ids_of[w] for w in words]
                flat = np.fromiter((i for ids in lists for i in ids), "<u4")
                yield _rows(schema, (chunk, bucket, n, pack_lists([len(x) for x in lists], len(flat).to_bytes(8, "little") + pack(flat))))
    return run


def _byte_of() -> dict[str, int]:
    """The byte that each character of a piece stands for: printable ones for themselves, the
    others, in order, for the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def pieces(spec: dict) -> pa.BinaryArray:
    """The bytes of each id, in order of the ids; as many as the vocabulary has."""
    byte_of = _byte_of()
    found = {i: bytes(byte_of[c] for c in p) for p, i in spec["model"]["vocab"].items()}
    found |= {a["id"]: a["content"].encode() for a in spec["added_tokens"]}
    return pa.array([found.get(i) for i in range(max(found) + 1)], pa.binary())


def _assembler(table, buckets: int):
    """Ids and decoded texts of the documents of a chunk."""
    def run(docs: pa.Table, entries: pa.Table) -> pa.Table:
        flats, at = [], 0
        rows = list(zip(*(entries[c].to_pylist() for c in ("bucket", "n", "packed"))))
        size = max([b + (n - 1) * buckets + 1 for b, n, _ in rows], default=0)
        lengths, starts = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for bucket, n, packed in rows:
            counts, content = unpack_lists(packed, n)
            counts = counts.astype(np.int64)
            lengths[bucket::buckets][:n] = counts
            starts[bucket::buckets][:n] = at + np.cumsum(counts) - counts
            flats.append(unpack(content[8:], int.from_bytes(content[:8], "little")))
            at += len(flats[-1])
        flat = np.concatenate([*flats, np.zeros(0, "<u4")]).astype(np.int32)

        all_ids, ends, texts = [], [0], []
        for n, packed in zip(docs["n"].to_pylist(), docs["packed"].to_pylist()):
            places = unpack(packed, n)
            counts = lengths[places]
            shift = np.repeat(starts[places] - np.cumsum(counts) + counts, counts)
            ids = flat[shift + np.arange(len(shift))]
            all_ids.append(ids)
            ends.append(ends[-1] + len(ids))
            texts.append(_content(table.value.take(pa.array(ids))))
        values = np.concatenate([*all_ids, np.zeros(0, np.int32)])
        lists = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(values, pa.int32()))
        decoded = pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())
        return pa.table({"doc_id": docs["doc_id"].combine_chunks(), "ids": lists, "decoded": decoded})
    return run


def _content(array: pa.BinaryArray) -> bytes:
    """The values of an array without nulls, one after the other."""
    if not len(array):
        return b""
    _, offsets, data = array.buffers()
    where = np.frombuffer(offsets, np.int32)
    return bytes(memoryview(data)[where[array.offset]:where[array.offset + len(array)]])


def split(docs: DataFrame, spec, buckets: int, size: int = CHUNK) -> DataFrame:
    """(chunk, doc_id, places) per document and (chunk, bucket, words) per chunk, in one table; ``packed``
    holds ``n`` places or words."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_splitter(spec, buckets, size), SPLIT)


def encode_words(words: DataFrame, spec) -> DataFrame:
    """(chunk, bucket, ids of its words): a bucket's distinct words are encoded once."""
    dealt = words.select("chunk", "bucket", "n", "packed").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(_encoder(spec), "chunk long, bucket int, n long, packed binary")


def round_trip(docs: DataFrame, path: str, size: int = CHUNK) -> DataFrame:
    """doc_id, ids and the text decoded from them, for each row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    buckets = BUCKETS * int(spark.conf.get("spark.sql.shuffle.partitions"))
    with open(path, encoding="utf-8") as file:
        content = file.read()
    spec, table = spark.sparkContext.broadcast(content), spark.sparkContext.broadcast(pieces(json.loads(content)))
    # Documents stay where their chunk was cut: only words and ids are exchanged.
    parts = save_bucketed(split(docs, spec, buckets, size), "splits", "chunk")
    ids = encode_words(parts.where("bucket is not null"), spec)
    rows = parts.where("bucket is null").select("chunk", "doc_id", "n", "packed")
    return rows.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(
        _assembler(table, buckets), "doc_id long, ids array<int>, decoded string")
