"""The registered queries of the subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import backoff, bagminhash, bpe, chat, dom, imatch, labelled, langid, latent, merkle, mixing, recompress, trie, warc
from .common import crc_of_id, table

TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(f: Callable[[SparkSession, str], DataFrame]):
    QUERIES[f.__name__] = f
    return f


@register
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.compare_edited(table(spark, sf_dir, "documents"))


@register
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each use of a document in the mixture."""
    return mixing.schedule(table(spark, sf_dir, "documents"))


SQL["op2_mixing"] = r"""
with counted as (
    select doc_id, source, coalesce(source, '') as source_name,
           cast(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) as bigint) as n_tokens
    from documents),
totals as (select source_name, sum(n_tokens) as tokens, count(*) as docs from counted group by source_name),
shares as (select *, tokens / sum(tokens) over () as p from totals),
chosen as (
    select ceil(greatest(1 - ln(2.0) / nullif(ln(max(p) / min(p)), 0), 0) * 10000 - 0.001) / 10000 as a
    from shares where tokens > 0),
powered as (select s.*, case when tokens > 0 then round(pow(p, coalesce(a, 0)), 9) end as power from shares s, chosen),
weighted as (select *, round(power / sum(power) over (), 6) as weight from powered),
planned as (
    select source_name, tokens, weight,
           coalesce(greatest(floor(weight * max(tokens / weight) over ()), tokens), 0) as budget,
           least(greatest(cast(ceil(tokens / 20000) as bigint), 1), docs) as blocks
    from weighted),
sized as (
    select *, cast(pow(2, ceil(log2(blocks))) as bigint) as size, cast(floor(budget / greatest(tokens, 1)) as bigint) as whole,
           cast(round(case when tokens > 0 then budget / tokens - floor(budget / tokens) else 0 end * blocks) as bigint) as last
    from planned),
dealt as (
    select c.doc_id, c.source, c.n_tokens, s.*, greatest(whole, 1) as epochs,
           cast('0x' || substr(md5('block|' || coalesce(cast(doc_id as varchar), '')), 1, 8) as bigint) % blocks as block
    from counted c join sized s using (source_name)),
used as (
    select *, unnest(range(0, epochs + 1)) as epoch from dealt),
ordered as (
    select *, (block * (2 * (cast('0x' || substr(md5('step|' || source_name || '|' || epoch), 1, 8) as bigint) % 1048576) + 1)
              + cast('0x' || substr(md5('shift|' || source_name || '|' || epoch), 1, 8) as bigint) % 1048576) % size as nth
    from used)
select doc_id, source, n_tokens, weight, cast(epoch as bigint) as epoch, cast(block as bigint) as block,
       round(least((epoch + nth / size) / (epochs + last / blocks), 1.0), 9) as place
from ordered where epoch < epochs or nth * blocks < last * size"""


@register
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class, and the links found between its text and others."""
    found = bagminhash.classes(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id", "links")


@register
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


SQL["op4_warc"] = """
with paid as (
    select page_id, coalesce(html, '') as html, sha1(coalesce(html, '')) as h from pages),
first as (select h, min(page_id) as low from paid group by h)
select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + (
           (cast('0x' || substr(h, cast(1 + 5 * (i // 4) as bigint), 5) as bigint) >> cast(15 - 5 * (i % 4) as bigint)) & 31) as bigint), 1)), '')
           as payload_digest,
       case when page_id = low then 'response' else 'revisit' end as record_type,
       case when page_id <> low then low end as refers_to
from paid join first using (h)"""


@register
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompress.digest(table(spark, sf_dir, "documents"))


SQL["op5_substring_dedup"] = r"""
with split as (
    select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words
    from documents),
starts as (select doc_id, words, unnest(range(1, len(words) - 48)) as i from split where len(words) >= 50),
named as (select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h from starts),
late as (
    select doc_id, i from named join (select h, min(doc_id) as low from named group by h) using (h) where doc_id > low),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as i from late),
each_word as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from split),
kept as (
    select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n
    from each_word anti join gone using (doc_id, i) group by doc_id)
select s.doc_id, cast(len(s.words) as bigint) as n_words, cast(len(s.words) - coalesce(k.n, 0) as bigint) as n_removed,
       sha256(coalesce(k.text, '')) as kept_sha256
from split s left join kept k using (doc_id)"""


@register
def op6_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return backoff.scores(docs, F.pmod(crc_of_id(), F.lit(7)) == 2)


@register
def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.main_text(table(spark, sf_dir, "pages"), dom.fit(labelled.pages()))


@register
def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that documents leak."""
    return latent.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(crc_of_id(), F.lit(3)) == 1
    model = langid.train(docs.where(~held_out))
    return langid.with_language(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


@register
def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each turn of the repaired conversations."""
    return chat.formatted(table(spark, sf_dir, "conversations"))


@register
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A leaf, its proof and its verification for each document."""
    return merkle.manifest(table(spark, sf_dir, "documents")).drop("siblings")


# crc32 of a decimal number, one bit at a time: -1 in the list stands for a shift.
_CRC = """list_reduce(list_concat([4294967295::bigint], flatten(list_transform(range(1, len({0}) + 1), lambda i: list_concat(
    [cast(ascii(substr({0}, cast(i as integer), 1)) as bigint)], list_transform(range(0, 8), lambda k: -1::bigint))))),
    lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)"""


def crc(text: str) -> str:
    return f"xor({_CRC.format(text)}, 4294967295::bigint)"


_FRAMED = "case when {0} is null then '-' else strlen(cast({0} as varchar)) || ':' || {0} end"
_LEAF = "sha256(concat({}))"


def _leaf(n_chars: str) -> str:
    return _LEAF.format(", ".join(_FRAMED.format(c) for c in ("doc_id", "source", "lang", f"({n_chars})", "text")))


_PAIRS = "list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], '')))"

SQL["op11_merkle_manifest"] = f"""
with recursive leaves as (
    select doc_id, lang, {_leaf('n_chars')} as leaf,
           case when {crc('cast(doc_id as varchar)')} % 7 = 0 then {_leaf('n_chars + 1')} else {_leaf('n_chars')} end as changed
    from documents),
placed as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as place from leaves),
levels as (
    select lang, 0 as level, list(leaf order by place) as nodes from placed group by lang
    union all select lang, level + 1, {_PAIRS} from levels where len(nodes) > 1),
tops as (select lang, nodes[1] as subroot from levels where len(nodes) = 1),
ranked as (select *, row_number() over (order by lang nulls first) - 1 as rank from tops),
uppers as (
    select 0 as level, list(subroot order by rank) as nodes from ranked
    union all select level + 1, {_PAIRS} from uppers where len(nodes) > 1),
top as (select nodes[1] as root from uppers where len(nodes) = 1),
steps as (
    select ranked.lang, rank, subroot, list(levels.nodes order by level) as own, (select list(nodes order by level) from uppers) as outer_nodes
    from ranked join levels on ranked.lang is not distinct from levels.lang group by ranked.lang, rank, subroot),
sides as (
    select p.*, s.subroot,
           list_concat(list_transform(range(0, len(own) - 1), lambda l: struct_pack(at := (place >> l) & 1, other := own[l + 1][xor(place >> l, 1) + 1])),
                       list_transform(range(0, len(outer_nodes) - 1), lambda l: struct_pack(at := (rank >> l) & 1, other := outer_nodes[l + 1][xor(rank >> l, 1) + 1])))
               as way
    from placed p join steps s on p.lang is not distinct from s.lang),
folded as (
    select doc_id, leaf, subroot, changed as node, way, 0 as level from sides
    union all
    select doc_id, leaf, subroot,
           sha256(case when way[level + 1].at = 1 then way[level + 1].other || node else node || coalesce(way[level + 1].other, '') end),
           way, level + 1
    from folded where level < len(way))
select doc_id, leaf, subroot, root, sha256(array_to_string(list_filter(list_transform(way, lambda s: s.other), lambda o: o is not null), '')) as proof_sha256,
       node as folded_root, node = root as verified
from folded, top where level = len(way)"""


@register
def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of each document and the text they decode to, as counts and hashes."""
    import public_tokenizers

    found = bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@register
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per node of the conversations' prefix trie."""
    return trie.trie(table(spark, sf_dir, "conversations"))


SQL["op13_prefix_trie"] = f"""
with original as (
    select conv_id as c, list({{'r': coalesce(role, ''), 't': coalesce(text, '')}} order by turn nulls first, coalesce(role, ''),
           sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as turns
    from conversations where conv_id is not null group by conv_id),
headed as (select *, {crc('cast(c as varchar)')} % 6 as h from original),
whole as (
    select o.c, list_concat(coalesce(b.turns, [])[:o.h], o.turns[o.h + 1:]) as turns
    from headed o left join original b on b.c = o.c - o.c % 100),
starts as (select c, turns, unnest(range(0, len(turns) + 1)) as depth from whole),
named as (select c, depth, turns[:depth] as prefix, len(turns) = depth as last from starts),
nodes as (
    select prefix, depth, min(c) as conv_id, count(*) as n_convs, max(case when depth > 0 then length(prefix[depth].t) else 0 end) as chars,
           coalesce(string_agg(cast(c as varchar), ',' order by c) filter (last), '') as members
    from named group by prefix, depth),
children as (select prefix[:depth - 1] as prefix, count(*) as n from nodes where depth > 0 group by 1),
above as (
    select w.prefix[:up] as prefix, sum((n_convs - 1) * chars) as saved, sum(case when c.n is null then 1 else 0 end) as leaves
    from (select *, unnest(range(0, depth + 1)) as up from nodes) w left join children c on c.prefix = w.prefix group by 1)
select v.conv_id, v.depth, p.conv_id as parent_conv_id, v.n_convs, coalesce(c.n, 0) as n_children, cast(a.leaves as bigint) as n_leaves,
       cast(a.saved as bigint) as saved_tokens, sha256(v.members) as ends_sha256
from nodes v join above a on a.prefix = v.prefix left join children c on c.prefix = v.prefix
left join nodes p on v.depth > 0 and p.prefix = v.prefix[:v.depth - 1]"""
