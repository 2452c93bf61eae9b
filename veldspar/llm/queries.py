"""The queries of this package: each applies one operator to its whole table."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, embedding, fingerprint, language, late_overwrite, line_dedup, merkle, packing, pii, quality, simhash, warc
from .common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train_model(docs, _table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.near_lines(_table(spark, sf_dir, "documents"))


#: A conversation in another layout, whose texts look like marks of a template.
TRICKY = json.dumps({"messages": [{"role": r, "content": "\\### Assistant: </turn> ok"} for r in ("user", "assistant")]})


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = chat.turn_records(_table(spark, sf_dir, "conversations"))
    extra = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.lit(TRICKY).alias("record"))
    return chat.digests(chat.format_turns(chat.to_turns(records.unionByName(extra))))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", F.round("overlap", 6).alias("overlap"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload"))
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4()}"
    warc.write(pages, folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding.near_duplicates(_table(spark, sf_dir, "embeddings"))


#: A key for everyone to see; real ones come from a secret store.
SHOWN_KEY = "veldspar demonstration key"


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"), SHOWN_KEY)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train_model(docs))


def op11_late_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return late_overwrite.layouts(spark, _table(spark, sf_dir, "sales"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return fingerprint.compared(docs, fingerprint.rarity(docs))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(merkle.leaves(_table(spark, sf_dir, "documents"), merkle.tampered()))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_line_dedup": op2_line_dedup,
    "op3_chat_format": op3_chat_format,
    "op4_packing": op4_packing,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_warc": op7_warc,
    "op8_embedding_near_dedup": op8_embedding_near_dedup,
    "op9_pii": op9_pii,
    "op10_language_id": op10_language_id,
    "op11_late_overwrite": op11_late_overwrite,
    "op12_fingerprints": op12_fingerprints,
    "op13_merkle_manifest": op13_merkle_manifest,
}

#: Components of ``links`` (u, v) over ``nodes`` (node), as a recursive query.
REACHED = "reached as (select node, node as other from nodes union select r.node, l.v from reached r join (select u, v from links union all select v, u from links) l on l.u = r.other)"

LINES_SQL = f"""
with recursive lines as (select doc_id, unnest(string_split(text, chr(10))) as line, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::integer as line_no from documents),
different as (select line, min((doc_id, line_no)) as node, count(*) as n_copies, length(line) as n, least(2, length(line) // 10) as edits from lines group by line),
links as (select a.node as u, b.node as v from different a join different b on a.edits > 0 and b.n between a.n and a.n + a.edits and (b.n > a.n or a.node < b.node) and levenshtein(a.line, b.line) <= a.edits),
nodes as (select u as node from links union select v from links),
{REACHED},
classes as (select node, min(other) as class from reached group by node),
degrees as (select node, count(*) as n_links from (select u as node from links union all select v from links) group by node),
known as (select d.line, coalesce(c.class, d.node) as class, d.n_copies, coalesce(g.n_links, 0) as n_links from different d left join classes c using (node) left join degrees g using (node))
select l.doc_id, l.line_no, k.class[1] as class_doc_id, k.class[2] as class_line_no, k.n_copies::bigint as n_copies, k.n_links::bigint as n_links, k.class = (l.doc_id, l.line_no) as kept
from lines l join known k using (line)
"""

_ESCAPED = "length({0}) + length({0}) - length(replace({0}, '\\', '')) + length({0}) - length(regexp_replace({0}, '#+', '#', 'g')) + (length({0}) - length(replace({0}, '</turn>', ''))) // 7"

CHAT_SQL = f"""
with turns as (
select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
union all select -7, unnest([0, 1]), unnest(['user', 'assistant']), '\\### Assistant: </turn> ok'),
made as (select *, length('### : </turn>') + 1 + length(role) - length(replace(role, ':', '')) + {_ESCAPED.format("role")} + {_ESCAPED.format("text")} as n from turns)
select conv_id, count(*)::bigint as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars, sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text)) as loss_sha256, sum(n)::bigint as formatted_chars
from made group by conv_id
"""


def _shingles_sql(table: str, key: str) -> str:
    words = f"select {key}, list_filter(list_transform(string_split_regex(lower(text), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> '') as w from {table} where text is not null"
    return f"select distinct {key}, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: list_slice(w, i, i + 4)) when len(w) > 0 then [w] else [] end) as s from ({words})"


def _words_sql(text: str) -> str:
    return f"list_filter(list_transform(string_split_regex(lower({text}), '\\s+'), lambda w: regexp_replace(w, '[^\\p{{L}}\\p{{N}}]', '', 'g')), lambda w: w <> '')"


#: An item's answer is its last sentence, where it has several: of its words as many have to be there as of its shingles.
LEAKS_SQL = f"""
with items as ({_shingles_sql("benchmark", "item_id")}), docs as ({_shingles_sql("documents", "doc_id")}), sizes as (select item_id, count(*) as n from items group by 1),
held as (select doc_id, item_id, count(*)::double / any_value(n) as overlap from items join docs using (s) join sizes using (item_id) group by 1, 2 having count(*) >= 0.8 * any_value(n) - 1e-9),
said as (select item_id, list_filter(string_split(regexp_replace(trim(text), '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda s: s <> '') as sentences from benchmark),
answers as (select item_id, case when len(sentences) > 1 then list_distinct({_words_sql("sentences[-1]")}) else [] end as answer from said),
spoken as (select doc_id, list_distinct({_words_sql("text")}) as words from documents where doc_id in (select doc_id from held))
select doc_id, item_id, round(overlap, 6) as overlap from held join answers using (item_id) join spoken using (doc_id) where len(list_intersect(answer, words)) >= 0.8 * len(answer) - 1e-9
"""

WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages), q as (select page_id, html, strlen(html) as n, max(page_id) over (partition by html) as last from p)
select page_id, n::bigint as payload_bytes, sha1(html) as payload_digest, case when n >= 1000 and last <> page_id then 'revisit' else 'response' end as record_type, case when n >= 1000 and last <> page_id then last end as refers_to from q
"""

VECTORS_SQL = f"""
with recursive v as (select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings),
u as (select vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as e from v where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (select a.vec_id as u, b.vec_id as v from u a join u b on a.vec_id < b.vec_id and list_dot_product(a.e, b.e) >= 0.95),
nodes as (select vec_id as node from embeddings),
{REACHED},
parts as (select node, min(other) as part from reached group by node),
degrees as (select node, count(*) as n from (select u as node from links union all select v from links) group by node)
select node as vec_id, coalesce(n, 0)::bigint as n_links, part as component_id, part = node as kept from parts left join degrees using (node)
"""


def _row_sql(n_chars: str) -> str:
    return " || ".join(f"coalesce(strlen(({c})::varchar)::varchar || ':' || ({c})::varchar, '-')" for c in ("doc_id", "source", "lang", n_chars, "text"))


#: t: the table of the CRC-32's polynomial. low: the trees of the groups, high: the one above, way: the siblings of a leaf, each with its side.
MERKLE_SQL = f"""
with recursive tab as (select list(c order by k) as t from (select k, list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as k))),
docs as (select *, coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::varchar, ''), lambda x: ord(x)::bigint)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0, false) as hit from documents, tab),
made as (select doc_id, lang, sha256({_row_sql('n_chars')}) as leaf, sha256({_row_sql('n_chars + case when hit then 1 else 0 end')}) as shown from docs),
leaves as (select *, dense_rank() over (order by lang nulls first) - 1 as g, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as i from made),
low as (select g, 0 as level, i, leaf as d from leaves union all select g, level + 1, i // 2, sha256(string_agg(d, '' order by i)) from (select *, count(*) over (partition by g) as n from low) where n > 1 group by g, level, i // 2),
sizes as (select g, max(level) as top from low group by g),
subroots as (select g, d as subroot from low join sizes using (g) where level = top),
high as (select 0 as level, g as i, subroot as d from subroots union all select level + 1, i // 2, sha256(string_agg(d, '' order by i)) from (select *, count(*) over () as n from high) where n > 1 group by level, i // 2),
steps as (
select l.g, l.i, k as rung, case when o.d is null then '=' when o.i < l.i >> k then '<' || o.d else '>' || o.d end as step from (select l.g, l.i, unnest(range(s.top)) as k from leaves l join sizes s using (g)) l left join low o on o.g = l.g and o.level = l.k and o.i = xor(l.i >> l.k, 1)
union all select l.g, l.i, 1000 + k, case when o.d is null then '=' when o.i < l.g >> k then '<' || o.d else '>' || o.d end from (select g, i, unnest(range((select max(level) from high))) as k from leaves) l left join high o on o.level = l.k and o.i = xor(l.g >> l.k, 1)),
ways as (select g, i, list(step order by rung) as way from steps group by g, i),
known as (select l.*, s.subroot, (select d from high order by level desc limit 1) as root, coalesce(w.way, []) as way from leaves l join subroots s using (g) left join ways w using (g, i)),
folded as (select *, list_reduce(list_prepend(shown, way), lambda a, x: sha256(case when x[1] = '<' then x[2:] || a when x[1] = '>' then a || x[2:] else a end)) as folded_root from known)
select doc_id, leaf, subroot, root, sha256(array_to_string(list_transform(way, lambda x: x[2:]), '')) as proof_sha256, folded_root, folded_root = root as verified from folded
"""

#: DuckDB SQL for those queries that it can express over whole tables; the others are tested against brute force.
ORACLE_SQL: dict[str, str] = {"op2_line_dedup": LINES_SQL, "op3_chat_format": CHAT_SQL, "op6_decontamination": LEAKS_SQL, "op7_warc": WARC_SQL, "op8_embedding_near_dedup": VECTORS_SQL, "op13_merkle_manifest": MERKLE_SQL}
