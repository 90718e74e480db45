"""The registered queries of this subpackage and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkforge.llm import ann, chat_format, decontaminate, lang_id, mixing, sharding, simhash, substring_dedup, url_filter, warc
from linkforge.llm.common import read_table

#: (verdict, host, path) of the explicit URL rules; fixed values of the query's contract.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang_id.identify(read_table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "n_switches")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.round_trip(read_table(spark, sf_dir, "pages")).where("reason is null")
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeated_windows(read_table(spark, sf_dir, "documents"), texts=False).drop("kept_text")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_by_bytes(read_table(spark, sf_dir, "documents"), 8, carry=["doc_id"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.matches(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("toxic") == 1).alias("blocked"))
    return url_filter.judge(pages, URL_RULES, pages.join(labels, "page_id")).select("page_id", "host", "path", "rule", "verdict")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents"), carry=["doc_id"])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicate_groups(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat_format.swapped_replies(read_table(spark, sf_dir, "conversations"))
    return chat_format.format_pairs(pairs, carry=("conv_id", "rejected_id"))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_language, op2_warc, op3_substring_dedup, op4_sharding, op5_decontaminate, op6_url_filter, op7_mixing, op8_simhash, op9_chat, op10_ann, pipeline)}


#: The twin of op6 knows the explicit rules only: the labels don't depend on the URL, so no rule reaches the confidence, and the others' verdict is allow.
_URL_FILTER = r"""
with parts as (
  select page_id, regexp_extract(coalesce(url, ''), '(?s)\A.*?://(.*)\z', 1) as rest from pages
), places as (
  select page_id, translate(regexp_extract(rest, '(?s)\A([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '(?s)\A[^/?#]*([^?#]*)', 1) as path
  from parts
), rules as (
  select * from (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')) as r(kind, h, p)
), fits as (
  select page_id, host, path, arg_max(h || p, length(h || p)) filter (h is not null) as rule, arg_max(kind, length(h || p)) filter (h is not null) as kind
  from places left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
  group by page_id, host, path
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.kind, 'allow') as verdict
from places p join fits f on p.page_id is not distinct from f.page_id and p.host = f.host and p.path = f.path
"""

_DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BASE32 = " || ".join(f"substr({_DIGITS}, ((('0x' || substr(hex, {1 + 5 * i}, 5))::bigint >> {shift}) & 31)::int + 1, 1)" for i in range(8) for shift in (15, 10, 5, 0))
_WARC = f"""
with payloads as (
  select page_id, coalesce(html, '') as payload, sha1(coalesce(html, '')) as hex from pages
), marked as (
  select page_id, strlen(payload) as payload_bytes, {_BASE32} as payload_digest, min(page_id) over (partition by payload) as least from payloads
)
select page_id, payload_bytes, payload_digest, case when page_id = least then 'response' else 'revisit' end as record_type, case when page_id <> least then least end as refers_to from marked
"""
_SUBSTRINGS = r"""
with docs as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), windows as (
  select doc_id, i, min(doc_id) over (partition by w) < doc_id as again from (select doc_id, i, array_to_string(words[i:i + 12], ' ') as w from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from docs))
), gone as (
  select distinct doc_id, i + unnest(range(0, 13)) as i from windows where again
), every as (
  select doc_id, unnest(range(1, len(words) + 1)) as i, unnest(words) as word from docs
), kept as (
  select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n from every anti join gone using (doc_id, i) group by 1
)
select doc_id, len(words) as n_words, len(words) - coalesce(n, 0) as n_removed, sha256(coalesce(text, '')) as kept_sha256 from docs left join kept using (doc_id)
"""

ORACLES = {
    "op2_warc": _WARC,
    "op3_substring_dedup": _SUBSTRINGS,
    "op6_url_filter": _URL_FILTER,
    "op9_chat": """
with turns as (
  select distinct conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations where conv_id is not null
), listed as (
  select conv_id, list({'role': role, 'text': text} order by turn nulls first, role, text) as turns from turns group by conv_id
), replies as (
  select conv_id, turns, list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant') as spots from listed
), convs as (
  select conv_id, turns[1:spots[len(spots)]] as chosen, spots, conv_id % greatest(1, count(*) over () // 1024) as g from replies where len(spots) > 0
), next as (
  select *, coalesce(lead(conv_id) over (partition by g order by conv_id), min(conv_id) over (partition by g)) as rejected_id, (conv_id % len(spots)) + 1 as n from convs
), pairs as (
  select a.conv_id, a.rejected_id, a.chosen,
    list_concat(a.chosen[1:a.spots[a.n] - 1], b.chosen[b.spots[least(a.n, len(b.spots))]:len(b.chosen)]) as rejected
  from next a join convs b on a.rejected_id = b.conv_id
), counted as (
  select *, len(list_filter(range(1, least(len(chosen), len(rejected)) + 1), lambda i: chosen[1:i] = rejected[1:i])) as k from pairs
), turns_of as (
  select conv_id, rejected_id, k, 0 as side, unnest(range(1, len(chosen) + 1)) as i, unnest(chosen) as t from counted
  union all
  select conv_id, rejected_id, k, 1, unnest(range(1, len(rejected) + 1)), unnest(rejected) from counted
), rendered as (
  select *, '<|im_start|>' || replace(t.role, '<|im_', '<| im_') || chr(10) || replace(t.text, '<|im_', '<| im_') || '<|im_end|>' || chr(10) as s,
    13 + length(replace(t.role, '<|im_', '<| im_')) as head
  from turns_of
), placed as (
  select *, sum(length(s)) over (partition by conv_id, side order by i) - coalesce(sum(length(s)) filter (i <= k) over (partition by conv_id, side), 0) as stop_, length(s) as size from rendered
)
select conv_id, rejected_id, k::int as prefix_turns,
  coalesce(string_agg(s, '' order by i) filter (side = 0 and i <= k), '') as prompt,
  coalesce(string_agg(s, '' order by i) filter (side = 0 and i > k), '') as chosen, coalesce(string_agg(s, '' order by i) filter (side = 1 and i > k), '') as rejected,
  coalesce(string_agg((stop_ - size + head)::bigint::varchar || '-' || stop_::bigint::varchar, ',' order by i) filter (side = 0 and i > k and t.role = 'assistant'), '') as chosen_spans,
  coalesce(string_agg((stop_ - size + head)::bigint::varchar || '-' || stop_::bigint::varchar, ',' order by i) filter (side = 1 and i > k and t.role = 'assistant'), '') as rejected_spans
from placed group by conv_id, rejected_id, k
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
