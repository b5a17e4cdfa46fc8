"""The operators as queries over the given tables: ``fn(spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    block_search, decontamination, html_text, infill, lexical, licenses, line_dedup, ngram_join, passages, quality,
    secrets, subwords, warc)

MODEL = "/opt/tokenizers/piece_bpe_32k.model"  # a public vocabulary; any SentencePiece model of merges will do

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ngram_jaccard_join(spark, sf_dir):
    groups = ngram_join.grouped(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", "n_shingles", "component_id")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

ORACLE_SQL["op1_ngram_jaccard_join"] = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, ws[p:p + k - 1] as shingle from (
    select doc_id, ws, least(5, len(ws)) as k, unnest(range(1, len(ws) - least(5, len(ws)) + 2)) as p from w
    where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
pairs as (
  select a.doc_id as x, b.doc_id as y, count(*) as common from s a join s b using (shingle) where a.doc_id < b.doc_id
  group by 1, 2),
links as (
  select x, y from pairs join n nx on nx.doc_id = x join n ny on ny.doc_id = y
  where 100 * common >= 80 * (nx.n + ny.n - common)),
edges as (select x, y from links union all select y, x from links),
reached as (
  select doc_id, doc_id as c from documents union select e.y, r.c from reached r join edges e on e.x = r.doc_id)
select doc_id, coalesce(any_value(n), 0) as n_shingles, min(c) as component_id
from reached left join n using (doc_id) group by doc_id
"""


@query
def op2_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.scored(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines",
                                       "n_repeat_words", "base_failed", "kept")


@query
def op3_sentencepiece(spark, sf_dir):
    return subwords.round_trip(table(spark, sf_dir, "documents"), MODEL)


@query
def op4_warc(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


ORACLE_SQL["op4_warc"] = """
with p as (select page_id, coalesce(html, '') as body from pages),
d as (select page_id, strlen(body) as payload_bytes, sha256(body) as payload_digest,
             min(page_id) over (partition by body) as least, count(*) over (partition by body) as n from p)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and page_id <> least then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and page_id <> least then least end as refers_to
from d
"""


@query
def op5_line_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = line_dedup.without_boilerplate(docs)
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


ORACLE_SQL["op5_line_dedup"] = r"""
with lines as (
  select doc_id, source, pos, line, trim(line, E' \t\n\r\v\f') as body
  from (select doc_id, source, unnest(string_split(coalesce(text, ''), chr(10))) as line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents)),
boiler as (
  select body, min(doc_id) as keeper from lines where body <> '' group by body having count(distinct source) >= 5),
marked as (
  select l.*, b.body is not null
    and not (l.doc_id = b.keeper and row_number() over (partition by l.doc_id, l.body order by l.pos) = 1) as gone
  from lines l left join boiler b on l.body = b.body)
select doc_id, count(*) filter (where body <> '') as n_lines, count(*) filter (where gone) as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as text_sha256
from marked group by doc_id
"""


@query
def op6_license_scan(spark, sf_dir):
    return licenses.report(table(spark, sf_dir, "documents"))


@query
def op7_substring_dedup(spark, sf_dir):
    return passages.shared(table(spark, sf_dir, "documents"))


@query
def op8_html_extraction(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))


@query
def op9_secret_scan(spark, sf_dir):
    return secrets.report(table(spark, sf_dir, "documents"))


@query
def op10_benchmark_decontamination(spark, sf_dir):
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op10_benchmark_decontamination"] = rf"""
with d as (
  select doc_id, coalesce(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as ws from documents),
b as (
  select item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
item_windows as (
  select distinct item_id, k, ws[p:p + k - 1] as part from (
    select item_id, ws, least(10, len(ws)) as k, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as p from b
    where len(ws) > 0)),
doc_windows as (
  select doc_id, k, p, ws[p:p + k - 1] as part from (
    select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as p
    from d, (select distinct k from item_windows) where len(ws) >= k)),
hits as (select doc_id, p, k, item_id from doc_windows join item_windows using (k, part)),
words as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from hits) group by 1),
items as (
  select doc_id, count(distinct item_id) as n_items,
         string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by 1)
select doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
       sha256(coalesce(ids, '')) as items_sha256, n_hit is not null as contaminated
from d left join words using (doc_id) left join items using (doc_id)
"""


@query
def op11_exact_top_k(spark, sf_dir):
    found = block_search.top_k(table(spark, sf_dir, "embeddings"), every=20, k=20)
    return found.select("query_id", "rank", "vec_id", "score")


ORACLE_SQL["op11_exact_top_k"] = """
with v as (
  select vec_id, [cast(floor(64 * cast(x as double)) as bigint) for x in embedding] as q from embeddings
  where vec_id is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0),
c as (
  select vec_id, unnest(q) as x, generate_subscripts(q, 1) as i from v),
s as (
  select a.vec_id as query_id, b.vec_id, cast(sum(a.x * b.x) as bigint) as score
  from c a join c b on a.i = b.i and a.vec_id <> b.vec_id where a.vec_id % 20 = 0 group by a.vec_id, b.vec_id),
r as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 20
"""


@query
def op12_fill_in_middle(spark, sf_dir):
    return infill.report(table(spark, sf_dir, "documents"))


ORACLE_SQL["op12_fill_in_middle"] = r"""
with d as (
  select doc_id, coalesce(text, '') as text, sha256('7:' || coalesce(cast(doc_id as varchar), '')) as h,
         regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') as units from documents),
c as (
  select *, len(units) as n, cast('0x' || h[1:8] as bigint) % (len(units) + 1) as r1,
         cast('0x' || h[9:16] as bigint) % (len(units) + 1) as r2, cast('0x' || h[25:32] as bigint) % 100 < 50 as spm,
         text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') as plain from d),
p as (
  select *, array_to_string(units[1:least(r1, r2)], '') as prefix,
         array_to_string(units[least(r1, r2) + 1:greatest(r1, r2)], '') as middle,
         array_to_string(units[greatest(r1, r2) + 1:], '') as suffix from c)
select doc_id, n, case when plain then 'plain' when spm then 'spm' else 'psm' end as form,
       case when not plain then length(prefix) end as prefix_chars,
       case when not plain then length(middle) end as middle_chars,
       sha256(case when plain then text when spm then '<S>' || suffix || '<P>' || prefix || '<M>' || middle
                   else '<P>' || prefix || '<S>' || suffix || '<M>' || middle end) as output_sha256,
       sha256(text) as restored_sha256
from p
"""


@query
def op13_ranked_search(spark, sf_dir):
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLE_SQL["op13_ranked_search"] = r"""
with words as (
  select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from documents),
lengths as (select doc_id, count(*) as n from words group by doc_id),
total as (select count(*) as docs, sum(n)::bigint as terms from lengths),
tf as (select doc_id, term, count(*) as tf from words group by doc_id, term),
df as (select term, count(*) as df from tf group by term),
asked as (
  select item_id, term, count(*) as repeats from (
    select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark)
  group by item_id, term),
scored as (
  select item_id, tf.doc_id, sum(repeats * cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint)
         * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * docs) // terms))))::bigint as score
  from asked join tf using (term) join df using (term) join lengths using (doc_id), total group by item_id, tf.doc_id),
ranked as (
  select *, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank
  from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
