"""Queries of the training-data operators over the synthetic tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import linededup, media, mixing, ngramjoin, packing, quality, secret_scan, topk, toxicity, warc
from .common import read

#: Target weights of op2 and of the pipeline; sources that aren't named have weight 1.
WEIGHTS = {"src0": 5, "src1": 3, "src2": 2}
TOKENS = "byte_bpe_50k.tiktoken"


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), WEIGHTS).select("doc_id", "source", "block", "slot", "mix_position")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    return warc.read_pages(warc.archive_pages(spark, pages), pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_topk(read(spark, sf_dir, "embeddings"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(media.store_media(read(spark, sf_dir, "documents")))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.jaccard_classes(read(spark, sf_dir, "documents"), ngramjoin.Rule(words=3, num=90))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), TOKENS)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_deleted").cast("long").alias("n_deleted"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_mixing, op3_warc, op4_exact_topk, op5_media, op6_ngram_jaccard, op7_packing, op8_line_dedup, op9_quality, op10_secrets)}


OP2 = f"""
with recursive src as (
  select source, row_number() over (order by coalesce(source, ''), source is null) - 1 as i, count(*) as rows_,
         case source {' '.join(f"when '{k}' then {v}" for k, v in WEIGHTS.items())} else 1 end as w
  from documents group by source),
tot as (select cast(sum(w) as bigint) as total, list(w order by i) as ws from src),
edf as (
  select cast(0 as bigint) as t, list_transform(ws, lambda x: cast(0 as bigint)) as done, cast(-1 as bigint) as pick from tot
  union all
  select t + 1, list_transform(done, lambda d, k: case when k - 1 = p then d + 1 else d end), p
  from (select t, done, total, cast(list_sort(list_filter(list_transform(ws, lambda w, k:
          case when done[k] < w and (done[k] * total) // w <= t then [((done[k] + 1) * total + w - 1) // w, k - 1] else null end),
          lambda x: x is not null))[1][2] as bigint) as p
        from edf, tot where t < total)),
slots as (select pick as i, t - 1 as slot, row_number() over (partition by pick order by t) - 1 as j from edf where t > 0),
ranked as (
  select doc_id, source, row_number() over (partition by source order by md5(cast(doc_id as varchar)), doc_id) - 1 as r from documents),
placed as (
  select k.doc_id, k.source, r // {mixing.BLOCK_ROWS} as block, r, ((r // {mixing.BLOCK_ROWS}) // w) * total + s.slot as slot
  from ranked k join src on k.source is not distinct from src.source, tot, slots s
  where s.i = src.i and s.j = (r // {mixing.BLOCK_ROWS}) % w)
select doc_id, source, cast(block as bigint) as block, cast(slot as bigint) as slot, row_number() over (order by slot, r) - 1 as mix_position
from placed
"""
OP3 = """
with p as (select page_id, encode(coalesce(html, '')) as b, sha256(coalesce(html, '')) as d from pages),
q as (select *, octet_length(b) as n, min(page_id) over (partition by d) as first from p)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when n >= 100 and first < page_id then 'revisit' else 'response' end as record_type,
       case when n >= 100 and first < page_id then first end as refers_to
from q
"""
OP4 = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as e from embeddings
  where embedding is not null and vec_id is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as k from s)
select query_id, cast(k as integer) as rank, vec_id, score from r where k <= 20
"""
OP6 = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[k:k + 2], ' ') as g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) as k from w where len(ws) >= 3)
  union select doc_id, array_to_string(ws, ' ') from w where len(ws) in (1, 2)),
n as (select doc_id, count(*) as n from s group by doc_id),
links as (
  select a.doc_id as a, b.doc_id as b from s a join s b on a.g = b.g and a.doc_id <> b.doc_id
  join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 90 * (x.n + y.n - count(*))),
reach as (select doc_id as a, doc_id as b from documents union select r.a, l.b from reach r join links l on r.b = l.a),
c as (select a, min(b) as component_id from reach group by a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id
from documents d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id
"""
#: Independent of the operator's windows: equal lines of two places, extended to maximal runs along their diagonal. Line k
#: of the later copy goes if the run from its start to k + (its distance from the earlier copy, in one text) has enough words.
OP8 = rf"""
with d as (select doc_id, text, string_split(text, chr(10)) as l from documents where text is not null),
i as (select doc_id, unnest(l) as line, unnest(range(len(l))) as k from d),
w as (select *, greatest(1, len(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda y: y <> ''))) as w, count(*) over (partition by line) as n from i),
p as (select b.doc_id, b.k, b.w, a.doc_id as da, b.k - a.k as shift from w a join w b on a.line = b.line and a.n > 1
        and (a.doc_id < b.doc_id or a.doc_id = b.doc_id and a.k < b.k)),
g as (select *, k - row_number() over (partition by doc_id, da, shift order by k) as g from p),
s as (select doc_id, k, da, sum(w) over (partition by doc_id, da, shift, g order by k rows between unbounded preceding and
               (case when da = doc_id then shift - 1 else 1000000000 end) following) as s from g),
gone as (select distinct doc_id, k from s where s >= {linededup.MIN_WORDS}),
kept as (select i.doc_id, count(*) as n_lines, count(gone.k) as n_deleted, string_agg(case when gone.k is null then i.line end, chr(10) order by i.k) as t
         from i left join gone on gone.doc_id = i.doc_id and gone.k = i.k group by i.doc_id)
select x.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_deleted, 0) as n_deleted,
       case when x.text is not null then sha256(coalesce(t, '')) end as kept_sha256
from documents x left join kept on kept.doc_id = x.doc_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_mixing": OP2, "op3_warc": OP3, "op4_exact_topk": OP4, "op6_ngram_jaccard": OP6, "op8_line_dedup": OP8}
