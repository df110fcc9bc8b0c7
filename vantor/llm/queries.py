"""One query for each training-data operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vantor.llm.bpe import bpe_digests
from vantor.llm.common import scratch, shared_dir, table
from vantor.llm.leaks import leak_report
from vantor.llm.minhash import near_duplicates
from vantor.llm.pfor import token_file_digests
from vantor.llm.substrings import repeated_span_digests
from vantor.llm.templates import main_texts
from vantor.llm.toxicity import held_out, toxicity
from vantor.llm.unigram import token_counts
from vantor.llm.warc import read_archives, write_archives
from vantor.llm.webp import media_digests

BPE, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as space:
        return near_duplicates(space, table(spark, sf_dir, "documents"), width=3, percent=85).checkpoint()


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as space:
        return read_archives(space, write_archives(space, table(spark, sf_dir, "pages"))).checkpoint()


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as space:
        return main_texts(space, table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long")).checkpoint()


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as space:
        return token_file_digests(space, table(spark, sf_dir, "documents"), public_tokenizers.path(BPE)).checkpoint()


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BPE))


def op8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_words=1)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as space:
        return repeated_span_digests(space, table(spark, sf_dir, "documents")).checkpoint()


def op10_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash, op2_toxicity, op3_token_counts, op4_warc, op5_main_text, op6_token_files, op7_bpe, op8_leaks, op9_substrings, op10_webp)}


WARC_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
d as (select page_id, strlen(html) as payload_bytes, sha256(html) as payload_digest from p),
g as (select payload_digest, min(page_id) as first from d where payload_bytes >= 100 and page_id is not null group by payload_digest)
select d.page_id, d.payload_bytes, d.payload_digest,
  case when g.first < d.page_id then 'revisit' else 'response' end as record_type,
  case when g.first < d.page_id then g.first end as refers_to
from d left join g on d.payload_digest = g.payload_digest and d.payload_bytes >= 100
"""


NEAR_SQL = r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 3 then [array_to_string(ws, ' ')]
  else list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) end as ss from w),
e as (select doc_id, len(ss) as n, unnest(ss) as shingle from s),
p as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as x, any_value(b.n) as y, count(*) as c from e a join e b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select a, b from p where 100 * c >= 85 * (x + y - c)),
links as (select a, b from l union all select b, a from l),
r as (select doc_id, doc_id as other from s union select r.doc_id, links.b from r join links on r.other = links.a),
c as (select doc_id, min(other) as component_id from r group by doc_id)
select s.doc_id, len(ss)::bigint as n_shingles, component_id, s.doc_id = component_id as kept from s join c using (doc_id)
"""

SPANS_SQL = r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
i as (select doc_id, ws, unnest(range(1, len(ws) - 48)) as i from w where len(ws) >= 50),
v as (select doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) as h from i),
f as (select h, min(doc_id) as first from v group by h),
hit as (select v.doc_id, v.i from v join f using (h) where f.first < v.doc_id),
t as (select doc_id, unnest(ws) as word, unnest(range(1, len(ws) + 1)) as p from w),
g as (select t.doc_id, t.p, t.word, coalesce(max(hit.i) over (partition by t.doc_id order by t.p) >= t.p - 49, false) as gone from t left join hit on t.doc_id = hit.doc_id and t.p = hit.i),
k as (select doc_id, count(*) filter (gone) as n_removed, string_agg(word, ' ' order by p) filter (not gone) as kept from g group by doc_id)
select w.doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from w left join k using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash": NEAR_SQL, "op4_warc": WARC_SQL, "op9_substrings": SPANS_SQL}
