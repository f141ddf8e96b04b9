"""The operators over their whole tables, as the driver asks for them, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, codebooks, collocations, licences, metricjoin, mixing, passages, pii, simhash, topk, toxicity, urls, wordpieces
from .tables import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


@query("op1_mixing")
def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query("op2_pii")
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read(spark, sf_dir, "documents")))


@query("op3_byte_level_bpe")
def op3_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op4_token_counts")
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return wordpieces.count_tokens(read(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


@query("op5_simhash_near_dedup")
def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


OP6_SQL = """
with recursive v as (select vec_id, label, embedding::double[] as e from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0),
  links as (select a.vec_id as x, b.vec_id as y from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and len(a.e) = len(b.e)
    where list_cosine_similarity(a.e, b.e) >= 0.93),
  reach(x, y) as (select vec_id, vec_id from embeddings union select r.x, l.y from reach r join links l on l.x = r.y),
  lowest as (select x, min(y) as low from reach group by x)
select vec_id, (select count(*) from links l where l.x = vec_id) as n_links, low as component_id, vec_id = low as kept
from embeddings join lowest on x = vec_id"""


@query("op6_embedding_near_dedup", OP6_SQL)
def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metricjoin.near_duplicates(read(spark, sf_dir, "embeddings"))


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = toxicity.train(docs, labels.where(~held_out))
    scored = toxicity.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


@query("op8_substring_dedup")
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(read(spark, sf_dir, "documents"))


OP9_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(1024 * x::double)::bigint) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  s as (select q.vec_id as query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0)::bigint as score
    from v q join v c on q.vec_id <> c.vec_id and len(q.e) = len(c.e) where q.vec_id % 100 = 0)
select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score
from s qualify rank <= 10"""


@query("op9_exact_top_k", OP9_SQL)
def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


@query("op10_url_filters")
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), urls.train(urls.labelled_urls(spark)))


OP11_SQL = r"""
with d as (select doc_id, coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
  pieces as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
  w as (select lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') as w from pieces),
  grams as (select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase
    from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from (select lang, w, unnest(range(1, 5)) as k from w))),
  f as materialized (select lang, k, phrase, string_split(phrase, ' ') as w, count(*) as a from grams group by lang, k, phrase having count(*) >= 30),
  totals as (select lang, sum(len(w))::bigint as n from w group by lang),
  cuts as (select lang, phrase, a, k, w, unnest(range(1, k)) as c from f where k > 1),
  sides as (select x.lang, x.phrase, x.a, x.c, l.a as l, r.a as r, ((2000000::hugeint * x.a) // (l.a + r.a))::bigint as score from cuts x
    join f l on l.lang = x.lang and l.phrase = array_to_string(x.w[1:x.c], ' ') join f r on r.lang = x.lang and r.phrase = array_to_string(x.w[x.c + 1:x.k], ' ')),
  best as (select * from sides qualify row_number() over (partition by lang, phrase order by score, c) = 1),
  inner_ as (select lang, a, k, w, unnest(range(2, k)) as m from f where k > 2),
  covered as (select lang, phrase, max(a) as longer from (select lang, a, array_to_string(w[i:i + m - 1], ' ') as phrase
    from (select *, unnest(range(1, k - m + 2)) as i from inner_)) group by lang, phrase),
  kept as (select b.* from best b left join covered c using (lang, phrase) where c.longer is null or 100 * c.longer < 80 * b.a)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score
from kept join totals using (lang) qualify rank <= 2000"""


@query("op11_collocations", OP11_SQL)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


def _op12_sql(rounds: int = codebooks.ROUNDS) -> str:
    """Every round as two steps, because SQL has no other way to fix their number."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select vec_id, part, (min(d * 16 + entry) % 16)::int as entry, (min(d * 16 + entry) // 16)::bigint as error, any_value(x) as x
    from (select p.vec_id, p.part, b.entry, p.x, list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))::hugeint as d
      from p join b{r} b on b.part = p.part) group by vec_id, part)""")
        if r < rounds:
            steps.append(f"""b{r + 1} as materialized (select b.part, b.entry, coalesce(n.x, b.x) as x from b{r} b left join (select part, entry, list(m order by i) as x from (
      select part, entry, i, ((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*))::bigint as m
      from (select part, entry, unnest(x) as c, generate_subscripts(x, 1) as i from a{r}) group by part, entry, i) group by part, entry) n
    on n.part = b.part and n.entry = b.entry)""")
    return f"""
with v as (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as e from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  p as materialized (select vec_id, part, e[part * (len(e) // 8) + 1:(part + 1) * (len(e) // 8)] as x from (select vec_id, e, unnest(range(8)) as part from v)),
  b0 as materialized (select part, (n - 1)::int as entry, x from (select *, row_number() over (partition by part order by vec_id) as n from p) where n <= 16),
  {", ".join(steps)},
  coded as (select vec_id, string_agg(printf('%02x', entry), '' order by part) as code, sum(error)::bigint as error from a{rounds} group by vec_id),
  digest as (select sha256(string_agg(c::varchar, ',' order by part, entry, i)) as codebooks_sha256
    from (select part, entry, unnest(x) as c, generate_subscripts(x, 1) as i from b{rounds}))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256
from coded join v using (vec_id) cross join digest"""


OP12_SQL = _op12_sql()


@query("op12_vector_codes", OP12_SQL)
def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codebooks.compressed(read(spark, sf_dir, "embeddings"))


@query("op13_licence_scan")
def op13_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scanned(read(spark, sf_dir, "documents"))
