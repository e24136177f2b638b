"""Registered queries of the numbered operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from scorelake.llm import ann, bpe, clusters, infill, langid, licences, minhash, mixing, packing, pii, repeats, simhash, urls

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"))


@query
def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = langid.fit(documents.where(~held_out))
    return langid.predict(documents, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_edits(table(spark, sf_dir, "documents"))


@query
def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.repeats(table(spark, sf_dir, "documents"))


ORACLES["op6_repeats"] = """
with words as (
  select doc_id, rowid_, coalesce(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), []) as w
  from (select doc_id, text, row_number() over () as rowid_ from documents)
), starts as (
  select doc_id, rowid_, unnest(range(1, greatest(len(w) - 11, 1))) as i from words
), windows as (
  select s.doc_id, s.rowid_, s.i, sha256(array_to_string(w[s.i : s.i + 12], ' ')) as h
  from starts s join words using (rowid_)
), firsts as (select h, min(doc_id) as first_id from windows group by h
), covered as (
  select distinct rowid_, unnest(range(i, i + 13)) as p from windows join firsts using (h) where windows.doc_id > first_id
), gone as (select rowid_, list(p) as ps, count(*) as n from covered group by rowid_
), kept as (
  select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed,
    case when n is null then w else list_filter(w, lambda x, i: not list_contains(ps, i)) end as k, coalesce(list_sort(ps), []) as ps
  from words left join gone using (rowid_)
)
select doc_id, n_words, n_removed,
  array_to_string(list_transform(list_filter(ps, lambda x: not list_contains(ps, x - 1)),
    lambda x, i: (x - 1)::varchar || ':' || list_filter(ps, lambda y: not list_contains(ps, y + 1))[i]::varchar), ',') as removed,
  sha256(array_to_string(k, ' ')) as kept_sha256
from kept"""


@query
def op5_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 50 == 0)


ORACLES["op5_nearest"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: x::double) as e from embeddings
  where vec_id is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs as (
  select q.vec_id as query_id, c.vec_id, list_cosine_similarity(q.e, c.e) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(q.e) = len(c.e)
), ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from pairs)
select query_id, rank, vec_id, score from ranked where rank <= 5"""


@query
def op10_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).withColumn("weight", F.round("weight", 9))


def _mixture_sql() -> str:
    share = "ln(tokens / total)"
    rounds = "".join(
        f"""
, points{r} as (select i, lo + (hi - lo) * i / {mixing.POINTS + 1}.0::double as a from bounds{r}, range({mixing.POINTS + 2}) as g(i))
, sums{r} as (select i, a, sum(exp(a * {share})) as z, sum(exp(a * {share}) * {share}) as e, min({share}) as least from points{r}, sources, totals group by i, a)
, flat{r} as (
  select a, ln(z) - a * e / z >= {mixing.ENTROPY}::double * ln(n) or exp((a - 1) * least) / z > {mixing.REPEATS}::double as f from sums{r}, totals
), bounds{r + 1} as (select coalesce(max(a) filter (f), 0.0::double) as lo, coalesce(min(a) filter (not f), 1.0::double) as hi from flat{r})"""
        for r in range(mixing.ROUNDS)
    )
    return f"""
with rows_ as (
  select doc_id, source, coalesce('=' || source, 'null') as k, substr(md5(coalesce(text, '')), 1, 16) as th,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as n_tokens
  from documents
), sources as (select k, count(*) as docs, sum(n_tokens)::bigint as tokens from rows_ group by k having sum(n_tokens) > 0
), totals as (select sum(tokens)::double as total, count(*)::double as n from sources
), bounds0 as (select 0.0::double as lo, 1.0::double as hi)
{rounds}
, tempered as (select *, pow(tokens::double, hi) as t from sources, bounds{mixing.ROUNDS}
), plan as (select k, tokens, t / sum(t) over () as weight, t / sum(t) over () * total as budget from tempered, totals
), dealt as (select *, unnest(range(0, floor(budget / tokens)::bigint + 1)) as turn from rows_ join plan using (k)
), hashed as (select *, ('0x' || substr(md5(concat_ws('|', coalesce(doc_id::varchar, ''), th, turn::varchar)), 1, 15))::bigint as h from dealt
), placed as (
  select *, turn * tokens + coalesce(sum(n_tokens) over (partition by k, turn order by h, doc_id, th rows between unbounded preceding and 1 preceding), 0)::bigint as start
  from hashed
), taken as (select *, floor(start / (weight * {mixing.BLOCK_TOKENS}::double))::bigint as block from placed where start < budget)
select doc_id, source, n_tokens, round(weight, 9) as weight, turn, block,
  row_number() over (partition by block order by md5('place#' || h::varchar), doc_id, th, turn)::int as place
from taken"""


ORACLES["op10_mixture"] = _mixture_sql()


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op7_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


@query
def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


@query
def op11_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(table(spark, sf_dir, "embeddings"))


def _clusters_sql() -> str:
    assign = """
, near{r} as materialized (
  select vid, k, d from (
    select vid, k, sum((q - c) * (q - c))::bigint as d, row_number() over (partition by vid order by sum((q - c) * (q - c)), k) as place
    from parts join centres{r} using (i) group by vid, k)
  where place = 1)"""
    rounds = "".join(
        assign.format(r=r)
        + f"""
, sums{r} as materialized (select k, i, sum(q)::bigint as s, count(*)::bigint as n from near{r} join parts using (vid) group by k, i)
, centres{r + 1} as materialized (
  select c.k, c.i, case when n is null then c.c else (s - ((s % n) + n) % n) // n end as c from centres{r} c left join sums{r} x on x.k = c.k and x.i = c.i)"""
        for r in range(clusters.ROUNDS)
    )
    return f"""
with kept as materialized (
  select row_number() over () as vid, vec_id, list_transform(embedding, lambda x: floor({clusters.SCALE} * x::double)::bigint) as q
  from embeddings where len(embedding) = {clusters.WIDTH} and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), parts as materialized (select vid, unnest(range(1, {clusters.WIDTH + 1})) as i, unnest(q) as q from kept
), first as (
  select vid, (row_number() over (order by sha256('{clusters.SALT}' || vec_id::varchar), q) - 1)::int as k from kept where vec_id is not null
), centres0 as materialized (select k, i, q as c from first join parts using (vid) where k < {clusters.CENTROIDS})
{rounds}{assign.format(r=clusters.ROUNDS)}
, names as (select k, sha256(string_agg(c::varchar, ',' order by i)) as centroid_sha256 from centres{clusters.ROUNDS} group by k)
select vec_id, k as cluster, d as distance, (sum(d) over (partition by k))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, centroid_sha256
from near{clusters.ROUNDS} join kept using (vid) join names using (k)"""


ORACLES["op11_clusters"] = _clusters_sql()


@query
def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(table(spark, sf_dir, "documents"), with_ids=False))


@query
def op13_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = infill.fill_in_middle(table(spark, sf_dir, "documents"))
    digests = F.sha2(F.col("output"), 256).alias("output_sha256"), F.sha2(infill.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


ORACLES["op13_infill"] = f"""
with units as (
  select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') as u, sha256('1:' || coalesce(doc_id::varchar, '')) as d
  from documents
), drawn as (
  select doc_id, t, u, len(u)::bigint as n, ('0x' || d[1:8])::bigint as h1, ('0x' || d[9:16])::bigint as h2, ('0x' || d[17:24])::bigint as h3, ('0x' || d[25:32])::bigint as h4
  from units
), cuts as (
  select *, least(h1 % (n + 1), h2 % (n + 1)) as a, greatest(h1 % (n + 1), h2 % (n + 1)) as b,
    case when t = '' or contains(t, '<P>') or contains(t, '<S>') or contains(t, '<M>') or h3 % 100 >= {infill.PLAIN_FROM} then 'plain'
      when h4 % 100 < {infill.SPM_BELOW} then 'spm' else 'psm' end as form
  from drawn
), pieces as (
  select *, array_to_string(u[1 : a], '') as p, array_to_string(u[a + 1 : b], '') as m, array_to_string(u[b + 1 : n], '') as s from cuts
)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars, case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then t when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(t) as restored_sha256
from pieces"""
