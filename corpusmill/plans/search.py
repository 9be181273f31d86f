"""Queries for retrieval, themes, quotes, assets, reports and run control, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import classify, language, text, urls
from corpusmill.functions.sites import SITE_PATTERN, site
from corpusmill.operators import assets, index, ops, retrieve, verify
from corpusmill.plans import sql, unit_sql
from corpusmill.plans.core import UNITS, _units, pages
from corpusmill.plans.sql import PAGES
from corpusmill.session import materialize
from corpusmill.sources import tables
from corpusmill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = fn
    if oracle:
        ORACLE[name] = oracle


# --- dense half: every vector whose id is divisible by 50 asks all vectors


def _vectors(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").withColumnRenamed("vec_id", "point_id")


def _vector_queries(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


_D = """d as (select query_id, point_id, score, row_number() over (partition by query_id order by score desc, point_id) as rank from (
  select q.vec_id as query_id, p.vec_id as point_id, list_dot_product(p.embedding::double[], q.embedding::double[]) / (sqrt(list_dot_product(p.embedding::double[], p.embedding::double[])) * sqrt(list_dot_product(q.embedding::double[], q.embedding::double[]))) as score
  from embeddings p, embeddings q where q.vec_id % 50 = 0) t qualify rank <= 30)"""
add("r01_dense_top_k", lambda s, d: retrieve.dense_top_k(_vectors(s, d), _vector_queries(s, d), 30).select("query_id", "point_id", F.round("score", 6).alias("score"), "rank"), f"with {_D} select query_id, point_id, round(score, 6) as score, rank from d")
add(
    "r21_filtered_dense",
    lambda s, d: retrieve.dense_top_k(_vectors(s, d).where("label = 1"), _vector_queries(s, d), 8).select("query_id", "point_id", "rank"),
    "select query_id, point_id, rank from (select query_id, point_id, row_number() over (partition by query_id order by score desc, point_id) as rank from (select q.vec_id as query_id, p.vec_id as point_id, list_dot_product(p.embedding::double[], q.embedding::double[]) / sqrt(list_dot_product(p.embedding::double[], p.embedding::double[])) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) as score from embeddings p, embeddings q where q.vec_id % 50 = 0 and p.label = 1) t) u where rank <= 8",
)

# --- sparse half: the evaluation needs ask all documents


def _doc_points(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("point_id"), F.col("text").alias("embed_text"))


def _needs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), F.col("need").alias("text"))


_S = f"""w as (select doc_id, unnest({sql.words("text")}) as term, len({sql.words("text")}) as n from documents where text is not null),
t as (select doc_id, term, count(*) as tf, any_value(n) as n from w group by doc_id, term),
df as (select term, count(*) as df from t group by term), c as (select count(*) as total from documents where text is not null),
n as (select item_id as query_id, unnest(list_distinct({sql.words("need")})) as term from eval_items),
sc as (select query_id, doc_id as point_id, round(sum(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256.0)) * ln(1 + (total - df + 0.5) / (df + 0.5))), 9) as score from n join t using (term) join df using (term), c group by query_id, doc_id),
s as (select query_id, point_id, score, row_number() over (partition by query_id order by round(score, 9) desc, point_id) as rank from sc qualify rank <= 30)"""


def _sparse(s: SparkSession, d: str, k: int = 30) -> DataFrame:
    return retrieve.sparse_top_k(_doc_points(s, d), _needs(s, d), k)


add("r02_sparse_top_k", lambda s, d: _sparse(s, d).select("query_id", "point_id", F.round("score", 6).alias("score"), "rank"), f"with {_S} select query_id, point_id, round(score, 6) as score, rank from s")
add(
    "s09_postings",
    lambda s, d: retrieve.postings(_doc_points(s, d)).select("point_id", "term", "tf", F.round("weight", 9).alias("weight")),
    f"with {_S.split('df as')[0].rstrip().rstrip(',')} select doc_id as point_id, term, tf, round(tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / 256.0)), 9) as weight from t",
)

# --- fusion: two rankings of the pages of each query's hits, by score and by recency

_HITS = "(select distinct query_id, hit_id, page_id, score, scored_at from page_hits where page_id is not null and score is not null and not isnan(score))"


def _hits(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "page_hits").where("page_id is not null and score is not null and not isnan(score)").select("query_id", "hit_id", "page_id", "score", "scored_at").distinct()


def _halves(s: SparkSession, d: str, k: int = 30) -> tuple[DataFrame, DataFrame]:
    h = _hits(s, d).withColumnRenamed("hit_id", "point_id")
    dense = retrieve.top_per_query(h, k)
    w = Window.partitionBy("query_id").orderBy(F.desc("scored_at"), "point_id")
    return dense, h.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


_H = f"""a as (select query_id, hit_id as point_id, row_number() over (partition by query_id order by score desc, hit_id) as rank from {_HITS} qualify rank <= 30),
b as (select query_id, hit_id as point_id, row_number() over (partition by query_id order by scored_at desc, hit_id) as rank from {_HITS} qualify rank <= 30),
u as (select *, 0 as half from a union all select *, 1 as half from b),
g as (select query_id, point_id, sum(1.0::double / (60 + rank)) as score, min(half * 1000 + rank) as first from u group by query_id, point_id),
f as (select query_id, point_id, score, row_number() over (partition by query_id order by round(score, 12) desc, first) as rank from g)"""


def _fused(s: SparkSession, d: str, cut: int = 10**6) -> DataFrame:
    return retrieve.fuse(*_halves(s, d), cut)


add("r03_fusion", lambda s, d: _fused(s, d).select("query_id", "point_id", F.round("score", 9).alias("score"), "rank"), f"with {_H} select query_id, point_id, round(score, 9) as score, rank from f")
add(
    "a18_fusion_report",
    lambda s, d: retrieve.fusion_report(*_halves(s, d), _fused(s, d, 20)),
    f"""with {_H}, j as (select query_id, point_id, a.rank as d, b.rank as s, case when f.rank <= 20 then 1 end as k from a full join b using (query_id, point_id) left join f using (query_id, point_id))
    select query_id, count(d) as dense, count(s) as sparse, count(*) filter (where d is not null and s is not null) as overlap, count(*) as union_size, count(k) as kept, min(d) filter (where k is null) as first_dropped_dense, min(s) filter (where k is null) as first_dropped_sparse from j group by query_id""",
)
add("r06_positional", lambda s, d: retrieve.positional(_halves(s, d)[0]).select("query_id", "point_id", "score"), f"with {_H} select query_id, point_id, count(*) over (partition by query_id) - rank + 1 as score from a")
add("r04_query_pool", lambda s, d: retrieve.top_per_query(_hits(s, d).withColumnRenamed("hit_id", "point_id"), retrieve.fetch_size(24)).select("query_id", "point_id", "rank"), f"select query_id, hit_id as point_id, row_number() over (partition by query_id order by score desc, hit_id) as rank from {_HITS} qualify rank <= 48")
add(
    "r07_page_diverse",
    lambda s, d: retrieve.select_diverse(_halves(s, d)[0].select("query_id", "point_id", "rank", F.col("page_id").alias("page_key"), F.col("point_id").cast("string").alias("text"), F.lit("").alias("lineage")), 12, False).select("query_id", "point_id", "position"),
    f"""with {_H}, p as (select a.query_id, a.point_id, a.rank, h.page_id, row_number() over (partition by a.query_id, h.page_id order by a.rank) as turn, min(a.rank) over (partition by a.query_id, h.page_id) as best from a join {_HITS} h on h.query_id = a.query_id and h.hit_id = a.point_id)
    select query_id, point_id, cast(row_number() over (partition by query_id order by turn, best) as int) as position from p qualify position <= 12""",
)
_BEST = f"(select query_id, hit_id, page_id, score, row_number() over (partition by query_id order by score desc, hit_id) as position from {_HITS} qualify position <= 12)"


def _theme_hits(s: SparkSession, d: str) -> DataFrame:
    top = retrieve.top_per_query(_hits(s, d).withColumnRenamed("hit_id", "point_id"), 12).withColumnRenamed("rank", "position")
    p = pages(s, d).select("page_id", "url", "final_url", site("origin").alias("host"), F.when(F.col("url").contains("-"), "Long").otherwise("").alias("category"), F.lit(None).cast("string").alias("entity_name"))
    return top.join(p, "page_id", "left")


_T = f"""h as (select b.*, coalesce(nullif(regexp_extract(lower(p.origin), {sql.q(SITE_PATTERN)}, 1), ''), 'unknown') as entity, case when contains(p.url, '-') then 'long' else 'general' end as cat from {_BEST} b left join {PAGES} p using (page_id)),
e as (select query_id, entity, max(score) as s, min(position) as seen, list_sort(list_distinct(list(cat))) as cats from h group by query_id, entity),
en as (select *, row_number() over (partition by query_id order by s desc, seen) as n from e),
c as (select query_id, cat, max(score) as s, min(position) as seen from h group by query_id, cat),
cn as (select *, row_number() over (partition by query_id order by s desc, seen) as n from c),
x as (select l.query_id, l.n, r.n as m, l.entity || ' ↔ ' || r.entity as label, 'co-occurs:' || list_min(list_intersect(l.cats, r.cats)) as relationship, least(l.s, r.s) as score from en l join en r on l.query_id = r.query_id and l.n < r.n and r.n <= 8 and len(list_intersect(l.cats, r.cats)) > 0),
a as (select query_id, 0 as part, n, 0 as m, entity as label, 'entity' as relationship, s as score from en where n <= 6 union all select query_id, 1, n, 0, 'theme:' || cat, 'category-theme', s from cn where n <= 3 union all select query_id, 2, n, m, label, relationship, score from x)"""
add("p04_themes", lambda s, d: retrieve.themes(_theme_hits(s, d)).select("query_id", "position", "label", "relationship", "score"), f"with {_T} select query_id, row_number() over (partition by query_id order by part, n, m) as position, label, relationship, score from a qualify position <= 12")
add(
    "a05_theme_entities",
    lambda s, d: _theme_hits(s, d).groupBy("query_id", F.coalesce(F.when(F.length("host") > 0, F.col("host")), F.lit("unknown")).alias("entity")).agg(F.max("score").alias("score"), F.max_by("point_id", F.struct("score", -F.col("position"))).alias("best_hit")),
    f"with {_T} select query_id, entity, max(score) as score, arg_max(hit_id, -position) as best_hit from h group by query_id, entity",
)


def _hybrid(s: SparkSession, d: str) -> DataFrame:
    nodes = index.index_run(table(s, d, "crawl_pages"), english_only=True).where("chunk_role = 'child'")
    points = materialize(index.embed_distinct(nodes)[0], "points")  # the stored index
    q = table(s, d, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), F.col("need").alias("text"), index.embed(F.col("need")).alias("vector"))
    return retrieve.hybrid(points, q, 8, prefer_child=True).select("query_id", "position", "rank", "point_id", "page_id", "score")


add("p03_hybrid_query", _hybrid)

# --- quotes


def _quotes(s: SparkSession, d: str) -> DataFrame:
    return _units(s, d).select(F.col("unit_id").alias("quote_id"), "page_id", F.col("child_text").alias("quote"))


add(
    "p05_verify_quotes",
    lambda s, d: verify.verify_quotes(_quotes(s, d), pages(s, d)).select("quote_id", "found", "reason", "digest"),
    f"""with p as (select page_id, {sql.reason()} as why, {sql.plain("blocks")} as plain, blocks from {PAGES}),
    c as (select *, case when why is not null and why <> 'no_content' then 'page_not_citable:' || why when length({sql.strip("plain")}) = 0 then 'page_not_found' end as refusal from p),
    j as (select u.unit_id as quote_id, c.page_id is null as gone, refusal, plain, blocks, {sql.normalize(sql.clean("u.child_text"))} as q from {UNITS} u left join c using (page_id)),
    r as (select *, case when gone then 'page_not_found' else refusal end as why from j),
    f as (select *, case when why is not null then false when not regexp_matches(q, '[\\pL\\pN]') then false when length(q) >= 12 then contains({sql.normalize("regexp_replace(plain, '\\|([" + sql.BLANK + "]*\\|)+', '|', 'g')")}, q)
      else len(list_filter(flatten(list_transform(list_filter(blocks, lambda b: b.kind = 'row'), lambda b: coalesce(b.cells, []))), lambda x: length(x) > 0 and {sql.normalize("x")} = q)) > 0 end as found from r)
    select quote_id, found, case when why is null and not found then 'quote_not_found' else why end as reason, case when why is null then sha256(plain) end as digest from f""",
)
add("p06_page_text", lambda s, d: verify.page_text(pages(s, d)).select("page_id", F.length("text").alias("chars"), "refusal"), f"with c as (select page_id, {sql.reason()} as why, {sql.plain('blocks')} as t from {PAGES}), r as (select *, case when why is not null and why <> 'no_content' then 'page_not_citable:' || why when length({sql.strip('t')}) = 0 then 'page_not_found' end as refusal from c) select page_id, case when refusal is null then length(t) end as chars, refusal from r")
add(
    "p07_host_lookup",
    lambda s, d: verify.host_lookup(pages(s, d).select(F.concat(F.lit("https://www."), site("origin"), F.lit("/x")).alias("address"), F.lit(None).cast("string").alias("crawl_type")).distinct(), pages(s, d).join(table(s, d, "crawl_runs").select("run_id", "crawl_type").distinct(), "run_id").select(site("origin").alias("host"), F.lower("crawl_type").alias("crawl_type"))).select("address", "host", F.array_join("types", ",").alias("types"), "reason"),
    f"""with p as (select *, regexp_extract(lower(origin), {sql.q(SITE_PATTERN)}, 1) as host from {PAGES}), a as (select distinct 'https://www.' || host || '/x' as address, host from p),
    t as (select host, list_sort(list_distinct(list(lower(crawl_type)))) as types from p join (select distinct run_id, crawl_type from crawl_runs) r using (run_id) group by host)
    select address, t.host, array_to_string(types, ',') as types, case when t.host is null then 'not_indexed' when len(types) > 1 then 'ambiguous_crawl_type' end as reason from a left join t using (host)""",
)
add(
    "j10_need_in_document",
    lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", text.normalize("text").alias("t")).join(F.broadcast(table(s, d, "eval_items").select("item_id", text.normalize("text").alias("p"))), F.col("t").contains(F.col("p"))).select("doc_id", "item_id"),
    f"select doc_id, item_id from (select doc_id, {sql.normalize('text')} as t from documents where text is not null) d join (select item_id, {sql.normalize('text')} as p from eval_items) i on contains(t, p)",
)

# --- entities


def _entities(s: SparkSession, d: str) -> DataFrame:
    hosts = pages(s, d).select(site("origin").alias("h")).distinct()
    parents = hosts.select(F.array_join(F.slice(F.split("h", r"\."), -2, 2), ".").alias("domain")).distinct()
    return parents.select(F.sha2("domain", 256).alias("entity_id"), F.col("domain").alias("entity_name"), F.lit("site").alias("source_type"), "domain", F.col("domain").alias("ord"))


add(
    "j01_entity_of_host",
    lambda s, d: index.resolve_entities(pages(s, d).select(site("origin").alias("host")), _entities(s, d)).select("host", "entity_id", "entity_name"),
    f"""with h as (select distinct regexp_extract(lower(origin), {sql.q(SITE_PATTERN)}, 1) as host from {PAGES}), e as (select distinct array_to_string(string_split(host, '.')[-2:], '.') as domain from h)
    select host, sha256(arg_min(domain, domain)) as entity_id, min(domain) as entity_name from h join e on host = domain or ends_with(host, '.' || domain) group by host""",
)

# --- runs, reports, maintenance


def _runs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "crawl_runs").where("run_id is not null").groupBy("run_id").agg(F.min("content_ready_at").alias("content_ready_at"), F.max(F.lower("status")).alias("status"), F.max("rag_indexed_at").alias("rag_indexed_at"))


_RUNS = "(select run_id, min(content_ready_at) as content_ready_at, max(lower(status)) as status, max(rag_indexed_at) as rag_indexed_at from crawl_runs where run_id is not null group by run_id)"
add(
    "a03_schedulable",
    lambda s, d: ops.schedulable(_runs(s, d), pages(s, d), _runs(s, d).where("rag_indexed_at is not null")),
    f"""with r as (select r.*, coalesce(n, 0) as n, rag_indexed_at is not null as x from {_RUNS} r left join (select run_id, count(*) as n from {PAGES} group by run_id) p using (run_id))
    select count(*) as runs, count(*) filter (where x) as excluded, count(*) filter (where not x and content_ready_at is null) as not_ready, count(*) filter (where not x and content_ready_at is not null and n = 0) as no_pages,
    count(*) filter (where not x and content_ready_at is not null and n > 50000) as over_cap, (select run_id from r where not x and content_ready_at is not null and n between 1 and 50000 order by content_ready_at, run_id limit 1) as candidate from r""",
)
add("j02_runs_with_pages", lambda s, d: _runs(s, d).join(ops.page_counts(pages(s, d)), "run_id", "left").select("run_id", F.coalesce("pages", F.lit(0)).alias("pages")), f"select run_id, coalesce(n, 0) as pages from {_RUNS} left join (select run_id, count(*) as n from {PAGES} group by run_id) p using (run_id)")
add("j03_open_runs", lambda s, d: _runs(s, d).join(_runs(s, d).where("rag_indexed_at is not null").select("run_id"), "run_id", "left_anti").select("run_id"), f"select run_id from {_RUNS} where rag_indexed_at is null")
add(
    "j04_orphan_hits",
    lambda s, d: ops.orphans(table(s, d, "page_hits").withColumnRenamed("page_id", "run_id"), pages(s, d).select(F.col("page_id").alias("run_id")), "scored_at"),
    "select page_id as run_id, count(*) as n, max(scored_at) as newest, count(*) filter (where scored_at is null) as undated from page_hits where page_id is not null and page_id not in (select page_id from crawl_pages) group by page_id",
)
add(
    "o21_lost_enqueues",
    lambda s, d: ops.lost_enqueues(_runs(s, d), _runs(s, d).where("rag_indexed_at is not null or status = 'failed'").select("run_id", F.col("status").alias("state")), F.lit("2030-01-01").cast("timestamp")).select("run_id", "reason"),
    f"with r as {_RUNS}, j as (select run_id, count(*) filter (where status <> 'failed') as alive from r where rag_indexed_at is not null or status = 'failed' group by run_id) select run_id, case when j.run_id is null then 'never_enqueued' else 'failed_only' end as reason from r left join j using (run_id) where content_ready_at is not null and (j.run_id is null or alive = 0)".replace("j.run_id", "j.alive"),
)
_NOW = "2026-01-01"
add(
    "o20_job_class",
    lambda s, d: table(s, d, "crawl_runs").select("run_id", ops.job_class(F.lower("status"), F.col("rag_indexed_at"), F.col("content_ready_at"), F.lit(_NOW).cast("timestamp"), F.lit(_NOW).cast("timestamp")).alias("job")),
    f"select run_id, case when status is null then 'NEVER_QUEUED' when lower(status) = 'complete' then 'COMPLETE' when lower(status) = 'failed' then 'FAILED' when rag_indexed_at > timestamptz '{_NOW} 00:00:00+00' and content_ready_at < timestamptz '{_NOW} 00:00:00+00' then 'HELD_DEAD' when rag_indexed_at > timestamptz '{_NOW} 00:00:00+00' then 'QUEUED_LIVE' else 'STRANDED' end as job from crawl_runs",
)


def _shown(s: SparkSession, d: str) -> DataFrame:
    return _units(s, d).join(pages(s, d).select("page_id", "url", F.col("title").alias("page_title"), site("origin").alias("host")), "page_id").withColumn("chunk_role", F.lit("child")).withColumn("chunk_key", F.col("unit_id"))


_SHOWN = f"(select u.*, p.url, p.title, regexp_extract(lower(p.origin), {sql.q(SITE_PATTERN)}, 1) as host from {UNITS} u join {PAGES} p using (page_id))"
add("a11_host_report", lambda s, d: ops.host_report(_shown(s, d)), f"select host, count(*) as points, count(distinct url) as pages, sum(length(child_text)) as chars, round(count(*) / count(distinct url), 2) as points_per_page from {_SHOWN} group by host")
add("a12_url_report", lambda s, d: ops.url_report(_shown(s, d)).select("url", "chunks", "chars"), f"select url, count(*) as chunks, sum(length(child_text)) as chars from {_SHOWN} group by url")
add(
    "a13_block_report",
    lambda s, d: ops.block_report(pages(s, d)),
    f"""with p as (select run_id, blocks, {sql.plain("blocks")} as t from {PAGES}), x as (select *, list_filter(coalesce(blocks, []), lambda b: b.kind = 'row') as rs from p)
    select run_id, cast(grouping(run_id) as int) as is_total, count(*) as pages, sum(length(t)) as chars, count(*) filter (where length({sql.strip("t")}) = 0) as empty_pages, count(*) filter (where regexp_matches(t, {sql.q(text.INLINE_TAGS)})) as with_tags,
    count(*) filter (where regexp_matches(t, 'https?://\\S+')) as with_urls, count(*) filter (where regexp_matches(t, {sql.q(text.ESCAPED)})) as with_escapes, sum(len(rs)) as table_rows, sum(len(list_filter(rs, lambda b: length({sql.strip(sql.block("b"))}) = 0))) as rows_lost from x group by rollup (run_id)""",
)
add(
    "a14_cleanup_counts",
    lambda s, d: ops.cleanup_counts(pages(s, d)),
    f"with d as (select coalesce(length(failure_reason) > 0, false) as f, coalesce(not {sql.bool_of('robots_allowed')}, false) as r, coalesce({sql.int_of('status_code')}, 0) >= 400 as e from {PAGES}) select count(*) filter (where f) as failed, count(*) filter (where r) as refused, count(*) filter (where e) as error, count(*) filter (where f or r or e) as any_reason, count(*) filter (where not (f or r or e)) as kept from d",
)
add("u03_kept_pages", lambda s, d: ops.deletable(pages(s, d)).where("not any").select("page_id"), f"select page_id from {PAGES} where not (coalesce(length(failure_reason) > 0, false) or coalesce(not {sql.bool_of('robots_allowed')}, false) or coalesce({sql.int_of('status_code')}, 0) >= 400)")
add("u06_purge_except", lambda s, d: ops.purge_except(_runs(s, d), _runs(s, d).where("rag_indexed_at is not null").select("run_id")), f"select run_id from {_RUNS} where rag_indexed_at is null")
add("p28_block_kinds", lambda s, d: ops.block_kinds(pages(s, d)), f"select kind, count(*) as n from (select unnest(blocks).kind as kind from {PAGES}) group by kind")
add("p28_field_audit", lambda s, d: ops.field_audit(table(s, d, "crawl_pages").select("title", "status_code", "failure_reason", "blocks")), " union all ".join(f"select '{c}' as field, count(*) filter (where {c} is null) as nulls, count(*) filter (where {n} <= 0) as blank, count(*) filter (where {n} > 0) as present from crawl_pages" for c, n in (("title", "length(trim(title))"), ("status_code", "length(trim(status_code))"), ("failure_reason", "length(trim(failure_reason))"), ("blocks", "len(blocks)"))))
add(
    "p26_missing_postings",
    lambda s, d: ops.missing_postings(_doc_points(s, d).withColumn("child_text", F.lit(None).cast("string")).withColumn("parent_text", F.lit(None).cast("string")), _doc_points(s, d).join(table(s, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("point_id")), "point_id", "left_semi")).select("point_id", F.length("text").alias("chars")),
    "select doc_id as point_id, length(text) as chars from documents where text is not null and doc_id not in (select doc_id from documents where text is not null and lang = 'en')",
)
add(
    "r17_level_skips",
    lambda s, d: ops.level_skips(pages(s, d).select("page_id", F.posexplode("blocks").alias("pos", "b")).where("b.kind = 'heading'").select("page_id", "pos", F.col("b.level").alias("level")), "page_id", "pos", "level"),
    f"with h as (select page_id, pos, b.level as level, lag(b.level) over (partition by page_id order by pos) as before from (select page_id, unnest(blocks) as b, unnest(range(len(blocks))) as pos from {PAGES}) where b.kind = 'heading') select page_id, count(*) as headings, count(*) filter (where level > before + 1) as skips from h group by page_id",
)
add("r20_listing", lambda s, d: _shown(s, d).select("url", "child_index", "unit_id").withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("child_index", "unit_id"))), f"select url, child_index, unit_id, row_number() over (partition by url order by child_index, unit_id) as n from {_SHOWN}")
add(
    "a16_gate_summary",
    lambda s, d: ops.gate_summary(_sparse(s, d).where("rank <= 8").join(table(s, d, "documents").select(F.col("doc_id").alias("point_id"), "lang"), "point_id").groupBy("query_id").agg(F.min(F.when(F.col("lang") == "en", F.col("rank"))).alias("rank"), F.count("*").alias("returned")).join(table(s, d, "eval_items").select(F.col("item_id").alias("query_id"), "stratum"), "query_id", "right").select("stratum", "rank", F.coalesce("returned", F.lit(0)).alias("returned"), F.lit(False).alias("error"))),
    f"with {_S}, r as (select i.stratum, min(case when lang = 'en' then rank end) as rank, count(point_id) as returned from eval_items i left join (select s.*, lang from s join documents d on d.doc_id = s.point_id where rank <= 8) s on s.query_id = i.item_id group by i.item_id, i.stratum) select stratum, count(*) as asked, count(rank) as found, count(*) filter (where rank = 1) as first, count(*) filter (where returned > 0) as returned, 0 as errors from r group by stratum",
)

# --- allow lists, intervals and set operations on the star schema

add("j05_allowed_semi", lambda s, d: assets.allowed(table(s, d, "lineitem"), table(s, d, "orders").where("o_totalprice > 400000").select(F.col("o_orderkey").alias("l_orderkey")).orderBy("l_orderkey").limit(500), ["l_orderkey"]).select("l_orderkey", "l_linenumber"), "select l_orderkey, l_linenumber from lineitem where l_orderkey in (select o_orderkey from orders where o_totalprice > 400000 order by o_orderkey limit 500)")
add("j07_tampered_anti", lambda s, d: assets.tampered(table(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), table(s, d, "customer").where("c_acctbal > 0"), ["c_custkey"]).select("o_orderkey"), "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_acctbal > 0)")
add(
    "j08_interval_join",
    lambda s, d: assets.covering_source(table(s, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("start_char")), table(s, d, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 10 - 10).alias("start_char"), (F.col("l_linenumber") * 10).alias("end_char"), F.col("l_linenumber").alias("ord"), F.col("l_shipdate").cast("string").alias("label")), "l_orderkey").select("l_orderkey", "l_linenumber", F.col("source_label").isNotNull().alias("covered")),
    "select l_orderkey, l_linenumber, exists (select 1 from lineitem s where s.l_orderkey = l.l_orderkey and s.l_linenumber * 10 - 10 <= cast(floor(l.l_quantity) as int) and cast(floor(l.l_quantity) as int) < s.l_linenumber * 10) as covered from lineitem l",
)
add("s14_delete_rows", lambda s, d: assets.delete_rows(table(s, d, "orders"), table(s, d, "customer").where("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey")), ["o_custkey"]).select("o_orderkey"), "select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_nationkey = 3)")
add("u01_union_distinct", lambda s, d: table(s, d, "customer").select(F.col("c_nationkey").alias("n")).union(table(s, d, "supplier").select("s_nationkey")).distinct(), "select c_nationkey as n from customer union select s_nationkey from supplier")
add("o27_asset_chunks", lambda s, d: assets.asset_chunks(table(s, d, "eval_items").select(F.col("item_id").cast("string").alias("resource_digest"), "text")), unit_sql.ASSET_CHUNKS)
add(
    "a10_ordered_distinct",
    lambda s, d: table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag"))), lambda x: x["l_returnflag"])), ",").alias("flags")),
    "with o as (select l_orderkey, l_returnflag, min(l_linenumber) as n from lineitem group by l_orderkey, l_returnflag) select l_orderkey, string_agg(l_returnflag, ',' order by n, l_returnflag) as flags from o group by l_orderkey",
)

# --- governed templates by tags, channel and owner


def _templates(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select("doc_id", F.pmod("doc_id", F.lit(3)).cast("string").alias("owner_id"), F.col("lang").alias("channel"), F.col("source").alias("framework"), F.array_distinct(F.slice(retrieve.terms(F.col("text")), 1, 12)).alias("entity_tags"))


add(
    "o14_entity_tags",
    lambda s, d: assets.template_filter(_templates(s, d), "1", " EN ", None, ["how", "why"]).select("doc_id"),
    f"select doc_id from documents where text is not null and doc_id % 3 = 1 and lower(lang) = 'en' and len(list_intersect(({sql.words('text')})[1:12], ['how', 'why'])) > 0",
)


def _points(s: SparkSession, d: str) -> DataFrame:
    """The units as points with what a question may ask for."""
    p = pages(s, d).select("page_id", "url", urls.host_of("origin", "url").alias("host"), classify.quality(text.plain_text("blocks"), "title", F.size("blocks") > 0).alias("quality"), classify.category("url", text.plain_text("blocks")).alias("category"))
    return _units(s, d).select("unit_id", "page_id", "run_id", "child_text").join(p, "page_id").withColumns({"chunk_role": F.lit("child"), "language": language.language(F.col("child_text"))})


add(
    "o07_filtered_points",
    lambda s, d: retrieve.metadata_filter(_points(s, d), host=" HarrowLedger.example", categories=["Page", " docs "], min_quality=0.5, language="en", chunk_role=retrieve.search_role(None, True, False)).select("unit_id"),
    f"""with p as (select page_id, {sql.host('origin', 'url')} as host, {sql.category('url', sql.plain('blocks'))} as category, title, blocks, length({sql.strip(sql.plain('blocks'))}) as n from {PAGES}),
    r as (select *, least(greatest(35 + case when length(title) > 0 then 15 else 0 end + case when len(blocks) > 0 then 15 else 0 end + case when n >= 500 then 15 else 0 end + case when n >= 2000 then 10 else 0 end + case when n >= 5000 then 10 else 0 end - case when n < 200 then 20 else 0 end, 0), 100) / 100 as quality from p)
    select unit_id from {UNITS} u join r using (page_id) where host = 'harrowledger.example' and category in ('page', 'docs') and quality >= 0.5 and {unit_sql.language('u.child_text')} = 'en'""",
)
add(
    "r05_reranked",
    lambda s, d: retrieve.rerank(_sparse(s, d).join(table(s, d, "documents").select(F.col("doc_id").alias("point_id"), F.col("text").alias("document")), "point_id").join(_needs(s, d).withColumnRenamed("text", "query_text"), "query_id"), 8, retrieve.overlap_score).where("rank <= 8").select("query_id", "point_id", F.round("score", 9).alias("score"), "rank"),
    f"""with {_S}, o as (select s.query_id, s.point_id, s.rank as r, round(len(list_intersect(list_distinct({sql.words('need')}), list_distinct({sql.words('d.text')}))) / greatest(len(list_distinct({sql.words('need')})), 1), 9) as score from s join documents d on d.doc_id = s.point_id join eval_items e on e.item_id = s.query_id where s.rank <= 40)
    select query_id, point_id, score, cast(row_number() over (partition by query_id order by score desc, r) as int) as rank from o qualify rank <= 8""",
)

# --- points by host, cached vectors


def _typed(s: SparkSession, d: str) -> DataFrame:
    return pages(s, d).join(table(s, d, "crawl_runs").select("run_id", "crawl_type").distinct(), "run_id").select(F.col("page_id").alias("point_id"), site("origin").alias("host"), F.lower("crawl_type").alias("crawl_type"))


_TYPED = f"(select page_id as point_id, regexp_extract(lower(origin), {sql.q(SITE_PATTERN)}, 1) as host, lower(crawl_type) as crawl_type from {PAGES} join (select distinct run_id, crawl_type from crawl_runs) using (run_id))"
add("s17_crawl_types", lambda s, d: tables.crawl_types(_typed(s, d), "harrowledger.example"), f"select distinct crawl_type from {_TYPED} where host = 'harrowledger.example' order by crawl_type nulls first limit 16")
add("s16_any_point", lambda s, d: tables.any_point(_typed(s, d), "harrowledger.example").select("point_id", "host"), f"select min(point_id) as point_id, host from {_TYPED} where host = 'harrowledger.example' group by host")
_KEYS = "select distinct sha256(child_text) as key from "
add("s21_new_vectors", lambda s, d: tables.new_vectors(_units(s, d).where("child_index = 0").select(F.sha2("child_text", 256).alias("key")), _units(s, d).select(F.sha2("child_text", 256).alias("key"))), f"{_KEYS} {UNITS} where sha256(child_text) not in (select sha256(child_text) from {UNITS} where child_index = 0)")
add(
    "s20_cached_vectors",
    lambda s, d: tables.cached_vectors(table(s, d, "embeddings").select(F.col("vec_id").alias("key"), F.when(F.col("label") == 3, F.slice("embedding", 1, 8)).otherwise(F.col("embedding")).alias("vector")), table(s, d, "documents").select(F.col("doc_id").alias("key")), 64).select("key"),
    "select distinct doc_id as key from documents join embeddings on vec_id = doc_id where label <> 3",
)
add("j09_missing_pages", lambda s, d: verify.verify_quotes(_quotes(s, d), pages(s, d)).where("reason <> 'quote_not_found'").select("quote_id", "reason"), f"with c as (select page_id, {sql.reason()} as why, {sql.plain('blocks')} as t from {PAGES}), r as (select *, case when why is not null and why <> 'no_content' then 'page_not_citable:' || why when length({sql.strip('t')}) = 0 then 'page_not_found' end as refusal from c), j as (select unit_id as quote_id, case when r.page_id is null then 'page_not_found' else refusal end as reason from {UNITS} u left join r using (page_id)) select quote_id, reason from j where reason is not null")
add(
    "j01_entity_or_host",
    lambda s, d: index.resolve_entities(_typed(s, d), table(s, d, "mix_targets").select(F.col("source").alias("entity_id"), F.col("source").alias("entity_name"), F.lit("listed").alias("source_type"), F.lit("harrowledger.example").alias("domain"), F.col("target_share").alias("ord")), crawl_type="crawl_type").select("host", "crawl_type", "entity_id", "entity_name", "source_type"),
    f"""with h as (select distinct host, crawl_type from {_TYPED} where length(host) > 0), e as (select source from mix_targets order by target_share, source limit 1)
    select host, crawl_type, case when own then source end as entity_id, case when own then source else host end as entity_name, case when own then 'listed' when coalesce(trim(crawl_type), '') = '' then 'unknown' else lower(trim(crawl_type)) end as source_type from (select *, host = 'harrowledger.example' or ends_with(host, '.harrowledger.example') as own from h) x, e""",
)

# --- the retrieval gate


def _gate(s: SparkSession, d: str) -> DataFrame:
    points = _units(s, d).select(F.col("unit_id").alias("point_id"), "run_id", "section_title", "parent_text", "child_text", "page_id").join(pages(s, d).select("page_id", site("origin").alias("host")), "page_id")
    return ops.gate_sample(points, 80)


_CODE = sql.q("(" + ops.CODE + ")")
add(
    "p25_gate_sample",
    _gate,
    f"""with p as (select unit_id as point_id, u.run_id, regexp_extract(lower(origin), {sql.q(SITE_PATTERN)}, 1) as host, trim(child_text) as child, trim(parent_text) as parent, trim(coalesce(section_title, '')) as title from {UNITS} u join (select page_id, origin from {PAGES}) x using (page_id) where u.run_id is not null and length(trim(child_text)) > 0),
    l as (select *, list_filter(regexp_extract_all(child, {_CODE}, 1), lambda t: length(t) >= 5 and t not in ({", ".join(map(sql.q, ops.NO_CODE))})) as ts from p),
    e as (select point_id, run_id, host, unnest(ts) as need, unnest(range(len(ts))) as n from l),
    f as (select *, row_number() over (partition by need order by point_id, n) as k from e qualify k = 1),
    o as (select *, row_number() over (partition by point_id order by n) as k2 from f qualify k2 = 1)
    select * from (select 'literal' as stratum, need, run_id, host, need as expect_literal, cast(null as double) as parent_child_ratio from o order by point_id limit 40)
    union all select * from (select 'wide_parent', title, run_id, host, null, cast(round(length(parent) / length(child), 2) as double) from p where length(title) > 0 and length(parent) >= 2 * length(child) order by point_id limit 40)""",
)


def _gate_summary(s: SparkSession, d: str) -> DataFrame:
    asked = materialize(_gate(s, d).withColumn("query_id", F.xxhash64("stratum", "need", "run_id")).distinct(), "gate")
    units = _units(s, d).select(F.col("unit_id").alias("point_id"), F.col("child_text").alias("embed_text"))
    hits = retrieve.sparse_top_k(units, asked.select("query_id", F.col("need").alias("text")).distinct(), 8)
    return ops.gate_summary(ops.gate_results(asked, hits.join(units.withColumnRenamed("embed_text", "text"), "point_id").withColumnRenamed("rank", "position")))


add("p25_gate_run", _gate_summary)

# --- governed assets: the evaluation passages as resources of six keys


def _entries(s: SparkSession, d: str) -> DataFrame:
    key = F.col("item_id").cast("string")
    return table(s, d, "eval_items").select(
        F.lit("owner").alias("owner_id"), F.concat(F.lit("a"), F.pmod("item_id", F.lit(7))).alias("asset_id"), F.concat(F.lit("v"), key).alias("asset_version_id"), F.concat(F.lit("r"), key).alias("resource_id"),
        F.sha2("text", 256).alias("resource_digest"), F.sha2(F.concat(F.lit("v"), "text"), 256).alias("asset_version_digest"), "item_id", "text", F.when(F.col("item_id") % 5 == 0, "revoked").otherwise("approved").alias("lifecycle"), F.lit(None).cast("timestamp").alias("expires_at"),
    )


def _asset_points(s: SparkSession, d: str) -> DataFrame:
    e = _entries(s, d)
    return assets.index_assets(e.select(*assets.ENTRY_KEY, "text"), e.select(*assets.ENTRY_KEY, "lifecycle", "expires_at"))[0]


add("p09_asset_points", lambda s, d: _asset_points(s, d).select("resource_id", "start_char", "end_char", F.size("embedding").alias("width")), unit_sql.ASSET_POINTS)
add("p11_revision_left", lambda s, d: assets.delete_revision(_asset_points(s, d), _entries(s, d), "v2", "r2").select("resource_id", "start_char"), f"select resource_id, start_char from ({unit_sql.ASSET_POINTS}) t where resource_id <> 'r2'")
add("s15_allowed_points", lambda s, d: assets.allowed(_asset_points(s, d), _entries(s, d).where("item_id % 3 = 0")).select("resource_id", "start_char"), f"select resource_id, start_char from ({unit_sql.ASSET_POINTS}) t where cast(substr(resource_id, 2) as int) % 3 = 0")


def _asset_hits(s: SparkSession, d: str) -> DataFrame:
    points = materialize(_asset_points(s, d), "assetpoints")
    asked = table(s, d, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), index.embed(F.col("need")).alias("vector"))
    return assets.query_assets(points, _entries(s, d).where("item_id % 3 = 0"), asked, 5).select("query_id", "point_id", "rank")


add("p10_asset_hits", _asset_hits)
