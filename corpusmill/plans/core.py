"""Queries for the operators on pages, texts, addresses, runs and retrieval, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions import classify, ids, language, text, tokens, urls
from corpusmill.functions.sites import SITE_PATTERN, site
from corpusmill.operators import index, ops, retrieve, sections, verify
from corpusmill.plans import sql, unit_sql
from corpusmill.plans.sql import PAGES
from corpusmill.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = fn
    if oracle:
        ORACLE[name] = oracle


def pages(s: SparkSession, d: str) -> DataFrame:
    return index.latest(table(s, d, "crawl_pages"), "page_id", "arrived_at")


def per_page(col: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: pages(s, d).select("page_id", col())


def per_document(col: Callable[[], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: table(s, d, "documents").select("doc_id", col())


# --- pages: decoding, classification, counts

add("s02_page_counts", lambda s, d: ops.page_counts(table(s, d, "crawl_pages")), "select run_id, count(*) as pages from crawl_pages group by run_id")
add("s12_latest_pages", lambda s, d: pages(s, d).select("page_id", "run_id", "arrived_at"), f"select page_id, run_id, arrived_at from {PAGES}")
add("o15_status_int", per_page(lambda: classify.int_of("status_code").alias("status")), f"select page_id, {sql.int_of('status_code')} as status from {PAGES}")
add("o16_robots_flag", per_page(lambda: classify.bool_of("robots_allowed").alias("robots")), f"select page_id, {sql.bool_of('robots_allowed')} as robots from {PAGES}")
add("o01_unusable_reason", lambda s, d: index.classified(pages(s, d)).select("page_id", "reason"), f"select page_id, {sql.reason()} as reason from {PAGES}")
add("o02_locale_path", per_page(lambda: urls.is_locale_path("url").alias("locale")), f"select page_id, {sql.locale('url')} as locale from {PAGES}")
add("o03_sitemap", per_page(lambda: urls.is_sitemap("url").alias("sitemap")), f"select page_id, {sql.sitemap('url')} as sitemap from {PAGES}")
add(
    "o05_skip_counts",
    lambda s, d: index.skip_counts(pages(s, d)),
    f"""with c as (select run_id, {sql.reason()} as reason from {PAGES})
    select run_id, count(*) as pages_seen, count(*) filter (where reason is not null) as skipped_unusable,
      count(*) filter (where reason not in ('locale','failure','http_error','sitemap')) as skipped_empty, count(*) filter (where reason is null) as kept from c group by run_id""",
)
add("o13_citable", lambda s, d: verify.citable(pages(s, d)).select("page_id", "refusal"), f"with c as (select page_id, {sql.reason()} as reason, {sql.plain('blocks')} as t from {PAGES}) select page_id, case when reason is not null and reason <> 'no_content' then 'page_not_citable:' || reason when length({sql.strip('t')}) = 0 then 'page_not_found' end as refusal from c")

# --- texts

add("f03_plain_text", per_page(lambda: text.plain_text("blocks").alias("plain")), f"select page_id, {sql.plain('blocks')} as plain from {PAGES}")
add("f02_block_text", lambda s, d: pages(s, d).select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", text.render_block(F.col("b")).alias("t")), f"select page_id, cast(pos as int) as pos, {sql.block('b')} as t from (select page_id, unnest(blocks) as b, unnest(range(len(blocks))) as pos from {PAGES})")
add(
    "f04_page_title",
    per_page(lambda: text.page_title("title", "blocks").alias("title")),
    f"select page_id, case when length({sql.strip('title')}) > 0 then {sql.strip('title')} else list_filter(list_transform(list_filter(coalesce(blocks, []), lambda b: b.kind = 'heading'), lambda b: {sql.strip('coalesce(b.text, chr(0)[1:0])')}), lambda t: length(t) > 0)[1] end as title from {PAGES}".replace("chr(0)[1:0]", "''"),
)
add("f01_clean_prose", per_document(lambda: text.clean_prose("text").alias("t")), f"select doc_id, {sql.clean('text')} as t from documents")
add("f07_normalize", per_document(lambda: text.normalize("text").alias("t")), f"select doc_id, {sql.normalize('text')} as t from documents")
add("f08_sanitize", per_document(lambda: text.sanitize("text").alias("t")), f"select doc_id, regexp_replace(coalesce(text, ''), {sql.q(text.UNWANTED)}, '', 'g') as t from documents")
add("f20_signal_form", per_document(lambda: text.signal_form("text").alias("t")), f"select doc_id, array_to_string({sql.terms('text')}, ' ') as t from documents")
add("f09_asset_text", per_document(lambda: text.asset_text("text").alias("t")), f"with a as (select doc_id, {sql.strip('array_to_string(list_transform(string_split(regexp_replace(text, chr(13) || chr(10) || chr(63), chr(10), chr(103)), chr(10)), lambda t: ' + sql.strip('regexp_replace(t, chr(91) || chr(32) || chr(9) || chr(93) || chr(43), chr(32), chr(103))') + '), chr(10))')} as t from documents) select doc_id, case when length(t) > 0 then t end as t from a")
_MARKED = "regexp_replace(regexp_replace(text, '([.!?])(?:\\s+|$)', '\\1' || chr(1), 'g'), ':\\n', ':' || chr(1), 'g')"
add(
    "f11_sentences",
    lambda s, d: table(s, d, "documents").select("doc_id", F.posexplode(text.sentences("text")).alias("n", "sentence")),
    f"with s as (select doc_id, list_filter(list_transform(string_split({_MARKED}, chr(1)), lambda t: regexp_replace(t, '^[ \\n\\-*]+|[ \\n\\-*]+$', '', 'g')), lambda t: length(t) >= 3) as l from documents where text is not null) select doc_id, cast(unnest(range(len(l))) as int) as n, unnest(l) as sentence from s",
)
add("f13_specific", per_document(lambda: text.is_specific("text").alias("specific")), f"select doc_id, regexp_matches(text, {sql.q(text.SPECIFIC)}) as specific from documents")
add(
    "o09_stub_units",
    lambda s, d: table(s, d, "parent_child_units").select("unit_id", text.is_stub("child_text", "section_title").alias("stub")).distinct(),
    f"with u as (select unit_id, {sql.normalize('child_text')} as t, {sql.normalize('section_title')} as own from parent_child_units) select distinct unit_id, length(t) = 0 or (length(own) > 0 and t = own) or regexp_matches(t, {sql.q(text.TRAIL)}) or len(regexp_extract_all(t, {sql.q(text.STUB_WORD)})) < 8 as stub from u",
)
add("o23_token_counts", lambda s, d: table(s, d, "parent_child_units").select("unit_id", tokens.token_count(F.col("child_text")).alias("n")).distinct(), r"select distinct unit_id, len(regexp_extract_all(child_text, '[\pL\pN_]+|[^\pL\pN_\s\x1c-\x1f\x85\pZ]')) as n from parent_child_units")
add("o06_language", per_document(lambda: language.language(F.col("text")).alias("detected")), unit_sql.LANGUAGES)

# --- sections and units

add(
    "o22_sections",
    lambda s, d: sections.page_sections(pages(s, d)).select("page_id", "section_index", "title", "level", "text"),
    f"""with b as (select page_id, unnest(blocks) as b, unnest(range(len(blocks))) as pos from {PAGES} where len(blocks) > 0),
    g as (select page_id, pos, b, sum(case when b.kind = 'heading' then 1 else 0 end) over (partition by page_id order by pos rows unbounded preceding) as g from b),
    r as (select page_id, g, pos, case when b.kind = 'heading' then nullif({sql.strip('b.text')}, '') end as title, case when b.kind = 'heading' then b.level end as level, {sql.block('b')} as t from g),
    s as (select page_id, g, first(title order by pos) as title, first(level order by pos) as level, string_agg(t, chr(10) || chr(10) order by pos) filter (where length({sql.strip('t')}) > 0) as text from r group by page_id, g)
    select page_id, cast(row_number() over (partition by page_id order by g) - 1 as int) as section_index, title, level, text from s where text is not null""",
)
add("o22_section_anchors", lambda s, d: sections.page_sections(pages(s, d)).select("page_id", "section_index", F.explode("anchors").alias("a")).groupBy("page_id", "section_index").agg(F.count("*").alias("links"), F.count_if(F.length("a.label") > 0).alias("labelled")), unit_sql.SECTION_ANCHORS)
add("o25_units", lambda s, d: sections.units(sections.page_sections(pages(s, d))).select("page_id", "section_index", "parent_index", "child_index", "section_title", "parent_text", "child_text"), unit_sql.UNITS_OF_PAGES)
add("p01_index_run", lambda s, d: index.index_run(table(s, d, "crawl_pages")).select("point_id", "run_id", "page_id", "chunk_role", "chunk_key", "category", "quality", "text_digest"), unit_sql.INDEX_RUN)
add("a02_index_counts", lambda s, d: index.index_counts(table(s, d, "crawl_pages")), unit_sql.INDEX_COUNTS)
add("o29_parents_once", lambda s, d: index.page_nodes(pages(s, d)).where("chunk_role = 'parent'").select("page_id", "chunk_key", "text_digest"), unit_sql.PARENTS)
UNITS = "(select distinct unit_id, page_id, run_id, section_title, parent_index, child_index, parent_text, child_text from parent_child_units)"


def _units(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "parent_child_units").drop("section_anchors").distinct()


def _dated_units(s: SparkSession, d: str) -> DataFrame:
    u = _units(s, d).where("run_id is not null").withColumn("text_digest", ids.text_digest("child_text"))
    return u.join(pages(s, d).select("page_id", "crawled_at"), "page_id")


add(
    "r16_first_page_wins",
    lambda s, d: index.first_page_wins(_dated_units(s, d)).select("unit_id", "run_id", "page_id", "text_digest"),
    f"""with u as (select u.*, p.crawled_at, sha256(regexp_replace(child_text, {sql.q(text.UNWANTED)}, '', 'g')) as text_digest from {UNITS} u join {PAGES} p using (page_id) where u.run_id is not null),
    o as (select *, first_value(page_id) over (partition by run_id, text_digest order by crawled_at, page_id) as owner from u) select unit_id, run_id, page_id, text_digest from o where page_id = owner""",
)
add(
    "p02_embed_distinct",
    lambda s, d: index.embed_distinct(_units(s, d).withColumn("embed_text", text.sanitize("child_text")).select("unit_id", "embed_text"))[0].select("unit_id", F.size("embedding").alias("width"), F.round(retrieve.norm(F.col("embedding")), 3).alias("length")),
)
# --- addresses


def _passage_kind() -> str:
    blob = f"(lower({sql.path('url')}) || ' ' || lower(coalesce(section_title, '')) || ' ' || lower(substr(coalesce(child_text, ''), 1, 800)))"
    cat = sql.category("url", "child_text")
    cases = " ".join(f"when {sql.any_of(blob, ns)}{f' or c = {sql.q(d)}' if d else ''} then {sql.q(k)}" for k, d, ns in classify.PASSAGE_KINDS)
    return f"with x as (select u.*, url, {cat} as c from {UNITS} u join (select page_id, url from {PAGES}) p using (page_id)) select unit_id, case {cases} else 'feature' end as kind from x"



add("f22_host", per_page(lambda: urls.host_of("origin", "url").alias("host")), f"select page_id, {sql.host('origin', 'url')} as host from {PAGES}")
add("f23_bare_host", per_page(lambda: urls.bare_host(urls.host_of("origin", "url")).alias("host")), f"select page_id, regexp_replace({sql.host('origin', 'url')}, '^www\\.', '') as host from {PAGES}")
add("f24_host_candidates", per_page(lambda: F.array_join(urls.host_candidates("origin"), " ").alias("hosts")), f"with h as (select page_id, {sql.host('origin', 'null')} as h from {PAGES}), b as (select *, regexp_replace(h, '^www\\.', '') as b from h) select page_id, case when not contains(h, '.') then '' when h = b then h || ' www.' || b else h || ' ' || b || case when h <> 'www.' || b then ' www.' || b else '' end end as hosts from b")
add("f25_page_key", per_page(lambda: urls.page_key("page_id", "final_url", "url").alias("key")), f"select page_id, 'id:' || page_id as key from {PAGES}")
add(
    "f26_tags",
    per_page(lambda: F.array_join(urls.tags("url", "title"), " ").alias("tags")),
    f"""with p as (select page_id, list_filter(list_transform(list_filter(string_split(lower({sql.path('url')}), '/'), lambda p: p <> '' and p not in ('index.html', 'index.htm'))[1:8], lambda p: regexp_replace(regexp_replace(p, '[^a-z0-9\\-]+', '-', 'g'), '^-+|-+$', '', 'g')), lambda p: p <> '')
      || list_filter(({sql.terms("coalesce(title, '')")})[1:6], lambda w: length(w) > 2) as l from {PAGES})
    select page_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i)[1:12], ' ') as tags from p""",
)
add("f27_category", per_page(lambda: classify.category("url", text.plain_text("blocks")).alias("category")), f"select page_id, {sql.category('url', sql.plain('blocks'))} as category from {PAGES}")
add("f28_intent", per_page(lambda: classify.content_intent(classify.category("url", text.plain_text("blocks"))).alias("intent")), f"with c as (select page_id, {sql.category('url', sql.plain('blocks'))} as c from {PAGES}) select page_id, case c " + " ".join(f"when {sql.q(k)} then {sql.q(v)}" for k, v in classify.INTENTS.items()) + " else 'general' end as intent from c")
add("f31_source_rights", per_page(lambda: classify.source_rights(site("origin"), F.lit(None).cast("string"), ["www.Harrowledger.example"]).alias("rights")), f"select page_id, case when regexp_replace(lower({sql.strip(f'regexp_extract(lower(origin), {sql.q(SITE_PATTERN)}, 1)')}), '^www\\.', '') = 'harrowledger.example' then 'consented' else 'unknown' end as rights from {PAGES}")
add(
    "f32_quality",
    per_page(lambda: classify.quality(text.plain_text("blocks"), "title", F.size("blocks") > 0).alias("quality")),
    f"with t as (select page_id, title, blocks, length({sql.strip(sql.plain('blocks'))}) as n from {PAGES}) select page_id, least(greatest(35 + case when length(title) > 0 then 15 else 0 end + case when len(blocks) > 0 then 15 else 0 end + case when n >= 500 then 15 else 0 end + case when n >= 2000 then 10 else 0 end + case when n >= 5000 then 10 else 0 end - case when n < 200 then 20 else 0 end, 0), 100) / 100 as quality from t",
)
add("f33_evergreen", per_page(lambda: classify.is_evergreen("url", text.plain_text("blocks")).alias("evergreen")), f"with t as (select page_id, url, {sql.plain('blocks')} as t from {PAGES}) select page_id, not {sql.any_of(chr(40) + 'lower(coalesce(url, chr(32)) || chr(32) || substr(t, 1, 800))' + chr(41), [*classify.YEARS, '/news/', 'press release'])} and {sql.category('url', 't')} in ('docs','product','pricing','about','page') as evergreen from t")
add("f29_passage_kind", lambda s, d: _units(s, d).join(pages(s, d).select("page_id", "url"), "page_id").select("unit_id", classify.passage_kind("url", "section_title", "child_text", classify.category("url", "child_text")).alias("kind")), _passage_kind())
add("f30_feature_tag", lambda s, d: _units(s, d).select("unit_id", classify.feature_tag("section_title", F.array().cast("array<string>")).alias("tag")), f"select unit_id, nullif(substr({sql.strip('regexp_replace(' + sql.strip('section_title') + ', ' + sql.q('[^a-zA-Z0-9 \\-_]+') + ', chr(0)[1:0], chr(103))')}, 1, 80), '') as tag from {UNITS}".replace("chr(0)[1:0]", "''"))

# --- identifiers

_NS = ids.POINTS.hex
add(
    "o31_point_id",
    lambda s, d: _units(s, d).select("unit_id", ids.point_id("run_id", "page_id", F.concat(F.lit("child:"), "child_index")).alias("id")),
    f"""with n as (select unit_id, sha1(unhex('{_NS}') || encode(concat_ws(':', run_id, page_id, 'child:' || child_index))) as h from {UNITS})
    select unit_id, substr(h,1,8) || '-' || substr(h,9,4) || '-5' || substr(h,14,3) || '-' || case when substr(h,17,1) in ('0','4','8','c') then '8' when substr(h,17,1) in ('1','5','9','d') then '9' when substr(h,17,1) in ('2','6','a','e') then 'a' else 'b' end || substr(h,18,3) || '-' || substr(h,21,12) as id from n""",
)
add("f45_stable_id", lambda s, d: table(s, d, "eval_items").select("item_id", ids.stable_id("query", F.col("stratum"), F.lower("need")).alias("id")), "select item_id, substr(sha256('query' || chr(31) || stratum || chr(31) || lower(need)), 1, 24) as id from eval_items")
add("f46_text_digest", per_document(lambda: ids.text_digest("text").alias("digest")), f"select doc_id, sha256(regexp_replace(coalesce(text, ''), {sql.q(text.UNWANTED)}, '', 'g')) as digest from documents")
add("f47_source_digest", per_page(lambda: ids.source_digest("content_html").alias("digest")), f"select page_id, case when length(content_html) > 0 then sha256(content_html) end as digest from {PAGES}")
add("f48_cache_key", per_document(lambda: ids.cache_key("text", "hash-384").alias("key")), "select doc_id, sha256('hash-384' || chr(0) || text) as key from documents")

# --- queries

add(
    "f34_query_class",
    lambda s, d: table(s, d, "eval_items").select("item_id", classify.query_class("need").alias("c"), classify.query_signals("need", F.lit("observed")).alias("p"), classify.cluster_label("need").alias("label")).select("item_id", "c.intent", "c.stage", "p.score", "p.tier", "label"),
    """with q as (select item_id, need, case """
    + " ".join(f"when regexp_matches(lower(need), {sql.q(p)}) then '{i}'" for p, i, *_ in classify.QUERY_CLASSES)
    + """ else 'informational' end as intent, regexp_extract_all(lower(need), '[a-z0-9]+') as w from eval_items),
    s as (select *, case intent when 'navigational' then 'retention' when 'transactional' then 'decision' when 'commercial' then 'consideration' else 'awareness' end as stage from q),
    p as (select *, 40 + case intent when 'informational' then 10 when 'commercial' then 20 when 'transactional' then 25 else 15 end + case when len(w) >= 5 then 20 when len(w) >= 3 then 10 else 5 end + case stage when 'awareness' then 5 when 'decision' then 15 else 10 end as score from s)
    select item_id, intent, stage, score, case when score >= 70 then 'high' when score >= 45 then 'medium' else 'low' end as tier,
      coalesce(nullif(array_to_string(list_filter(w, lambda x: x not in ("""
    + ", ".join(map(sql.q, classify.CLUSTER_STOP))
    + """))[1:3], ' '), ''), 'general') as label from p""",
)
