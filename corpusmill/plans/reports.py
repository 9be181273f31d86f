"""Queries for document reports, streams and window or set rules on the star schema, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import generators, ids, text, tokens
from corpusmill.functions.sites import SITE_PATTERN, site
from corpusmill.operators import assets, checks, evidence, ops, reports, retrieve, sections
from corpusmill.plans import report_sql, sql, unit_sql
from corpusmill.plans.core import _MARKED, _units, pages
from corpusmill.plans.core import ORACLE as CORE_ORACLE
from corpusmill.plans.sql import PAGES
from corpusmill.sources.tables import table, upsert
from corpusmill.streaming import streams

ORACLE_OF_CLASSES = CORE_ORACLE["f34_query_class"]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def add(name: str, fn: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = fn
    if oracle:
        ORACLE[name] = oracle


def outline(blocks: str = "blocks") -> Column:
    """A page as a plain document: headings marked by #, list items by a dash."""
    mark = lambda b: F.when(b["kind"] == "heading", F.concat(F.repeat(F.lit("#"), F.least(F.greatest(F.coalesce(b["level"], F.lit(1)), F.lit(1)), F.lit(6))), F.lit(" "), text.render_block(b))).when(b["kind"] == "listItem", F.concat(F.lit("- "), text.render_block(b))).otherwise(text.render_block(b))
    return F.array_join(F.filter(F.transform(F.coalesce(blocks, F.array()), mark), lambda t: F.length(t) > 0), "\n")


def docs(s: SparkSession, d: str) -> DataFrame:
    """Documents: pages as outlines, with their first sentence as evidence and the status as technical signal."""
    p = pages(s, d).select(F.col("page_id").alias("source_id"), outline().alias("text"), "url", (F.col("failure_reason").isNotNull()).alias("partial"), F.when(site("origin").startswith("help."), "subject").otherwise("competitor").alias("role"))
    quote = F.substring("text", 1, 40)
    return p.withColumn("evidence", F.array(F.struct(F.concat(F.lit("e-"), "source_id").alias("evidence_id"), "source_id", quote.alias("quote"), F.lit(0).alias("start_char"), F.length(quote).alias("end_char")))).where("length(text) > 0")


def plain_docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").where("text is not null").select(F.col("doc_id").alias("source_id"), F.regexp_replace("text", "^#", "").alias("text")).where(F.length(text.strip(F.col("text"))) > 0)


add("p12_readiness", lambda s, d: reports.readiness(docs(s, d)))
add("p12_readiness_dimensions", lambda s, d: reports.readiness_dimensions(docs(s, d)), report_sql.READINESS_DIMENSIONS)
add("p13_claims", lambda s, d: reports.claims(docs(s, d)).select("source_id", "claim_id", "specific", "status"), report_sql.CLAIM_ROWS)
add("p13_fact_density", lambda s, d: reports.fact_density(docs(s, d))[1], report_sql.FACT_DENSITY)
_ONE = f"select doc_id as source_id, {_MARKED} as m, text from documents where length({sql.strip('text')}) > 0 and not regexp_matches(text, '(?m)^#{{1,6}}\\s+')"
add(
    "a08_fact_share",
    lambda s, d: reports.fact_density(plain_docs(s, d).where(~F.col("text").rlike(r"(?m)^#{1,6}\s+")))[0].select("source_id", "sentences", "facts", "score"),
    f"""with o as ({_ONE}), s as (select source_id, list_filter(list_transform(string_split(m, chr(1)), lambda t: regexp_replace(t, '^[ \\n\\-*]+|[ \\n\\-*]+$', '', 'g')), lambda t: length(t) >= 3) as l from o),
    c as (select source_id, len(l) as sentences, len(list_filter(l, lambda t: regexp_matches(t, {sql.q(text.SPECIFIC)}))) as facts from s) select source_id, sentences, facts, case when sentences > 0 then round(facts / (2 * sentences) * 100, 1) end as score from c""",
)
add("p14_entities", lambda s, d: reports.entities(docs(s, d)).select("source_id", "entity_id", "name", "mentions", "confidence"), report_sql.ENTITIES)
add("p14_relationships", lambda s, d: reports.relationships(docs(s, d)))
add("p15_schema_nodes", lambda s, d: reports.schema_nodes(docs(s, d)).select("source_id", "type", "visible"))
add("p15_schema_checks", lambda s, d: reports.schema_checks(docs(s, d)).select("source_id", "type", "code", "valid"))
add("p17_findings", lambda s, d: reports.findings(docs(s, d)).select("source_id", "dimension", "present", "n"), report_sql.FINDING_ROWS)
add("p18_content_gaps", lambda s, d: reports.content_gaps(docs(s, d)).select("dimension", "signal", "status", "confidence"), report_sql.GAP_ROWS)
add("p20_audit_actions", lambda s, d: reports.audit_actions(docs(s, d)), report_sql.ACTIONS)
add("p21_attribute_map", lambda s, d: reports.attribute_map(docs(s, d)), report_sql.ATTRIBUTES)
add("p19_best_scores", lambda s, d: reports.readiness_dimensions(docs(s, d)).groupBy("dimension").agg(F.max("score").alias("best"), F.count("score").alias("known")), report_sql.BEST_SCORES)
add(
    "p16_query_plan",
    lambda s, d: reports.query_plan(table(s, d, "eval_items").select(F.col("need").alias("query"), F.lit("observed").alias("origin")), table(s, d, "mix_targets").select(F.col("source").alias("topic"), F.col("source").alias("ord"))).select("query_id", "query", "origin", "intent", "stage", "priority", "tier", "cluster_label"),
)
add(
    "o32_query_hypotheses",
    lambda s, d: reports.query_plan(table(s, d, "eval_items").select(F.col("need").alias("query"), F.lit("observed").alias("origin")), table(s, d, "mix_targets").select(F.col("source").alias("topic"), F.col("source").alias("ord"))).where("origin = 'generatedHypothesis'").select("query"),
    f"with t as (select lower({sql.strip('source')}) as k, arg_min(source, source) as topic from mix_targets where length({sql.strip('source')}) > 0 group by 1), q as (select unnest(['what is ' || {sql.strip('topic')}, {sql.strip('topic')} || ' alternatives', {sql.strip('topic')} || ' pricing']) as query from t) select {sql.collapse(sql.strip('query'))} as query from q where lower({sql.collapse(sql.strip('query'))}) not in (select lower({sql.collapse(sql.strip('need'))}) from eval_items)",
)
add("f14_entity_counts", lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.size(generators.entity_mentions(F.col("text"))).alias("mentions")), report_sql.ENTITY_COUNTS)
add("f15_faq_pairs", lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.explode(generators.faq_pairs(F.col("text"))).alias("p")).select("doc_id", "p.question", "p.answer"), unit_sql.FAQ_PAIRS)
add("f10_document_sections", lambda s, d: docs(s, d).select("source_id", F.explode(generators.sections(F.col("text"))).alias("s")).select("source_id", "s.section_id", "s.heading"), report_sql.DOCUMENT_SECTIONS)
add("f12_sentence_offsets", lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", "text", F.explode(generators.sentences_with_offsets(F.col("text"))).alias("s")).select("doc_id", "s.start", "s.end", (F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")) == F.col("s.sentence")).alias("exact")), report_sql.SENTENCE_OFFSETS)
add("o33_dimension_matches", lambda s, d: docs(s, d).select("source_id", F.explode(generators.dimension_matches(F.col("text"))).alias("m")).select("source_id", "m.dimension", "m.start", "m.end"))
add("f06_visible_lines", lambda s, d: pages(s, d).where("content_html is not null").select("page_id", F.size(F.split(generators.visible_text(F.col("content_html"), F.lit("text/html")), "\n")).alias("lines")))
add(
    "f16_howto_steps",
    lambda s, d: table(s, d, "documents").where("text is not null").select("doc_id", F.size(F.regexp_extract_all("text", F.lit(r"(?m)^\s*\d+[.)]\s+(.+?)\s*$"), F.lit(1))).alias("steps")),
    "select doc_id, cast(len(regexp_extract_all(text, '(?m)^\\s*\\d+[.)]\\s+(.+?)\\s*$')) as int) as steps from documents where text is not null",
)

# --- streams and their batch forms



def _stream_counts(s: SparkSession, d: str) -> DataFrame:
    e = streams.table_stream(s, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))
    return streams.run_available(e, "counts", "complete")


add("t01_stream_counts", _stream_counts, "select event_type, count(*) as n, round(sum(value), 2) as total from events group by event_type")
add(
    "t02_first_texts",
    lambda s, d: streams.run_available(streams.first_texts(streams.table_stream(s, d, "documents").where("text is not null").select(F.lower(F.trim("source")).alias("run_id"), ids.text_digest("text").alias("text_digest"))), "texts"),
    f"select distinct lower(trim(source)) as run_id, sha256(regexp_replace(text, {sql.q(text.UNWANTED)}, '', 'g')) as text_digest from documents where text is not null",
)
_BEATS = """with b as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 900 seconds then 0 else 1 end as fresh from events), g as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as g from b)
select user_id, min(ts) as held_from, max(ts) + interval 900 seconds as held_until, count(*) as beats from g group by user_id, g"""
add("t03_lease_spans", lambda s, d: streams.lease_spans(table(s, d, "events"), "user_id", "ts"), _BEATS)
add("t03_lease_stream", lambda s, d: streams.run_available(streams.lease_spans(streams.table_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "ts"), "leases", "complete"), _BEATS)
add("t05_claim_once", lambda s, d: streams.run_available(streams.claim_once(streams.table_stream(s, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts")), "event_id", "ts").select("event_id"), "claims"), "select distinct event_id from events")
add("t06_latest_status", lambda s, d: streams.latest_status(table(s, d, "events"), "user_id", "event_type", "ts"), "select user_id, arg_max(event_type, ts::varchar || event_type) as event_type, max(ts) as ts from events group by user_id")
add("t06_status_stream", lambda s, d: streams.run_available(streams.latest_status(streams.table_stream(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "event_type", "ts").select("user_id", "event_type"), "status", "complete"), "select user_id, arg_max(event_type, ts::varchar || event_type) as event_type from events group by user_id")

# --- keyed tables

add(
    "s12_upsert",
    lambda s, d: upsert(table(s, d, "crawl_pages").where("failure_reason is null").select("page_id", "arrived_at"), table(s, d, "crawl_pages").select("page_id", "arrived_at"), "page_id", "arrived_at"),
    "select page_id, max(arrived_at) as arrived_at from crawl_pages group by page_id",
)
add(
    "r18_upsert_items",
    lambda s, d: assets.upsert_items(table(s, d, "documents").where("text is not null").select(F.lower("source").alias("template_id"), F.col("text").alias("body"), F.col("doc_id").alias("ord"))).select("ord"),
    f"with ok as (select lower(trim(lower(source))) as id, doc_id from documents where text is not null and length({sql.strip('text')}) >= 8), f as (select *, row_number() over (partition by id order by doc_id) as n from ok) select doc_id as ord from f where n = 1 order by doc_id limit 50",
)
add(
    "r12_asset_top_k",
    lambda s, d: assets.asset_top_k(table(s, d, "embeddings").withColumnRenamed("vec_id", "point_id").withColumn("manifest_eligible", F.col("label") != 3), table(s, d, "embeddings").select("label").where("label in (1, 2, 3)").distinct(), table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 5, ["label"]).select("query_id", "point_id", "rank"),
    "select query_id, point_id, rank from (select query_id, point_id, row_number() over (partition by query_id order by score desc, point_id) as rank from (select q.vec_id as query_id, p.vec_id as point_id, list_dot_product(p.embedding::double[], q.embedding::double[]) / sqrt(list_dot_product(p.embedding::double[], p.embedding::double[])) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) as score from embeddings p, embeddings q where q.vec_id % 50 = 0 and p.label in (1, 2)) t) u where rank <= 5",
)
add("p29_contract_diff", lambda s, d: ops.contract_diff(s.createDataFrame([(f.name, f.dataType.simpleString()) for f in table(s, d, "orders").schema], "field string, type string"), s.createDataFrame([("o_orderkey", "bigint"), ("o_custkey", "int"), ("o_note", "string")], "field string, type string")))
add("j06_allowed_versions", lambda s, d: assets.allowed(table(s, d, "lineitem"), table(s, d, "part").where("p_size = 7").select(F.col("p_partkey").alias("l_partkey")).orderBy("l_partkey").limit(500), ["l_partkey"]).groupBy("l_partkey").agg(F.count("*").alias("n")), "select l_partkey, count(*) as n from lineitem where l_partkey in (select p_partkey from part where p_size = 7 order by p_partkey limit 500) group by l_partkey")
add("j15_new_words", lambda s, d: table(s, d, "documents").where("text is not null and lang = 'de'").select(F.explode(F.array_distinct(retrieve.terms(F.col("text")))).alias("k")).distinct().join(table(s, d, "documents").where("text is not null and lang = 'en'").select(F.explode(F.array_distinct(retrieve.terms(F.col("text")))).alias("k")).distinct(), "k", "left_anti"), f"select distinct k from (select unnest({sql.words('text')}) as k from documents where lang = 'de') where k not in (select unnest({sql.words('text')}) from documents where text is not null and lang = 'en')")
add("o28_batches", lambda s, d: sections.batched(table(s, d, "documents").where("text is not null"), "doc_id", "text"))
add("o37_repeated_keys", lambda s, d: checks.repeated(table(s, d, "parent_child_units"), "unit_id"), "select unit_id, count(*) as n from parent_child_units group by unit_id having count(*) > 1")
add("o37_unknown_pages", lambda s, d: checks.unknown(table(s, d, "page_hits").where("page_id is not null"), table(s, d, "crawl_pages"), "page_id").select("page_id").distinct(), "select distinct page_id from page_hits where page_id is not null and page_id not in (select page_id from crawl_pages)")


def _first_of(s: SparkSession, d: str, role: str) -> str:
    """The smallest document of a role, '' where there is none."""
    return docs(s, d).where(F.col("role") == role).agg(F.min("source_id")).first()[0] or ""


add("j11_entity_coverage", lambda s, d: reports.entity_coverage(docs(s, d), _first_of(s, d, "subject"), _first_of(s, d, "competitor")), report_sql.COVERAGE)
add("j14_readiness_comparison", lambda s, d: reports.readiness_comparison(docs(s, d), _first_of(s, d, "subject")), report_sql.COMPARISON)
add("p18_gap_sources", lambda s, d: reports.gap_sources(docs(s, d)), report_sql.GAP_SOURCES)
add(
    "a06_distinct_clusters",
    lambda s, d: reports.query_plan(table(s, d, "eval_items").select(F.col("need").alias("query"), F.lit("observed").alias("origin")), table(s, d, "mix_targets").select(F.col("source").alias("topic"), F.col("source").alias("ord")).limit(0)).agg(F.countDistinct("cluster_id").alias("clusters")),
    f"select count(distinct label) as clusters from ({ORACLE_OF_CLASSES})",
)
add(
    "r11_template_top_k",
    lambda s, d: assets.template_top_k(table(s, d, "embeddings").select(F.col("vec_id").alias("template_id"), "embedding", F.when(F.col("label") == 3, F.lit(" ")).otherwise(F.lit("text")).alias("body")), table(s, d, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector")), 25).select("query_id", "template_id", "rank"),
    "select query_id, template_id, rank from (select query_id, template_id, label, row_number() over (partition by query_id order by score desc, template_id) as rank from (select q.vec_id as query_id, p.vec_id as template_id, p.label, list_dot_product(p.embedding::double[], q.embedding::double[]) / sqrt(list_dot_product(p.embedding::double[], p.embedding::double[])) / sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) as score from embeddings p, embeddings q where q.vec_id % 50 = 0) t) u where rank <= 20 and label <> 3",
)

# --- evidence, warnings, summaries, bookkeeping

add("o34_sentence_evidence", lambda s, d: evidence.sentence_evidence(table(s, d, "documents").where("text is not null"), "doc_id").select("doc_id", "start_char", "end_char", "quote", "evidence_id"), report_sql.SENTENCE_EVIDENCE)
add("o34_finding_evidence", lambda s, d: evidence.finding_evidence(docs(s, d)).select("source_id", "dimension", "quote", "evidence_id"))
add("f50_finding_summaries", lambda s, d: reports.findings(docs(s, d)).select("source_id", "dimension", evidence.finding_summary(F.col("dimension"), F.col("present"), F.col("n")).alias("summary")), report_sql.SUMMARIES)
add("f50_delta_summaries", lambda s, d: reports.readiness_comparison(docs(s, d), _first_of(s, d, "subject")).select("dimension", evidence.delta_summary(F.col("dimension"), F.col("score"), F.col("best"), F.col("delta")).alias("summary")), report_sql.DELTAS)
add("f52_warnings", lambda s, d: evidence.warnings(docs(s, d).withColumn("source_digest", F.when(F.col("role") == "subject", F.sha2("text", 256)).otherwise(F.lit("0")))).select("source_id", F.array_join("warnings", "\n").alias("warnings")), report_sql.WARNINGS)
add("f53_provenance", lambda s, d: evidence.provenance(docs(s, d)).select("source_id", "url", F.array_join("evidence_ids", " ").alias("evidence_ids")), report_sql.PROVENANCE)
add("s07_links_removed", lambda s, d: evidence.delete_page(pages(s, d), table(s, d, "page_hits"), pages(s, d).agg(F.min("page_id")).first()[0] or "")[2], "select count(*) as links_removed from page_hits where page_id = (select min(page_id) from crawl_pages)")
add("s07_pages_left", lambda s, d: evidence.delete_page(pages(s, d), table(s, d, "page_hits"), pages(s, d).agg(F.min("page_id")).first()[0] or "")[0].select("page_id"), "select distinct page_id from crawl_pages where page_id <> (select min(page_id) from crawl_pages)")


def _stamp() -> Column:
    return F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")


add(
    "f43_ready_at",
    lambda s, d: table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("x", F.when(F.col("event_id") % 4 == 0, F.concat(_stamp(), F.lit("+00"))).when(F.col("event_id") % 4 == 1, F.concat(F.replace(_stamp(), F.lit(" "), F.lit("T")), F.lit("Z"))).when(F.col("event_id") % 4 == 2, F.concat(F.lit(" "), _stamp())).otherwise(F.lit("not yet"))).select("event_id", F.unix_micros(evidence.ready_at(F.col("x"))).alias("at")),
    "select event_id, case when event_id % 4 < 3 then epoch_us(ts) end as at from events",
)
add("f42_status_rows", lambda s, d: evidence.status_rows(table(s, d, "crawl_runs").select("run_id", F.col("status").alias("state"), F.lit(None).cast("int").alias("pages_seen"))).select("run_id", "state", "pages_seen", "chunks_upserted", "trigger").distinct(), "select distinct run_id, coalesce(nullif(status, ''), 'failed') as state, 0::bigint as pages_seen, 0::bigint as chunks_upserted, 'manual' as trigger from crawl_runs")
add("r19_trigger_order", lambda s, d: evidence.trigger_order(table(s, d, "crawl_runs")).select("run_id"), "select run_id from (select distinct run_id, content_ready_at from crawl_runs where content_ready_at is not null and rag_indexed_at is null) order by run_id")
_KEYED = f"(select sha256(child_text) as key, child_index, len(regexp_extract_all(child_text, {sql.q(unit_sql.TOKEN)})) as n from {unit_sql.DISTINCT_UNITS})"
add(
    "a19_embedding_stats",
    lambda s, d: evidence.embedding_stats(_units(s, d).select(F.sha2("child_text", 256).alias("key"), "child_text"), _units(s, d).where("child_index = 0").select(F.sha2("child_text", 256).alias("key")), 150, tokens.token_count(F.col("child_text"))),
    f"with k as {_KEYED}, u as (select key, count(*) as c, count(*) filter (where n > 150) as l from k group by key) select cast(sum(c) as bigint) as texts, count(*) as different, count(*) filter (where key in (select key from k where child_index = 0)) as hits, count(*) filter (where key not in (select key from k where child_index = 0)) as misses, cast(sum(l) as bigint) as truncated from u",
)
add("o18_refused_texts", lambda s, d: table(s, d, "documents").select("doc_id", evidence.refused(F.col("text")).alias("refused")), "select doc_id, coalesce(" + " or ".join([f"contains(lower(text), {sql.q(m)})" for m in evidence.FORBIDDEN_MARKERS] + [f"regexp_matches(text, {sql.q(p)})" for p in evidence.FORBIDDEN]) + ", false) as refused from documents")
