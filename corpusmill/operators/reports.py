"""Deterministic reports on documents (P12-P19): every document of a table at once.

documents: source_id, text (visible text), partial (boolean), url?, evidence? (array of evidence_id, source_id, quote,
start_char, end_char), json_ld? (array of strings), technical? (crawlable, status_code, load_time_ms).
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import classify, generators, ids, text
from corpusmill.session import held, materialize

BLANK = r"\s\x0b\x1c-\x1f\x85\p{Z}"
READINESS = ["headingHierarchy", "answerFirst", "faq", "schema", "factDensity", "eeat", "technicalCrawlabilityPerformance"]
#: What to do about a dimension. Fixed values.
FIXES = {
    "headingHierarchy": "Use one clear H1 and avoid skipped heading levels.",
    "answerFirst": "Lead with a direct, concise answer before background context.",
    "faq": "Add visible, content-supported question-and-answer pairs where useful.",
    "schema": "Add applicable JSON-LD that exactly matches visible content.",
    "factDensity": "Replace vague prose with verified specifics and attach exact evidence.",
    "eeat": "Add explicit authorship, source attribution, and first-hand evidence.",
    "technicalCrawlabilityPerformance": "Resolve crawl/status issues and improve measured load time.",
}
OPPORTUNITIES = {
    "topics": "Add clearly headed coverage of relevant competitor-covered topics.",
    "questions": "Answer relevant user questions explicitly in visible content.",
    "capabilities": "Explain concrete capabilities with supportable details.",
    "proof": "Add verifiable proof such as sourced results or case studies.",
    "pricing": "Clarify pricing or plan information when commercially appropriate.",
    "process": "Explain the process or workflow in explicit steps.",
    "callsToAction": "Provide a clear next action aligned with the page purpose.",
}
EVIDENCE = "array<struct<evidence_id:string,source_id:string,quote:string,start_char:int,end_char:int>>"
#: Signs of authorship, dates, sources and experience. Fixed values; blanks are those of Unicode.
TRUST = [rf"(?im)^(?:by|author:)[{BLANK}]+[^{BLANK}]+", r"\b(?:19|20)\d{2}\b", rf"(?im)^#{{1,6}}[{BLANK}]+(?:sources|references)\b", r"(?i)\b(?:we tested|our experience|case study)\b", r"(?i)\baccording to\b"]
TEMPLATES = ["what is {}", "{} alternatives", "{} pricing"]


def with_defaults(docs: DataFrame) -> DataFrame:
    for name, kind in (("evidence", EVIDENCE), ("json_ld", "array<string>"), ("technical", "struct<crawlable:boolean,status_code:int,load_time_ms:int>"), ("url", "string"), ("partial", "boolean")):
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    return docs.withColumn("partial", F.coalesce("partial", F.lit(False)))


def verified_evidence(strict: bool = False) -> Column:
    """O35, O36. A document's evidence whose quote stands in its text (normalised, or exactly when strict) and at its span."""

    def ok(e: Column) -> Column:
        span = e["start_char"].isNull() | e["end_char"].isNull() | (F.substring(F.col("text"), e["start_char"] + 1, e["end_char"] - e["start_char"]) == e["quote"])
        q = text.normalize(e["quote"])
        stands = F.col("text").contains(e["quote"]) if strict else q.rlike(r"[\p{L}\p{N}]") & (F.length(q) >= 12) & text.normalize("text").contains(q)
        return F.coalesce((e["source_id"] == F.col("source_id")) & stands & span, F.lit(False))

    return F.filter(F.coalesce("evidence", F.array().cast(EVIDENCE)), ok)


def claims(docs: DataFrame) -> DataFrame:
    """P13, J10. One row a sentence: section, position, text, whether specific, and ids of the evidence that supports it."""
    d = with_defaults(docs).withColumn("valid", verified_evidence())
    s = d.select("source_id", "valid", F.posexplode(generators.sections(F.col("text"))).alias("_n", "s"))
    c = s.select("source_id", "valid", F.col("_n").alias("section"), "s.section_id", "s.heading", F.posexplode_outer(text.sentences("s.text")).alias("n", "sentence"))
    own = text.query_form("sentence")
    supports = lambda e: own.contains(text.query_form(e["quote"])) | text.query_form(e["quote"]).contains(own)
    c = c.withColumn("specific", F.coalesce(text.is_specific("sentence"), F.lit(False))).withColumn("evidence_ids", F.transform(F.filter("valid", supports), lambda e: e["evidence_id"]))
    status = F.when(~F.col("specific"), "notFactual").when(F.size("evidence_ids") > 0, "supported").otherwise("unsupported")
    return c.withColumn("claim_id", F.concat("section_id", F.lit("-claim-"), F.col("n") + 1)).withColumn("status", status).drop("valid")


def fact_density(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A8. (sections, documents): scores of sections, and their mean weighted by sentences, rounded scores as they are."""
    c = claims(docs)
    has = F.col("sentence").isNotNull()
    by = c.groupBy("source_id", "section", "section_id", "heading").agg(F.count_if(has).alias("sentences"), F.count_if(has & F.col("specific")).alias("facts"), F.count_if(F.col("status") == "supported").alias("supported"))
    by = by.withColumn("score", F.when(F.col("sentences") > 0, F.round((F.col("facts") + F.col("supported")) / (2 * F.col("sentences")) * 100, 1)))
    whole = by.groupBy("source_id").agg(F.sum(F.coalesce("score", F.lit(0.0)).cast("decimal(10,1)") * F.col("sentences")).cast("double").alias("w"), F.sum("sentences").alias("n"))
    return by, whole.select("source_id", F.when(F.col("n") > 0, F.round(F.col("w") / F.col("n"), 1)).alias("score"))


def readiness_dimensions(docs: DataFrame) -> DataFrame:
    """P12. One row a document and dimension: score, null where the input cannot tell."""
    d = with_defaults(docs)
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^(#{1,6})\s+.+?\s*$"), F.lit(1))
    levels = F.transform(heads, lambda h: F.length(h))
    skips = F.size(F.filter(levels, lambda x, i: (i > 0) & (x > F.get(levels, i - 1) + 1)))
    heading = F.when((F.size(levels) == 0) & F.col("partial"), None).when(F.size(levels) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), 100.0 - F.when(F.array_contains(levels, 1), 0).otherwise(30) - 20 * skips))
    first = F.get(text.sentences(text.strip(F.regexp_replace("text", r"(?m)^#{1,6}\s+.+?\s*$", ""))), F.lit(0))
    words = F.size(F.split(text.strip(first), r"\s+"))
    late = first.rlike(r"(?i)^(in this (article|post)|welcome|have you ever)")
    answer = F.when(first.isNull(), F.when(F.col("partial"), None).otherwise(0.0)).when((words <= 35) & ~late, 100.0).when(words <= 60, 65.0).otherwise(30.0)
    pairs = F.size(generators.faq_pairs(F.col("text")))
    faq = F.when(pairs >= 3, 100.0).when(pairs > 0, 70.0).when(F.col("partial"), None).otherwise(0.0)
    good = lambda j: F.coalesce((F.get_json_object(j, "$['@context']") == "https://schema.org") & (F.length(F.get_json_object(j, "$['@type']")) > 0), F.lit(False))
    schema = F.when(F.col("json_ld").isNull(), None).when((F.size("json_ld") > 0) & F.forall("json_ld", good), 100.0).otherwise(0.0)
    signs = TRUST
    trust = F.when(F.col("partial"), None).otherwise(sum((F.col("text").rlike(p).cast("int") for p in signs), F.lit(0)) * 20.0)
    t = F.col("technical")
    technical = F.when(t["crawlable"].isNull() | t["status_code"].isNull() | t["load_time_ms"].isNull(), None).otherwise(F.when(t["crawlable"], 40.0).otherwise(0.0) + F.when(t["status_code"].between(200, 299), 30.0).otherwise(0.0) + F.when(t["load_time_ms"] <= 2500, 30.0).when(t["load_time_ms"] <= 4000, 15.0).otherwise(0.0))
    facts = fact_density(docs)[1].withColumnRenamed("score", "_facts")
    scored = d.join(facts, "source_id", "left").withColumn("_faq", faq)
    dims = dict(zip(READINESS, [heading, answer, F.col("_faq"), schema, F.col("_facts"), trust, technical], strict=True))
    rows = F.array(*[F.struct(F.lit(k).alias("dimension"), v.cast("double").alias("score")) for k, v in dims.items()])
    return scored.select("source_id", F.explode(rows).alias("r")).select("source_id", "r.*")


def readiness(docs: DataFrame) -> DataFrame:
    """P12, A7, R14. Overall score (null unless all seven are known) and fixes, worst dimension first."""
    dims = readiness_dimensions(docs)
    names = F.create_map(*[F.lit(x) for kv in FIXES.items() for x in kv])
    weak = F.array_sort(F.collect_list(F.when(F.col("score") < 80, F.struct("score", "dimension"))))
    return dims.groupBy("source_id").agg(F.when(F.count("score") == len(READINESS), F.round(F.avg("score"), 1)).alias("overall"), F.transform(weak, lambda x: names[x["dimension"]]).alias("fixes"))


def readiness_comparison(docs: DataFrame, subject: str) -> DataFrame:
    """P19, J14. By dimension: the subject's score, the best other and the delta, null when either is unknown; worst first."""
    dims = readiness_dimensions(docs)
    others = dims.where(F.col("source_id") != subject).groupBy("dimension").agg(F.max("score").alias("best"))
    out = dims.where(F.col("source_id") == subject).join(others, "dimension", "left").withColumn("delta", F.round(F.col("score") - F.col("best"), 1))
    return out.select("dimension", "score", "best", "delta").orderBy(F.coalesce("delta", F.lit(0.0)), "dimension")


def entities(docs: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """P14, A9. Entities of each document: key, name, type, aliases, mentions, confidence. seeds (name, canonical, type, ord):
    a name that several seeds claim goes to the last."""
    m = docs.select("source_id", F.explode(generators.entity_mentions(F.col("text"))).alias("m")).select("source_id", "m.*")
    if seeds is not None:
        last = held(seeds.groupBy(F.lower("name").alias("_k")).agg(F.max_by(F.struct("canonical", "type"), "ord").alias("c")))
        m = m.withColumn("_k", F.lower("value")).join(last, "_k", "left")
    else:
        m = m.withColumn("c", F.lit(None).cast("struct<canonical:string,type:string>"))
    m = m.withColumn("name", F.coalesce("c.canonical", "value")).withColumn("entity_key", F.lower("name"))
    by = m.groupBy("source_id", "entity_key").agg(F.min_by("name", "start").alias("name"), F.min_by(F.coalesce("c.type", F.lit("other")), "start").alias("type"), F.array_sort(F.collect_set("value")).alias("_v"), F.count("*").alias("mentions"))
    by = by.withColumn("aliases", F.filter("_v", lambda v: v != F.col("name"))).withColumn("confidence", F.round(F.least(F.lit(0.95), 0.55 + 0.1 * F.col("mentions")), 2))
    return by.select("source_id", ids.stable_id("entity", F.col("entity_key")).alias("entity_id"), "entity_key", "name", "type", "aliases", "mentions", "confidence")


def relationships(docs: DataFrame) -> DataFrame:
    """J13. Pairs of entities of a document with a mention start in one sentence, with the number of such sentences."""
    d = docs.select("source_id", generators.entity_mentions(F.col("text")).alias("m"), generators.sentences_with_offsets(F.col("text")).alias("s"))
    inside = lambda s: F.array_distinct(F.transform(F.filter("m", lambda m: (s["start"] <= m["start"]) & (m["start"] < s["end"])), lambda m: F.lower(m["value"])))
    keys = d.select("source_id", F.explode(F.transform("s", inside)).alias("k")).where("size(k) > 1")
    # entities of one sentence, a handful, paired in order
    pairs = keys.select("source_id", F.explode(F.flatten(F.transform("k", lambda a: F.transform(F.filter("k", lambda b: b > a), lambda b: F.struct(a.alias("left"), b.alias("right")))))).alias("p")).select("source_id", "p.*")
    out = pairs.groupBy("source_id", "left", "right").agg(F.count("*").alias("shared"))
    return out.withColumn("confidence", F.round(F.least(F.lit(0.9), 0.55 + 0.1 * F.col("shared")), 2))


def entity_coverage(docs: DataFrame, subject: str, other: str) -> DataFrame:
    """J11, U5. Entities of the other document with the state of the subject's coverage."""
    e = entities(docs)
    a = e.where(F.col("source_id") == subject).select("entity_key", F.col("name").alias("subject_name"))
    b = e.where(F.col("source_id") == other).select("entity_key", F.col("name").alias("other_name"))
    j = a.join(b, "entity_key", "full_outer").where("other_name is not null")
    return j.select("entity_key", F.coalesce("subject_name", "other_name").alias("name"), F.when(F.col("subject_name").isNull(), "missingOnSubject").otherwise("both").alias("status"))


def schema_nodes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """P15, F15-F18. Structured-markup nodes that a document's text supports, as JSON, with the check of what is visible."""
    d = with_defaults(docs)
    context = F.lit("https://schema.org").alias("@context")
    title = F.nullif(F.regexp_extract("text", r"(?m)^#\s+(.+?)\s*$", 1), F.lit(""))
    steps = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"(?m)^\s*\d+[.)]\s+(.+?)\s*$"), F.lit(1)), text.strip), lambda s: F.length(s) > 0)
    field = lambda key: text.strip(F.get(F.reverse(F.regexp_extract_all("text", F.lit(rf"(?im)^{key}:\s*(.+?)\s*$"), F.lit(1))), F.lit(0)))
    name, description = F.coalesce(field("product name"), field("name")), field("description")
    pairs = F.col("_pairs")
    nodes = F.array(
        F.when(title.isNotNull(), F.struct(F.lit("Article").alias("type"), F.to_json(F.struct(context, F.lit("Article").alias("@type"), title.alias("headline"), F.col("text").alias("articleBody"), F.col("url"))).alias("node"), F.array(title).alias("said"))),
        F.when(F.size(pairs) > 0, F.struct(F.lit("FAQPage").alias("type"), F.to_json(F.struct(context, F.lit("FAQPage").alias("@type"), F.transform(pairs, lambda p: F.struct(F.lit("Question").alias("@type"), p["question"].alias("name"), F.struct(F.lit("Answer").alias("@type"), p["answer"].alias("text")).alias("acceptedAnswer"))).alias("mainEntity"))).alias("node"), F.flatten(F.transform(pairs, lambda p: F.array(p["question"], p["answer"]))).alias("said"))),
        F.when(F.size(steps) > 0, F.struct(F.lit("HowTo").alias("type"), F.to_json(F.struct(context, F.lit("HowTo").alias("@type"), title.alias("name"), F.transform(steps, lambda x, i: F.struct(F.lit("HowToStep").alias("@type"), (i + 1).alias("position"), x.alias("text"))).alias("step"))).alias("node"), steps.alias("said"))),
        F.when(name.isNotNull() & description.isNotNull(), F.struct(F.lit("Product").alias("type"), F.to_json(F.struct(context, F.lit("Product").alias("@type"), name.alias("name"), description.alias("description"), field("sku").alias("sku"))).alias("node"), F.array(name, description).alias("said"))),
    )
    out = d.withColumn("_pairs", generators.faq_pairs(F.col("text"))).select("source_id", "text", F.explode(F.filter(nodes, lambda n: n.isNotNull())).alias("n"))
    body = text.normalize("text")
    return out.select("source_id", *keep, "n.type", "n.node", F.forall("n.said", lambda s: body.contains(text.normalize(s))).alias("visible"))


#: Fields a node of each type needs, and what is said of the checks. Fixed values.
REQUIRED = {"Article": ["headline", "articleBody"], "FAQPage": ["mainEntity"], "HowTo": ["name", "step"], "Product": ["name", "description"]}
CHECKS = {
    "jsonSyntax": ("Node is JSON serializable.", "Node is not valid JSON."),
    "schemaShape": ("Required deterministic shape is present.", "Required fields are missing."),
    "visibleContent": ("All generated content values occur in supplied visible content.", "At least one generated content value is not visible."),
}


def schema_checks(docs: DataFrame) -> DataFrame:
    """P15, F19. Three rows a node: source_id, type, code, valid, detail. A node is well-formed JSON, has its type's fields, and says
    nothing that does not stand in the text as it is."""

    @F.pandas_udf("array<string>")
    def strings(s: pd.Series) -> pd.Series:
        return s.map(lambda x: generators.content_strings(json.loads(x), frozenset(("@context", "@type", "url"))))

    n = schema_nodes(docs, ("text",)).withColumn("said", strings.asNondeterministic()("node"))
    has = lambda f: F.length(F.coalesce(F.get_json_object("node", f"$.{f}"), F.lit(""))) > F.when(F.get_json_object("node", f"$.{f}") == "[]", 2).otherwise(0)
    shape = F.lit(False)
    for kind, fields in REQUIRED.items():
        whole = F.col("type") == kind
        for f in fields:
            whole = whole & has(f)
        shape = shape | whole
    shape = shape & (F.get_json_object("node", "$['@context']") == "https://schema.org")
    found = {"jsonSyntax": F.lit(True), "schemaShape": F.coalesce(shape, F.lit(False)), "visibleContent": F.forall("said", lambda v: F.col("text").contains(v))}
    rows = F.array(*[F.struct(F.lit(code).alias("code"), ok.alias("valid"), F.when(ok, CHECKS[code][0]).otherwise(CHECKS[code][1]).alias("detail")) for code, ok in found.items()])
    return n.select("source_id", "type", F.explode(rows).alias("c")).select("source_id", "type", "c.*")


def query_plan(queries: DataFrame, topics: DataFrame, most: int = 200) -> DataFrame:
    """P16, O32, R13, A6. Given queries (query, origin) and hypotheses from topics (topic, ord) x three templates that are not
    asked already, at most `most`, classified and sorted by priority."""
    have = queries.select(text.query_form("query").alias("_k")).distinct()
    t = topics.where(F.length(text.strip(F.col("topic"))) > 0).groupBy(text.query_form("topic").alias("_t")).agg(F.min_by("topic", "ord").alias("topic"), F.min("ord").alias("ord"))
    made = t.select("ord", F.posexplode(F.array(*[F.replace(F.lit(p), F.lit("{}"), text.strip(F.col("topic"))) for p in TEMPLATES])).alias("_n", "query"))
    made = made.withColumn("_k", text.query_form("query")).join(have, "_k", "left_anti").groupBy("_k").agg(F.min(F.struct("ord", "_n", "query")).alias("r")).orderBy("r.ord", "r._n").limit(most)
    rows = queries.select("query", "origin").unionByName(made.select("r.query", F.lit("generatedHypothesis").alias("origin")))
    rows = rows.withColumn("query", text.collapse(text.strip(F.col("query")))).withColumn("c", classify.query_class("query")).withColumn("p", classify.query_signals("query", "origin")).withColumn("cluster_label", classify.cluster_label("query"))
    out = rows.select(ids.stable_id("query", F.col("origin"), F.lower("query")).alias("query_id"), "query", "origin", "c.intent", "c.stage", "c.rationale", ids.stable_id("cluster", F.col("cluster_label")).alias("cluster_id"), "cluster_label", F.col("p.score").alias("priority"), "p.tier")
    return out.orderBy(F.desc("priority"), F.lower("query"))


def findings(pages: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """P17. By page and dimension: present (null when the page is partial and nothing was found), signals, opportunity; and kept columns."""
    d = with_defaults(pages).withColumn("m", generators.dimension_matches(F.col("text")))
    names = F.array(*map(F.lit, generators.DIMENSIONS))
    rows = d.select("source_id", *keep, "partial", "m", F.explode(names).alias("dimension"))
    own = F.filter("m", lambda x: x["dimension"] == F.col("dimension"))
    rows = rows.withColumn("signals", F.array_distinct(F.transform(own, lambda x: x["quote"]))).withColumn("n", F.size(own))
    present = F.when(F.col("n") > 0, True).when(~F.col("partial"), False)
    advice = F.create_map(*[F.lit(x) for kv in OPPORTUNITIES.items() for x in kv])
    return rows.select("source_id", *keep, "partial", "dimension", present.alias("present"), "n", "signals", F.when(~present, advice[F.col("dimension")]).alias("opportunity"))


def content_gaps(pages: DataFrame) -> DataFrame:
    """P18, A17, J15. pages with role (subject or competitor): dimension gaps, then topics that only competitors have.

    Coverage is true, false, or unknown (null) when a partial page might have it; it is never filled in.
    """
    return _gaps(materialize(findings(pages, ("role",)), "findings"))


def _gaps(f: DataFrame) -> DataFrame:
    s = f.where("role = 'subject'").groupBy("dimension").agg(F.max(F.coalesce("present", F.lit(False))).alias("t"), F.max(F.col("partial")).alias("p"))
    s = s.select("dimension", F.when(F.col("t"), True).when(~F.col("p"), False).alias("coverage"))
    c = f.where("role = 'competitor'").groupBy("dimension").agg(F.count_if("present").alias("covering"), F.count("*").alias("total"))
    gaps = s.join(c, "dimension").where("covering > 0 and (coverage is null or not coverage)")
    unknown = F.col("coverage").isNull()
    gaps = gaps.select("dimension", F.lit(None).cast("string").alias("signal"), F.when(unknown, "coverageUnknown").otherwise("supportedGap").alias("status"), F.when(unknown, "unknown").when(F.col("covering") == F.col("total"), "high").otherwise("medium").alias("confidence"), F.col("covering").alias("n_sources"))
    topics = f.where("dimension = 'topics'").select("role", "source_id", "partial", F.explode("signals").alias("signal")).withColumn("k", text.signal_form("signal"))
    hidden = F.broadcast(f.where("role = 'subject'").agg(F.coalesce(F.max("partial"), F.lit(False)).alias("hidden")))
    only = topics.where("role = 'competitor'").join(topics.where("role = 'subject'").select("k"), "k", "left_anti")
    only = only.groupBy("k").agg(F.min_by("signal", F.struct("source_id", "signal")).alias("signal"), F.countDistinct("source_id").alias("n_sources")).crossJoin(hidden)  # one row
    return gaps.unionByName(only.select(F.lit("topics").alias("dimension"), "signal", F.when(F.col("hidden"), "coverageUnknown").otherwise("supportedGap").alias("status"), F.when(F.col("hidden"), "unknown").otherwise("medium").alias("confidence"), "n_sources"))


def gap_sources(pages: DataFrame) -> DataFrame:
    """P18. The competitor pages behind each gap, one row each: dimension, signal (null for the dimension itself), source_id."""
    f = materialize(findings(pages, ("role",)), "findings")
    gaps = materialize(_gaps(f).select("dimension", "signal"), "gaps")
    theirs = f.where("role = 'competitor' and present")
    whole = theirs.select("dimension", "source_id").join(held(gaps.where("signal is null").select("dimension")), "dimension", "left_semi").select("dimension", F.lit(None).cast("string").alias("signal"), "source_id")
    topics = theirs.where("dimension = 'topics'").select("source_id", F.explode("signals").alias("s")).withColumn("k", text.signal_form("s"))
    named = gaps.where("signal is not null").select("signal", text.signal_form("signal").alias("k"))
    return whole.unionByName(topics.join(named, "k").select(F.lit("topics").alias("dimension"), "signal", "source_id").distinct())


def audit_actions(pages: DataFrame) -> DataFrame:
    """P20, J16, R15. One action a gap (high for sure gaps, low for unknown ones), one a page opportunity; high first."""
    advice = F.create_map(*[F.lit(x) for kv in OPPORTUNITIES.items() for x in kv])
    f = materialize(findings(pages, ("role",)), "findings")
    g = _gaps(f)
    tier = F.when(F.col("status") == "coverageUnknown", "low").when(F.col("confidence") == "high", "high").otherwise("medium")
    a = g.select(ids.stable_id("action", F.col("dimension"), F.col("signal"), F.col("status")).alias("action_id"), tier.alias("tier"), "dimension", F.coalesce(advice[F.col("dimension")], F.lit("")).alias("action"), F.lit("gap").alias("origin"))
    b = f.where("opportunity is not null").select(ids.stable_id("opportunity", F.col("source_id"), F.col("dimension")).alias("action_id"), F.lit("medium").alias("tier"), "dimension", F.col("opportunity").alias("action"), F.lit("page").alias("origin"))
    order = F.when(F.col("tier") == "high", 0).when(F.col("tier") == "medium", 1).otherwise(2)
    return a.unionByName(b).orderBy(order, "action_id")


def attribute_map(pages: DataFrame) -> DataFrame:
    """P21 (the attribute part), J15. One row a page, dimension and signal; `only` marks signals no subject page has."""
    f = materialize(findings(pages, ("role",)).where("present"), "findings").select("role", "source_id", "dimension", F.explode("signals").alias("signal")).withColumn("k", text.signal_form("signal"))
    own = f.where("role = 'subject'").select("dimension", "k", F.lit(True).alias("_own")).distinct()
    return f.join(own, ["dimension", "k"], "left").select("role", "source_id", "dimension", "signal", ((F.col("role") != "subject") & F.col("_own").isNull()).alias("only"))


def level_transitions(docs: DataFrame) -> DataFrame:
    """R17 over headings kept as rows."""
    h = docs.select("source_id", F.posexplode(F.regexp_extract_all("text", F.lit(r"(?m)^(#{1,6})\s+.+?\s*$"), F.lit(1))).alias("n", "h"))
    w = Window.partitionBy("source_id").orderBy("n")
    return h.withColumn("level", F.length("h")).withColumn("before", F.lag(F.length("h")).over(w)).groupBy("source_id").agg(F.count("*").alias("headings"), F.count_if(F.col("level") > F.col("before") + 1).alias("skips"))
