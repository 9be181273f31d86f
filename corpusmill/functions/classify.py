"""Classification of pages, passages and queries as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusmill.functions.text import _c, collapse, strip
from corpusmill.functions.urls import bare_host, is_locale_path, is_sitemap, path


def int_of(x: Column | str) -> Column:
    """O15. A number stored as text, float or int; fractions truncated; null when unreadable."""
    return strip(_c(x).cast("string")).try_cast("double").try_cast("int")


def bool_of(x: Column | str) -> Column:
    """O16. A truth value stored as text or number; null when blank or anything else."""
    t = F.lower(strip(_c(x).cast("string")))
    return F.when(t.isin("t", "true", "1", "y", "yes"), True).when(t.isin("f", "false", "0", "n", "no"), False).otherwise(F.when(t.try_cast("double").isNotNull(), t.try_cast("double") != 0))


def unusable_reason(url: Column | str, final_url: Column | str, status: Column, robots: Column, failure: Column | str, blocks: Column | str) -> Column:
    """O1. Why a page cannot be used, the first that holds; null when it can. status and robots are decoded values."""
    page_url = F.coalesce(F.nullif(_c(final_url), F.lit("")), _c(url))
    return (
        F.when(is_locale_path(page_url) | is_locale_path(url), "locale")
        .when(status >= 400, "http_error")
        .when(is_sitemap(page_url) | is_sitemap(url), "sitemap")
        .when(~robots, "failure")
        .when(F.length(strip(_c(failure))) > 0, "failure")
        .when(F.coalesce(F.size(_c(blocks)), F.lit(0)) <= 0, "no_content")
    )


#: Category by the first needle found in the path and the first 500 characters; intent of each category. Fixed values.
CATEGORIES = [
    ("pricing", ["/pricing", "pricing", "plans and pricing"]),
    ("docs", ["/docs", "/documentation", "/api/", "api reference"]),
    ("blog", ["/blog", "/news", "/articles", "/resources"]),
    ("product", ["/product", "/features", "/platform"]),
    ("about", ["/about", "/company", "/team"]),
    ("careers", ["/careers", "/jobs"]),
    ("legal", ["/privacy", "/terms", "/legal"]),
    ("compare", ["/compare", "/vs-", "versus", "alternative"]),
]
INTENTS = {"blog": "thought-leadership", "docs": "technical-reference", "pricing": "commercial", "product": "product-marketing", "compare": "competitive", "about": "company", "careers": "company", "legal": "legal"}
#: Kinds of passages of other companies' pages: (kind, category that decides, needles). Fixed values.
PASSAGE_KINDS = [
    ("pricing", "pricing", ["/pricing", "pricing", "plans and pricing", "per seat", "$/"]),
    ("comparison", "compare", ["/compare", "/vs-", "versus", "alternative", "unlike ", "compared to"]),
    ("proof", None, ["soc 2", "iso 27001", "g2 ", "case study", "customers", "testimonial", "award", "% faster"]),
    ("gap", None, ["faq", "frequently asked", "missing", "not available", "does not support", "limitation"]),
]
YEARS = ["2020", "2021", "2022", "2023", "2024", "2025", "2026"]


def _any(blob: Column, needles: list[str]) -> Column:
    out = blob.contains(needles[0])
    for n in needles[1:]:
        out = out | blob.contains(n)
    return out


def _text(x: Column | str, n: int) -> Column:
    return F.lower(F.substring(F.coalesce(_c(x), F.lit("")), 1, n))


def category(url: Column | str, text: Column | str) -> Column:
    """F27."""
    p = path(url)
    blob = F.concat(F.lower(F.when(F.length(p) > 0, p).otherwise("/")), F.lit(" "), _text(text, 500))
    out = F.when(_any(blob, CATEGORIES[0][1]), CATEGORIES[0][0])
    for name, needles in CATEGORIES[1:]:
        out = out.when(_any(blob, needles), name)
    return out.otherwise("page")


def content_intent(cat: Column | str) -> Column:
    """F28. Intent of a category."""
    out = None
    for k, v in INTENTS.items():
        out = F.when(_c(cat) == k, v) if out is None else out.when(_c(cat) == k, v)
    return out.otherwise("general")


def passage_kind(url: Column | str, section_title: Column | str, text: Column | str, cat: Column | str) -> Column:
    """F29. `feature` is also what is left."""
    blob = F.concat_ws(" ", F.lower(path(url)), F.lower(F.coalesce(_c(section_title), F.lit(""))), _text(text, 800))
    out = None
    for kind, decides, needles in PASSAGE_KINDS:
        hit = _any(blob, needles) if decides is None else (_c(cat) == decides) | _any(blob, needles)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("feature")


def feature_tag(section_title: Column | str, tags: Column | str) -> Column:
    """F30."""
    cleaned = strip(F.regexp_replace(strip(_c(section_title)), r"[^a-zA-Z0-9 \-_]+", ""))
    tag = F.get(F.filter(_c(tags), lambda t: (F.length(t) > 0) & ~t.isin("pricing", "docs", "blog", "about")), F.lit(0))
    return F.substring(F.when(F.length(cleaned) > 0, cleaned).otherwise(tag), 1, 80)


def source_rights(host: Column | str, existing: Column | str, consented: list[str]) -> Column:
    """F31."""
    v = F.lower(strip(_c(existing)))
    listed = F.array(*[bare_host(F.lit(h)) for h in consented if h.strip()]) if consented else F.array().cast("array<string>")
    return F.when(v.isin("consented", "licensed", "unknown", "prohibited"), v).when((F.length(bare_host(host)) > 0) & F.array_contains(listed, bare_host(host)), "consented").otherwise("unknown")


def quality(text: Column | str, title: Column | str, has_blocks: Column) -> Column:
    """F32. 0 to 1 from length, title and blocks."""
    n = F.length(strip(F.coalesce(_c(text), F.lit(""))))
    points = F.lit(35) + F.when(F.length(_c(title)) > 0, 15).otherwise(0) + F.when(has_blocks, 15).otherwise(0) + F.when(n >= 500, 15).otherwise(0) + F.when(n >= 2000, 10).otherwise(0) + F.when(n >= 5000, 10).otherwise(0) - F.when(n < 200, 20).otherwise(0)
    return F.least(F.greatest(points, F.lit(0)), F.lit(100)) / 100


def is_evergreen(url: Column | str, text: Column | str) -> Column:
    """F33."""
    blob = F.lower(F.concat(F.coalesce(_c(url), F.lit("")), F.lit(" "), F.substring(F.coalesce(_c(text), F.lit("")), 1, 800)))
    return ~_any(blob, [*YEARS, "/news/", "press release"]) & category(url, text).isin("docs", "product", "pricing", "about", "page")


#: Intent and stage of a query by the first pattern that matches. Fixed values.
QUERY_CLASSES = [
    (r"\b(?:login|sign in|support|documentation|docs)\b", "navigational", "retention", "Navigational/support marker matched."),
    (r"\b(?:buy|price|pricing|trial|demo|coupon|subscribe)\b", "transactional", "decision", "Purchase or conversion marker matched."),
    (r"\b(?:best|versus|vs|alternative|compare|review)\b", "commercial", "consideration", "Comparison or evaluation marker matched."),
]
OTHER_QUERY = ("informational", "awareness", "No navigation, conversion, or comparison marker matched.")
ORIGIN_POINTS = {"observed": 40, "imported": 25, "generatedHypothesis": 5}
INTENT_POINTS = {"informational": 10, "commercial": 20, "transactional": 25, "navigational": 15}
STAGE_POINTS = {"awareness": 5, "consideration": 10, "decision": 15, "retention": 10}
CLUSTER_STOP = "a an and best buy for guide how is pricing the to use what why alternatives".split()


def query_class(query: Column | str) -> Column:
    """F34. Struct of intent, stage and rationale."""
    v = F.lower(_c(query))
    as_struct = lambda i, s, r: F.struct(F.lit(i).alias("intent"), F.lit(s).alias("stage"), F.lit(r).alias("rationale"))
    out = None
    for pattern, *rest in QUERY_CLASSES:
        out = F.when(v.rlike(pattern), as_struct(*rest)) if out is None else out.when(v.rlike(pattern), as_struct(*rest))
    return out.otherwise(as_struct(*OTHER_QUERY))


def _points(x: Column, table: dict[str, int]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(x == k, v) if out is None else out.when(x == k, v)
    return out


def query_signals(query: Column | str, origin: Column | str) -> Column:
    """F35. Struct of the four points, their sum and the tier."""
    cls = query_class(query)
    words = F.size(F.regexp_extract_all(F.lower(_c(query)), F.lit("([a-z0-9]+)"), F.lit(1)))
    parts = [_points(_c(origin), ORIGIN_POINTS), _points(cls["intent"], INTENT_POINTS), F.when(words >= 5, 20).when(words >= 3, 10).otherwise(5), _points(cls["stage"], STAGE_POINTS)]
    total = parts[0] + parts[1] + parts[2] + parts[3]
    tier = F.when(total >= 70, "high").when(total >= 45, "medium").otherwise("low")
    return F.struct(parts[0].alias("provenance"), parts[1].alias("intent"), parts[2].alias("specificity"), parts[3].alias("stage"), total.alias("score"), tier.alias("tier"))


def cluster_label(query: Column | str) -> Column:
    """F36."""
    words = F.filter(F.regexp_extract_all(F.lower(collapse(strip(_c(query)))), F.lit("([a-z0-9]+)"), F.lit(1)), lambda w: ~w.isin(CLUSTER_STOP))
    label = F.array_join(F.slice(words, 1, 3), " ")
    return F.when(F.length(label) > 0, label).otherwise("general")
