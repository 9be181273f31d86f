"""What reports rest on: evidence spans, summaries, warnings and provenance (O34, F50, F52, F53), and run bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import generators, ids
from corpusmill.operators.reports import verified_evidence, with_defaults

#: Characters an evidence quote has at least.
SHORTEST = 12

#: Texts of reports. Fixed values.
HEURISTIC = "Scores and classifications are deterministic heuristics, not measured search-engine or AI-citation outcomes."
PARTIAL = "Input is marked partial; absence-based findings are omitted where completeness is required."
DIGEST = "Declared sourceDigest does not match normalized visible content; computed content was analyzed without replacing provenance."
FOUND = "Found {n} supplied-content signal(s) for {dimension}."
UNKNOWN = "No {dimension} signal occurred in the partial supplied content; full-page coverage is unknown."
ABSENT = "No {dimension} signal occurred in the complete supplied content."
COMPARED = "Subject {dimension} coverage is {state}; {covering} of {total} supplied competitor page(s) contain matching signals."
BOTH_UNKNOWN = "Subject and competitor {dimension} scores are unknown from supplied input."
SUBJECT_UNKNOWN = "Subject {dimension} score is unknown; best supplied competitor score is {best}."
BEST_UNKNOWN = "Subject {dimension} score is {score}; no competitor score was available for comparison."
DELTA = "Subject {dimension} score {score} is {relation} best competitor score {best} (delta {delta})."

#: What a text may not ask for that runs on its own. Fixed values.
FORBIDDEN = [
    r"(?i)\b(?:curl|wget|pip|npm|pnpm|yarn)\b",
    r"(?i)\b(?:subprocess|os\.system|eval|exec|spawn|shell)\b",
    r"(?i)(?:https?|file)://",
    r"(?i)\b(?:environment variable|api[_ -]?key|secret|credential)\b",
    r"(?i)(?:ignore|override|disregard).{0,40}(?:instruction|policy|authority)",
]
#: Hosted parsers a text may not name, in any case. Fixed values.
FORBIDDEN_MARKERS = ["llamaparse", "llamacloud", "llama_cloud_api_key", "@llamaindex/cloud"]

#: Counters of a job's status row, its texts and its times.
COUNTERS = ["pages_seen", "pages_english", "pages_skipped_lang", "pages_skipped_empty", "pages_skipped_unusable", "chunks_upserted", "chunks_skipped_repeat", "chunks_skipped_stub", "attempt", "embedding_rate_limit_retries"]


def _said(template: str, **values: Column) -> Column:
    """A fixed text with its places filled in."""
    parts, rest = [], template
    while "{" in rest:
        before, _, rest = rest.partition("{")
        name, _, rest = rest.partition("}")
        parts += [F.lit(before), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


def widened(text: Column, start: Column, end: Column, on_both_sides: bool = False) -> Column:
    """O34. Struct (start_char, end_char, quote) of a span of at least SHORTEST characters where the text has them: a shorter one
    gets what it lacks on its left and then on its right, or six characters on both sides."""
    lacks = F.lit(SHORTEST) - (end - start)
    first = F.when(lacks > 0, F.greatest(F.lit(0), start - (F.lit(6) if on_both_sides else lacks))).otherwise(start)
    last = F.when(lacks > 0, F.least(F.length(text), F.greatest(end + 6 if on_both_sides else end, first + SHORTEST))).otherwise(end)
    return F.struct(first.cast("int").alias("start_char"), last.cast("int").alias("end_char"), F.substring(text, first.cast("int") + 1, (last - first).cast("int")).alias("quote"))


def finding_evidence(pages: DataFrame) -> DataFrame:
    """P17, O34. One row a signal of a page: source_id, dimension, evidence_id and its widened span."""
    m = pages.select("source_id", "text", F.explode(generators.dimension_matches(F.col("text"))).alias("m"))
    m = m.select("source_id", F.col("m.dimension").alias("dimension"), widened(F.col("text"), F.col("m.start"), F.col("m.end"), True).alias("e")).select("source_id", "dimension", "e.*")
    return m.withColumn("evidence_id", ids.stable_id(F.col("source_id"), F.col("start_char"), F.col("end_char"), F.col("quote")))


def sentence_evidence(docs: DataFrame, ident: str = "source_id") -> DataFrame:
    """O34 over the sentences of a document: ident, n, evidence_id and span, widened to the left first."""
    s = docs.select(F.col(ident), "text", F.posexplode(generators.sentences_with_offsets(F.col("text"))).alias("n", "s"))
    s = s.select(ident, "n", widened(F.col("text"), F.col("s.start"), F.col("s.end")).alias("e")).select(ident, "n", "e.*")
    return s.withColumn("evidence_id", ids.stable_id(F.col(ident), F.col("start_char"), F.col("end_char"), F.col("quote")))


def warnings(docs: DataFrame) -> DataFrame:
    """F52. (source_id, warnings): that scores are heuristics, that the input is partial, that a declared digest is wrong."""
    d = with_defaults(docs)
    digest = F.col("source_digest") if "source_digest" in d.columns else F.lit(None).cast("string")
    all_of = F.array(F.lit(HEURISTIC), F.when(F.col("partial"), F.lit(PARTIAL)), F.when((F.length(digest) > 0) & (digest != F.sha2("text", 256)), F.lit(DIGEST)))
    return d.select("source_id", F.filter(all_of, lambda w: w.isNotNull()).alias("warnings"))


def provenance(docs: DataFrame) -> DataFrame:
    """F53. (source_id, url, evidence_ids): the verified evidence of a document, in its order."""
    return with_defaults(docs).select("source_id", "url", F.transform(verified_evidence(), lambda e: e["evidence_id"]).alias("evidence_ids"))


def finding_summary(dimension: Column, present: Column, n: Column) -> Column:
    """F50."""
    return F.when(present, _said(FOUND, n=n, dimension=dimension)).when(present.isNull(), _said(UNKNOWN, dimension=dimension)).otherwise(_said(ABSENT, dimension=dimension))


def comparison_summary(dimension: Column, coverage: Column, covering: Column, total: Column) -> Column:
    state = F.when(coverage, "present").when(~coverage, "absent").otherwise("unknown")
    return _said(COMPARED, dimension=dimension, state=state, covering=covering, total=total)


def delta_summary(dimension: Column, score: Column, best: Column, delta: Column) -> Column:
    relation = F.when(delta > 0, "ahead of").when(delta < 0, "behind").otherwise("tied with")
    whole = F.when(score.isNull() & best.isNull(), _said(BOTH_UNKNOWN, dimension=dimension)).when(score.isNull(), _said(SUBJECT_UNKNOWN, dimension=dimension, best=best))
    return whole.when(best.isNull(), _said(BEST_UNKNOWN, dimension=dimension, score=score)).otherwise(_said(DELTA, dimension=dimension, score=score, relation=relation, best=best, delta=delta))


def delete_page(pages: DataFrame, links: DataFrame, page_id: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """S7. (pages, links, removed): both without the page, and one row with the number of links that went. A blank id removes nothing."""
    hit = F.coalesce((F.col("page_id") == page_id) & F.lit(bool(page_id)), F.lit(False))
    return pages.where(~hit), links.where(~hit), links.where(hit).agg(F.count("*").alias("links_removed"))


def ready_at(x: Column) -> Column:
    """F43. An instant written with a blank or T, and with +00, Z, an offset or none (UTC); null where it cannot be read."""
    t = F.regexp_replace(F.replace(F.trim(x), F.lit(" "), F.lit("T")), r"(\+00|Z)$", "+00:00")
    whole = F.when(t.rlike(r"^\d{4}-\d\d-\d\d(?:T\d\d(?::\d\d(?::\d\d(?:[.,]\d{1,6})?)?)?(?:[+-]\d\d:\d\d)?)?$"), F.when(t.rlike(r"T.*[+-]\d\d:\d\d$"), t).otherwise(F.concat(F.when(t.contains("T"), t).otherwise(F.concat(t, F.lit("T00:00:00"))), F.lit("+00:00"))))
    full = F.regexp_replace(F.regexp_replace(F.replace(whole, F.lit(","), F.lit(".")), r"T(\d\d)([+-])", r"T$1:00$2"), r"T(\d\d:\d\d)([+-])", r"T$1:00$2")
    return F.try_to_timestamp(full)


def status_rows(rows: DataFrame) -> DataFrame:
    """F42. Job status rows with their defaults: no counter is null, a missing state is failed, a missing trigger manual."""
    have = set(rows.columns)
    col = lambda c, kind: F.col(c).cast(kind) if c in have else F.lit(None).cast(kind)
    filled = {c: F.coalesce(col(c, "long"), F.lit(0)) for c in COUNTERS}
    filled |= {"run_id": F.coalesce(col("run_id", "string"), F.lit("")), "state": F.coalesce(F.nullif(col("state", "string"), F.lit("")), F.lit("failed")), "trigger": F.coalesce(F.nullif(col("trigger", "string"), F.lit("")), F.lit("manual"))}
    return rows.withColumns(filled | {"embedding_wait_seconds": F.coalesce(col("embedding_wait_seconds", "double"), F.lit(0.0))})


def trigger_order(runs: DataFrame) -> DataFrame:
    """R19. Runs that wait for their index, by the text of their ready mark and their id; a report, sorted as a whole."""
    waiting = runs.where("content_ready_at is not null and rag_indexed_at is null").select("run_id", F.col("content_ready_at").cast("string").alias("ready")).distinct()
    return waiting.orderBy("ready", "run_id")


def embedding_stats(texts: DataFrame, cache: DataFrame, limit: int, tokens: Column, key: str = "key") -> DataFrame:
    """A19. One row: texts, different ones, those the cache has and lacks, and inputs longer than the model's limit."""
    have = cache.select(key).distinct().withColumn("_hit", F.lit(1))
    asked = texts.withColumn("_long", (tokens > limit).cast("long")).groupBy(key).agg(F.count("*").alias("_n"), F.sum("_long").alias("_long"))
    j = asked.join(have, key, "left")
    return j.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("texts"), F.count("*").alias("different"), F.count("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"), F.coalesce(F.sum("_long"), F.lit(0)).alias("truncated"))


def refused(text: Column) -> Column:
    """O18. Whether a text asks for something it has no authority for."""
    low = F.lower(text)
    asks = [low.contains(m) for m in FORBIDDEN_MARKERS] + [text.rlike(p) for p in FORBIDDEN]
    out = asks[0]
    for a in asks[1:]:
        out = out | a
    return F.coalesce(out, F.lit(False))
