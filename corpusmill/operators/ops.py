"""Reports and maintenance over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import classify, text

MOST_PAGES = 50_000


def page_counts(pages: DataFrame) -> DataFrame:
    """S2, A1."""
    return pages.groupBy("run_id").agg(F.count("*").alias("pages"))


def is_ready(run_ready_at: Column) -> Column:
    """O11."""
    return run_ready_at.isNotNull()


def schedulable(runs: DataFrame, pages: DataFrame, excluded: DataFrame, most: int = MOST_PAGES) -> DataFrame:
    """A3, A4, J2, J3, O12. One row: counts of runs without marker, without pages, over the cap and excluded, and the oldest
    ready run that is left, ties by id."""
    r = runs.select("run_id", "content_ready_at").join(page_counts(pages), "run_id", "left").join(excluded.select("run_id", F.lit(True).alias("out")).distinct(), "run_id", "left")
    n = F.coalesce("pages", F.lit(0))
    out = F.coalesce("out", F.lit(False))
    free = is_ready(F.col("content_ready_at")) & ~out & (n > 0) & (n <= most)
    return r.agg(
        F.count("*").alias("runs"),
        F.count_if(out).alias("excluded"),
        F.count_if(~out & F.col("content_ready_at").isNull()).alias("not_ready"),
        F.count_if(~out & F.col("content_ready_at").isNotNull() & (n == 0)).alias("no_pages"),
        F.count_if(~out & F.col("content_ready_at").isNotNull() & (n > most)).alias("over_cap"),
        F.min(F.when(free, F.struct("content_ready_at", "run_id")))["run_id"].alias("candidate"),
    )


def orphans(rows: DataFrame, runs: DataFrame, time: str, cutoff: Column | None = None) -> DataFrame:
    """J4, A15. Run ids of rows that no run has: rows, newest time, undated rows; those newer than the cutoff are left alone."""
    lost = rows.where(F.col("run_id").isNotNull()).join(runs.select("run_id").distinct(), "run_id", "left_anti")
    g = lost.groupBy("run_id").agg(F.count("*").alias("n"), F.max(time).alias("newest"), F.count_if(F.col(time).isNull()).alias("undated"))
    return g if cutoff is None else g.where(F.col("newest").isNull() | (F.col("newest") < cutoff))


def lost_enqueues(runs: DataFrame, jobs: DataFrame, now: Column, grace_seconds: int = 3600) -> DataFrame:
    """O21, J18. Runs ready since the grace period that have no job (never_enqueued) or only failed ones (failed_only)."""
    states = jobs.groupBy("run_id").agg(F.count_if(F.col("state") != "failed").alias("alive"), F.count("*").alias("jobs"))
    r = runs.select("run_id", "content_ready_at").where(F.col("content_ready_at").isNotNull() & (F.unix_timestamp("content_ready_at") + grace_seconds <= F.unix_timestamp(now))).join(states, "run_id", "left")
    return r.withColumn("reason", F.when(F.col("jobs").isNull(), "never_enqueued").when(F.col("alive") == 0, "failed_only")).where("reason is not null").select("run_id", "content_ready_at", "reason")


def job_class(state: Column, lease_until: Column, claimed_at: Column, now: Column, started_at: Column) -> Column:
    """O19, O20. What became of a run's job."""
    lapsed = lease_until.isNull() | (lease_until <= now)
    return (
        F.when(state.isNull(), "NEVER_QUEUED")
        .when(state == "complete", "COMPLETE")
        .when(state == "failed", "FAILED")
        .when(~lapsed & (claimed_at < started_at), "HELD_DEAD")
        .when(~lapsed, "QUEUED_LIVE")
        .otherwise("STRANDED")
    )


def host_report(points: DataFrame) -> DataFrame:
    """A11."""
    g = points.groupBy("host").agg(F.count("*").alias("points"), F.countDistinct("url").alias("pages"), F.sum(F.length(display_text())).alias("chars"))
    return g.withColumn("points_per_page", F.round(F.col("points") / F.col("pages"), 2))


def display_text() -> Column:
    """F44."""
    return F.when(F.col("chunk_role") == "parent", F.col("parent_text")).otherwise(F.col("child_text"))


def url_report(points: DataFrame) -> DataFrame:
    """A12."""
    return points.groupBy("url").agg(F.count("*").alias("chunks"), F.sum(F.length(display_text())).alias("chars"), F.min_by("page_title", "chunk_key").alias("title"))


def block_report(pages: DataFrame) -> DataFrame:
    """A13, S25. By run and in total (null run): pages, characters, empty pages, pages with tags, with link leaks, with escapes; rows and rows lost."""
    p = pages.withColumn("t", text.plain_text("blocks"))
    rows = F.filter(F.coalesce("blocks", F.array()), lambda b: b["kind"] == "row")
    p = p.withColumn("n_rows", F.size(rows)).withColumn("lost", F.size(F.filter(rows, lambda b: F.length(text.strip(text.render_block(b))) == 0)))
    return p.rollup("run_id").agg(
        F.grouping("run_id").cast("int").alias("is_total"), F.count("*").alias("pages"), F.sum(F.length("t")).alias("chars"), F.count_if(F.length(text.strip(F.col("t"))) == 0).alias("empty_pages"),
        F.count_if(F.col("t").rlike(text.INLINE_TAGS)).alias("with_tags"), F.count_if(F.col("t").rlike(r"https?://\S+")).alias("with_urls"), F.count_if(F.col("t").rlike(text.ESCAPED)).alias("with_escapes"),
        F.sum("n_rows").alias("table_rows"), F.sum("lost").alias("rows_lost"),
    )


def deletable(pages: DataFrame) -> DataFrame:
    """O17, U2, U3. Pages with the three delete predicates, whether any holds, and the complement (null-safe)."""
    failed = F.coalesce(F.length("failure_reason") > 0, F.lit(False))
    refused = F.coalesce(~classify.bool_of("robots_allowed"), F.lit(False))
    error = F.coalesce(classify.int_of("status_code"), F.lit(0)) >= 400
    return pages.select("page_id", "run_id", failed.alias("failed"), refused.alias("refused"), error.alias("error"), (failed | refused | error).alias("any"))


def cleanup_counts(pages: DataFrame) -> DataFrame:
    """A14. Pages by reason, their distinct union, and what is kept."""
    d = deletable(pages)
    return d.agg(F.count_if("failed").alias("failed"), F.count_if("refused").alias("refused"), F.count_if("error").alias("error"), F.count_if("any").alias("any_reason"), F.count_if(~F.col("any")).alias("kept"))


#: Serial numbers, versions and names with inner capitals, which a retrieval has to bind; and such words that are too common. Fixed values.
CODE = r"\b(?:[A-Z][A-Z0-9]{1,}-[A-Z0-9]{2,}(?:-[A-Z0-9]+)*|\d+\.\d+\.\d+|[A-Z][a-z]+[A-Z][a-zA-Z]{2,})\b"
NO_CODE = "HTTP-API B-2-B SOC-2 ISO-27001 JavaScript TypeScript PowerPoint SharePoint LinkedIn YouTube WordPress PayPal iPhone iPad eCommerce ePayments".split()


def gate_sample(points: DataFrame, most: int = 80, code: str = CODE) -> DataFrame:
    """P25. Questions for a retrieval gate: stratum, need, run_id, host, expect_literal, parent_child_ratio; at most half of `most` a stratum.

    literal: a term of five characters or more that stands in a passage, each term once, one a point (the point's entity
    first, if its text has it); wide_parent: the section title of a passage whose parent is at least twice as long. Points count by id, so that the
    same points give the same sample.
    """
    half = max(1, most // 2)
    p = points.where(F.col("run_id").isNotNull() & (F.length(F.trim("child_text")) > 0)).withColumn("child", F.trim("child_text")).withColumn("parent", F.trim(F.coalesce("parent_text", F.lit(""))))
    entity = F.trim(F.coalesce("entity_name", F.lit(""))) if "entity_name" in points.columns else F.lit("")
    own = F.when((F.length(entity) > 3) & F.lower("child").contains(F.lower(entity)), F.array(entity)).otherwise(F.array().cast("array<string>"))
    terms = F.filter(F.concat(own, F.regexp_extract_all("child", F.lit(f"({code})"), F.lit(1))), lambda t: (F.length(t) >= 5) & ~t.isin(NO_CODE))
    each = p.select("point_id", "run_id", "host", F.posexplode(terms).alias("n", "need"))
    # a term belongs to the first point that has it, a point asks for the first term that belongs to it
    first = each.groupBy("need").agg(F.min(F.struct("point_id", "n", "run_id", "host")).alias("f")).select("need", "f.*")
    literal = first.groupBy("point_id").agg(F.min(F.struct("n", "need", "run_id", "host")).alias("f")).orderBy("point_id").limit(half)
    literal = literal.select(F.lit("literal").alias("stratum"), "f.need", "f.run_id", "f.host", F.col("f.need").alias("expect_literal"), F.lit(None).cast("double").alias("parent_child_ratio"))
    title = F.trim(F.coalesce("section_title", F.lit("")))
    wide = p.where((F.length(title) > 0) & (F.length("parent") >= 2 * F.length("child"))).orderBy("point_id").limit(half)
    wide = wide.select(F.lit("wide_parent").alias("stratum"), title.alias("need"), "run_id", "host", F.lit(None).cast("string").alias("expect_literal"), F.round(F.length("parent") / F.length("child"), 2).alias("parent_child_ratio"))
    return literal.unionByName(wide)


def gate_results(asked: DataFrame, hits: DataFrame) -> DataFrame:
    """P25. asked (query_id, stratum, expect_literal) with the hits (query_id, position, text) of each question: stratum, rank of the first hit
    that has the literal, number returned, error."""
    has = F.lower("text").contains(F.lower("expect_literal"))
    j = asked.join(hits.select("query_id", "position", "text"), "query_id", "left")
    by = j.groupBy("query_id", "stratum").agg(F.min(F.when(has, F.col("position"))).alias("rank"), F.count("position").alias("returned"))
    return by.withColumn("error", F.lit(False))


def gate_summary(results: DataFrame) -> DataFrame:
    """A16. results (stratum, expected, rank?, error): by stratum asked, found, first, returned, errors."""
    return results.groupBy("stratum").agg(F.count("*").alias("asked"), F.count_if(F.col("rank").isNotNull()).alias("found"), F.count_if(F.col("rank") == 1).alias("first"), F.count_if(F.col("returned") > 0).alias("returned"), F.count_if("error").alias("errors"))


def gate_compare(before: DataFrame, after: DataFrame) -> DataFrame:
    """P25. Two summaries side by side; worse when fewer were found or ranked first."""
    b = before.select("stratum", F.col("found").alias("found_before"), F.col("first").alias("first_before"))
    j = after.join(b, "stratum", "full_outer")
    worse = (F.coalesce("found", F.lit(0)) < F.coalesce("found_before", F.lit(0))) | (F.coalesce("first", F.lit(0)) < F.coalesce("first_before", F.lit(0)))
    return j.select("stratum", "found_before", "found", "first_before", "first", worse.alias("worse"))


def purge_except(runs: DataFrame, keep: DataFrame, jobs: DataFrame | None = None) -> DataFrame:
    """U6, P27. The runs to purge. Raises when a run to keep is unknown or a doomed run has a live job."""
    missing = keep.select("run_id").join(runs, "run_id", "left_anti")
    if not missing.isEmpty():
        raise ValueError("a run to keep does not exist")
    doomed = runs.join(keep.select("run_id"), "run_id", "left_anti").select("run_id").distinct()
    if jobs is not None and not jobs.where("live").join(doomed, "run_id", "left_semi").isEmpty():
        raise ValueError("a doomed run has a live job")
    return doomed


def missing_postings(points: DataFrame, postings: DataFrame) -> DataFrame:
    """P26. Points without term weights and the text to make them from: text, else child, else parent."""
    t = F.coalesce(*[F.when(F.length(c) > 0, F.col(c)) for c in ("embed_text", "child_text", "parent_text")], F.lit(""))
    return points.join(postings.select("point_id").distinct(), "point_id", "left_anti").select("point_id", t.alias("text"))


def field_audit(df: DataFrame) -> DataFrame:
    """P28. By column: rows with a value, null, and empty or blank."""
    cols = [f.name for f in df.schema.fields]
    value = lambda c: F.length(F.trim(F.col(c).cast("string"))) if df.schema[c].dataType.simpleString() == "string" else F.size(F.col(c)) if df.schema[c].dataType.simpleString().startswith("array") else F.lit(1)
    one = df.agg(*[F.struct(F.lit(c).alias("field"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_if(F.col(c).isNotNull() & (value(c) <= 0)).alias("blank"), F.count_if(F.col(c).isNotNull() & (value(c) > 0)).alias("present")).alias(c) for c in cols])
    return one.select(F.explode(F.array(*cols)).alias("r")).select("r.*")


def block_kinds(pages: DataFrame) -> DataFrame:
    """P28. Block kinds with their counts."""
    return pages.select(F.explode("blocks").alias("b")).groupBy(F.col("b.kind").alias("kind")).agg(F.count("*").alias("n"))


def contract_diff(sender: DataFrame, receiver: DataFrame) -> DataFrame:
    """P29. (field, type) of two contracts: missing, extra or of another type. Raises when a side names a field twice."""
    for side in (sender, receiver):
        if not side.groupBy("field").count().where("count > 1").isEmpty():
            raise ValueError("a field is named twice")
    j = sender.select("field", F.col("type").alias("sent")).join(receiver.select("field", F.col("type").alias("expected")), "field", "full_outer")
    verdict = F.when(F.col("sent").isNull(), "missing").when(F.col("expected").isNull(), "extra").when(F.col("sent") != F.col("expected"), "type")
    return j.withColumn("verdict", verdict).where("verdict is not null")


def level_skips(headings: DataFrame, doc: str, position: str, level: str) -> DataFrame:
    """R17. By document: headings, and neighbours whose level goes up by more than one."""
    before = F.lag(level).over(Window.partitionBy(doc).orderBy(position))
    return headings.withColumn("_b", before).groupBy(doc).agg(F.count("*").alias("headings"), F.count_if(F.col(level) > F.col("_b") + 1).alias("skips"))
