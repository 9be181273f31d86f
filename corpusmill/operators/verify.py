"""Quotes and page texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import text, urls
from corpusmill.operators.index import classified

SHORTEST = 12


def citable(pages: DataFrame) -> DataFrame:
    """O13. Pages with `plain` and `refusal`: null when the text may be cited."""
    c = classified(pages).withColumn("plain", text.plain_text("blocks"))
    refusal = F.when(F.col("reason").isNotNull() & (F.col("reason") != "no_content"), F.concat(F.lit("page_not_citable:"), "reason")).when(F.length(text.strip(F.col("plain"))) == 0, "page_not_found")
    return c.withColumn("refusal", refusal)


def quote_found(quote: Column, plain: Column, blocks: Column) -> Column:
    """P5. The cleaned quote stands in the page's text (runs of empty cells as one bar); one of fewer than 12 characters
    has to be a whole cell of a row."""
    q = text.normalize(text.clean_prose(quote))
    body = text.normalize(F.regexp_replace(plain, rf"\|([{text.BLANK}]*\|)+", "|"))
    cells = F.flatten(F.transform(F.filter(F.coalesce(blocks, F.array()), lambda b: b["kind"] == "row"), lambda b: F.coalesce(b["cells"], F.array())))
    cell = F.exists(cells, lambda c: F.coalesce((F.length(c) > 0) & (text.normalize(c) == q), F.lit(False)))
    return F.when(~q.rlike(r"[\p{L}\p{N}]"), False).when(F.length(q) >= SHORTEST, body.contains(q)).otherwise(cell)


def verify_quotes(quotes: DataFrame, pages: DataFrame) -> DataFrame:
    """P5, J9. quotes (quote_id, page_id, quote): found, reason, digest of the page's text. Each page is read once."""
    wanted = quotes.select("page_id").distinct()
    p = citable(pages.join(wanted, "page_id", "left_semi")).select("page_id", "plain", "blocks", "refusal", F.lit(True).alias("there"))
    j = quotes.join(p, "page_id", "left")
    reason = F.when(F.col("there").isNull(), "page_not_found").otherwise(F.col("refusal"))
    found = F.when(reason.isNull(), quote_found(F.col("quote"), F.col("plain"), F.col("blocks"))).otherwise(False)
    j = j.withColumn("reason", reason).withColumn("found", found)
    return j.select("quote_id", "page_id", "found", F.when(F.col("reason").isNull() & ~F.col("found"), "quote_not_found").otherwise(F.col("reason")).alias("reason"), F.when(F.col("reason").isNull(), F.sha2("plain", 256)).alias("digest"))


def page_text(pages: DataFrame, page_id: str | None = None, run_id: str | None = None, url: str | None = None) -> DataFrame:
    """P6, S4. Text and refusal of one page, by id or by run and exact url or final url."""
    if page_id is not None:
        pages = pages.where(F.col("page_id") == page_id)
    if run_id is not None:
        pages = pages.where(F.col("run_id") == run_id)
    if url is not None:
        pages = pages.where((F.col("url") == url) | (F.col("final_url") == url))
    c = citable(pages)
    return c.select("page_id", "run_id", "url", text.page_title("title", "blocks").alias("title"), F.when(F.col("refusal").isNull(), F.col("plain")).alias("text"), "refusal")


def host_lookup(addresses: DataFrame, points: DataFrame) -> DataFrame:
    """P7, S16, S17. addresses (address, crawl_type?): the first host candidate that is indexed, its crawl types, and for an
    untyped address with several types a refusal."""
    asked = addresses.select("address", "crawl_type", F.posexplode(urls.host_candidates("address")).alias("n", "host"))
    there = points.select("host", F.col("crawl_type").alias("type")).distinct()
    hit = asked.join(there, "host").where(F.col("crawl_type").isNull() | (F.col("crawl_type") == F.col("type")))
    by = hit.groupBy("address", "crawl_type", "n", "host").agg(F.array_sort(F.collect_set("type")).alias("types"))  # the few crawl types of a host
    first = by.groupBy("address", "crawl_type").agg(F.min_by(F.struct("host", "types"), "n").alias("r")).select(F.col("address").alias("_a"), F.col("crawl_type").alias("_t"), "r.*")
    out = addresses.select("address", "crawl_type").join(first, (F.col("address") == F.col("_a")) & F.col("crawl_type").eqNullSafe(F.col("_t")), "left").drop("_a", "_t")
    reason = F.when(F.col("host").isNull(), "not_indexed").when(F.col("crawl_type").isNull() & (F.size("types") > 1), "ambiguous_crawl_type")
    return out.withColumn("reason", reason)
