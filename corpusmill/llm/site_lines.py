"""Problem 3: lines that recur across the documents of one source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import held, materialize

#: Rows of a set that may be broadcast: two longs each, some 20 MB as a hashed relation.
BROADCAST_ROWS = 400_000
#: Pages whose lines to drop may be broadcast.
DROP_PAGES = 20_000


def line_key(line: Column) -> Column:
    """Lower-cased letters of a line, hashed to 64 bits; null when it has no letter."""
    letters = F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")
    return F.when(F.length(letters) > 0, F.xxhash64(letters))


def page_lines(pages: DataFrame, page_id: str, source: Column, blocks: str) -> DataFrame:
    """(page_id, src, block_pos, line_no, h): the lines of the blocks of each page; code and textless blocks have none."""
    b = pages.select(F.col(page_id).alias("page_id"), F.xxhash64(source).alias("src"), F.posexplode(F.transform(F.col(blocks), lambda x: F.when(~F.coalesce(x["kind"] == "code", F.lit(False)), x["text"]))).alias("block_pos", "t"))
    lines = b.where("page_id is not null and src is not null and t is not null").select("page_id", "src", "block_pos", F.posexplode(F.split("t", "\n", -1)).alias("line_no", "line"))
    return lines.select("page_id", "src", "block_pos", "line_no", line_key(F.col("line")).alias("h")).where("h is not null")


def repeated_lines(pages: DataFrame, page_id: str, source: Column, blocks: str, least_pages: int = 5, width: int = 1 << 16) -> DataFrame:
    """Every occurrence (page_id, block_pos, line_no) of a line that stands on least_pages distinct pages of its source.

    The lines are hashed once and written; the passes read that table. First pass: a count-min summary per source, `width` counters each, built by a partial sum in every task and merged
    by adding. It never counts a line too low, so a counter below least_pages rules its lines out. Second pass: exact
    distinct page counts of the lines that remain. A source so large that every counter fills up has all its lines
    counted exactly; none is lost. Both passes sum before they shuffle, so a source with a third of all pages
    costs its tasks no more than the summary's width. Pages delivered twice (same page_id) count once. Pages without
    id or source, null blocks and empty tables give no rows; other columns are not touched.
    """
    lines = materialize(page_lines(pages, page_id, source, blocks), "lines")
    cell = F.pmod("h", F.lit(width)).cast("int")
    summary = lines.select("src", cell.alias("cell")).groupBy("src", "cell").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages).select("src", "cell")
    likely = lines.withColumn("cell", cell).join(held(materialize(summary, "linesummary"), BROADCAST_ROWS), ["src", "cell"], "left_semi")
    counted = likely.select("src", "h", "page_id").distinct().groupBy("src", "h").agg(F.count("*").alias("n"))
    sure = materialize(counted.where(F.col("n") >= least_pages).select("src", "h"), "linesure")
    return lines.join(held(sure, BROADCAST_ROWS), ["src", "h"], "left_semi").select("page_id", "block_pos", "line_no").distinct()


def remove_repeated_lines(pages: DataFrame, page_id: str, source: Column, blocks: str, least_pages: int = 5) -> DataFrame:
    """pages with the repeated lines taken out of the blocks' texts; every row and column is kept.

    A text whose lines all go becomes the empty string; blocks keep their positions. Rows of one page_id get
    the same treatment, rows without page_id none.
    """
    found = repeated_lines(pages, page_id, source, blocks, least_pages)
    drop = materialize(found.groupBy(F.col("page_id").alias("_mill_page")).agg(F.collect_set(F.struct("block_pos", "line_no")).alias("_mill_drop")), "linedrop")  # bounded by the page's own lines
    drop = held(drop, DROP_PAGES)
    joined = pages.join(drop, F.col(page_id) == F.col("_mill_page"), "left")

    def clean(b: Column, pos: Column) -> Column:
        kept = F.filter(F.transform(F.split(b["text"], "\n", -1), lambda line, k: F.struct(line.alias("line"), F.array_contains(F.col("_mill_drop"), F.struct(pos.alias("block_pos"), k.alias("line_no"))).alias("out"))), lambda x: ~x["out"])
        text = F.when(F.col("_mill_drop").isNull() | b["text"].isNull() | F.coalesce(b["kind"] == "code", F.lit(False)), b["text"]).otherwise(F.array_join(F.transform(kept, lambda x: x["line"]), "\n"))
        return b.withField("text", text)

    return joined.withColumn(blocks, F.transform(F.col(blocks), clean)).drop("_mill_page", "_mill_drop")
