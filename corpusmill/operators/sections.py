"""Pages to sections, parents and children."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.text import _c, plain_text, strip
from corpusmill.functions.tokens import token_spans

#: Limits in tokens: (size, overlap) of parents and of children, and what the model takes beside its own two tokens.
PARENT, CHILD = (500, 80), (200, 40)
SEQUENCE_LIMIT, SPECIAL_TOKENS = 512, 2

Spans = Callable[[str], list[tuple[int, int]]]


def sections(blocks: Column | str) -> Column:
    """O22. Array of (title, level, text, anchors): every heading begins a section and stays in it; blank ones are dropped.

    The blocks are folded once, in the JVM: a heading opens a new group, other blocks join the last one.
    """
    items = F.coalesce(_c(blocks), F.array())
    starts = F.filter(F.transform(items, lambda b, i: F.when((b["kind"] == "heading") | (i == 0), i)), lambda i: i.isNotNull())
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(items)))
    groups = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("e")), lambda g: F.slice(items, g["a"] + 1, g["e"] - g["a"]))

    def one(group: Column) -> Column:
        head = F.get(group, F.lit(0))
        is_head = head["kind"] == "heading"
        title = F.when(is_head, strip(head["text"]))
        links = F.filter(F.transform(F.flatten(F.transform(group, lambda b: F.coalesce(b["anchors"], F.array()))), lambda a: F.struct(strip(F.coalesce(a["label"], F.lit(""))).alias("label"), strip(F.coalesce(a["href"], F.lit(""))).alias("href"))), lambda a: F.length(a["href"]) > 0)
        hrefs = F.transform(links, lambda a: a["href"])
        first = F.filter(links, lambda a, i: F.array_position(hrefs, a["href"]) == i + 1)
        return F.struct(F.when(F.length(title) > 0, title).alias("title"), F.when(is_head, head["level"]).alias("level"), plain_text(group).alias("text"), first.alias("anchors"))

    return F.filter(F.transform(groups, one), lambda s: F.length(strip(s["text"])) > 0)


def page_sections(pages: DataFrame, page_id: str = "page_id", blocks: str = "blocks", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a section: page_id, kept columns, section_index (from 0), title, level, text, anchors."""
    out = pages.where(F.size(F.coalesce(F.col(blocks), F.array())) > 0).select(page_id, *keep, F.posexplode(sections(blocks)).alias("section_index", "s"))
    return out.select(page_id, *keep, "section_index", "s.title", "s.level", "s.text", "s.anchors")


def window_spans(text: str, size: int, overlap: int, spans: Spans = token_spans, limit: int = SEQUENCE_LIMIT, special: int = SPECIAL_TOKENS) -> list[tuple[int, int]]:
    """O23, O24. (start, end) of windows of at most `size` tokens, measured on the window itself; starts advance by size - overlap tokens."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size must be positive and the overlap smaller")
    if 0 < limit < size + special:
        raise ValueError(f"{size} tokens do not fit a model limit of {limit} with {special} of its own")
    tokens = spans(text or "")

    def widest(first: int) -> tuple[int, int] | None:
        """The longest window from a token on that keeps the limit; a tokenizer may count more in it than it did in the text."""
        for last in range(min(first + size, len(tokens)), first, -1):
            piece = text[tokens[first][0] : tokens[last - 1][1]]
            start = tokens[first][0] + len(piece) - len(piece.lstrip())
            if piece.strip() and len(spans(piece.strip())) <= size:
                return (start, start + len(piece.strip())), last
            if not piece.strip():
                return None, last
        return None, first + 1

    out = []
    for first in range(0, len(tokens), size - overlap):
        window, last = widest(first)
        if window:
            out.append(window)
        if last >= len(tokens):
            break
    return out


def token_windows(text: str, size: int, overlap: int, spans: Spans = token_spans, limit: int = SEQUENCE_LIMIT, special: int = SPECIAL_TOKENS) -> list[str]:
    """The windows themselves."""
    text = (text or "").strip()
    return [text[a:b] for a, b in window_spans(text, size, overlap, spans, limit, special)]


def units(sections_df: DataFrame, keys: tuple[str, ...] = ("page_id",), order: str = "section_index", parent: tuple[int, int] = PARENT, child: tuple[int, int] = CHILD, spans: Spans = token_spans) -> DataFrame:
    """O25. Parents within sections and children within parents; parent_index and child_index count through each page.

    One Arrow batch function cuts the texts; numbering is a window over the page. A section whose text has no token gives
    nothing; a parent without children is its own child. Other columns of sections_df are carried.
    """
    cols = [f for f in sections_df.schema.fields if f.name not in ("text", "level")]
    schema = T.StructType([*cols, T.StructField("w", T.ArrayType(T.StructType([T.StructField("parent_text", T.StringType()), T.StructField("children", T.ArrayType(T.StringType()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("parent_text", pa.string()), ("children", pa.list_(pa.string()))]))
        for b in batches:
            made = []
            for t in b.column("text").to_pylist():
                parents = token_windows(t or "", *parent, spans)
                made.append([{"parent_text": p, "children": token_windows(p, *child, spans) or [p]} for p in parents])
            yield pa.record_batch([*[b.column(f.name) for f in cols], pa.array(made, kind)], names=schema.names)

    cut = sections_df.mapInArrow(run, schema)
    rows = cut.select(*[f.name for f in cols], F.posexplode("w").alias("_p", "p")).select("*", F.posexplode("p.children").alias("_c", "child_text"))
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(order, "_p", "_c")  # a page's own units
    rows = rows.withColumn("child_index", (F.row_number().over(w) - 1)).withColumn("parent_index", F.dense_rank().over(Window.partitionBy(*keys).orderBy(order, "_p")) - 1)
    return rows.withColumn("parent_text", F.col("p.parent_text")).withColumnRenamed("title", "section_title").withColumnRenamed("anchors", "section_anchors").drop("_p", "_c", "p")


def page_units(pages: DataFrame, keep: tuple[str, ...], page_id: str = "page_id", blocks: str = "blocks", parent: tuple[int, int] = PARENT, child: tuple[int, int] = CHILD, spans: Spans = token_spans) -> DataFrame:
    """O22-O25 of whole pages: one row a parent (page_id, kept columns, section_index, section_title, section_anchors,
    parent_index, parent_text, children). children: array of (child_index, text).

    All sections of a page stand in its row, so parents and children are numbered where they are cut and nothing is
    shuffled; Python gets the sections' texts only.
    """
    cut = "array<struct<section:int,parent_text:string,children:array<struct<child_index:int,text:string>>>>"

    def numbered(texts) -> list[dict]:
        found, n = [], 0
        for section, text in enumerate(texts):
            for p in token_windows(text or "", *parent, spans):
                own = token_windows(p, *child, spans) or [p]
                found.append({"section": section, "parent_text": p, "children": [{"child_index": n + k, "text": c} for k, c in enumerate(own)]})
                n += len(own)
        return found

    @F.pandas_udf(cut)
    def units_of(s: pd.Series) -> pd.Series:
        return s.map(numbered)

    held = pages.where(F.size(F.coalesce(F.col(blocks), F.array())) > 0).select(page_id, *keep, sections(blocks).alias("_s"))
    # marked so, it is computed once, before its rows are made, and not drawn into them
    held = held.withColumn("_u", units_of.asNondeterministic()(F.transform("_s", lambda s: s["text"])))
    rows = held.select(page_id, *keep, "_s", F.posexplode("_u").alias("parent_index", "_p"))
    own = F.get("_s", F.col("_p.section"))
    return rows.select(page_id, *keep, F.col("_p.section").alias("section_index"), own["title"].alias("section_title"), own["anchors"].alias("section_anchors"), "parent_index", F.col("_p.parent_text").alias("parent_text"), F.col("_p.children").alias("children"))


def embed_batches(texts: list[str], most_items: int, most_tokens: int, spans: Spans = token_spans) -> list[list[str]]:
    """O28. Texts in order, cut into batches before either limit would be passed; a text over the limit is an error."""
    out: list[list[str]] = []
    size = 0
    for t in texts:
        n = len(spans(t))
        if n > most_tokens:
            raise ValueError("a text has more tokens than a batch may have")
        if not out or len(out[-1]) >= most_items or size + n > most_tokens:
            out.append([])
            size = 0
        out[-1].append(t)
        size += n
    return out


def batched(df: DataFrame, ident: str, text: str, most_items: int = 64, most_tokens: int = 50_000) -> DataFrame:
    """O28 over a table: (ident, task, batch) with batches that keep both limits, cut in every task on its own."""
    kind = df.schema[ident].dataType
    schema = T.StructType([T.StructField(ident, kind), T.StructField("task", T.IntegerType()), T.StructField("batch", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, batch, items, tokens = TaskContext.get().partitionId(), 0, 0, 0
        for b in batches:
            numbers = []
            for t in b.column(1).to_pylist():
                n = len(token_spans(t or ""))
                if n > most_tokens:
                    raise ValueError("a text has more tokens than a batch may have")
                if items and (items >= most_items or tokens + n > most_tokens):
                    batch, items, tokens = batch + 1, 0, 0
                items, tokens = items + 1, tokens + n
                numbers.append(batch)
            yield pa.record_batch([b.column(0), pa.array([task] * len(numbers), pa.int32()), pa.array(numbers, pa.int32())], names=schema.names)

    return df.select(ident, text).mapInArrow(run, schema)
