"""Governed assets and templates: allow-list semi joins, interval join, template search."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import ids, text
from corpusmill.operators.checks import executable_entries
from corpusmill.operators.index import embed_distinct
from corpusmill.operators.retrieve import dense_top_k
from corpusmill.operators.sections import window_spans
from corpusmill.session import held, materialize, small_enough

#: Columns by which a manifest entry names a point, and by which a runtime manifest does.
ENTRY_KEY = ["owner_id", "asset_id", "asset_version_id", "resource_id", "resource_digest", "asset_version_digest"]
VERSION_KEY = ["asset_id", "asset_version_id"]
MOST_ENTRIES = 500


def allowed(points: DataFrame, entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """J5, J6. Points that a manifest lists, on all key columns. Up to 500 entries are broadcast, more are shuffled."""
    keys = keys or ENTRY_KEY
    few = entries.select(*keys).distinct()
    return points.join(F.broadcast(few) if small_enough(few, MOST_ENTRIES) else few, keys, "left_semi")


def tampered(points: DataFrame, entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """J7. Points that match no entry on all columns; a query whose result has any must fail."""
    return points.join(entries.select(*(keys or ENTRY_KEY)).distinct(), keys or ENTRY_KEY, "left_anti")


def assert_allowed(points: DataFrame, entries: DataFrame, keys: list[str] | None = None) -> DataFrame:
    if not tampered(points, entries, keys).isEmpty():
        raise ValueError("a point does not match the manifest")
    return points


def delete_rows(points: DataFrame, doomed: DataFrame, keys: list[str]) -> DataFrame:
    """S14, S15, P11. What stays when the rows with these keys go."""
    return points.join(doomed.select(*keys).distinct(), keys, "left_anti")


def chunk_offsets(body: str, size: int = 200, overlap: int = 40) -> list[tuple[int, int, str]]:
    """O27. (start, end, text) of a text's windows."""
    return [(a, b, body[a:b]) for a, b in window_spans(body, size, overlap)]


def asset_chunks(assets: DataFrame, digest: str = "resource_digest", body: str = "text") -> DataFrame:
    """O27, S24 (the text form). (digest, start_char, end_char, text, chunk_id) of normalised texts; blank ones give none."""
    src = assets.select(F.col(digest).cast("string").alias("digest"), text.asset_text(body).alias("t")).where("t is not null and digest is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(d, *c) for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for c in chunk_offsets(t)]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.string())], names=["digest", "start_char", "end_char", "text"])

    out = src.mapInArrow(run, "digest string, start_char int, end_char int, text string")
    return out.withColumn("chunk_id", ids.uuid5(F.concat_ws(":", "digest", F.concat_ws("-", "start_char", "end_char"))))


def covering_source(chunks: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    """J8. The first source (smallest ord) of the same key whose [start_char, end_char) holds the chunk's start.

    An equi join on the key first, so the interval is checked among one resource's few sources only.
    """
    s = sources.select(key, F.col("start_char").alias("_a"), F.col("end_char").alias("_e"), "ord", "label")
    hit = chunks.select(key, "start_char").distinct().join(s, key).where((F.col("_a") <= F.col("start_char")) & (F.col("start_char") < F.col("_e")))
    first = hit.groupBy(key, "start_char").agg(F.min_by("label", "ord").alias("source_label"))
    return chunks.join(first, [key, "start_char"], "left")


def index_assets(revisions: DataFrame, entries: DataFrame, sources: DataFrame | None = None, cache: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """P9. (points, new cache rows) of the revisions that a manifest lists: chunks with offsets, the source whose
    span covers their start (J8), an eligible mark, and vectors embedded once a text.

    revisions: the columns of ENTRY_KEY, text and what else a point carries; entries: the manifest, which has to hold (checks).
    sources: resource_digest, start_char, end_char, label, ord. Listed entries without a revision give nothing.
    """
    listed = allowed(revisions, executable_entries(entries))
    chunks = asset_chunks(listed.select("resource_digest", "text").distinct())
    chunks = chunks.withColumnRenamed("digest", "resource_digest")
    if sources is not None:
        chunks = covering_source(chunks, sources, "resource_digest")
    made, fresh = embed_distinct(chunks.withColumnRenamed("text", "embed_text"), cache)
    points = listed.drop("text").distinct().join(made, "resource_digest").withColumn("manifest_eligible", F.lit(True))
    return points.withColumn("point_id", F.concat_ws(":", *ENTRY_KEY[:4], "chunk_id")), fresh


def asset_top_k(points: DataFrame, entries: DataFrame, queries: DataFrame, k: int, keys: list[str] | None = None) -> DataFrame:
    """R12. Dense top k among the points a manifest allows."""
    return dense_top_k(allowed(points, entries, keys).where("manifest_eligible"), queries, k)


def query_assets(points: DataFrame, entries: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """P10. The hits of each query among the points a valid manifest lists, with their columns. Raises when a hit matches no entry on all
    key columns (J7), as a store that was changed behind the manifest could return."""
    valid = executable_entries(entries)
    top = materialize(asset_top_k(points, valid, queries, k), "assethits")
    hits = points.join(held(top), "point_id")
    assert_allowed(hits, valid)
    return hits


def delete_revision(points: DataFrame, entries: DataFrame, asset_version_id: str, resource_id: str) -> DataFrame:
    """P11. What stays when one revision's resource goes. Raises unless exactly one entry names it."""
    one = entries.where((F.col("asset_version_id") == asset_version_id) & (F.col("resource_id") == resource_id)).select(*ENTRY_KEY)
    if one.limit(2).count() != 1:
        raise ValueError("exactly one entry has to name the resource")
    return delete_rows(points, one, ENTRY_KEY)


def template_filter(templates: DataFrame, owner: str | None = None, channel: str | None = None, framework: str | None = None, entity_tags: list[str] | None = None) -> DataFrame:
    """O14."""
    if owner is not None:
        templates = templates.where(F.col("owner_id") == owner)
    if channel:
        templates = templates.where(F.lower("channel") == channel.strip().lower())
    if framework:
        templates = templates.where(F.lower("framework") == framework.strip().lower())
    if entity_tags:
        templates = templates.where(F.arrays_overlap("entity_tags", F.array(*map(F.lit, entity_tags))))
    return templates


def template_text() -> Column:
    """P8. The lines a template is embedded by."""
    return F.concat_ws("\n", *[F.when(F.length(c) > 0, F.col(c)) for c in ("name", "channel", "framework", "body")])


def upsert_items(items: DataFrame, most: int = 50) -> DataFrame:
    """R18. Templates as they are stored: bodies of at least 8 characters, the first of each id (any case), at most 50 in order."""
    ok = items.where(F.length(text.strip(F.col("body"))) >= 8).withColumn("_id", F.lower(F.trim("template_id")))
    first = ok.withColumn("_n", F.row_number().over(Window.partitionBy("_id").orderBy("ord"))).where("_n = 1")
    return first.orderBy("ord").limit(most).drop("_n", "_id")


def template_top_k(templates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """R11. Dense top k (at most 20), blank bodies dropped after the limit."""
    top = dense_top_k(templates, queries, min(k, 20), ident="template_id")
    return top.join(templates.select(F.col("template_id").alias("point_id"), "body"), "point_id").where(F.length(F.trim("body")) > 0).select("query_id", F.col("point_id").alias("template_id"), "score", "rank")
