"""Index a run: pages to points."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import classify, ids, text, urls
from corpusmill.functions.language import language
from corpusmill.operators.sections import page_units
from corpusmill.session import materialize, small_enough

#: Runs with more pages fail.
MOST_PAGES = 50_000
#: Reasons that are skipped without counting as empty.
POLICY_REASONS = ["locale", "failure", "http_error", "sitemap"]
DIMENSIONS = 384
#: Rows of one or two keys that may be broadcast: some 20 MB.
BROADCAST_ROWS = 200_000


def latest(df: DataFrame, key: str, newest: str, ties: tuple[str, ...] = ()) -> DataFrame:
    """One row a key: the one with the largest `newest` (null last), equal ones by the smallest `ties`. Null keys are dropped.

    A ranking window with a limit of one: every task keeps one row a key before the shuffle, and columns that
    the query does not read are never shuffled.
    """
    w = Window.partitionBy(key).orderBy(F.col(newest).desc_nulls_last(), *ties)
    return df.where(F.col(key).isNotNull()).withColumn("_mill_n", F.row_number().over(w)).where("_mill_n = 1").drop("_mill_n")


def classified(pages: DataFrame) -> DataFrame:
    """Pages with status_int, robots (decoded) and reason."""
    decoded = pages.withColumn("status_int", classify.int_of("status_code")).withColumn("robots", classify.bool_of("robots_allowed"))
    return decoded.withColumn("reason", classify.unusable_reason("url", "final_url", F.col("status_int"), F.col("robots"), "failure_reason", "blocks"))


def skip_counts(pages: DataFrame, by: str = "run_id") -> DataFrame:
    """O5, A2 (the part that needs no texts): pages seen and skipped, by run. `no_content` counts as unusable and empty."""
    c = classified(pages)
    return c.groupBy(by).agg(
        F.count("*").alias("pages_seen"),
        F.count_if(F.col("reason").isNotNull()).alias("skipped_unusable"),
        F.count_if(F.col("reason").isNotNull() & ~F.col("reason").isin(POLICY_REASONS)).alias("skipped_empty"),
        F.count_if(F.col("reason").isNull()).alias("kept"),
    )


def resolve_entities(hosts: DataFrame, entities: DataFrame, host: str = "host", crawl_type: str | None = None) -> DataFrame:
    """J1. For every host the first entity (smallest ord) one of whose domains is the host or its suffix after a dot.

    hosts' rows are exploded to their few suffixes, so the suffix join is an equi join; entities: (entity_id,
    entity_name, source_type, domain, ord), of which the first 5,000 by ord count. With crawl_type, a host that has none
    keeps its place: its entity has no id, its own name and its crawl type, `unknown` where that is blank (F41).
    """
    labels = F.split(F.col(host), r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    few = F.broadcast(entities.orderBy("ord", "entity_id", "domain").limit(5000))
    asked = hosts.select(host, *([F.col(crawl_type).alias("_type")] if crawl_type else [])).where(F.length(host) > 0).distinct()
    hit = asked.select(host).distinct().withColumn("domain", F.explode(suffixes)).join(few, "domain")
    found = hit.groupBy(host).agg(F.min_by(F.struct("entity_id", "entity_name", "source_type"), "ord").alias("e"))
    if not crawl_type:
        return found.select(host, "e.*")
    kind = F.lower(F.trim(F.coalesce(F.col("_type"), F.lit(""))))
    made = F.struct(F.lit(None).cast("string").alias("entity_id"), F.col(host).alias("entity_name"), F.when(kind == "", "unknown").otherwise(kind).alias("source_type"))
    return asked.join(found, host, "left").select(host, F.col("_type").alias(crawl_type), F.coalesce("e", made).alias("e")).select(host, crawl_type, "e.*")


def latest_pages(pages: DataFrame, key: str = "page_id", newest: str = "arrived_at") -> DataFrame:
    """`latest` for wide rows of which few are repeated: only the rows of repeated keys are shuffled.

    The keys that stand on several rows are counted first, from the key column alone.
    """
    again = materialize(pages.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "again")
    again = F.broadcast(again) if small_enough(again, BROADCAST_ROWS) else again
    return pages.where(F.col(key).isNotNull()).join(again, key, "left_anti").unionByName(latest(pages.join(again, key, "left_semi"), key, newest))


def first_page_wins(nodes: DataFrame, run: str = "run_id", digest: str = "text_digest", page: str = "page_id", order: str = "crawled_at") -> DataFrame:
    """R16. Keep a text's nodes only on the first page of the run that has it; repeats inside that page stay.

    Set form of the page-by-page rule: the owner is the page with the smallest (crawled_at, page_id). Owners are found by
    an aggregate with partial minima, so a text on every page of a run costs one row a task; only texts on
    several pages have an owner to be looked up, and where these are few no node is shuffled.
    """
    here = F.struct(F.col(order).alias("at"), F.col(page).alias("owner"))
    owner = nodes.groupBy(run, digest).agg(F.min(here).alias("o"), F.max(here).alias("l")).where("o.owner <> l.owner").select(F.col(run).alias("_run"), F.col(digest).alias("_digest"), "o.owner")
    owner = materialize(owner, "owners")
    owner = F.broadcast(owner) if small_enough(owner, BROADCAST_ROWS) else owner
    joined = nodes.join(owner, F.col(run).eqNullSafe(F.col("_run")) & (F.col(digest) == F.col("_digest")), "left")
    return joined.where(F.col("owner").isNull() | (F.col(page) == F.col("owner"))).drop("owner", "_run", "_digest")


def usable_pages(pages: DataFrame, english_only: bool = True) -> DataFrame:
    """Classified pages with `plain` and `language`; `skipped` says why a page is not indexed (O4, O6), null for those that are.

    A page without text is skipped as extract_empty, one in another language, or in none, as non_english.
    """
    c = classified(pages)
    plain = F.when(F.col("reason").isNull(), text.plain_text("blocks"))
    c = c.withColumn("plain", plain)
    blank = F.length(text.strip(F.col("plain"))) == 0
    c = c.withColumn("language", language(F.when(~blank, F.col("plain"))) if english_only else F.lit(None).cast("string"))
    why = F.when(F.col("reason") == "no_content", "extract_empty").when(F.col("reason").isNotNull(), F.col("reason")).when(blank, "extract_empty")
    return c.withColumn("skipped", why.when(~F.coalesce(F.col("language") == "en", F.lit(False)), "non_english") if english_only else why)


def run_units(pages: DataFrame, english_only: bool = True) -> DataFrame:
    """O22-O25, O9 of the pages to index: one row a parent with its page's columns, its children that are no stubs and the number of stubs."""
    ok = usable_pages(pages, english_only).where("skipped is null")
    page = ok.withColumn("host", urls.host_of("origin", "url")).withColumn("page_title", text.page_title("title", "blocks")).withColumn("category", classify.category("url", "plain"))
    page = page.withColumn("quality", classify.quality("plain", "page_title", F.size("blocks") > 0)).withColumn("evergreen", classify.is_evergreen("url", "plain")).withColumn("tags", urls.tags("url", "page_title")).withColumn("source_digest", ids.source_digest("content_html"))
    keep = ("run_id", "host", "url", "final_url", "page_title", "category", "quality", "evergreen", "tags", "source_digest", "language", "crawled_at")
    u = page_units(page, keep)
    return u.withColumn("kept", F.filter("children", lambda c: ~text.is_stub(c["text"], F.col("section_title")))).withColumn("stubs", F.size("children") - F.size("kept")).drop("children")


def nodes_of(units_df: DataFrame) -> DataFrame:
    """O26, O29. Nodes of the units: one row a child that is no stub, and one a parent before its first when its text is not the child's."""
    u = units_df.where(F.size("kept") > 0)
    child = F.transform("kept", lambda c: F.struct(F.lit("child").alias("chunk_role"), c["child_index"].alias("child_index"), c["text"].alias("child_text")))
    first = F.get("kept", F.lit(0))
    leads = text.strip(F.col("parent_text")) != text.strip(first["text"])
    parent = F.array(F.struct(F.lit("parent").alias("chunk_role"), first["child_index"].alias("child_index"), F.lit("").alias("child_text")))
    n = u.withColumn("_n", F.explode(F.when(leads, F.concat(parent, child)).otherwise(child))).select(*[c for c in u.columns if c not in ("kept", "stubs")], "_n.*")
    is_parent = F.col("chunk_role") == "parent"
    n = n.withColumn("embed_text", text.sanitize(F.when(is_parent, F.col("parent_text")).otherwise(F.col("child_text"))))
    key = F.when(is_parent, F.concat(F.lit("parent:"), F.col("parent_index"))).otherwise(F.concat(F.lit("child:"), F.col("child_index")))
    n = n.withColumn("chunk_key", key).withColumn("text_digest", F.sha2("embed_text", 256)).withColumn("point_id", ids.point_id("run_id", "page_id", F.col("chunk_key")))
    return n.withColumn("content_intent", classify.content_intent("category"))


def page_nodes(pages: DataFrame, english_only: bool = True) -> DataFrame:
    """The nodes of all usable pages, repeated texts included."""
    return nodes_of(run_units(pages, english_only))


def index_run(pages: DataFrame, english_only: bool = True, most_pages: int | None = None) -> DataFrame:
    """P1 without the vectors: nodes of all runs in `pages`, repeated texts on the run's first page only.

    The nodes are written once, as the owners of texts are found from them and joined back to them. A run of more pages than
    most_pages (the reference value is MOST_PAGES) is an error, as nothing of it would be complete.
    """
    newest = latest_pages(pages)
    if most_pages is not None and (over := [r.run_id for r in newest.groupBy("run_id").count().where(F.col("count") > most_pages).select("run_id").limit(20).collect()]):
        raise ValueError(f"runs with more than {most_pages} pages: {over}")
    return first_page_wins(materialize(page_nodes(newest, english_only), "nodes"))


def index_counts(pages: DataFrame, english_only: bool = True) -> DataFrame:
    """A2. One row a run: pages seen, indexed and skipped (every skip counts as unusable; non_english as lang too; what no
    policy asks for as empty too), nodes kept, and nodes left out as repeats and stubs."""
    newest = latest_pages(pages)
    by_page = usable_pages(newest, english_only).groupBy("run_id").agg(
        F.count("*").alias("pages_seen"), F.count_if(F.col("skipped").isNull()).alias("pages_english"), F.count_if(F.col("skipped") == "non_english").alias("skipped_lang"),
        F.count_if(F.col("skipped").isNotNull() & ~F.col("skipped").isin(POLICY_REASONS)).alias("skipped_empty"), F.count_if(F.col("skipped").isNotNull()).alias("skipped_unusable"),
    )
    units_df = materialize(run_units(newest, english_only), "units")
    stubs = units_df.groupBy("run_id").agg(F.sum("stubs").alias("chunks_skipped_stub"))
    nodes = materialize(nodes_of(units_df).select("run_id", "page_id", "text_digest", "crawled_at"), "digests")
    kept = first_page_wins(nodes).groupBy("run_id").agg(F.count("*").alias("chunks_upserted"))
    made = nodes.groupBy("run_id").agg(F.count("*").alias("made"))
    out = by_page
    for more in (stubs, kept, made):  # one row a run each
        out = out.join(more.withColumnRenamed("run_id", "_run"), F.col("run_id").eqNullSafe(F.col("_run")), "left").drop("_run")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return out.withColumns({"chunks_upserted": zero("chunks_upserted"), "chunks_skipped_repeat": zero("made") - zero("chunks_upserted"), "chunks_skipped_stub": zero("chunks_skipped_stub")}).drop("made")


def hash_vector(t: str, dimensions: int = DIMENSIONS) -> np.ndarray:
    """The stand-in embedder: words and word pairs hashed to signed places, length 1; zeros for no words."""
    import re
    import zlib

    words = re.findall(r"[a-z0-9]+", t.lower())
    v = np.zeros(dimensions, dtype=np.float32)
    for f in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
        h = zlib.crc32(f.encode())
        v[h % dimensions] += 1.0 if h & 1 << 31 else -1.0
    n = float(np.linalg.norm(v))
    return v / n if n else v


def embed(t: Column, model: Callable[[str], np.ndarray] = hash_vector) -> Column:
    """A text's vector; the model is loaded once a worker and called on Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda x: model(x or "").tolist())

    return run(t)


def embed_distinct(nodes: DataFrame, cache: DataFrame | None = None, model_name: str = "hash-384", column: str = "embed_text", model: Callable[[str], np.ndarray] = hash_vector, dimensions: int = DIMENSIONS) -> tuple[DataFrame, DataFrame]:
    """P2, J17. (nodes with `embedding`, new cache rows): every distinct text that the cache lacks is embedded once.

    cache: (key, vector); vectors of another width are ignored (S20). Blank texts get no vector. The new rows go to
    the cache insert-if-absent (S21).
    """
    keyed = nodes.withColumn("_key", F.when(F.length(text.strip(F.col(column))) > 0, ids.cache_key(column, model_name)))
    wanted = keyed.where("_key is not null").groupBy("_key").agg(F.first(column).alias("t"))
    held = None if cache is None else cache.where(F.size("vector") == dimensions).dropDuplicates(["key"]).select(F.col("key").alias("_key"), "vector")
    fresh = (wanted if held is None else wanted.join(held, "_key", "left_anti")).select("_key", embed(F.col("t"), model).alias("vector"))
    vectors = fresh if held is None else fresh.unionByName(held.join(wanted, "_key", "left_semi"))
    out = keyed.join(vectors, "_key", "left").withColumnRenamed("vector", "embedding").drop("_key")
    return out, fresh.select(F.col("_key").alias("key"), "vector")
