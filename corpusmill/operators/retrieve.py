"""Filtered hybrid retrieval, many questions at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import urls
from corpusmill.session import held, materialize

#: Term saturation, length weight and reference length of the document weights.
K, B, AVERAGE = 1.2, 0.75, 256.0
#: Constant of reciprocal-rank fusion.
FUSION = 60
#: Candidates a reranker gets at least, where there are so many.
RERANK_POOL = 40
#: Bytes of query vectors that every task holds at once.
QUERY_BYTES = 32_000_000


def metadata_filter(points: DataFrame, run_id: str | None = None, owner_id: str | None = None, visibility: str | None = None, crawl_type: str | None = None, host: str | None = None, chunk_role: str | None = None, source_types: list[str] | None = None, entity_names: list[str] | None = None, categories: list[str] | None = None, min_quality: float | None = None, language: str | None = "en") -> DataFrame:
    """O7. The conjunction of the conditions that are given; all reach the scan, run_id prunes partitions."""
    lowered = lambda xs: [x.strip().lower() for x in xs if x.strip()]
    for name, value in (("run_id", run_id), ("owner_id", owner_id), ("visibility", visibility), ("language", language), ("crawl_type", crawl_type), ("host", host.strip().lower() if host else None), ("chunk_role", chunk_role)):
        if value is not None:
            points = points.where(F.col(name) == value)
    for name, values in (("source_type", lowered(source_types or [])), ("entity_name", [x.strip() for x in entity_names or [] if x.strip()]), ("category", lowered(categories or []))):
        if values:
            points = points.where(F.col(name).isin(values))
    return points if min_quality is None else points.where(F.col("quality") >= min_quality)


def search_role(chunk_role: str | None, prefer_parent: bool, prefer_child: bool) -> str | None:
    """O8."""
    return chunk_role or ("child" if prefer_parent or prefer_child else None)


def fetch_size(top_k: int) -> int:
    """R4. Candidates of each half."""
    return max(2 * top_k, 30)


def top_per_query(scored: DataFrame, k: int, score: str = "score", ident: str = "point_id") -> DataFrame:
    """The k best of each query, ties by id; ranks from 1. Spark keeps k rows a query in every task before it shuffles."""
    w = Window.partitionBy("query_id").orderBy(F.desc(score), ident)
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def dense_top_k(points: DataFrame, queries: DataFrame, k: int, ident: str = "point_id", vector: str = "embedding") -> DataFrame:
    """R1, R21. Exact cosine top k of each query. queries (query_id, vector) are the stated set, held by every task in blocks of
    QUERY_BYTES; each block is a pass over the points.

    Points with a null or zero vector, or another width, take no part.
    """
    q = queries.select("query_id", F.col("vector").alias("_q"), norm(F.col("vector")).alias("_n")).where("_n > 0")
    p = points.select(F.col(ident).alias("point_id"), F.col(vector).alias("_v"), norm(F.col(vector)).alias("_m")).where("_m > 0")
    q = materialize(q, "queries")
    size = q.agg(F.sum(F.size("_q") * 8 + 64)).first()[0] or 0
    blocks = size // QUERY_BYTES + 1

    def of(part: DataFrame) -> DataFrame:
        pairs = p.join(F.broadcast(part), F.size("_v") == F.size("_q"))
        return top_per_query(pairs.select("query_id", "point_id", (dot(F.col("_v"), F.col("_q")) / (F.col("_m") * F.col("_n"))).alias("score")), k)

    out = of(q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == 0))
    for n in range(1, blocks):
        out = out.unionByName(of(q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == n)))
    return out


def terms(text: Column) -> Column:
    """Runs of letters and digits of any script, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def postings(points: DataFrame, ident: str = "point_id", text: str = "embed_text", only: DataFrame | None = None) -> DataFrame:
    """S9. (point_id, term, weight, tf, len): document weights of every term, or of the terms in `only`."""
    t = points.select(F.col(ident).alias("point_id"), terms(F.col(text)).alias("w")).select("point_id", F.size("w").alias("len"), F.explode("w").alias("term"))
    if only is not None:
        t = t.join(only, "term", "left_semi")
    t = t.groupBy("point_id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    return t.withColumn("weight", F.col("tf") * (K + 1) / (F.col("tf") + K * (1 - B + B * F.col("len") / AVERAGE)))


def sparse_top_k(points: DataFrame, queries: DataFrame, k: int, ident: str = "point_id", text: str = "embed_text", index: DataFrame | None = None) -> DataFrame:
    """R2. BM25 top k of each query (query_id, text): document weights times inverse document frequencies.

    N and document frequencies are those of all points given. A repeated query term counts once. Scores are rounded to
    nine places before they are ranked, so that the order of a sum does not decide.
    """
    q = queries.select("query_id", F.explode(F.array_distinct(terms(F.col("text")))).alias("term"))
    asked = held(q.select("term").distinct())
    q = held(q)
    total = points.agg(F.count("*").alias("total"))
    post = postings(points, ident, text, asked) if index is None else index.join(asked, "term", "left_semi")
    df = post.groupBy("term").agg(F.count("*").alias("df"))
    hit = post.join(held(materialize(df, "frequencies")), "term").join(q, "term").crossJoin(F.broadcast(total))  # one row
    idf = F.log(1 + (F.col("total") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return top_per_query(hit.groupBy("query_id", "point_id").agg(F.round(F.sum(F.col("weight") * idf), 9).alias("score")), k)


def fuse(dense: DataFrame, sparse: DataFrame, top_k: int) -> DataFrame:
    """R3, U1. Reciprocal-rank fusion of two ranked halves (query_id, point_id, rank): score, and rank with ties in the
    order of the dense half first."""
    both = dense.select("query_id", "point_id", "rank", F.lit(0).alias("half")).unionByName(sparse.select("query_id", "point_id", "rank", F.lit(1).alias("half")))
    one = both.groupBy("query_id", "point_id").agg(F.sum(1.0 / (FUSION + F.col("rank"))).alias("score"), F.min(F.struct("half", "rank")).alias("first"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "first.half", "first.rank")
    return one.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top_k).select("query_id", "point_id", "score", "rank")


def fusion_report(dense: DataFrame, sparse: DataFrame, fused: DataFrame) -> DataFrame:
    """A18. By query: sizes, overlap, union, survivors of each half and the first dropped rank of each."""
    d = dense.select("query_id", "point_id", F.col("rank").alias("d"))
    s = sparse.select("query_id", "point_id", F.col("rank").alias("s"))
    f = fused.select("query_id", "point_id", F.lit(1).alias("f"))
    j = d.join(s, ["query_id", "point_id"], "full_outer").join(f, ["query_id", "point_id"], "left")
    return j.groupBy("query_id").agg(
        F.count("d").alias("dense"), F.count("s").alias("sparse"), F.count_if(F.col("d").isNotNull() & F.col("s").isNotNull()).alias("overlap"), F.count("*").alias("union_size"), F.count("f").alias("kept"),
        F.min(F.when(F.col("f").isNull(), F.col("d"))).alias("first_dropped_dense"), F.min(F.when(F.col("f").isNull(), F.col("s"))).alias("first_dropped_sparse"),
    )


def return_text(prefer_parent: bool, prefer_child: bool) -> Column:
    """F37."""
    order = ["parent_text", "embed_text", "child_text"] if prefer_parent and not prefer_child else ["child_text", "embed_text", "parent_text"] if prefer_child and not prefer_parent else ["embed_text", "child_text", "parent_text"]
    return F.coalesce(*[F.when(F.length(c) > 0, F.col(c)) for c in order], F.lit(""))


def lineage_key() -> Column:
    """F39."""
    return F.concat_ws("|", F.coalesce("page_key", F.lit("")), F.coalesce("section_title", F.lit("")), F.substring(F.sha2(F.trim("parent_text"), 256), 1, 16))


def select_diverse(pool: DataFrame, top_k: int, collapse: bool) -> DataFrame:
    """R7, R8. Page-diverse selection from each query's ranked pool.

    pool: query_id, point_id, rank, page_key, text, lineage. Pages in the order of their best passage take turns; a
    passage whose text (or, when collapsing, lineage) was taken already is passed over without costing the page its turn. A
    pool has at most twice the fetch size of rows, so one query's rows are a small group by construction.
    """

    kind = {f.name: f.dataType for f in pool.schema}
    schema = T.StructType([T.StructField("query_id", kind["query_id"]), T.StructField("point_id", kind["point_id"]), T.StructField("rank", T.IntegerType()), T.StructField("position", T.IntegerType())])

    def pick(rows: list[tuple]) -> list[tuple]:
        pages: dict[str, list[tuple]] = {}
        for r in rows:
            pages.setdefault(r[3] or f"point:{r[1]}", []).append(r)
        texts, parents, chosen = set(), set(), []
        turns = [iter(q) for q in pages.values()]
        while turns and len(chosen) < top_k:
            still = []
            for queue in turns:
                if len(chosen) >= top_k:
                    break
                for r in queue:
                    if r[4] and r[4] in texts:
                        continue
                    texts.add(r[4])
                    if collapse and r[5] in parents:
                        continue
                    parents.add(r[5])
                    chosen.append((*r[:3], len(chosen) + 1))
                    still.append(queue)
                    break
            turns = still
        return chosen

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        form: pa.Schema | None = None

        def out(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = [form.field("query_id").type, form.field("point_id").type, pa.int32(), pa.int32()]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema.names)

        for b in batches:
            form = b.schema
            found: list[tuple] = []
            for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and held[0][0] != r[0]:
                    found += pick(held)
                    held = []
                held.append(r)
            yield out(found)
        if held:
            yield out(pick(held))

    rows = pool.select("query_id", "point_id", F.col("rank").cast("int").alias("rank"), "page_key", "text", "lineage")
    return rows.repartition("query_id").sortWithinPartitions("query_id", "rank").mapInArrow(run, schema)


def positional(pool: DataFrame) -> DataFrame:
    """R6 without a reranker: score n - rank + 1 of each query's pool."""
    return pool.withColumn("score", F.count("*").over(Window.partitionBy("query_id")) - F.col("rank") + 1)


def rerank_document(prefer_parent: bool, prefer_child: bool) -> Column:
    """F40. What a reranker reads: the child, else the plain text, where parents are collapsed; else the text that is returned."""
    whole = return_text(prefer_parent, prefer_child)
    if not prefer_parent or prefer_child:
        return whole
    return F.coalesce(*[F.when(F.length(F.trim(c)) > 0, F.trim(c)) for c in ("child_text", "embed_text")], whole)


def rerank(pool: DataFrame, top_k: int, score: Callable[[Column, Column], Column], query: str = "query_text", document: str = "document") -> DataFrame:
    """R5, R6. Each query's pool, cut to the best max(2 * top_k, RERANK_POOL), in the order that `score` (of query and document)
    gives; equal scores keep their order. The new rank and score take the place of the old."""
    cut = pool.where(F.col("rank") <= max(2 * top_k, RERANK_POOL)).withColumn("score", score(F.col(query), F.col(document)))
    return cut.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc_nulls_last("score"), "rank")))


def overlap_score(query: Column, document: Column) -> Column:
    """The stand-in reranker: the share of the query's different terms that the document has."""
    asked = F.array_distinct(terms(query))
    return F.size(F.array_intersect(asked, terms(document))) / F.greatest(F.size(asked), F.lit(1))


def hybrid(points: DataFrame, queries: DataFrame, top_k: int, prefer_parent: bool = False, prefer_child: bool = False, index: DataFrame | None = None, reranker: Callable[[Column, Column], Column] | None = None, **conditions: object) -> DataFrame:
    """P3. queries: query_id, text, vector. Hits of every query: position, rank, score, text and the point's columns.

    Conditions are those of metadata_filter and hold before both halves, as the order of filter and top k matters; children
    are searched when either preference is given (O8). `index` (postings with the points' ids) holds for unfiltered points.
    The pool is the whole union unless a reranker is given.
    """
    if conditions:
        points = metadata_filter(points, **{"chunk_role": search_role(conditions.pop("chunk_role", None), prefer_parent, prefer_child), **conditions})
        index = None if index is None else index.join(points.select("point_id"), "point_id", "left_semi")
    n = fetch_size(top_k)
    dense = dense_top_k(points, queries, n)
    sparse = sparse_top_k(points, queries, n, index=index)
    fused = fuse(dense, sparse, 2 * n)
    collapse = prefer_parent and not prefer_child
    wanted = points.withColumn("page_key", urls.page_key("page_id", "final_url", "url")).withColumn("text", return_text(prefer_parent, prefer_child)).withColumn("lineage", lineage_key())
    pool = wanted.join(held(materialize(fused, "fused")), "point_id")
    if reranker is not None:
        asked = held(queries.select("query_id", F.col("text").alias("query_text")))
        pool = rerank(pool.withColumn("document", rerank_document(prefer_parent, prefer_child)).join(asked, "query_id"), top_k, reranker).drop("query_text", "document")
    picked = materialize(select_diverse(pool, top_k, collapse).select("query_id", "point_id", F.col("rank").alias("rank"), "position"), "picked")
    keep = [c for c in wanted.columns if c not in ("embedding", "lineage", "page_key")]
    hits = pool.select("query_id", "score", *keep).join(held(picked), ["query_id", "point_id"])
    return hits.where(F.length(F.trim("text")) > 0)


def themes(hits: DataFrame, most: int = 12) -> DataFrame:
    """A5, J12, R9, P4. Theme rows of each query's hits: entities, categories, then pairs of entities sharing a category.

    hits: query_id, position, score, entity_name, host, category, url, final_url. Ties keep the order of the hits; of
    several shared categories the alphabetically first is named.
    """
    ent = F.coalesce(F.when(F.length("entity_name") > 0, F.col("entity_name")), F.when(F.length("host") > 0, F.col("host")), F.lit("unknown"))
    h = hits.withColumn("entity", ent).withColumn("cat", F.lower(F.coalesce(F.when(F.length("category") > 0, F.col("category")), F.lit("general"))))
    best = F.struct(F.col("score").alias("s"), (-F.col("position")).alias("p"))
    group = lambda by: h.groupBy("query_id", by).agg(F.max(best).alias("best"), F.max_by(F.struct(F.coalesce("final_url", "url").alias("url"), "entity"), best).alias("top"), F.min("position").alias("seen"), F.array_sort(F.collect_set("cat")).alias("cats"))  # noqa: E731  (a query's few hits)
    ranked = lambda df: df.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("best.s"), "seen")))
    ents, cats = ranked(group("entity")), ranked(group("cat"))
    a = ents.where(F.col("n") <= max(most // 2, 1)).select("query_id", F.lit(0).alias("part"), "n", F.lit(0).alias("m"), F.col("entity").alias("label"), F.lit("entity").alias("relationship"), F.col("best.s").alias("score"))
    b = cats.where(F.col("n") <= max(2, most // 4)).select("query_id", F.lit(1).alias("part"), "n", F.lit(0).alias("m"), F.concat(F.lit("theme:"), "cat").alias("label"), F.lit("category-theme").alias("relationship"), F.col("best.s").alias("score"))
    lead = ents.where("n <= 8").select("query_id", "n", "entity", "cats", F.col("best.s").alias("s"))
    right = lead.select("query_id", F.col("n").alias("m"), F.col("entity").alias("other"), F.col("cats").alias("cats2"), F.col("s").alias("s2"))
    pairs = lead.join(right, "query_id").where("n < m and arrays_overlap(cats, cats2)")  # at most 28 a query
    c = pairs.select("query_id", F.lit(2).alias("part"), "n", "m", F.concat_ws(" ↔ ", "entity", "other").alias("label"), F.concat(F.lit("co-occurs:"), F.array_min(F.array_intersect("cats", "cats2"))).alias("relationship"), F.least("s", "s2").alias("score"))
    w = Window.partitionBy("query_id").orderBy("part", "n", "m")
    return a.unionByName(b).unionByName(c).withColumn("position", F.row_number().over(w)).where(F.col("position") <= most).select("query_id", "position", "label", "relationship", "score")


def graph(points: DataFrame, queries: DataFrame, top_k: int, prefer_child: bool = False, index: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """P4, R10. (hits, themes): at least 12 hits are fetched, parents preferred unless children are asked for; themes come
    from all of them, the hits are cut back to top_k."""
    hits = hybrid(points, queries, max(top_k, 12), prefer_parent=not prefer_child, prefer_child=prefer_child, index=index)
    return hits.where(F.col("position") <= top_k), themes(hits)
