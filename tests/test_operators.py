import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import assets, checks, evidence, index, ops, reports, retrieve, sections, verify
from corpusmill.sources import tables
from corpusmill.streaming import streams

BLOCK = "struct<kind:string,text:string,level:int,ordered:boolean,cells:array<string>,html:string,anchors:array<struct<label:string,href:string>>>"
PAGE = f"page_id string, run_id string, origin string, url string, final_url string, title string, status_code string, robots_allowed string, failure_reason string, content_html string, blocks array<{BLOCK}>, crawled_at timestamp, arrived_at timestamp"


def block(kind, text=None, level=None, cells=None, anchors=()):
    return (kind, text, level, None, cells, None, list(anchors))


def page(spark, rows):
    import datetime as dt

    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(hours=k)
    return spark.createDataFrame([(i, "r", "https://a.example", f"https://a.example/{i}", None, None, "200", "t", None, None, b, at(k), at(k)) for k, (i, b) in enumerate(rows)], PAGE)


def test_sections(spark):
    link = [("L", " /x "), ("again", "/x"), ("", "/y"), ("none", " ")]
    blocks = [block("paragraph", "before"), block("heading", " One ", 2), block("paragraph", "text", anchors=link), block("heading", " ", 3), block("heading", "Two", 1), block("row", cells=["a", "b"])]
    got = sections.page_sections(page(spark, [("p", blocks), ("q", []), ("n", None), ("h", [block("heading", "Only")])])).orderBy("page_id", "section_index").collect()
    assert [(r.page_id, r.section_index, r.title, r.level, r.text) for r in got] == [("h", 0, "Only", None, "Only"), ("p", 0, None, None, "before"), ("p", 1, "One", 2, "One\n\ntext"), ("p", 2, "Two", 1, "Two\n\na | b")]
    assert [(a.label, a.href) for a in got[2].anchors] == [("L", "/x"), ("", "/y")]


def test_windows_are_slices_and_fit():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice(["ab", "c", " ", ". ", "é", "\n"]) for _ in range(rng.randrange(80)))
        size = rng.randrange(1, 12)
        overlap = rng.randrange(0, size)
        w = sections.token_windows(t, size, overlap)
        spans = sections.token_spans(t.strip())
        assert all(p in t and 0 < len(sections.token_spans(p)) <= size for p in w)
        if spans:
            assert w[0].startswith(t.strip()[: spans[0][1]]) and w[-1].endswith(t.strip()[spans[-1][0] :])
    with pytest.raises(ValueError):
        sections.token_windows("x", 511, 0)
    assert sections.embed_batches(["a b", "c", "d e f"], 2, 4) == [["a b", "c"], ["d e f"]]


def test_units_number_through_the_page(spark):
    long = " ".join(f"w{k}" for k in range(1200))
    df = sections.page_sections(page(spark, [("p", [block("heading", "A"), block("paragraph", long), block("heading", "B"), block("paragraph", "short")])]))
    u = sections.units(df).orderBy("child_index").collect()
    assert [r.child_index for r in u] == list(range(len(u))) and sorted({r.parent_index for r in u}) == list(range(u[-1].parent_index + 1))
    assert all(r.child_text in r.parent_text for r in u) and u[-1].section_title == "B" and u[-1].parent_text == "B\n\nshort"


def test_first_page_wins_against_the_loop(spark):
    rng = random.Random(3)
    rows = [(f"r{rng.randrange(2)}", f"p{rng.randrange(12):02}", f"d{rng.randrange(15)}") for _ in range(300)]
    at = {(r, p): rng.randrange(4) for r, p, _ in rows}
    df = spark.createDataFrame([(r, p, d, at[r, p]) for r, p, d in rows], "run_id string, page_id string, text_digest string, crawled_at int")
    want = []
    for run in ("r0", "r1"):
        owner = {}
        for p in sorted({p for r, p, _ in rows if r == run}, key=lambda p: (at[run, p], p)):
            own = [d for r, q, d in rows if (r, q) == (run, p)]
            want += [(run, p, d) for d in own if owner.setdefault(d, p) == p]
    got = [(r.run_id, r.page_id, r.text_digest) for r in index.first_page_wins(df).collect()]
    assert sorted(got) == sorted(want)


def test_index_run(spark):
    body = "The clerks of the town keep the ledger in a box that nobody but the owner has ever opened for them. " * 2
    rows = [("p1", [block("heading", "Ledger"), block("paragraph", body)]), ("p2", [block("paragraph", "Ledger"), block("paragraph", body)]), ("p3", [block("heading", "Ledger"), block("paragraph", body)]), ("p4", [block("paragraph", "Der Vertrag ist nicht das, was die Kunden von der Firma für sich wollten, und das auch. " * 3)])]
    nodes = index.index_run(page(spark, rows)).collect()
    assert {r.page_id for r in nodes} == {"p1"} and [r.chunk_role for r in nodes] == ["child"]
    points, fresh = index.embed_distinct(spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", " ")], "id string, embed_text string"))
    assert fresh.count() == 1 and {r.id: r.embedding is None for r in points.collect()} == {"a": False, "b": False, "c": True}
    again, none = index.embed_distinct(spark.createDataFrame([("a", "x y")], "id string, embed_text string"), fresh)
    assert none.count() == 0 and again.collect()[0].embedding is not None


def greedy(pool, k, collapse):
    pages, out, texts, lines = {}, [], set(), set()
    for r in pool:
        pages.setdefault(r[2], []).append(r)
    while len(out) < k:
        before = len(out)
        for q in pages.values():
            while q and len(out) < k:
                r = q.pop(0)
                if r[3] in texts:
                    continue
                texts.add(r[3])
                if collapse and r[4] in lines:
                    continue
                lines.add(r[4])
                out.append(r[0])
                break
        if len(out) == before:
            return out
    return out


@pytest.mark.parametrize("collapse", [False, True])
def test_page_diverse_selection(spark, collapse):
    rng = random.Random(9)
    rows, want = [], {}
    for q in range(40):
        pool = [(f"{q}-{k}", k + 1, f"p{rng.randrange(5)}", f"t{rng.randrange(9)}", f"l{rng.randrange(6)}") for k in range(rng.randrange(1, 25))]
        rows += [(q, *r) for r in pool]
        want[q] = greedy(pool, 7, collapse)
    df = spark.createDataFrame(rows, "query_id int, point_id string, rank int, page_key string, text string, lineage string")
    got = {}
    for r in retrieve.select_diverse(df, 7, collapse).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append(r.point_id)
    assert got == want


def test_fusion_keeps_dense_order_on_ties(spark):
    half = lambda ids_: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(ids_)], "query_id int, point_id string, rank int")
    got = [r.point_id for r in retrieve.fuse(half(["a", "b", "c"]), half(["d", "b", "a"]), 10).orderBy("rank").collect()]
    assert got == ["a", "b", "d", "c"] or got == ["b", "a", "d", "c"]
    score = {i: sum(1 / (60 + r) for r in rs) for i, rs in {"a": (1, 3), "b": (2, 2), "c": (3,), "d": (1,)}.items()}
    assert got == sorted(score, key=lambda i: -score[i])


def test_sparse_finds_the_name_the_dense_half_cannot(spark):
    p = spark.createDataFrame([("a", "plain words only", [1.0, 0.0]), ("b", "the Zorblatt report", [0.0, 1.0]), ("z", "", [0.0, 0.0])], "point_id string, embed_text string, embedding array<float>")
    q = spark.createDataFrame([(1, "zorblatt Zorblatt", [1.0, 0.0])], "query_id int, text string, vector array<float>")
    assert [r.point_id for r in retrieve.sparse_top_k(p, q, 3).collect()] == ["b"]
    assert [r.point_id for r in retrieve.dense_top_k(p, q, 1).collect()] == ["a"]


def test_quotes(spark):
    rows = [("p", [block("paragraph", "A long  enough quote stands here."), block("row", cells=["$15/month", "", "x"])]), ("bad", [block("paragraph", "x" * 20)])]
    pages = page(spark, rows).withColumn("status_code", F.when(F.col("page_id") == "bad", "404").otherwise("200"))
    asked = [(1, "p", "LONG enough  quote"), (2, "p", "$15/month"), (3, "p", "15/mon"), (4, "p", "—!!—"), (5, "bad", "x" * 15), (6, "gone", "y" * 15), (7, "p", None)]
    got = {r.quote_id: (r.found, r.reason) for r in verify.verify_quotes(spark.createDataFrame(asked, "quote_id int, page_id string, quote string"), pages).collect()}
    assert got == {1: (True, None), 2: (True, None), 3: (False, "quote_not_found"), 4: (False, "quote_not_found"), 5: (False, "page_not_citable:http_error"), 6: (False, "page_not_found"), 7: (False, "quote_not_found")}


def test_entities_of_hosts(spark):
    e = spark.createDataFrame([("e2", "Two", "s", "a.example", 2), ("e1", "One", "s", "x.a.example", 1), ("e3", "No", "s", "example.org", 0)], "entity_id string, entity_name string, source_type string, domain string, ord int")
    h = spark.createDataFrame([("x.a.example",), ("y.a.example",), ("xa.example",), ("",)], "host string")
    assert {r.host: r.entity_id for r in index.resolve_entities(h, e).collect()} == {"x.a.example": "e1", "y.a.example": "e2"}


def test_allow_lists_fail_closed(spark):
    p = spark.createDataFrame([("o", "a", 1), ("o", "b", 1)], "owner_id string, asset_id string, v int")
    e = spark.createDataFrame([("o", "a")], "owner_id string, asset_id string")
    keys = ["owner_id", "asset_id"]
    assert [r.asset_id for r in assets.allowed(p, e, keys).collect()] == ["a"]
    with pytest.raises(ValueError):
        assets.assert_allowed(p, e, keys)
    body = "One two three. " * 200
    chunks = assets.chunk_offsets(body.strip())
    assert all(body[a:b] == t for a, b, t in chunks) and len(chunks) > 2


def test_purge_and_contracts(spark):
    runs = spark.createDataFrame([("a",), ("b",)], "run_id string")
    assert [r.run_id for r in ops.purge_except(runs, spark.createDataFrame([("a",)], "run_id string")).collect()] == ["b"]
    with pytest.raises(ValueError):
        ops.purge_except(runs, spark.createDataFrame([("z",)], "run_id string"))
    with pytest.raises(ValueError):
        ops.purge_except(runs, spark.createDataFrame([("a",)], "run_id string"), spark.createDataFrame([("b", True)], "run_id string, live boolean"))


def test_readiness_golden(spark):
    t = "# Title\nA short answer first. By 2021 it grew 40%.\n## Why so?\nBecause it is.\n#### Sources\naccording to them"
    docs = spark.createDataFrame([("s", t, False), ("part", "plain words", True)], "source_id string, text string, partial boolean")
    d = {(r.source_id, r.dimension): r.score for r in reports.readiness_dimensions(docs).collect()}
    assert d["s", "headingHierarchy"] == 80 and d["s", "answerFirst"] == 100 and d["s", "faq"] == 70 and d["s", "schema"] is None and d["s", "eeat"] == 60 and d["s", "technicalCrawlabilityPerformance"] is None
    assert d["part", "headingHierarchy"] is None and d["part", "faq"] is None and d["part", "eeat"] is None
    whole = {r.source_id: r for r in reports.readiness(docs).collect()}
    assert whole["s"].overall is None and whole["s"].fixes[0] == reports.FIXES["factDensity"]


def test_tri_state_gaps(spark):
    rows = [("s", "nothing", True, "subject"), ("c1", "## Topic A\nBook a demo", False, "competitor"), ("c2", "plain", False, "competitor")]
    g = {(r.dimension, r.signal): (r.status, r.confidence) for r in reports.content_gaps(spark.createDataFrame(rows, "source_id string, text string, partial boolean, role string")).collect()}
    assert g["callsToAction", None] == ("coverageUnknown", "unknown") and g["topics", "Topic A"] == ("coverageUnknown", "unknown")
    rows[0] = ("s", "nothing", False, "subject")
    g = {(r.dimension, r.signal): (r.status, r.confidence) for r in reports.content_gaps(spark.createDataFrame(rows, "source_id string, text string, partial boolean, role string")).collect()}
    assert g["callsToAction", None] == ("supportedGap", "medium") and g["topics", "Topic A"] == ("supportedGap", "medium")


def test_tables(spark, tmp_path):
    path = str(tmp_path / "points")
    row = lambda i, r, v: (i, r, [v, 0.0])
    make = lambda rows: spark.createDataFrame(rows, "point_id string, run_id string, embedding array<double>")
    tables.write_run(make([row("a", "r1", 1.0), row("b", "r2", 1.0)]), path)
    tables.write_run(make([row("c", "r1", 2.0)]), path)
    assert {(r.point_id, r.run_id) for r in spark.read.parquet(path).collect()} == {("c", "r1"), ("b", "r2")}
    tables.check_points(make([row("a", "r", 1.0)]), 2)
    with pytest.raises(ValueError):
        tables.check_points(make([row("a", "r", 1.0)]), 3)
    assert tables.delete_where_run(path, spark, "r1") and not tables.delete_where_run(path, spark, "r1")
    assert tables.exists(spark, path) and tables.exists(spark, path + "-none") is False
    raw = spark.createDataFrame([(None, "x", 1)], "ContentHtml string, contentHtml string, RunId int")
    assert tables.decode_documents(raw).columns == ["content_html", "run_id"] and tables.decode_documents(raw).first().content_html == "x"
    folder = tmp_path / "cache" / "run1"
    folder.mkdir(parents=True)
    (folder / "a.blocks.json").write_text('[{"kind":"paragraph","text":"x"}]')
    (folder / "b.blocks.json").write_text("not json")
    got = {r.file.rpartition("/")[2]: r for r in tables.block_files(spark, str(tmp_path / "cache")).collect()}
    assert got["a.blocks.json"].blocks[0].text == "x" and got["a.blocks.json"].run_id == "run1" and got["b.blocks.json"].blocks is None


def test_stream_equals_batch(spark, tmp_path):
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for k in range(3):
        spark.createDataFrame([("r", f"d{(k * 3 + j) % 5}", at(k * 30 + j)) for j in range(4)], "run_id string, text_digest string, ts timestamp").coalesce(1).write.mode("append").parquet(str(tmp_path / "n.parquet"))
    batch = spark.read.parquet(str(tmp_path / "n.parquet"))
    got = streams.run_available(streams.first_texts(streams.table_stream(spark, str(tmp_path), "n", 1).select("run_id", "text_digest")), "t")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.select("run_id", "text_digest").distinct().collect()))
    assert streams.lease_spans(batch, "run_id", "ts").count() == 3
    assert streams.run_available(streams.claim_once(streams.table_stream(spark, str(tmp_path), "n", 1).select("text_digest", "ts"), "text_digest", "ts", "5 hours"), "c").count() == 5


def test_empty_tables_everywhere(spark):
    p = page(spark, []).where("page_id is not null")
    assert index.index_run(p).count() == 0
    assert ops.block_report(p).count() <= 1 and ops.cleanup_counts(p).first().kept == 0
    d = spark.createDataFrame([], "source_id string, text string, partial boolean, role string")
    for df in (reports.readiness(d), reports.claims(d), reports.entities(d), reports.relationships(d), reports.content_gaps(d), reports.schema_nodes(d)):
        assert df.count() == 0


def test_checks(spark):
    spans = spark.createDataFrame([(1, None, None), (2, 0, 3), (3, 5, None), (4, 3, 3), (5, -1, 2)], "id int, start_char int, end_char int")
    assert {r.id for r in checks.broken_spans(spans).collect()} == {3, 4, 5}
    q = spark.createDataFrame([("observed", None, None), ("observed", "s", None), ("generatedHypothesis", None, None)], "origin string, source_id string, source_reference string")
    assert checks.without_source(q).count() == 1
    d = spark.createDataFrame([("x", "0" * 64), ("x", None)], "body string, digest string")
    with pytest.raises(ValueError):
        checks.require_none(checks.wrong_digests(d, "body", "digest"), "a digest is wrong")
    e = spark.createDataFrame([("o", "approved", None), ("o", "revoked", None)], "owner_id string, lifecycle string, expires_at timestamp")
    assert checks.executable_entries(e).count() == 1
    with pytest.raises(ValueError):
        checks.executable_entries(e.unionByName(e.withColumn("owner_id", F.lit("p"))))


def test_batches_keep_both_limits(spark):
    df = spark.createDataFrame([(k, "w " * (k % 7 + 1)) for k in range(100)], "i int, t string").coalesce(2)
    got = sections.batched(df, "i", "t", 5, 20).groupBy("task", "batch").agg(F.count("*").alias("n"), F.sum(F.col("i") % 7 + 1).alias("tokens")).collect()
    assert all(r.n <= 5 and r.tokens <= 20 for r in got) and sum(r.n for r in got) == 100


def test_graph_query(spark):
    rows = [(f"p{k}", f"pg{k % 4}", "Alpha" if k % 2 else "Beta", "docs", f"text about ledgers number {k}", [1.0, float(k)]) for k in range(20)]
    p = spark.createDataFrame(rows, "point_id string, page_id string, entity_name string, category string, embed_text string, embedding array<float>")
    p = p.selectExpr("*", "embed_text as child_text", "embed_text as parent_text", "'s' as section_title", "'https://a.example' as url", "'https://a.example' as final_url", "'a.example' as host")
    q = spark.createDataFrame([(1, "ledgers", [1.0, 3.0])], "query_id int, text string, vector array<float>")
    hits, found = retrieve.graph(p, q, 3)
    assert hits.count() == 3 and {r.relationship for r in found.collect()} == {"entity", "category-theme", "co-occurs:docs"}


def test_lease_and_claim_streams_equal_batch_over_unordered_files(spark, tmp_path):
    """More files than a trigger takes, the newest first: no span is left open and no event is dropped as late."""
    import datetime as dt

    import __spark_entry__

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    for k in reversed(range(18)):
        rows = [(k * 3 + j, (k + j) % 4, at(k * 40 + j * 5), "a", 1.0) for j in range(3)]
        spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(str(tmp_path / "events.parquet"))
    plain = lambda v: f"{v:%Y-%m-%d %H:%M:%S.%f}" if isinstance(v, dt.datetime) else v
    run = lambda name: sorted(tuple(map(plain, r)) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect())
    assert run("t03_lease_stream") == run("t03_lease_spans") != []
    assert run("t05_claim_once") == [(k,) for k in range(54)]


def test_no_entry_is_cut(spark):
    points = spark.range(1200).withColumnRenamed("id", "k")
    assert assets.allowed(points, points, ["k"]).count() == 1200


def test_first_entities_by_ord(spark):
    few = spark.range(6000).selectExpr("cast(id as string) entity_id", "'n' entity_name", "'t' source_type", "concat('h', id, '.example') domain", "6000 - id as ord")
    hosts = spark.createDataFrame([("h5999.example",), ("h0.example",)], "host string")
    assert [r.host for r in index.resolve_entities(hosts, few).collect()] == ["h5999.example"]


def test_page_units_are_the_units_of_the_page(spark):
    body = " ".join(f"word{k} sits here." for k in range(400))
    rows = [("p1", [block("heading", "One"), block("paragraph", body), block("heading", "Two"), block("paragraph", "short text")]), ("p2", [block("paragraph", body + body)]), ("p3", []), ("p4", [block("paragraph", " ")])]
    df = page(spark, rows)
    one = {(r.page_id, r.parent_index, r.child_index, r.parent_text, r.child_text, r.section_title) for r in sections.units(sections.page_sections(df)).collect()}
    two = sections.page_units(df, ()).select("page_id", "parent_index", "section_title", "parent_text", F.explode("children").alias("c")).collect()
    assert one == {(r.page_id, r.parent_index, r.c.child_index, r.parent_text, r.c.text, r.section_title) for r in two} and len(one) > 10


def test_index_counts_add_up(spark):
    body = "The clerks of the town keep the ledger in a box that nobody but the owner has ever opened for them. " * 2
    rows = [("p1", [block("heading", "Ledger"), block("paragraph", body)]), ("p2", [block("heading", "Ledger"), block("paragraph", body)]), ("p3", [block("paragraph", "Home")]), ("p4", [block("paragraph", "Der Vertrag ist nicht das, was die Kunden von der Firma für sich wollten, und das auch. " * 3)]), ("p5", [])]
    df = page(spark, rows)
    r = index.index_counts(df).collect()
    assert sum(x.pages_seen for x in r) == 5 and sum(x.skipped_unusable for x in r) == 5 - sum(x.pages_english for x in r)
    assert sum(x.skipped_lang for x in r) == 2 and sum(x.skipped_empty for x in r) == 3
    assert sum(x.chunks_upserted for x in r) == index.index_run(df).count() == 1 and sum(x.chunks_skipped_repeat for x in r) == 1
    with pytest.raises(ValueError):
        index.index_run(df, most_pages=4)


def test_pages_without_a_run_are_indexed(spark):
    body = "The clerks of the town keep the ledger in a box that nobody but the owner has ever opened for them. " * 2
    df = page(spark, [("p1", [block("paragraph", body)]), ("p2", [block("paragraph", body)])]).withColumn("run_id", F.lit(None).cast("string"))
    assert [r.page_id for r in index.index_run(df).collect()] == ["p1"]


def test_latest_pages_equals_latest(spark):
    df = spark.range(60).selectExpr("cast(id % 45 as string) page_id", "timestamp_seconds(id) arrived_at", "id x").unionByName(spark.sql("select cast(null as string) page_id, timestamp_seconds(1) arrived_at, 1L x"))
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(index.latest_pages(df)) == rows(index.latest(df, "page_id", "arrived_at"))


def test_reranked_pool(spark):
    pool = spark.createDataFrame([(1, f"p{k}", k, "red ledger" if k == 60 else "blue box red" if k == 7 else "x", "red ledger") for k in range(1, 70)], "query_id int, point_id string, rank int, document string, query_text string")
    got = retrieve.rerank(pool, 8, retrieve.overlap_score).orderBy("rank").collect()
    assert len(got) == 40 and [r.point_id for r in got][:3] == ["p7", "p1", "p2"] and got[0].score == 0.5


def test_hybrid_with_conditions_and_reranker(spark):
    rows = [(f"p{k}", f"pg{k}", "child" if k % 2 else "parent", "en", f"text about ledgers number {k}", [1.0, float(k)]) for k in range(20)]
    p = spark.createDataFrame(rows, "point_id string, page_id string, chunk_role string, language string, embed_text string, embedding array<float>")
    p = p.selectExpr("*", "embed_text as child_text", "embed_text as parent_text", "'s' as section_title", "'https://a.example' as url", "'https://a.example' as final_url")
    q = spark.createDataFrame([(1, "ledgers number 9", [1.0, 3.0])], "query_id int, text string, vector array<float>")
    hits = retrieve.hybrid(p, q, 4, prefer_child=True, reranker=retrieve.overlap_score, language="en").orderBy("position").collect()
    assert [h.point_id for h in hits][0] == "p9" and {h.chunk_role for h in hits} == {"child"} and len(hits) == 4


def test_query_sets_in_blocks(spark, monkeypatch):
    rows = [(k, [float(k % 7), float(k % 5) + 1]) for k in range(50)]
    p = spark.createDataFrame(rows, "point_id int, embedding array<float>")
    q = p.selectExpr("point_id as query_id", "embedding as vector")
    whole = sorted(map(tuple, retrieve.dense_top_k(p, q, 3).collect()))
    monkeypatch.setattr(retrieve, "QUERY_BYTES", 600)
    assert sorted(map(tuple, retrieve.dense_top_k(p, q, 3).collect())) == whole and len(whole) == 150


def test_terms_of_any_script(spark):
    p = spark.createDataFrame([("a", "Договор и счёт"), ("b", "the ledger")], "point_id string, embed_text string")
    q = spark.createDataFrame([(1, "счёт")], "query_id int, text string")
    assert [r.point_id for r in retrieve.sparse_top_k(p, q, 5).collect()] == ["a"]


def test_fallback_entity(spark):
    hosts = spark.createDataFrame([("docs.a.example", "Site"), ("b.example", None), ("", "x"), (None, "x")], "host string, t string")
    e = spark.createDataFrame([("1", "A", "brand", "a.example", 0)], "entity_id string, entity_name string, source_type string, domain string, ord int")
    got = {tuple(r) for r in index.resolve_entities(hosts, e, crawl_type="t").collect()}
    assert got == {("docs.a.example", "Site", "1", "A", "brand"), ("b.example", None, None, "b.example", "unknown")}


def test_evidence(spark):
    df = spark.createDataFrame([("s", "ab. Cdefghijklmnopq rs.", 4, 7), ("s", "ab", 0, 2)], "source_id string, text string, a int, b int")
    left = [tuple(r.e) for r in df.select(evidence.widened(F.col("text"), F.col("a"), F.col("b")).alias("e")).collect()]
    both = [tuple(r.e) for r in df.select(evidence.widened(F.col("text"), F.col("a"), F.col("b"), True).alias("e")).collect()]
    assert left == [(0, 12, "ab. Cdefghij"), (0, 2, "ab")] and both == [(0, 13, "ab. Cdefghijk"), (0, 2, "ab")]
    w = evidence.warnings(spark.createDataFrame([("s", "x", True, "0" * 64), ("t", "x", False, None)], "source_id string, text string, partial boolean, source_digest string")).collect()
    assert {r.source_id: len(r.warnings) for r in w} == {"s": 3, "t": 1}
    at = spark.createDataFrame([("2026-09-24 12:32:44.213000+00",), ("2026-09-24T12:32:44Z",), ("2026-09-24T14:32+02:00",), ("2026-09-24",), ("soon",), ("",), (None,)], "x string")
    got = [r[0] for r in at.select(F.unix_seconds(evidence.ready_at(F.col("x")))).collect()]
    assert got == [1790253164, 1790253164, 1790253120, 1790208000, None, None, None]
    pages, links, gone = evidence.delete_page(df.selectExpr("source_id as page_id"), df.selectExpr("source_id as page_id"), "s")
    assert (pages.count(), links.count(), gone.first()[0]) == (0, 0, 2)
    assert evidence.delete_page(pages, links, "")[2].first()[0] == 0


def test_no_machine_local_folder_on_a_cluster(spark, monkeypatch):
    from corpusmill import session

    class Context:
        master = "spark://x:7077"
        getCheckpointDir = staticmethod(lambda: None)
        getConf = staticmethod(lambda: {})

    with pytest.raises(ValueError):
        session.shared_dir(type("S", (), {"sparkContext": Context()})())


def test_a_text_over_the_batch_limit_is_an_error(spark):
    df = spark.createDataFrame([(1, "a b c d")], "i int, t string")
    with pytest.raises(Exception, match="more tokens"):
        sections.batched(df, "i", "t", 5, 3).collect()


def manifest(spark, n=3, **change):
    rows = [("o", "a", f"v{k}", f"r{k}", f"{k}" * 4, "d", "approved", None) for k in range(n)]
    return spark.createDataFrame(rows, "owner_id string, asset_id string, asset_version_id string, resource_id string, resource_digest string, asset_version_digest string, lifecycle string, expires_at timestamp").withColumns(change)


def test_governed_assets_from_revision_to_hit(spark):
    e = manifest(spark)
    revisions = e.drop("lifecycle", "expires_at").withColumn("text", F.concat(F.lit("the ledger of box "), "resource_id"))
    sources = spark.createDataFrame([("0000", 0, 5, "first", 1), ("0000", 0, 50, "second", 2)], "resource_digest string, start_char int, end_char int, label string, ord int")
    points, fresh = assets.index_assets(revisions, e.withColumn("lifecycle", F.when(F.col("resource_id") == "r2", "revoked").otherwise("approved")), sources)
    got = {r.resource_id: r for r in points.collect()}
    assert set(got) == {"r0", "r1"} and got["r0"].source_label == "first" and got["r1"].source_label is None and fresh.count() == 2
    q = points.where("resource_id = 'r1'").select(F.lit(1).alias("query_id"), F.col("embedding").alias("vector"))
    assert [r.resource_id for r in assets.query_assets(points, e, q, 1).collect()] == ["r1"]
    assert {r.resource_id for r in assets.delete_revision(points, e, "v1", "r1").collect()} == {"r0"}
    with pytest.raises(ValueError):
        assets.delete_revision(points, e, "v9", "r1")
    with pytest.raises(ValueError):
        assets.query_assets(points, e.unionByName(e), q, 1)
    with pytest.raises(ValueError):
        assets.index_assets(revisions, manifest(spark, 501))


def test_gate_sample(spark):
    rows = [("p1", "r", "NetSuite and NetSuite and YouTube", "Title", "x" * 100, None), ("p2", "r", "NetSuite uses AvaTax 1.2.3", "", "y", None), ("p3", None, "ZipLine", "T", "z" * 99, None), ("p4", "r", "the acme box", "T", "short", "Acme")]
    df = spark.createDataFrame(rows, "point_id string, run_id string, child_text string, section_title string, parent_text string, entity_name string").withColumn("host", F.lit("h"))
    got = {(r.stratum, r.need) for r in ops.gate_sample(df).collect()}
    assert got == {("literal", "NetSuite"), ("literal", "AvaTax"), ("wide_parent", "Title")}
    asked = spark.createDataFrame([(1, "literal", "AvaTax"), (2, "wide_parent", None)], "query_id int, stratum string, expect_literal string")
    hits = spark.createDataFrame([(1, 1, "none"), (1, 2, "an avatax")], "query_id int, position int, text string")
    assert {(r.stratum, r.rank, r.returned) for r in ops.gate_results(asked, hits).collect()} == {("literal", 2, 2), ("wide_parent", None, 0)}


def test_schema_checks(spark):
    text = "# The box\nWhy now?\nBecause\nof rain.\n\n1. Open it.\nName: Box\nDescription: a box"
    df = spark.createDataFrame([("s", text), ("t", "1. Only a step."), ("u", "nothing")], "source_id string, text string")
    got = {(r.source_id, r.type, r.code): r.valid for r in reports.schema_checks(df).collect()}
    assert len(got) == 15 and all(v for (_, _, c), v in got.items() if c == "jsonSyntax")
    # the lines of an answer are joined, so it does not stand in the text as it is; a list of steps without a title has no name
    assert not got["s", "FAQPage", "visibleContent"] and got["s", "Article", "visibleContent"] and got["s", "Product", "schemaShape"]
    assert not got["t", "HowTo", "schemaShape"] and got["t", "HowTo", "visibleContent"]
