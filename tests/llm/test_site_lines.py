from pyspark.sql import functions as F

from corpusmill.functions.sites import site
from corpusmill.llm.site_lines import remove_repeated_lines, repeated_lines

SCHEMA = "page_id string, origin string, blocks array<struct<kind:string,text:string>>, line string, h int"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], SCHEMA)



def test_counts_distinct_pages_of_one_site(spark):
    spelled = ["https://A.example", "http://www.a.example/", "HTTPS://a.example:443", "a.example", "https://www.A.EXAMPLE"]
    rows = [(f"p{k}", o, [("paragraph", f"body {'abcdefgh'[k]}\nShare THIS, 2{k}!"), ("code", "share this"), ("paragraph", None), ("paragraph", "12 34")]) for k, o in enumerate(spelled)]
    rows += [rows[0], ("q1", "https://b.a.example", [("paragraph", "share this")]), (None, "a.example", [("paragraph", "share this")]), ("q2", None, [("paragraph", "share this")]), ("q3", "a.example", None), ("q4", "a.example", [])]
    df = pages(spark, rows)
    found = {tuple(r) for r in repeated_lines(df, "page_id", site("origin"), "blocks", 5, width=4).collect()}
    assert found == {(f"p{k}", 0, 1) for k in range(5)}
    assert repeated_lines(df, "page_id", site("origin"), "blocks", 6).count() == 0
    out = {r.page_id: r for r in remove_repeated_lines(df, "page_id", site("origin"), "blocks", 5).collect()}
    assert out["p1"].blocks[0].text == "body b" and out["p1"].blocks[1].text == "share this" and out["p1"].blocks[2].text is None
    assert out["q1"].blocks[0].text == "share this" and out["q3"].blocks is None and out["p1"].line == "clash"
    assert remove_repeated_lines(df, "page_id", site("origin"), "blocks", 5).count() == len(rows)


def test_same_line_often_on_one_page_is_no_case(spark):
    df = pages(spark, [("p", "a.example", [("paragraph", "x\nx\nx\nx\nx\nx")])])
    assert repeated_lines(df, "page_id", site("origin"), "blocks", 5).count() == 0


def test_empty(spark):
    df = pages(spark, [])
    assert repeated_lines(df, "page_id", site("origin"), "blocks").count() == 0
    assert remove_repeated_lines(df, "page_id", site("origin"), "blocks").count() == 0


def test_site_forms(spark):
    df = spark.createDataFrame([("https://u:p@WWW.x.example:80/path?q",), (None,), ("",), ("  x.example/ ",)], "o string")
    assert [r[0] for r in df.select(site(F.col("o"))).collect()] == ["x.example", None, "", "x.example"]
