import hashlib
import re
import uuid

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import classify, generators, ids, language, text, tokens, urls


def values(spark, rows, schema, *cols):
    df = spark.createDataFrame(rows, schema)
    return [r[0] if len(cols) == 1 else tuple(r) for r in df.select(*cols).collect()]


def test_clean_prose(spark):
    given = [("  a  b \xa0",), ("x \\u003cb\\u003e y \\u0026 z",), ("u003cdiv class=u0022au0022u003eTwo   words",), (None,), ("",)]
    assert values(spark, given, "t string", text.clean_prose("t")) == ["a  b", "x <b> y & z", "Two words", None, ""]


BLOCK = "struct<kind:string,text:string,level:int,cells:array<string>,anchors:array<struct<label:string,href:string>>>"


def test_blocks_to_text_and_title(spark):
    blocks = [("heading", " ", 1, None, None), ("heading", " Head ", 2, None, None), ("row", None, None, ["a", None, " ", "b"], None), ("code", " <x>  y ", None, None, None), ("paragraph", None, None, None, None)]
    got = values(spark, [(blocks, None), (None, " T "), ([], None)], f"b array<{BLOCK}>, t string", text.plain_text("b"), text.page_title("t", "b"))
    assert got == [("Head\n\na |  | b\n\n<x>  y", "Head"), ("", "T"), ("", None)]


def test_whitespace_is_pythons(spark):
    blanks = "".join(chr(c) for c in range(0x3100) if chr(c).isspace())
    assert values(spark, [(blanks + "x" + blanks,)], "t string", text.strip("t")) == ["x"]
    assert values(spark, [("a" + blanks + "b",)], "t string", text.collapse("t")) == ["a b"]


@pytest.mark.parametrize(
    ("t", "title", "stub"),
    [("", None, True), ("Pricing plans", "pricing  PLANS", True), ("Home / Products / Card reader", None, True), ("one two three four five six seven", None, True), ("one two three four five six seven eight", None, False), ("We answer 24/7 and every call is logged by hand", "x", False)],
)
def test_stubs(spark, t, title, stub):
    assert values(spark, [(t, title)], "t string, s string", text.is_stub("t", "s")) == [stub]


def test_sentences(spark):
    t = "One is here. Two!\n- Three is a list:\nFour? x"
    want = [p.strip(" \n-*") for p in re.split(r"(?<=[.!?])(?:\s+|$)|(?<=:)\n", t) if len(p.strip(" \n-*")) >= 3]
    assert values(spark, [(t,)], "t string", text.sentences("t")) == [want] == [generators.split_sentences(t)]


@pytest.mark.parametrize(
    ("raw", "number", "flag"),
    [("200", 200, True), (" 404 ", 404, True), ("200.0", 200, True), ("1", 1, True), ("0", 0, False), ("t", None, True), ("No", None, False), ("", None, None), ("abc", None, None), (None, None, None)],
)
def test_value_shapes(spark, raw, number, flag):
    assert values(spark, [(raw,)], "x string", classify.int_of("x"), classify.bool_of("x")) == [(number, flag)]


@pytest.mark.parametrize(
    ("url", "locale", "sitemap"),
    [("https://a.b/us/x", False, False), ("https://a.b/de/x", True, False), ("https://a.b/en-gb/", False, False), ("https://a.b/fr-CA", True, False), ("https://a.b/", False, False), ("not a url", False, False), ("https://a.b/x/sitemap_index.xml", False, True), ("https://a.b/product-sitemap.xml?x", False, True), ("https://a.b/how-to-build-a-sitemap", False, False), (None, False, False), ("https://a.b:99/zu", True, False)],
)
def test_paths(spark, url, locale, sitemap):
    assert values(spark, [(url,)], "u string", urls.is_locale_path("u"), urls.is_sitemap("u")) == [(locale, sitemap)]


def test_unusable_order(spark):
    one = [("paragraph", "x", None, None, None)]
    rows = [("https://a/de/", None, 404, False, "x", one), ("https://a/p", None, 404, False, "x", one), ("https://a/sitemap", None, 0, False, "x", one), ("https://a/p", None, None, False, None, one), ("https://a/p", None, None, None, " x ", one), ("https://a/p", None, None, None, " ", []), ("https://a/p", "", 200, True, None, one), ("https://a/p", "https://a/ja/", 200, True, None, one)]
    got = values(spark, rows, f"u string, f string, s int, r boolean, x string, b array<{BLOCK}>", classify.unusable_reason("u", "f", F.col("s"), F.col("r"), "x", "b"))
    assert got == ["locale", "http_error", "sitemap", "failure", "failure", "no_content", None, "locale"]


def test_hosts(spark):
    rows = [("https://U:p@WWW.A.example:80/x", None), (None, "b.example/y"), ("", "http://C.example"), (" ", None)]
    assert values(spark, rows, "o string, u string", urls.host_of("o", "u")) == ["www.a.example", "b.example", "c.example", ""]
    assert values(spark, rows[:1] + [("localhost", None)], "o string, u string", urls.host_candidates("o")) == [["www.a.example", "a.example"], []]


def test_tags_and_category(spark):
    got = values(spark, [("https://a/Docs/API Reference!/index.html", "How to use it with Ledgers and Books today")], "u string, t string", urls.tags("u", "t"), classify.category("u", "t"))
    assert got == [(["docs", "api-reference", "how", "use", "with", "ledgers"], "docs")]


def test_ids(spark):
    names = ["run:page:child:0", "ü:é:parent:1", ""]
    assert values(spark, [(n,) for n in names], "n string", ids.uuid5("n")) == [str(uuid.uuid5(ids.POINTS, n)) for n in names]
    want = hashlib.sha256("\x1f".join(["a", "b", ""]).encode()).hexdigest()[:24]
    assert values(spark, [("b", None)], "x string, y string", ids.stable_id("a", F.col("x"), F.col("y"))) == [want]
    value = {"b": 1, "a": ["é"]}
    assert ids.canonical_json(value) == '{"a":["é"],"b":1}'.encode()
    signature = ids.sign(value, b"key")
    assert ids.verify(value, "a2V5", signature) and not ids.verify({**value, "b": 2}, "a2V5", signature)


def test_sanitize(spark):
    assert values(spark, [("a\x00​b­c﻿\td",), (None,)], "t string", text.sanitize("t")) == ["abc\td", ""]


def test_tokens_as_python_counts_them(spark):
    samples = ["It's 9.5% — ok_1", "é́ x\xa0y", "日本語 テスト", "🧾 a b", "", "²½ ๙"]
    assert values(spark, [(t,) for t in samples], "t string", tokens.token_count(F.col("t"))) == [len(re.findall(r"\w+|[^\w\s]", t)) for t in samples]


def test_language(spark):
    rows = [("The ledger of the firm is not what it was when the clerks and the owners met.",), ("Der Vertrag ist nicht das, was die Kunden von der Firma für sich wollten, und das auch.",), ("short",), (None,)]
    assert values(spark, rows, "t string", language.language(F.col("t"))) == ["en", "de", None, None]


def test_query_rules(spark):
    rows = [("best ledger software alternatives", "observed"), ("Login to Docs", "imported"), ("buy it", "generatedHypothesis"), ("the", "observed")]
    got = values(spark, rows, "q string, o string", classify.query_class("q")["intent"], classify.query_signals("q", "o")["score"], classify.query_signals("q", "o")["tier"], classify.cluster_label("q"))
    assert got == [("commercial", 80, "high", "ledger software"), ("navigational", 60, "medium", "login docs"), ("transactional", 50, "medium", "it"), ("informational", 60, "medium", "general")]


def test_generators():
    t = "Intro here.\n# One\nQ: Why now?\nA: Because.\n\n## Two\n1. First step\nAda Lovelace of London met Bob."
    assert [s[1] for s in generators.split_sections(t)] == ["Preamble", "One", "Two"]
    assert generators.question_pairs(t) == [("Why now?", "Because.")]
    assert all(t[a:b] == s for s, a, b in generators.sentence_spans(t))
    assert [e[0] for e in generators.entity_spans(t)][-2:] == ["Ada Lovelace of London", "Bob"] or "Bob." in [e[0] for e in generators.entity_spans(t)]
    assert all(t[a:b] == q for _, a, b, q in generators.dimension_spans(t))
    assert generators.html_lines("<h2>A <b>b</b></h2><script>x</script><ul><li>c</ul><p>d &amp; e</p>") == "## A b\n- c\nd & e"
    assert generators.content_strings({"@type": "X", "name": "n", "list": [{"text": "t", "url": "u"}]}) == ["n", "t"]
