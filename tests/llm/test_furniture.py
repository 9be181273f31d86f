import random

from corpusmill.functions.sites import site
from corpusmill.llm.furniture import Tree, furniture, main_blocks

SCHEMA = "page_id string, origin string, blocks array<struct<kind:string,text:string,cells:array<string>,anchors:array<struct<label:string,href:string>>>>, content_html string, pos string, src int"
TAGS = {"heading": "h2", "paragraph": "p", "listItem": "li", "code": "pre"}


def block(kind, text, link=False):
    return (kind, text, None, [(text, "https://x.example/")] if link else [])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))


def page(rng, number, host, brand, classes, markup=True):
    body = [block("heading", f"Title {words(rng, 5)}")] + [block("paragraph", words(rng, 12) + ".") for _ in range(rng.randrange(2, 6))]
    body.append(block("heading", "Help center"))
    body.append(block("paragraph", f"Real text {words(rng, 5)} here.\nShare this with your team"))
    nav = [block("listItem", t, True) for t in ("Home", "Pricing", "Help center")]
    more = [block("heading", "Related"), *[block("listItem", f"Story {words(rng, 4)}", True) for _ in range(2)], block("paragraph", "")]
    foot = [block("paragraph", f"(c) {brand} Ltd. All rights reserved."), block("paragraph", "Share this with your team")]
    parts = [(classes[0], nav), (classes[1], body), (classes[2], more), (classes[3], foot)]
    blocks = [b for _, p in parts for b in p]
    html = "".join(f'<div class="{c}">' + "".join(f"<{TAGS[b[0]]}>{b[1]}</{TAGS[b[0]]}>" for b in p) + "</div>" for c, p in parts)
    first = len(nav) + len(body)
    want = {(str(number), k) for k, b in enumerate(blocks) if b[1] and not len(nav) <= k < first}
    return (str(number), host, blocks, html if markup else None, "clash", 1), want


def site_pages(rng, many):
    rows, want = [], set()
    for k in range(many):
        h = k % 3
        classes = [("m", "b", "x", "f"), ("q1", "q2", "q3", "q4"), ("nav", "text", "aside", "end")][h]
        r, w = page(rng, k, ["https://one.example", "HTTPS://www.one.example/", "http://two.example", "three.example"][(0, 2, 3)[h] if k % 2 or h else 1], "ONE two Three".split()[h], classes, k % 5 != 0)
        rows.append(r)
        want |= w
    return rows, want


def test_containers_and_pages_without_markup(spark):
    rows, want = site_pages(random.Random(3), 90)
    df = spark.createDataFrame(rows + rows[:7] + [("n1", "one.example", None, None, "", 0), ("n2", "one.example", [], "<p>x</p>", "", 0), (None, "one.example", rows[0][2], None, "", 0), ("n3", None, rows[0][2], None, "", 0), ("n4", "four.example", [(None, None, None, None)], None, "", 0)], SCHEMA)
    got = {tuple(r) for r in furniture(df, "page_id", site("origin"), "blocks", "content_html").collect()}
    assert got == want
    out = {r.page_id: r for r in main_blocks(df, "page_id", site("origin"), "blocks", "content_html").collect()}
    kept = [b.text for b in out["0"].blocks if b.text]
    assert kept[0].startswith("Title") and kept[-1].endswith("team") and out["n1"].blocks is None and out["0"].pos == "clash"
    assert main_blocks(df, "page_id", site("origin"), "blocks", "content_html").count() == df.count()


def test_empty(spark):
    assert furniture(spark.createDataFrame([], SCHEMA), "page_id", site("origin"), "blocks", "content_html").count() == 0


def test_markup_reading():
    html = '<!-- <p>no</p> --><body><nav id="a"><ul><li><a href="/">One</a><li>Two</ul></nav><br><main><p>Three &amp; four<h2>Five</h2><blockquote><p>Six</p></blockquote></main><script>"<p>"</script></body>'
    tree = Tree(html)
    assert tree.signatures == ['nav id="a"', 'nav id="a"', "main", "main", "main"][: len(tree.signatures)]
    blocks = [{"text": t, "cells": None} for t in ("Two", "Three & four", "gone", "Five")]
    assert [None if p is None else tree.signatures[p] for p in tree.places(blocks)][1:] == ["main", None, "main"]
    assert (Tree("</div><p>").signatures, Tree("</div><p>").texts) == ([""], [""])


def test_subtree_hashes():
    tree = Tree("<div><nav><p>a</p><p>b</p></nav><section><nav><p>a</p><p>b</p></nav></section><nav><p>b</p><p>a</p></nav></div>")
    hashes = tree.subtrees({k: [ord(t)] for k, t in enumerate(tree.texts)})
    assert tree.tags == ["div", "nav", "section", "nav", "nav"] and tree.parents == [-1, 0, 0, 2, 0]
    assert hashes[1] == hashes[3] != hashes[4] and len(set(hashes)) == 4
    assert [tree.tags[c] for c in tree.around(2)] == ["nav", "section", "div"]


def test_a_rare_container_goes_by_its_recurring_subtree(spark):
    """A box on three pages, too rare to be judged by its lines, recurs as a whole; so does one with other text only in part."""
    rng, rows = random.Random(9), []
    for k in range(12):
        box = [block("paragraph", "Winter office hours"), block("paragraph", "Ring the side bell")] if k < 3 else [block("paragraph", words(rng, 4)), block("paragraph", words(rng, 4))] if k < 5 else []
        body = [block("paragraph", words(rng, 20) + ".") for _ in range(4)]
        html = "<main>" + "".join(f"<p>{b[1]}</p>" for b in body) + "</main>" + (f'<aside class="{k > 2}">' + "".join(f"<p>{b[1]}</p>" for b in box) + "</aside>" if box else "")
        rows.append((f"p{k:02}", "one.example", body + box, html, "", 0))
    got = {tuple(r) for r in furniture(spark.createDataFrame(rows, SCHEMA), "page_id", site("origin"), "blocks", "content_html").collect()}
    assert got == {(f"p{k:02}", n) for k in range(3) for n in (4, 5)}
