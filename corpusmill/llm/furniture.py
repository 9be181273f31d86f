"""Problem 6: the site's own furniture among a page's blocks, by element subtrees that recur across the pages of a host."""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.session import materialize, small_enough

#: Elements that become a block.
LEAVES = frozenset("h1 h2 h3 h4 h5 h6 p li tr blockquote pre dt dd".split())
#: Elements that group blocks without saying what they are.
NEUTRAL = frozenset("html body ul ol dl table thead tbody tfoot form figure span a b i em strong code small br hr img".split())
#: Blocks that may hold others, and elements that end with their blocks.
HOLDERS = frozenset("li blockquote dd tr".split())
GROUPS = frozenset("ul ol dl table tbody body html".split())
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
TAG = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9]*)([^>]*)>")
SKIPPED = re.compile(r"<!--.*?-->|<(script|style|noscript|svg|template)\b.*?</\1\s*>", re.S | re.I)
LETTERS = re.compile(r"[\W\d_]+")
#: A trail of links from the home page: at least one more step behind it.
TRAIL = re.compile(r"^\W*(?:home|start|main page|homepage)\s*(?:[>»›→/\\|:]|::|&gt;)+\s*\S", re.I)

#: Pages of a host on which a line recurs, and hosts whose furniture a line must be to count as such everywhere.
RECURS, HOSTS = 3, 2
#: Share of recurring or link lines from which a container is furniture; lines it needs at all, and lines by which a host is judged by itself.
SHARE, LEAST_LINES, OWN_LINES = 0.5, 6, 30
BROADCAST_ROWS = 100_000
#: Pages that are Python objects at once.
SLICE = 256


def _hash(*parts: str) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(parts).encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


class Tree:
    """The block elements of a page in document order, with their texts and the containers around them."""

    def __init__(self, markup: str):
        markup = SKIPPED.sub("", markup)
        self.tags: list[str] = []  # of the containers, by number; an inner one has a larger number than the outer
        self.parents: list[int] = []
        self.texts: list[str] = []
        self.inside: list[int] = []  # of each leaf, its innermost container, -1 for none
        self.signatures: list[str] = []  # of each leaf, tags and attributes of the containers around it
        stack: list[tuple[str, str, int]] = []
        leaf, begin = None, 0
        for m in TAG.finditer(markup):
            shut, tag, rest = m[1], m[2].lower(), m[3]
            if leaf is not None:
                ends = tag == leaf and shut
                begins = tag in LEAVES and not shut and (tag == leaf or leaf not in HOLDERS)
                if not ends and not begins and not (shut and (tag in GROUPS or any(tag == t for t, _, _ in stack))):
                    continue
                self.texts.append(markup[begin : m.start()])  # an unclosed block ends where the next begins, or with what it stands in
                leaf = None
                if ends:
                    continue
            if shut:
                names = [t for t, _, _ in stack]
                if tag in names:
                    del stack[len(names) - 1 - names[::-1].index(tag) :]
            elif tag in LEAVES:
                leaf, begin = tag, m.end()
                self.signatures.append(">".join(s for _, s, _ in stack))
                self.inside.append(stack[-1][2] if stack else -1)
            elif tag not in VOID and not rest.endswith("/") and tag not in NEUTRAL:
                self.parents.append(stack[-1][2] if stack else -1)
                stack.append((tag, " ".join([tag, *sorted(rest.split())]), len(self.tags)))
                self.tags.append(tag)
        if leaf is not None:
            self.texts.append(markup[begin:])

    def places(self, blocks: list[dict]) -> list[int | None]:
        """The leaf of each block, None where the markup does not tell."""
        if len(self.texts) == len(blocks):
            return list(range(len(blocks)))
        plain = [letters(html.unescape(TAG.sub("", t))) for t in self.texts]
        out, at = [], 0
        for b in blocks:
            own = letters(block_text(b))
            k = next((k for k in range(at, len(plain)) if plain[k] == own), None) if own else None
            out.append(k)
            at = at if k is None else k + 1
        return out

    def subtrees(self, leaves: dict[int, list[int]]) -> list[int]:
        """The hash of each container's subtree: its tag and, bottom up, the hashes of what it holds. leaves: the hashes of each leaf."""
        parts: list[list[str]] = [[t] for t in self.tags]
        for k, c in enumerate(self.inside):
            if c >= 0:
                parts[c] += map(str, leaves.get(k, ()))
        out = [0] * len(parts)
        for c in range(len(parts) - 1, -1, -1):
            out[c] = _hash("subtree", *parts[c])
            if self.parents[c] >= 0:
                parts[self.parents[c]].append(str(out[c]))
        return out

    def around(self, leaf: int) -> list[int]:
        """The containers around a leaf."""
        out, c = [], self.inside[leaf]
        while c >= 0:
            out.append(c)
            c = self.parents[c]
        return out


def letters(text: str) -> str:
    return LETTERS.sub("", text.lower())


def block_text(b: dict) -> str:
    return " ".join([b["text"] or "", *[c or "" for c in b["cells"] or []]])


def describe(block: dict, brand: str) -> tuple[list[int], bool, bool]:
    """(hashes of the lines' letters without the site's name, all text is links, is a trail)."""
    text = block["text"] or ""
    kind = block["kind"] or ""
    if kind in ("code", "row", "quote", "term", "definition") or block["cells"]:
        return [], False, False
    lines = [x for x in (letters(line) for line in text.split("\n")) if x]
    linked = sum(len(letters(a["label"] or "")) for a in block["anchors"] or [])
    own = sum(map(len, lines))
    return [_hash(kind, x.replace(brand, "") if brand else x) for x in lines], bool(own) and linked >= own, bool(TRAIL.match(text))


def block_features(pages: DataFrame, page_id: str, site: Column, blocks: str, markup: str) -> DataFrame:
    """One row a line of a block: page_id, src, pos, sig (0: unknown), trees (hashes of the subtrees around it), line (null: the
    block has none), link, trail. A line's hash, of its block's kind and its letters, is the hash of a leaf's subtree."""
    src = pages.select(F.col(page_id).cast("string").alias("page_id"), site.alias("site"), F.transform(F.col(blocks), lambda b: F.struct(b["kind"].alias("kind"), b["text"].alias("text"), b["cells"].alias("cells"), F.transform(b["anchors"], lambda a: F.struct(a["label"].alias("label"))).alias("anchors"))).alias("blocks"), F.col(markup).alias("markup"))
    src = src.where("page_id is not null and site is not null and size(blocks) > 0")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            ids, src_, pos, sig, trees, line, link, trail = [], [], [], [], [], [], [], []
            for page, host, blks, markup in zip(*[b.column(k).to_pylist() for k in range(4)], strict=True):
                labels = host.split(".")
                brand = letters(labels[-2] if len(labels) > 1 else host)
                host_key = _hash(host)
                blks = [x or {"kind": None, "text": None, "cells": None, "anchors": None} for x in blks]
                described = [describe(x, brand) for x in blks]
                tree = Tree(markup) if markup else None
                places = tree.places(blks) if tree else [None] * len(blks)
                subtrees = tree.subtrees({p: d[0] or [_hash(x["kind"] or "", letters(block_text(x)))] for p, d, x in zip(places, described, blks, strict=True) if p is not None}) if tree else []
                for k, (blk, p, (own, is_link, is_trail)) in enumerate(zip(blks, places, described, strict=True)):
                    s = None if p is None else tree.signatures[p]
                    if s is not None and s not in names:
                        if len(names) > 100_000:
                            names.clear()
                        names[s] = _hash("container", s) or 1
                    around = [] if p is None else [subtrees[c] for c in tree.around(p)]
                    for h in own or ([None] if s is not None and block_text(blk).strip() else []):
                        ids.append(page)
                        src_.append(host_key)
                        pos.append(k)
                        sig.append(0 if s is None else names[s])
                        trees.append(around)
                        line.append(h)
                        link.append(is_link)
                        trail.append(is_trail)
            yield pa.record_batch([pa.array(ids, pa.string()), pa.array(src_, pa.int64()), pa.array(pos, pa.int32()), pa.array(sig, pa.int64()), pa.array(trees, pa.list_(pa.int64())), pa.array(line, pa.int64()), pa.array(link, pa.bool_()), pa.array(trail, pa.bool_())], names=["page_id", "src", "pos", "sig", "trees", "line", "link", "trail"])

    return src.mapInArrow(run, "page_id string, src long, pos int, sig long, trees array<long>, line long, link boolean, trail boolean")


def _held(df: DataFrame, tag: str) -> DataFrame:
    df = materialize(df, tag)
    return F.broadcast(df) if small_enough(df, BROADCAST_ROWS) else df


def furniture(pages: DataFrame, page_id: str, site: Column, blocks: str, markup: str) -> DataFrame:
    """(page_id, block_pos) of the blocks that are furniture of their site.

    Element subtrees are hashed bottom up (a leaf by its letters without the site's name, a container by its tag and the
    hashes of what it holds) and counted per host by pages. A container whose subtree recurs on RECURS pages of the host is
    deleted with all in it. Few containers recur as a whole, as their items vary; so each is also judged, by its tags and
    attributes, over all pages of the host: it is furniture when at least half of the leaves in it recur on RECURS pages, are
    links altogether, or are a trail from the home page, and goes with all blocks that have text, recurring or not (as the
    items of a related-links box). A container that is body by that rule stays even where its subtree recurs, as the body of a page
    that a site shows at several addresses.
    A host with fewer than OWN_LINES lines in a container goes by that container's share over all hosts.
    Blocks whose page has no markup, or whose markup does not match, are furniture when all their lines stand at least as often as not in
    deleted containers of the host, or of at least HOSTS hosts, when they are a trail, or when they are links altogether
    next to furniture or at least three in a row. Blocks that hold furniture lines together with body text stay, as do code, cells, quotes and terms
    outside deleted containers. All counts cover all pages, and are summed before they are shuffled.

    Pages without id, site or blocks give no rows; pages delivered twice count once; null kinds, texts and anchors are
    empty ones; an empty table gives an empty result; other columns are not touched.
    """
    rows = materialize(block_features(pages, page_id, site, blocks, markup), "furniture")
    recurring = rows.where("line is not null").select("src", "line", "page_id").distinct().groupBy("src", "line").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS).select("src", "line", F.lit(True).alias("again"))
    whole = rows.select("src", "page_id", F.explode(F.array_distinct("trees")).alias("tree")).distinct().groupBy("src", "tree").agg(F.count("*").alias("n")).where(F.col("n") >= RECURS).select("src", "tree")
    whole = _held(whole, "subtrees")
    marked = rows.where("line is not null or sig <> 0").join(_held(recurring, "recurring"), ["src", "line"], "left")
    sign = F.coalesce("again", F.lit(False)) | F.col("link") | F.col("trail")
    own = marked.where("sig <> 0").groupBy("src", "sig").agg(F.count("*").alias("n"), F.sum(sign.cast("int")).alias("y"))
    own = materialize(own, "containers")
    every = own.groupBy("sig").agg(F.sum("n").alias("n_all"), F.sum("y").alias("y_all"))
    share = F.when(F.col("n") >= OWN_LINES, F.col("y") / F.col("n")).otherwise(F.col("y_all") / F.col("n_all"))
    judged = _held(own.join(every, "sig").select("src", "sig", (share >= SHARE).alias("out"), ((F.col("n_all") >= LEAST_LINES) | ((F.col("n_all") >= RECURS) & (F.col("y_all") == F.col("n_all")))).alias("sure")), "judged")
    told = rows.join(judged, ["src", "sig"], "left")
    by_container = told.where("sig <> 0 and sure and out").select("page_id", "pos")
    open_ = told.where("sig <> 0 and not sure").select("page_id", "src", "pos", F.explode("trees").alias("tree"))
    by_subtree = open_.join(whole, ["src", "tree"], "left_semi").select("page_id", "pos")

    known = told.where("line is not null and sig <> 0 and sure").groupBy("src", "line").agg(F.count("*").alias("n"), F.sum(F.col("out").cast("int")).alias("y"))
    known = materialize(known, "lines")
    here = _held(known.where("2 * y >= n").select("src", "line", F.lit(True).alias("here")), "here")
    there = known.groupBy("line").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.sum((F.col("y") > 0).cast("int")).alias("hosts")).where(f"2 * y >= n and hosts >= {HOSTS}").select("line", F.lit(True).alias("there"))
    untold = told.where("line is not null and (sig = 0 or not sure)").select("page_id", "src", "pos", "line", "link", "trail").distinct()
    untold = untold.join(here, ["src", "line"], "left").join(_held(there, "there"), "line", "left")
    each = untold.groupBy("page_id", "pos").agg(F.min(F.coalesce("here", "there", F.lit(False))).alias("all"), F.max("link").alias("link"), F.max("trail").alias("trail"))
    each = each.withColumn("sure", F.col("all") | F.col("trail"))
    # a page's own blocks: links next to one another, of which one is furniture or one touches furniture
    page = each.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "sure", "link"))).alias("b"))
    # and runs of links, which no body consists of
    at = F.transform(F.filter("b", lambda x: x["link"]), lambda x: x["pos"])
    has = lambda x, *steps: F.forall(F.array(*map(F.lit, steps)), lambda k: F.array_contains(at, x["pos"] + k))
    in_run = lambda x: x["link"] & (has(x, 1, 2) | has(x, -1, 1) | has(x, -2, -1))
    page = page.withColumn("b", F.transform("b", lambda x: F.struct(x["pos"].alias("pos"), (x["sure"] | in_run(x)).alias("sure"), x["link"].alias("link"))))
    walk = lambda a: F.aggregate(a, F.struct(F.array().cast("array<int>").alias("found"), F.lit(-2).alias("last")), lambda s, x: F.when(x["sure"] | (x["link"] & (F.abs(x["pos"] - s["last"]) == 1)), F.struct(F.array_append(s["found"], x["pos"]).alias("found"), x["pos"].alias("last"))).otherwise(s))["found"]
    by_text = page.select("page_id", F.explode(F.array_union(walk(F.col("b")), walk(F.reverse("b")))).alias("pos"))
    return by_container.unionByName(by_subtree).unionByName(by_text).distinct().select(F.col("page_id").alias(page_id), F.col("pos").alias("block_pos"))


def main_blocks(pages: DataFrame, page_id: str, site: Column, blocks: str, markup: str) -> DataFrame:
    """pages with the furniture taken out of their blocks; every row and column is kept."""
    found = furniture(pages, page_id, site, blocks, markup)
    drop = found.groupBy(F.col(page_id).alias("_mill_page")).agg(F.collect_set("block_pos").alias("_mill_drop"))  # bounded by the page's own blocks
    joined = pages.join(drop, F.col(page_id).cast("string") == F.col("_mill_page"), "left")
    kept = F.filter(F.col(blocks), lambda b, k: ~F.coalesce(F.array_contains("_mill_drop", k), F.lit(False)))
    return joined.withColumn(blocks, kept).drop("_mill_page", "_mill_drop")
