"""Problem 7: evaluation passages inside documents, by the q-gram lemma and banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")

#: Length of a q-gram in characters, at most; each character counts with 8 bits of its code.
Q = 8
#: Steps at which q-grams of an item are taken, widest first, and the shared q-grams that a step has to leave of a passage.
STEPS = ((4, 6), (2, 4), (1, 1))
#: Characters of documents that are worked on at once, and windows that are aligned at once.
CHUNK_CHARS, CHUNK_WINDOWS = 3_000_000, 50_000
#: Items and characters of items held by one pass over the documents; more items take several passes.
BLOCK_ITEMS, BLOCK_CHARS = 5_000, 8_000_000
#: Bits of the filter that most q-grams of unrelated documents stop at, and of a diagonal's number.
FILTER_BITS, DIAGONAL_BITS = 22, 26

_MULT = np.uint64(0x9E3779B97F4A7C15)


def plain(text: str) -> str:
    """The words of a text in lower case, one space between them."""
    return " ".join(WORD.findall(text)).lower()


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """The q characters from each position on as one number."""
    small = np.concatenate([(codes * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8), np.zeros(8, np.uint8)])
    eight = np.ndarray(len(codes), np.uint64, small, strides=(1,))
    return (eight & np.uint64((1 << 8 * q) - 1)) * _MULT


class Items:
    """The q-grams of the evaluation passages, at steps that leave a passage with `edits` edits enough of them."""

    def __init__(self, items: list[tuple[object, str]], words: int, edits: int):
        self.words, self.edits, self.keys, texts = words, edits, [], []
        for k, t in items:
            p = plain(t)
            if p.count(" ") + 1 >= words:
                self.keys.append(k)
                texts.append(f" {p} ")
        # a run of spaces costs more edits than there may be, so that no passage reaches over it
        self.gap = " " * (edits + 2)
        self.codes = _codes(self.gap.join(["", *texts, ""]))
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        self.starts = np.cumsum(sizes + edits + 2) - sizes
        # no passage is shorter than words of one letter, of which some q-gram has to be left
        self.q = max(min(Q, (2 * words + 1) // (edits + 1)), 1)
        self.windows, self.steps, self.least, at = [], [], [], []
        for start, size, text in zip(self.starts, sizes, texts, strict=True):
            gaps = np.array([m.start() for m in re.finditer(" ", text)], dtype=np.int64)
            begin, end = gaps[:-words], gaps[words:] + 1
            self.windows.append((begin, end))
            for step, enough in STEPS:
                taken = (end - self.q) // step - (begin - 1) // step  # multiples of step from begin to end - q
                spoiled = edits * -(-self.q // step)
                if taken.min() - spoiled >= enough or step == 1:
                    break
            self.steps.append((step, taken - spoiled))
            self.least.append(max(int(taken.min()) - spoiled, 1))
            at.append(start + np.arange(0, size - self.q + 1, step))
        self.least = np.array(self.least, dtype=np.int64)
        at = np.concatenate(at) if at else np.zeros(0, dtype=np.int64)
        grams = _grams(self.codes, self.q)[at]
        order = np.argsort(grams, kind="stable")
        self.at = at[order]
        self.grams, self.first, self.runs = np.unique(grams[order], return_index=True, return_counts=True)
        self.filter = np.zeros(1 << FILTER_BITS, dtype=bool)
        self.filter[(self.grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True


def distances(doc: np.ndarray, first: np.ndarray, pattern: np.ndarray, begin: np.ndarray, size: np.ndarray, width: int, most: int) -> np.ndarray:
    """Fewest edits that turn pattern[begin : begin + size] into a part of doc whose diagonals lie among the `width` from
    `first` (place in doc of the pattern's begin) on; most + 1 if more. All passages at once, one row of the band after the other."""
    out = np.full(len(begin), most + 1, dtype=np.int8)
    band = np.arange(width)
    for low in range(0, len(begin), CHUNK_WINDOWS):
        part = slice(low, low + CHUNK_WINDOWS)
        f, b, n = first[part], begin[part], size[part]
        row = np.zeros((len(b), width), dtype=np.int8)
        for i in range(int(n.max(initial=0))):
            on = n > i
            there = pattern[np.where(on, b + i, 0)]
            here = doc[np.clip(f[:, None] + i + band, 0, len(doc) - 1)]
            new = row + (here != there[:, None])
            np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
            for d in range(1, width):
                np.minimum(new[:, d], new[:, d - 1] + 1, out=new[:, d])
            row = np.where(on[:, None], np.minimum(new, most + 1), row).astype(np.int8)
        out[part] = row.min(axis=1)
    return out


def find(texts: list[str], items: Items) -> list[tuple[int, int, int]]:
    """(text, item, edits) for each text that holds a passage of an item; texts are plain ones."""
    if not len(items.grams) or not texts:
        return []
    edits, many = items.edits, len(items.keys)
    codes = _codes(items.gap.join(["", *texts, ""]))
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.cumsum(sizes + len(items.gap)) - sizes
    grams = _grams(codes, items.q)
    at = np.flatnonzero(items.filter[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
    grams = grams[at]
    place = np.minimum(np.searchsorted(items.grams, grams), len(items.grams) - 1)
    hit = items.grams[place] == grams
    at, place = at[hit], place[hit]
    runs = items.runs[place]
    ends = np.cumsum(runs)
    there = items.at[np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - runs - items.first[place], runs)]
    here = np.repeat(at, runs)
    doc = np.maximum(np.searchsorted(starts - 1, here, side="right") - 1, 0)
    item = np.searchsorted(items.starts, there, side="right") - 1
    inside = there - items.starts[item]
    # blocks of diagonals as wide as a passage with its edits can be; two neighbours are one of the overlapping bands
    block = (here - inside + (1 << 22)) // (edits + 1)
    key = (doc * many + item) << DIAGONAL_BITS | block
    order = np.argsort(key, kind="stable")
    key, inside = key[order], inside[order]
    kept, begin, count = np.unique(key, return_index=True, return_counts=True)
    follows = np.zeros(len(kept), dtype=bool)
    follows[:-1] = kept[1:] == kept[:-1] + 1
    both = count + np.where(follows, np.append(count[1:], 0), 0)
    pair = kept >> DIAGONAL_BITS
    rows: list[tuple[np.ndarray, ...]] = []
    for k in np.flatnonzero(both >= items.least[pair % many]):
        i = int(pair[k] % many)
        step, need = items.steps[i]
        first, last = items.windows[i]
        # what the band shares with each passage of the item, by the places of the q-grams in it
        shared = np.zeros(int(last[-1]) // step + 2, dtype=np.int64)
        shared[inside[begin[k] : begin[k] + both[k]] // step + 1] = 1
        upto = np.cumsum(shared)
        left = upto[(last - items.q) // step + 1] - upto[(first - 1) // step + 1] - need
        own = np.flatnonzero(left >= 0)
        diagonal = (int(kept[k]) & (1 << DIAGONAL_BITS) - 1) * (edits + 1) - (1 << 22) - edits
        rows.append((np.full(len(own), pair[k]), diagonal + first[own], items.starts[i] + first[own], (last - first)[own], left[own]))
    if not rows:
        return []
    pair, first, begin, size, left = (np.concatenate(c) for c in zip(*rows, strict=True))
    width, best = 4 * edits + 2, {}

    def align(some: np.ndarray) -> None:
        for p, d in zip(pair[some].tolist(), distances(codes, first[some], items.codes, begin[some], size[some], width, edits).tolist(), strict=True):
            if d <= edits:
                best[p] = min(best.get(p, d), d)

    # the passage of which most is left often settles it; the others of a pair follow where it does not
    order = np.lexsort((-left, pair))
    top = order[np.concatenate([[True], pair[order][1:] != pair[order][:-1]])] if len(order) else order
    align(top)
    rest = np.ones(len(pair), dtype=bool)
    rest[top] = False
    done = np.array([p for p, d in best.items() if d == 0], dtype=np.int64)
    align(np.flatnonzero(rest & ~np.isin(pair, done)))
    return [(p // many, p % many, d) for p, d in sorted(best.items())]


def leaks(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, words: int = 12, edits: int = 2) -> DataFrame:
    """(doc_id, item_id, edits): documents that hold `words` consecutive words of an item but for at most `edits` characters
    that were inserted, deleted or replaced, and the fewest such edits of any such passage (0: word for word).

    Texts are compared as their words (letters and digits) in lower case with single spaces, the spaces around a passage
    included. The q-grams of all places of a document are looked up among those of the items, taken at steps; hits are
    counted by diagonal (document position minus item position) in overlapping bands. By the q-gram lemma a passage
    keeps all but ceil(q / step) of its q-grams for each edit, within edits + 1 diagonals: bands that hold fewer hits than
    the item's weakest passage keeps are dropped, and of the others the passages with fewer. What remains is
    aligned in its band. No passage within the budget is lost. The items are the query set and are held by each task, BLOCK_ITEMS or
    BLOCK_CHARS of them at a time: a larger set takes several passes over the documents, whose rows are never shuffled
    before the final grouping.

    Null texts and ids and items of fewer than `words` words give no rows; repeated rows count once; empty tables
    give an empty result; other columns are not touched.
    """
    src = docs.select(F.col(doc_id).alias("d"), F.col(text).alias("t")).where("d is not null and t is not null").where(F.length("t") >= max(2 * words - 1 - edits, 1))
    asked = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).where("i is not null and t is not null").distinct()
    schema = T.StructType([T.StructField("d", src.schema["d"].dataType), T.StructField("i", asked.schema["i"].dataType), T.StructField("e", T.IntegerType())])
    out = None
    block: list[tuple[object, str]] = []

    def passed(part: list[tuple[object, str]]) -> DataFrame:
        held = src.sparkSession.sparkContext.broadcast(Items(part, words, edits))
        item_type = schema["i"].dataType

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            own = held.value
            kind = to_arrow_type(item_type)
            for b in batches:
                texts = b.column(1).to_pylist()
                low = 0
                while low < len(texts):
                    chunk, size, high = [], 0, low
                    while high < len(texts) and (high == low or size + len(texts[high]) <= CHUNK_CHARS):
                        chunk.append(plain(texts[high]))
                        size += len(texts[high])
                        high += 1
                    found = find(chunk, own)
                    if found:
                        yield pa.record_batch([b.column(0).take(pa.array([low + d for d, _, _ in found])), pa.array([own.keys[i] for _, i, _ in found], kind), pa.array([e for _, _, e in found], pa.int32())], names=["d", "i", "e"])
                    low = high

        return src.mapInArrow(run, schema)

    def add(part: list[tuple[object, str]]) -> None:
        nonlocal out
        out = passed(part) if out is None else out.unionByName(passed(part))

    chars = 0
    for row in asked.toLocalIterator():
        block.append((row.i, row.t))
        chars += len(row.t)
        if len(block) == BLOCK_ITEMS or chars >= BLOCK_CHARS:
            add(block)
            block, chars = [], 0
    if block or out is None:
        add(block)
    return out.groupBy("d", "i").agg(F.min("e").alias("edits")).select(F.col("d").alias(doc_id), F.col("i").alias(item_id), "edits")
