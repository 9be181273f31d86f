"""Problem 5: oversized items cut at natural boundaries, all cuts found at once by pointer doubling."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.tokens import TOKEN, token_count

#: After these a full stop ends no sentence. Fixed values.
ABBREVIATIONS = frozenset("approx cf co corp dept dr e.g eg est etc fig i.e ie inc jr ltd mr mrs ms no nos p.a pp prof resp sr st vol vs".split())

#: A sentence end: closing marks may follow the stop, then white space, then something that can start a sentence.
SENTENCE = re.compile(r"([^\s]*?)[.!?…。！？]+[\"'”’)\]»]*\s+(?=[\"'“‘(\[«¿¡]*[^\W_a-z])")
LINES = re.compile(r"\n\s*")
WORDS = re.compile(r"\s+")

#: Tokens that are worked on at once.
CHUNK_TOKENS = 2_000_000


def natural_offsets(text: str) -> list[int]:
    """Character offsets at which a line or a sentence begins."""
    out = [m.end() for m in LINES.finditer(text)]
    for m in SENTENCE.finditer(text):
        word = m[1].lower().lstrip("(\"'[“‘")
        if m.group(0).lstrip()[len(m[1]) :].startswith(".") and (word in ABBREVIATIONS or len(word) == 1 or re.fullmatch(r"(?:[^\W\d_]\.)+[^\W\d_]", word)):
            continue
        out.append(m.end())
    return sorted(set(out))


def cut(texts: list[str], limit: int, overlap: int) -> list[tuple[int, int, int, int]]:
    """Pieces (item, first char, last char, tokens) of each text, in order.

    A node is a place at which a piece may start. Every node is joined to the farthest boundary that its piece may
    end at: a line or sentence end within the limit, else the last white space, else the limit itself, always more
    than `overlap` tokens after the node; the next piece starts `overlap` tokens before that end. Starting from the
    first node of every text, the successor table is applied to all nodes reached so far and then squared, so that
    k rounds find the first 2**k cuts of all texts.
    """
    starts, ends, item, natural, blank, first, size = [], [], [], [], [], [], []
    base = 0
    for k, t in enumerate(texts):
        spans = np.array([m.span() for m in TOKEN.finditer(t)], dtype=np.int64).reshape(-1, 2)
        n = len(spans)
        first.append(base)
        size.append(n)
        starts.append(spans[:, 0])
        ends.append(spans[:, 1])
        item.append(np.full(n, k))
        for offsets, to in ((natural_offsets(t), natural), ([m.end() for m in WORDS.finditer(t)], blank)):
            at = np.unique(np.searchsorted(spans[:, 0], np.array(offsets, dtype=np.int64)))
            to.append(at[(at > 0) & (at < n)] + base)
        base += n
    if not base:
        return []
    start, end, of = np.concatenate(starts), np.concatenate(ends), np.concatenate(item)
    first_a, size_a = np.array(first), np.array(size)
    node = np.arange(base)
    stop = (first_a + size_a)[of]
    reach = np.minimum(node + limit, stop)
    to = np.where(reach == stop, stop, reach)
    for where in (np.concatenate(blank), np.concatenate(natural)):  # the better kind last
        if len(where):
            at = np.searchsorted(where, reach, side="right") - 1
            far = where[np.maximum(at, 0)]
            to = np.where((at >= 0) & (far > node + overlap) & (reach < stop), far, to)
    follow = np.where(to >= stop, node, to - overlap)  # the last piece's node leads to itself
    reached = np.zeros(base, dtype=bool)
    reached[first_a[size_a > 0]] = True
    table = follow
    while True:
        new = table[reached]
        if reached[new].all():
            break
        reached[new] = True
        table = table[table]
    cuts = np.flatnonzero(reached)
    return list(zip(of[cuts].tolist(), start[cuts].tolist(), end[to[cuts] - 1].tolist(), (to[cuts] - cuts).tolist(), strict=True))


def split_oversized(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int) -> DataFrame:
    """The pieces of every item of more than `limit` tokens: keys, text_hash (tells texts of the same keys apart), piece (from 0), start_char, end_char, n_tokens, piece_text.

    Pieces have at most `limit` tokens; consecutive ones share exactly `overlap` tokens. Items within the limit,
    null and blank texts give no rows (split_items keeps them). Rows that repeat keys and text count once. Null
    keys are kept as they are, other columns of df are not carried. The count that picks the items runs in the JVM,
    so only oversized texts are shuffled or reach Python; each text is cut inside one task.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    names = [f"_k{n}" for n in range(len(keys))]
    src = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(text).alias("_text"))
    big = src.where((F.length("_text") > limit) & (token_count(F.col("_text")) > limit))
    big = big.withColumn("_h", F.xxhash64("_text")).dropDuplicates([*names, "_h"])
    schema = T.StructType([*[T.StructField(k, big.schema[n].dataType) for k, n in zip(keys, names, strict=True)], T.StructField("text_hash", T.LongType()), T.StructField("piece", T.IntegerType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), T.StructField("n_tokens", T.IntegerType()), T.StructField("piece_text", T.StringType())])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(len(names)).to_pylist()
            low = 0
            while low < len(texts):
                high, tokens = low, 0
                while high < len(texts) and (high == low or tokens + len(texts[high]) <= CHUNK_TOKENS):
                    tokens += len(texts[high])
                    high += 1
                found = cut(texts[low:high], limit, overlap)
                rows = np.array([f[0] for f in found], dtype=np.int64)
                if len(found):
                    number = np.arange(len(rows)) - np.searchsorted(rows, rows)
                    take = pa.array(rows + low)
                    yield pa.record_batch([*[b.column(c).take(take) for c in range(len(names))], b.column(len(names) + 1).take(take), pa.array(number, pa.int32()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int64()), pa.array([f[3] for f in found], pa.int32()), pa.array([texts[low + f[0]][f[1] : f[2]] for f in found], pa.string())], names=schema.names)
                low = high

    return big.mapInArrow(pieces, schema)


def split_items(df: DataFrame, keys: list[str], text: str, limit: int, overlap: int) -> DataFrame:
    """Every item with a text: the pieces of the oversized ones, the others whole as piece 0. Null texts give no rows."""
    cut_up = split_oversized(df, keys, text, limit, overlap)
    whole = df.select(*keys, F.col(text).alias("piece_text")).where(F.col("piece_text").isNotNull())
    whole = whole.withColumn("n_tokens", token_count(F.col("piece_text")).cast("int")).where(F.col("n_tokens") <= limit).distinct()
    whole = whole.select(*keys, F.xxhash64("piece_text").alias("text_hash"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start_char"), F.length("piece_text").cast("long").alias("end_char"), "n_tokens", "piece_text")
    return cut_up.unionByName(whole)
