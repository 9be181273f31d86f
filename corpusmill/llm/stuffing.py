"""Problem 9: keyword-stuffed and link-list documents, by compression ratios of blocks."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from math import log2

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.language import FUNCTION_WORDS, best_language
from corpusmill.session import materialize

WORD = re.compile(r"[^\W_]+")
END = re.compile(r"[.!?…。！？]+[\"'”’)\]»]*(?=\s|$)")
PARAGRAPH = re.compile(r"\n\s*\n")
_KEPT = frozenset().union(*FUNCTION_WORDS.values())
#: Share of a block's words from which its commonest word pair is its subject.
SUBJECT = 0.15

#: Fewest words of a block that is judged; with fewer sentence ends a word than this it does not consist of sentences.
LEAST_WORDS, FEW_ENDS = 8, 1 / 30
#: Ratio from which the phrases of a block are counted.
PHRASE_FROM = 1.5
#: Blocks as which the norm of all languages counts beside a language's own.
WEIGHT = 30


def ratio(data: bytes) -> float:
    """How many times smaller data gets; the format's fixed bytes do not count."""
    return len(data) / max(len(zlib.compress(data, 6)) - 8, 1) if data else 0.0


def pattern(words: list[str]) -> bytes:
    """The block with every content word as one sign: lists of names, links or tags are a run of it, sentences are not."""
    return "".join(f" {w} " if w in _KEPT else "w" for w in words).encode("utf-8", "replace")


def sentence_ends(block: str, words: list[str], redundant: bool) -> int:
    """Sentence ends of a block. Where one word pair makes up SUBJECT of a redundant block's words, those of sentences
    that repeat it do not count, as each says the same again."""
    ends = [m.end() for m in END.finditer(block)]
    if not ends or not redundant:
        return len(ends)
    (one, two), n = Counter(zip(words, words[1:], strict=False)).most_common(1)[0]
    if 2 * n < SUBJECT * len(words):
        return len(ends)
    same = re.compile(rf"(?<![^\W_]){re.escape(one)}[\W_]+{re.escape(two)}(?![^\W_])")
    low = block.lower()
    return sum(not same.search(low, a, b) for a, b in zip([0, *ends], ends, strict=False))


def blocks(text: str) -> list[str]:
    """Paragraphs; neighbours without a sentence end are one block, as the items of a list or a run of headings."""
    out, run = [], []
    for p in PARAGRAPH.split(text):
        if not p.strip():
            continue
        if END.search(p):
            if run:
                out.append("\n".join(run))
                run = []
            out.append(p)
        else:
            run.append(p)
    if run:
        out.append("\n".join(run))
    return out


def measure(text: str) -> Iterator[tuple[str, int, int, int, float, float, float]]:
    """(language, chars, words, size class, ratio of the words, ratio of the pattern, sentence ends a word) of each block."""
    for b in blocks(text):
        words = WORD.findall(b.lower())
        n = len(words)
        if not n:
            continue
        data = " ".join(words).encode("utf-8", "replace")
        r = ratio(data)
        yield best_language(words) or "und", len(b.strip()), n, int(2 * log2(len(data))), r, n / max(len(zlib.compress(pattern(words), 1)) - 8, 1), sentence_ends(b, words, r >= PHRASE_FROM and n >= LEAST_WORDS) / n


def block_measures(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """One row a block: doc, lang, chars, words, bucket, ratio, pattern, ends. Null and blank texts have none."""
    src = docs.select(F.col(ident).alias("doc"), F.col(text).alias("text")).where("doc is not null and text is not null")
    kind = src.schema["doc"].dataType.simpleString()
    types = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, at = [], []
            for k, t in enumerate(b.column(1).to_pylist()):
                own = list(measure(t))
                rows += own
                at += [k] * len(own)
            if rows:
                yield pa.record_batch([b.column(0).take(pa.array(at)), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=["doc", "lang", "chars", "words", "bucket", "ratio", "pattern", "ends"])

    return src.mapInArrow(run, f"doc {kind}, lang string, chars int, words int, bucket int, ratio double, pattern double, ends double")


def _norm(column: str) -> Column:
    """Median and spread below it of a group; the spam lies above."""
    q = F.percentile_approx(column, [0.25, 0.5], 1000)
    return F.struct(q[1].alias("mid"), ((q[1] - q[0]) / 0.674).alias("spread"))


def stuffed(docs: DataFrame, ident: str, text: str, extreme: float = 5.0, share: float = 0.5) -> DataFrame:
    """(ident, stuffed_share): documents of whose text more than `share` is keyword runs, link lists, tags or one repeated phrase.

    Every block is compressed twice: its words, and its pattern, in which every word that is no function word is one sign, as
    a list of different words repeats no word but its pattern. Each ratio is set against that of all blocks of its
    length (half octaves of bytes) and language, judged block by block: median, and spread below it. The norm of a
    language is drawn towards that of all languages as WEIGHT blocks would draw it, so that few blocks make no norm; blocks
    without a language, among which the spam gathers, go by that of all. A block `extreme` spreads above in either
    is redundant; it is confirmed by few sentence ends a word, where sentences that repeat the block's
    one subject do not count. Blocks of fewer than LEAST_WORDS words are never counted against a document. All lengths and all blocks are measured.

    Null and blank texts are never found; a null identifier gives no row, repeated rows of one identifier count
    together (their share is the same). Empty tables give an empty result; other columns are not touched.
    """
    m = materialize(block_measures(docs, ident, text).where(F.col("words") > 0), "stuffing")
    judged = m.where(F.col("words") >= LEAST_WORDS)
    # a row for each language and half octave of length that occurs: languages x about 60, whatever the data
    norm = judged.where("lang <> 'und'").groupBy("lang", "bucket").agg(_norm("ratio").alias("own_r"), _norm("pattern").alias("own_p"), F.count("*").alias("n"))
    common = judged.groupBy("bucket").agg(_norm("ratio").alias("r"), _norm("pattern").alias("p"), F.count("*").alias("n"))
    # a length that hardly occurs takes the norm of the nearest shorter one, else of the next longer one
    w = Window.orderBy("bucket")
    enough = F.when(F.col("n") >= WEIGHT, F.struct("r", "p"))
    near = F.coalesce(F.last(enough, ignorenulls=True).over(w), F.first(enough, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), F.struct("r", "p"))
    common = common.select("bucket", near.alias("near")).select("bucket", "near.*")
    z = judged.join(F.broadcast(norm), ["lang", "bucket"], "left").join(F.broadcast(common), "bucket", "left")

    def above(c: str, own: str, every: str) -> Column:
        drawn = lambda f: (F.coalesce(F.col("n") * F.col(own)[f], F.lit(0.0)) + WEIGHT * F.col(every)[f]) / (F.coalesce("n", F.lit(0)) + WEIGHT)
        return (F.col(c) - drawn("mid")) / F.greatest(drawn("spread"), 0.02 * drawn("mid"))

    redundant = (above("ratio", "own_r", "r") >= extreme) | (above("pattern", "own_p", "p") >= extreme)
    bad = z.where(redundant & (F.col("ends") < FEW_ENDS)).groupBy("doc").agg(F.sum("chars").alias("bad"))
    out = m.groupBy("doc").agg(F.sum("chars").alias("chars")).join(bad, "doc").select("doc", (F.col("bad") / F.col("chars")).alias("stuffed_share"))
    return out.where(F.col("stuffed_share") > share).select(F.col("doc").alias(ident), "stuffed_share")
