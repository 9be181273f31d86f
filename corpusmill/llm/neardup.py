"""Problem 2: near-duplicate records by a parity-sketch join."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import discard, materialize, small_enough

WORD = re.compile(r"[^\W_]+")

#: Segments a record is joined by: as many as find a pair right at the limit with the probability FOUND, and SLOTS at least.
SLOTS, FOUND = 72, 0.99
#: A segment joins when its tokens carry as many bits as a record number has, and this many more; segments are made
#: so large that they have SPARE times as many on average. A token of a word in the share p of the records has -log2 p bits.
MORE_BITS, SPARE = 3.0, 0.95
#: Words in at least FREQUENT_SHARE of the records are left out of the segments (not out of the verification);
#: words in less than RARE_SHARE count as if they were in that share.
FREQUENT_SHARE, RARE_SHARE = 0.2, 0.002
#: Records whose tokens have fewer bits than this many segments need are joined by all tokens, frequent ones included;
#: then segments have PER_SEGMENT tokens on average, and LEAST_TOKENS at least.
FEW_SEGMENTS, PER_SEGMENT, LEAST_TOKENS = 1.5, 6, 6
#: 64-bit words of the sketch whose Hamming distance is a lower bound of the difference.
SKETCH_WORDS = 16
#: Distinct contents in a bucket from which its pairs are made in blocks of about BLOCK contents, behind the bounds.
HOT_BUCKET, BLOCK = 64, 4096
#: Rows of one or two longs that may be broadcast: some 16 MB as a hashed relation.
BROADCAST_ROWS = 200_000
#: Segments a record is dealt to at once, on average (about a third of them carry enough to join); the rest follows in further passes, whose disk is freed in between.
PASS_SEGMENTS = 60
#: However few records there are, so many segments fit into one pass; and there are never more passes than this.
PASS_LEAST, MOST_PASSES = 4_000_000, 24
#: A pass brings its segments together in so many shares of their values, one after the other: only one share's shuffle files lie on disk.
SHARES = 4
PARTITIONS = "spark.sql.shuffle.partitions"
#: Edits may fall on rare words more often than on others.
SLACK = 0.85
WORD_BITS = 43
SLOT_BITS = 20
#: A word id carries the word's bits in quarters in its lowest places.
QUARTERS = 6
BATCH_WORDS, BATCH_RECORDS = 500_000, 1 << (64 - WORD_BITS - QUARTERS - 1)
FREQUENT = int(-np.log2(FREQUENT_SHARE) * 4)
CACHE_WORDS = 1_000_000

_U = np.uint64


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    x = (x + _U(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)).astype(np.uint64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _word_id(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little") >> (64 - WORD_BITS)


def _frequencies(kinds: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {k: Counter() for k in kinds}
        totals = dict.fromkeys(kinds, 0)

        def flush():
            rows = [(k, _word_id(w), n) for k, c in seen.items() for w, n in c.items()] + [(k, -1, n) for k, n in totals.items()]
            for k, c in seen.items():
                c.clear()
                totals[k] = 0
            return pa.record_batch([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["kind", "word", "records"])

        for b in batches:
            for kind, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                if len(words) < max(kinds[kind], 1):
                    continue
                totals[kind] += 1
                seen[kind].update(set(words))
            if sum(map(len, seen.values())) > CACHE_WORDS:
                yield flush()
        yield flush()

    return run


def slot_counts(tokens: np.ndarray, size: np.ndarray, pieces: np.ndarray, least: float, nearest: float) -> np.ndarray:
    """Segments for which records whose tokens (of the sum of weights `size`) are dealt to `pieces` segments meet a partner
    right at the limit with probability FOUND: one of them has to miss the difference and to keep the weight `least`."""
    tokens, pieces = np.maximum(tokens, 1).astype(np.float64), pieces.astype(np.float64)
    differ, common = 2 * (1 - nearest) * tokens, nearest * tokens
    need = np.ceil(least * tokens / size)
    chance = (1 - 1 / pieces) ** common
    enough = np.ones(len(tokens))
    for k in range(int(need.max(initial=0))):
        enough -= np.where(k < need, chance, 0)
        chance = chance * np.maximum(common - k, 0) / (k + 1) / (pieces - 1)
    one = np.clip((1 - 1 / pieces) ** differ * enough, 1e-4, 0.999)
    return np.maximum(np.ceil(np.log(1 - FOUND) / np.log1p(-one)), SLOTS).astype(np.int64)


def sketch_batch(words: list[list[int]]) -> dict[str, np.ndarray]:
    """Counts, content hash, tokens, the bits of their words in quarters, and sketch of records given as word ids.

    A token is a word with the number of its occurrence, so that sets of tokens stand for multisets of words.
    """
    n = np.array([len(w) for w in words], dtype=np.int64)
    rec = np.repeat(np.arange(len(words), dtype=np.uint64), n)
    ids = np.concatenate([np.array(w, dtype=np.uint64) for w in words])
    combined = np.sort((rec << _U(WORD_BITS + QUARTERS)) | ids)
    first = np.ones(len(combined), dtype=bool)
    first[1:] = combined[1:] != combined[:-1]
    place = np.arange(len(combined))
    occurrence = place - np.maximum.accumulate(np.where(first, place, 0))
    rec = (combined >> _U(WORD_BITS + QUARTERS)).astype(np.int64)
    token = _mix(((combined >> _U(QUARTERS)) & _U((1 << WORD_BITS) - 1)) + _U(0xD1342543DE82EF95) * occurrence.astype(np.uint64), 1)
    edges = np.concatenate([[0], np.cumsum(n)])
    # parity sketch: every token flips one bit, so the Hamming distance is at most the symmetric difference
    sketch = np.zeros((len(words), SKETCH_WORDS), dtype=np.uint64)
    bit = _mix(token, 3)
    np.bitwise_xor.at(sketch, (rec, (bit % _U(SKETCH_WORDS)).astype(np.int64)), _U(1) << ((bit >> _U(32)) & _U(63)))
    content = np.add.reduceat(_mix(token, 2), edges[:-1]).view(np.int64)
    return {"n": n, "content": content, "tokens": (token >> _U(32)).astype(np.uint32), "quarters": (combined & _U((1 << QUARTERS) - 1)).astype(np.int64), "sketch": sketch.view(np.int64)}


class Segments:
    """How a batch of records is dealt to segments: for each family of tokens and each size band a record joins in, its
    number of pieces and of segments. bits: what a segment needs."""

    def __init__(self, n: np.ndarray, tokens: np.ndarray, quarters: np.ndarray, bits: np.ndarray, nearest: float):
        self.tokens, size = tokens, len(n)
        self.rec = np.repeat(np.arange(size), n)
        rare = quarters > FREQUENT
        worth = np.maximum(np.bincount(self.rec, weights=quarters * rare, minlength=size), 1).astype(np.int64)
        few = worth < FEW_SEGMENTS * 4 * bits
        # so that a record with few bits meets a partner that has a little more
        near_few = worth * SLACK * nearest < FEW_SEGMENTS * 4 * bits
        rares = np.bincount(self.rec, weights=rare, minlength=size).astype(np.int64)
        every, ones = np.ones(size, dtype=bool), np.ones(len(tokens), dtype=np.int64)
        families = ((rare, every, rares, worth, quarters, SPARE * 4 * bits, 4 * bits), (ones > 0, near_few, n, n, ones, np.full(size, PER_SEGMENT), np.full(size, LEAST_TOKENS)))
        self.parts = []
        for number, (mask, members, count, weight, each, mean, least) in enumerate(families):
            band = np.floor(np.log2(weight)).astype(np.int64)
            for step in (0, 1):
                # a partner of a larger band is hardly ever more than 1 / (SLACK * nearest) times as large
                joins = members if step == 0 else members & (weight / (SLACK * nearest) >= 2.0 ** (band + 1))
                b = band + step
                pieces = np.maximum(np.rint(1.4 * 2.0**b / mean), 2).astype(np.int64)
                slots = slot_counts(count, weight, pieces, least, nearest)
                if number == 0:
                    slots[few] = SLOTS  # these are found by all their tokens
                self.parts.append((number, mask, b, pieces, np.where(joins & (count > 0), slots, 0), each, least))

    def counts(self) -> np.ndarray:
        """Segments by record and part."""
        return np.stack([part[4] for part in self.parts], axis=1)

    def words(self, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        """(record, segment word) of the segments numbered low to high - 1 in their part, by record."""
        keys: list[tuple[np.ndarray, np.ndarray]] = []
        for number, mask, b, pieces, slots, each, least in self.parts:
            own, end = slots > low, np.minimum(slots, high)
            # records of the same number of pieces are at the same hashing, so that no token is hashed that has no segment in the range
            for p in np.unique(pieces[own]).tolist():
                use = mask & (own & (pieces == p))[self.rec]
                r0, t0, w0 = self.rec[use], self.tokens[use].astype(np.uint64), each[use]
                rep = low // p
                while len(r0):
                    first = np.concatenate([[True], r0[1:] != r0[:-1]])
                    x = _mix(t0, 10 + rep)
                    cell = (np.cumsum(first) - 1) * p + (x - x // _U(p) * _U(p)).astype(np.int64)
                    r = np.repeat(r0[first], p)
                    place = np.tile(np.arange(rep * p, rep * p + p), len(r) // p)
                    word = np.zeros(len(r), dtype=np.uint64)
                    np.bitwise_xor.at(word, cell, _mix(t0, 5))
                    keep = (np.bincount(cell, weights=w0, minlength=len(r)) >= least[r]) & (place >= low) & (place < end[r])
                    r, place, word = r[keep], place[keep], word[keep]
                    keys.append((r, _mix(word ^ _mix((b[r] * 4 + number << SLOT_BITS | place).astype(np.uint64), 6), 7)))
                    rep += 1
                    more = end[r0] > rep * p
                    if not more.all():
                        r0, t0, w0 = r0[more], t0[more], w0[more]
        owner = np.concatenate([k[0] for k in keys]) if keys else np.zeros(0, dtype=np.int64)
        value = np.concatenate([k[1] for k in keys]) if keys else np.zeros(0, dtype=np.uint64)
        order = np.argsort(owner, kind="stable")
        return owner[order], value[order].view(np.int64)


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def _records(kinds: dict[str, int], known_words: dict[str, dict[int, int]], bits: dict[str, float], nearest: float):
    tags = {k: int(_word_id(k)) for k in kinds}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, dict[str, int]] = {k: {} for k in kinds}
        usual = int(-np.log2(RARE_SHARE) * 4)

        def emit(kind, keys, words):
            out = sketch_batch(words)
            content = (out["content"].view(np.uint64) ^ _U(tags[kind])).view(np.int64)
            m, edges = len(words), np.concatenate([[0], np.cumsum(out["n"])])
            counts = Segments(out["n"], out["tokens"], out["quarters"], np.full(m, bits[kind]), nearest).counts()
            return pa.record_batch(
                [
                    pa.array([kind] * m), pa.array(keys, pa.string()), pa.array(content), pa.array(out["n"].astype(np.int32)), _lists(edges, out["tokens"].view(np.int32), pa.int32()), _lists(edges, out["quarters"].astype(np.int8), pa.int8()),
                    _lists(np.arange(m + 1) * SKETCH_WORDS, out["sketch"].ravel(), pa.int64()), _lists(np.arange(m + 1) * counts.shape[1], counts.astype(np.int32).ravel(), pa.int32()),
                ],
                names=["kind", "key", "content", "n", "tokens", "quarters", "sketch", "counts"],
            )

        for b in batches:
            held: dict[str, tuple[list, list, int]] = {}
            for kind, key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = WORD.findall(text.lower())
                if len(words) < max(kinds[kind], 1):
                    continue
                known = cache[kind]
                if len(known) > CACHE_WORDS:
                    known.clear()
                ids = []
                for w in words:
                    i = known.get(w)
                    if i is None:
                        i = _word_id(w)
                        i = known[w] = i << QUARTERS | known_words[kind].get(i, usual)
                    ids.append(i)
                keys, texts, size = held.get(kind, ([], [], 0))
                keys.append(key)
                texts.append(ids)
                size += len(ids)
                held[kind] = (keys, texts, size)
                if size > BATCH_WORDS or len(keys) >= BATCH_RECORDS:
                    yield emit(kind, keys, texts)
                    del held[kind]
            for kind, (keys, texts, _) in held.items():
                yield emit(kind, keys, texts)

    return run


def _segments(bits: dict[str, float], nearest: float, low: int, high: int, shares: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = whole.column(2).to_numpy().astype(np.int64)
            size, cuts = np.cumsum(lengths), [0]
            while cuts[-1] < len(lengths):
                done = size[cuts[-1] - 1] if cuts[-1] else 0
                cuts.append(min(max(int(np.searchsorted(size, done + BATCH_WORDS, "right")), cuts[-1] + 1), cuts[-1] + BATCH_RECORDS))
            for at, end in zip(cuts, cuts[1:], strict=False):
                b = whole.slice(at, end - at)
                need = np.array([bits[k] for k in b.column(0).to_pylist()])
                made = Segments(b.column(2).to_numpy().astype(np.int64), b.column(3).flatten().to_numpy().view(np.uint32), b.column(4).flatten().to_numpy().astype(np.int64), need, nearest)
                owner, value = made.words(low, high)
                some, row = np.unique(owner, return_inverse=True)
                share, columns = value.view(np.uint64) % _U(shares), []
                for k in range(shares):
                    own = share == _U(k)
                    columns.append(_lists(np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=len(some)))]), value[own], pa.int64()))
                yield pa.record_batch([b.column(1).take(pa.array(some)), *columns], names=["content", *_shares(shares)])

    return run


def _shares(shares: int) -> list[str]:
    return [f"keys_{k}" for k in range(shares)]


def passes(counts: dict[int, int], most: float) -> list[tuple[int, int]]:
    """Ranges of segment numbers that cover all segments and hold at most `most` of them, or one number. counts: how many have how many."""
    c = np.array(sorted(k for k in counts if k > 0), dtype=np.int64)
    m = np.array([counts[k] for k in c.tolist()], dtype=np.float64)
    out, low = [], 0
    while len(c) and low < c[-1]:
        upto = np.cumsum(np.concatenate([[0], np.diff(np.concatenate([[low], np.maximum(c, low)])) * np.cumsum(m[::-1])[::-1]]))
        k = int(np.searchsorted(upto, most, "right"))
        if k == len(upto):
            high = int(c[-1])
        else:
            still = float(m[k - 1 :].sum())
            high = max(low, int(c[k - 2]) if k > 1 else low) + int((most - upto[k - 1]) // still)
        high = max(high, low + 1)
        out.append((low, high))
        low = high
    return out


def _within_bounds(least: float):
    def run(key: tuple, cell: pa.Table) -> pa.Table:
        content, n = cell["content"].to_numpy(), cell["n"].to_numpy().astype(np.int64)
        block = cell["block"].to_numpy()
        sketch = cell["sketch"].combine_chunks().flatten().to_numpy().view(np.uint64).reshape(len(content), SKETCH_WORDS)
        same = key[1].as_py() == key[2].as_py()
        left = np.flatnonzero(block == key[1].as_py())
        right = left if same else np.flatnonzero(block == key[2].as_py())
        right = right[np.argsort(n[right], kind="stable")]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for x in left:
            near = right[np.searchsorted(n[right], np.ceil(least * n[x] - 1e-9)) : np.searchsorted(n[right], n[x] / least + 1e-9, "right")]
            apart = np.bitwise_count(sketch[near] ^ sketch[x]).sum(axis=1, dtype=np.int64)
            near = near[apart <= n[near] + n[x] - 2 * np.ceil(least * np.maximum(n[near], n[x]) - 1e-9)]
            other = content[near[content[near] > content[x]] if same else near]
            found.append((np.minimum(content[x], other), np.maximum(content[x], other)))
        return pa.table({"a": np.concatenate([f[0] for f in found] or [content[:0]]), "b": np.concatenate([f[1] for f in found] or [content[:0]])})

    return run


def _dense_pairs(hot: DataFrame, made: DataFrame, least: float) -> DataFrame:
    """(a, b) of the contents of large buckets that the size and Hamming bounds leave. hot: (seg, content, d).

    A bucket is dealt into blocks, and each two blocks meet in one group, so that no task holds a whole bucket.
    """
    blocks = F.ceil(F.col("d") / BLOCK).cast("int")
    dealt = hot.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("content", F.lit(1)), F.col("blocks")).cast("int"))
    need = materialize(dealt.select("content").distinct(), "hot")
    sketches = made.select("content", "n", "sketch").join(F.broadcast(need) if small_enough(need, BROADCAST_ROWS) else need, "content", "left_semi")
    held = dealt.join(sketches.dropDuplicates(["content"]), "content")
    met = held.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("seg", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "content", "n", "sketch")
    return met.groupBy("seg", "i", "j").applyInArrow(_within_bounds(least), "a long, b long")


def _shared(segments: DataFrame) -> DataFrame:
    """(seg, lo, hi, m, two): the segments of at least two contents. two: of just two, lo and hi."""
    # u_lo, u_hi, m and the sum of u tell whether a bucket holds just two contents, however often each: then the sum is
    # m * u_lo plus a multiple of u_hi - u_lo, which by chance happens once in billions
    part = lambda c: F.col(c).bitwiseAND(0xFFFFFFFF)
    shared = segments.withColumn("u", part("content")).groupBy("seg").agg(F.min("content").alias("lo"), F.max("content").alias("hi"), F.count("*").alias("m"), F.sum("u").alias("u")).where("lo < hi")
    step = part("hi") - part("lo")
    shared = shared.withColumn("two", F.when(step == 0, False).otherwise((F.col("u") - F.col("m") * part("lo")) % F.when(step == 0, 1).otherwise(step) == 0))
    return shared.select("seg", "lo", "hi", "m", "two")


def _in_shares(shares: list[DataFrame], tag: str) -> list[DataFrame]:
    """Each written after the other, with its share of the shuffle partitions: in more, the rows of a record would lie apart and compress less."""
    spark = shares[0].sparkSession
    usual = spark.conf.get(PARTITIONS)
    spark.conf.set(PARTITIONS, str(-(-int(usual) // len(shares))))
    try:
        return [materialize(x, tag) for x in shares]
    finally:
        spark.conf.set(PARTITIONS, usual)


def _read(parts: list[DataFrame]) -> DataFrame:
    """Written tables of one schema as one scan."""
    return parts[0].sparkSession.read.schema(parts[0].schema).parquet(*(f for x in parts for f in x.inputFiles()))


def _pass_pairs(made: DataFrame, bits: dict[str, float], least: float, low: int, high: int) -> DataFrame:
    """(a, b): the contents that agree on a segment numbered low to high - 1."""
    names = _shares(SHARES)
    made_now = materialize(made.where(F.array_max("counts") > low).select("kind", "content", "n", "tokens", "quarters").mapInArrow(_segments(bits, least, low, high, SHARES), ", ".join(["content long", *(f"{c} array<long>" for c in names)])), "keys")
    segments = lambda c: made_now.select("content", F.explode(c).alias("seg"))
    parts = _in_shares([_shared(segments(c)) for c in names], "segments")
    shared = _read(parts)
    couples = shared.where("two").select(F.col("lo").alias("a"), F.col("hi").alias("b"))
    more = shared.where("not two").select("seg", "m")
    if small_enough(more, BROADCAST_ROWS):
        met = [segments(F.concat(*names)).join(F.broadcast(more), "seg")]
    else:
        met = [segments(c).join(own.where("not two").select("seg", "m"), "seg") for c, own in zip(names, parts, strict=True)]
    met = _in_shares([x.select("seg", "content", "m").distinct() for x in met], "buckets")
    rows = _read(met)
    warm = rows.where(F.col("m") <= HOT_BUCKET).select("seg", "content")
    hot = rows.where(F.col("m") > HOT_BUCKET)
    dense = None
    if not hot.isEmpty():
        # buckets of the same contents give the same pairs: one of them is compared
        sized = hot.groupBy("seg").agg(F.count("*").alias("d"), F.bit_xor("content").alias("x"), F.bit_xor(F.xxhash64("content")).alias("y"))
        hot = hot.join(sized, "seg")
        warm = warm.unionByName(hot.where(F.col("d") <= HOT_BUCKET).select("seg", "content"))
        one = sized.where(F.col("d") > HOT_BUCKET).groupBy("d", "x", "y").agg(F.min("seg").alias("seg"))
        dense = _dense_pairs(hot.join(one.select("seg"), "seg", "left_semi"), made, least)
    pairs = warm.select("seg", F.col("content").alias("a")).join(warm.select("seg", F.col("content").alias("b")), "seg").where("a < b").select("a", "b").union(couples)
    pairs = materialize((pairs if dense is None else pairs.union(dense)).distinct(), "passpairs")
    for done in (made_now, *parts, *met):
        discard(done)
    return pairs


def near_duplicates(records: DataFrame, kinds: dict[str, int], least: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Records that share at least `least` of the longer one's words, counted as often as they occur in both.

    records: (kind, key, text); kinds gives the fewest words of a record of each kind that is compared. Returns
    (members, links): members (kind, key, content), one row a record, `content` being the class of records with the
    same words; links (kind, a, b, similarity), a < b, one row for each pair of classes that reaches `least`. Copies
    are thus never compared with one another, however many there are.

    Every record is a set of tokens (word, number of occurrence). Tokens are hashed to segments by as many independent
    hashings as make its segments; each segment's tokens are XORed to one word, which is equal in two records whose
    difference misses that segment. Segments hold as many tokens as the number of records calls for: those that
    carry too little information to tell records apart do not join. Segment counts depend on the size band (powers of two
    of the information in a record); a record also joins in the next band when a partner may lie there. Words in a fifth of
    all records stay out of the segments, as they occur everywhere; a record with hardly any other words is joined by
    all of them. Pairs that agree on a
    segment go through the size bound, the parity sketch's Hamming distance (a lower bound of the symmetric difference)
    and an exact count. A pair is found with a probability that grows with its similarity, from FOUND right at the limit
    on: a record joins by as many segments as that takes (slot_counts), however many records there are. They are joined in
    passes of PASS_SEGMENTS a record, each writing its pairs before the next begins, so that what lies on disk at once does
    not grow with the number of segments; within a pass, segments are brought together in SHARES of their values. A bucket of more than HOT_BUCKET contents is compared
    block by block, where only pairs within the two bounds become rows; no pair is lost by that. Common words are
    counted by 32-bit hashes of (word, occurrence): a pair of n and m words gains a false one with a chance of n * m / 2**32.

    The words in at least RARE_SHARE of the records are collected with their counts: they are at most 500 times as
    many as a record has different words on average.
    Null kinds, keys and texts give no rows, kinds that are not listed are left out, repeated rows count once, empty
    tables give empty results; other columns are not carried.
    """
    spark = records.sparkSession
    src = records.select(F.col("kind").cast("string"), F.col("key").cast("string"), F.col("text").cast("string")).where("kind is not null and key is not null and text is not null").where(F.col("kind").isin(*kinds))
    counted = src.mapInArrow(_frequencies(kinds), "kind string, word long, records long").groupBy("kind", "word").agg(F.sum("records").alias("records"))
    counted = materialize(counted, "words")
    total = {r.kind: r.records for r in counted.where("word = -1").collect()}
    known_words, bits = {}, {}
    for k in kinds:
        n = total.get(k, 0)
        rows = counted.where((F.col("kind") == k) & (F.col("word") >= 0) & (F.col("records") >= max(n * RARE_SHARE, 2))).select("word", "records").collect()
        known_words[k] = {r.word: int(max(-np.log2(r.records / n), 0) * 4) for r in rows}
        bits[k] = np.log2(max(n, 2)) + MORE_BITS
    made = src.mapInArrow(_records(kinds, known_words, bits, least), "kind string, key string, content long, n int, tokens array<int>, quarters array<byte>, sketch array<long>, counts array<int>")
    made = materialize(made, "sketches")
    members = materialize(made.select("kind", "key", "content").distinct(), "members")
    counts = {r.c: r.n for r in made.select(F.explode("counts").alias("c")).groupBy("c").agg(F.count("*").alias("n")).collect()}
    found = [_pass_pairs(made, bits, least, low, high) for low, high in passes(counts, max(PASS_SEGMENTS * sum(total.values()), PASS_LEAST, sum(c * n for c, n in counts.items()) / MOST_PASSES))]
    pairs = found[0] if found else made.select(F.col("content").alias("a"), F.col("content").alias("b")).where("false")
    for more in found[1:]:
        pairs = pairs.union(more)
    pairs = materialize(pairs.distinct(), "pairs")
    for done in found:
        discard(done)

    wanted = pairs.select(F.col("a").alias("content")).union(pairs.select("b")).distinct()
    # copies are dropped in a step of its own, so that its shuffle files don't lie beside all sketches
    copied = materialize(made.join(F.broadcast(wanted) if small_enough(wanted, BROADCAST_ROWS) else wanted, "content", "left_semi").select("content", "kind", "n", "sketch", "tokens"), "copied")
    discard(made)
    wanted = materialize(copied.dropDuplicates(["content"]), "wanted")
    discard(copied)
    side = lambda c: wanted.select(F.col("content").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    most = F.greatest("n_a", "n_b")
    need = F.ceil(F.lit(least) * most - 1e-9)
    apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    near = materialize(pairs.join(side("a"), "a").join(side("b"), "b").where(F.least("n_a", "n_b") >= need).where(apart <= F.col("n_a") + F.col("n_b") - 2 * need).select("a", "b", "n_a", "n_b"), "near")
    full = lambda c: wanted.select(F.col("content").alias(c), F.col("tokens").alias(f"t_{c}"), *([F.col("kind")] if c == "a" else []))
    common = F.size(F.array_intersect("t_a", "t_b"))
    links = near.join(full("a"), "a").join(full("b"), "b").withColumn("similarity", common / most).where(common >= need).select("kind", "a", "b", "similarity")
    return members, links


def classes(members: DataFrame, links: DataFrame) -> DataFrame:
    """One row a record: kind, key, class_id (smallest key with the same words) and n_links, its class's links to other classes."""
    ends = links.select(F.col("a").alias("content")).union(links.select("b")).groupBy("content").agg(F.count("*").alias("n_links"))
    first = members.groupBy("content").agg(F.min("key").alias("class_id"))
    return members.join(first, "content").join(ends, "content", "left").select("kind", "key", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """(kind, key_a, key_b), key_a < key_b: every pair of records, copies included. As many rows as there are pairs."""
    one = lambda c: members.select(F.col("content").alias(c), F.col("key").alias(f"k_{c}"))
    across = links.select("kind", "a", "b").join(one("a"), "a").join(one("b"), "b").select("kind", F.least("k_a", "k_b").alias("key_a"), F.greatest("k_a", "k_b").alias("key_b"))
    same = members.groupBy("content").agg(F.count("*").alias("m")).where("m > 1").select("content")
    copies = members.join(same, "content")
    within = copies.select("kind", "content", F.col("key").alias("key_a")).join(copies.select("content", F.col("key").alias("key_b")), "content").select("kind", "key_a", "key_b")
    return across.unionByName(within).where("key_a < key_b").distinct()
