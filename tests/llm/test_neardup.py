import random
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import neardup
from corpusmill.llm.neardup import all_pairs, classes, near_duplicates

WORDS = [a + b + c for a in "ba co di fu ge ha".split() for b in "ra lo mi nu sé ti".split() for c in "n st x ld".split()]


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        rng.choice([lambda: out.__setitem__(k, rng.choice(WORDS)), lambda: out.insert(k, rng.choice(WORDS)), lambda: out.pop(k)])()
    if rng.random() < 0.3:
        k = rng.randrange(len(out))
        out = out[k:] + out[:k]
    return out


def corpus(rng, groups, size):
    rows = []
    for g in range(groups):
        base = [rng.choice(WORDS) for _ in range(rng.randrange(*size))]
        for m in range(rng.choice([1, 1, 1, 2, 3, 6])):
            rows.append((f"{g:03}-{m}", " ".join(edited(rng, base, rng.randrange(0, len(base) // 8 + 1)) if m else base).title()))
    return rows


def brute(rows, kind, fewest, least=0.75):
    counts = [(k, Counter(neardup.WORD.findall(t.lower()))) for k, t in dict(rows).items() if t]
    counts = [(k, c, sum(c.values())) for k, c in counts if sum(c.values()) >= fewest]
    return {(kind, min(k, j), max(k, j)) for x, (k, c, n) in enumerate(counts) for j, d, m in counts[x + 1 :] if sum((c & d).values()) >= least * max(n, m)}


def frame(spark, rows):
    return spark.createDataFrame([(*r, "n", 3) for r in rows], "kind string, key string, text string, content string, n int")


@pytest.mark.parametrize(("hot", "held"), [(neardup.HOT_BUCKET, neardup.PASS_LEAST), (2, 50_000)])
def test_against_all_pairs(spark, monkeypatch, hot, held):
    monkeypatch.setattr(neardup, "HOT_BUCKET", hot)
    monkeypatch.setattr(neardup, "PASS_LEAST", held)
    rng = random.Random(12)
    pages, units = corpus(rng, 90, (100, 500)), corpus(rng, 90, (40, 130))
    pages += [("copy1", pages[0][1]), ("copy2", pages[0][1].upper()), ("reversed", " ".join(reversed(pages[0][1].split())))]
    rows = [("page", *r) for r in pages] + [("unit", *r) for r in units]
    rows += rows[:20] + [("page", "short", "a b c"), ("page", "none", None), ("page", None, pages[0][1]), (None, "x", pages[0][1]), ("other", "y", pages[0][1]), ("unit", "empty", "")]
    members, links = near_duplicates(frame(spark, rows), {"page": 100, "unit": 40})
    want = brute(pages, "page", 100) | brute(units, "unit", 40)
    got = {tuple(r) for r in all_pairs(members, links).collect()}
    assert len(want) > 100 and got == want
    own = {r.key: r for r in classes(members, links).collect() if r.kind == "page"}
    assert own["copy1"].class_id == own["copy2"].class_id == own["reversed"].class_id == own["000-0"].class_id
    assert own["copy1"].n_links == own["000-0"].n_links
    assert "short" not in own


def test_many_copies_are_one_class(spark):
    text = " ".join(WORDS[:120])
    members, links = near_duplicates(frame(spark, [("page", f"k{k}", text) for k in range(300)]), {"page": 100})
    assert links.count() == 0 and classes(members, links).select("class_id").distinct().count() == 1


def test_few_rare_words(spark):
    """Records made of frequent words only are joined by all their words."""
    rng = random.Random(1)
    rows = [("unit", f"k{k:02}", " ".join(rng.choice(WORDS[:30]) for _ in range(60))) for k in range(30)]
    rows += [("unit", f"e{k:02}", rows[k][2] + " extra words here") for k in range(10)]
    members, links = near_duplicates(frame(spark, rows), {"unit": 40})
    assert {tuple(r) for r in all_pairs(members, links).collect()} >= {("unit", f"e{k:02}", f"k{k:02}") for k in range(10)}


def test_empty(spark):
    members, links = near_duplicates(frame(spark, []), {"page": 100})
    assert members.count() == links.count() == all_pairs(members, links).count() == 0


def test_hot_buckets_lose_no_pair(spark, monkeypatch):
    """Groups of edited copies with pairs that share one segment only: blocks find what the plain join of the bucket finds."""
    rng = random.Random(5)
    rows = []
    for g in range(8):
        base = [rng.choice(WORDS) for _ in range(60)]
        for m in range(40):
            out = list(base)
            for k in rng.sample(range(60), 8):
                out[k] = rng.choice(WORDS)
            rows.append(("unit", f"{g}-{m:02}", " ".join(out)))
    links = []
    for hot, block in ((10**6, 4096), (3, 16)):
        monkeypatch.setattr(neardup, "HOT_BUCKET", hot)
        monkeypatch.setattr(neardup, "BLOCK", block, raising=False)
        links.append({tuple(r) for r in near_duplicates(frame(spark, rows), {"unit": 40}, 0.75)[1].select("a", "b").collect()})
    assert len(links[0]) > 500 and links[1] == links[0]


def test_passes_cover_all_segments():
    rng = random.Random(2)
    for _ in range(50):
        counts = {rng.randrange(0, 3000): rng.randrange(1, 500) for _ in range(rng.randrange(1, 9))}
        most = rng.randrange(500, 200_000)
        ranges = neardup.passes(counts, most)
        assert [a for a, _ in ranges] == [0, *[b for _, b in ranges]][: len(ranges)] and (ranges[-1][1] if ranges else 0) == max(counts)
        for a, b in ranges:
            held = sum(n * (min(max(c, a), b) - a) for c, n in counts.items())
            assert held <= most or b == a + 1


@pytest.mark.parametrize(("records", "n", "pairs"), [(10**5, 45, 200), (10**5, 200, 200), (10**7, 60, 200), (10**9, 120, 60)])
def test_recall_at_the_limit_holds_for_any_record_count(records, n, pairs):
    """Pairs of exactly the least similarity, in the segments of so many records: nearly all share one."""
    rng = np.random.default_rng(3)
    word = lambda: int(rng.integers(1 << neardup.WORD_BITS)) << neardup.QUARTERS | int(rng.uniform(2.4, 8.97) * 4)
    words = []
    for _ in range(pairs):
        base = [word() for _ in range(n)]
        other = list(base)
        for k in rng.permutation(n)[: n // 4]:
            other[k] = word()
        words += [base, other]
    made = neardup.sketch_batch(words)
    segments = neardup.Segments(made["n"], made["tokens"], made["quarters"], np.full(len(words), np.log2(records) + neardup.MORE_BITS), 0.75)
    most = int(segments.counts().max())
    met = set()
    for low, high in ((0, 50), (50, 51), (51, most)):
        owner, value = segments.words(low, high)
        assert len(set(zip(owner.tolist()[:5000], value.tolist()[:5000], strict=True))) == min(len(owner), 5000)
        even = owner % 2 == 0
        for pair in np.unique(np.intersect1d(owner[even] // 2 * 2**50 + value[even] % 2**50, owner[~even] // 2 * 2**50 + value[~even] % 2**50) // 2**50).tolist():
            met.add(pair)
    assert len(met) >= 0.96 * pairs


def test_a_pass_shuffles_a_share_of_its_segments_at_once(spark, monkeypatch):
    """What a step of a pass writes to shuffle files, which is what lies on disk at once besides the tables."""
    monkeypatch.setattr(neardup, "PASS_SEGMENTS", 10**6)
    shuffled, held = [], []
    materialize = neardup.materialize
    sc = spark.sparkContext

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        seq = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {seq.apply(k).stageId(): seq.apply(k).shuffleWriteRecords() for k in range(seq.size())}

    def watched(df, tag):
        before = stages()
        out = materialize(df, tag)
        if tag == "keys":
            held.append(sum(len(x) for r in out.collect() for x in r[1:]))
            shuffled.append(0)
        elif tag == "segments":
            shuffled[-1] = max([shuffled[-1], *(n for k, n in stages().items() if k not in before)])
        return out

    monkeypatch.setattr(neardup, "materialize", watched)
    rng = random.Random(4)
    rows = [("unit", k, t) for k, t in corpus(rng, 60, (60, 130))]
    members, links = near_duplicates(frame(spark, rows), {"unit": 40})
    assert {tuple(r) for r in all_pairs(members, links).collect()} == brute([r[1:] for r in rows], "unit", 40)
    assert len(held) == 1 and held[0] > 5_000 and 0 < shuffled[0] <= 0.4 * held[0]
