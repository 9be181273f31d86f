import os
import random

import pytest

from corpusmill.llm.public_tokens import DEFAULT_VOCABULARY, encoding
from corpusmill.llm import mixing
from corpusmill.llm.mixing import capped, entropy, exponent_for, mix, tempered, weights

needs_vocabulary = pytest.mark.skipif(not os.path.exists(DEFAULT_VOCABULARY), reason="no vocabulary file")


def test_tempering_meets_an_entropy():
    shares = {"a": 0.7, "b": 0.2, "c": 0.1}
    for e in (0.9, 1.0, 1.05):
        assert abs(entropy(tempered(shares, exponent_for(shares, e))) - e) < 1e-6
    assert tempered(shares, 0)["c"] == pytest.approx(1 / 3) and tempered({}, 0.5) == {}


def test_tempering_meets_a_repetition_limit():
    shares = {"a": 0.9, "b": 0.1}
    w = tempered(shares, exponent_for(shares, repeat_limit={"a": 2.0, "b": 0.3}))
    assert w["b"] == pytest.approx(0.3, abs=1e-6)


def test_caps_pass_on_what_they_keep():
    got = capped({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 0.2, "b": 2.0, "c": 2.0})
    assert got == pytest.approx({"a": 0.2, "b": 0.48, "c": 0.32})
    assert sum(capped({"a": 0.0, "b": 1.0}, {"a": 1.0, "b": 0.4}).values()) == pytest.approx(0.4)
    assert weights({"a": 0}, {"a": 1.0}, {}) == {}


@needs_vocabulary
def test_mix(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_DOCS", 7)
    rng = random.Random(6)
    sizes = {"Small ": 12, " big": 300, " mid": 80, "tiny": 3, "unlisted": 20}
    rows, n = [], 0
    for s, many in sizes.items():
        for _ in range(many):
            rows.append((n, " ".join(rng.choice("apple bread candle dust".split()) for _ in range(rng.randrange(1, 60))), rng.choice([s, s.upper()]), 9))
            n += 1
    rows += [(9001, None, "big", 1), (9002, "  \n", "big", 1), (9003, "x", None, 1), (None, "x", "big", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copies int")
    targets = spark.createDataFrame([("small", 0.4, 3), ("BIG", 0.2, 2), ("mid ", 0.3, 5), ("tiny", 0.05, 1), ("nowhere", 0.05, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mix(docs, "doc_id", "text", "source", targets)
    enc = encoding(DEFAULT_VOCABULARY)
    text = {r[0]: r[1] for r in rows if r[0] is not None}
    got = chosen.collect()
    assert len({r.doc_id for r in got}) == len(got) and all(r.n_tokens == len(enc.encode_ordinary(text[r.doc_id])) for r in got)
    by = {r.source: r for r in shares.collect()}
    assert set(by) == {"small", "big", "mid", "tiny", "nowhere"}
    total = sum(r.tokens for r in by.values())
    longest = max(r.n_tokens for r in got)
    assert abs(sum(r.mixed_tokens for r in by.values()) - total) <= 5 * longest
    want = weights({k: r.tokens for k, r in by.items()}, {k: r.target_share for k, r in by.items()}, {k: r.max_repeats for k, r in by.items()})
    for k, r in by.items():
        assert abs(r.mixed_tokens - want.get(k, 0) * total) <= longest
        own = [x for x in got if x.source == k]
        assert r.mixed_tokens == sum(x.n_tokens * x.copies for x in own) and all(1 <= x.copies <= r.max_repeats for x in own)
        assert max((x.copies for x in own), default=0) - min((x.copies for x in own), default=0) <= 1
    assert by["small"].mixed_tokens == 3 * by["small"].tokens
    again, _ = mix(docs.repartition(5), "doc_id", "text", "source", targets)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got))
    tempered_docs, tempered_shares = mix(docs, "doc_id", "text", "source", targets, temperature=True)
    assert tempered_docs.count() > 0 and abs(sum(r.reached_share for r in tempered_shares.collect()) - 1) < 1e-9


@needs_vocabulary
def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mix(docs, "doc_id", "text", "source", targets)
    assert chosen.count() == 0 and [r.reached_share for r in shares.collect()] == [0.0]
    chosen, shares = mix(docs, "doc_id", "text", "source", targets.limit(0))
    assert chosen.count() == 0 and shares.count() == 0
