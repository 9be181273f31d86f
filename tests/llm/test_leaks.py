import random

import numpy as np

from corpusmill.llm.leaks import Items, distances, find, leaks, plain

VOCABULARY = [x + y for x in "ba co di fu ge".split() for y in "ra lo mi nu sé".split()] + ["a", "I", "9", "straße"]


def brute(docs, items, n):
    out = set()
    shingles = lambda t: {tuple(w[k : k + n]) for w in [plain(t).split()] for k in range(len(w) - n + 1)}
    by = {k: shingles(t) for k, t in items}
    for d, t in docs:
        s = shingles(t)
        out |= {(d, k) for k, v in by.items() if s & v}
    return out


def sentence(rng, n):
    return "".join(rng.choice(VOCABULARY) + rng.choice([" ", " ", ", ", " — ", "_", "\n"]) for _ in range(n))


def cases(rng):
    items = [(k, sentence(rng, rng.randrange(5, 60))) for k in range(30)] + [(99, "too short"), (98, "")]
    docs = []
    for k in range(300):
        parts = [sentence(rng, rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = plain(rng.choice(items)[1]).split()
            a = rng.randrange(max(1, len(w) - 3))
            parts += [rng.choice([" ", "; ", " · "]).join(w[a : a + rng.randrange(6, 16)]).upper(), sentence(rng, rng.randrange(6))]
        docs.append((k, " ".join(parts)))
    return docs, items


def apart(pattern, text):
    """Fewest edits that turn pattern into a part of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for c in pattern:
        new = [row[0] + 1]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


def edited_brute(docs, items, n, most):
    out = {}
    for k, t in items:
        w = plain(t).split()
        for d, x in docs:
            best = min((apart(f" {' '.join(w[a : a + n])} ", f" {plain(x)} ") for a in range(len(w) - n + 1)), default=99)
            if best <= most:
                out[d, k] = best
    return out


def test_against_all_shingles(spark):
    docs, items = cases(random.Random(8))
    want = brute(docs, items, 12)
    assert len(want) > 30
    for edits in (0, 1, 2):
        own = Items(items, 12, edits)
        assert {(docs[d][0], own.keys[i]) for d, i, e in find([plain(t) for _, t in docs], own) if e == 0} == want
    d = spark.createDataFrame([(*r, 5) for r in docs + docs[:9] + [(None, docs[0][1]), (900, None), (901, "")]], "doc_id long, text string, item_id int")
    i = spark.createDataFrame(items + items[:3] + [(None, "x " * 20), (97, None)], "item_id long, text string")
    found = leaks(d, "doc_id", "text", i, "item_id", "text", 12).collect()
    assert {(r.doc_id, r.item_id) for r in found if r.edits == 0} == want and len(found) == len({(r.doc_id, r.item_id) for r in found})
    assert leaks(d.limit(0), "doc_id", "text", i, "item_id", "text").count() == 0
    assert leaks(d, "doc_id", "text", i.limit(0), "item_id", "text").count() == 0


def test_edited_passages_against_the_whole_table():
    rng = random.Random(4)
    items = [(k, sentence(rng, rng.randrange(12, 30))) for k in range(8)] + [(50, "a b c d e f g h i j k l m")]
    docs = []
    for k in range(60):
        w = plain(rng.choice(items)[1])
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(w))
            w = rng.choice([w[:at] + w[at + 1 :], w[:at] + "x" + w[at:], w[:at] + "z" + w[at + 1 :], w[:at] + " " + w[at:]])
        docs.append((k, " ".join([sentence(rng, rng.randrange(6)), w, sentence(rng, rng.randrange(6))])))
    for edits in (1, 2, 3):
        own = Items(items, 12, edits)
        got = {(docs[d][0], own.keys[i]): e for d, i, e in find([plain(t) for _, t in docs], own)}
        assert got == edited_brute(docs, items, 12, edits) and len(set(got.values())) == edits + 1


def test_no_passage_reaches_from_one_document_into_the_next():
    words = "the copper cistern clause obliges moganium suite to credit ninety two days".split()
    own = Items([(1, " ".join(words))], 12, 2)
    assert find([" ".join(words[:6]), " ".join(words[6:]), "x" + " ".join(words)], own) == [(2, 0, 1)]


def test_distances():
    codes = lambda t: np.frombuffer(t.encode("utf-32-le"), np.uint32)
    one = lambda p, t, first, width, most: int(distances(codes(t), np.array([first]), codes(p), np.array([0]), np.array([len(p)]), width, most)[0])
    assert one("abcdef", "abcdef  ", 0, 2, 2) == 0
    assert one("abcdef", "xxabcdef  ", 0, 4, 2) == 0
    assert one("abcdef", "abxdef  ", 0, 3, 2) == 1
    assert one("abcdef", "xabdefx  ", 0, 4, 2) == 1
    assert one("abcdef", "uvwxyz  ", 0, 4, 2) == 3
