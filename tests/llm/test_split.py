import random
import re

from corpusmill.llm.split import cut, natural_offsets, split_items, split_oversized

TOKEN = re.compile(r"\w+|[^\w\s]")


def greedy(text, limit, overlap):
    """One cut after the other."""
    spans = [m.span() for m in TOKEN.finditer(text)]
    token_at = lambda offsets: {next((k for k, s in enumerate(spans) if s[0] >= o), len(spans)) for o in offsets}
    natural, blank = token_at(natural_offsets(text)), token_at([m.end() for m in re.finditer(r"\s+", text)])
    out, s = [], 0
    while spans:
        if len(spans) - s <= limit:
            return [*out, (spans[s][0], spans[-1][1])]
        window = range(s + overlap + 1, s + limit + 1)
        e = max([k for k in window if k in natural] or [k for k in window if k in blank] or [s + limit])
        out.append((spans[s][0], spans[e - 1][1]))
        s = e - overlap
    return out


def random_text(rng, n):
    return "".join(rng.choice(["word", "Big", "7", "é́", " "]) + rng.choice([" ", " ", " ", ". ", ".\n\n", "! ", ",", "—", "x", " e.g. ", "　"]) for _ in range(n))


def test_against_one_cut_after_the_other():
    rng = random.Random(2)
    for _ in range(60):
        texts = [random_text(rng, rng.randrange(0, 200)) for _ in range(5)] + ["", "  ", "-" * 90, "a" * 50]
        limit = rng.randrange(2, 40)
        overlap = rng.randrange(0, limit)
        found = cut(texts, limit, overlap)
        for k, t in enumerate(texts):
            assert [(a, b) for i, a, b, _ in found if i == k] == greedy(t, limit, overlap)


def test_abbreviations_end_no_sentence():
    t = "One thing, e.g. This one. Costs approx. Nine p.a. Or so! Then J. Doe left. (Really?) Yes"
    assert [t[o:].split()[0] for o in natural_offsets(t)] == ["Costs", "Then", "(Really?)", "Yes"]


def test_operator(spark):
    rng = random.Random(5)
    long = random_text(rng, 4000)
    rows = [("a", 1, long, "x"), ("a", 1, long, "y"), ("b", 2, "short text", "x"), (None, 3, long[::-1], "x"), ("c", 4, None, "x"), ("d", 5, "", "x"), ("e", None, "one two three " * 7, "x")]
    df = spark.createDataFrame(rows, "page_id string, idx int, text string, piece string")
    got = split_oversized(df, ["page_id", "idx"], "text", 20, 6).collect()
    assert {(r.page_id, r.idx) for r in got} == {("a", 1), (None, 3), ("e", None)}
    own = sorted((r for r in got if r.page_id == "a"), key=lambda r: r.piece)
    assert [r.piece for r in own] == list(range(len(own))) and all(len(TOKEN.findall(r.piece_text)) == r.n_tokens <= 20 for r in own)
    for p, q in zip(own, own[1:], strict=False):
        assert len(TOKEN.findall(long[q.start_char : p.end_char])) == 6
    assert own[0].start_char == TOKEN.search(long).start() and long[own[-1].end_char :].strip() == ""
    every = split_items(df, ["page_id", "idx"], "text", 20, 6)
    assert {(r.page_id, r.piece_text) for r in every.collect() if r.piece == 0} >= {("b", "short text"), ("d", "")}
    assert split_items(df.limit(0), ["page_id", "idx"], "text", 20, 6).count() == 0
