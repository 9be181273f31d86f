import random

from corpusmill.llm.stuffing import block_measures, blocks, stuffed

NOUNS = "ledger meter portal quote winter market garden bridge letter engine window valley doctor singer copper".split()
MANY = [x + y + z for x in "bra cor del fin gor hul mar nes pol ran".split() for y in "ti mo la ve ku sa".split() for z in "nd rt x l sh mp".split()]
LINKING = "the of and to in is that for with on by from as".split()


def prose(rng, n):
    return " ".join(" ".join(w for _ in range(rng.randrange(4, 9)) for w in (rng.choice(LINKING), rng.choice(MANY))).capitalize() + "." for _ in range(n))


def spam(rng, kind):
    if kind == "keywords":
        return ", ".join(rng.choice(["cheap ", "best ", "buy "]) + "ledger tool" for _ in range(60))
    if kind == "tags":
        return " ".join(f"#{rng.choice(NOUNS)}{rng.choice(NOUNS).title()}" for _ in range(40))
    if kind == "links":
        return "\n".join(f"https://{rng.choice(NOUNS)}.example/{rng.choice(NOUNS)}-{rng.randrange(99)}" for _ in range(30))
    return " ".join(f"{rng.choice(['Cheap', 'Best', 'Buy'])} ledger tool for {rng.choice(NOUNS)} {rng.choice(NOUNS)}." for _ in range(40))


def test_kinds_and_hard_negatives(spark):
    rng = random.Random(3)
    rows, want = [], set()
    for k in range(400):
        rows.append((k, "\n\n".join(prose(rng, rng.randrange(1, 6)) for _ in range(rng.randrange(1, 5)))))
    for k, kind in enumerate(["keywords", "tags", "links", "slogans"] * 5, 1000):
        rows.append((k, spam(rng, kind)))
        want.add(k)
    rows.append((2000, prose(rng, 12) + "\n\n" + spam(rng, "tags")[:120]))  # a few tags at the end
    rows.append((2001, "\n".join(f"- 1.{j}: " + prose(rng, 1) for j in range(20))))
    rows.append((2002, "A short heading\n\nAnother heading of the page\n\n" + prose(rng, 1)))
    rows += [(3000, None), (3001, ""), (3002, " \n\n "), (None, spam(rng, "tags")), (3003, "x" * 300000), (3004, "!!! ??? ...")]
    df = spark.createDataFrame([(i, t, "en", 1) for i, t in rows + rows[400:403]], "doc_id long, text string, lang string, words int")
    assert {r.doc_id for r in stuffed(df, "doc_id", "text").collect()} == want
    assert stuffed(df.limit(0), "doc_id", "text").count() == 0


def test_blocks_join_items_without_sentence_end():
    assert blocks("a\n\nb\n\nC is here.\n\n\n\nd") == ["a\nb", "C is here.", "d"]


def test_language_is_judged_by_the_block(spark):
    """A long opening in another language does not choose the norm of the rest, and spam without a language is no norm of its own."""
    opening = "Der Markt und die Brücke sind nicht für das Fenster. " * 120
    mixed = opening.strip() + "\n\n" + prose(random.Random(2), 60)
    got = block_measures(spark.createDataFrame([(1, mixed)], "id int, t string"), "id", "t").collect()
    assert {r.lang for r in got} == {"de", "en"}
    rng = random.Random(4)
    rows = [(k, prose(rng, 24)) for k in range(200)] + [(k, "Cheap blue widgets. " * rng.randrange(76, 100)) for k in range(1000, 1080)]
    assert {r.id for r in stuffed(spark.createDataFrame(rows, "id int, t string"), "id", "t").collect()} == set(range(1000, 1080))
