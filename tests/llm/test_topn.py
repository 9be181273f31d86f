import random

from corpusmill.llm.topn import top_n


def brute(rows, n):
    best = {}
    for g, s, i in {r for r in rows if None not in r and r[1] == r[1]}:
        best.setdefault(g, []).append((-s, i))
    return {(g, i, k + 1) for g, v in best.items() for k, (_, i) in enumerate(sorted(v)[:n])}


def run(spark, rows, n, parts=5):
    df = spark.createDataFrame([(*r, "x", 9) for r in rows], "page_id string, score double, hit_id long, g string, local int")
    return {(r.page_id, r.hit_id, r.position) for r in top_n(df, "page_id", "score", "hit_id", n, parts).collect()}


def test_against_brute_force_with_hot_group_ties_and_repeats(spark):
    rng = random.Random(4)
    rows = [("hot" if rng.random() < 0.4 else f"p{rng.randrange(60)}", rng.choice([0.5, 0.25, -1.0, rng.random()]), rng.randrange(10**6)) for _ in range(3000)]
    rows += rows[:500] + [(None, 1.0, 1), ("p1", None, 2), ("p1", float("nan"), 3), ("z", -0.0, 5), ("z", 0.0, 4)]
    for n in (1, 3, 40):
        assert run(spark, rows, n, 7) == brute(rows, n)


def test_one_group_over_many_tasks(spark):
    rows = [("only", float(k % 11), k) for k in range(2000)]
    assert run(spark, rows, 500, 16) == brute(rows, 500)


def test_empty_table(spark):
    assert run(spark, [], 3) == set()


def test_all_rows_ineligible(spark):
    assert run(spark, [(None, 1.0, 1), ("a", None, 2)], 3) == set()
