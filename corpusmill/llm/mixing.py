"""Problem 8: sources mixed to target weights."""

from __future__ import annotations

from math import exp, isqrt, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.public_tokens import DEFAULT_VOCABULARY, public_token_count
from corpusmill.session import materialize

#: Documents a block holds on average, at least; so many that a source has no more blocks than a block has documents, where
#: it has more than the square of this.
BLOCK_DOCS = 2000


def entropy(shares: dict[str, float]) -> float:
    return -sum(w * log(w) for w in shares.values() if w > 0)


def tempered(shares: dict[str, float], exponent: float) -> dict[str, float]:
    """Shares raised to an exponent and normalised: 1 leaves them, 0 makes them equal."""
    top = max(shares.values(), default=0)
    raised = {k: exp(exponent * log(w / top)) if w > 0 else 0.0 for k, w in shares.items()}
    total = sum(raised.values())
    return {k: w / total for k, w in raised.items()} if total else {}


def exponent_for(shares: dict[str, float], target_entropy: float | None = None, repeat_limit: dict[str, float] | None = None) -> float:
    """The exponent in [0, 1] at which the tempered shares have the target entropy, or the smallest at which no source is
    asked for more than its limit (the largest share each can give); found by bisection. 1 where even that is not enough."""

    def enough(a: float) -> bool:
        w = tempered(shares, a)
        if target_entropy is not None:
            return entropy(w) <= target_entropy
        return all(w[k] <= repeat_limit[k] + 1e-12 for k in w)

    low, high = 0.0, 1.0
    if enough(low):
        return low
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if enough(mid) else (mid, high)
    return high


def capped(shares: dict[str, float], caps: dict[str, float]) -> dict[str, float]:
    """Shares of the mix: as wanted where the cap allows, capped otherwise; what capped sources cannot give goes to
    the others in proportion to their wanted shares. The common factor is found by bisection. Sums to 1 if the caps do."""
    room = sum(caps[k] for k in shares)
    if room <= 1:
        return {k: caps[k] for k in shares}
    taken = lambda f: sum(min(caps[k], f * w) for k, w in shares.items())
    low, high = 0.0, 1.0
    while taken(high) < 1 and high < 1e18:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if taken(mid) < 1 else (low, mid)
    return {k: min(caps[k], high * w) for k, w in shares.items()}


def weights(tokens: dict[str, int], wanted: dict[str, float] | None, repeats: dict[str, float], target_entropy: float | None = None) -> dict[str, float]:
    """Share of each source in the mix. tokens: what each source has; repeats: how often a document may be used in all.

    Without wanted shares the natural ones are tempered to the target entropy, or, without one, as far towards equal
    shares as the repetition limits allow. Shares are then normalised over the sources that have tokens and capped.
    """
    have = {k: t for k, t in tokens.items() if t > 0}
    total = sum(have.values())
    if not total:
        return {}
    caps = {k: repeats.get(k, 1) * t / total for k, t in have.items()}
    if wanted is None:
        natural = {k: t / total for k, t in have.items()}
        shares = tempered(natural, exponent_for(natural, target_entropy, caps))
    else:
        asked = {k: max(wanted.get(k, 0.0), 0.0) for k in have}
        s = sum(asked.values())
        shares = {k: w / s for k, w in asked.items()} if s else {}
    return capped(shares, caps) if shares else {}


def source_key(source: Column) -> Column:
    """A source's name, trimmed (all white space) and in lower case."""
    return F.lower(F.regexp_replace(source, r"^[\s\x1c-\x1f\x85\p{Z}]+|[\s\x1c-\x1f\x85\p{Z}]+$", ""))


def mix(docs: DataFrame, ident: str, text: str, source: str, targets: DataFrame, target_entropy: float | None = None, temperature: bool = False, vocabulary: str = DEFAULT_VOCABULARY, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(documents, shares). documents: ident, source, n_tokens, copies (1 or more), the mix; shares: source, target_share,
    max_repeats, tokens, mixed_tokens, reached_share, one row a listed source.

    targets: source, target_share, max_repeats; sources are compared trimmed and in lower case. The mix has as many tokens
    as the listed sources' non-blank documents together. Each source gets its target share, as far as max_repeats lets it;
    what it cannot give goes to the others in proportion (`temperature` takes tempered natural shares instead). A source
    budget of r whole passes and a rest is realised as r copies of every document, and one more for those that come first
    in a pseudo-random order until the rest is used up. The order is one of blocks, hashed by document, and within a block
    by hash; the blocks' token sums are prefix-summed, so that only the one block a source's budget ends in is looked at
    document by document. Reached shares miss the wanted ones by less than one document a source.

    targets are one row a source and are held by the driver, as are the sources' token sums. Null and blank texts, null ids
    and sources that are null or not listed do not take part; a source listed twice keeps its largest max_repeats and the
    sum of its shares; null shares and repeats count as 0 and 1. Repeated rows of one id are documents of their own.
    """
    asked = targets.select(source_key(F.col("source")).alias("source"), F.coalesce("target_share", F.lit(0.0)).alias("w"), F.coalesce("max_repeats", F.lit(1)).alias("r")).where("source is not null")
    rows = asked.groupBy("source").agg(F.sum("w").alias("w"), F.max("r").alias("r")).collect()
    listed = {r.source: (r.w, r.r) for r in rows}
    kept = docs.select(F.col(ident).alias("id"), F.col(text).alias("text"), source_key(F.col(source)).alias("source"))
    kept = kept.where("id is not null and text is not null").where(F.col("source").isin(list(listed))).where(F.col("text").rlike(r"[^\s\x1c-\x1f\x85\p{Z}]"))
    sized = kept.select("id", "source", public_token_count(F.col("text"), vocabulary).alias("n"), F.xxhash64(F.lit(seed), "id", "text").alias("h"))
    sized = materialize(sized, "mixsizes")
    sums = {r.source: (r.n, r.docs) for r in sized.groupBy("source").agg(F.sum("n").alias("n"), F.count("*").alias("docs")).collect()}
    tokens = {k: int(sums[k][0]) if k in sums else 0 for k in listed}
    total = sum(tokens.values())
    share = weights(tokens, None if temperature else {k: v[0] for k, v in listed.items()}, {k: float(v[1]) for k, v in listed.items()}, target_entropy)
    spark = docs.sparkSession
    plan = []
    for k, (want, most) in sorted(listed.items()):
        budget = share.get(k, 0.0) * total
        passes = min(int(budget // tokens[k]), most) if tokens[k] else 0
        plan.append((k, float(want), int(most), tokens[k], passes, float(budget - passes * tokens[k]) if passes < most else 0.0, max(1, sums[k][1] // max(BLOCK_DOCS, isqrt(sums[k][1]))) if k in sums else 1))
    plan_df = F.broadcast(spark.createDataFrame(plan, "source string, target_share double, max_repeats int, tokens long, passes int, rest double, blocks long"))
    placed = sized.join(plan_df.select("source", "passes", "rest", "blocks"), "source").withColumn("block", F.pmod("h", F.col("blocks")))
    blocks = placed.groupBy("source", "block", "rest").agg(F.sum("n").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.withColumn("upto", upto).withColumn("state", F.when(F.col("upto") <= F.col("rest"), 1).when(F.col("upto") - F.col("size") < F.col("rest"), 0).otherwise(-1))
    blocks = materialize(blocks.where("state >= 0").select("source", "block", "state", (F.col("upto") - F.col("size")).alias("before")), "mixblocks")
    split = placed.join(blocks.where("state = 0"), ["source", "block"])
    run = F.sum("n").over(Window.partitionBy("source").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, 0))
    # the document at the end is taken when most of it fits
    edge = split.withColumn("run", run).select("id", "source", "n", "passes", F.when(F.col("before") + F.col("run") - F.col("n") / 2 <= F.col("rest"), 1).otherwise(0).alias("more"))
    others = placed.join(blocks.where("state = 0").select("source", "block"), ["source", "block"], "left_anti").join(blocks.where("state = 1").select("source", "block", "state"), ["source", "block"], "left")
    others = others.select("id", "source", "n", "passes", F.coalesce("state", F.lit(0)).alias("more"))
    mixed = edge.unionByName(others).select(F.col("id").alias(ident), "source", F.col("n").alias("n_tokens"), (F.col("passes") + F.col("more")).alias("copies")).where("copies > 0")
    mixed = materialize(mixed, "mix")
    reached = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"))
    whole = F.sum("mixed_tokens").over(Window.partitionBy())  # one row a listed source
    shares = plan_df.select("source", "target_share", "max_repeats", "tokens").join(reached, "source", "left").withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    return mixed, shares.withColumn("reached_share", F.when(whole > 0, F.col("mixed_tokens") / whole).otherwise(0.0))
