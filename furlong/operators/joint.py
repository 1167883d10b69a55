"""Probabilities of finishing orders from win probabilities: each contest's entries are joined with each other by contest.

``field`` has one row for each entry: the contest, the entity, and p, which sums to 1 in its contest. ``lam`` holds the powers
that discount p at the second and third place; (1, 1) is the plain sequential model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

Powers = tuple[float, float]


def normalise_clip(field: DataFrame, contest: str, p: str, out: str, eps: float = 1e-6) -> DataFrame:
    """p divided by its contest's sum, kept within eps and 1 - eps, and divided again. A contest whose p sum to 0 gets equal
    shares."""
    w = Window.partitionBy(contest)
    once = field.withColumn(out, F.try_divide(F.col(p), F.sum(p).over(w)))
    once = once.withColumn(out, F.least(F.greatest(F.col(out), F.lit(eps)), F.lit(1 - eps)))
    return once.withColumn(out, F.col(out) / F.sum(out).over(w))


def market_share(field: DataFrame, contest: str, odds: str, out: str) -> DataFrame:
    """Normalised inverse odds; null in a contest where any entry has none above 1."""
    w = Window.partitionBy(contest)
    whole = F.count(F.when(F.col(odds) > 1, 1)).over(w) == F.count("*").over(w)
    return field.withColumn(out, F.when(whole, 1 / F.col(odds) / F.sum(1 / F.col(odds)).over(w)))


def _stages(field: DataFrame, contest: str, entity: str, p: str, lam: Powers, keep: tuple[str, ...] = ()) -> DataFrame:
    w = Window.partitionBy("c")
    df = field.select(F.col(contest).alias("c"), F.col(entity).alias("e"), F.col(p).alias("p"), *[F.col(k).alias(f"keep_{k}") for k in keep])
    df = df.withColumns({f"w{k}": F.col("p") if power == 1 else F.pow("p", F.lit(float(power))) for k, power in zip((2, 3), lam, strict=True)})
    return df.withColumns({"s2": F.sum("w2").over(w), "s3": F.sum("w3").over(w), "n": F.count("*").over(w)})


def _two(a: str, b: str) -> Column:
    """Probability that a wins and b is second."""
    return F.col(f"{a}.p") * F.try_divide(F.col(f"{b}.w2"), F.col(f"{a}.s2") - F.col(f"{a}.w2"))


def _three(a: str, b: str, c: str) -> Column:
    return _two(a, b) * F.try_divide(F.col(f"{c}.w3"), F.col(f"{a}.s3") - F.col(f"{a}.w3") - F.col(f"{b}.w3"))


def exacta(field: DataFrame, contest: str = "contest_id", entity: str = "entity_id", p: str = "p", lam: Powers = (1, 1)) -> DataFrame:
    """(contest, first, second, prob) of all ordered pairs."""
    s = _stages(field, contest, entity, p, lam)
    both = s.alias("a").join(s.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.e") != F.col("b.e")))
    return both.select(F.col("a.c").alias(contest), F.col("a.e").alias("first"), F.col("b.e").alias("second"), _two("a", "b").alias("prob"))


def quinella(field: DataFrame, contest: str = "contest_id", entity: str = "entity_id", p: str = "p", lam: Powers = (1, 1)) -> DataFrame:
    """(contest, low, high, prob): both in the first two, from each pair once."""
    s = _stages(field, contest, entity, p, lam)
    both = s.alias("a").join(s.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.e") < F.col("b.e")))
    return both.select(F.col("a.c").alias(contest), F.col("a.e").alias("low"), F.col("b.e").alias("high"), (_two("a", "b") + _two("b", "a")).alias("prob"))


def quinellas(field: DataFrame, probs: dict[str, str], contest: str = "contest_id", entity: str = "entity_id") -> DataFrame:
    """(contest, low, high, one column for each of ``probs``): ``quinella`` under several probabilities (the name out to the
    column of p) from one join; pairs joined to each other by both entities would be shuffled."""
    w = Window.partitionBy("c")
    s = field.select(F.col(contest).alias("c"), F.col(entity).alias("e"), *[F.col(p).alias(f"p_{n}") for n, p in probs.items()])
    s = s.withColumns({f"s_{n}": F.sum(f"p_{n}").over(w) for n in probs})
    both = s.alias("a").join(s.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.e") < F.col("b.e")))
    two = lambda x, y, n: F.col(f"{x}.p_{n}") * F.try_divide(F.col(f"{y}.p_{n}"), F.col(f"{x}.s_{n}") - F.col(f"{x}.p_{n}"))
    return both.select(F.col("a.c").alias(contest), F.col("a.e").alias("low"), F.col("b.e").alias("high"), *[(two("a", "b", n) + two("b", "a", n)).alias(n) for n in probs])


def _triples(s: DataFrame, how) -> DataFrame:
    both = s.alias("a").join(s.alias("b"), (F.col("a.c") == F.col("b.c")) & how("a.e", "b.e"))
    return both.join(s.alias("c"), (F.col("a.c") == F.col("c.c")) & how("b.e", "c.e") & how("a.e", "c.e"))


def trifecta(field: DataFrame, contest: str = "contest_id", entity: str = "entity_id", p: str = "p", lam: Powers = (1, 1), keep: tuple[str, ...] = ()) -> DataFrame:
    """(contest, first, second, third, prob) of all ordered triples. The entries' columns ``keep`` come along as first_<column> and
    so on: triples that look them up by entity later would be shuffled once for each place."""
    rows = _triples(_stages(field, contest, entity, p, lam, keep), lambda x, y: F.col(x) != F.col(y))
    places = {"first": "a", "second": "b", "third": "c"}
    kept = [F.col(f"{side}.keep_{k}").alias(f"{place}_{k}") for k in keep for place, side in places.items()]
    return rows.select(F.col("a.c").alias(contest), *[F.col(f"{side}.e").alias(place) for place, side in places.items()], _three("a", "b", "c").alias("prob"), *kept)


def trio(field: DataFrame, contest: str = "contest_id", entity: str = "entity_id", p: str = "p", lam: Powers = (1, 1)) -> DataFrame:
    """(contest, k1, k2, k3, prob) with k1 < k2 < k3: each triple once, with its six orders summed."""
    rows = _triples(_stages(field, contest, entity, p, lam), lambda x, y: F.col(x) < F.col(y))
    orders = [_three(*o) for o in ("abc", "acb", "bac", "bca", "cab", "cba")]
    total = orders[0]
    for o in orders[1:]:
        total = total + o
    return rows.select(F.col("a.c").alias(contest), F.col("a.e").alias("k1"), F.col("b.e").alias("k2"), F.col("c.e").alias("k3"), total.alias("prob"))


def wide(field: DataFrame, contest: str = "contest_id", entity: str = "entity_id", p: str = "p", lam: Powers = (1, 1)) -> DataFrame:
    """(contest, low, high, prob): both in the first three; in a field of two that is certain."""
    t = trio(field, contest, entity, p, lam)
    pairs = F.array(*[F.struct(F.col(x).alias("low"), F.col(y).alias("high")) for x, y in (("k1", "k2"), ("k1", "k3"), ("k2", "k3"))])
    more = t.select(contest, F.explode(pairs).alias("s"), "prob").groupBy(contest, "s.low", "s.high").agg(F.sum("prob").alias("prob"))
    two = field.groupBy(contest).agg(F.min(entity).alias("low"), F.max(entity).alias("high"), F.count("*").alias("n")).filter("n = 2")
    return more.unionByName(two.select(contest, "low", "high", F.lit(1.0).alias("prob")))


def marginals(field: DataFrame, contest: str = "contest_id", entity: str = "entity_id", p: str = "p", lam: Powers = (1, 1)) -> DataFrame:
    """(contest, entity, n, win, top2, top3): the probability to be among the first one, two and three; certain in a field
    no larger than that. Pairs and triples are summed as they are joined and never stored."""
    s = _stages(field, contest, entity, p, lam)
    both = s.alias("a").join(s.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.e") != F.col("b.e")))
    second = both.groupBy(F.col("b.c").alias("c"), F.col("b.e").alias("e")).agg(F.sum(_two("a", "b")).alias("second"))
    rows = _triples(s, lambda x, y: F.col(x) != F.col(y))
    third = rows.groupBy(F.col("c.c").alias("c"), F.col("c.e").alias("e")).agg(F.sum(_three("a", "b", "c")).alias("third"))
    out = s.select("c", "e", "n", "p").join(second, ["c", "e"], "left").join(third, ["c", "e"], "left")
    one = F.lit(1.0)
    top2 = F.when(F.col("n") <= 2, one).otherwise(F.least(one, F.col("p") + F.coalesce("second", F.lit(0.0))))
    top3 = F.when(F.col("n") <= 3, one).otherwise(F.least(one, F.col("p") + F.coalesce("second", F.lit(0.0)) + F.coalesce("third", F.lit(0.0))))
    return out.select(F.col("c").alias(contest), F.col("e").alias(entity), "n", F.when(F.col("n") == 1, one).otherwise(F.col("p")).alias("win"), top2.alias("top2"), top3.alias("top3"))


def place_depth(n: Column) -> Column:
    """How many places pay: 3 from eight entries on, 2 from five, else none."""
    return F.when(n >= 8, 3).when(n >= 5, 2)


def place(field: DataFrame, contest: str = "contest_id", entity: str = "entity_id", p: str = "p", lam: Powers = (1, 1)) -> DataFrame:
    """(contest, entity, prob) of the fields where places pay."""
    m = marginals(field, contest, entity, p, lam).withColumn("d", place_depth(F.col("n"))).filter("d is not null")
    return m.select(contest, entity, F.when(F.col("d") == 3, F.col("top3")).otherwise(F.col("top2")).alias("prob"))


def independent_pairs(field: DataFrame, contest: str = "contest_id", entity: str = "entity_id", p: str = "p") -> DataFrame:
    """(contest, low, high, product, uniform): the baselines on the same unordered pairs, each summing to 1."""
    f = field.select(F.col(contest).alias("c"), F.col(entity).alias("e"), F.col(p).alias("p"))
    both = f.alias("a").join(f.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.e") < F.col("b.e")))
    rows = both.select(F.col("a.c").alias(contest), F.col("a.e").alias("low"), F.col("b.e").alias("high"), (F.col("a.p") * F.col("b.p")).alias("x"))
    w = Window.partitionBy(contest)
    return rows.select(contest, "low", "high", F.try_divide("x", F.sum("x").over(w)).alias("product"), (1 / F.count("*").over(w)).alias("uniform"))


def consistency(field: DataFrame, contest: str = "contest_id", entity: str = "entity_id", p: str = "p", lam: Powers = (1, 1), tol: float = 1e-6) -> DataFrame:
    """(contest, n, checks that fail): exacta sums to 1 and its marginal is p, quinella, trio and trifecta sum to 1, wide sums
    to 3, and no pair's wide is below its quinella. Contests of three entries or more."""
    ex, qu, tr, wi = (f(field, contest, entity, p, lam) for f in (exacta, quinella, trio, wide))
    won = ex.groupBy(contest, F.col("first").alias(entity)).agg(F.sum("prob").alias("m"))
    off = lambda c, v: F.abs(F.coalesce(c, F.lit(-9.0)) - v) > tol
    parts = [
        ex.groupBy(contest).agg(F.sum("prob").alias("ex")), qu.groupBy(contest).agg(F.sum("prob").alias("qu")), tr.groupBy(contest).agg(F.sum("prob").alias("tr")), wi.groupBy(contest).agg(F.sum("prob").alias("wi")),
        won.join(field.select(contest, entity, F.col(p).alias("p")), [contest, entity]).groupBy(contest).agg(F.max(F.abs(F.col("m") - F.col("p"))).alias("worst")),
        wi.withColumnRenamed("prob", "wp").join(qu, [contest, "low", "high"]).groupBy(contest).agg(F.count_if(F.col("wp") < F.col("prob") - tol).alias("below")),
    ]
    out = field.groupBy(contest).agg(F.count("*").alias("n")).filter("n >= 3")
    for part in parts:
        out = out.join(part, contest, "left")
    fails = off(F.col("ex"), 1).cast("long") + off(F.col("qu"), 1).cast("long") + off(F.col("tr"), 1).cast("long") + off(F.col("wi"), 3).cast("long") + (F.col("worst") > tol).cast("long") + F.col("below")
    return out.select(contest, "n", fails.alias("fails"))
