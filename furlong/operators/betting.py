"""Settlement of bets of all types, returns, stakes and allocation.

A bet is (contest, bet_type, selection): ``selection`` is an array of entities, in finishing order for exacta and trifecta,
ascending otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: How many entities each bet type names, and whether their order counts.
BET_TYPES = {"win": (1, False), "place": (1, False), "exacta": (2, True), "quinella": (2, False), "wide": (2, False), "trifecta": (3, True), "trio": (3, False)}


def canonical(bet_type: Column, selection: Column) -> Column:
    """The selection as it is where order counts, ascending otherwise."""
    ordered = [t for t, (_, o) in BET_TYPES.items() if o]
    return F.when(bet_type.isin(ordered), selection).otherwise(F.array_sort(selection))


def selection_key(selection: Column) -> Column:
    return F.array_join(selection.cast("array<string>"), "-")


def expected_count(bet_type: Column, n: Column) -> Column:
    """How many selections of a bet type a field of n has; null for a type that is not known."""
    out = None
    for name, (k, ordered) in BET_TYPES.items():
        ways = F.lit(1)
        for j in range(k):
            ways = ways * F.when(n > j, n - j).when(n <= j, 0)
        ways = ways if ordered else F.floor(ways / (1, 1, 2, 6)[k])
        out = (F.when if out is None else out.when)(bet_type == name, ways.cast("long"))
    return out


def coverage(dividends: DataFrame, fields: DataFrame, contest: str) -> DataFrame:
    """(contest, bet_type, listed, expected, scope): distinct canonical selections of each contest and type against what the field (contest, n)
    has; scope is 'full', 'partial', 'excess', or null without a field or a known type."""
    one = dividends.select(contest, "bet_type", canonical(F.col("bet_type"), F.col("selection")).alias("selection")).filter("selection is not null").distinct()
    out = one.groupBy(contest, "bet_type").agg(F.count("*").alias("listed")).join(fields.select(contest, "n"), contest, "left")
    out = out.withColumn("expected", expected_count(F.col("bet_type"), F.col("n")))
    listed, expected = F.col("listed"), F.col("expected")
    return out.select(contest, "bet_type", "listed", "expected", F.when(listed == expected, "full").when(listed < expected, "partial").when(listed > expected, "excess").alias("scope"))


def outcomes(entries: DataFrame, contest: str, entity: str, order: str, started: str) -> DataFrame:
    """(contest, n, depth, top1, top2, top3, placed, voided): the finishers of the first ranks, each null unless every rank
    up to it is held by one entry; who placed (null on a dead heat across the last paying place); and who did not start."""
    from .joint import place_depth

    at = lambda k: F.collect_list(F.when(F.col(order) == k, F.col(entity))).alias(f"__{k}")
    o = entries.groupBy(contest).agg(F.sum(started).alias("n"), at(1), at(2), at(3), F.collect_set(F.when(F.col(started) == 0, F.col(entity))).alias("voided"))
    clear = {1: F.size("__1") == 1}
    clear[2] = clear[1] & (F.size("__2") == 1)
    clear[3] = clear[2] & (F.size("__3") == 1)
    depth = place_depth(F.col("n"))
    upto = F.when(depth == 3, F.concat("__1", "__2", "__3")).when(depth == 2, F.concat("__1", "__2"))
    tops = [F.when(clear[k], F.concat(*["__1", "__2", "__3"][:k])).alias(f"top{k}") for k in (1, 2, 3)]
    return o.select(contest, "n", depth.alias("depth"), *tops, F.when(F.size(upto) == depth, upto).alias("placed"), upto.alias("maybe_placed"), "voided", F.size("__1").alias("winners"), F.col("__1").alias("firsts"))


def settle(bets: DataFrame, results: DataFrame, contest: str) -> DataFrame:
    """``bets`` with hit (1, 0, or null where a dead heat leaves it open or the type does not pay in this field) and void (a
    selected entry did not start)."""
    b = bets.join(results, contest)
    t, s = F.col("bet_type"), F.col("selection")
    both = F.array_sort("top2")
    pays = (
        F.when(t == "win", F.when(F.size(F.array_intersect(s, "firsts")) == 0, F.lit(False)).when(F.col("winners") == 1, F.lit(True)))
        .when(t == "place", F.when(F.col("depth").isNull(), None).when(F.size(F.array_intersect(s, "maybe_placed")) == 0, F.lit(False)).when(F.col("placed").isNotNull(), F.lit(True)))
        .when(t == "exacta", s == F.col("top2")).when(t == "quinella", s == both)
        .when(t == "wide", F.size(F.array_intersect(s, "top3")) == 2)
        .when(t == "trifecta", s == F.col("top3")).when(t == "trio", s == F.array_sort("top3"))
    )
    void = F.arrays_overlap(s, "voided")
    return b.select(*bets.columns, F.when(~void, pays.cast("int")).alias("hit"), void.alias("void"))


def score(settled: DataFrame, dividends: DataFrame, contest: str, estimate: str) -> DataFrame:
    """``settled`` with its payout a unit: the real dividend, else ``estimate`` (a column of the bets); 0 for a miss, the
    stake back for a void, null where the hit is open."""
    d = dividends.select(contest, "bet_type", "selection", F.col("dividend").alias("__real"))
    b = settled.join(d, [contest, "bet_type", "selection"], "left")
    paid = F.when(F.col("void"), 1.0).when(F.col("hit") == 0, 0.0).when(F.col("hit") == 1, F.coalesce("__real", estimate))
    return b.withColumn("payout", paid).withColumn("estimated", (F.col("hit") == 1) & F.col("__real").isNull()).drop("__real")


def returns(scored: DataFrame, by: list[str]) -> DataFrame:
    """By each of ``by`` and in total ('__total__'): bets, void, skipped (open), hits, estimated payouts and the recovery of
    the bets that were settled."""
    live = F.col("payout").isNotNull() & ~F.col("void")
    out = scored.rollup(*by).agg(
        F.count("*").alias("bets"), F.count_if("void").alias("void"), F.count_if(F.col("payout").isNull()).alias("skipped"), F.sum(F.coalesce("hit", F.lit(0))).cast("long").alias("hits"),
        F.count_if("estimated").alias("estimated"), F.avg(F.when(live, F.col("payout"))).alias("recovery"),
    )
    return out.withColumns({c: F.coalesce(F.col(c), F.lit("__total__")) for c in by})


def kelly(p: Column, odds: Column, *, fraction: float = 0.5, cap: float = 0.05, estimated: Column | None = None, haircut: float = 0.8) -> Column:
    """Share of the bank: a fraction of the growth-optimal stake, 0 without an edge, capped; estimated odds are cut first."""
    o = odds if estimated is None else F.when(estimated, odds * haircut).otherwise(odds)
    return F.least(F.lit(cap), F.greatest(F.lit(0.0), fraction * F.try_divide(p * o - 1, o - 1)))


def informative_weights(rows: DataFrame, contest: str, p: str, odds: str, sharpness: float = 10.0, least: float = 1.0) -> DataFrame:
    """(contest, informative, weight): sigmoid of the best expected value less 1 for contests that hold any of at least
    ``least``, with a mean of 1 over those; 1 for the others."""
    c = rows.groupBy(contest).agg(F.max(F.col(p) * F.col(odds)).alias("ev")).withColumn("informative", F.col("ev") >= least)
    c = c.withColumn("w", 1 / (1 + F.exp(-sharpness * (F.col("ev") - 1))))
    mean = c.filter("informative").agg(F.avg("w").alias("m"))
    return c.crossJoin(F.broadcast(mean)).select(contest, "informative", F.when(F.col("informative"), F.col("w") / F.col("m")).otherwise(1.0).alias("weight"))


def stride_sample(cells: DataFrame, group: str, key: str, k: int, offset: Column) -> DataFrame:
    """k rows of each group, evenly spaced in the order of ``key`` from an offset; all rows of smaller groups."""
    w = Window.partitionBy(group)
    r = cells.withColumns({"__r": F.row_number().over(w.orderBy(key)) - 1, "__n": F.count("*").over(w)})
    hit = F.lit(False)
    for i in range(k):
        hit = hit | (F.col("__r") == F.pmod(offset + F.floor(F.col("__n") * i / k), F.col("__n")))
    return r.filter((F.col("__n") <= k) | hit).drop("__r", "__n")
