"""Settlement, returns, strategies, cells, gates and fits over the contest panel, with oracles in SQL of another form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import betting as bt, bootstrap as bs, fits, joint
from ..sources.panel import market, panel
from .scores import _boot

PAYOUT, CAP = 0.75, 9999.0


def field_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bet of each type on each contest's lowest prices, whether those entries started or not."""
    ranked = panel(spark, sf_dir).groupBy("contest_id").agg(F.array_sort(F.collect_list(F.struct("odds", "entity_id"))).alias("r"))
    ids = F.transform("r", lambda x: x["entity_id"])
    types = F.array(*[F.struct(F.lit(t).alias("bet_type"), F.slice(ids, 1, k).alias("selection"), F.lit(k).alias("k")) for t, (k, _) in bt.BET_TYPES.items()])
    bets = ranked.select("contest_id", F.explode(types).alias("b")).select("contest_id", "b.*").filter(F.size("selection") == F.col("k"))
    return bets.select("contest_id", "bet_type", bt.canonical(F.col("bet_type"), F.col("selection")).alias("selection"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bt.outcomes(panel(spark, sf_dir), "contest_id", "entity_id", "finish_order", "started")


def settlement_all(s: SparkSession, d: str) -> DataFrame:
    out = bt.settle(field_choice(s, d), results(s, d), "contest_id")
    return out.select("contest_id", "bet_type", bt.selection_key(F.col("selection")).alias("selection"), "hit", "void")


def raw_dividends(s: SparkSession, d: str) -> DataFrame:
    """What a dividend feed holds: selections in any order, a correction after some rows, and contests only in part."""
    r = results(s, d).filter("top3 is not null").select("contest_id", "top3", "depth", "placed")
    o = panel(s, d).filter("finish_order <= 3").groupBy("contest_id").agg(F.map_from_entries(F.collect_list(F.struct("entity_id", "odds"))).alias("o"))
    r = r.join(o, "contest_id")
    e, price = [F.col("top3")[k] for k in range(3)], [F.col("o")[F.col("top3")[k]] for k in range(3)]
    row = lambda t, sel, v: F.struct(F.lit(t).alias("bet_type"), F.array(*sel).alias("selection"), F.round(v, 1).alias("dividend"))
    rows = [row("win", e[:1], price[0]), row("exacta", e[:2], price[0] * price[1] * 0.6), row("quinella", [e[1], e[0]], price[0] * price[1] * 0.4), row("trifecta", e, price[0] * price[1] * price[2] * 0.4), row("trio", e[::-1], price[0] * price[1] * price[2] * 0.2)]
    rows += [row("wide", [e[j], e[i]], price[i] * price[j] * 0.2) for i, j in ((0, 1), (0, 2), (1, 2))]
    scope = F.when(F.col("contest_id") % 4 == 0, "partial").otherwise("full").alias("scope")
    first = r.select("contest_id", scope, F.explode(F.array(*rows)).alias("b")).select("contest_id", "scope", "b.*", F.lit(1).alias("seq"))
    return first.unionByName(first.filter("contest_id % 5 = 0").select("contest_id", "scope", "bet_type", "selection", F.round(F.col("dividend") + 1, 1).alias("dividend"), F.lit(2).alias("seq")))


def load_dividends(raw: DataFrame) -> DataFrame:
    """Dividends by canonical selection, the last row of each, of fully covered contests only."""
    rows = raw.filter("scope = 'full'").withColumn("selection", bt.canonical(F.col("bet_type"), F.col("selection")))
    return rows.groupBy("contest_id", "bet_type", "selection").agg(F.max_by("dividend", "seq").alias("dividend"))


def dividends_load(s: SparkSession, d: str) -> DataFrame:
    out = load_dividends(raw_dividends(s, d))
    return out.select("contest_id", "bet_type", bt.selection_key(F.col("selection")).alias("selection"), "dividend")


def returns_by_type(s: SparkSession, d: str) -> DataFrame:
    settled = bt.settle(field_choice(s, d).withColumn("estimate", F.lit(5.0)), results(s, d), "contest_id")
    out = bt.returns(bt.score(settled, load_dividends(raw_dividends(s, d)), "contest_id", "estimate"), ["bet_type"])
    return out.withColumn("recovery", F.round("recovery", 6))


def pair_cells(s: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of each contest: model probability, estimated odds from the market's, and expected value."""
    cells = joint.quinellas(market(s, d), {"prob": "p", "qprob": "q"})
    cells = cells.withColumn("odds", F.least(F.lit(CAP), PAYOUT / F.col("qprob")))
    return cells.select("contest_id", "low", "high", "prob", "odds", F.round(F.col("prob") * F.col("odds"), 9).alias("ev"))


def settled_pairs(s: SparkSession, d: str, cells: DataFrame) -> DataFrame:
    bets = cells.withColumns({"bet_type": F.lit("quinella"), "selection": F.array("low", "high")})
    return bt.score(bt.settle(bets, results(s, d), "contest_id"), load_dividends(raw_dividends(s, d)), "contest_id", "odds")


def top(cells: DataFrame, k: int, *order) -> DataFrame:
    w = Window.partitionBy("contest_id").orderBy(*order, "low", "high")
    return cells.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


#: Strategies by name: cells to chosen cells.
STRATEGIES = {
    "ev": lambda c: top(c.filter("ev >= 0.8"), 3, F.desc("ev")).drop("rank"),
    "lowest": lambda c: top(c, 3, F.round("odds", 6)).drop("rank"),
    "probable": lambda c: top(c, 3, F.round("prob", 9).desc()).drop("rank"),
    "uniform": lambda c: bt.stride_sample(c, "contest_id", F.struct("low", "high"), 3, F.col("contest_id")),
}


def exotic_backtest(s: SparkSession, d: str) -> DataFrame:
    cells, out = pair_cells(s, d), None
    for name, choose in STRATEGIES.items():
        one = choose(cells).withColumn("strategy", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return bt.returns(settled_pairs(s, d, out), ["strategy"]).withColumn("recovery", F.round("recovery", 6))


def price_edge(s: SparkSession, d: str) -> DataFrame:
    """By threshold of expected value: bets, hits, return, return without the best hit, and the mix of odds bands."""
    thresholds = F.array(*[F.lit(t) for t in (0.5, 0.7, 0.8, 0.85)])
    scored = settled_pairs(s, d, pair_cells(s, d)).filter("payout is not null").withColumn("threshold", F.explode(thresholds)).filter("ev >= threshold")
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    out = scored.groupBy("threshold").agg(
        F.count("*").alias("bets"), F.sum("hit").cast("long").alias("hits"), F.round(F.avg("payout"), 6).alias("roi"), F.round((F.sum("payout") - F.max("payout")) / F.count("*"), 6).alias("roi_without_best"),
        share(F.col("odds") < 10).alias("short"), share((F.col("odds") >= 10) & (F.col("odds") < 50)).alias("mid"), share(F.col("odds") >= 50).alias("long"),
    )
    return out


def portfolio_cells(s: SparkSession, d: str) -> DataFrame:
    """Cells of K and staking (flat, or by probability within the contest): return, one-sided p of a gain, Holm, verdict."""
    days = market(s, d).select("contest_id", "day").distinct()
    scored = settled_pairs(s, d, top(pair_cells(s, d), 5, F.desc("ev"))).filter("payout is not null").join(days, "contest_id")
    cells = scored.withColumn("k", F.explode(F.array(F.lit(1), F.lit(3), F.lit(5)))).filter("rank <= k")
    w = Window.partitionBy("contest_id", "k")
    by_p = F.col("prob") / F.sum("prob").over(w)
    flat = 1 / F.count("*").over(w)
    cells = cells.withColumn("stake", F.map_from_arrays(F.array(F.lit("flat"), F.lit("probability")), F.array(flat, by_p)))
    cells = cells.select("k", "day", "payout", F.explode("stake").alias("staking", "stake"))
    sums = cells.groupBy("k", "staking", "day").agg(F.sum(F.col("stake") * (F.col("payout") - 1)).alias("s"), F.sum("stake").alias("n"), F.count("*").alias("bets")).persist()
    reps = bs.replicates(sums, "day", {"v": F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))}, 300, ["k", "staking"])
    test = bs.interval(reps, "v", by=["k", "staking"]).withColumn("cell", F.concat_ws("-", "k", "staking"))
    point = sums.groupBy("k", "staking").agg(F.sum("bets").alias("bets"), (F.sum("s") / F.sum("n")).alias("gain"))
    out = bs.holm(point.join(test, ["k", "staking"]), "p_one_sided", "cell")
    verdict = F.when(F.col("bets") < 100, "thin").when((F.col("adjusted") <= 0.05) & (F.col("gain") > 0), "keep").otherwise("demote")
    return out.select("k", "staking", "bets", F.round("gain", 6).alias("gain"), F.round("p_one_sided", 6).alias("p_one_sided"), F.round("adjusted", 6).alias("adjusted"), verdict.alias("verdict"))


def cross_pool(s: SparkSession, d: str) -> DataFrame:
    """The market's rank 1 to 3 bet to win and, from five entries on, to be placed at 30 % of the win odds."""
    w = Window.partitionBy("contest_id").orderBy("odds", "entity_id")
    m = market(s, d).withColumn("rank", F.row_number().over(w)).filter("rank <= 3 and n >= 5")
    placed = F.when(F.col("n") >= 8, F.col("finish_order") <= 3).otherwise(F.col("finish_order") <= 2)
    win, place = F.col("won") * F.col("odds"), F.when(placed, 1 + (F.col("odds") - 1) * 0.3).otherwise(0.0)
    return m.groupBy("rank").agg(F.count("*").alias("contests"), F.round(F.avg(win), 6).alias("win"), F.round(F.avg(place), 6).alias("place"), F.round(F.avg(win - place), 6).alias("difference"))


def place_ledger(s: SparkSession, d: str) -> DataFrame:
    """Contests of the place panel and why the others are not in it; the first reason counts."""
    r = results(s, d).join(panel(s, d).groupBy("contest_id").agg(F.min("odds").alias("o")), "contest_id")
    reason = F.when(F.col("depth").isNull(), "small_field").when(F.col("placed").isNull(), "dead_heat_or_short").when(F.col("o") < 1.3, "price_floor").otherwise("scored")
    return r.groupBy(reason.alias("reason")).agg(F.count("*").alias("contests"))


def bettable(s: SparkSession, d: str) -> DataFrame:
    """All entries with the reason that keeps them out, and p renormalised over those that stay."""
    p = panel(s, d)
    reason = F.when(F.col("started") == 0, "scratched").when(F.col("odds") <= 1.4, "no_odds").when(F.col("weight") > 200, "no_prob").otherwise("ok")
    p = p.withColumn("reason", reason).withColumn("x", F.when(F.col("reason") == "ok", F.pow(1 / F.col("odds"), F.lit(1.2))))
    return p.select("contest_id", "entity_id", "reason", F.round(F.try_divide("x", F.sum("x").over(Window.partitionBy("contest_id"))), 6).alias("p"))


def ev_selection(s: SparkSession, d: str) -> DataFrame:
    """Entries of a value of 0.8 and more; those above the odds cap are named, and stay in the count that shares are of."""
    m = market(s, d).filter("p * odds >= 0.8")
    w = Window.partitionBy("contest_id")
    return m.select("contest_id", "entity_id", F.round(F.col("p") * F.col("odds"), 6).alias("ev"), (F.col("odds") > 15).alias("capped"), F.round(F.count_if(F.col("odds") <= 15).over(w) / F.count("*").over(w), 6).alias("share_kept"))


def kelly_haircut(s: SparkSession, d: str) -> DataFrame:
    m = market(s, d).withColumn("estimated", F.col("contest_id") % 4 == 0)
    f = bt.kelly(F.col("p"), F.col("odds"), estimated=F.col("estimated"))
    return m.select("contest_id", "entity_id", F.round(f, 6).alias("fraction"))


def contest_weights(s: SparkSession, d: str) -> DataFrame:
    out = bt.informative_weights(market(s, d), "contest_id", "p", "odds", least=0.9)
    return out.select("contest_id", "informative", F.round("weight", 6).alias("weight"))


def recommendations(s: SparkSession, d: str) -> DataFrame:
    """Win bets by value with their stakes, and the best pairs, as one table."""
    m = market(s, d).filter("p * odds >= 0.9")
    win = m.select("contest_id", F.lit("win").alias("bet_type"), F.col("entity_id").cast("string").alias("selection"), "odds", F.lit(False).alias("is_estimated"), F.col("p").alias("prob"))
    pairs = STRATEGIES["ev"](pair_cells(s, d))
    pairs = pairs.select("contest_id", F.lit("quinella").alias("bet_type"), F.concat_ws("-", "low", "high").alias("selection"), "odds", F.lit(True).alias("is_estimated"), "prob")
    out = win.unionByName(pairs)
    stake = bt.kelly(F.col("prob"), F.col("odds"), estimated=F.col("is_estimated"))
    return out.select("contest_id", "bet_type", "selection", "is_estimated", F.round(F.col("prob") * F.col("odds"), 6).alias("ev"), F.round(stake, 6).alias("stake"))


def policy_gate(s: SparkSession, d: str) -> DataFrame:
    """Recovery of each policy by year, and whether it beats the favourite in most years and in total."""
    m = market(s, d).withColumn("y", F.year("day"))
    w = Window.partitionBy("contest_id").orderBy("odds", "entity_id")
    m = m.withColumn("fav", F.row_number().over(w) == 1)
    policies = {"ev": F.col("p") * F.col("odds") >= 0.9, "ev_capped": (F.col("p") * F.col("odds") >= 0.9) & (F.col("odds") <= 8), "favourite": F.col("fav"), "uniform": F.lit(True)}
    named = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in policies.items()]), lambda x: x.isNotNull())
    by = m.withColumn("policy", F.explode(named)).groupBy("policy", "y").agg(F.sum(F.col("won") * F.col("odds")).alias("paid"), F.count("*").alias("bets"))
    # the favourite's own sums, not sums taken again: those of another order may differ in the last digit, and it beat itself
    year = Window.partitionBy("y")
    of_favourite = lambda c: F.max(F.when(F.col("policy") == "favourite", F.col(c))).over(year)
    j = by.withColumns({"bp": of_favourite("paid"), "bn": of_favourite("bets")})
    better = F.count_if(F.col("paid") / F.col("bets") > F.col("bp") / F.col("bn"))
    total, fav = F.sum("paid") / F.sum("bets"), F.sum("bp") / F.sum("bn")
    out = j.groupBy("policy").agg(F.sum("bets").alias("bets"), F.round(total, 6).alias("recovery"), better.alias("better_years"), ((2 * better > F.count("*")) & (total > fav)).alias("adopt"))
    return out


def samples(s: SparkSession, d: str) -> DataFrame:
    return fits.one_winner(market(s, d), "contest_id", "won")


def told(spark: SparkSession, row: dict, schema: str) -> DataFrame:
    return spark.createDataFrame([tuple(row[c.split()[0]] for c in schema.split(", "))], schema)


def rounded9(row: dict) -> dict:
    return {k: round(v, 6) if isinstance(v, float) else v for k, v in row.items()}


def gamma_fit(s: SparkSession, d: str) -> DataFrame:
    return told(s, rounded9(fits.fit_power(samples(s, d), "contest_id", "won", "q")), "gamma double, nll double, n long, status string")


def two_gamma_fit(s: SparkSession, d: str) -> DataFrame:
    return told(s, rounded9(fits.fit_two_power(samples(s, d), "contest_id", "won", "p")), "lo double, hi double, nll double, n long, status string")


def stage_fit(s: SparkSession, d: str) -> DataFrame:
    """The powers of the second and third stage."""
    out = None
    for stage in (2, 3):
        rows = fits.stage_samples(market(s, d), "contest_id", "finish_order", stage)
        row = rounded9(fits.fit_power(rows, "contest_id", "__next", "p")) | {"stage": stage}
        one = told(s, row, "stage int, gamma double, nll double, n long, status string")
        out = one if out is None else out.unionByName(one)
    return out


GRID = [round(0.5 + 0.025 * k, 3) for k in range(41)]


def prequential(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(rows of contests with one winner with their year, (eval year, gamma) fitted on all earlier years)."""
    rows = samples(s, d).withColumn("y", F.year("day"))
    losses = fits.candidate_losses(rows, "contest_id", "won", lambda: F.pow("q", F.col("g")), [(g,) for g in GRID], ["g"], ["y"])
    w = Window.partitionBy("g").orderBy("y").rowsBetween(Window.unboundedPreceding, -1)  # a row for each year
    before = losses.withColumns({"b": F.sum("nll").over(w), "bn": F.sum("n").over(w)}).filter("bn > 0")
    best = before.groupBy("y").agg(F.min_by("g", F.struct(F.round(F.col("b") / F.col("bn"), 12), "g")).alias("gamma"))
    return rows, best


def prequential_gamma(s: SparkSession, d: str) -> DataFrame:
    """For each year from the second: gamma of all earlier years, and that year's loss with it and without."""
    rows, best = prequential(s, d)
    r = rows.join(F.broadcast(best), "y").withColumn("x", F.pow("q", F.col("gamma")))
    c = r.groupBy("y", "gamma", "contest_id").agg(F.sum("x").alias("t"), F.max(F.when(F.col("won") == 1, F.col("x"))).alias("w"), F.max(F.when(F.col("won") == 1, F.col("q"))).alias("q"))
    out = c.groupBy(F.col("y").alias("eval_year"), "gamma").agg(F.count("*").alias("contests"), F.round(F.avg(F.ln("t") - F.ln("w")), 6).alias("nll"), F.round(F.avg(-F.ln("q")), 6).alias("nll_before"))
    return out.withColumn("better", F.col("nll") < F.col("nll_before"))


def oof_predictions(s: SparkSession, d: str) -> DataFrame:
    """Every entry of the years from the second on, with the share that the fit on earlier years gives it."""
    _, best = prequential(s, d)
    m = market(s, d).withColumn("y", F.year("day")).join(F.broadcast(best), "y").withColumn("x", F.pow("q", F.col("gamma")))
    return m.select("contest_id", "entity_id", F.col("y").alias("fold"), F.round(F.col("x") / F.sum("x").over(Window.partitionBy("contest_id")), 6).alias("p_oof"))


def softmax_fit(s: SparkSession, d: str) -> DataFrame:
    """Weights of ln p-like and weight features in the contest softmax, fitted before 1998 and scored from then on."""
    rows = samples(s, d).withColumns({"f1": F.ln("q"), "f2": F.col("weight") / 100})
    theta = fits.fit_softmax(rows.filter("year(day) < 1998"), "contest_id", "won", ["f1", "f2"], tolerance=1e-12).theta
    new = fits.softmax_shares(rows.filter("year(day) >= 1998"), "contest_id", ["f1", "f2"], theta, "r").filter("won = 1")
    return new.agg(F.lit(round(float(theta[0]), 6)).alias("alpha"), F.lit(round(float(theta[1]), 6)).alias("beta"), F.count("*").alias("contests"), F.round(F.avg(-F.ln("r")), 6).alias("nll"), F.round(F.avg(-F.ln("q")), 6).alias("nll_market"),
                   F.round(1 - F.avg(-F.ln("r")) / F.avg(F.ln("n")), 6).alias("r2"), F.round(F.avg(F.ln("r") - F.ln("q")) / F.avg(F.ln("n")), 6).alias("delta_r2"))


def platt_fit(s: SparkSession, d: str) -> DataFrame:
    m = market(s, d).filter("n > 1")
    a, b = fits.fit_platt(m.filter("year(day) < 1998"), "p", "won")
    z = 1 / (1 + F.exp(-(F.ln(F.col("p") / (1 - F.col("p"))) * a + b)))
    y = F.col("won")
    loss = lambda c: F.round(-F.avg(y * F.ln(c) + (1 - y) * F.ln(1 - c)), 6)
    return m.filter("year(day) >= 1998").agg(F.lit(round(a, 5)).alias("slope"), F.lit(round(b, 5)).alias("shift"), loss(z).alias("loss_after"), loss(F.col("p")).alias("loss_before"))


def isotonic_fit(s: SparkSession, d: str) -> DataFrame:
    return fits.fit_isotonic(market(s, d), "p", "won", 1).select(F.round("x", 1).alias("x"), "n", F.round("fitted", 6).alias("fitted"))


def market_calibration(s: SparkSession, d: str) -> DataFrame:
    """q' = q**0.9, renormalised, with how many shares of each year lie outside the range of the years before 1998."""
    m = market(s, d)
    span = m.filter("year(day) < 1998").agg(F.min("q").alias("lo"), F.max("q").alias("hi"))
    x = m.withColumn("x", F.pow("q", F.lit(0.9))).withColumn("qq", F.col("x") / F.sum("x").over(Window.partitionBy("contest_id"))).crossJoin(F.broadcast(span))
    y = F.col("won")
    brier = lambda c: F.round(F.avg((F.col(c) - y) * (F.col(c) - y)), 6)
    return x.groupBy(F.year("day").alias("y")).agg(F.count("*").alias("n"), F.count_if((F.col("q") < F.col("lo")) | (F.col("q") > F.col("hi"))).alias("outside"), brier("q").alias("brier_q"), brier("qq").alias("brier_corrected"))


AXES = {"class": "class", "field": "CASE WHEN n <= 3 THEN 'small' WHEN n <= 7 THEN 'mid' ELSE 'large' END", "season": "concat('q', cast(quarter(day) AS string))", "price": "CASE WHEN odds < 3 THEN 'short' WHEN odds < 8 THEN 'mid' ELSE 'long' END", "year": "cast(year(day) AS string)"}


def segment_accuracy(s: SparkSession, d: str) -> DataFrame:
    """By axis and segment: entries, log loss of model and market, and the three-way decision on the day-cluster interval of
    their difference (margin 0.001)."""
    m = market(s, d).filter("n > 1").withColumn("g", -(F.col("won") * F.ln("p") + (1 - F.col("won")) * F.ln(1 - F.col("p")))).withColumn("h", -(F.col("won") * F.ln("q") + (1 - F.col("won")) * F.ln(1 - F.col("q"))))
    long = m.select("day", "g", "h", F.explode(F.map_from_arrays(F.array(*[F.lit(a) for a in AXES]), F.array(*[F.expr(e) for e in AXES.values()]))).alias("axis", "segment"))
    sums = long.groupBy("axis", "segment", "day").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")).persist()
    reps = bs.replicates(sums, "day", {"v": F.sum((F.col("g") - F.col("h")) * F.col("times")) / F.sum(F.col("n") * F.col("times"))}, 200, ["axis", "segment"])
    ci = bs.interval(reps, "v", by=["axis", "segment"])
    out = sums.groupBy("axis", "segment").agg(F.sum("n").alias("n"), F.round(F.sum("g") / F.sum("n"), 6).alias("loss_p"), F.round(F.sum("h") / F.sum("n"), 6).alias("loss_q")).join(ci, ["axis", "segment"])
    decision = F.when(F.col("ci_high") < 0.001, "not_worse").when(F.col("ci_low") > 0.001, "worse").otherwise("open")
    return out.select("axis", "segment", "n", "loss_p", "loss_q", F.round("ci_low", 5).alias("ci_low"), F.round("ci_high", 5).alias("ci_high"), decision.alias("decision"))


def paired_recent(s: SparkSession, d: str) -> DataFrame:
    """Mean winner's log-loss difference of two arms over all days and over the last 5 and 3 years. The arms must cover the
    same contests."""
    m = samples(s, d).filter("won = 1").select("contest_id", "day", (F.ln("q") - F.ln("p")).alias("diff"))
    last = m.agg(F.max("day").alias("last"))
    windows = F.array(F.lit(0), F.lit(5), F.lit(3))
    long = m.crossJoin(F.broadcast(last)).withColumn("years", F.explode(windows)).filter((F.col("years") == 0) | (F.col("day") > F.add_months("last", -12 * F.col("years"))))
    return long.groupBy("years").agg(F.count("*").alias("contests"), F.countDistinct("day").alias("days"), F.round(F.avg("diff"), 6).alias("mean_diff"))


QUERIES = {f.__name__: f for f in (
    settlement_all, dividends_load, returns_by_type, exotic_backtest, price_edge, portfolio_cells, cross_pool, place_ledger, bettable, ev_selection, kelly_haircut, contest_weights, recommendations, policy_gate,
    two_gamma_fit, prequential_gamma, oof_predictions, softmax_fit, platt_fit, isotonic_fit, market_calibration, segment_accuracy, paired_recent,
)} | {"gamma_grid_fit": gamma_fit, "stage_discount_fit": stage_fit}

# --- oracles
_CHOICE = """r AS (SELECT contest_id, entity_id, odds, finish_order, started, row_number() OVER (PARTITION BY contest_id ORDER BY odds, entity_id) AS k FROM panel),
s AS (SELECT contest_id, max(CASE WHEN k = 1 THEN entity_id END) AS s1, max(CASE WHEN k = 2 THEN entity_id END) AS s2, max(CASE WHEN k = 3 THEN entity_id END) AS s3,
  min(CASE WHEN k <= 1 THEN started END) AS v1, min(CASE WHEN k <= 2 THEN started END) AS v2, min(CASE WHEN k <= 3 THEN started END) AS v3,
  max(CASE WHEN k = 1 THEN finish_order END) AS p1, sum(started) AS n, count(*) AS entries,
  count(CASE WHEN finish_order = 1 THEN 1 END) AS c1, count(CASE WHEN finish_order = 2 THEN 1 END) AS c2, count(CASE WHEN finish_order = 3 THEN 1 END) AS c3,
  max(CASE WHEN finish_order = 1 THEN entity_id END) AS e1, max(CASE WHEN finish_order = 2 THEN entity_id END) AS e2, max(CASE WHEN finish_order = 3 THEN entity_id END) AS e3 FROM r GROUP BY contest_id),
t AS (SELECT *, c1 = 1 AND c2 = 1 AS two, c1 = 1 AND c2 = 1 AND c3 = 1 AS three, CASE WHEN n >= 8 THEN 3 WHEN n >= 5 THEN 2 END AS depth, CASE WHEN n >= 8 THEN c1 + c2 + c3 WHEN n >= 5 THEN c1 + c2 END AS placed FROM s),
b AS (SELECT contest_id, 'win' AS bet_type, [s1] AS sel, v1 AS ok, CASE WHEN p1 IS NULL OR p1 > 1 THEN 0 WHEN c1 = 1 THEN 1 END AS h FROM t
UNION ALL SELECT contest_id, 'place', [s1], v1, CASE WHEN depth IS NULL THEN NULL WHEN p1 IS NULL OR p1 > depth THEN 0 WHEN placed = depth THEN 1 END FROM t
UNION ALL SELECT contest_id, 'exacta', [s1, s2], v2, CASE WHEN two THEN cast(s1 = e1 AND s2 = e2 AS int) END FROM t WHERE entries >= 2
UNION ALL SELECT contest_id, 'quinella', list_sort([s1, s2]), v2, CASE WHEN two THEN cast(list_sort([s1, s2]) = list_sort([e1, e2]) AS int) END FROM t WHERE entries >= 2
UNION ALL SELECT contest_id, 'wide', list_sort([s1, s2]), v2, CASE WHEN three THEN cast(s1 IN (e1, e2, e3) AND s2 IN (e1, e2, e3) AS int) END FROM t WHERE entries >= 2
UNION ALL SELECT contest_id, 'trifecta', [s1, s2, s3], v3, CASE WHEN three THEN cast(s1 = e1 AND s2 = e2 AND s3 = e3 AS int) END FROM t WHERE entries >= 3
UNION ALL SELECT contest_id, 'trio', list_sort([s1, s2, s3]), v3, CASE WHEN three THEN cast(list_sort([s1, s2, s3]) = list_sort([e1, e2, e3]) AS int) END FROM t WHERE entries >= 3),
settled AS (SELECT contest_id, bet_type, sel, CASE WHEN ok = 1 THEN h END AS hit, ok = 0 AS void FROM b)"""
_DIVIDENDS = """f AS (SELECT contest_id, list(entity_id ORDER BY finish_order) AS e, list(odds ORDER BY finish_order) AS o FROM panel WHERE finish_order <= 3 GROUP BY contest_id HAVING count(*) = 3 AND count(DISTINCT finish_order) = 3),
dv AS (SELECT contest_id, bet_type, sel, round(v, 1) + CASE WHEN contest_id % 5 = 0 THEN 1 ELSE 0 END AS dividend FROM (
SELECT contest_id, 'win' AS bet_type, e[1:1] AS sel, o[1] AS v FROM f UNION ALL SELECT contest_id, 'exacta', e[1:2], o[1] * o[2] * 0.6e0 FROM f UNION ALL SELECT contest_id, 'quinella', list_sort(e[1:2]), o[1] * o[2] * 0.4e0 FROM f
UNION ALL SELECT contest_id, 'trifecta', e, o[1] * o[2] * o[3] * 0.4e0 FROM f UNION ALL SELECT contest_id, 'trio', list_sort(e), o[1] * o[2] * o[3] * 0.2e0 FROM f
UNION ALL SELECT contest_id, 'wide', list_sort([e[1], e[2]]), o[1] * o[2] * 0.2e0 FROM f UNION ALL SELECT contest_id, 'wide', list_sort([e[1], e[3]]), o[1] * o[3] * 0.2e0 FROM f UNION ALL SELECT contest_id, 'wide', list_sort([e[2], e[3]]), o[2] * o[3] * 0.2e0 FROM f) z WHERE contest_id % 4 <> 0)"""
_RETURNS = """cast(count(*) AS bigint) AS bets, cast(count(CASE WHEN void THEN 1 END) AS bigint) AS void, cast(count(CASE WHEN payout IS NULL THEN 1 END) AS bigint) AS skipped, cast(coalesce(sum(hit), 0) AS bigint) AS hits,
cast(count(CASE WHEN hit = 1 AND dividend IS NULL THEN 1 END) AS bigint) AS estimated, round(avg(CASE WHEN NOT void THEN payout END), 6) AS recovery"""
_PAIRS = """pc AS (SELECT a.contest_id, a.entity_id AS low, b.entity_id AS high, a.p * b.p / (1 - a.p) + b.p * a.p / (1 - b.p) AS prob, least(9999e0, 75e-2 / (a.q * b.q / (1 - a.q) + b.q * a.q / (1 - b.q))) AS odds
FROM market a JOIN market b ON a.contest_id = b.contest_id AND a.entity_id < b.entity_id), cells AS (SELECT *, round(prob * odds, 9) AS ev FROM pc),
rt AS (SELECT contest_id, list_sort(list(entity_id)) AS pair FROM panel WHERE finish_order <= 2 GROUP BY contest_id HAVING count(*) = 2 AND count(DISTINCT finish_order) = 2)"""
_PAID = "SELECT x.*, CASE WHEN pair IS NULL THEN NULL WHEN pair = [low, high] THEN 1 ELSE 0 END AS hit, false AS void, dividend, CASE WHEN pair IS NULL THEN NULL WHEN pair = [low, high] THEN coalesce(dividend, x.odds) ELSE 0 END AS payout FROM {} x LEFT JOIN rt ON rt.contest_id = x.contest_id LEFT JOIN dv ON dv.contest_id = x.contest_id AND dv.bet_type = 'quinella' AND dv.sel = [low, high]"
_RANK = "row_number() OVER (PARTITION BY contest_id ORDER BY {}, low, high)"
_KELLY = "round(least(0.05, greatest(0, 0.5 * ({p} * {o} - 1) / ({o} - 1))), 6)"
ONE = "one AS (SELECT contest_id FROM market GROUP BY contest_id HAVING sum(won) = 1), sm AS (SELECT market.* FROM market JOIN one ON market.contest_id = one.contest_id)"


def _narrow(rows: str, weights: dict[str, str], spans: dict[str, tuple[float, float]], rounds: int, points: int, guard: str, out: str, pre: str = "") -> str:
    """Rounds of grids as CTEs: each evaluates all candidates, takes the best, and the next spans its neighbours."""
    names = list(spans)
    ctes, lo, hi = [ONE] + ([pre] if pre else []) + [f"rw AS ({rows})"], {n: f"cast({a} AS double)" for n, (a, _) in spans.items()}, {n: f"cast({b} AS double)" for n, (_, b) in spans.items()}
    ctes.append("b0 AS (SELECT " + ", ".join(f"{lo[n]} AS {n}_a, {hi[n]} AS {n}_z" for n in names) + ")")
    for k in range(rounds):
        cand = ", ".join(f"{n}_a + ({n}_z - {n}_a) * i{j} / {points - 1}e0 AS {n}" for j, n in enumerate(names))
        grids = " CROSS JOIN ".join(f"(SELECT unnest(range(0, {points})) AS i{j}) g{j}" for j in range(len(names)))
        ctes.append(f"c{k} AS (SELECT {cand} FROM b{k} CROSS JOIN {grids})")
        ctes.append(f"l{k} AS (SELECT {', '.join(names)}, count(*) AS n, sum(ln(t) - ln(w)) / count(*) AS nll FROM (SELECT {', '.join(names)}, contest_id, sum(x) AS t, max(CASE WHEN hit = 1 THEN x END) AS w FROM (SELECT rw.contest_id, rw.hit, c{k}.*, {weights['x']} AS x FROM rw CROSS JOIN c{k}) a GROUP BY {', '.join(names)}, contest_id) z GROUP BY {', '.join(names)})")
        ctes.append(f"m{k} AS (SELECT * FROM l{k} ORDER BY round(nll, 12), {', '.join(names)} LIMIT 1)")
        ctes.append(f"b{k + 1} AS (SELECT " + ", ".join(f"greatest(0.1e0, {n} - ({n}_z - {n}_a) / {points - 1}e0) AS {n}_a, least(5e0, {n} + ({n}_z - {n}_a) / {points - 1}e0) AS {n}_z" for n in names) + f" FROM m{k} CROSS JOIN b{k})")
    edge = " OR ".join(f"{n} - 0.1 < 1e-3 OR 5 - {n} < 1e-3" for n in names)
    head = ", ".join(f"round(CASE WHEN n < 50 OR {edge} THEN 1e0 ELSE {n} END, 6) AS {n}" for n in names)
    return f"WITH {', '.join(ctes)} SELECT {out}{head}, round(CASE WHEN n >= 50 THEN nll END, 6) AS nll, cast(n AS bigint) AS n, CASE WHEN n < 50 THEN 'few_samples' WHEN {edge} THEN 'boundary' ELSE 'fitted' END AS status FROM m{rounds - 1}"


def _stage_sql(stage: int) -> str:
    clear = " AND ".join(f"sum(CASE WHEN finish_order = {k} THEN 1 ELSE 0 END) = 1" for k in range(1, stage + 1))
    rows = f"SELECT market.contest_id, p AS v, CASE WHEN finish_order = {stage} THEN 1 ELSE 0 END AS hit FROM market JOIN (SELECT contest_id FROM market GROUP BY contest_id HAVING {clear}) k ON market.contest_id = k.contest_id WHERE finish_order IS NULL OR finish_order >= {stage}"
    return "SELECT * FROM (" + _narrow(rows, {"x": "power(v, gamma)"}, {"gamma": (0.1, 5.0)}, 4, 15, "", f"{stage} AS stage, ") + f") s{stage}"


def _newton_softmax() -> str:
    """Newton steps for two features as a chain of CTEs."""
    ctes = [ONE, "x AS (SELECT contest_id, won, n, q, year(day) AS y, ln(q) AS f1, weight / 100 AS f2 FROM sm)", "t0 AS (SELECT 0e0 AS a, 0e0 AS b)"]
    for k in range(8):
        ctes.append(f"u{k} AS (SELECT contest_id, won, f1, f2, exp(a * f1 + b * f2) AS e FROM x, t{k} WHERE y < 1998)")
        ctes.append(f"v{k} AS (SELECT contest_id, sum(e * f1) / sum(e) AS m1, sum(e * f2) / sum(e) AS m2, sum(e * f1 * f1) / sum(e) AS c11, sum(e * f1 * f2) / sum(e) AS c12, sum(e * f2 * f2) / sum(e) AS c22, sum(won * f1) AS w1, sum(won * f2) AS w2 FROM u{k} GROUP BY contest_id)")
        ctes.append(f"h{k} AS (SELECT sum(w1 - m1) AS g1, sum(w2 - m2) AS g2, sum(c11 - m1 * m1) AS h11, sum(c12 - m1 * m2) AS h12, sum(c22 - m2 * m2) AS h22 FROM v{k})")
        ctes.append(f"t{k + 1} AS (SELECT a + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS a, b + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b FROM t{k}, h{k})")
    return f"""WITH {', '.join(ctes)}, s AS (SELECT won, n, q, a, b, exp(a * f1 + b * f2) / sum(exp(a * f1 + b * f2)) OVER (PARTITION BY contest_id) AS r FROM x, t8 WHERE y >= 1998)
SELECT round(max(a), 6) AS alpha, round(max(b), 6) AS beta, cast(count(*) AS bigint) AS contests, round(avg(-ln(r)), 6) AS nll, round(avg(-ln(q)), 6) AS nll_market, round(1 - avg(-ln(r)) / avg(ln(n)), 6) AS r2, round(avg(ln(r) - ln(q)) / avg(ln(n)), 6) AS delta_r2 FROM s WHERE won = 1"""


def _newton_platt() -> str:
    ctes = ["z AS (SELECT year(day) AS y, cast(won AS double) AS w, p, ln(p / (1 - p)) AS l FROM market WHERE n > 1)", "t0 AS (SELECT 1e0 AS a, 0e0 AS b)"]
    for k in range(8):
        ctes.append(f"g{k} AS (SELECT sum((w - s) * l) AS ga, sum(w - s) AS gb, sum(s * (1 - s) * l * l) AS haa, sum(s * (1 - s) * l) AS hab, sum(s * (1 - s)) AS hbb FROM (SELECT w, l, 1 / (1 + exp(-(l * a + b))) AS s FROM z, t{k} WHERE y < 1998) i)")
        ctes.append(f"t{k + 1} AS (SELECT a + (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS a, b + (haa * gb - hab * ga) / (haa * hbb - hab * hab) AS b FROM t{k}, g{k})")
    return f"WITH {', '.join(ctes)} SELECT round(max(a), 5) AS slope, round(max(b), 5) AS shift, round(-avg(w * ln(s) + (1 - w) * ln(1 - s)), 6) AS loss_after, round(-avg(w * ln(p) + (1 - w) * ln(1 - p)), 6) AS loss_before FROM (SELECT w, p, a, b, 1 / (1 + exp(-(l * a + b))) AS s FROM z, t8 WHERE y >= 1998) f"


_PREQ = f"""{ONE}, g AS (SELECT round(5e-1 + 25e-3 * i, 3) AS g FROM (SELECT unnest(range(0, 41)) AS i) r), l AS (SELECT g, y, count(*) AS n, sum(ln(t) - ln(w)) AS nll FROM (SELECT g, year(day) AS y, contest_id, sum(power(q, g)) AS t, max(CASE WHEN won = 1 THEN power(q, g) END) AS w FROM sm CROSS JOIN g GROUP BY g, year(day), contest_id) a GROUP BY g, y),
f AS (SELECT e.y, l.g, round(sum(l.nll) / sum(l.n), 12) AS loss FROM (SELECT DISTINCT y FROM l) e JOIN l ON l.y < e.y GROUP BY e.y, l.g), best AS (SELECT y, g AS gamma FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY loss, g) AS k FROM f) o WHERE k = 1)"""
_SEG = " UNION ALL ".join(f"SELECT '{a}' AS axis, {e.replace('AS string', 'AS varchar')} AS segment, day, g, h FROM ll" for a, e in AXES.items())
_LL = "ll AS (SELECT *, -(won * ln(p) + (1 - won) * ln(1 - p)) AS g, -(won * ln(q) + (1 - won) * ln(1 - q)) AS h FROM market WHERE n > 1)"

SQL = {
    "settlement_all": f"WITH {_CHOICE} SELECT contest_id, bet_type, array_to_string(sel, '-') AS selection, hit, void FROM settled",
    "dividends_load": f"WITH {_DIVIDENDS} SELECT contest_id, bet_type, array_to_string(sel, '-') AS selection, round(dividend, 1) AS dividend FROM dv",
    "returns_by_type": f"""WITH {_CHOICE}, {_DIVIDENDS}, p AS (SELECT s.*, dividend, CASE WHEN void THEN 1 WHEN hit = 0 THEN 0 WHEN hit = 1 THEN coalesce(dividend, 5e0) END AS payout FROM settled s LEFT JOIN dv ON dv.contest_id = s.contest_id AND dv.bet_type = s.bet_type AND dv.sel = s.sel)
SELECT bet_type, {_RETURNS} FROM p GROUP BY bet_type UNION ALL SELECT '__total__', {_RETURNS} FROM p""",
    "exotic_backtest": f"""WITH {_PAIRS}, {_DIVIDENDS}, r AS (SELECT *, {_RANK.format('ev DESC')} AS by_ev, {_RANK.format('round(odds, 6)')} AS by_odds, {_RANK.format('round(prob, 9) DESC')} AS by_prob, row_number() OVER (PARTITION BY contest_id ORDER BY low, high) - 1 AS k, count(*) OVER (PARTITION BY contest_id) AS m FROM cells),
c AS (SELECT 'ev' AS strategy, * FROM r WHERE ev >= 0.8 AND by_ev <= 3 UNION ALL SELECT 'lowest', * FROM r WHERE by_odds <= 3 UNION ALL SELECT 'probable', * FROM r WHERE by_prob <= 3 UNION ALL SELECT 'uniform', * FROM r WHERE m <= 3 OR k IN (contest_id % m, (contest_id + m // 3) % m, (contest_id + 2 * m // 3) % m)),
p AS ({_PAID.format('c')}) SELECT strategy, {_RETURNS} FROM p GROUP BY strategy UNION ALL SELECT '__total__', {_RETURNS} FROM p""",
    "price_edge": f"""WITH {_PAIRS}, {_DIVIDENDS}, p AS ({_PAID.format('cells')}), t AS (SELECT unnest([0.5e0, 0.7e0, 0.8e0, 0.85e0]) AS threshold)
SELECT threshold, cast(count(*) AS bigint) AS bets, cast(sum(hit) AS bigint) AS hits, round(avg(payout), 6) AS roi, round((sum(payout) - max(payout)) / count(*), 6) AS roi_without_best, round(avg(CASE WHEN p.odds < 10 THEN 1e0 ELSE 0 END), 6) AS short, round(avg(CASE WHEN p.odds >= 10 AND p.odds < 50 THEN 1e0 ELSE 0 END), 6) AS mid, round(avg(CASE WHEN p.odds >= 50 THEN 1e0 ELSE 0 END), 6) AS long
FROM p JOIN t ON ev >= threshold WHERE payout IS NOT NULL GROUP BY threshold""",
    "portfolio_cells": f"""WITH {_PAIRS}, {_DIVIDENDS}, r AS (SELECT *, {_RANK.format('ev DESC')} AS rk FROM cells), pd AS (SELECT p.*, (SELECT max(day) FROM market m WHERE m.contest_id = p.contest_id) AS day FROM ({_PAID.format('(SELECT * FROM r WHERE rk <= 5)')}) p WHERE payout IS NOT NULL),
ck AS (SELECT pd.*, k FROM pd JOIN (SELECT unnest([1, 3, 5]) AS k) z ON rk <= k), st AS (SELECT k, 'flat' AS staking, day, payout, 1e0 / count(*) OVER (PARTITION BY contest_id, k) AS stake FROM ck UNION ALL SELECT k, 'probability', day, payout, prob / sum(prob) OVER (PARTITION BY contest_id, k) FROM ck),
{_boot("SELECT k AS kk, staking, day, sum(stake * (payout - 1)) AS s, sum(stake) AS n, count(*) AS bets FROM st GROUP BY k, staking, day", 300, 'day', 'kk, staking')},
tp AS (SELECT kk, staking, avg(CASE WHEN v <= 0 THEN 1e0 ELSE 0e0 END) AS pv FROM r_boot GROUP BY kk, staking), j AS (SELECT *, row_number() OVER (ORDER BY pv, cast(kk AS varchar) || '-' || staking) AS o, count(*) OVER () AS m FROM tp),
a AS (SELECT kk, staking, pv, least(1.0, (SELECT max(b.pv * (b.m - b.o + 1)) FROM j b WHERE b.o <= j.o)) AS adj FROM j), g AS (SELECT kk, staking, sum(bets) AS bets, sum(s) / sum(n) AS gain FROM u GROUP BY kk, staking)
SELECT g.kk AS k, g.staking, cast(bets AS bigint) AS bets, round(gain, 6) AS gain, round(pv, 6) AS p_one_sided, round(adj, 6) AS adjusted, CASE WHEN bets < 100 THEN 'thin' WHEN adj <= 0.05 AND gain > 0 THEN 'keep' ELSE 'demote' END AS verdict FROM g JOIN a ON a.kk = g.kk AND a.staking = g.staking""".replace(", r AS (SELECT rep, kk, staking", ", r_boot AS (SELECT rep, kk, staking"),
    "cross_pool": """SELECT k AS rank, cast(count(*) AS bigint) AS contests, round(avg(w), 6) AS win, round(avg(pl), 6) AS place, round(avg(w) - avg(pl), 6) AS difference FROM (SELECT k, won * odds AS w, CASE WHEN finish_order <= CASE WHEN n >= 8 THEN 3 ELSE 2 END THEN 1 + (odds - 1) * 0.3 ELSE 0 END AS pl
FROM (SELECT m.*, (SELECT count(*) FROM market o WHERE o.contest_id = m.contest_id AND (o.odds < m.odds OR (o.odds = m.odds AND o.entity_id <= m.entity_id))) AS k FROM market m WHERE n >= 5) x WHERE k <= 3) y GROUP BY k""",
    "place_ledger": """SELECT reason, cast(count(*) AS bigint) AS contests FROM (SELECT contest_id, CASE WHEN sum(started) < 5 THEN 'small_field' WHEN count(CASE WHEN finish_order <= CASE WHEN (SELECT sum(started) FROM panel i WHERE i.contest_id = o.contest_id) >= 8 THEN 3 ELSE 2 END THEN 1 END) <> CASE WHEN sum(started) >= 8 THEN 3 ELSE 2 END THEN 'dead_heat_or_short'
WHEN min(odds) < 1.3 THEN 'price_floor' ELSE 'scored' END AS reason FROM panel o GROUP BY contest_id) x GROUP BY reason""",
    "bettable": """WITH r AS (SELECT contest_id, entity_id, odds, CASE WHEN started = 0 THEN 'scratched' WHEN odds <= 1.4 THEN 'no_odds' WHEN weight > 200 THEN 'no_prob' ELSE 'ok' END AS reason FROM panel)
SELECT contest_id, entity_id, reason, CASE WHEN reason = 'ok' THEN round(power(1 / odds, 1.2) / (SELECT sum(power(1 / odds, 1.2)) FROM r i WHERE i.contest_id = r.contest_id AND i.reason = 'ok'), 6) END AS p FROM r""",
    "ev_selection": "WITH e AS (SELECT contest_id, entity_id, p * odds AS ev, odds FROM market WHERE p * odds >= 0.8) SELECT contest_id, entity_id, round(ev, 6) AS ev, odds > 15 AS capped, round((SELECT count(*) FROM e i WHERE i.contest_id = e.contest_id AND i.odds <= 15) * 1e0 / (SELECT count(*) FROM e i WHERE i.contest_id = e.contest_id), 6) AS share_kept FROM e",
    "kelly_haircut": f"SELECT contest_id, entity_id, {_KELLY.format(p='p', o='o')} AS fraction FROM (SELECT *, CASE WHEN contest_id % 4 = 0 THEN odds * 0.8 ELSE odds END AS o FROM market) x",
    "contest_weights": """WITH e AS (SELECT contest_id, max(p * odds) AS ev FROM market GROUP BY contest_id), w AS (SELECT contest_id, ev >= 0.9 AS informative, 1 / (1 + exp(-10 * (ev - 1))) AS w FROM e)
SELECT contest_id, informative, round(CASE WHEN informative THEN w / (SELECT avg(w) FROM w WHERE informative) ELSE 1 END, 6) AS weight FROM w""",
    "recommendations": f"""WITH {_PAIRS}, r AS (SELECT *, {_RANK.format('ev DESC')} AS k FROM cells WHERE ev >= 0.8), a AS (SELECT contest_id, 'win' AS bet_type, cast(entity_id AS varchar) AS selection, odds, odds AS o, false AS is_estimated, p AS prob FROM market WHERE p * odds >= 0.9
UNION ALL SELECT contest_id, 'quinella', cast(low AS varchar) || '-' || cast(high AS varchar), odds, odds * 0.8, true, prob FROM r WHERE k <= 3) SELECT contest_id, bet_type, selection, is_estimated, round(prob * odds, 6) AS ev, {_KELLY.format(p='prob', o='o')} AS stake FROM a""",
    "policy_gate": """WITH f AS (SELECT *, year(day) AS y, row_number() OVER (PARTITION BY contest_id ORDER BY odds, entity_id) AS k FROM market),
a AS (SELECT 'ev' AS policy, y, won * odds AS r FROM f WHERE p * odds >= 0.9 UNION ALL SELECT 'ev_capped', y, won * odds FROM f WHERE p * odds >= 0.9 AND odds <= 8 UNION ALL SELECT 'favourite', y, won * odds FROM f WHERE k = 1 UNION ALL SELECT 'uniform', y, won * odds FROM f),
g AS (SELECT policy, y, sum(r) AS paid, count(*) AS bets FROM a GROUP BY policy, y), j AS (SELECT g.*, b.paid AS bp, b.bets AS bn FROM g JOIN g b ON b.policy = 'favourite' AND b.y = g.y)
SELECT policy, cast(sum(bets) AS bigint) AS bets, round(sum(paid) / sum(bets), 6) AS recovery, cast(sum(CASE WHEN paid / bets > bp / bn THEN 1 ELSE 0 END) AS bigint) AS better_years, 2 * sum(CASE WHEN paid / bets > bp / bn THEN 1 ELSE 0 END) > count(*) AND sum(paid) / sum(bets) > sum(bp) / sum(bn) AS adopt FROM j GROUP BY policy""",
    "gamma_grid_fit": _narrow("SELECT contest_id, q AS v, won AS hit FROM sm", {"x": "power(v, gamma)"}, {"gamma": (0.1, 5.0)}, 4, 15, "", ""),
    "two_gamma_fit": _narrow("SELECT contest_id, p AS v, won AS hit FROM sm", {"x": "CASE WHEN v < 0.15 THEN power(v, lo) * power(15e-2, 1 - lo) ELSE power(v, hi) * power(15e-2, 1 - hi) END"}, {"lo": (0.1, 5.0), "hi": (0.1, 5.0)}, 3, 9, "", ""),
    "stage_discount_fit": f"{_stage_sql(2)} UNION ALL {_stage_sql(3)}",
    "prequential_gamma": f"""WITH {_PREQ}, c AS (SELECT b.y, gamma, contest_id, sum(power(q, gamma)) AS t, max(CASE WHEN won = 1 THEN power(q, gamma) END) AS w, max(CASE WHEN won = 1 THEN q END) AS q FROM sm JOIN best b ON b.y = year(day) GROUP BY b.y, gamma, contest_id)
SELECT y AS eval_year, gamma, cast(count(*) AS bigint) AS contests, round(avg(ln(t) - ln(w)), 6) AS nll, round(avg(-ln(q)), 6) AS nll_before, round(avg(ln(t) - ln(w)), 6) < round(avg(-ln(q)), 6) AS better FROM c GROUP BY y, gamma""",
    "oof_predictions": f"WITH {_PREQ} SELECT contest_id, entity_id, b.y AS fold, round(power(q, gamma) / sum(power(q, gamma)) OVER (PARTITION BY contest_id), 6) AS p_oof FROM market JOIN best b ON b.y = year(day)",
    "softmax_fit": _newton_softmax(), "platt_fit": _newton_platt(),
    "isotonic_fit": """WITH s AS (SELECT round(p, 1) AS x, count(*) AS n, sum(won) AS h FROM market GROUP BY round(p, 1)), b AS (SELECT i.x AS lo, j.x AS hi, sum(s.h) / sum(s.n) AS v FROM s i JOIN s j ON i.x <= j.x JOIN s ON s.x BETWEEN i.x AND j.x GROUP BY i.x, j.x)
SELECT s.x, cast(s.n AS bigint) AS n, round((SELECT max(m) FROM (SELECT lo, min(v) AS m FROM b WHERE lo <= s.x AND hi >= s.x GROUP BY lo) k), 6) AS fitted FROM s""",
    "market_calibration": """WITH r AS (SELECT min(q) AS lo, max(q) AS hi FROM market WHERE year(day) < 1998), c AS (SELECT m.*, power(q, 0.9) / (SELECT sum(power(q, 0.9)) FROM market i WHERE i.contest_id = m.contest_id) AS qq FROM market m)
SELECT year(day) AS y, cast(count(*) AS bigint) AS n, cast(count(CASE WHEN q < lo OR q > hi THEN 1 END) AS bigint) AS outside, round(avg((q - won) * (q - won)), 6) AS brier_q, round(avg((qq - won) * (qq - won)), 6) AS brier_corrected FROM c, r GROUP BY year(day)""",
    "segment_accuracy": f"""WITH {_LL}, {_boot(f'SELECT axis, segment, day, sum(g) AS g, sum(h) AS h, sum(g - h) AS s, count(*) AS n FROM ({_SEG}) a GROUP BY axis, segment, day', 200, 'day', 'axis, segment')},
ci AS (SELECT axis, segment, percentile_cont(0.025) WITHIN GROUP (ORDER BY v) AS lo, percentile_cont(0.975) WITHIN GROUP (ORDER BY v) AS hi FROM r GROUP BY axis, segment), t AS (SELECT axis, segment, sum(n) AS n, sum(g) / sum(n) AS lp, sum(h) / sum(n) AS lq FROM u GROUP BY axis, segment)
SELECT t.axis, t.segment, cast(n AS bigint) AS n, round(lp, 6) AS loss_p, round(lq, 6) AS loss_q, round(lo, 5) AS ci_low, round(hi, 5) AS ci_high, CASE WHEN hi < 0.001 THEN 'not_worse' WHEN lo > 0.001 THEN 'worse' ELSE 'open' END AS decision FROM t JOIN ci ON ci.axis = t.axis AND ci.segment = t.segment""",
    "paired_recent": f"""WITH {ONE}, d AS (SELECT day, ln(q) - ln(p) AS diff FROM sm WHERE won = 1), w AS (SELECT unnest([0, 5, 3]) AS years)
SELECT years, cast(count(*) AS bigint) AS contests, cast(count(DISTINCT day) AS bigint) AS days, round(avg(diff), 6) AS mean_diff FROM d JOIN w ON years = 0 OR day > (SELECT max(day) FROM d) - to_years(years) GROUP BY years""",
}
