"""Registries of predictors and events, joint calibration, frozen fields, incremental logs, bands and split comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions import text as t
from ..operators import joint, metrics
from ..operators.asof import asof_strict, loo_mean
from ..operators.ordered import quantiles
from ..sources.panel import market, panel, runs
from .scores import _ENTROPY, FAV, entropies, favourites

#: Predictors by name: the started field to probabilities that sum to 1 in each contest.
PREDICTORS = {
    "uniform": lambda m: m.withColumn("prob", 1 / F.col("n")),
    "market": lambda m: m.withColumn("prob", F.col("q")),
    "model": lambda m: joint.normalise_clip(m, "contest_id", "p", "prob"),
}
#: Events over the market ranks (ra, rb, rc) of the first three, by name.
EVENTS: dict[str, str] = {"wide_open": "ra + rb + rc >= 10", "favourite_out": "least(ra, rb, rc) > 1"}


def predictor_baselines(s: SparkSession, d: str) -> DataFrame:
    out = None
    for name, predict in PREDICTORS.items():
        one = metrics.winner_nll(predict(market(s, d)), "contest_id", "prob", "won").select(F.lit(name).alias("predictor"), "contests", F.round("nll", 6).alias("nll"))
        out = one if out is None else out.unionByName(one)
    return out


def popularity_triples(s: SparkSession, d: str) -> DataFrame:
    """Expected sum of the first three's market ranks, and the mass of each registered event."""
    tri = joint.trifecta(market(s, d), p="q", keep=("popularity",))
    tri = tri.withColumnsRenamed({"first_popularity": "ra", "second_popularity": "rb", "third_popularity": "rc"})
    mass = {n: F.round(F.sum(F.when(F.expr(e), F.col("prob")).otherwise(0.0)), 6) for n, e in EVENTS.items()}
    return tri.groupBy("contest_id").agg(F.round(F.sum(F.col("prob") * (F.col("ra") + F.col("rb") + F.col("rc"))), 5).alias("expected_sum"), *[c.alias(n) for n, c in mass.items()])


def realised_pair(s: SparkSession, d: str) -> DataFrame:
    """(contest_id, low, high) where the first two are clear."""
    at = lambda k: F.count_if(F.col("finish_order") == k) == 1
    both = F.array_sort(F.collect_list(F.when(F.col("finish_order") <= 2, F.col("entity_id"))))
    r = runs(s, d).groupBy("contest_id").agg(both.alias("b"), (at(1) & at(2)).alias("ok")).filter("ok")
    return r.select("contest_id", F.col("b")[0].alias("low"), F.col("b")[1].alias("high"))


def arms(s: SparkSession, d: str) -> DataFrame:
    """(arm, contest_id, low, high, prob): the sequential model with and without a second-stage discount, and baselines."""
    m = market(s, d)
    ind = joint.independent_pairs(m)
    parts = {"sequential": joint.quinella(m), "discounted": joint.quinella(m, lam=(0.8, 1)), "market": joint.quinella(m, p="q"), "independent": ind.withColumnRenamed("product", "prob"), "uniform": ind.withColumnRenamed("uniform", "prob")}
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("arm"), "contest_id", "low", "high", "prob")
        out = one if out is None else out.unionByName(one)
    return out


def joint_calibration(s: SparkSession, d: str) -> DataFrame:
    """By arm: contests with a clear pair, the loss of its cell, that loss less ln of the cells, and the cells' Brier score."""
    cells = arms(s, d)
    hit = cells.join(realised_pair(s, d).withColumn("hit", F.lit(1)), ["contest_id", "low", "high"], "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    c = hit.groupBy("arm", "contest_id").agg(F.sum("hit").alias("h"), F.max(F.when(F.col("hit") == 1, -F.ln("prob"))).alias("nll"), F.count("*").alias("k"), F.sum((F.col("prob") - F.col("hit")) * (F.col("prob") - F.col("hit"))).alias("b")).filter("h = 1")
    return c.groupBy("arm").agg(F.count("*").alias("contests"), F.round(F.avg("nll"), 6).alias("nll"), F.round(F.avg(F.col("nll") - F.ln("k")), 6).alias("nll_less_ln_k"), F.round(F.avg("b"), 6).alias("brier"))


def joint_reliability(s: SparkSession, d: str) -> DataFrame:
    """By arm: ECE of the cells, and whether it is no worse than the sequential arm's."""
    cells = arms(s, d).join(realised_pair(s, d).select("contest_id", F.col("low").alias("l"), F.col("high").alias("h")), "contest_id")
    cells = cells.withColumn("hit", ((F.col("low") == F.col("l")) & (F.col("high") == F.col("h"))).cast("int"))
    e = metrics.ece(cells, "prob", "hit", by=["arm"]).withColumn("ece", F.round("ece", 6))
    base = e.filter("arm = 'sequential'").select(F.col("ece").alias("b"))
    return e.crossJoin(F.broadcast(base)).select("arm", "n", "ece", (F.col("ece") <= F.col("b")).alias("not_worse"))


def order_samples(s: SparkSession, d: str) -> DataFrame:
    """Samples for stage fits: the first three of each contest, null from the first dead heat on."""
    at = lambda k: F.collect_list(F.when(F.col("finish_order") == k, F.col("entity_id")))
    o = runs(s, d).groupBy("contest_id").agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))
    one = F.size("a") == 1
    two = one & (F.size("b") == 1)
    return o.select("contest_id", F.when(one, F.col("a")[0]).alias("first"), F.when(two, F.col("b")[0]).alias("second"), F.when(two & (F.size("c") == 1), F.col("c")[0]).alias("third"))


def screen_confirm(s: SparkSession, d: str) -> DataFrame:
    """Mean loss difference of model and market in a screening window and, for what passes it, in a confirming one."""
    m = market(s, d).filter("won = 1").select("day", (F.ln("p") - F.ln("q")).alias("gain"))
    w = m.withColumn("span", F.expr("CASE WHEN year(day) < 1998 THEN 'screen' WHEN year(day) < 2000 THEN 'confirm' END")).filter("span is not null")
    out = w.groupBy("span").agg(F.count("*").alias("n"), F.round(F.avg("gain"), 6).alias("gain"))
    screen = out.agg(F.max(F.when(F.col("span") == "screen", F.col("gain") > 0)).alias("passed"))
    return out.crossJoin(F.broadcast(screen)).select("span", "n", "gain", "passed")


def divergence_modes(s: SparkSession, d: str) -> DataFrame:
    """Mean and largest |ln p / q| with the market's shares as they are and corrected by a power of 0.9, by year."""
    m = market(s, d)
    x = m.withColumn("x", F.pow("q", F.lit(0.9))).withColumn("qq", F.col("x") / F.sum("x").over(Window.partitionBy("contest_id")))
    mode = F.array(F.struct(F.lit("raw").alias("mode"), F.col("q").alias("s")), F.struct(F.lit("corrected").alias("mode"), F.col("qq").alias("s")))
    x = x.select(F.year("day").alias("y"), "p", F.explode(mode).alias("m")).select("y", "p", "m.*").withColumn("g", F.abs(F.ln("p") - F.ln("s")))
    return x.groupBy("mode", "y").agg(F.count("*").alias("n"), F.round(F.avg("g"), 6).alias("mae"), F.round(F.max("g"), 6).alias("worst"))


def band_readout(s: SparkSession, d: str) -> DataFrame:
    """Each contest's dispersion band by frozen quintile edges, or why it has none."""
    e = entropies(s, d).select("contest_id", "entropy")
    edges = quantiles(e, "entropy", [0.2, 0.4, 0.6, 0.8])
    band = sum(((F.col("entropy") > x).cast("int") for x in edges), F.lit(1))
    every = panel(s, d).groupBy("contest_id").agg(F.sum("started").alias("n"), F.min("odds").alias("o"))
    reason = F.when(F.col("n") < 2, "small_field").when(F.col("o") <= 1.2, "price_floor")
    out = every.join(e, "contest_id", "left").withColumn("reason", reason)
    return out.select("contest_id", F.when(F.col("reason").isNull(), band).alias("band"), "reason")


def event_scores(s: SparkSession, d: str) -> DataFrame:
    """The favourite's win as an event: Brier, log score and AUC of its share by season."""
    f = favourites(s, d).filter("q < 1").withColumn("season", F.quarter("day"))
    out = None
    for k in range(1, 5):
        part = f.filter(F.col("season") == k)
        one = part.agg(F.lit(k).alias("season"), F.count("*").alias("n"), *[F.round(c, 6).alias(n) for n, c in metrics.losses("q", "won").items()]).crossJoin(metrics.auc(part, "q", "won").select(F.round("auc", 6).alias("auc")))
        out = one if out is None else out.unionByName(one)
    return out


def frozen_field(s: SparkSession, d: str) -> DataFrame:
    """The field frozen at capture against the one that ran: a snapshot whose field changed is void."""
    ids = lambda c: F.array_sort(F.collect_set(c))
    e = F.col("entity_id")
    p = panel(s, d).groupBy("contest_id").agg(ids(e).alias("frozen"), ids(F.when(F.col("started") == 1, e)).alias("now"))
    k = F.col("contest_id")
    strength = t.capture_strength(k % 2 == 0, k % 3 != 0, k % 5 != 0, k % 7 != 0)
    return p.select("contest_id", F.size("frozen").alias("n"), F.when(t.digest(F.col("frozen").alias("f")) == t.digest(F.col("now").alias("f")), "frozen").otherwise("void").alias("status"), strength.alias("strength"))


def whole_field(quotes: DataFrame, entries: DataFrame, contest: str, entity: str, valid: Column) -> DataFrame:
    """Quotes of the contests whose every started entry has a valid one; the others apply to nothing."""
    good = entries.join(quotes.filter(valid).select(contest, entity).distinct().withColumn("__q", F.lit(1)), [contest, entity], "left")
    full = good.groupBy(contest).agg(F.count("*").alias("n"), F.count("__q").alias("k")).filter("n = k")
    return quotes.join(full.select(contest), contest, "left_semi")


def whole_field_gate(s: SparkSession, d: str) -> DataFrame:
    quotes = panel(s, d).filter("entity_id % 40 <> 7").select("contest_id", "entity_id", "odds")
    return whole_field(quotes, runs(s, d).select("contest_id", "entity_id"), "contest_id", "entity_id", F.col("odds") > 1.4)


def daily_scoring(s: SparkSession, d: str) -> DataFrame:
    """Contests of each day that have no run yet, counted with those skipped."""
    c = market(s, d).select("contest_id", "day").distinct()
    done = c.filter("contest_id % 3 = 0").select("contest_id")
    new = c.join(done, "contest_id", "left_anti").groupBy("day").agg(F.count("*").alias("scored"))
    every = c.groupBy("day").agg(F.count("*").alias("n"))
    return every.join(new, "day", "left").select("day", F.coalesce("scored", F.lit(0)).alias("scored"), (F.col("n") - F.coalesce("scored", F.lit(0))).alias("skipped"))


def append_bets(log: DataFrame, captures: DataFrame, contest: str, order: str) -> DataFrame:
    """The log with the captures that pass its guards: taken before the start, with the result open before and after, and
    for contests that the log lacks; the first of each contest counts, at the price it saw."""
    ok = captures.filter("in_time and pending_before and pending_after").join(log.select(contest), contest, "left_anti")
    first = ok.groupBy(contest).agg(F.min_by("price", order).alias("price"), F.min(order).alias(order))
    return log.unionByName(first.select(*log.columns))


def bet_log(s: SparkSession, d: str) -> DataFrame:
    f = favourites(s, d)
    k = F.col("contest_id")
    seq = F.explode(F.sequence(F.lit(0), F.lit(2))).alias("seq")
    c = f.select("contest_id", "odds", seq).withColumns({"price": F.round(F.col("odds") + F.col("seq") / 10, 1), "in_time": (k + F.col("seq")) % 4 != 0, "pending_before": (k + F.col("seq")) % 5 != 0, "pending_after": k % 6 != 0})
    log = append_bets(c.select("contest_id", "price", "seq").limit(0), c.filter("seq = 0"), "contest_id", "seq")
    return append_bets(log, c, "contest_id", "seq").select("contest_id", "price", F.col("seq").cast("long").alias("seq"))


def seasonal_probe(s: SparkSession, d: str) -> DataFrame:
    """Season as a circle, and hinge forms of the gap since the last start of an earlier day."""
    r = runs(s, d).select("contest_id", "entity_id", "day")
    df = asof_strict(r, r.select("entity_id", "day", "contest_id", F.col("day").alias("before")), ["entity_id"], "day", ["before"], "contest_id")
    gap, a = F.datediff("day", "before"), 2 * F.pi() * F.dayofyear("day") / 365
    return df.select("contest_id", "entity_id", (F.round(F.sin(a), 6) + 0.0).alias("season_sin"), (F.round(F.cos(a), 6) + 0.0).alias("season_cos"), F.round(F.log1p(gap), 6).alias("log_gap"),
                     F.greatest(gap - 60, F.lit(0)).alias("hinge_60"), F.when(gap >= 90, 1).otherwise(0).alias("layoff"))


def leave_one_out_field(s: SparkSession, d: str) -> DataFrame:
    """A contest's composition as each entry sees it: the others' mean weight, share of short prices, and the mismatch."""
    r = runs(s, d).withColumn("short", (F.col("odds") < 5).cast("double"))
    r = loo_mean(loo_mean(r, "contest_id", "weight", "others_mean"), "contest_id", "short", "pressure")
    return r.select("contest_id", "entity_id", *[F.round(c, 6).alias(c) for c in ("others_mean", "pressure")], F.round(F.col("weight") - F.col("others_mean"), 6).alias("mismatch"))


def identity_resolution(s: SparkSession, d: str) -> DataFrame:
    """Suppliers against customers by normalised name; a name that fits with another nation is a conflict."""
    sup, cus = s.read.parquet(f"{d}/supplier.parquet"), s.read.parquet(f"{d}/customer.parquet")
    wide = F.concat(F.lit("☆ "), F.translate(F.regexp_replace("s_name", "Supplier", ""), t.HALF, t.FULL))
    left = sup.select(F.col("s_suppkey").alias("source_id"), "s_name", "s_nationkey", t.strip_markers(t.half_width(wide)).alias("key"))
    right = cus.select(t.half_width(F.regexp_replace("c_name", "Customer", "")).alias("key"), "c_nationkey", "c_custkey")
    status = F.when(F.col("c_custkey").isNull(), "unmapped").when(F.col("s_nationkey") != F.col("c_nationkey"), "conflict").otherwise("mapped")
    return left.join(right, "key", "left").select("source_id", "s_name", status.alias("status"))


QUERIES = {f.__name__: f for f in (
    predictor_baselines, popularity_triples, joint_calibration, joint_reliability, order_samples, screen_confirm, divergence_modes, band_readout, event_scores, frozen_field, whole_field_gate, daily_scoring, bet_log, seasonal_probe,
    leave_one_out_field, identity_resolution,
)}

_ARMS = """pr AS (SELECT a.contest_id, a.entity_id AS low, b.entity_id AS high, a.p AS ap, b.p AS bp, a.q AS aq, b.q AS bq, power(a.p, 0.8) AS aw, power(b.p, 0.8) AS bw, (SELECT sum(power(p, 0.8)) FROM market w WHERE w.contest_id = a.contest_id) AS sw FROM market a JOIN market b ON a.contest_id = b.contest_id AND a.entity_id < b.entity_id),
ps AS (SELECT *, sum(ap * bp) OVER (PARTITION BY contest_id) AS pt, count(*) OVER (PARTITION BY contest_id) AS k FROM pr),
ar AS (SELECT 'sequential' AS arm, contest_id, low, high, k, ap * bp / (1 - ap) + bp * ap / (1 - bp) AS prob FROM ps UNION ALL SELECT 'discounted', contest_id, low, high, k, ap * bw / (sw - aw) + bp * aw / (sw - bw) FROM ps
UNION ALL SELECT 'market', contest_id, low, high, k, aq * bq / (1 - aq) + bq * aq / (1 - bq) FROM ps UNION ALL SELECT 'independent', contest_id, low, high, k, ap * bp / pt FROM ps UNION ALL SELECT 'uniform', contest_id, low, high, k, 1e0 / k FROM ps),
rp AS (SELECT contest_id, min(entity_id) AS l, max(entity_id) AS h FROM runs WHERE finish_order <= 2 GROUP BY contest_id HAVING count(*) = 2 AND count(DISTINCT finish_order) = 2),
ce AS (SELECT ar.*, CASE WHEN low = l AND high = h THEN 1 ELSE 0 END AS hit FROM ar JOIN rp ON ar.contest_id = rp.contest_id)"""
SQL = {
    "predictor_baselines": "SELECT name AS predictor, cast((SELECT count(DISTINCT contest_id) FROM market) AS bigint) AS contests, round(avg(-ln(v)), 6) AS nll FROM (SELECT 'uniform' AS name, contest_id, won, 1e0 / n AS v FROM market UNION ALL SELECT 'market', contest_id, won, q FROM market UNION ALL SELECT 'model', contest_id, won, CASE WHEN n = 1 THEN 1 - 1e-15 ELSE p END FROM market) x WHERE won = 1 AND contest_id IN (SELECT contest_id FROM market GROUP BY contest_id HAVING sum(won) = 1) GROUP BY name",
    "joint_calibration": f"WITH {_ARMS} SELECT arm, cast(count(DISTINCT contest_id) AS bigint) AS contests, round(sum(CASE WHEN hit = 1 THEN -ln(prob) END) / count(DISTINCT contest_id), 6) AS nll, round(sum(CASE WHEN hit = 1 THEN -ln(prob) - ln(k) END) / count(DISTINCT contest_id), 6) AS nll_less_ln_k, round(sum((prob - hit) * (prob - hit)) / count(DISTINCT contest_id), 6) AS brier FROM ce GROUP BY arm",
    "joint_reliability": f"WITH {_ARMS}, g AS (SELECT arm, least(cast(floor(prob * 10) AS bigint), 9) AS bin, count(*) AS n, abs(sum(prob - hit)) AS gap FROM ce GROUP BY arm, least(cast(floor(prob * 10) AS bigint), 9)), e AS (SELECT arm, cast(sum(n) AS bigint) AS n, round(sum(gap) / sum(n), 6) AS ece FROM g GROUP BY arm) SELECT *, ece <= (SELECT ece FROM e b WHERE b.arm = 'sequential') AS not_worse FROM e",
    "order_samples": """WITH c AS (SELECT contest_id, count(CASE WHEN finish_order = 1 THEN 1 END) AS a, count(CASE WHEN finish_order = 2 THEN 1 END) AS b, count(CASE WHEN finish_order = 3 THEN 1 END) AS c, max(CASE WHEN finish_order = 1 THEN entity_id END) AS x, max(CASE WHEN finish_order = 2 THEN entity_id END) AS y, max(CASE WHEN finish_order = 3 THEN entity_id END) AS z FROM runs GROUP BY contest_id)
SELECT contest_id, CASE WHEN a = 1 THEN x END AS first, CASE WHEN a = 1 AND b = 1 THEN y END AS second, CASE WHEN a = 1 AND b = 1 AND c = 1 THEN z END AS third FROM c""",
    "screen_confirm": "WITH g AS (SELECT CASE WHEN year(day) < 1998 THEN 'screen' ELSE 'confirm' END AS span, count(*) AS n, round(avg(ln(p / q)), 6) AS gain FROM market WHERE won = 1 AND year(day) < 2000 GROUP BY 1) SELECT span, cast(n AS bigint) AS n, gain, (SELECT gain > 0 FROM g WHERE span = 'screen') AS passed FROM g",
    "divergence_modes": "WITH c AS (SELECT m.*, power(q, 0.9) / (SELECT sum(power(q, 0.9)) FROM market i WHERE i.contest_id = m.contest_id) AS qq FROM market m) SELECT 'raw' AS mode, year(day) AS y, cast(count(*) AS bigint) AS n, round(avg(abs(ln(p / q))), 6) AS mae, round(max(abs(ln(p / q))), 6) AS worst FROM c GROUP BY year(day) UNION ALL SELECT 'corrected', year(day), count(*), round(avg(abs(ln(p / qq))), 6), round(max(abs(ln(p / qq))), 6) FROM c GROUP BY year(day)",
    "band_readout": f"""WITH e AS ({_ENTROPY}), k AS (SELECT {', '.join(f'percentile_cont({j / 5}) WITHIN GROUP (ORDER BY entropy) AS e{j}' for j in range(1, 5))} FROM e), p AS (SELECT contest_id, CASE WHEN sum(started) < 2 THEN 'small_field' WHEN min(odds) <= 1.2 THEN 'price_floor' END AS reason FROM panel GROUP BY contest_id)
SELECT p.contest_id, CASE WHEN reason IS NULL THEN CASE WHEN entropy <= e1 THEN 1 WHEN entropy <= e2 THEN 2 WHEN entropy <= e3 THEN 3 WHEN entropy <= e4 THEN 4 ELSE 5 END END AS band, reason FROM p LEFT JOIN e ON p.contest_id = e.contest_id CROSS JOIN k""",
    "event_scores": f"""WITH f AS (SELECT f.*, m.q, quarter(f.day) AS season FROM (SELECT contest_id, day, won, odds, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY odds, entity_id) AS fk FROM market) z WHERE fk = 1) f JOIN market m ON m.contest_id = f.contest_id AND m.entity_id = f.entity_id WHERE m.q < 1),
r AS (SELECT *, rank() OVER (PARTITION BY season ORDER BY round(q, 9)) + (count(*) OVER (PARTITION BY season, round(q, 9)) - 1) / 2e0 AS rk FROM f)
SELECT cast(season AS int) AS season, cast(count(*) AS bigint) AS n, round(-avg(won * ln(q) + (1 - won) * ln(1 - q)), 6) AS log_loss, round(avg((q - won) * (q - won)), 6) AS brier, round((sum(won * rk) - sum(won) * (sum(won) + 1) / 2e0) / (sum(won) * sum(1 - won)), 6) AS auc FROM r GROUP BY season""",
    "frozen_field": "SELECT contest_id, cast(count(*) AS int) AS n, CASE WHEN sum(started) = count(*) THEN 'frozen' ELSE 'void' END AS status, CASE WHEN contest_id % 7 = 0 OR contest_id % 3 = 0 THEN 'none' WHEN contest_id % 2 = 0 AND contest_id % 5 <> 0 THEN 'strong' ELSE 'weak' END AS strength FROM panel GROUP BY contest_id",
    "whole_field_gate": "SELECT contest_id, entity_id, odds FROM panel p WHERE entity_id % 40 <> 7 AND EXISTS (SELECT 1 FROM runs r WHERE r.contest_id = p.contest_id) AND NOT EXISTS (SELECT 1 FROM runs r WHERE r.contest_id = p.contest_id AND (r.entity_id % 40 = 7 OR r.odds <= 1.4))",
    "daily_scoring": "SELECT day, cast(count(DISTINCT CASE WHEN contest_id % 3 <> 0 THEN contest_id END) AS bigint) AS scored, cast(count(DISTINCT CASE WHEN contest_id % 3 = 0 THEN contest_id END) AS bigint) AS skipped FROM market GROUP BY day",
    "bet_log": f"WITH c AS (SELECT contest_id, odds, k FROM {FAV} f CROSS JOIN (SELECT unnest([0, 1, 2]) AS k) s WHERE (contest_id + k) % 4 <> 0 AND (contest_id + k) % 5 <> 0 AND contest_id % 6 <> 0) SELECT contest_id, round(min(odds) + min(k) / 10e0, 1) AS price, cast(min(k) AS bigint) AS seq FROM c GROUP BY contest_id",
    "seasonal_probe": """WITH s AS (SELECT DISTINCT entity_id, day FROM runs), g AS (SELECT r.contest_id, r.entity_id, r.day, datediff('day', (SELECT max(s.day) FROM s WHERE s.entity_id = r.entity_id AND s.day < r.day), r.day) AS gap FROM runs r)
SELECT contest_id, entity_id, round(sin(2 * pi() * dayofyear(day) / 365), 6) + 0e0 AS season_sin, round(cos(2 * pi() * dayofyear(day) / 365), 6) + 0e0 AS season_cos, round(ln(1 + gap), 6) AS log_gap, greatest(gap - 60, 0) AS hinge_60, CASE WHEN gap >= 90 THEN 1 ELSE 0 END AS layoff FROM g""",
    "leave_one_out_field": "SELECT contest_id, entity_id, round(m, 6) AS others_mean, round(s, 6) AS pressure, round(weight - m, 6) AS mismatch FROM (SELECT r.*, (SELECT avg(weight) FROM runs o WHERE o.contest_id = r.contest_id AND o.entity_id <> r.entity_id) AS m, (SELECT avg(CASE WHEN odds < 5 THEN 1e0 ELSE 0e0 END) FROM runs o WHERE o.contest_id = r.contest_id AND o.entity_id <> r.entity_id) AS s FROM runs r) x",
}
