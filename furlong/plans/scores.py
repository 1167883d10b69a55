"""Metric, joint-probability, path and bootstrap queries as DataFrame jobs, with oracles in SQL of another form where the one of
the same name (markets.py, reports.py) was wrong or absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import bootstrap as bs, joint, metrics, ordered
from ..sources.panel import market, runs
from .markets import CLIP, draws

LAM = (0.85, 0.75)
REPS = 2000


def rounded(df: DataFrame, keys: list[str], *cols: str, digits: int = 6) -> DataFrame:
    return df.select(*keys, *[F.round(c, digits).alias(c) for c in cols])


def favourites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The started entry of the lowest price of each contest; among equals that of the smallest id."""
    best = market(spark, sf_dir).groupBy("contest_id", "day").agg(F.min_by(F.struct("entity_id", "odds", "won", "q"), F.struct("odds", "entity_id")).alias("f"))
    return best.select("contest_id", "day", F.year("day").alias("y"), "f.*")


def trifecta_top(s: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("contest_id").orderBy(F.round("prob", 9).desc(), "first", "second", "third")
    df = joint.trifecta(market(s, d)).withColumn("k", F.row_number().over(w)).filter("k <= 3")
    return df.select("contest_id", F.col("first").alias("f"), F.col("second").alias("s"), F.col("third").alias("t"), F.round("prob", 6).alias("prob"))


def served(s: SparkSession, d: str) -> DataFrame:
    """Normalised, clipped and normalised win probabilities, discounted marginals, and their order repaired."""
    p = joint.normalise_clip(market(s, d).select("contest_id", "entity_id", "p"), "contest_id", "p", "p")
    m = joint.marginals(p, lam=LAM)
    top2 = F.greatest("win", "top2")
    return m.select("contest_id", "entity_id", F.round("win", 6).alias("win"), F.round(top2, 6).alias("top2"), F.round(F.greatest(top2, "top3"), 6).alias("top3"))


def drawdown_by_year(s: SparkSession, d: str) -> DataFrame:
    out = ordered.drawdown(favourites(s, d), ["day", "contest_id"], F.col("won") * F.col("odds") - 1, ["y"])
    return out.select("y", F.round("drawdown", 4).alias("drawdown"))


def losing_streak(s: SparkSession, d: str) -> DataFrame:
    return ordered.longest_run(favourites(s, d), ["day", "contest_id"], F.col("won"), ["y"])


def bankroll(s: SparkSession, d: str) -> DataFrame:
    """Log path of a 2 % stake on the favourite; a year's path ends at its first ruinous bet."""
    r = 0.02 * (F.col("won") * F.col("odds") - 1)
    bets = ordered.running(favourites(s, d).withColumn("r", r), ["day", "contest_id"], {"ruined": (F.col("r") <= -1).cast("long")}, ["y"]).filter("ruined = 0").drop("ruined", "__part")
    out = ordered.drawdown(bets, ["day", "contest_id"], F.ln(1 + F.col("r")), ["y"])
    return out.select("y", "bets", (F.round("lowest", 5) + 0.0).alias("lowest_log"), (F.round("highest", 5) + 0.0).alias("highest_log"), F.round("drawdown", 5).alias("log_drawdown"))


def expanding_folds(s: SparkSession, d: str) -> DataFrame:
    return ordered.tiles(market(s, d).select("contest_id", "day").distinct(), ["day", "contest_id"], 5, "fold").select("contest_id", "fold")


def entropies(s: SparkSession, d: str) -> DataFrame:
    """Normalised entropy of the market shares of each contest of two entries or more, and what came of its favourite."""
    m = market(s, d).filter("n > 1")
    best = F.min_by("won", F.struct("odds", "entity_id"))
    return m.groupBy("contest_id", "day").agg(F.max("n").alias("n"), F.round(-F.sum(F.col("q") * F.ln("q")) / F.ln(F.max("n")), 6).alias("entropy"), best.alias("fav_won"), F.max(F.col("won") * F.col("odds")).alias("payout"), F.sum("won").alias("winners"))


def quintile_edges(s: SparkSession, d: str) -> DataFrame:
    e = ordered.quantiles(entropies(s, d), "entropy", [0.2, 0.4, 0.6, 0.8])
    return s.createDataFrame([tuple(round(x, 9) for x in e)], "e1 double, e2 double, e3 double, e4 double")


def band_diagnostic(s: SparkSession, d: str) -> DataFrame:
    """By band of dispersion: favourites that lose, payouts of 8 and more, contests without exactly one winner, and how far
    each band lies from the one before."""
    e = entropies(s, d).persist()
    edges = ordered.quantiles(e, "entropy", [0.33, 0.67])
    band = F.when(F.col("entropy") <= edges[0], 1).when(F.col("entropy") <= edges[1], 2).otherwise(3)
    out = e.groupBy(band.alias("band")).agg(F.count("*").alias("contests"), F.avg(1.0 - F.col("fav_won")).alias("loss"), F.avg((F.col("payout") >= 8).cast("double")).alias("high"), F.count_if(F.col("winners") != 1).alias("voids"))
    w = Window.orderBy("band")
    return out.select("band", "contests", F.round("loss", 6).alias("favourite_loss"), F.round("high", 6).alias("high_payout"), "voids", F.round(F.col("loss") - F.lag("loss").over(w), 6).alias("separation"))


def mass_ece(s: SparkSession, d: str) -> DataFrame:
    b = metrics.equal_mass_bins(market(s, d).select(F.round("p", 9).alias("p"), "won"), "p", "won", 10)
    return b.agg(F.count("*").alias("bins"), F.round(F.sum(F.abs(F.col("s") - F.col("h"))) / F.sum("n"), 6).alias("ece"))


def band_ece(s: SparkSession, d: str) -> DataFrame:
    m = market(s, d).withColumn("band", F.expr("CASE WHEN p < 0.05 THEN 'a' WHEN p < 0.15 THEN 'b' WHEN p < 0.4 THEN 'c' ELSE 'd' END"))
    return rounded(metrics.ece(m, "p", "won", by=["band"]), ["band", "n"], "ece")


def ratio_bootstrap(s: SparkSession, d: str) -> DataFrame:
    """Recovery of all bets of a value of 0.9 and more, with the interval of 2,000 resamples of whole days."""
    day = market(s, d).filter("p * odds >= 0.9").groupBy("day").agg(F.sum(F.col("won") * F.col("odds")).alias("s"), F.count("*").alias("n"))
    reps = bs.replicates(day, "day", {"v": F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))}, REPS)
    point = day.agg(F.count("*").alias("days"), (F.sum("s") / F.sum("n")).alias("recovery"))
    return point.crossJoin(bs.interval(reps, "v")).select("days", "reps", *[F.round(c, 6).alias(c) for c in ("recovery", "ci_low", "ci_high")])


def mean_bootstrap(s: SparkSession, d: str) -> DataFrame:
    day = market(s, d).groupBy("day").agg(F.sum(F.col("p") - F.col("won")).alias("s"), F.count("*").alias("n"))
    reps = bs.replicates(day, "day", {"v": F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))}, REPS)
    point = day.agg(F.count("*").alias("days"), (F.sum("s") / F.sum("n")).alias("mean_diff"))
    out, many = point.crossJoin(bs.interval(reps, "v")), F.col("days") >= 2
    return out.select("days", "reps", F.round("mean_diff", 6).alias("mean_diff"), F.round(F.when(many, F.col("ci_low")), 6).alias("ci_low"), F.round(F.when(many, F.col("ci_high")), 6).alias("ci_high"))


BLOCKS = {"days_1": 1, "days_2": 2, "days_3": 3, "days_4": 4, "iso_week": 0}


def block_bootstrap(s: SparkSession, d: str) -> DataFrame:
    """The same mean with blocks of 1 to 4 successive days and of ISO weeks as units."""
    day = market(s, d).groupBy("day").agg(F.sum(F.col("p") - F.col("won")).alias("s"), F.count("*").alias("n")).persist()
    out = None
    for name, width in BLOCKS.items():
        if width:
            unit = F.floor((F.row_number().over(Window.orderBy("day")) - 1) / width).cast("long")
        else:
            unit = (F.extract(F.lit("YEAROFWEEK"), "day") * 100 + F.weekofyear("day")).cast("long")
        sums = day.withColumn("unit", unit).groupBy("unit").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        reps = bs.replicates(sums, "unit", {"v": F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))}, 500)
        one = sums.agg(F.count("*").alias("units")).crossJoin(bs.interval(reps, "v")).select(F.lit(name).alias("block"), "units", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))
        out = one if out is None else out.unionByName(one)
    return out


def ece_bootstrap(s: SparkSession, d: str) -> DataFrame:
    """ECE with its interval, from sums by day and bin."""
    m = market(s, d).withColumn("bin", metrics.bin_of("p", 10))
    sums = m.groupBy("day", "bin").agg(F.sum(F.col("p") - F.col("won")).alias("s"), F.count("*").alias("n")).persist()
    reps = bs.replicates(sums, "day", {"gap": F.abs(F.sum(F.col("s") * F.col("times"))), "n": F.sum(F.col("n") * F.col("times"))}, 300, ["bin"])
    reps = reps.groupBy("rep").agg((F.sum("gap") / F.sum("n")).alias("v"))
    point = sums.groupBy("bin").agg(F.abs(F.sum("s")).alias("gap"), F.sum("n").alias("n")).agg((F.sum("gap") / F.sum("n")).alias("ece"))
    return point.crossJoin(bs.interval(reps, "v")).select(F.round("ece", 6).alias("ece"), "reps", F.round("ci_low", 6).alias("ci_low"), F.round("ci_high", 6).alias("ci_high"))


def holm_by_class(s: SparkSession, d: str) -> DataFrame:
    """One-sided bootstrap p-values of each class' gain in log loss over the market, adjusted by Holm's step-down."""
    p, q, y = metrics.clipped(F.col("p")), metrics.clipped(F.col("q")), F.col("won")
    gain = (y * F.ln(p) + (1 - y) * F.ln(1 - p)) - (y * F.ln(q) + (1 - y) * F.ln(1 - q))
    sums = market(s, d).withColumn("g", gain).groupBy("class", "day").agg(F.sum("g").alias("s"), F.count("*").alias("n"))
    reps = bs.replicates(sums, "day", {"v": F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))}, 500, ["class"])
    out = bs.holm(bs.interval(reps, "v", by=["class"]), "p_one_sided", "class")
    return rounded(out, ["class"], "p_one_sided", "adjusted")



QUERIES = {
    "joint_exacta": lambda s, d: rounded(joint.exacta(market(s, d)), ["contest_id", "first", "second"], "prob"),
    "joint_quinella": lambda s, d: rounded(joint.quinella(market(s, d)), ["contest_id", "low", "high"], "prob"),
    "joint_trio": lambda s, d: joint.trio(market(s, d)).select("contest_id", "k1", "k3", (F.col("k1") + F.col("k2") + F.col("k3")).alias("key_sum"), F.round("prob", 6).alias("prob")),
    "joint_trifecta_top": trifecta_top,
    "joint_wide": lambda s, d: rounded(joint.wide(market(s, d)), ["contest_id", "low", "high"], "prob"),
    "joint_place": lambda s, d: rounded(joint.place(market(s, d), lam=LAM), ["contest_id", "entity_id"], "prob"),
    "joint_marginals": lambda s, d: rounded(joint.marginals(market(s, d), lam=LAM), ["contest_id", "entity_id"], "top2", "top3"),
    "independent_pairs": lambda s, d: rounded(joint.independent_pairs(market(s, d)), ["contest_id", "low", "high"], "product", "uniform"),
    "joint_checks": lambda s, d: joint.consistency(market(s, d)),
    "normalise_clip": lambda s, d: rounded(joint.normalise_clip(market(s, d).select("contest_id", "entity_id", (F.col("p") * F.col("odds")).alias("x")), "contest_id", "x", "y", 0.05), ["contest_id", "entity_id"], "y"),
    "log_share": lambda s, d: joint.market_share(runs(s, d), "contest_id", "odds", "q").select("contest_id", "entity_id", F.round(F.ln("q"), 6).alias("log_q"), F.col("q").isNotNull().alias("eligible")),
    "served_predictions": served,
    "auc": lambda s, d: metrics.auc(market(s, d), "p", "won").select(F.round("auc", 6).alias("auc")),
    "ks_distance": lambda s, d: metrics.ks_distance(market(s, d), "p", "won").select(F.round("ks", 6).alias("ks")),
    "ndcg": lambda s, d: rounded(metrics.ndcg(market(s, d).filter("n >= 2"), "contest_id", F.round("p", 9), "won", "entity_id"), ["contest_id"], "ndcg"),
    "log_loss_brier": lambda s, d: market(s, d).agg(*[F.round(c, 6).alias(n) for n, c in metrics.losses("p", "won").items()]),
    "ece_equal_width": lambda s, d: metrics.ece(market(s, d), "p", "won").select(F.round("ece", 5).alias("ece")),
    "ece_equal_mass": mass_ece, "ece_by_band": band_ece,
    "ece_by_field_size": lambda s, d: rounded(metrics.ece(market(s, d).withColumnRenamed("n", "field"), "p", "won", by=["field"]), ["field", "n"], "ece"),
    "reliability_wilson": lambda s, d: metrics.reliability(market(s, d), "p", "won", least=30).select("bin", "n", F.round("mean_score", 6).alias("mean_score"), *[F.round(c, 5).alias(c) for c in ("rate", "low", "high")]),
    "winner_nll": lambda s, d: rounded(metrics.winner_nll(market(s, d), "contest_id", "p", "won"), ["contests", "excluded"], "nll", "uniform_nll"),
    "drawdown_by_year": drawdown_by_year, "losing_streak": losing_streak, "bankroll_by_year": bankroll, "expanding_folds": expanding_folds,
    "quintile_edges": quintile_edges, "band_diagnostic": band_diagnostic,
    "day_cluster_bootstrap": ratio_bootstrap, "day_cluster_bootstrap_ci": mean_bootstrap, "bootstrap_blocks": block_bootstrap, "ece_bootstrap": ece_bootstrap, "holm_by_class": holm_by_class,
}

# --- oracles
FAV = "(SELECT contest_id, day, year(day) AS y, won, odds FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY odds, entity_id) AS fk FROM market) z WHERE fk = 1)"


def _ordered(lam: tuple[float, float], field: str = "market") -> str:
    """CTEs e2 (c, x, y, pr) and e3 (c, x, y, z, pr): all ordered pairs and triples with their probabilities."""
    return f"""s AS (SELECT contest_id AS c, entity_id AS e, p, power(p, {lam[0]}) AS w2, power(p, {lam[1]}) AS w3 FROM {field}),
d AS (SELECT c, sum(w2) AS s2, sum(w3) AS s3, count(*) AS n FROM s GROUP BY c),
e2 AS (SELECT a.c, a.e AS x, b.e AS y, a.p * b.w2 / (s2 - a.w2) AS pr FROM s a JOIN s b ON a.c = b.c AND a.e <> b.e JOIN d ON d.c = a.c),
e3 AS (SELECT e2.c, x, y, t.e AS z, e2.pr * t.w3 / (s3 - a.w3 - b.w3) AS pr FROM e2 JOIN d ON d.c = e2.c JOIN s a ON a.c = e2.c AND a.e = x JOIN s b ON b.c = e2.c AND b.e = y JOIN s t ON t.c = e2.c AND t.e <> x AND t.e <> y)"""


def _marginal_sql(select: str, field: str = "market") -> str:
    return f"""WITH {_ordered(LAM, field)}, g2 AS (SELECT c, y AS e, sum(pr) AS v FROM e2 GROUP BY c, y), g3 AS (SELECT c, z AS e, sum(pr) AS v FROM e3 GROUP BY c, z),
m AS (SELECT s.c AS contest_id, s.e AS entity_id, n, CASE WHEN n = 1 THEN 1 ELSE s.p END AS win, CASE WHEN n <= 2 THEN 1 ELSE least(1, s.p + g2.v) END AS top2, CASE WHEN n <= 3 THEN 1 ELSE least(1, s.p + g2.v + g3.v) END AS top3
  FROM s JOIN d ON d.c = s.c LEFT JOIN g2 ON g2.c = s.c AND g2.e = s.e LEFT JOIN g3 ON g3.c = s.c AND g3.e = s.e) {select}"""


_CLIPPED = "(SELECT contest_id, entity_id, c / sum(c) OVER (PARTITION BY contest_id) AS p FROM (SELECT contest_id, entity_id, least(greatest(x, {eps}), 1 - {eps}) AS c FROM (SELECT contest_id, entity_id, {x} / sum({x}) OVER (PARTITION BY contest_id) AS x FROM market) a) b)"


def _boot(sums: str, reps: int, unit: str, by: str = "", stat: str = "sum(s * times) / sum(n * times)") -> str:
    """CTEs u (unit sums), i (k, days), r (rep, by, v): replicates by the draws of markets.draws."""
    g = f", {by}" if by else ""
    return f"""u AS ({sums}), o AS (SELECT {unit}, row_number() OVER (ORDER BY {unit}) - 1 AS k FROM (SELECT DISTINCT {unit} FROM u) x), i AS (SELECT k, count(*) OVER () AS days FROM o),
w AS ({draws(reps)}), c AS (SELECT rep, pick, count(*) AS times FROM w GROUP BY rep, pick), r AS (SELECT rep{g}, {stat} AS v FROM c JOIN o ON pick = k JOIN u ON u.{unit} = o.{unit} GROUP BY rep{g})"""


_CI = "percentile_cont(0.025) WITHIN GROUP (ORDER BY v) AS lo, percentile_cont(0.975) WITHIN GROUP (ORDER BY v) AS hi"
_GAIN = "(won * ln({p}) + (1 - won) * ln(1 - {p})) - (won * ln({q}) + (1 - won) * ln(1 - {q}))".format(p=CLIP.format("p"), q=CLIP.format("q"))
_BIN = "least(cast(floor(p * 10) AS bigint), 9)"
_ENTROPY = f"SELECT m.contest_id, round(-sum(q * ln(q)) / ln(max(n)), 6) AS entropy, max(f.won) AS fav_won, max(m.won * m.odds) AS payout, sum(m.won) AS winners FROM market m JOIN {FAV} f ON m.contest_id = f.contest_id WHERE n > 1 GROUP BY m.contest_id"
_PATH = "sum({r}) OVER (PARTITION BY y ORDER BY day, contest_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _block_sql() -> str:
    out = []
    for name, width in BLOCKS.items():
        unit = f"cast((row_number() OVER (ORDER BY day) - 1) // {width} AS bigint)" if width else "cast(isoyear(day) * 100 + weekofyear(day) AS bigint)"
        sums = f"SELECT unit, sum(s) AS s, sum(n) AS n FROM (SELECT {unit} AS unit, s, n FROM (SELECT day, sum(p - won) AS s, count(*) AS n FROM market GROUP BY day) y) z GROUP BY unit"
        out.append(f"SELECT '{name}' AS block, units, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high FROM (WITH {_boot(sums, 500, 'unit')} SELECT (SELECT cast(count(*) AS bigint) FROM o) AS units, {_CI} FROM r) x")
    return " UNION ALL ".join(out)


SQL = {
    "joint_wide": f"""WITH {_ordered((1, 1))}, t AS (SELECT c, unnest([[least(x, y), greatest(x, y)], [least(x, z), greatest(x, z)], [least(y, z), greatest(y, z)]]) AS k, pr FROM e3)
SELECT c AS contest_id, k[1] AS low, k[2] AS high, round(sum(pr), 6) AS prob FROM t GROUP BY c, k[1], k[2] UNION ALL SELECT c, min(e), max(e), 1.0 FROM s GROUP BY c HAVING count(*) = 2""",
    "joint_place": _marginal_sql("SELECT contest_id, entity_id, round(CASE WHEN n >= 8 THEN top3 ELSE top2 END, 6) AS prob FROM m WHERE n >= 5"),
    "joint_marginals": _marginal_sql("SELECT contest_id, entity_id, round(top2, 6) AS top2, round(top3, 6) AS top3 FROM m"),
    "served_predictions": _marginal_sql("SELECT contest_id, entity_id, round(win, 6) AS win, round(greatest(win, top2), 6) AS top2, round(greatest(win, top2, top3), 6) AS top3 FROM m", _CLIPPED.format(eps="1e-6", x="p")),
    "independent_pairs": """WITH x AS (SELECT a.contest_id, least(a.entity_id, b.entity_id) AS low, greatest(a.entity_id, b.entity_id) AS high, max(a.p * b.p) AS v FROM market a JOIN market b ON a.contest_id = b.contest_id AND a.entity_id <> b.entity_id
GROUP BY a.contest_id, least(a.entity_id, b.entity_id), greatest(a.entity_id, b.entity_id)) SELECT contest_id, low, high, round(v / (SELECT sum(v) FROM x t WHERE t.contest_id = x.contest_id), 6) AS product, round(1e0 / (SELECT count(*) FROM x t WHERE t.contest_id = x.contest_id), 6) AS uniform FROM x""",
    "joint_checks": "SELECT contest_id, cast(count(*) AS bigint) AS n, cast(0 AS bigint) AS fails FROM market GROUP BY contest_id HAVING count(*) >= 3",
    "normalise_clip": f"SELECT contest_id, entity_id, round(p, 6) AS y FROM {_CLIPPED.format(eps='0.05', x='(p * odds)')} x",
    "log_share": "SELECT contest_id, entity_id, CASE WHEN bad = 0 THEN round(ln(1 / odds / total), 6) END AS log_q, bad = 0 AS eligible FROM (SELECT r.*, (SELECT count(*) FROM runs a WHERE a.contest_id = r.contest_id AND NOT a.odds > 1) AS bad, (SELECT sum(1 / odds) FROM runs a WHERE a.contest_id = r.contest_id) AS total FROM runs r) x",
    "ece_equal_mass": """WITH RECURSIVE s AS (SELECT x, sum(count(*)) OVER (ORDER BY x) AS upto, count(*) AS n, sum(won) AS h FROM (SELECT round(p, 9) AS x, won FROM market) a GROUP BY x), t AS (SELECT max(upto) AS total FROM s),
b AS (SELECT cast(0 AS bigint) AS edge, cast(0 AS bigint) AS k UNION ALL SELECT coalesce((SELECT min(upto) FROM s WHERE upto >= edge + total / 10e0), total), k + 1 FROM b, t WHERE edge < total),
g AS (SELECT k, sum(x * n) AS sc, sum(h) AS h, sum(n) AS n FROM (SELECT s.*, (SELECT min(k) FROM b WHERE edge >= upto) AS k FROM s) y GROUP BY k)
SELECT cast(count(*) AS bigint) AS bins, round(sum(abs(sc - h)) / sum(n), 6) AS ece FROM g""",
    "ece_by_band": f"""SELECT band, cast(sum(n) AS bigint) AS n, round(sum(gap) / sum(n), 6) AS ece FROM (SELECT CASE WHEN p < 0.05 THEN 'a' WHEN p < 0.15 THEN 'b' WHEN p < 0.4 THEN 'c' ELSE 'd' END AS band, count(*) AS n, abs(sum(p - won)) AS gap FROM market GROUP BY band, {_BIN}) x GROUP BY band""",
    "ece_by_field_size": f"SELECT field, cast(sum(k) AS bigint) AS n, round(sum(gap) / sum(k), 6) AS ece FROM (SELECT n AS field, count(*) AS k, abs(sum(p - won)) AS gap FROM market GROUP BY n, {_BIN}) x GROUP BY field",
    "reliability_wilson": f"""WITH c AS (SELECT {_BIN} AS bin, cast(count(*) AS bigint) AS n, avg(p) AS m, avg(cast(won AS double)) AS r FROM market GROUP BY {_BIN}), h AS (SELECT *, 1.96 * sqrt((r * (1 - r) + 0.9604 / n) / n) AS half FROM c)
SELECT bin, n, round(m, 6) AS mean_score, CASE WHEN n >= 30 THEN round(r, 5) END AS rate, CASE WHEN n >= 30 THEN round((r + 1.9208 / n - half) / (1 + 3.8416 / n), 5) END AS low, CASE WHEN n >= 30 THEN round((r + 1.9208 / n + half) / (1 + 3.8416 / n), 5) END AS high FROM h""",
    "drawdown_by_year": f"WITH b AS (SELECT *, {_PATH.format(r='won * odds - 1')} AS bank FROM {FAV} f) SELECT y, round(max(greatest(peak, 0) - bank), 4) AS drawdown FROM (SELECT y, bank, max(bank) OVER (PARTITION BY y ORDER BY day, contest_id) AS peak FROM b) x GROUP BY y",
    "losing_streak": f"""WITH g AS (SELECT y, won, row_number() OVER (PARTITION BY y ORDER BY day, contest_id) - row_number() OVER (PARTITION BY y, won ORDER BY day, contest_id) AS island FROM {FAV} f)
SELECT y, cast(max(CASE WHEN won = 0 THEN len ELSE 0 END) AS bigint) AS longest FROM (SELECT y, won, count(*) AS len FROM g GROUP BY y, won, island) x GROUP BY y""",
    "bankroll_by_year": f"""WITH r AS (SELECT *, 2e-2 * (won * odds - 1) AS r FROM {FAV} f), a AS (SELECT *, {_PATH.format(r='CASE WHEN r <= -1 THEN 1 ELSE 0 END')} AS ruined FROM r), b AS (SELECT *, {_PATH.format(r='ln(1 + r)')} AS bank FROM a WHERE ruined = 0)
SELECT y, cast(count(*) AS bigint) AS bets, round(min(bank), 5) + 0e0 AS lowest_log, round(max(bank), 5) + 0e0 AS highest_log, round(max(greatest(peak, 0) - bank), 5) AS log_drawdown FROM (SELECT *, max(bank) OVER (PARTITION BY y ORDER BY day, contest_id) AS peak FROM b) x GROUP BY y""",
    "quintile_edges": f"SELECT " + ", ".join(f"round(percentile_cont({k / 5}) WITHIN GROUP (ORDER BY entropy), 9) AS e{k}" for k in range(1, 5)) + f" FROM ({_ENTROPY}) x",
    "band_diagnostic": f"""WITH e AS ({_ENTROPY}), k AS (SELECT percentile_cont(0.33) WITHIN GROUP (ORDER BY entropy) AS a, percentile_cont(0.67) WITHIN GROUP (ORDER BY entropy) AS b FROM e),
s AS (SELECT CASE WHEN entropy <= a THEN 1 WHEN entropy <= b THEN 2 ELSE 3 END AS band, count(*) AS contests, avg(1e0 - fav_won) AS loss, avg(CASE WHEN payout >= 8 THEN 1e0 ELSE 0e0 END) AS high, count(CASE WHEN winners <> 1 THEN 1 END) AS voids FROM e, k GROUP BY 1)
SELECT s.band, cast(s.contests AS bigint) AS contests, round(s.loss, 6) AS favourite_loss, round(s.high, 6) AS high_payout, cast(s.voids AS bigint) AS voids, round(s.loss - t.loss, 6) AS separation FROM s LEFT JOIN s t ON t.band = s.band - 1""",
    "day_cluster_bootstrap": f"WITH {_boot('SELECT day, sum(won * odds) AS s, count(*) AS n FROM market WHERE p * odds >= 0.9 GROUP BY day', REPS, 'day')} SELECT cast((SELECT count(*) FROM u) AS bigint) AS days, cast(count(*) AS bigint) AS reps, round((SELECT sum(s) / sum(n) FROM u), 6) AS recovery, round(percentile_cont(0.025) WITHIN GROUP (ORDER BY v), 6) AS ci_low, round(percentile_cont(0.975) WITHIN GROUP (ORDER BY v), 6) AS ci_high FROM r",
    "bootstrap_blocks": _block_sql(),
    "ece_bootstrap": f"""WITH {_boot(f'SELECT day, {_BIN} AS bin, sum(p - won) AS s, count(*) AS n FROM market GROUP BY day, {_BIN}', 300, 'day', 'bin', 'abs(sum(s * times)) AS gap, sum(n * times)')}, e AS (SELECT rep, sum(gap) / sum(v) AS v FROM r GROUP BY rep)
SELECT round((SELECT sum(g) / sum(n) FROM (SELECT bin, abs(sum(s)) AS g, sum(n) AS n FROM u GROUP BY bin) y), 6) AS ece, cast(count(*) AS bigint) AS reps, round(percentile_cont(0.025) WITHIN GROUP (ORDER BY v), 6) AS ci_low, round(percentile_cont(0.975) WITHIN GROUP (ORDER BY v), 6) AS ci_high FROM e""",
    "holm_by_class": f"""WITH {_boot(f'SELECT class, day, sum(g) AS s, count(*) AS n FROM (SELECT class, day, {_GAIN} AS g FROM market) m GROUP BY class, day', 500, 'day', 'class')},
t AS (SELECT class, avg(CASE WHEN v <= 0 THEN 1e0 ELSE 0e0 END) AS pv FROM r GROUP BY class), k AS (SELECT *, row_number() OVER (ORDER BY pv, class) AS j, count(*) OVER () AS m FROM t)
SELECT class, round(pv, 6) AS p_one_sided, round(least(1.0, (SELECT max(b.pv * (b.m - b.j + 1)) FROM k b WHERE b.j <= k.j)), 6) AS adjusted FROM k""",
}
