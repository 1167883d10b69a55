"""Probes of cells against given win probabilities, and gates on paired arms."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import bootstrap as bs


def cell_shares(rows: DataFrame, contest: str, p: str, won: str, probe: str, cell: str, keep: list[str]) -> DataFrame:
    """(keep, probe, contest, cell, m, x): the probability and the wins in each cell of each contest, sparsely. Rows are
    (contest, probe, cell) of contests with one winner; p is scaled to sum to 1 in each contest and probe. Rows without a
    cell take part as the rest of the field; cells that hold a whole field say nothing and are left out."""
    w = Window.partitionBy(contest, probe)
    r = rows.withColumn("__p", F.col(p) / F.sum(p).over(w)).withColumn("__n", F.count("*").over(w)).withColumn("__w", F.sum(won).over(w)).filter("__w = 1")
    c = r.groupBy(*keep, F.col(probe).alias("probe"), F.col(contest).alias("contest"), F.col(cell).alias("cell")).agg(F.sum("__p").alias("m"), F.sum(won).alias("x"), F.count("*").alias("k"), F.max("__n").alias("n"))
    return c.filter("cell is not null and k < n").drop("k", "n")


def score_sums(shares: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """(by, probe, cell, contests, score) and (by, probe, cell, other, info): the gradient of the log likelihood of a tilt of
    each cell at 0, and the blocks of its information, from the pairs of cells that meet in a contest."""
    s = shares.groupBy(*by, "probe", "cell").agg(F.count("*").alias("contests"), F.sum(F.col("x") - F.col("m")).alias("score"))
    a, b = shares.select(*by, "probe", "contest", "cell", "m"), shares.select("probe", "contest", F.col("cell").alias("other"), F.col("m").alias("om"))
    own = F.when(F.col("cell") == F.col("other"), F.col("m")).otherwise(0.0)
    h = a.join(b, ["probe", "contest"]).groupBy(*by, "probe", "cell", "other").agg(F.sum(own - F.col("m") * F.col("om")).alias("info"))
    return s, h


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal distribution, by a rational approximation (absolute error below 1.5e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * x)
    return t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)


def cell_tests(shares: DataFrame, least: int = 30) -> DataFrame:
    """(probe, cell, contests, score, z, p_value, adjusted): the score test of each cell alone, adjusted by Holm over all cells
    that at least ``least`` contests hold; the others have no test. Cells are a bounded list of named hypotheses."""
    s, h = score_sums(shares, [])
    s = s.join(h.filter("cell = other").select("probe", "cell", "info"), ["probe", "cell"]).withColumn("z", F.when((F.col("contests") >= least) & (F.col("info") > 1e-12), F.col("score") / F.sqrt("info")))
    s = s.withColumn("p_value", normal_tail(F.col("z"))).withColumn("tie", F.concat_ws(":", "probe", "cell"))
    tested = bs.holm(s.filter("p_value is not null"), "p_value", "tie")
    return tested.unionByName(s.filter("p_value is null"), allowMissingColumns=True).select("probe", "cell", "contests", "score", "z", "p_value", "adjusted")


def fold_tilts(shares: DataFrame, fold: str, ridge: float = 1e-6) -> list[tuple[int, str, str, float]]:
    """(fold, probe, cell, tilt) for each fold but the first: one Newton step from 0 on all earlier folds, the whole block of a
    probe at once. What reaches the driver is a k x k block for each fold, k the number of cells."""
    s, h = score_sums(shares, [fold])
    scores, infos = s.collect(), h.collect()
    folds = sorted({r[fold] for r in scores if r[fold] is not None})
    out = []
    for probe in sorted({r["probe"] for r in scores if r["probe"] is not None}):
        cells = sorted({r["cell"] for r in scores if r["probe"] == probe})
        at = {c: i for i, c in enumerate(cells)}
        g, m, n = np.zeros(len(cells)), np.zeros((len(cells), len(cells))), 0
        for f in folds:
            if n:
                out += [(f, probe, c, float(x)) for c, x in zip(cells, np.linalg.solve(m / n + ridge * np.eye(len(cells)), g / n), strict=True)]
            for r in scores:
                if r[fold] == f and r["probe"] == probe:
                    g[at[r["cell"]]] += r["score"]
                    n = max(n, 1) + r["contests"]
            for r in infos:
                if r[fold] == f and r["probe"] == probe:
                    m[at[r["cell"]], at[r["other"]]] += r["info"]
    return out


def tilt_losses(rows: DataFrame, contest: str, day: str, fold: str, p: str, won: str, probe: str, cell: str, tilts: DataFrame) -> DataFrame:
    """(probe, fold, day, contests, delta): the loss of the tilted probabilities less that of the given ones, of each fold's contests under
    the tilts (fold, probe, cell, tilt) of earlier folds, summed by day. Folds without tilts are left out."""
    w = Window.partitionBy(contest, probe)
    r = rows.withColumn("__p", F.col(p) / F.sum(p).over(w)).withColumn("__w", F.sum(won).over(w)).filter("__w = 1")
    r = r.select(F.col(contest).alias("contest"), F.col(day).alias("day"), F.col(fold).alias("fold"), F.col(probe).alias("probe"), F.col(cell).alias("cell"), "__p", F.col(won).alias("won"))
    r = r.join(F.broadcast(tilts.select("fold", "probe").distinct()), ["fold", "probe"]).join(F.broadcast(tilts), ["fold", "probe", "cell"], "left")
    z = F.coalesce("tilt", F.lit(0.0))
    each = r.groupBy("probe", "fold", "day", "contest").agg((F.ln(F.sum(F.col("__p") * F.exp(z))) - F.sum(F.col("won") * z)).alias("d"))
    return each.groupBy("probe", "fold", "day").agg(F.count("*").alias("contests"), F.sum("d").alias("delta"))


def run_probe(rows: DataFrame, contest: str, day: str, fold: str, p: str, won: str, probe: str, cell: str, reps: int = 2000) -> DataFrame:
    """(probe, contests, days, delta, ci_low, ci_high, passes): the prequential mean change of the winner's loss by each probe's
    tilts, with its day-cluster interval; a probe passes the screen where the interval lies below 0. A null interval
    (fewer than 2 days) does not pass."""
    spark = rows.sparkSession
    shares = cell_shares(rows, contest, p, won, probe, cell, [fold]).persist()
    tilts = spark.createDataFrame(fold_tilts(shares, fold), "fold int, probe string, cell string, tilt double")
    shares.unpersist()
    sums = tilt_losses(rows, contest, day, fold, p, won, probe, cell, tilts).groupBy("probe", "day").agg(F.sum("contests").alias("n"), F.sum("delta").alias("s")).persist()
    ci = bs.interval(bs.replicates(sums, "day", {"v": F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))}, reps, ["probe"]), "v", by=["probe"])
    out = sums.groupBy("probe").agg(F.sum("n").alias("contests"), F.count("*").alias("days"), (F.sum("s") / F.sum("n")).alias("delta")).join(ci, "probe", "left")
    enough = F.col("days") >= 2
    return out.select("probe", "contests", "days", "delta", *[F.when(enough, F.col(c)).alias(c) for c in ("ci_low", "ci_high")], (enough & (F.col("delta") <= 0) & (F.col("ci_high") <= 0)).alias("passes"))


def paired_gate(bets: DataFrame, base: str, cand: str, *, reps: int = 2000, min_bets: int = 30, min_days: int = 2, by: list[str] | None = None) -> DataFrame:
    """(by, bets and recovery of both arms, days, delta, ci_low, ci_high, reps, verdict) of ``bets`` (arm, day, stake, payout, by).

    Days are drawn once for both arms; each replicate is the difference of the two ratios payout / stake. Replicates in
    which an arm stakes nothing are dropped. Adopted where the interval lies above 0, rejected where it lies below, open
    otherwise; no_decision below ``min_bets`` bets of an arm or ``min_days`` days, or without replicates."""
    by = by or []
    arm = lambda a, c: F.sum(F.when(F.col("arm") == a, F.col(c)).otherwise(0.0))
    used = bets.filter(F.col("arm").isin(base, cand) & F.col("stake").isNotNull() & F.col("payout").isNotNull() & F.col("day").isNotNull())
    sums = used.groupBy(*by, "day").agg(
        arm(base, "stake").alias("bs"), arm(base, "payout").alias("bp"), arm(cand, "stake").alias("cs"), arm(cand, "payout").alias("cp"),
        F.count_if(F.col("arm") == base).alias("bn"), F.count_if(F.col("arm") == cand).alias("cn"),
    ).persist()
    drawn = lambda c: F.sum(F.col(c) * F.col("times"))
    ratio = lambda p, s: F.when(s > 0, p / s)
    r = bs.replicates(sums, "day", {"v": ratio(drawn("cp"), drawn("cs")) - ratio(drawn("bp"), drawn("bs"))}, reps, by)
    ci = bs.interval(r, "v", by=by)
    point = sums.groupBy(*by).agg(F.count("*").alias("days"), F.sum("bn").alias("base_bets"), F.sum("cn").alias("cand_bets"), ratio(F.sum("bp"), F.sum("bs")).alias("base_recovery"), ratio(F.sum("cp"), F.sum("cs")).alias("cand_recovery"))
    out = point.join(ci, by, "left") if by else point.crossJoin(F.broadcast(ci))
    enough = (F.least("base_bets", "cand_bets") >= min_bets) & (F.col("days") >= min_days) & (F.col("reps") >= 2)
    verdict = F.when(~enough, "no_decision").when(F.col("ci_low") > 0, "adopt").when(F.col("ci_high") < 0, "reject").otherwise("open")
    return out.select(*by, "days", "base_bets", "cand_bets", "base_recovery", "cand_recovery", (F.col("cand_recovery") - F.col("base_recovery")).alias("delta"), "ci_low", "ci_high", "reps", F.coalesce("p_one_sided", F.lit(None).cast("double")).alias("p_one_sided"), verdict.alias("verdict"))


def tail_guard(rows: DataFrame, base: str, cand: str, masks: dict[str, Column], tolerance: float) -> DataFrame:
    """(mask, n, base_calibration, cand_calibration, passes) of ``rows`` (arm, p, won, ...): within each mask, a condition that
    looks the same to both arms, the candidate's mean p less its rate of wins exceeds the base's by ``tolerance`` at most. A mask
    that neither arm has rows in is left out; one that a single arm lacks does not pass."""
    kinds = F.array(*[F.when(m, F.lit(name)) for name, m in masks.items()])
    long = rows.filter(F.col("arm").isin(base, cand) & F.col("p").isNotNull() & F.col("won").isNotNull()).withColumn("mask", F.explode(F.array_compact(kinds)))
    each = lambda a: F.avg(F.when(F.col("arm") == a, F.col("p") - F.col("won")))
    out = long.groupBy("mask").agg(F.count_if(F.col("arm") == base).alias("n"), each(base).alias("base_calibration"), each(cand).alias("cand_calibration"))
    return out.withColumn("passes", F.coalesce(F.col("cand_calibration") <= F.col("base_calibration") + tolerance, F.lit(False)))


def type_gate(diffs: DataFrame, least: dict[str, int], *, alpha: float = 0.05, reps: int = 2000) -> DataFrame:
    """(bet_type, bets, days, delta, ci_low, ci_high, p_one_sided, adjusted, verdict) of ``diffs`` (bet_type, day, diff): the mean
    edge over a baseline by type, with day-cluster intervals and one-sided p-values adjusted by Holm over the types that can be
    decided. Adopted where the adjusted p is below ``alpha``, the mean and the interval's low end above 0; rejected otherwise;
    no_decision for types without a number in ``least``, below it, or with fewer than 2 days."""
    sums = diffs.filter("diff is not null and day is not null").groupBy("bet_type", "day").agg(F.sum("diff").alias("s"), F.count("*").alias("n")).persist()
    r = bs.replicates(sums, "day", {"v": F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))}, reps, ["bet_type"])
    need = F.coalesce(*[F.when(F.col("bet_type") == t, F.lit(n)) for t, n in least.items()], F.lit(2**62))
    point = sums.groupBy("bet_type").agg(F.sum("n").alias("bets"), F.count("*").alias("days"), (F.sum("s") / F.sum("n")).alias("delta"))
    point = point.withColumn("can", (F.col("bets") >= need) & (F.col("days") >= 2)).join(bs.interval(r, "v", by=["bet_type"]), "bet_type", "left")
    decided = bs.holm(point.filter("can"), "p_one_sided", "bet_type")
    adopt = (F.col("adjusted") < alpha) & (F.col("delta") > 0) & (F.col("ci_low") > 0)
    out = decided.withColumn("verdict", F.when(adopt, "adopt").otherwise("reject"))
    rest = point.filter(~F.col("can")).withColumns({c: F.lit(None).cast("double") for c in ("ci_low", "ci_high", "p_one_sided", "adjusted")}).withColumn("verdict", F.lit("no_decision"))
    return out.unionByName(rest).select("bet_type", "bets", "days", "delta", "ci_low", "ci_high", "p_one_sided", "adjusted", "verdict")
