"""Out-of-fold tables: predictions of several arms over expanding folds in one long table, and the reports that read it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import bootstrap as bs
from .fits import candidate_losses, spread
from .likelihood import Candidate, fit_candidates, stages
from .metrics import ks_distance


def oof_table(rows: DataFrame, contest: str, entity: str, day: str, order: str, fold: str, features: list[str], arms: dict[str, list[str]], ridge: float = 0.0) -> DataFrame:
    """(arm, fold, contest, entity, day, p, won): what each arm, a subset of ``features``, fitted on all earlier folds gives the
    entries of each fold but the first. All arms and folds are fitted in the same aggregations. Contests of other than one
    winner teach nothing but are predicted; entries with a null feature are left out."""
    spark = rows.sparkSession
    if unknown := {f for own in arms.values() for f in own} - set(features):
        raise ValueError(f"no such features: {sorted(unknown)}")
    folds = sorted(r[0] for r in rows.select(fold).distinct().collect() if r[0] is not None)[1:]
    candidates = [(a, Candidate(int(f), ridge, tuple(features.index(x) for x in own))) for a, own in arms.items() for f in folds]
    data = stages(rows, contest, order, features, fold, depth=1).persist()
    fits = fit_candidates(data, len(features), [c for _, c in candidates]) if candidates else []
    data.unpersist()
    table = [(a, c.before, *map(float, f.theta)) for (a, c), f in zip(candidates, fits, strict=True) if f.status != "no_samples"]
    theta = spark.createDataFrame(table, "arm string, fold int, " + ", ".join(f"t{i} double" for i in range(len(features))))
    good = F.lit(True)
    for f in features:
        good = good & F.col(f).isNotNull()
    u = sum((F.col(f) * F.col(f"t{i}") for i, f in enumerate(features)), F.lit(0.0))
    r = rows.filter(good).withColumn("__f", F.col(fold).cast("int")).join(F.broadcast(theta.withColumnRenamed("fold", "__f")), "__f").withColumn("__u", u)
    w = Window.partitionBy("arm", contest)
    r = r.withColumn("__e", F.exp(F.col("__u") - F.max("__u").over(w)))
    won = F.coalesce((F.col(order) == 1).cast("int"), F.lit(0))
    return r.select("arm", F.col("__f").alias("fold"), F.col(contest).alias("contest"), F.col(entity).alias("entity"), F.col(day).alias("day"), (F.col("__e") / F.sum("__e").over(w)).alias("p"), won.alias("won"))


def winner_losses(oof: DataFrame) -> DataFrame:
    """(arm, fold, contest, day, loss) of contests with one winner."""
    each = oof.groupBy("arm", "fold", "contest", "day").agg(F.sum("won").alias("w"), F.max(F.when(F.col("won") == 1, F.col("p"))).alias("p"))
    return each.filter("w = 1").select("arm", "fold", "contest", "day", (-F.ln(F.greatest("p", F.lit(1e-15)))).alias("loss"))


def arm_deltas(oof: DataFrame, base: str, reps: int = 2000) -> DataFrame:
    """(arm, contests, loss, base_loss, delta, ci_low, ci_high, worse_folds, folds, helps): each other arm against ``base`` on the
    contests that both predict: the mean loss of the arm less that of the base, its day-cluster interval, and in how many
    folds it is above 0. For arms that leave a group out, a delta above 0 in most folds and in the interval says that the group helps."""
    losses = winner_losses(oof)
    b = losses.filter(F.col("arm") == base).select("contest", F.col("loss").alias("base_loss"))
    d = losses.filter(F.col("arm") != base).join(b, "contest")
    sums = d.groupBy("arm", "fold", "day").agg(F.sum("loss").alias("l"), F.sum("base_loss").alias("b"), F.count("*").alias("n")).persist()
    days = sums.groupBy("arm", "day").agg(F.sum(F.col("l") - F.col("b")).alias("s"), F.sum("n").alias("n"))
    ci = bs.interval(bs.replicates(days, "day", {"v": F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))}, reps, ["arm"]), "v", by=["arm"])
    folds = sums.groupBy("arm", "fold").agg((F.sum("l") > F.sum("b")).alias("worse")).groupBy("arm").agg(F.count_if("worse").alias("worse_folds"), F.count("*").alias("folds"))
    total = sums.groupBy("arm").agg(F.sum("n").alias("contests"), (F.sum("l") / F.sum("n")).alias("loss"), (F.sum("b") / F.sum("n")).alias("base_loss"))
    out = total.join(folds, "arm").join(ci.select("arm", "ci_low", "ci_high"), "arm").withColumn("delta", F.col("loss") - F.col("base_loss"))
    return out.select("arm", "contests", "loss", "base_loss", "delta", "ci_low", "ci_high", "worse_folds", "folds", ((F.col("ci_low") > 0) & (2 * F.col("worse_folds") > F.col("folds"))).alias("helps"))


def earlier_powers(oof: DataFrame, points: int = 41, lo: float = 0.5, hi: float = 1.5) -> DataFrame:
    """(fold, gamma): the power that suits the winners of all earlier folds of one arm best, on a grid."""
    w = Window.partitionBy("contest")
    rows = oof.withColumn("__w", F.sum("won").over(w)).filter("__w = 1")
    got = candidate_losses(rows, "contest", "won", lambda: F.pow("p", F.col("g")), [(round(g, 9),) for g in spread(lo, hi, points)], ["g"], ["fold"])
    before = Window.partitionBy("g").orderBy("fold").rowsBetween(Window.unboundedPreceding, -1)  # a row for each fold
    got = got.withColumns({"b": F.sum("nll").over(before), "n": F.sum("n").over(before)}).filter("n > 0")
    return got.groupBy("fold").agg(F.min_by("g", F.struct(F.round(F.col("b") / F.col("n"), 12), "g")).alias("gamma"))


def ece(rows: DataFrame, p: str, won: str, bins: int = 10) -> DataFrame:
    """(ece): the mean gap of equal-width bins, weighted by their rows."""
    b = rows.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.abs(F.sum(F.col(p) - F.col(won))).alias("gap"))
    return b.agg((F.sum("gap") / F.sum("n")).alias("ece"))


def transfer_check(oof: DataFrame, reference: DataFrame, *, margin: float = 0.0005, most_ks: float = 0.1, least_days: int = 30) -> DataFrame:
    """(folds, days, ece_raw, ece_calibrated, delta, ks, verdict) of one arm's out-of-fold table: powers fitted on earlier folds are
    applied to the next one; ks is the distance of the winners' raw scores from those of ``reference`` (contest, entity, p), on which
    the powers are to be used. no_decision without a held-out fold or below ``least_days`` days; open where the scores
    differ beyond ``most_ks`` or the gap moves by ``margin`` at most; adopt and reject by the gap otherwise."""
    powers = earlier_powers(oof)
    w = Window.partitionBy("contest")
    held = oof.join(F.broadcast(powers), "fold").withColumn("__x", F.pow("p", F.col("gamma"))).withColumn("q", F.col("__x") / F.sum("__x").over(w)).persist()
    facts = held.agg(F.countDistinct("fold").alias("folds"), F.countDistinct("day").alias("days"))
    winners = held.filter("won = 1")
    theirs = winners.select("contest", "entity").join(reference.select("contest", "entity", F.col("p").alias("r")), ["contest", "entity"])
    both = winners.select(F.col("p").alias("x"), F.lit(1).alias("y")).unionByName(theirs.select(F.col("r").alias("x"), F.lit(0).alias("y")))
    out = facts.crossJoin(ece(held, "p", "won").withColumnRenamed("ece", "ece_raw")).crossJoin(ece(held, "q", "won").withColumnRenamed("ece", "ece_calibrated")).crossJoin(ks_distance(both, "x", "y"))
    delta = F.col("ece_calibrated") - F.col("ece_raw")
    verdict = F.when((F.col("folds") == 0) | (F.col("days") < least_days), "no_decision").when((F.col("ks") > most_ks) | (F.abs(delta) <= margin), "open").when(delta < 0, "adopt").otherwise("reject")
    return out.select("folds", "days", "ece_raw", "ece_calibrated", delta.alias("delta"), "ks", verdict.alias("verdict"))
