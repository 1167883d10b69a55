"""Fits over samples of contests: candidate grids and Newton steps, each round one Spark aggregation.

Samples are rows (contest, p, won) of contests with exactly one winner; only candidate losses and k x k sums reach the driver."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .metrics import clipped

#: The search range of every power, and the pivot of the two-piece power.
RANGE, PIVOT = (0.1, 5.0), 0.15


def one_winner(rows: DataFrame, contest: str, won: str) -> DataFrame:
    """Rows of contests with exactly one winner."""
    w = Window.partitionBy(contest)
    return rows.withColumn("__w", F.sum(won).over(w)).filter("__w = 1").drop("__w")


def grid(values: list[tuple[float, ...]], names: list[str]) -> Column:
    """An array of candidate structs, to be exploded next to each row."""
    return F.array(*[F.struct(*[F.lit(float(x)).alias(n) for x, n in zip(v, names, strict=True)]) for v in values])


def candidate_losses(rows: DataFrame, contest: str, won: str, weight: Callable[[], Column], values: list[tuple[float, ...]], names: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, candidate columns, n, nll sum) of the winner's share of ``weight`` (a column over the row and candidate)."""
    rows = rows.withColumn("__c", F.explode(grid(values, names))).select("*", "__c.*").withColumn("__x", weight())
    each = rows.groupBy(*(by or []), contest, *names).agg(F.sum("__x").alias("t"), F.max(F.when(F.col(won) == 1, F.col("__x"))).alias("x"))
    return each.groupBy(*(by or []), *names).agg(F.count("*").alias("n"), F.sum(F.ln("t") - F.ln("x")).alias("nll"))


def spread(lo: float, hi: float, n: int) -> list[float]:
    return [lo + (hi - lo) * k / (n - 1) for k in range(n)]


def fit_power(rows: DataFrame, contest: str, won: str, p: str, *, rounds: int = 4, points: int = 15, least: int = 50, weight: Callable[[str], Column] | None = None) -> dict:
    """{gamma, nll, n, status}: the power whose normalised shares give the winners the least loss, by grids over RANGE that
    narrow to the neighbours of the best. Guards: too few contests, or a best at the range's end, give the identity."""
    lo, hi = RANGE
    rows = rows.persist()
    best = None
    make = weight or (lambda g: F.pow(F.col(p), F.col(g)))
    for _ in range(rounds):
        values = spread(lo, hi, points)
        got = candidate_losses(rows, contest, won, lambda: make("g"), [(v,) for v in values], ["g"]).collect()
        if not got or got[0]["n"] < least:
            rows.unpersist()
            return {"gamma": 1.0, "nll": None, "n": got[0]["n"] if got else 0, "status": "few_samples"}
        best = min(got, key=lambda r: (round(r["nll"] / r["n"], 12), r["g"]))
        step = (hi - lo) / (points - 1)
        lo, hi = max(RANGE[0], best["g"] - step), min(RANGE[1], best["g"] + step)
    rows.unpersist()
    edge = best["g"] - RANGE[0] < 1e-3 or RANGE[1] - best["g"] < 1e-3
    return {"gamma": 1.0 if edge else best["g"], "nll": best["nll"] / best["n"], "n": best["n"], "status": "boundary" if edge else "fitted"}


def two_piece(p: str, lo: str, hi: str) -> Column:
    """A power below the pivot and another above, continuous at it."""
    x = F.col(p)
    return F.when(x < PIVOT, F.pow(x, F.col(lo)) * F.pow(F.lit(PIVOT), 1 - F.col(lo))).otherwise(F.pow(x, F.col(hi)) * F.pow(F.lit(PIVOT), 1 - F.col(hi)))


def fit_two_power(rows: DataFrame, contest: str, won: str, p: str, *, rounds: int = 3, points: int = 9, least: int = 50) -> dict:
    """{lo, hi, nll, n, status} of the two-piece power: a 9 x 9 grid, then narrower ones around the best."""
    spans = [list(RANGE), list(RANGE)]
    rows, best = rows.persist(), None
    for _ in range(rounds):
        values = [(a, b) for a in spread(*spans[0], points) for b in spread(*spans[1], points)]
        got = candidate_losses(rows, contest, won, lambda: two_piece(p, "lo", "hi"), values, ["lo", "hi"]).collect()
        if not got or got[0]["n"] < least:
            rows.unpersist()
            return {"lo": 1.0, "hi": 1.0, "nll": None, "n": got[0]["n"] if got else 0, "status": "few_samples"}
        best = min(got, key=lambda r: (round(r["nll"] / r["n"], 12), r["lo"], r["hi"]))
        for k, name in enumerate(("lo", "hi")):
            step = (spans[k][1] - spans[k][0]) / (points - 1)
            spans[k] = [max(RANGE[0], best[name] - step), min(RANGE[1], best[name] + step)]
    rows.unpersist()
    edge = any(best[n] - RANGE[0] < 1e-3 or RANGE[1] - best[n] < 1e-3 for n in ("lo", "hi"))
    return {"lo": 1.0 if edge else best["lo"], "hi": 1.0 if edge else best["hi"], "nll": best["nll"] / best["n"], "n": best["n"], "status": "boundary" if edge else "fitted"}


def stage_samples(runs: DataFrame, contest: str, order: str, stage: int) -> DataFrame:
    """Samples for the power of one stage: the entries left after the first ``stage`` - 1 finishers, with the next one as
    winner; contests with a dead heat among the first ``stage`` are left out."""
    w = Window.partitionBy(contest)
    clear = F.lit(True)
    for k in range(1, stage + 1):
        clear = clear & (F.sum((F.col(order) == k).cast("int")).over(w) == 1)
    rows = runs.withColumn("__ok", clear).filter("__ok").drop("__ok")
    return rows.filter(F.col(order).isNull() | (F.col(order) >= stage)).withColumn("__next", F.coalesce((F.col(order) == stage).cast("int"), F.lit(0)))


class Fit(NamedTuple):
    """Coefficients, and why the steps ended: fitted (the gradient is gone), not_converged (it is not after the last step),
    separable (the winners' loss goes to 0, or a coefficient beyond all measure), no_samples."""

    theta: np.ndarray
    status: str
    steps: int


#: A coefficient on a feature of unit spread beyond this is no finite optimum.
FAR = 30.0


def flat(theta: np.ndarray, information: np.ndarray, scale: np.ndarray) -> bool:
    """A coefficient has gone far (beyond 5 spreads) and the data no longer tell it from a larger one: the winners are separable."""
    return bool(((np.abs(theta * scale) > 5) & (information <= 1e-6 * scale**2)).any())


def fit_softmax(rows: DataFrame, contest: str, won: str, features: list[str], *, steps: int = 8, ridge: float = 1e-9, tolerance: float = 1e-8) -> Fit:
    """The conditional logit: shares softmax(features . theta) within each contest of one winner. Newton steps from 0; each is
    one aggregation of a k-vector and a k x k matrix. Rows of no contest with a winner give no_samples and zeros."""
    rows, k = rows.persist(), len(features)
    theta, status, done = np.zeros(k), "not_converged", 0
    spread = rows.agg(*[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(features)]).first()
    scale = np.array([spread[f"s{i}"] or 0.0 for i in range(k)])
    w = Window.partitionBy(contest)
    for _ in range(steps):
        u = sum((F.col(f) * float(t) for f, t in zip(features, theta, strict=True)), F.lit(0.0))
        r = rows.withColumn("__u", u).withColumn("__e", F.exp(F.col("__u") - F.max("__u").over(w))).withColumn("__s", F.col("__e") / F.sum("__e").over(w))
        mean = [F.sum(F.col("__s") * F.col(f)).alias(f"m{i}") for i, f in enumerate(features)]
        at_win = [F.sum(F.col(won) * F.col(f)).alias(f"x{i}") for i, f in enumerate(features)]
        second = [F.sum(F.col("__s") * F.col(features[i]) * F.col(features[j])).alias(f"c{i}_{j}") for i in range(k) for j in range(i, k)]
        c = r.groupBy(contest).agg(*mean, *at_win, *second)
        got = c.agg(F.count("*").alias("n"), *[F.sum(F.col(f"x{i}") - F.col(f"m{i}")).alias(f"g{i}") for i in range(k)], *[F.sum(F.col(f"c{i}_{j}") - F.col(f"m{i}") * F.col(f"m{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k)]).first()
        if got["g0"] is None:
            status = "no_samples"
            break
        g = np.array([got[f"g{i}"] for i in range(k)])
        h = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        if np.abs(g).max() <= tolerance * got["n"] or flat(theta, np.diag(h) / got["n"], scale):
            status = "separable" if flat(theta, np.diag(h) / got["n"], scale) else "fitted"
            break
        theta, done = theta + np.linalg.solve(h + ridge * np.eye(k), g), done + 1
        if np.abs(theta * scale).max() > FAR:
            status = "separable"
            break
    rows.unpersist()
    return Fit(theta, status, done)


def softmax_shares(rows: DataFrame, contest: str, features: list[str], theta: np.ndarray, out: str) -> DataFrame:
    w = Window.partitionBy(contest)
    u = sum((F.col(f) * float(t) for f, t in zip(features, theta, strict=True)), F.lit(0.0))
    r = rows.withColumn("__u", u).withColumn("__e", F.exp(F.col("__u") - F.max("__u").over(w)))
    return r.withColumn(out, F.col("__e") / F.sum("__e").over(w)).drop("__u", "__e")


def fit_platt(rows: DataFrame, p: str, label: str, *, steps: int = 8) -> tuple[float, float]:
    """(slope, shift) of the logistic calibration of logit(p), by Newton steps from the identity; a step that makes the loss worse
    is halved until it does not. Scores are clipped away from 0 and 1; steps end where slope and shift cannot be told
    apart (one score only) or labels are all alike."""
    x, y = clipped(F.col(p)), F.col(label).cast("double")
    rows = rows.select(F.ln(x / (1 - x)).alias("z"), y.alias("y")).persist()

    def sums(a: float, b: float):
        u = F.col("z") * a + b
        s = 1 / (1 + F.exp(-u))
        v, d = s * (1 - s), F.col("y") - s
        loss = F.sum(F.greatest(u, F.lit(0.0)) + F.log1p(F.exp(-F.abs(u))) - F.col("y") * u)
        return rows.agg(loss.alias("loss"), F.sum(d * F.col("z")).alias("ga"), F.sum(d).alias("gb"), F.sum(v * F.col("z") * F.col("z")).alias("haa"), F.sum(v * F.col("z")).alias("hab"), F.sum(v).alias("hbb")).first()

    a, b = 1.0, 0.0
    r = sums(a, b)
    for _ in range(steps):
        if not r["hbb"]:
            break
        det = r["haa"] * r["hbb"] - r["hab"] ** 2
        if det <= 1e-12 * r["haa"] * r["hbb"]:
            break
        da, db = (r["hbb"] * r["ga"] - r["hab"] * r["gb"]) / det, (r["haa"] * r["gb"] - r["hab"] * r["ga"]) / det
        for _ in range(40):
            new = sums(a + da, b + db)
            if new["loss"] <= r["loss"] * (1 + 1e-12):
                break
            da, db = da / 2, db / 2
        else:
            break
        a, b, r = a + da, b + db, new
    rows.unpersist()
    return a, b


def fit_isotonic(rows: DataFrame, p: str, label: str, digits: int = 2) -> DataFrame:
    """(x, n, fitted): the non-decreasing calibration of scores rounded to ``digits``, by pooling adjacent violators over the
    rounded scores, of which there are 10**digits + 1 at most."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    s = rows.groupBy(F.round(p, digits).alias("x")).agg(F.count("*").cast("double").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
    s = VectorAssembler(inputCols=["x"], outputCol="__f").transform(s)
    model = IsotonicRegression(featuresCol="__f", labelCol="rate", weightCol="n", predictionCol="fitted").fit(s)
    return model.transform(s).select("x", F.col("n").cast("long").alias("n"), "fitted")
