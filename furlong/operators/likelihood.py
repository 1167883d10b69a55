"""Sequential likelihood of the first finishers, fitted for many candidates at once.

A contest's first place goes to an entry with probability softmax(features . theta) among all, its second among those left,
and so on. A candidate is a set of folds to learn from and a ridge; all candidates share every pass over the rows."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from .fits import FAR, Fit, flat


class Candidate(NamedTuple):
    """Learns from rows of folds below ``before`` (all if None), with ``ridge`` on the squared coefficients a stage, and only the
    coefficients of the features ``use`` (all if None); the others stay 0."""

    before: int | None = None
    ridge: float = 0.0
    use: tuple[int, ...] | None = None


def stages(rows: DataFrame, contest: str, order: str, features: list[str], fold: str | None = None, depth: int = 3) -> DataFrame:
    """(contest, fold, stage, won, f0, f1, ...): each entry in each of the first ``depth`` stages that it takes part in.

    A stage counts if one entry holds its rank and each rank before, and if two entries at least are left; entries
    without a finish order are left in all. Features are centred on the contest's mean, which changes no share and keeps
    exponents small; rows with a null feature or contest are left out."""
    w = Window.partitionBy(contest)
    ok = F.col(contest).isNotNull()
    for f in features:
        ok = ok & F.col(f).isNotNull() & ~F.isnan(F.col(f).cast("double"))
    df = rows.filter(ok).withColumn("__o", F.col(order).cast("int"))
    held = [F.sum((F.coalesce("__o", F.lit(0)) == k).cast("int")).over(w) for k in range(1, depth + 1)]
    deep, clear = F.lit(0), F.lit(True)
    for k, h in enumerate(held, 1):
        clear = clear & (h == 1) & (F.count("*").over(w) > k)
        deep = deep + clear.cast("int")
    centred = [(F.col(f).cast("double") - F.avg(F.col(f).cast("double")).over(w)).alias(f"f{i}") for i, f in enumerate(features)]
    df = df.select(F.col(contest).alias("contest"), (F.col(fold) if fold else F.lit(0)).cast("int").alias("fold"), "__o", deep.alias("__d"), *centred)
    upto = F.least(F.coalesce("__o", "__d"), F.col("__d"))
    df = df.filter(upto >= 1).withColumn("stage", F.explode(F.sequence(F.lit(1), upto)))
    return df.withColumn("won", F.coalesce((F.col("__o") == F.col("stage")).cast("int"), F.lit(0))).drop("__o", "__d")


def utility(k: int, theta: Column) -> Column:
    return sum((F.col(f"f{i}") * theta[f"t{i}"] for i in range(k)), F.lit(0.0))


def with_candidates(rows: DataFrame, thetas: dict[int, np.ndarray], keep: dict[int, Column]) -> DataFrame:
    """``rows`` next to each candidate that ``keep`` (a condition on the row) lets see them."""
    every = [F.when(keep[c], F.struct(F.lit(c).alias("id"), *[F.lit(float(x)).alias(f"t{i}") for i, x in enumerate(t)])) for c, t in thetas.items()]
    return rows.withColumn("c", F.explode(F.filter(F.array(*every), lambda x: x.isNotNull())))


def newton_sums(rows: DataFrame, k: int, thetas: dict[int, np.ndarray], keep: dict[int, Column]) -> dict[int, tuple[int, float, np.ndarray, np.ndarray]]:
    """(stages, log likelihood, gradient, Hessian) of each candidate at its coefficients: one aggregation for all."""
    r = with_candidates(rows, thetas, keep).withColumn("u", utility(k, F.col("c"))).withColumn("e", F.exp("u"))
    pair = [(i, j) for i in range(k) for j in range(i, k)]
    each = r.groupBy("c.id", "contest", "stage").agg(
        F.sum("e").alias("t"), F.sum(F.col("won") * F.col("u")).alias("u"), *[F.sum(F.col("e") * F.col(f"f{i}")).alias(f"m{i}") for i in range(k)],
        *[F.sum(F.col("won") * F.col(f"f{i}")).alias(f"x{i}") for i in range(k)], *[F.sum(F.col("e") * F.col(f"f{i}") * F.col(f"f{j}")).alias(f"c{i}_{j}") for i, j in pair],
    )
    mean = [F.col(f"m{i}") / F.col("t") for i in range(k)]
    total = each.groupBy("id").agg(
        F.count("*").alias("n"), F.sum(F.col("u") - F.ln("t")).alias("l"), *[F.sum(F.col(f"x{i}") - mean[i]).alias(f"g{i}") for i in range(k)],
        *[F.sum(F.col(f"c{i}_{j}") / F.col("t") - mean[i] * mean[j]).alias(f"h{i}_{j}") for i, j in pair],
    )
    out = {}
    for s in total.collect():  # a row for each candidate
        h = np.array([[s[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
        out[s["id"]] = s["n"], s["l"], np.array([s[f"g{i}"] for i in range(k)]), h
    return out


def sees(candidate: Candidate) -> Column:
    return F.lit(True) if candidate.before is None else F.col("fold") < candidate.before


def fit_candidates(rows: DataFrame, k: int, candidates: list[Candidate], *, steps: int = 20, tolerance: float = 1e-9) -> list[Fit]:
    """A fit of each candidate on ``stages`` rows: Newton steps from 0, all candidates in one aggregation a step. A candidate
    leaves when the gradient of its mean loss is gone (fitted), when a coefficient moves shares beyond all measure
    (separable), or when it sees no stage (no_samples); the rest are not_converged."""
    fits = {c: Fit(np.zeros(k), "not_converged", 0) for c in range(len(candidates))}
    live = dict.fromkeys(fits)
    spread = rows.agg(*[F.stddev_pop(f"f{i}").alias(f"s{i}") for i in range(k)]).first()
    scale = np.array([spread[f"s{i}"] or 0.0 for i in range(k)])
    for _ in range(steps + 1):
        if not live:
            break
        got = newton_sums(rows, k, {c: fits[c].theta for c in live}, {c: sees(candidates[c]) for c in live})
        for c in list(live):
            theta, _, done = fits[c]
            if c not in got:
                fits[c], _ = Fit(theta, "no_samples", done), live.pop(c)
                continue
            n, _, g, h = got[c]
            gone = candidates[c].ridge == 0 and flat(theta, np.diag(h) / n, scale)
            own = list(range(k)) if candidates[c].use is None else list(candidates[c].use)
            g, h = (g / n - candidates[c].ridge * theta)[own], (h / n + (candidates[c].ridge + 1e-12) * np.eye(k))[np.ix_(own, own)]
            if np.abs(g).max(initial=0) <= tolerance or gone:
                fits[c], _ = Fit(theta, "separable" if gone else "fitted", done), live.pop(c)
            elif done < steps:
                theta = theta.copy()
                theta[own] += np.linalg.solve(h, g)
                far = not np.isfinite(theta).all() or np.abs(theta * scale).max() > FAR
                fits[c] = Fit(fits[c].theta if far else theta, "separable" if far else "not_converged", done + 1)
                if far:
                    live.pop(c)
    return list(fits.values())


def losses_by_fold(rows: DataFrame, k: int, fits: dict[int, np.ndarray], on: dict[int, Column]) -> DataFrame:
    """(id, fold, n, nll): the loss of each fit on the stages that ``on`` gives it, all in one aggregation."""
    r = with_candidates(rows, fits, on).withColumn("u", utility(k, F.col("c")))
    each = r.groupBy("c.id", "fold", "contest", "stage").agg((F.ln(F.sum(F.exp("u"))) - F.sum(F.col("won") * F.col("u"))).alias("l"))
    return each.groupBy("id", "fold").agg(F.count("*").alias("n"), F.sum("l").alias("nll"))


class Search(NamedTuple):
    """The chosen ridge, and a row (ridge, fold, contests or stages, mean loss, status, theta) for each candidate."""

    ridge: float | None
    rows: list[tuple[float, int, int, float, str, np.ndarray]]


def search_ridge(rows: DataFrame, k: int, ridges: list[float], folds: list[int], **how) -> Search:
    """Expanding validation of ``stages`` rows: for each ridge and each of ``folds``, fit on all earlier folds and score the
    fold. The ridge of the least mean loss over folds is chosen, the first of equals; candidates that see nothing, or whose
    fold is empty, count in no mean."""
    rows = rows.persist()
    candidates = [Candidate(f, r) for r in ridges for f in folds]
    fits = fit_candidates(rows, k, candidates, **how)
    usable = {i: f for i, f in enumerate(fits) if f.status != "no_samples"}
    got = losses_by_fold(rows, k, {i: f.theta for i, f in usable.items()}, {i: F.col("fold") == candidates[i].before for i in usable}).collect() if usable else []
    rows.unpersist()
    out = [(candidates[r["id"]].ridge, r["fold"], r["n"], r["nll"] / r["n"], fits[r["id"]].status, fits[r["id"]].theta) for r in got]
    mean = {r: np.mean(own) for r in ridges if (own := [x[3] for x in out if x[0] == r])}
    return Search(min(mean, key=lambda r: (round(mean[r], 12), ridges.index(r))) if mean else None, sorted(out, key=lambda x: (ridges.index(x[0]), x[1])))
