"""Prospective cohorts: fields frozen at capture against what happened, with a ledger of what cannot be scored."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from . import joint
from .metrics import clipped

#: Why a frozen contest is not scored; the first that holds counts.
REASONS = ("invalid_field", "field_changed", "dead_heat", "fewer_than_three", "unknown_finisher")


def outcomes(frozen: DataFrame, runs: DataFrame, contest: str, entity: str, rank: str, order: str) -> DataFrame:
    """(contest, n, ra, rb, rc, reason) for each contest of ``frozen``: the frozen ranks of those that came in first, second and third,
    or the first reason against it. A field is invalid below four entries, or where an entity or a rank is null or stands twice;
    it has changed where the entities of ``runs`` (those that started) are others."""
    ids = lambda: F.array_sort(F.collect_set(entity))
    f = frozen.groupBy(contest).agg(
        F.count("*").alias("n"), F.countDistinct(entity).alias("__e"), F.countDistinct(rank).alias("__r"), ids().alias("__frozen"),
        F.collect_set(F.struct(F.col(entity).alias("e"), F.col(rank).alias("r"))).alias("__ranks"))
    at = lambda k: F.collect_list(F.when(F.col(order) == k, F.col(entity)))
    r = runs.groupBy(contest).agg(ids().alias("__ran"), *[at(k).alias(f"__{k}") for k in (1, 2, 3)])
    j = f.join(r, contest, "left")
    rank_of = lambda k: F.get(F.filter("__ranks", lambda x: x["e"] == F.get(F.col(f"__{k}"), F.lit(0))), F.lit(0))["r"]
    j = j.withColumns({"ra": rank_of(1), "rb": rank_of(2), "rc": rank_of(3)})
    sizes = [F.coalesce(F.array_size(f"__{k}"), F.lit(0)) for k in (1, 2, 3)]
    reason = (
        F.when((F.col("n") < 4) | (F.col("__e") < F.col("n")) | (F.col("__r") < F.col("n")), REASONS[0])
        .when(F.col("__ran").isNull() | (F.col("__ran") != F.col("__frozen")), REASONS[1])
        .when(F.greatest(*sizes) > 1, REASONS[2]).when(F.least(*sizes) == 0, REASONS[3])
        .when(F.col("ra").isNull() | F.col("rb").isNull() | F.col("rc").isNull(), REASONS[4])
    )
    scored = reason.isNull()
    return j.withColumn("reason", reason).select(contest, "n", *[F.when(scored, F.col(c)).alias(c) for c in ("ra", "rb", "rc")], "reason")


def event_masses(frozen: DataFrame, events: dict[str, str], contest: str, entity: str, rank: str, share: str) -> DataFrame:
    """(contest, one column for each event): the probability of each event, an SQL predicate over the ranks ra, rb and rc of the first
    three, under the sequential model of the frozen shares."""
    tri = joint.trifecta(frozen, contest, entity, share)
    ranks = frozen.groupBy(contest).agg(F.map_from_entries(F.collect_list(F.struct(entity, rank))).alias("__m"))
    tri = tri.withColumnRenamed("contest_id", contest).join(ranks, contest)
    tri = tri.withColumns({r: F.col("__m")[F.col(w)] for r, w in (("ra", "first"), ("rb", "second"), ("rc", "third"))})
    return tri.groupBy(contest).agg(*[F.sum(F.when(F.expr(e), F.col("prob")).otherwise(0.0)).alias(n) for n, e in events.items()])


def report(frozen: DataFrame, runs: DataFrame, events: dict[str, str], by: str, contest: str = "contest_id", entity: str = "entity_id", rank: str = "rank", share: str = "q", order: str = "finish_order") -> DataFrame:
    """For each value of ``by`` (a column of ``frozen``, one value a contest) and event: contests captured, scored and refused for each reason,
    the mean mass, the observed rate, and Brier and log score of the scored ones (null where none is)."""
    o = outcomes(frozen, runs, contest, entity, rank, order).join(frozen.groupBy(contest).agg(F.min(by).alias("by")), contest)
    good = frozen.join(o.filter("reason is null").select(contest), contest, "left_semi")
    o = o.join(event_masses(good, events, contest, entity, rank, share), contest, "left")
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("event"), F.col(n).alias("mass"), F.when(F.col("reason").isNull(), F.expr(e).cast("int")).alias("y")) for n, e in events.items()]))
    rows = o.select("by", "reason", each.alias("__x")).select("by", "reason", "__x.*")
    m, y = F.col("mass"), F.col("y")
    log = -(y * F.ln(clipped(m)) + (1 - y) * F.ln(1 - clipped(m)))
    return rows.groupBy(F.col("by").alias(by), "event").agg(
        F.count("*").alias("captured"), F.count("y").alias("scored"), *[F.count_if(F.col("reason") == r).alias(r) for r in REASONS],
        F.avg("mass").alias("expected"), F.avg("y").alias("observed"), F.avg((m - y) * (m - y)).alias("brier"), F.avg(log).alias("log_score"))


def ranked(field: DataFrame, contest: str, odds: str) -> DataFrame:
    """``field`` with rank (by odds; equal ones share it) and q, its share of the inverse odds."""
    w = Window.partitionBy(contest)
    return field.withColumns({"rank": F.rank().over(w.orderBy(odds)), "q": 1 / F.col(odds) / F.sum(1 / F.col(odds)).over(w)})
