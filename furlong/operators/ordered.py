"""Running sums and peaks over a whole ordered table without a window that one task must hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.places import work_dir


def running(df: DataFrame, order: list[str], sums: dict[str, Column], group: list[str] | None = None) -> DataFrame:
    """``df`` with, for each name, the sum of its column over the rows of the group up to and with the row in ``order``,
    which must have no ties. Rows are dealt by ranges of (group, order) and written; each task sums its own part, and the
    parts' totals, a few rows for each task and group, give what lies before."""
    spark, own, group = df.sparkSession, df.columns, group or []
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = work_dir(spark)
    dealt = df.withColumns({f"__{k}": c for k, c in sums.items()}).repartitionByRange(n, *group, *order)
    dealt.withColumn("__part", F.spark_partition_id()).write.parquet(path)
    rows = spark.read.parquet(path)
    part = rows.groupBy("__part", *group).agg(*[F.sum(f"__{k}").alias(f"__{k}_t") for k in sums])
    w = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select("__part", *group, *[F.coalesce(F.sum(f"__{k}_t").over(w), F.lit(0)).alias(f"__{k}_b") for k in sums])
    local = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"__{k}": F.sum(f"__{k}").over(local) for k in sums}).join(F.broadcast(part), ["__part", *group])
    return out.select(*own, *[(F.col(f"__{k}_b") + F.col(f"__{k}")).alias(k) for k in sums], F.col("__part"))


def drawdown(bets: DataFrame, order: list[str], gain: Column, group: list[str]) -> DataFrame:
    """(group, drawdown, lowest, highest): the largest fall of the running sum of ``gain`` from an earlier peak, the opening
    bank of 0 being the first, and the lowest and highest value after a bet."""
    path = running(bets, order, {"bank": gain}, group)
    local = Window.partitionBy("__part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    path = path.withColumn("peak", F.max("bank").over(local))
    part = path.groupBy("__part", *group).agg(F.max("bank").alias("top"))
    w = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = part.select("__part", *group, F.max("top").over(w).alias("before"))
    path = path.join(F.broadcast(before), ["__part", *group])
    fall = F.greatest(F.col("peak"), F.coalesce("before", "peak"), F.lit(0)) - F.col("bank")
    return path.groupBy(*group).agg(F.max(fall).alias("drawdown"), F.min("bank").alias("lowest"), F.max("bank").alias("highest"), F.count("*").alias("bets"))


def longest_run(bets: DataFrame, order: list[str], hit: Column, group: list[str]) -> DataFrame:
    """(group, longest): the largest number of rows without a hit in a row. Rows between two hits share their number of
    hits so far, so islands are groups of a running sum."""
    path = running(bets.withColumn("__hit", hit.cast("long")), order, {"hits": F.col("__hit")}, group)
    island = path.groupBy(*group, "hits").agg(F.count(F.when(F.col("__hit") == 0, 1)).alias("n"))
    return island.groupBy(*group).agg(F.max("n").alias("longest"))


def tiles(df: DataFrame, order: list[str], n: int, out: str) -> DataFrame:
    """``df`` with the number (from 1) of its row's of n tiles in ``order``; sizes differ by one at most, larger ones first."""
    ranked = running(df, order, {"__rank": F.lit(1)})
    total = F.lit(ranked.count())
    small, extra = F.floor(total / n), total % n
    edge = extra * (small + 1)
    r = F.col("__rank") - 1
    tile = F.when(r < edge, F.floor(r / (small + 1))).otherwise(extra + F.floor((r - edge) / F.greatest(small, F.lit(1))))
    return ranked.select(*df.columns, (tile + 1).cast("long").alias(out))


def quantiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Linear quantiles of a numeric column: rows are counted by value, and the two values at each place are looked up."""
    counts = running(df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n")), [value], {"__upto": F.col("__n")})
    counts = counts.persist()
    total = counts.agg(F.max("__upto")).first()[0]
    if not total:
        return [None] * len(shares)
    places = sorted({int(p) for s in shares for p in ((total - 1) * s, min((total - 1) * s + 1, total - 1))})
    found = counts.agg(*[F.min(F.when(F.col("__upto") > p, F.col(value))).alias(str(p)) for p in places]).first()
    counts.unpersist()
    out = []
    for s in shares:
        at = (total - 1) * s
        lo, hi = found[str(int(at))], found[str(int(min(at + 1, total - 1)))]
        out.append(lo + (hi - lo) * (at - int(at)))
    return out
