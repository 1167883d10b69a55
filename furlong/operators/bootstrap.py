"""Cluster bootstrap from sufficient statistics: sums by unit (a day, or a block of days), joined to a table of draw counts.

Draws come from integer arithmetic that any SQL engine repeats: a keyed permutation modulo the prime 2**31 - 1 of the place
of the draw, reduced to the number of units. They are not those of another library's generator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

#: Rounds of x -> (x + key)**5 modulo the prime: each is a bijection, and no product leaves 64 bits.
PRIME, ROUND_KEYS = 2147483647, (716414059, 1299709327, 387276917, 1640531527)


def draw_counts(spark: SparkSession, units: int, reps: int) -> DataFrame:
    """(rep, __k, times): for each replicate, how often each of the units 0 .. units - 1 is drawn, with replacement; units
    that are not drawn have no row. The draws are dealt over the tasks."""
    parts = max(1, min(reps * units // 200_000, 4096))
    df = spark.range(0, reps * units, 1, parts).select(F.expr(f"id div {units}").alias("rep"), (F.col("id") % units).alias("z"))
    for j, key in enumerate(ROUND_KEYS):
        z = (F.col("z") + (F.col("rep") + 1) * (48271 + 2 * j) + key) % PRIME
        df = df.withColumn("z", z).withColumn("z2", F.col("z") * F.col("z") % PRIME)
        df = df.withColumn("z", F.col("z2") * F.col("z2") % PRIME * F.col("z") % PRIME)
    # known not to be null: a join would else test the whole expression for it again
    return df.groupBy("rep", F.coalesce(F.col("z") % units, F.lit(0)).alias("__k")).agg(F.count("*").alias("times"))


def numbered(sums: DataFrame, unit: str, within: list[str] | None = None) -> DataFrame:
    """``sums`` with __k, the place (from 0) of its unit among all units in order. Units are calendar days or blocks of them,
    so there are some hundreds a year however many rows stand behind them."""
    order = sums.select(unit).distinct().withColumn("__k", F.row_number().over(Window.orderBy(unit)) - 1)
    return sums.join(F.broadcast(order), unit)


def replicates(sums: DataFrame, unit: str, stats: dict[str, Column], reps: int = 2000, by: list[str] | None = None) -> DataFrame:
    """(rep, by, statistics): each replicate draws as many units as there are, and the statistics, aggregates over the sums'
    columns and ``times``, are computed from the drawn units' sums."""
    rows = numbered(sums, unit)
    units = rows.agg(F.max("__k")).first()[0]
    if units is None:
        units, reps = 0, 0  # an empty table has no replicates
    counts = draw_counts(sums.sparkSession, units + 1, reps)
    return counts.join(rows, "__k").groupBy("rep", *(by or [])).agg(*[c.alias(n) for n, c in stats.items()])


def interval(reps: DataFrame, value: str, alpha: float = 0.05, by: list[str] | None = None) -> DataFrame:
    """(by, reps, ci_low, ci_high, p_one_sided): percentile interval, and the share of replicates at or below 0."""
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    out = reps.groupBy(*(by or [])).agg(F.count(value).alias("reps"), q.alias("__q"), F.avg((F.col(value) <= 0).cast("double")).alias("p_one_sided"))
    return out.select(*(by or []), "reps", F.col("__q")[0].alias("ci_low"), F.col("__q")[1].alias("ci_high"), "p_one_sided")


def holm(tests: DataFrame, p: str, tie: str, out: str = "adjusted") -> DataFrame:
    """Holm's step-down adjusted p-values over all rows of a table of tests (a handful of named cells)."""
    w = Window.orderBy(p, tie)
    m = F.count("*").over(Window.partitionBy(F.lit(0)))
    step = F.col(p) * (m - F.row_number().over(w) + 1)
    return tests.withColumn("__s", step).withColumn(out, F.least(F.lit(1.0), F.max("__s").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__s")
