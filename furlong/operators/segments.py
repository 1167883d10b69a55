"""Accuracy by segment: frozen axes over contests and over entries, with loss, calibration and intervals over days.

An axis is a name and an expression for its bucket. Contest axes compare the winner's loss with ln of the field's size; entry
axes compare each entry's log loss with that of the share 1 / n. A null bucket is 'missing', so each axis keeps all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from . import bootstrap as bs, metrics

MISSING = "missing"


def banded(value: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the first edge above the value, the last label from the last edge on; null for null and NaN."""
    out = F.when(value.isNull() | F.isnan(value.cast("double")), None)
    for edge, label in zip(edges, labels[:-1], strict=True):
        out = out.when(value < edge, label)
    return out.otherwise(labels[-1])


def last_starts(runs: DataFrame, entity: str, day: str, tie: str, keep: list[str], count: dict[str, Column] | None = None) -> DataFrame:
    """``runs`` with what is known of each entity before the day: prior_starts, prior_<name> (how many of these meet a condition of ``count``), prev_day, prev_<column> of the last start of an
    earlier day (the largest ``tie`` of that day), and prior_gap, the days between that start's day and the one before it. All are null
    for a row without an entity or a day.

    One exchange by entity serves all of it: the frame of a row ends the day before, so starts of one day don't see each other."""
    at = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    w = Window.partitionBy(entity).orderBy("__at").rangeBetween(Window.unboundedPreceding, -1)
    dated = F.col("__at").isNotNull()  # undated rows stand in every frame and count in none
    df = runs.withColumn("__at", at).withColumn("prev_day", F.max(day).over(w))
    df = df.withColumn("__last", F.max(F.when(dated, F.struct(F.col("__at"), F.col(tie), F.col("prev_day").alias("before"), *keep))).over(w)).withColumn("__n", F.count("__at").over(w))
    met = {f"__c_{n}": F.count_if(c & dated).over(w) for n, c in (count or {}).items()}
    df = df.withColumns(met) if met else df
    known = F.col(entity).isNotNull() & dated
    out = {"prior_starts": F.col("__n"), "prev_day": F.col("prev_day"), "prior_gap": F.datediff("prev_day", F.col("__last.before"))} | {f"prior_{n}": F.col(f"__c_{n}") for n in count or {}} | {f"prev_{c}": F.col(f"__last.{c}") for c in keep}
    return df.select(*runs.columns, *[F.when(known, c).alias(n) for n, c in out.items()])


def long_form(rows: DataFrame, axes: dict[str, Column], keep: list[str]) -> DataFrame:
    """A row for each of ``rows`` and axis: axis, bucket and the columns to keep."""
    pairs = F.array(*[F.struct(F.lit(a).alias("axis"), F.coalesce(e.cast("string"), F.lit(MISSING)).alias("bucket")) for a, e in axes.items()])
    return rows.select(*keep, F.explode(pairs).alias("__a")).select("__a.axis", "__a.bucket", *keep)


def with_losses(field: DataFrame, contest: str, p: str, q: str, won: str) -> DataFrame:
    """Entries of the contests with one winner and a rival, with n, excess (log loss less that of 1 / n) and, on the winner's
    row, winner_nll, market_nll and uniform_nll. Contests without a clear winner, or with a null p or q, have no row."""
    w = Window.partitionBy(contest)
    whole = F.count(F.when(F.col(p).isNotNull() & F.col(q).isNotNull(), 1)).over(w)
    df = field.withColumns({"n": F.count("*").over(w), "__k": F.sum(won).over(w), "__whole": whole}).filter("__k = 1 and n > 1 and __whole = n")
    pc, y, u = metrics.clipped(F.col(p)), F.col(won), 1 / F.col("n")
    loss = lambda x: -(y * F.ln(x) + (1 - y) * F.ln(1 - x))
    winner = lambda x: F.when(y == 1, -F.ln(x))
    return df.drop("__k", "__whole").withColumns({"excess": loss(pc) - loss(u), "winner_nll": winner(pc), "market_nll": winner(metrics.clipped(F.col(q))), "uniform_nll": winner(u)})


def _by_day(entries: DataFrame, contest_axes: dict[str, Column], entry_axes: dict[str, Column], day: str, p: str, won: str) -> DataFrame:
    """Sums by grain, axis, bucket, day and bin of p: what all of the report reads. Rows are bounded by days, buckets and bins."""
    keep = [day, p, won, "excess", "winner_nll", "market_nll", "uniform_nll"]
    grain = lambda g: (F.lit(g).alias("grain"), "*")
    rows = long_form(entries, contest_axes, keep).select(*grain("contest")).unionByName(long_form(entries, entry_axes, keep).select(*grain("entry")))
    gain = F.when(F.col("grain") == "contest", F.col("winner_nll") - F.col("uniform_nll")).otherwise(F.col("excess"))
    unit = F.when(F.col("grain") == "contest", F.col("winner_nll").isNotNull().cast("long")).otherwise(F.lit(1))
    return rows.groupBy("grain", "axis", "bucket", F.col(day).alias("day"), metrics.bin_of(p, 10).alias("bin")).agg(
        F.count("*").alias("entries"), F.count("winner_nll").alias("winners"), F.sum(unit).alias("units"), F.coalesce(F.sum(gain), F.lit(0.0)).alias("gain"), F.coalesce(F.sum("winner_nll"), F.lit(0.0)).alias("winner_nll"),
        F.coalesce(F.sum("market_nll"), F.lit(0.0)).alias("market_nll"), F.sum(F.col(won) - F.col(p)).alias("miss"))


KEYS = ["grain", "axis", "bucket"]


def day_sums(spark: SparkSession, entries: DataFrame, contest_axes: dict[str, Column], entry_axes: dict[str, Column], path: str, day: str = "day", p: str = "p", won: str = "won") -> DataFrame:
    """The sums of ``entries`` (of ``with_losses``), written to ``path`` once and read by the report and its yearly points."""
    _by_day(entries, contest_axes, entry_axes, day, p, won).write.parquet(path)
    return spark.read.parquet(path)


def report(sums: DataFrame, reps: int = 200) -> DataFrame:
    """By grain, axis and bucket: entries, winners (a contest has one), excess over uniform shares with its interval over resampled days,
    the winner's loss under model and market (contest grain only: an entry bucket splits contests), calibration in the large (entry
    grain only: 0 by construction where buckets hold whole contests), and ECE over ten bins."""
    bins = sums.groupBy(*KEYS, "bin").agg(*[F.sum(c).alias(c) for c in ("entries", "winners", "units", "gain", "winner_nll", "market_nll", "miss")])
    contest = F.col("grain") == "contest"
    out = bins.groupBy(*KEYS).agg(
        F.sum("entries").alias("entries"), F.sum("winners").alias("winners"), F.try_divide(F.sum("gain"), F.sum("units")).alias("excess"), F.try_divide(F.sum("winner_nll"), F.sum("winners")).alias("w"), F.try_divide(F.sum("market_nll"), F.sum("winners")).alias("m"),
        (F.sum("miss") / F.sum("entries")).alias("c"), (F.sum(F.abs("miss")) / F.sum("entries")).alias("ece"))
    daily = sums.groupBy(*KEYS, "day").agg(F.sum("gain").alias("s"), F.sum("units").alias("n")).filter("n > 0")
    ci = bs.interval(bs.replicates(daily, "day", {"v": F.sum(F.col("s") * F.col("times")) / F.sum(F.col("n") * F.col("times"))}, reps, KEYS), "v", by=KEYS)
    out = out.join(ci.select(*KEYS, "ci_low", "ci_high"), KEYS, "left")
    return out.select(*KEYS, "entries", "winners", "excess", "ci_low", "ci_high", F.when(contest, F.col("w")).alias("winner_nll"), F.when(contest, F.col("m")).alias("market_nll"), F.when(~contest, F.col("c")).alias("calibration"), "ece")


def by_year(sums: DataFrame) -> DataFrame:
    """(grain, axis, bucket, y, units, excess): the yearly points of the report; a contest counts in its winner's year."""
    return _points(sums.groupBy(*KEYS, F.year("day").alias("y")).agg(F.sum("units").alias("units"), F.sum("gain").alias("gain")))


def yearly(entries: DataFrame, contest_axes: dict[str, Column], entry_axes: dict[str, Column], day: str = "day") -> DataFrame:
    """The points of ``by_year`` from the ``entries`` (of ``with_losses``) at once: a task holds a sum for each bucket and year, and
    nothing is stored. Of a contest only the winner's row counts, so the others are not spread over the contest axes."""
    each = {"contest": (entries.filter("winner_nll is not null"), contest_axes, F.col("winner_nll") - F.col("uniform_nll")), "entry": (entries, entry_axes, F.col("excess"))}
    out = None
    for grain, (rows, axes, gain) in each.items():
        rows = long_form(rows.withColumns({"__y": F.year(day), "__gain": gain}), axes, ["__y", "__gain"])
        one = rows.groupBy(F.lit(grain).alias("grain"), "axis", "bucket", F.col("__y").alias("y")).agg(F.count("*").alias("units"), F.sum("__gain").alias("gain"))
        out = one if out is None else out.unionByName(one)
    return _points(out)


def _points(sums: DataFrame) -> DataFrame:
    return sums.filter("units > 0").select(*KEYS, "y", "units", (F.col("gain") / F.col("units")).alias("excess"))
