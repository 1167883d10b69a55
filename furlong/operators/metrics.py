"""Metrics of scored rows (score, 0/1 label) and of contests, as aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import running

CLIP = 1e-15


def clipped(p: Column) -> Column:
    return F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))


def losses(score: str, label: str) -> dict[str, Column]:
    """Aggregates: log loss and Brier score."""
    p, y = clipped(F.col(score)), F.col(label)
    return {"log_loss": -F.avg(y * F.ln(p) + (1 - y) * F.ln(1 - p)), "brier": F.avg((F.col(score) - y) * (F.col(score) - y))}


def by_score(df: DataFrame, score: str, label: str, digits: int) -> DataFrame:
    """One row for each score, rounded: what metrics by order need, a bounded number of rows whatever the table's size."""
    return df.groupBy(F.round(score, digits).alias("x")).agg(F.sum(label).cast("double").alias("pos"), F.sum(1 - F.col(label)).cast("double").alias("neg"))


def auc(df: DataFrame, score: str, label: str, digits: int = 9) -> DataFrame:
    """Area under the curve with ties counted half: pairs of a positive and a smaller negative."""
    s = running(by_score(df, score, label, digits), ["x"], {"upto": F.col("neg")})
    return s.agg(F.try_divide(F.sum(F.col("pos") * (F.col("upto") - F.col("neg") / 2)), F.sum("pos") * F.sum("neg")).alias("auc"))


def ks_distance(df: DataFrame, score: str, label: str, digits: int = 3) -> DataFrame:
    """Largest distance between the two labels' distributions of the score."""
    s = running(by_score(df, score, label, digits), ["x"], {"a": F.col("pos"), "b": F.col("neg")})
    t = s.agg(F.max("a").alias("at"), F.max("b").alias("bt"))
    return s.crossJoin(F.broadcast(t)).agg(F.max(F.abs(F.col("a") / F.col("at") - F.col("b") / F.col("bt"))).alias("ks"))


def bin_of(score: str | Column, bins: int) -> Column:
    """Equal-width bins of [0, 1]; the last one is closed."""
    return F.least(F.floor((F.col(score) if isinstance(score, str) else score) * bins), F.lit(bins - 1)).cast("long")


def reliability(df: DataFrame, score: str, label: str, bins: int = 10, by: list[str] | None = None, least: int = 0) -> DataFrame:
    """(by, bin, n, mean_score, rate, low, high): Wilson intervals at 95 %; rates and intervals of bins of fewer than
    ``least`` rows are null."""
    out = df.groupBy(*(by or []), bin_of(score, bins).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("rate"))
    z, n, r = 1.96, F.col("n"), F.col("rate")
    half = z * F.sqrt((r * (1 - r) + z * z / (4 * n)) / n)
    told = lambda c: F.when(n >= least, c)
    return out.withColumns({"low": told((r + z * z / (2 * n) - half) / (1 + z * z / n)), "high": told((r + z * z / (2 * n) + half) / (1 + z * z / n)), "rate": told(r)})


def ece(df: DataFrame, score: str, label: str, bins: int = 10, by: list[str] | None = None) -> DataFrame:
    """(by, n, ece): the mean distance of score and rate over equal-width bins, by rows."""
    r = reliability(df, score, label, bins, by)
    return r.groupBy(*(by or [])).agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.abs(F.col("mean_score") - F.col("rate"))) / F.sum("n")).alias("ece"))


def equal_mass_bins(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """(bin, n, s, h) of bins of about equal counts that never part equal scores: from its first row on, a bin takes whole
    scores until it holds rows / bins. Rows are first summed by score; a boundary then is one small look-up."""
    s = df.groupBy(F.col(score).alias("x")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("double")).alias("h"))
    s = running(s, ["x"], {"upto": F.col("n")}).persist()
    total = s.agg(F.max("upto")).first()[0] or 0
    edges, start = [], 0
    while start < total:
        start = s.filter(F.col("upto") >= start + total / bins).agg(F.min("upto")).first()[0] or total
        edges.append(start)
    where = F.lit(0)
    for e in edges:
        where = where + (F.col("upto") > e).cast("int")
    return s.groupBy(where.alias("bin")).agg(F.sum("n").alias("n"), F.sum(F.col("x") * F.col("n")).alias("s"), F.sum("h").alias("h"))


def ndcg(df: DataFrame, group: str, score: Column, gain: str, tie: str) -> DataFrame:
    """(group, ndcg) over all rows of the group."""
    by_score_, ideal = (Window.partitionBy(group).orderBy(c, tie) for c in (F.desc("__s"), F.desc(gain)))
    d = lambda w: F.col(gain) / F.log2(1 + F.row_number().over(w))
    out = df.withColumn("__s", score).select(group, d(by_score_).alias("a"), d(ideal).alias("b"))
    return out.groupBy(group).agg(F.try_divide(F.sum("a"), F.sum("b")).alias("ndcg"))


def winner_nll(df: DataFrame, group: str, p: str, won: str) -> DataFrame:
    """(contests, excluded, nll, uniform_nll): contests without exactly one winner are excluded and counted."""
    c = df.groupBy(group).agg(F.sum(won).alias("w"), F.max(F.when(F.col(won) == 1, F.col(p))).alias("pw"), F.count("*").alias("n"))
    one = F.col("w") == 1
    return c.agg(F.count("*").alias("contests"), F.count_if(~one).alias("excluded"), F.avg(F.when(one, -F.ln(clipped(F.col("pw"))))).alias("nll"), F.avg(F.when(one, F.ln("n"))).alias("uniform_nll"))
