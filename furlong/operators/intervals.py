"""Interval joins: rows of two tables whose intervals meet, found by bins of several widths."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

#: Bins that an interval is copied to at its own level at most (and one more); the bins of the next level are as many times as wide.
SPREAD = 64


def clean(df: DataFrame, lo: str, hi: str, closed: bool) -> DataFrame:
    """Borders as numbers, a null one beyond all others; intervals that hold nothing are left out."""
    a, b = F.coalesce(F.col(lo).cast("double"), F.lit(-math.inf)), F.coalesce(F.col(hi).cast("double"), F.lit(math.inf))
    df = df.withColumns({"__lo": a, "__hi": b})
    inside = F.col("__lo") <= F.col("__hi") if closed else F.col("__lo") < F.col("__hi")
    return df.filter(~F.isnan("__lo") & ~F.isnan("__hi") & inside)


def extent(df: DataFrame) -> tuple[float | None, float | None]:
    """The smallest and the largest finite border."""
    finite = F.filter(F.array("__lo", "__hi"), lambda x: F.abs(x) < math.inf)
    r = df.agg(F.min(F.array_min(finite)), F.max(F.array_max(finite))).first()
    return r[0], r[1]


def interval_join(left: DataFrame, right: DataFrame, lo: str, hi: str, right_lo: str, right_hi: str, width: float, on: list[str] | None = None, closed: bool = True) -> DataFrame:
    """Pairs of rows whose intervals [lo, hi] share a point (``closed``), or whose half-open intervals [lo, hi) do, with equal
    ``on`` columns. Columns of the right that the left has too, but for ``on``, are to be renamed first.

    A null border is open: it lies beyond all others. An interval with lo above hi, or of NaN, meets nothing, and so does an
    empty half-open one. A null in ``on`` meets nothing, as in any join. Repeated rows meet like others.

    An interval belongs to the level at which it touches SPREAD bins at most, ``width`` being that of level 0. A pair meets
    at the higher of its two levels: there the shorter interval lies in a bin or two, the longer in SPREAD + 1 at most, and
    the pair is told in the first bin that both touch, so none comes twice. A hot key is thus dealt over its bins on both sides, open
    intervals too, as open borders are drawn in to the extent of all finite ones."""
    on = on or []
    if clash := [c for c in right.columns if c in left.columns and c not in on]:
        raise ValueError(f"rename columns of the right side first: {clash}")
    a, b = clean(left, lo, hi, closed), clean(right, right_lo, right_hi, closed)
    ends = [x for x in (*extent(a), *extent(b)) if x is not None]
    least, most = (min(ends), max(ends)) if ends else (0.0, 0.0)
    widths = [float(width)]
    while (most - least) / widths[-1] >= SPREAD - 1:
        widths.append(widths[-1] * SPREAD)
    within = lambda x: F.least(F.greatest(x, F.lit(least)), F.lit(most))
    bin_at = lambda x, w: F.floor(within(F.col(x)) / w).cast("long")
    level = F.coalesce(*[F.when(bin_at("__hi", w) - bin_at("__lo", w) < SPREAD, m) for m, w in enumerate(widths)], F.lit(len(widths) - 1))
    a, b = a.withColumn("__level", level), b.withColumn("__level", level)
    levels = [{r[0] for r in df.select("__level").distinct().collect()} for df in (a, b)]  # a handful of numbers

    def copies(df: DataFrame, others: set[int]) -> DataFrame:
        """Each row in the bins of the levels at which it can meet a row of the other side."""
        def at(m: int, w: float) -> Column:
            here = (F.col("__level") <= m) if m in others else (F.col("__level") == m)
            return F.when(here, F.transform(F.sequence(bin_at("__lo", w), bin_at("__hi", w)), lambda x: F.struct(F.lit(m).alias("m"), x.alias("bin"))))

        return df.withColumn("__at", F.explode(F.flatten(F.array_compact(F.array(*[at(m, w) for m, w in enumerate(widths)]))))).withColumns({"__m": F.col("__at.m"), "__bin": F.col("__at.bin")}).drop("__at")

    own = copies(a, levels[1])
    other = copies(b, levels[0]).withColumnsRenamed({"__lo": "__rlo", "__hi": "__rhi", "__level": "__rlevel"})
    meet = (F.col("__lo") <= F.col("__rhi")) & (F.col("__rlo") <= F.col("__hi")) if closed else (F.col("__lo") < F.col("__rhi")) & (F.col("__rlo") < F.col("__hi"))
    width_at: Column = F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("__m") + 1)
    first = F.floor(within(F.greatest("__lo", "__rlo")) / width_at).cast("long")
    pairs = own.join(other, [*on, "__m", "__bin"]).filter(meet & (F.greatest("__level", "__rlevel") == F.col("__m")) & (F.col("__bin") == first))
    return pairs.select(*left.columns, *[c for c in right.columns if c not in on])
