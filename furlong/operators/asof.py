"""Strictly-before primitives: a value at a day uses earlier days only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F


def daily_before(runs: DataFrame, keys: list[str], day: str, sums: dict[str, Column]) -> DataFrame:
    """One row per (keys, day) with the sums of all earlier days (0 where there are none). Days are summed first, so a
    hot key is a window over at most its number of days."""
    daily = runs.groupBy(*keys, day).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    w = Window.partitionBy(*keys).orderBy(day).rowsBetween(Window.unboundedPreceding, -1)
    return daily.select(*keys, day, *[F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums])


def with_before(runs: DataFrame, keys: list[str], day: str, sums: dict[str, str]) -> DataFrame:
    """``runs`` with the sums of all earlier days of its keys. A null key is a key like any other."""
    b = daily_before(runs, keys, day, {n: F.expr(e) for n, e in sums.items()})
    same = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, day]]
    cond = same[0]
    for c in same[1:]:
        cond &= c
    return runs.alias("r").join(b.alias("b"), cond).select("r.*", *[F.col(f"b.{n}").alias(n) for n in sums])


def join_same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` with the other columns of the ``right`` row of equal keys; nulls are equal to each other."""
    right = right.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    cond = F.lit(True)
    for k in keys:
        cond &= left[k].eqNullSafe(right[f"__same_{k}"])
    return left.join(right, cond, how).drop(*[f"__same_{k}" for k in keys])


def sums_before(rows: DataFrame, day: str, blocks: dict[str, tuple[list[str], dict[str, tuple[str, str]]]]) -> DataFrame:
    """``rows`` with, for each block (keys, rates), <block>_starts, the number of rows of its keys on earlier days, and
    <block>_<rate>, a sum over another of these rows (null where there are none, or for a row without a day).

    The frames read the rows themselves: blocks whose keys hold one key in common take one exchange by it, and nothing is
    joined. That key's rows pass through one task, so it is for keys of many values."""
    df = rows.withColumn("__day", F.datediff(F.col(day), F.lit("1970-01-01")))
    dated = F.col("__day").isNotNull()
    for name, (keys, rates) in blocks.items():
        w = Window.partitionBy(*keys).orderBy("__day").rangeBetween(Window.unboundedPreceding, -1)
        out = {f"{name}_starts": F.when(dated, F.count(F.lit(1)).over(w)).otherwise(F.lit(0))}
        out |= {f"{name}_{c}": F.when(dated, F.try_divide(F.sum(F.expr(of)).over(w), F.sum(F.expr(by)).over(w))) for c, (of, by) in rates.items()}
        df = df.withColumns(out)
    return df.drop("__day")


def join_entries(left: DataFrame, found: DataFrame, contest: str, entity: str, values: list[str]) -> DataFrame:
    """``left`` with the ``values`` of the ``found`` row of the same entry; each has an entry once. The found entries of a contest
    are one map, so a ``left`` that lies by contest is not shuffled, as it would be for a join by both keys."""
    held = found.groupBy(F.col(contest).alias("__contest")).agg(F.map_from_entries(F.collect_list(F.struct(F.col(entity), F.struct(*values)))).alias("__held"))
    out = left.join(held, left[contest] == held["__contest"], "left").withColumn("__one", F.col("__held")[F.col(entity)])
    return out.select(*left.columns, *[F.col(f"__one.{v}").alias(v) for v in values])


def before_in_cell(rows: DataFrame, cell: list[str], day: str, value: str, least: int = 50, clip: float = 5.0) -> DataFrame:
    """``rows`` with z, their ``value`` against the mean and spread of their cell on earlier days: null below ``least`` earlier
    values and where these do not spread, kept within ``clip``. Null keys form a cell, null values count nowhere.

    Days are summed first: the count, the mean and the squares about it. Days are then joined about the first day's mean, so
    no square of a large level is subtracted from another."""
    daily = rows.groupBy(*cell, day).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_pop(value) * F.count(value), F.lit(0.0)).alias("squares"))
    w = Window.partitionBy(*cell).orderBy(day)
    daily = daily.withColumn("first", F.first("mean", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    off = F.coalesce(F.col("mean") - F.col("first"), F.lit(0.0))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = {"n": F.sum("n"), "s": F.sum(F.col("n") * off), "q": F.sum(F.col("squares") + F.col("n") * off * off)}
    first = F.max("first").over(past)  # the same on all days once there is one
    daily = daily.select(*cell, day, *[c.over(past).alias(f"__{k}") for k, c in sums.items()], first.alias("__first"))
    out = join_same(rows, daily, [*cell, day])
    n, q = F.col("__n"), F.try_divide(F.col("__q"), F.col("__n"))
    shift = F.try_divide(F.col("__s"), n)
    spread = q - shift * shift
    z = F.when((n >= least) & (spread > 1e-12 * q), (F.col(value) - F.col("__first") - shift) / F.sqrt(spread))
    return out.withColumn("z", z).withColumn("z", F.when(F.col("z").isNotNull(), F.least(F.lit(clip), F.greatest(F.lit(-clip), F.col("z"))))).drop("__n", "__s", "__q", "__first")


def asof_strict(probes: DataFrame, source: DataFrame, keys: list[str], day: str, values: list[str], tie: str) -> DataFrame:
    """``probes`` with the ``values`` of the last ``source`` row of the same keys on an earlier day (the largest ``tie`` of
    that day). Probes and source are one union in one window; a probe stands before the sources of its day."""
    last = source.groupBy(*keys, day).agg(F.max_by(F.struct(*values), tie).alias("__v"))
    both = probes.withColumn("__v", F.lit(None).cast(last.schema["__v"].dataType)).withColumn("__s", F.lit(0))
    both = both.unionByName(last.withColumn("__s", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy(day, "__s").rowsBetween(Window.unboundedPreceding, -1)
    out = both.withColumn("__v", F.last("__v", ignorenulls=True).over(w)).filter("__s = 0")
    return out.select(*probes.columns, *[F.col(f"__v.{v}").alias(v) for v in values])


def last(k: int | None, agg: str) -> Callable[[WindowSpec], Column]:
    """An aggregate of the last k rows, or of all: ``last(5, "avg(x)")`` is a reduction of ``asof_reductions``."""
    return lambda w: F.expr(agg).over(w.rowsBetween(Window.unboundedPreceding if k is None else 1 - k, 0))


Reduction = Callable[[WindowSpec], Column]


def asof_reductions(runs: DataFrame, key: str, day: str, tie: str, blocks: dict[str, tuple[str, dict[str, Reduction]]], sources: dict[str, str] | None = None) -> DataFrame:
    """``runs`` with reductions of each key's rows of earlier days. A block is a value (an SQL expression; rows where it is null are no
    source) with reductions that read it as column ``x`` in the order of (day, tie); its outputs at a row are those at the
    last source row of an earlier day. All blocks of a key share one exchange, and no join is needed: what stood at the
    last source row is the max_by of a frame that ends on the day before.

    ``sources`` names, for a block, the condition that makes a row its source (in the place of a value that is not null): blocks of
    one condition share one sort and one frame."""
    own, sources = runs.columns, sources or {}
    df = runs.withColumn("__day", F.datediff(F.col(day), F.lit("1970-01-01")))
    before = Window.partitionBy(key).orderBy("__day").rangeBetween(Window.unboundedPreceding, -1)
    groups: dict[str, list[str]] = {}
    for name, (value, _) in blocks.items():
        groups.setdefault(sources.get(name, f"({value}) IS NOT NULL"), []).append(name)
    conditions = {c: f"__c{i}" for i, c in enumerate(groups)}
    df = df.withColumns({n: F.coalesce(F.expr(c), F.lit(False)) for c, n in conditions.items()})
    out, was = [], {}
    for c, names in groups.items():
        w = Window.partitionBy(key, conditions[c]).orderBy("__day", tie)
        for name in names:
            value, reductions = blocks[name]
            df = df.withColumn("x", F.expr(value))
            df = df.select(*own, *[k for k in df.columns if k.startswith("__")], F.struct(*[r(w).alias(n) for n, r in reductions.items()]).alias(f"__{name}_now"))
            out += [F.col(f"{conditions[c]}_was.__{name}_now.{n}").alias(n) for n in reductions]
        was[f"{conditions[c]}_was"] = F.max_by(F.struct(*[f"__{n}_now" for n in names]), F.when(F.col(conditions[c]), F.struct("__day", tie))).over(before)
    return df.withColumns(was).select(*own, *out)


def loo_mean(df: DataFrame, group: str, col: str, out: str) -> DataFrame:
    """Mean of the group's other rows; null where there are none."""
    w = Window.partitionBy(group)
    own = F.when(F.col(col).isNotNull(), 1).otherwise(0)
    return df.withColumn(out, F.try_divide(F.sum(col).over(w) - F.coalesce(F.col(col), F.lit(0)), F.count(col).over(w) - own))


def field_rank(df: DataFrame, group: str, col: str, out: str) -> DataFrame:
    """Share of the group at or below the row, ties at their mean place; nulls stay null."""
    ranked = Window.partitionBy(group, F.col(col).isNull()).orderBy(col)
    ties = F.count("*").over(Window.partitionBy(group, col))
    n = F.count(col).over(Window.partitionBy(group))
    return df.withColumn(out, F.when(F.col(col).isNotNull(), (F.rank().over(ranked) + (ties - 1) / 2) / n))
