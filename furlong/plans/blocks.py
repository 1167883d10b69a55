"""As-of feature blocks and the matrix that joins them, as DataFrame jobs over the contest panel.

Their oracles are SQL of another form: day sums, a union of probes and sources, and group windows (features.py, reports.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.availability import tagged
from ..operators.asof import asof_reductions, asof_strict, before_in_cell, join_entries, join_same, last, loo_mean, sums_before, with_before
from ..sources.panel import market, runs

six = lambda c: F.round(c, 6) + F.lit(0.0)
BAND = "CASE WHEN distance <= 1400 THEN 1 WHEN distance <= 1800 THEN 2 WHEN distance <= 2200 THEN 3 ELSE 4 END"
#: A finisher's price by weight against the mean of its contest's finishers.
RELATIVE = "CASE WHEN result_status = 'finished' THEN price / weight - avg(CASE WHEN result_status = 'finished' THEN price / weight END) OVER (PARTITION BY contest_id) END"
RANK = "CASE WHEN n > 1 THEN 1 - cast(rank() OVER (PARTITION BY contest_id ORDER BY odds) - 1 AS double) / (n - 1) END"
x_now = lambda w: F.col("x")


def reductions_of(source: str, of: str, /, lift: float = 0.0, **reductions):
    """A query for one block of reductions over ``runs`` or ``market``; ``lift`` moves halves of the last digit off the edge."""
    read = {"runs": runs, "market": market}[source]

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        # the value first: it may hold a window of its own, over the panel as it is stored
        df = asof_reductions(read(spark, sf_dir).withColumn("source_value", F.expr(of)), "entity_id", "day", "contest_id", {"v": ("source_value", reductions)})
        return df.select("contest_id", "entity_id", *[six(F.col(n) + lift if lift else F.col(n)).alias(n) for n in reductions])

    return query


def rate(key: str, hit: str, least: int = 1):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = runs(spark, sf_dir).select("contest_id", "entity_id", "day", key, hit).filter(F.col(key).isNotNull())
        df = with_before(df, [key], "day", {"s": "1", "h": hit})
        return df.select("contest_id", "entity_id", F.when(F.col("s") >= least, F.round(F.col("h") / F.col("s"), 6)).alias("rate"), F.col("s").cast("long").alias("starts_before"))

    return query


def cell_rate(*keys: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = runs(spark, sf_dir).withColumn("band", F.expr(BAND)).select("contest_id", "entity_id", "day", "band", "won", *({*keys} - {"band", "entity_id"}))
        df = with_before(df, list(keys), "day", {"s": "1", "h": "won"})
        return df.select("contest_id", "entity_id", "band", F.round(F.try_divide("h", "s"), 6).alias("rate"))

    return query


def figure(value: str, *cell: str, finished: bool = False):
    """z of a value against what its cell showed on earlier days (at least 50 rows), clipped to 5."""

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = runs(spark, sf_dir).withColumn("v", F.expr(value))
        df = df.filter("result_status = 'finished'") if finished else df
        df = before_in_cell(df.select("contest_id", "entity_id", "day", "v", *cell), list(cell), "day", "v")
        return df.select("contest_id", "entity_id", F.round(F.when(F.col("v").isNotNull(), F.col("z")), 4).alias("z"))

    return query


def class_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class rank minus that of the last start of an earlier day, and whether the agent changed since."""
    r = runs(spark, sf_dir).select("contest_id", "entity_id", "day", "class", "agent_id")
    source = r.select("entity_id", "day", "contest_id", F.col("class").alias("c"), F.col("agent_id").alias("a"))
    df = asof_strict(r, source, ["entity_id"], "day", ["c", "a"], "contest_id")
    step = F.substring("class", 1, 1).cast("long") - F.substring("c", 1, 1).cast("long")
    return df.select("contest_id", "entity_id", step.alias("class_step"), F.when(F.col("agent_id") != F.col("a"), 1).otherwise(0).alias("agent_changed"))


def condition_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes against the last start of an earlier day: weight, distance, class cell, and extension by closing style."""
    df = asof_reductions(runs(spark, sf_dir), "entity_id", "day", "contest_id", {"v": ("1", {c: (lambda w, s=s: F.col(s)) for c, s in (("w", "weight"), ("d", "distance"), ("v", "venue"), ("l", "line"))})})
    longer = F.greatest(F.col("distance") - F.col("d"), F.lit(0))
    return df.select(
        "contest_id", "entity_id", F.round(F.col("weight") - F.col("w"), 6).alias("weight_change"), F.greatest(F.col("weight") - F.col("w"), F.lit(0.0)).alias("weight_up"),
        (F.col("distance") - F.col("d")).alias("distance_change"), F.when(F.col("venue") != F.col("v"), 1).otherwise(0).alias("venue_switch"), (longer * F.col("l")).alias("extension_by_style"),
        F.when(F.col("w").isNull(), 0).otherwise(1).alias("seen"),
    )


#: Reductions of an entity's earlier values by name: aggregate and how many of the last values it reads (all if None).
Takes = dict[str, tuple[str, int | None]]
AGGREGATES = {"mean": "avg(x)", "best": "max(x)", "least": "min(x)", "spread": "stddev_samp(x)"}
#: Blocks of an entity's earlier rows: name to (value, source, reductions).
ENTITY_BLOCKS: dict[str, tuple[str, str, Takes]] = {
    "form": ("finish_order", "results", {"form_last": ("now", 1), "form_mean3": ("mean", 3), "form_mean5": ("mean", 5), "form_best5": ("least", 5), "form_worst5": ("best", 5), "form_spread5": ("spread", 5)}),
    "wins": ("cast(won AS double)", "results", {"win_rate5": ("mean", 5), "win_rate10": ("mean", 10)}),
    "shows": ("cast(top3 AS double)", "results", {"show_rate5": ("mean", 5)}),
    "market": ("ln(q * n)", "market", {"support_last": ("now", 1), "support_mean3": ("mean", 3), "support_best5": ("best", 5), "support_spread5": ("spread", 5), "support_career": ("shrunk", None)}),
    "popular": ("cast(popularity AS double)", "market", {"popularity_last": ("now", 1), "popularity_mean5": ("mean", 5), "popularity_best5": ("least", 5)}),
    "beat": ("cast(popularity - finish_order AS double)", "results", {"beat_mean5": ("mean", 5), "beat_best": ("best", None)}),
    "residual": ("won - q", "results", {"residual_mean5": ("mean", 5), "residual_career": ("shrunk", None)}),
    "pace": ("rel", "results", {"pace_mean5": ("mean", 5), "pace_min5": ("least", 5), "pace_spread5": ("spread", 5)}),
    "front": ("CASE WHEN rel < 0 THEN 1e0 WHEN rel >= 0 THEN 0e0 END", "results", {"front_rate": ("mean", None), "front_rate5": ("mean", 5)}),
    "gain": ("line - finish_order", "results", {"gain_mean": ("mean", None), "gain_best": ("best", None), "gain_worst": ("least", None)}),
    "speed": ("z", "results", {"speed_last": ("now", 1), "speed_mean3": ("mean", 3), "speed_best5": ("best", 5)}),
    "load": ("weight", "entries", {"weight_last": ("now", 1)}),
    "trip": ("distance", "entries", {"distance_last": ("now", 1)}),
    "grade": ("cast(substring(class, 1, 1) AS int)", "entries", {"class_last": ("now", 1)}),
    "date": ("datediff(day, date '1992-01-01')", "entries", {"day_last": ("now", 1)}),
}
#: Blocks whose values are there for all rows, or for all that finished: they share a sort.
ALWAYS, FINISHED, PACED = "true", "finish_order IS NOT NULL", "rel IS NOT NULL"
SOURCES = dict.fromkeys(("wins", "shows", "load", "trip", "grade", "date"), ALWAYS) | dict.fromkeys(("form", "beat", "gain"), FINISHED) | dict.fromkeys(("pace", "front"), PACED) | dict.fromkeys(("market", "residual", "popular"), "q IS NOT NULL")
WIN, SHOW, FINISH = ("won", "1"), ("top3", "1"), ("finish_order", "CASE WHEN finish_order IS NOT NULL THEN 1 END")
#: Blocks of day sums by key: name to (keys, rates); a rate is a sum over another. Each has the number of starts besides.
SUM_BLOCKS: dict[str, tuple[list[str], dict[str, tuple[str, str]]]] = {
    "career": (["entity_id"], {"rate": WIN, "top2_rate": ("top2", "1"), "show_rate": SHOW, "finish_mean": FINISH, "stopped_rate": ("CASE WHEN result_status = 'stopped' THEN 1 ELSE 0 END", "1")}),
    "place": (["entity_id", "class"], {"rate": SHOW, "finish_mean": FINISH}), "agent": (["agent_id"], {"rate": WIN, "show_rate": SHOW, "finish_mean": FINISH}),
    "owner": (["owner_id"], {"rate": WIN, "show_rate": SHOW}), "band": (["entity_id", "band"], {"rate": WIN, "finish_mean": FINISH}), "venue_band": (["venue", "band"], {"rate": WIN}),
    "sire": (["sire"], {"rate": WIN, "show_rate": SHOW}), "sire_band": (["sire", "band"], {"rate": WIN}), "pair": (["agent_id", "owner_id"], {"rate": ("top2", "1")}),
    "agent_venue": (["agent_id", "venue"], {"rate": WIN, "show_rate": SHOW}), "agent_band": (["agent_id", "band"], {"rate": WIN}),
}
#: Keys of many values: all rows of one pass through one task. Day-sum blocks that hold one of them share its exchange; those of
#: other keys (places, sires) first sum by day.
MANY = ("entity_id", "agent_id", "owner_id")
#: Columns of the row itself, or of it and the blocks above: name to (expression, source, timing).
DERIVED: dict[str, tuple[str, str, str]] = {
    "field_size": ("n", "entries", "entry"), "carried": ("weight", "entries", "entry"), "trip_length": ("distance", "entries", "entry"), "grade_now": ("cast(substring(class, 1, 1) AS int)", "entries", "entry"),
    "share_now": ("q", "market", "market"), "popularity_now": ("popularity", "market", "market"), "debut": ("CASE WHEN day_last IS NULL THEN 1 ELSE 0 END", "entries", "as_of"), "few_starts": ("CASE WHEN career_starts < 3 THEN 1 ELSE 0 END", "entries", "as_of"),
    "days_since": ("datediff(day, date '1992-01-01') - day_last", "entries", "as_of"), "weight_change": ("weight - weight_last", "entries", "as_of"), "distance_change": ("distance - distance_last", "entries", "as_of"),
    "class_step": ("cast(substring(class, 1, 1) AS int) - class_last", "entries", "as_of"), "season_sin": ("sin(2 * pi() * dayofyear(day) / 365)", "entries", "static"), "season_cos": ("cos(2 * pi() * dayofyear(day) / 365)", "entries", "static"),
}
#: What some derived columns read of the blocks.
DERIVED_NEEDS = {"debut": ["day_last"], "few_starts": ["career_starts"], "days_since": ["day_last"], "weight_change": ["weight_last"], "distance_change": ["distance_last"], "class_step": ["class_last"]}
#: Columns that are also given less the mean of the other entries of the field.
FIELD_BLOCK = ["career_rate", "career_show_rate", "career_finish_mean", "form_mean3", "form_best5", "win_rate5", "support_last", "popularity_mean5", "pace_mean5", "agent_rate", "speed_mean3", "weight"]


def matrix_columns() -> dict[str, str]:
    """Every feature column and the block that gives it."""
    out = {c: b for b, (_, _, cols) in ENTITY_BLOCKS.items() for c in cols}
    out |= {f"{b}_{c}": b for b, (_, rates) in SUM_BLOCKS.items() for c in ("starts", *rates)}
    return out | dict.fromkeys(DERIVED, "derived") | {f"{c}_vs_field": "field" for c in FIELD_BLOCK}


def _available() -> dict[str, tuple[str, str, str]]:
    """(source, timing, treatment of gaps) of every feature column."""
    out = {c: (source, "as_of", "null") for _, source, cols in ENTITY_BLOCKS.values() for c in cols}
    out |= {f"{b}_{c}": ("results" if c != "starts" else "entries", "as_of", "zero" if c == "starts" else "prior" if c == "rate" else "null") for b, (_, rates) in SUM_BLOCKS.items() for c in ("starts", *rates)}
    out |= {c: (source, timing, "null") for c, (_, source, timing) in DERIVED.items()}
    return out | {f"{c}_vs_field": (*out.get(c, ("entries", "entry", "null"))[:2], "null") for c in FIELD_BLOCK}


AVAILABLE = _available()


def asof_matrix(rows: DataFrame, columns: list[str] | None = None, targets: DataFrame | None = None) -> DataFrame:
    """One row for each started entry with the as-of features of all wired blocks, on (contest_id, entity_id), each column
    described by its availability.

    ``rows`` is the market panel. A null key (an agent, owner, sire or venue that is not known) is a key like any other, so no
    row is lost. All that goes by entity (entity blocks and day sums of keys with the entity) comes from one exchange by entity, on whose
    partitions the wide row is made; it then moves once, to its contest, where all else is looked up by entry and the field's
    means are taken. Day sums of keys with the agent, and with the owner, come from one exchange of narrow rows each; the others
    are aggregations to (keys, day) that narrow rows look up. With ``columns`` only the blocks that these need are built; with
    ``targets`` (contest_id) only those contests' rows are returned, and history is first cut to the entities and keys that
    they hold, which leaves every value as it is."""
    every = matrix_columns()
    wanted = list(every) if columns is None else columns
    if unknown := [c for c in wanted if c not in every]:
        raise ValueError(f"no such feature columns: {unknown}")
    inner = [c for c in FIELD_BLOCK if f"{c}_vs_field" in wanted] + [n for c in wanted for n in DERIVED_NEEDS.get(c, ())]
    need = {every[c] for c in [*wanted, *inner] if c in every}
    # as many partitions as the stored panel has: coalesced ones would sort wide rows on disk
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("band", F.expr(BAND)).withColumn("rel", F.expr(RELATIVE))
    wanted_contests = None if targets is None else targets.select("contest_id").distinct()
    at = rows if targets is None else rows.join(wanted_contests, "contest_id", "left_semi")

    def history(keys: list[str]) -> DataFrame:
        return rows if targets is None else join_same(rows, at.select(*keys).distinct(), keys, "left_semi")

    def of_targets(df: DataFrame) -> DataFrame:
        return df if targets is None else df.join(wanted_contests, "contest_id", "left_semi")

    blocks = {n: (value, {c: taken(*t) for c, t in cols.items()}) for n, (value, _, cols) in ENTITY_BLOCKS.items() if n in need}
    sums = {lead: {n: b for n, b in SUM_BLOCKS.items() if n in need and lead == next((k for k in MANY if k in b[0]), None)} for lead in (*MANY, None)}
    given = lambda found: [f"{n}_{c}" for n, (_, rates) in found.items() for c in ("starts", *rates)]
    out = at
    if blocks or sums["entity_id"]:
        past = history(["entity_id"])
        if "speed" in blocks:
            # figures are of cells, so the rows of all entities are their past
            seen = before_in_cell(rows.withColumn("v", F.expr("price / weight")).select("contest_id", "entity_id", "day", "v", "venue", "class"), ["venue", "class"], "day", "v")
            past = join_entries(past, seen.select("contest_id", "entity_id", F.when(F.col("v").isNotNull(), F.col("z")).alias("z")), "contest_id", "entity_id", ["z"])
        past = sums_before(past.repartition(parts, "entity_id"), "day", sums["entity_id"])
        out = of_targets(asof_reductions(past, "entity_id", "day", "contest_id", blocks, SOURCES)).repartition(parts, "contest_id")
    for lead in MANY[1:]:
        if sums[lead]:
            past = sums_before(history([lead]).repartition(parts, lead), "day", sums[lead])
            out = join_entries(out, of_targets(past), "contest_id", "entity_id", given(sums[lead]))
    for name, (keys, rates) in sums[None].items():
        each = {f"__{i}_{side}": F.sum(F.expr(e[side])) for i, e in enumerate(rates.values()) for side in (0, 1)}
        daily = history(keys).groupBy(*keys, "day").agg(F.count("*").alias("__s"), *[c.alias(n) for n, c in each.items()])
        w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
        before = lambda c: F.sum(c).over(w)
        daily = daily.select(*keys, "day", F.coalesce(before("__s"), F.lit(0)).alias(f"{name}_starts"), *[F.try_divide(before(f"__{i}_0"), before(f"__{i}_1")).alias(f"{name}_{c}") for i, c in enumerate(rates)])
        narrow = at.select(*dict.fromkeys(["contest_id", "entity_id", *keys, "day"]))
        out = join_entries(out, join_same(narrow, daily, [*keys, "day"]), "contest_id", "entity_id", given({name: (keys, rates)}))
    for c in wanted:
        if c in DERIVED:
            out = out.withColumn(c, F.expr(DERIVED[c][0]))
    for c in FIELD_BLOCK:
        if f"{c}_vs_field" in wanted:
            out = loo_mean(out, "contest_id", c, "__m").withColumn(f"{c}_vs_field", F.col(c) - F.col("__m")).drop("__m")
    return out.select("contest_id", "entity_id", *[tagged(F.col(c), c, *AVAILABLE[c]) for c in wanted])


def taken(agg: str, k: int | None):
    if agg == "shrunk":
        return lambda w: last(k, "sum(x)")(w) / (last(k, "count(x)")(w) + 5)
    return x_now if agg == "now" else last(k, AGGREGATES[agg])


def told(c: str) -> Column:
    """A column to six digits; halves of the last digit, which shares of small numbers often are, are lifted off the edge."""
    return (F.round(F.col(c).cast("double") + 1e-9, 6) + F.lit(0.0)).alias(c)


def full_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = asof_matrix(market(spark, sf_dir))
    return df.select("contest_id", "entity_id", *[told(c) for c in matrix_columns()])


def projected_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contests of one year, and the columns that one model reads."""
    rows = market(spark, sf_dir)
    df = asof_matrix(rows, PROJECTED, rows.filter("year(day) = 1997").select("contest_id"))
    return df.select("contest_id", "entity_id", *[told(c) for c in PROJECTED])


PROJECTED = ["form_mean3", "career_rate", "agent_rate", "career_rate_vs_field"]


def slope3(w):
    """Least-squares slope of the last three values (of two: their difference), by its closed form."""
    n, x = last(3, "count(x)")(w), F.col("x")
    return F.when(n == 3, (x - F.lag("x", 2).over(w)) / 2).when(n == 2, x - F.lag("x").over(w))


enough = lambda agg, k: lambda w: F.when(last(None, "count(x)")(w) >= 3, last(k, agg)(w))
one = lambda source, agg, k: reductions_of("runs", source, **{"value": last(k, agg)})

QUERIES = {
    "agent_rate_before": rate("agent_id", "won"), "owner_rate_before": rate("owner_id", "won", 20), "venue_rate_before": rate("venue", "top3"),
    "aptitude_by_band": cell_rate("entity_id", "band"), "aptitude_by_venue_band": cell_rate("venue", "band"),
    "recent_form_3": one("finish_order", "avg(x)", 3), "recent_win_rate_5": one("cast(won AS double)", "avg(x)", 5),
    "past_market_5": one("cast(popularity AS double)", "avg(x)", 5), "best_last_5": one("cast(popularity AS double)", "min(x)", 5),
    "pace_block": reductions_of("runs", RELATIVE, lift=1e-9, mean5=last(5, "avg(x)"), min5=last(5, "min(x)"), front_rate=last(None, "avg(CASE WHEN x < 0 THEN 1e0 ELSE 0e0 END)")),
    "trajectory_block": reductions_of("runs", "cast(line - finish_order AS double)", mean_gain=last(None, "avg(x)"), best_gain=last(None, "max(x)")),
    "support_reductions": reductions_of(
        "market", "ln(q * n)", last1=x_now, mean3=lambda w: last(3, "sum(x)")(w) / (last(3, "count(x)")(w) + 1),
        career=lambda w: last(None, "sum(x)")(w) / (last(None, "count(x)")(w) + 5), best5=last(5, "max(x)"), sd5=last(5, "stddev_samp(x)"), trend3=slope3,
    ),
    "rank_robust": reductions_of("market", RANK, mean5=enough("avg(x)", 5), best=enough("max(x)", None)),
    "residual_form": reductions_of("market", "won - q", mean5=enough("avg(x)", 5), career=enough("avg(x)", None)),
    "speed_figure": figure("price / weight", "venue", "class"), "closing_figure": figure("odds", "class", finished=True),
    "class_change": class_change, "condition_change": condition_change, "asof_matrix": full_matrix, "asof_matrix_projected": projected_matrix,
}

#: The last start of an earlier day, by a correlated subquery.
_PREVIOUS = """WITH s AS (SELECT entity_id, day, max(contest_id) AS contest_id FROM runs GROUP BY entity_id, day),
l AS (SELECT r.*, (SELECT max(s.day) FROM s WHERE s.entity_id = r.entity_id AND s.day < r.day) AS day_before FROM runs r),
p AS (SELECT l.*, x.class AS c, x.agent_id AS a, x.weight AS w, x.distance AS d, x.venue AS v, x.line AS li FROM l LEFT JOIN s ON s.entity_id = l.entity_id AND s.day = l.day_before
  LEFT JOIN runs x ON x.contest_id = s.contest_id AND x.entity_id = s.entity_id) """


def _matrix_sql(columns: list[str], where: str = "true") -> str:
    """Every feature by its definition: rows of earlier days, looked up for each row by joins and lists."""
    duck = {"now": "{l}[-1]", "mean": "list_avg({l})", "best": "list_max({l})", "least": "list_min({l})", "spread": "list_aggregate({l}, 'stddev_samp')", "shrunk": "list_sum({l}) / (len({l}) + 5)"}
    date = lambda e: e.replace("datediff(day, date '1992-01-01')", "datediff('day', date '1992-01-01', day)")
    values = ", ".join(f"cast({date(e)} AS double) AS {n}_x" for n, (e, _, _) in ENTITY_BLOCKS.items())
    held = ", ".join(f"list(b.{n}_x ORDER BY b.day, b.contest_id) FILTER (b.{n}_x IS NOT NULL) AS {n}_l" for n in ENTITY_BLOCKS)
    rel = "CASE WHEN result_status = 'finished' THEN price / weight - avg(CASE WHEN result_status = 'finished' THEN price / weight END) OVER (PARTITION BY contest_id) END"
    cell = "PARTITION BY venue, class ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING"
    z = "CASE WHEN count(price / weight) OVER w >= 50 AND stddev_pop(price / weight) OVER w > 1e-9 THEN least(5e0, greatest(-5e0, (price / weight - avg(price / weight) OVER w) / stddev_pop(price / weight) OVER w)) END"
    ctes = [f"e0 AS (SELECT *, CASE WHEN distance <= 1400 THEN 1 WHEN distance <= 1800 THEN 2 WHEN distance <= 2200 THEN 3 ELSE 4 END AS band, {rel} AS rel, {z} AS z FROM market WINDOW w AS ({cell}))", f"e AS (SELECT *, {values} FROM e0)",
            f"h AS (SELECT a.contest_id, a.entity_id, {held} FROM e a JOIN e b ON a.entity_id = b.entity_id AND b.day < a.day GROUP BY a.contest_id, a.entity_id)"]
    joins = ["LEFT JOIN h ON h.contest_id = e.contest_id AND h.entity_id = e.entity_id"]
    cols = [f"{duck[agg].format(l=f'{b}_l' if k is None or agg == 'now' else f'{b}_l[-{k}:]')} AS {c}" for b, (_, _, takes) in ENTITY_BLOCKS.items() for c, (agg, k) in takes.items()]
    for name, (keys, rates) in SUM_BLOCKS.items():
        on, group = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys), ", ".join(f"a.{k}" for k in keys)
        each = "".join(f", sum({e[side]}) AS s{i}_{side}" for i, e in enumerate(rates.values()) for side in (0, 1))
        total = "".join(f", sum(b.s{i}_{side}) AS s{i}_{side}" for i in range(len(rates)) for side in (0, 1))
        ctes.append(f"d_{name} AS (SELECT {', '.join(keys)}, day, count(*) AS s{each} FROM e GROUP BY {', '.join(keys)}, day)")
        ctes.append(f"b_{name} AS (SELECT {group}, a.day, sum(b.s) AS s{total} FROM d_{name} a JOIN d_{name} b ON {on} AND b.day < a.day GROUP BY {group}, a.day)")
        joins.append(f"LEFT JOIN b_{name} ON {' AND '.join(f'b_{name}.{k} IS NOT DISTINCT FROM e.{k}' for k in keys)} AND b_{name}.day = e.day")
        cols += [f"coalesce(b_{name}.s, 0) AS {name}_starts", *[f"cast(b_{name}.s{i}_0 AS double) / b_{name}.s{i}_1 AS {name}_{c}" for i, c in enumerate(rates)]]
    ctes.append(f"f0 AS (SELECT e.contest_id, e.entity_id, e.day, e.weight, e.distance, e.class, e.n, e.q, e.popularity, {', '.join(cols)} FROM e {' '.join(joins)})")
    ctes.append(f"f AS (SELECT *, {', '.join(f'{date(e)} AS {c}' for c, (e, _, _) in DERIVED.items())} FROM f0)")
    field = [f"{c} - (sum({c}) OVER w - coalesce({c}, 0)) / nullif(count({c}) OVER w - CASE WHEN {c} IS NULL THEN 0 ELSE 1 END, 0) AS {c}_vs_field" for c in FIELD_BLOCK if f"{c}_vs_field" in columns]
    ctes.append(f"g AS (SELECT f.*{''.join(', ' + x for x in field)} FROM f WINDOW w AS (PARTITION BY contest_id))")
    return f"WITH {', '.join(ctes)} SELECT contest_id, entity_id, {', '.join(f'round(cast({c} AS double) + 1e-9, 6) + 0e0 AS {c}' for c in columns)} FROM g WHERE {where}"


_FIGURE = """WITH v AS (SELECT contest_id, entity_id, {value} AS v, count({value}) OVER w AS n, avg({value}) OVER w AS mean, stddev_pop({value}) OVER w AS sd FROM runs WHERE {where}
  WINDOW w AS (PARTITION BY {cell} ORDER BY day RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL 1 DAY PRECEDING))
SELECT contest_id, entity_id, CASE WHEN n >= 50 AND sd > 1e-9 THEN round(least(5.0, greatest(-5.0, (v - mean) / sd)), 4) END AS z FROM v"""
SQL = {
    "speed_figure": _FIGURE.format(value="(price / weight)", cell="venue, class", where="true"),
    "closing_figure": _FIGURE.format(value="odds", cell="class", where="result_status = 'finished'"),
    "class_change": _PREVIOUS + "SELECT contest_id, entity_id, cast(substring(class, 1, 1) AS bigint) - cast(substring(c, 1, 1) AS bigint) AS class_step, CASE WHEN agent_id <> a THEN 1 ELSE 0 END AS agent_changed FROM p",
    "condition_change": _PREVIOUS + """SELECT contest_id, entity_id, round(weight - w, 6) AS weight_change, greatest(weight - w, 0e0) AS weight_up, distance - d AS distance_change,
CASE WHEN venue <> v THEN 1 ELSE 0 END AS venue_switch, greatest(distance - d, 0) * li AS extension_by_style, CASE WHEN w IS NULL THEN 0 ELSE 1 END AS seen FROM p""",
    "asof_matrix": _matrix_sql(list(matrix_columns())),
    "asof_matrix_projected": _matrix_sql(PROJECTED, "year(day) = 1997"),
}
