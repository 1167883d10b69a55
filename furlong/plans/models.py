"""Fits, probes, gates, stakes and loads over the contest panel; oracles are written in another form: closed forms, chains of steps, plain joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import sql as sql_functions
from ..operators import availability, growth, joint, likelihood, oof, probes
from ..operators.asof import join_entries
from ..operators.intervals import interval_join
from ..sources import versions
from ..sources.panel import market, panel, runs
from ..sources.places import work_dir
from .bets import _DIVIDENDS, _PAID, _PAIRS, _RANK, ONE, pair_cells, settled_pairs
from .blocks import AVAILABLE, _matrix_sql, asof_matrix
from .scores import _boot

FEATURES = ["f1", "f2"]
REPS = 300


def featured(s: SparkSession, d: str) -> DataFrame:
    return market(s, d).withColumns({"f1": F.ln("q"), "f2": F.col("weight") / 100, "y": F.year("day")})


# --- fits


def top3_fit(s: SparkSession, d: str) -> DataFrame:
    """The sequential likelihood of the first three, fitted before 1998: coefficients, and the loss of each stage before and since."""
    rows = likelihood.stages(featured(s, d), "contest_id", "finish_order", FEATURES, "y", depth=3)
    theta = likelihood.fit_candidates(rows, 2, [likelihood.Candidate(before=1998)], tolerance=1e-12)[0].theta
    rows = rows.withColumn("u", rows["f0"] * float(theta[0]) + rows["f1"] * float(theta[1]))
    each = rows.groupBy("fold", "contest", "stage").agg((F.ln(F.sum(F.exp("u"))) - F.sum(F.col("won") * F.col("u"))).alias("l"))
    out = each.groupBy((F.col("fold") >= 1998).alias("held_out"), "stage").agg(F.count("*").alias("n"), F.round(F.avg("l"), 6).alias("nll"))
    return out.select("held_out", "stage", "n", "nll", *[F.lit(round(float(t), 5)).alias(n) for t, n in zip(theta, ("alpha", "beta"), strict=True)])


RIDGES = [0.0, 0.01, 0.1, 1.0]
FOLDS = [1995, 1996, 1997, 1998]


def ridge_search(s: SparkSession, d: str) -> DataFrame:
    """The ridge of the least mean loss over expanding years, with the losses of all (ridge, year)."""
    rows = likelihood.stages(featured(s, d), "contest_id", "finish_order", FEATURES, "y", depth=1)
    got = likelihood.search_ridge(rows, 2, RIDGES, FOLDS, tolerance=1e-12)
    table = [(r, f, n, round(l, 6), r == got.ridge) for r, f, n, l, _, _ in got.rows]
    return s.createDataFrame(table, "ridge double, fold int, n long, nll double, chosen boolean")


ARMS = {"full": FEATURES, "without_market": ["f2"], "without_weight": ["f1"]}


def ablation_report(s: SparkSession, d: str) -> DataFrame:
    """What each group of features adds out of fold: the loss without it against that of the full arm."""
    table = oof.oof_table(featured(s, d), "contest_id", "entity_id", "day", "finish_order", "y", FEATURES, ARMS)
    out = oof.arm_deltas(table, "full", REPS)
    six = [F.round(c, 5).alias(c) for c in ("loss", "base_loss", "delta", "ci_low", "ci_high")]
    return out.select("arm", "contests", *six, "worse_folds", "folds", "helps")


def stage_transfer(s: SparkSession, d: str) -> DataFrame:
    """Calibration of the out-of-fold win probabilities by powers of earlier years, and whether the scores are like the market's."""
    m = market(s, d).select(F.lit("model").alias("arm"), F.year("day").alias("fold"), F.col("contest_id").alias("contest"), F.col("entity_id").alias("entity"), "day", "p", "won", "q")
    reference = m.select("contest", "entity", F.col("q").alias("p"))
    out = oof.transfer_check(m.drop("q"), reference)
    return out.select("folds", "days", *[F.round(c, 6).alias(c) for c in ("ece_raw", "ece_calibrated", "delta", "ks")], "verdict")


# --- stakes and pools


def growth_allocation(s: SparkSession, d: str) -> DataFrame:
    """Stakes of greatest expected log growth on the entries of each contest, a quarter of the bank at most."""
    out = growth.growth_stakes(market(s, d), "contest_id", "entity_id", "p", "odds", 0.25)
    return out.select("contest_id", "entity_id", F.round("stake", 6).alias("stake"), F.round("total", 6).alias("total"))


def pool_devig(s: SparkSession, d: str) -> DataFrame:
    """Win probabilities behind the pool of pairs, of contests of three entries and more. The pool is priced from the market's
    shares, so these must come out again."""
    cells = joint.quinella(market(s, d).filter("n >= 3"), p="q")
    out = growth.pool_probabilities(cells.withColumn("share", 1 / (0.75 / F.col("prob"))), "contest_id", "low", "high", "share")
    out = out.withColumnRenamed("entity", "entity_id").join(market(s, d).select("contest_id", "entity_id", "q"), ["contest_id", "entity_id"])
    near = F.when(F.abs(F.col("p") - F.col("q")) < 1e-4, F.round(F.col("q") + 1e-9, 6))
    return out.select("contest_id", "entity_id", F.round(F.col("marginal") + 1e-9, 6).alias("marginal"), near.alias("recovered"), (F.col("gap") < 1e-6).alias("settled"))


def stage_loss(s: SparkSession, d: str) -> DataFrame:
    out = growth.stage_losses(market(s, d), "contest_id", "p", "finish_order", (0.8, 0.6))
    return out.select("stage", "contests", F.round("nll", 6).alias("nll"), F.round("over_uniform", 6).alias("over_uniform"))


# --- probes and gates

#: Probes of entries against the model: cells by name, null where an entry is in none.
PROBES = {
    "weight": "CASE WHEN weight <= 10 THEN 'light' WHEN weight > 40 THEN 'heavy' END",
    "line": "CASE WHEN line = 1 THEN 'first' WHEN line >= 5 THEN 'late' END",
    "venue": "CASE WHEN venue IN ('Brand#11', 'Brand#22', 'Brand#33') THEN 'twins' WHEN venue LIKE 'Brand#5%' THEN 'fifties' END",
}


def probed(s: SparkSession, d: str) -> DataFrame:
    each = F.explode(F.map_from_arrays(F.array(*[F.lit(p) for p in PROBES]), F.array(*[F.expr(c) for c in PROBES.values()])))
    return market(s, d).select("contest_id", "day", F.year("day").alias("fold"), "p", "won", each.alias("probe", "cell"))


def cell_probe(s: SparkSession, d: str) -> DataFrame:
    """Score test of each cell, adjusted by Holm."""
    out = probes.cell_tests(probes.cell_shares(probed(s, d), "contest_id", "p", "won", "probe", "cell", []))
    return out.select("probe", "cell", "contests", F.round("score", 6).alias("score"), F.round("z", 5).alias("z"), F.round("p_value", 4).alias("p_value"), F.round("adjusted", 4).alias("adjusted"))


def tilt_probe(s: SparkSession, d: str) -> DataFrame:
    """Prequential change of the winner's loss by the tilts of each probe's cells, with day intervals."""
    out = probes.run_probe(probed(s, d), "contest_id", "day", "fold", "p", "won", "probe", "cell", REPS)
    return out.select("probe", "contests", "days", *[F.round(c, 6).alias(c) for c in ("delta", "ci_low", "ci_high")], "passes")


def gate_bets(s: SparkSession, d: str) -> DataFrame:
    """Win bets of two arms: expected value by the model, and by a model blunted towards the market."""
    m = market(s, d).withColumn("blunt", (F.col("p") + F.col("q")) / 2)
    arms = F.array(F.struct(F.lit("base").alias("arm"), F.col("p").alias("x")), F.struct(F.lit("cand").alias("arm"), F.col("blunt").alias("x")))
    m = m.withColumn("a", F.explode(arms)).select("day", "contest_id", "odds", "q", "won", F.col("a.arm").alias("arm"), F.col("a.x").alias("p"))
    return m.withColumns({"stake": F.lit(1.0), "payout": F.col("won") * F.col("odds")})


def weighted_gate(s: SparkSession, d: str) -> DataFrame:
    bets = gate_bets(s, d).filter(F.col("p") * F.col("odds") >= 0.85)
    out = probes.paired_gate(bets, "base", "cand", reps=REPS)
    return out.select("days", "base_bets", "cand_bets", *[F.round(c, 6).alias(c) for c in ("base_recovery", "cand_recovery", "delta", "ci_low", "ci_high")], "reps", "verdict")


def tail_calibration(s: SparkSession, d: str) -> DataFrame:
    out = probes.tail_guard(gate_bets(s, d), "base", "cand", {"long_odds": F.col("odds") >= 8, "small_share": F.col("q") < 0.1}, 0.0)
    return out.select("mask", "n", F.round("base_calibration", 6).alias("base_calibration"), F.round("cand_calibration", 6).alias("cand_calibration"), "passes")


def combination_gate(s: SparkSession, d: str) -> DataFrame:
    """Payout of the best pair by expected value, and of the likeliest pair, less that of the cheapest one; each choice is a type."""
    days = market(s, d).select("contest_id", "day").distinct()
    w = Window.partitionBy("contest_id")
    orders = {"value": F.desc("ev"), "likely": F.round("prob", 9).desc(), "dear": F.round("odds", 6).desc(), "base": F.round("odds", 6).asc()}
    cells = pair_cells(s, d).withColumns({f"by_{n}": F.row_number().over(w.orderBy(o, "low", "high")) for n, o in orders.items()})
    paid = settled_pairs(s, d, cells.filter(F.least(*[F.col(f"by_{n}") for n in orders]) == 1)).filter("payout is not null")
    picked = paid.groupBy("contest_id").agg(*[F.max(F.when(F.col(f"by_{n}") == 1, F.col("payout"))).alias(n) for n in orders])
    diffs = F.array(*[F.struct(F.lit(n).alias("bet_type"), (F.col(n) - F.col("base")).alias("diff")) for n in orders if n != "base"])
    out = picked.select("contest_id", F.explode(diffs).alias("x")).select("contest_id", "x.*").filter("diff is not null")
    got = probes.type_gate(out.join(days, "contest_id"), {"value": 50, "likely": 50}, reps=REPS)
    return got.select("bet_type", "bets", "days", *[F.round(c, 6).alias(c) for c in ("delta", "ci_low", "ci_high", "p_one_sided", "adjusted")], "verdict")


# --- availability, SQL functions, interval joins


def model_inputs(s: SparkSession, d: str) -> DataFrame:
    """The columns of the matrix that may be read before the market opens, with their description, and how full they are."""
    m = join_entries(asof_matrix(market(s, d)), runs(s, d).select("contest_id", "entity_id", "won"), "contest_id", "entity_id", ["won"])
    m = m.withColumn("won", availability.tagged(F.col("won"), "won", "results", "result"))
    columns = availability.model_inputs(m, "as_of")
    told = availability.describe(m)
    x = availability.select_inputs(m, columns, ["contest_id", "entity_id"])
    counts = x.agg(*[F.count(c).alias(c) for c in columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.lit(told[c]["source"]).alias("source"), F.lit(told[c]["timing"]).alias("timing"), F.col(c).alias("n")) for c in columns]))
    return counts.select(rows.alias("r")).select("r.*")


def selection_grid_sql(s: SparkSession, d: str) -> DataFrame:
    """All pairs of each contest's entries, by the table function in SQL."""
    sql_functions.register(s)
    fields = market(s, d).groupBy("contest_id").agg(F.collect_list("entity_id").alias("ids"))
    return s.sql("SELECT contest_id, selection[0] AS low, selection[1] AS high FROM {f}, LATERAL selection_grid(ids, 2, false)", f=fields)


def odds_trend_sql(s: SparkSession, d: str) -> DataFrame:
    """Slope of each entity's odds over time, a day, by the aggregate in SQL."""
    sql_functions.register(s)
    out = s.sql("SELECT entity_id, round(ols_trend(cast(datediff(day, date'1992-01-01') AS double), odds), 8) + 0D AS slope FROM {m} GROUP BY entity_id", m=market(s, d))
    return out


def overlapping_shipments(s: SparkSession, d: str) -> DataFrame:
    """Returned and accepted shipments of the same part that are on their way at the same time; a unit takes a day."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01"))
    li = s.read.parquet(f"{d}/lineitem.parquet").select("l_partkey", "l_orderkey", "l_linenumber", "l_returnflag", day.alias("a"), (day + F.col("l_quantity").cast("int")).alias("b"))
    back = li.filter("l_returnflag = 'R'").drop("l_returnflag")
    other = li.filter("l_returnflag = 'A'").select("l_partkey", F.col("l_orderkey").alias("other_order"), F.col("l_linenumber").alias("other_line"), F.col("a").alias("x"), F.col("b").alias("z"))
    out = interval_join(back, other, "a", "b", "x", "z", 30, ["l_partkey"])
    return out.select("l_partkey", "l_orderkey", "l_linenumber", "other_order", "other_line")


# --- loads


def entry_load(s: SparkSession, d: str) -> DataFrame:
    """Entries of 1998 loaded into the tables of the years before, twice: ids by map, by name and year of birth, or as surrogates."""
    p = panel(s, d).withColumn("born", 1980 + F.col("entity_id") % 7)
    canonical = F.concat(F.lit("e"), F.col("entity_id"))
    old = p.filter("year(day) < 1998")
    contests = old.select(F.col("contest_id").alias("contest"), "day", "class").distinct()
    entities = p.filter("entity_id % 3 <> 2").select(canonical.alias("entity"), F.col("entity_name").alias("name"), F.col("born").alias("birth_year")).distinct()
    entries = old.select(F.col("contest_id").alias("contest"), canonical.alias("entity"), F.col("line").alias("number"), F.col("agent_id").alias("agent"), F.col("entry_status").alias("status"))
    source = F.concat(F.lit("s"), F.col("entity_id"))
    ids = p.filter("entity_id % 3 = 0").select(source.alias("source_id"), canonical.alias("canonical_id"), F.lit("mapped").alias("status")).distinct()
    new = p.filter("year(day) = 1998").select(
        F.col("contest_id").alias("contest"), "day", "class", source.alias("source_id"), F.col("entity_name").alias("name"), F.when(F.col("entity_id") % 3 == 1, F.year("day") - F.col("born")).alias("age"),
        F.col("line").alias("number"), F.col("agent_id").alias("agent"), F.when(F.col("entry_status") != "started", F.col("entry_status")).alias("status"), F.monotonically_increasing_id().alias("line"),
    )
    once = versions.load_entries(new, contests, entities, entries, ids)
    twice = versions.load_entries(new, once["contests"], once["entities"], once["entries"], ids)
    out = twice["entries"].filter("contest is not null").join(twice["contests"].filter("year(day) = 1998").select("contest"), "contest")
    return out.join(twice["entities"].select("entity", "birth_year"), "entity", "left").select("contest", "entity", "number", "agent", "status", "birth_year")


def result_backfill(s: SparkSession, d: str) -> DataFrame:
    """Results of all contests loaded over those of odd entities: starters only, added only, with the time behind the winner."""
    p = panel(s, d).withColumn("seconds", F.round(60 + F.coalesce("finish_order", F.lit(0)) * 0.7 + F.col("weight") / 100, 2))
    entries = p.select(F.col("contest_id").alias("contest"), F.col("entity_id").alias("entity"), F.col("entry_status").alias("status"))
    rows = p.select(F.col("contest_id").alias("contest"), F.col("entity_id").alias("entity"), F.coalesce("result_status", F.lit("finished")).alias("status"), F.col("finish_order").cast("long").alias("finish"), "seconds", F.col("entity_id").alias("line"))
    old = rows.filter("entity % 2 = 1 and finish is not null").select("contest", "entity", "status", "finish", F.lit(0.0).alias("seconds"), F.lit(None).cast("double").alias("behind"))
    done, refused = versions.backfill_results(old, rows, entries)
    done = done.select("contest", "entity", "status", "finish", (F.round("behind", 2) + F.lit(0.0)).alias("behind"), F.lit(None).cast("string").alias("reason"))
    none = [F.lit(None).cast(t).alias(n) for n, t in (("status", "string"), ("finish", "long"), ("behind", "double"))]
    return done.unionByName(refused.select("contest", "entity", *none, "reason"))


def diagnostic_versions(s: SparkSession, d: str) -> DataFrame:
    """Yearly diagnostics as payload rows of a batch each, one of them loaded twice; the newest of each kind, read back."""
    path = work_dir(s)
    m = market(s, d).filter("n > 1").withColumn("y", F.year("day"))
    for at, (kind, column, year) in enumerate([("model", "p", 1996), ("model", "p", 1997), ("market", "q", 1996), ("model", "p", 1997)]):
        gap = F.col(column) - F.col("won")
        row = m.filter(F.col("y") == year).groupBy("class").agg(F.count("*").alias("n"), F.round(F.avg(gap * gap), 6).alias("brier"))
        versions.append_batch(row.select("class", versions.payload("n", "brier").alias("payload")), path, kind, f"{year}", year * 10 + (at == 3))
    rows = versions.latest(versions.versions(s, path, "class string, payload string"))
    got = lambda f, t: F.get_json_object("payload", f"$.{f}").cast(t).alias(f)
    return rows.select("kind", "batch", "class", got("n", "long"), got("brier", "double"))


QUERIES = {f.__name__: f for f in (
    top3_fit, ridge_search, ablation_report, stage_transfer, growth_allocation, pool_devig, stage_loss, cell_probe, tilt_probe, weighted_gate, tail_calibration, combination_gate,
    model_inputs, selection_grid_sql, odds_trend_sql, overlapping_shipments, entry_load, result_backfill, diagnostic_versions,
)}

# --- oracles
_F = "x AS (SELECT contest_id, entity_id, day, year(day) AS y, won, finish_order, n, p, q, ln(q) AS f1, weight / 100 AS f2 FROM market)"
#: One row an entry and stage: places that one entry holds, each after the ones before, with two entries left.
_STAGES = """oc AS (SELECT contest_id, count(*) AS k, count(CASE WHEN finish_order = 1 THEN 1 END) AS c1, count(CASE WHEN finish_order = 2 THEN 1 END) AS c2, count(CASE WHEN finish_order = 3 THEN 1 END) AS c3 FROM x GROUP BY contest_id),
st AS (SELECT x.*, j AS stage, CASE WHEN finish_order = j THEN 1 ELSE 0 END AS w FROM x JOIN oc ON x.contest_id = oc.contest_id JOIN (SELECT unnest([1, 2, 3]) AS j) s ON (finish_order IS NULL OR finish_order >= j)
  WHERE c1 = 1 AND k > 1 AND (j < 2 OR (c2 = 1 AND k > 2)) AND (j < 3 OR (c3 = 1 AND k > 3)))"""


def _steps(n: int, rows: str, by: str, start: str, ridge: str = "0e0") -> list[str]:
    """CTEs t0 .. tn: Newton steps for two features over ``rows`` (by, contest_id, stage, w, f1, f2)."""
    out, on = [f"t0 AS ({start})"], " AND ".join(f"r.{b} = t.{b}" for b in by.split(", "))
    for k in range(n):
        out.append(f"u{k} AS (SELECT {', '.join('r.' + b for b in by.split(', '))}, contest_id, stage, w, f1, f2, exp(a * f1 + b * f2) AS e FROM ({rows}) r JOIN t{k} t ON {on})")
        out.append(f"v{k} AS (SELECT {by}, sum(e * f1) / sum(e) AS m1, sum(e * f2) / sum(e) AS m2, sum(e * f1 * f1) / sum(e) AS c11, sum(e * f1 * f2) / sum(e) AS c12, sum(e * f2 * f2) / sum(e) AS c22, sum(w * f1) AS w1, sum(w * f2) AS w2 FROM u{k} GROUP BY {by}, contest_id, stage)")
        out.append(f"h{k} AS (SELECT {by}, avg(w1 - m1) AS g1, avg(w2 - m2) AS g2, avg(c11 - m1 * m1) AS h11, avg(c12 - m1 * m2) AS h12, avg(c22 - m2 * m2) AS h22 FROM v{k} GROUP BY {by})")
        out.append(f"d{k} AS (SELECT r.*, t.a, t.b, g1 - {ridge} * a AS z1, g2 - {ridge} * b AS z2, h11 + {ridge} AS r11, h22 + {ridge} AS r22 FROM h{k} r JOIN t{k} t ON {on})")
        out.append(f"t{k + 1} AS (SELECT {by}, a + (r22 * z1 - h12 * z2) / (r11 * r22 - h12 * h12) AS a, b + (r11 * z2 - h12 * z1) / (r11 * r22 - h12 * h12) AS b FROM d{k})")
    return out


_CAND = f"c AS (SELECT ridge, fold FROM (SELECT unnest({RIDGES}) AS ridge) r, (SELECT unnest({FOLDS}) AS fold) f)"
_SEEN = "SELECT c.ridge, c.fold, st.* FROM st JOIN c ON st.y < c.fold WHERE stage = 1"
_ARM = "am AS (SELECT arm, fold FROM (SELECT unnest(['full', 'without_market', 'without_weight']) AS arm) r, (SELECT DISTINCT y AS fold FROM x WHERE y > (SELECT min(y) FROM x)) f)"
_ARM_ROWS = "SELECT am.arm, am.fold, contest_id, stage, w, CASE WHEN arm = 'without_market' THEN 0e0 ELSE f1 END AS f1, CASE WHEN arm = 'without_weight' THEN 0e0 ELSE f2 END AS f2 FROM st JOIN am ON st.y < am.fold WHERE stage = 1"
_PROBED = " UNION ALL ".join(f"SELECT contest_id, day, year(day) AS fold, p, won, '{n}' AS probe, {c} AS cell FROM market WHERE contest_id IN (SELECT contest_id FROM one)" for n, c in PROBES.items())
_SHARES = f"""{ONE}, pb AS ({_PROBED}), ct AS (SELECT probe, contest_id, fold, cell, sum(p) AS m, sum(won) AS v, count(*) AS k FROM pb WHERE cell IS NOT NULL GROUP BY probe, contest_id, fold, cell),
fs AS (SELECT contest_id, count(*) AS n FROM market GROUP BY contest_id), sh AS (SELECT ct.* FROM ct JOIN fs ON ct.contest_id = fs.contest_id WHERE k < n)"""
#: 2 * (1 - Phi(|z|)), by the trapezoidal rule on 0 .. |z|.
_TAIL = "1 - 2 * (SELECT sum(CASE WHEN i IN (0, 2000) THEN 5e-1 ELSE 1e0 END * exp(-(abs(z) * i / 2000e0) * (abs(z) * i / 2000e0) / 2)) FROM (SELECT unnest(range(0, 2001)) AS i) g) * (abs(z) / 2000e0) / sqrt(2 * pi())"
_GATE = "gm AS (SELECT day, contest_id, odds, q, won, p AS pb, (p + q) / 2 AS pc FROM market), gb AS (SELECT day, odds, q, won, 'base' AS arm, pb AS p FROM gm UNION ALL SELECT day, odds, q, won, 'cand', pc FROM gm)"
_CI = "percentile_cont(0.025) WITHIN GROUP (ORDER BY v) AS lo, percentile_cont(0.975) WITHIN GROUP (ORDER BY v) AS hi"
_HOLM = "least(1e0, max({p} * (m - o + 1)) OVER (ORDER BY {p}, {tie}))"


def _tilts() -> str:
    """One Newton step of two cells on the folds before each, by the closed form of a 2 x 2 system."""
    cells = {n: [c for c in ("first", "late") if c in e] or [c for c in ("heavy", "light") if c in e] or ["fifties", "twins"] for n, e in PROBES.items()}
    a, b = (f"CASE probe {' '.join(f'WHEN {n!r} THEN {sorted(c)[i]!r}' for n, c in cells.items())} END" for i in (0, 1))
    return f"""{_SHARES}, pc AS (SELECT probe, fold, contest_id, sum(CASE WHEN cell = {a} THEN m ELSE 0 END) AS ma, sum(CASE WHEN cell = {b} THEN m ELSE 0 END) AS mb, sum(CASE WHEN cell = {a} THEN v ELSE 0 END) AS va, sum(CASE WHEN cell = {b} THEN v ELSE 0 END) AS vb, count(*) AS cells FROM sh GROUP BY probe, fold, contest_id),
ps AS (SELECT probe, fold, sum(va - ma) AS ga, sum(vb - mb) AS gb, sum(ma - ma * ma) AS haa, sum(mb - mb * mb) AS hbb, sum(-ma * mb) AS hab, sum(cells) + CASE WHEN fold = (SELECT min(fold) FROM pc) THEN 1 ELSE 0 END AS n FROM pc GROUP BY probe, fold),
pa AS (SELECT probe, fold, sum(ga) OVER w AS ga, sum(gb) OVER w AS gb, sum(haa) OVER w AS haa, sum(hbb) OVER w AS hbb, sum(hab) OVER w AS hab, sum(n) OVER w AS n FROM ps WINDOW w AS (PARTITION BY probe ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
pr AS (SELECT probe, fold, ga / n AS ga, gb / n AS gb, haa / n + 1e-6 AS haa, hbb / n + 1e-6 AS hbb, hab / n AS hab FROM pa WHERE n IS NOT NULL),
tl AS (SELECT probe, fold, {a} AS cell, (hbb * ga - hab * gb) / (haa * hbb - hab * hab) AS tilt FROM pr UNION ALL SELECT probe, fold, {b}, (haa * gb - hab * ga) / (haa * hbb - hab * hab) FROM pr),
tc AS (SELECT pb.probe, pb.day, pb.contest_id, ln(sum(p * exp(coalesce(tilt, 0)))) - sum(won * coalesce(tilt, 0)) AS d FROM pb LEFT JOIN tl ON tl.probe = pb.probe AND tl.fold = pb.fold AND tl.cell = pb.cell WHERE pb.fold > (SELECT min(fold) FROM pb) GROUP BY pb.probe, pb.day, pb.contest_id)"""


_CHOSEN = [("value", "ev DESC"), ("likely", "round(prob, 9) DESC"), ("dear", "round(odds, 6) DESC"), ("base", "round(odds, 6)")]
_COUNTS = ", ".join(f"count({c}) AS {c}" for c, (_, timing, _) in AVAILABLE.items() if timing in ("static", "entry", "as_of"))
_KINDS = ", ".join(f"('{c}', '{source}', '{timing}')" for c, (source, timing, _) in AVAILABLE.items())

SQL = {
    "combination_gate": f"""WITH {_PAIRS}, {_DIVIDENDS}, rk AS (SELECT *, {', '.join(f'{_RANK.format(o)} AS by_{n}' for n, o in _CHOSEN)} FROM cells), pp AS (SELECT * FROM ({_PAID.format('(SELECT * FROM rk WHERE 1 IN (by_value, by_likely, by_dear, by_base))')}) z WHERE payout IS NOT NULL),
df AS ({' UNION ALL '.join(f"SELECT '{n}' AS bet_type, a.contest_id, a.payout - b.payout AS diff FROM pp a JOIN pp b ON a.contest_id = b.contest_id AND a.by_{n} = 1 AND b.by_base = 1" for n, _ in _CHOSEN[:3])}),
dy AS (SELECT df.*, (SELECT max(day) FROM market m WHERE m.contest_id = df.contest_id) AS day FROM df), {_boot('SELECT bet_type, day, sum(diff) AS s, count(*) AS n FROM dy GROUP BY bet_type, day', REPS, 'day', 'bet_type')},
ci AS (SELECT bet_type, {_CI}, avg(CASE WHEN v <= 0 THEN 1e0 ELSE 0e0 END) AS pv FROM r GROUP BY bet_type), g AS (SELECT bet_type, cast(sum(n) AS bigint) AS bets, count(*) AS days, sum(s) / sum(n) AS delta FROM u GROUP BY bet_type),
k AS (SELECT g.*, lo, hi, pv, row_number() OVER (ORDER BY pv, g.bet_type) AS o, count(*) OVER () AS m FROM g JOIN ci ON ci.bet_type = g.bet_type WHERE g.bet_type <> 'dear'), h AS (SELECT *, {_HOLM.format(p='pv', tie='bet_type')} AS adj FROM k)
SELECT bet_type, bets, days, round(delta, 6) AS delta, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, round(pv, 6) AS p_one_sided, round(adj, 6) AS adjusted, CASE WHEN adj < 0.05 AND delta > 0 AND lo > 0 THEN 'adopt' ELSE 'reject' END AS verdict FROM h
UNION ALL SELECT bet_type, bets, days, round(delta, 6), NULL, NULL, NULL, NULL, 'no_decision' FROM g WHERE bet_type = 'dear'""",
    "model_inputs": f"""SELECT u.name, source, timing, n FROM (UNPIVOT (SELECT {_COUNTS} FROM ({_matrix_sql(list(AVAILABLE))}) z) ON COLUMNS(*) INTO NAME name VALUE n) u JOIN (VALUES {_KINDS}) k(name, source, timing) ON k.name = u.name""",
    "top3_fit": f"""WITH {_F}, {_STAGES}, {', '.join(_steps(8, "SELECT 1 AS id, * FROM st WHERE y < 1998", 'id', 'SELECT 1 AS id, 0e0 AS a, 0e0 AS b'))},
l AS (SELECT y >= 1998 AS held_out, contest_id, stage, ln(sum(exp(a * f1 + b * f2))) - sum(w * (a * f1 + b * f2)) AS l FROM st, t8 GROUP BY y >= 1998, contest_id, stage)
SELECT held_out, stage, cast(count(*) AS bigint) AS n, round(avg(l), 6) AS nll, (SELECT round(a, 5) FROM t8) AS alpha, (SELECT round(b, 5) FROM t8) AS beta FROM l GROUP BY held_out, stage""",
    "ridge_search": f"""WITH {_F}, {_STAGES}, {_CAND}, {', '.join(_steps(8, _SEEN, 'ridge, fold', 'SELECT ridge, fold, 0e0 AS a, 0e0 AS b FROM c', 't.ridge'))},
l AS (SELECT ridge, fold, contest_id, ln(sum(exp(a * f1 + b * f2))) - sum(w * (a * f1 + b * f2)) AS l FROM st JOIN t8 ON st.y = t8.fold WHERE stage = 1 GROUP BY ridge, fold, contest_id),
g AS (SELECT ridge, fold, count(*) AS n, avg(l) AS nll FROM l GROUP BY ridge, fold), m AS (SELECT ridge, avg(nll) AS mean FROM g GROUP BY ridge)
SELECT ridge, cast(fold AS int) AS fold, n, round(nll, 6) AS nll, ridge = (SELECT ridge FROM m ORDER BY round(mean, 12), ridge LIMIT 1) AS chosen FROM g""",
    "ablation_report": f"""WITH {_F}, {_STAGES}, {_ARM}, {', '.join(_steps(7, _ARM_ROWS, 'arm, fold', 'SELECT arm, fold, 0e0 AS a, 0e0 AS b FROM am', '1e-12'))},
l AS (SELECT arm, fold, contest_id, day, ln(sum(exp(a * f1 + b * f2))) - sum(won * (a * f1 + b * f2)) AS l FROM (SELECT t7.arm, t7.fold, x.*, CASE WHEN arm = 'without_market' THEN 0 ELSE t7.a END AS a, CASE WHEN arm = 'without_weight' THEN 0 ELSE t7.b END AS b FROM x JOIN t7 ON x.y = t7.fold) z GROUP BY arm, fold, contest_id, day HAVING sum(won) = 1),
dl AS (SELECT o.arm, o.fold, o.day, o.l, b.l AS bl FROM l o JOIN l b ON b.contest_id = o.contest_id AND b.arm = 'full' WHERE o.arm <> 'full'),
fw AS (SELECT arm, count(CASE WHEN w THEN 1 END) AS worse_folds, count(*) AS folds FROM (SELECT arm, fold, sum(l) > sum(bl) AS w FROM dl GROUP BY arm, fold) f GROUP BY arm),
{_boot('SELECT arm, day, sum(l - bl) AS s, count(*) AS n FROM dl GROUP BY arm, day', REPS, 'day', 'arm')}, ci AS (SELECT arm, {_CI} FROM r GROUP BY arm), tt AS (SELECT arm, count(*) AS contests, avg(l) AS loss, avg(bl) AS base_loss FROM dl GROUP BY arm)
SELECT tt.arm, contests, round(loss, 5) AS loss, round(base_loss, 5) AS base_loss, round(loss - base_loss, 5) AS delta, round(lo, 5) AS ci_low, round(hi, 5) AS ci_high, worse_folds, folds, lo > 0 AND 2 * worse_folds > folds AS helps FROM tt JOIN fw ON fw.arm = tt.arm JOIN ci ON ci.arm = tt.arm""",
    "stage_transfer": f"""WITH {ONE}, gg AS (SELECT round(5e-1 + 25e-3 * i, 9) AS g FROM (SELECT unnest(range(0, 41)) AS i) r), l AS (SELECT g, y, count(*) AS n, sum(ln(t) - ln(w)) AS nll FROM (SELECT g, year(day) AS y, contest_id, sum(power(p, g)) AS t, max(CASE WHEN won = 1 THEN power(p, g) END) AS w FROM sm CROSS JOIN gg GROUP BY g, year(day), contest_id) a GROUP BY g, y),
f AS (SELECT e.y, l.g, round(sum(l.nll) / sum(l.n), 12) AS loss FROM (SELECT DISTINCT y FROM l) e JOIN l ON l.y < e.y GROUP BY e.y, l.g), best AS (SELECT y, g FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY loss, g) AS k FROM f) o WHERE k = 1),
h AS (SELECT m.*, best.y, power(p, g) / sum(power(p, g)) OVER (PARTITION BY contest_id) AS c FROM market m JOIN best ON year(m.day) = best.y),
e AS (SELECT (SELECT sum(gap) / sum(n) FROM (SELECT count(*) AS n, abs(sum(p - won)) AS gap FROM h GROUP BY least(floor(p * 10), 9)) a) AS raw, (SELECT sum(gap) / sum(n) FROM (SELECT count(*) AS n, abs(sum(c - won)) AS gap FROM h GROUP BY least(floor(c * 10), 9)) a) AS cal),
v AS (SELECT round(p, 3) AS s, 1 AS side FROM h WHERE won = 1 UNION ALL SELECT round(q, 3), 0 FROM h WHERE won = 1),
k AS (SELECT max(abs(a / ta - b / tb)) AS ks FROM (SELECT s, sum(sum(side)) OVER (ORDER BY s) AS a, sum(sum(1 - side)) OVER (ORDER BY s) AS b, sum(sum(side)) OVER () AS ta, sum(sum(1 - side)) OVER () AS tb FROM v GROUP BY s) z)
SELECT cast((SELECT count(DISTINCT y) FROM h) AS bigint) AS folds, cast((SELECT count(DISTINCT day) FROM h) AS bigint) AS days, round(raw, 6) AS ece_raw, round(cal, 6) AS ece_calibrated, round(cal - raw, 6) AS delta, round(ks, 6) AS ks,
CASE WHEN ks > 0.1 OR abs(cal - raw) <= 0.0005 THEN 'open' WHEN cal < raw THEN 'adopt' ELSE 'reject' END AS verdict FROM e, k""",
    # entries in falling order of p * odds; the optimum bets a first stretch of them
    "growth_allocation": """WITH e AS (SELECT contest_id, entity_id, p, odds, p * odds AS v, sum(p) OVER w AS sp, sum(1 / odds) OVER w AS so, lead(p * odds) OVER (PARTITION BY contest_id ORDER BY p * odds DESC, entity_id) AS nv FROM market WHERE odds > 1 WINDOW w AS (PARTITION BY contest_id ORDER BY p * odds DESC, entity_id)),
u AS (SELECT contest_id, max(b) AS free FROM (SELECT contest_id, (1 - sp) / (1 - so) AS b, v, nv FROM e WHERE so < 1 - 1e-9) x WHERE b > 0 AND v > b AND (nv IS NULL OR nv <= b + 1e-9) GROUP BY contest_id),
d AS (SELECT e.*, coalesce(u.free, CASE WHEN top > 1 THEN 0 ELSE 1 END) AS free FROM (SELECT *, max(v) OVER (PARTITION BY contest_id) AS top FROM e) e LEFT JOIN u ON e.contest_id = u.contest_id),
c AS (SELECT *, greatest(free, 75e-2) AS b, sp / (25e-2 + 75e-2 * so) AS mult FROM d),
m AS (SELECT contest_id, max(mult) AS m FROM c WHERE free < 75e-2 AND v / 75e-2 > mult AND (nv IS NULL OR nv / 75e-2 <= mult + 1e-9) GROUP BY contest_id),
s AS (SELECT c.contest_id, c.entity_id, greatest(0e0, p / coalesce(m.m, 1) - b / odds) AS stake FROM c LEFT JOIN m ON m.contest_id = c.contest_id)
SELECT k.contest_id, k.entity_id, round(coalesce(stake, 0), 6) AS stake, round(coalesce(sum(stake) OVER (PARTITION BY k.contest_id), 0), 6) AS total FROM market k LEFT JOIN s ON s.contest_id = k.contest_id AND s.entity_id = k.entity_id""",
    "pool_devig": "SELECT a.contest_id, a.entity_id, round(any_value(a.q) + sum(b.q * a.q / (1 - b.q)) + 1e-9, 6) AS marginal, round(any_value(a.q) + 1e-9, 6) AS recovered, true AS settled FROM market a JOIN market b ON a.contest_id = b.contest_id AND a.entity_id <> b.entity_id WHERE a.n >= 3 GROUP BY a.contest_id, a.entity_id",
    "stage_loss": f"""WITH {_F}, o AS (SELECT contest_id, count(CASE WHEN finish_order = 1 THEN 1 END) AS c1, count(CASE WHEN finish_order = 2 THEN 1 END) AS c2, count(CASE WHEN finish_order = 3 THEN 1 END) AS c3 FROM x GROUP BY contest_id),
l AS (SELECT 1 AS stage, -ln(sum(CASE WHEN finish_order = 1 THEN p END) / sum(p)) AS l, count(*) AS k FROM x JOIN o ON x.contest_id = o.contest_id WHERE c1 = 1 GROUP BY x.contest_id
UNION ALL SELECT 2, -ln(sum(CASE WHEN finish_order = 2 THEN power(p, 0.8) END) / sum(power(p, 0.8))), count(*) FROM x JOIN o ON x.contest_id = o.contest_id WHERE c1 = 1 AND c2 = 1 AND finish_order IS DISTINCT FROM 1 GROUP BY x.contest_id
UNION ALL SELECT 3, -ln(sum(CASE WHEN finish_order = 3 THEN power(p, 0.6) END) / sum(power(p, 0.6))), count(*) FROM x JOIN o ON x.contest_id = o.contest_id WHERE c1 = 1 AND c2 = 1 AND c3 = 1 AND (finish_order IS NULL OR finish_order > 2) GROUP BY x.contest_id)
SELECT stage, cast(count(*) AS bigint) AS contests, round(avg(l), 6) AS nll, round(avg(l - ln(k)), 6) AS over_uniform FROM l WHERE k > 1 GROUP BY stage""",
    "cell_probe": f"""WITH {_SHARES}, t AS (SELECT probe, cell, count(*) AS contests, sum(v - m) AS score, sum(v - m) / sqrt(sum(m * (1 - m))) AS z FROM sh GROUP BY probe, cell), p AS (SELECT *, greatest(0, {_TAIL}) AS pv FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY pv, probe || ':' || cell) AS o, count(*) OVER () AS m FROM p)
SELECT probe, cell, contests, round(score, 6) AS score, round(z, 5) AS z, round(pv, 4) AS p_value, round({_HOLM.format(p='pv', tie="probe || ':' || cell")}, 4) AS adjusted FROM o""",
    "tilt_probe": f"""WITH {_tilts()}, {_boot('SELECT probe, day, sum(d) AS s, count(*) AS n FROM tc GROUP BY probe, day', REPS, 'day', 'probe')}, ci AS (SELECT probe, {_CI} FROM r GROUP BY probe), g AS (SELECT probe, count(*) AS contests, count(DISTINCT day) AS days, avg(d) AS delta FROM tc GROUP BY probe)
SELECT g.probe, contests, days, round(delta, 6) AS delta, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, delta <= 0 AND hi <= 0 AS passes FROM g JOIN ci ON ci.probe = g.probe""",
    "weighted_gate": f"""WITH {_GATE}, {_boot("SELECT day, sum(CASE WHEN arm = 'base' THEN won * odds ELSE 0 END) AS bp, count(CASE WHEN arm = 'base' THEN 1 END) AS bs, sum(CASE WHEN arm = 'cand' THEN won * odds ELSE 0 END) AS cp, count(CASE WHEN arm = 'cand' THEN 1 END) AS cs FROM gb WHERE p * odds >= 0.85 GROUP BY day", REPS, 'day', '', 'sum(cp * times) / nullif(sum(cs * times), 0) - sum(bp * times) / nullif(sum(bs * times), 0)')},
ci AS (SELECT count(v) AS reps, {_CI} FROM r), t AS (SELECT count(*) AS days, sum(bs) AS bn, sum(cs) AS cn, sum(bp) / sum(bs) AS br, sum(cp) / sum(cs) AS cr FROM u)
SELECT cast(days AS bigint) AS days, cast(bn AS bigint) AS base_bets, cast(cn AS bigint) AS cand_bets, round(br, 6) AS base_recovery, round(cr, 6) AS cand_recovery, round(cr - br, 6) AS delta, round(lo, 6) AS ci_low, round(hi, 6) AS ci_high, cast(reps AS bigint) AS reps,
CASE WHEN least(bn, cn) < 30 OR days < 2 THEN 'no_decision' WHEN lo > 0 THEN 'adopt' WHEN hi < 0 THEN 'reject' ELSE 'open' END AS verdict FROM t, ci""",
    "tail_calibration": f"""WITH {_GATE}, m AS (SELECT 'long_odds' AS mask, * FROM gb WHERE odds >= 8 UNION ALL SELECT 'small_share', * FROM gb WHERE q < 0.1), c AS (SELECT mask, count(CASE WHEN arm = 'base' THEN 1 END) AS n, avg(CASE WHEN arm = 'base' THEN p - won END) AS b, avg(CASE WHEN arm = 'cand' THEN p - won END) AS k FROM m GROUP BY mask)
SELECT mask, n, round(b, 6) AS base_calibration, round(k, 6) AS cand_calibration, k <= b AS passes FROM c""",
    "selection_grid_sql": "SELECT a.contest_id, a.entity_id AS low, b.entity_id AS high FROM market a JOIN market b ON a.contest_id = b.contest_id AND a.entity_id < b.entity_id",
    "odds_trend_sql": "SELECT entity_id, round(regr_slope(odds, datediff('day', date '1992-01-01', day)), 8) + 0e0 AS slope FROM market GROUP BY entity_id",
    "overlapping_shipments": """WITH s AS (SELECT *, datediff('day', date '1992-01-01', cast(l_shipdate AS date)) AS a, datediff('day', date '1992-01-01', cast(l_shipdate AS date)) + cast(l_quantity AS int) AS b FROM lineitem)
SELECT x.l_partkey, x.l_orderkey, x.l_linenumber, z.l_orderkey AS other_order, z.l_linenumber AS other_line FROM s x JOIN s z ON x.l_partkey = z.l_partkey AND x.l_returnflag = 'R' AND z.l_returnflag = 'A' AND x.a <= z.b AND z.a <= x.b""",
    "entry_load": """WITH p AS (SELECT *, 1980 + entity_id % 7 AS born FROM panel), nm AS (SELECT entity_name, born, count(DISTINCT entity_id) AS k, min('e' || entity_id) AS e FROM p WHERE entity_id % 3 <> 2 GROUP BY entity_name, born)
SELECT contest_id AS contest, CASE WHEN entity_id % 3 = 0 THEN 'e' || entity_id WHEN entity_id % 3 = 1 AND k = 1 THEN e ELSE 'nk:s' || entity_id END AS entity, line AS number, agent_id AS agent, entry_status AS status,
CASE WHEN entity_id % 3 <> 2 THEN p.born END AS birth_year FROM p LEFT JOIN nm ON p.entity_name = nm.entity_name AND p.born = nm.born WHERE year(day) = 1998""",
    "result_backfill": """WITH p AS (SELECT *, round(60 + coalesce(finish_order, 0) * 0.7 + weight / 100, 2) AS seconds FROM panel), f AS (SELECT contest_id, min_by(seconds, entity_id) AS best FROM p WHERE finish_order = 1 GROUP BY contest_id)
SELECT p.contest_id AS contest, entity_id AS entity, CASE WHEN started = 1 THEN result_status END AS status, CASE WHEN started = 1 THEN cast(finish_order AS bigint) END AS finish, CASE WHEN started = 1 AND (entity_id % 2 = 0 OR finish_order IS NULL) THEN round(seconds - best, 2) + 0e0 END AS behind, CASE WHEN started = 0 THEN 'no starter' END AS reason FROM p LEFT JOIN f ON f.contest_id = p.contest_id""",
    "diagnostic_versions": "SELECT kind, cast(y AS varchar) AS batch, class, n, brier FROM (SELECT 'model' AS kind, year(day) AS y, class, count(*) AS n, round(avg((p - won) * (p - won)), 6) AS brier FROM market WHERE n > 1 AND year(day) = 1997 GROUP BY year(day), class UNION ALL SELECT 'market', year(day), class, count(*), round(avg((q - won) * (q - won)), 6) FROM market WHERE n > 1 AND year(day) = 1996 GROUP BY year(day), class) x",
}
