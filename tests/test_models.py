"""Fits, stakes, probes, gates, streams, loads and joins against brute force, planted effects and golden values."""

import datetime as dt
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.functions import sql as sql_functions
from furlong.operators import asof, availability, fits, growth, intervals, likelihood, oof, ordered, probes
from furlong.plans import blocks
from furlong.sources import core, versions
from furlong.streaming import quotes, windows

rng = np.random.default_rng(5)


def near(a, b, tol=1e-6):
    return abs(a - b) <= tol


# --- mended faults


def test_path_opens_at_zero(spark):
    df = spark.createDataFrame([("a", 1, -1.0), ("a", 2, -1.0), ("a", 3, 5.0), ("b", 1, 1.0), ("b", 2, -3.0)], "g string, k int, x double")
    assert {r.g: r.drawdown for r in ordered.drawdown(df, ["k"], F.col("x"), ["g"]).collect()} == {"a": 2.0, "b": 3.0}


def test_figures_of_cells_that_do_not_spread(spark):
    day = dt.date(2020, 1, 1)
    flat = [("flat", day + dt.timedelta(i), 123456789.1) for i in range(70)]
    wide = [("wide", day + dt.timedelta(i // 2), 1e6 + float(x)) for i, x in enumerate(rng.normal(size=140))]
    nulls = [(None, day + dt.timedelta(i), float(i % 3)) for i in range(60)] + [("wide", day + dt.timedelta(80), None)]
    rows = [(i, *r) for i, r in enumerate(flat + wide + nulls)]
    got = {r.i: r.z for r in asof.before_in_cell(spark.createDataFrame(rows, "i int, cell string, day date, v double"), ["cell"], "day", "v", least=50).collect()}
    assert len(got) == len(rows) and not any(got[i] is not None for i, c, *_ in rows if c == "flat")
    for i, c, d, v in rows:
        past = [w for _, k, e, w in rows if k == c and e < d and w is not None]
        if c == "flat" or v is None or len(past) < 50:
            assert got[i] is None
        else:
            assert near(got[i], np.clip((v - np.mean(past)) / np.std(past), -5, 5), 1e-5)


def test_matrix_keeps_rows_of_null_keys(spark):
    day = dt.date(2020, 1, 1)
    rows = [(c, e, day + dt.timedelta(c), None if e == 1 else 7, e, "1-A", 1, 10.0 * e, 5.0 + e, 2.0 * e, "finished", e, e, None if e == 2 else "v", None if e == 3 else "s", 1200, int(e == 1), int(e <= 2), 1, 1 / 3, 3) for c in range(3) for e in (1, 2, 3)]
    df = spark.createDataFrame(rows, "contest_id int, entity_id int, day date, agent_id int, owner_id int, class string, line int, price double, weight double, odds double, result_status string, finish_order int, popularity int, venue string, sire string, distance int, won int, top2 int, top3 int, q double, n int")
    out = blocks.asof_matrix(df)
    got = {(r.contest_id, r.entity_id): r for r in out.collect()}
    assert len(got) == 9 and len(out.columns) >= 72
    assert [got[c, 1].agent_starts for c in range(3)] == [0, 1, 2] and [got[c, 2].agent_starts for c in range(3)] == [0, 2, 4]
    assert got[2, 3].sire_starts == 2 and got[2, 2].venue_band_starts == 2 and got[2, 1].venue_band_starts == 4
    # nothing of the day or later is seen
    late = df.withColumn("won", F.when(F.col("contest_id") == 2, 1 - F.col("won")).otherwise(F.col("won"))).withColumn("finish_order", F.when(F.col("contest_id") == 2, 4 - F.col("finish_order")).otherwise(F.col("finish_order")))
    assert {tuple(r) for r in blocks.asof_matrix(late).collect()} == {tuple(r) for r in out.collect()}


def test_platt_of_sure_scores(spark):
    rows = [(p, int(rng.random() < q)) for p, q in ((0.0, 0.02), (1.0, 0.97), (0.3, 0.3), (0.6, 0.6)) for _ in range(200)]
    a, b = fits.fit_platt(spark.createDataFrame(rows, "p double, y int"), "p", "y")
    assert math.isfinite(a) and math.isfinite(b) and 0 < a < 1
    assert fits.fit_platt(spark.createDataFrame([(0.5, 1), (0.5, 0)], "p double, y int"), "p", "y") == (1.0, 0.0)


def test_softmax_says_how_it_ended(spark):
    rows = [(c, e, float(e == c % 3), int(e == c % 3), float(rng.normal())) for c in range(60) for e in range(3)]
    df = spark.createDataFrame(rows, "c int, e int, f double, won int, g double")
    assert fits.fit_softmax(df, "c", "won", ["f"], steps=40).status == "separable"
    fit = fits.fit_softmax(df, "c", "won", ["g"])
    assert fit.status == "fitted" and abs(fit.theta[0]) < 1
    assert fits.fit_softmax(df.filter("c < 0"), "c", "won", ["g"]).status == "no_samples"


def test_loads_of_null_keys_repeat(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, o int")
    new = spark.createDataFrame([(None, "n", 1), (None, "m", 2), (2, "b", 1)], "k int, v string, o int")
    once = core.insert_if_absent(old, new, ["k"], "o")
    assert sorted(map(str, core.insert_if_absent(once, new, ["k"], "o").collect())) == sorted(map(str, once.collect())) and once.count() == 3
    key = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(key, None)
    with core.wide_charsets(spark):
        assert spark.conf.get(key) == "true"
    assert spark.conf.get(key, None) == before


# --- fits


def sequential(theta, n, field=6, ties=0.0):
    rows = []
    for c in range(n):
        f = rng.normal(size=(field, len(theta)))
        left, order = list(range(field)), {}
        for k in range(1, 4):
            w = np.exp(f[left] @ theta)
            order[left.pop(rng.choice(len(left), p=w / w.sum()))] = k
        if rng.random() < ties:
            order = {e: max(k - 1, 1) for e, k in order.items()}
        rows += [(c, e, order.get(e), c * 6 // n, *map(float, f[e])) for e in range(field)]
    return rows


def test_sequential_likelihood(spark):
    rows = sequential(np.array([0.8, -0.5]), 700, ties=0.1)
    df = spark.createDataFrame(rows, "c int, e int, o int, y int, a double, b double")
    st = likelihood.stages(df, "c", "o", ["a", "b"], "y")
    top, one = (likelihood.fit_candidates(likelihood.stages(df, "c", "o", ["a", "b"], "y", depth=k), 2, [likelihood.Candidate()])[0] for k in (3, 1))
    assert top.status == one.status == "fitted" and np.abs(top.theta - [0.8, -0.5]).max() < 0.12
    n, loss, g, h = likelihood.newton_sums(st, 2, {0: top.theta}, {0: F.lit(True)})[0]
    brute = 0.0
    for c in range(700):
        own = [r for r in rows if r[0] == c]
        orders = [r[2] for r in own]
        for k in range(1, 4):
            if any(orders.count(j) != 1 for j in range(1, k + 1)):
                break
            left = [r for r in own if r[2] is None or r[2] >= k]
            u = {r[1]: float(np.dot(r[4:], top.theta)) for r in left}
            brute += next(u[r[1]] for r in left if r[2] == k) - math.log(sum(map(math.exp, u.values())))
    assert near(loss, brute, 1e-6) and np.abs(g).max() / n < 1e-8 and np.linalg.eigvalsh(h).min() > 0
    step = likelihood.newton_sums(st, 2, {0: top.theta + [1e-5, 0]}, {0: F.lit(True)})[0]
    assert near((step[2][0] - g[0]) / 1e-5, -h[0][0], 1e-2 * h[0][0])


def test_sequential_edges(spark):
    rows = [(1, 1, 1, 0.0), (1, 2, 2, 1.0), (2, 1, 1, 0.0), (3, 1, 1, 0.0), (3, 2, 1, 1.0), (4, 1, 1, None), (4, 2, 2, 1.0), (None, 1, 1, 1.0), (5, 1, None, 1.0), (5, 2, None, 0.0)]
    st = likelihood.stages(spark.createDataFrame(rows, "c int, e int, o int, a double"), "c", "o", ["a"])
    assert {(r.contest, r.stage) for r in st.collect()} == {(1, 1)}
    assert likelihood.fit_candidates(st.filter("contest < 0"), 1, [likelihood.Candidate()])[0].status == "no_samples"
    sure = spark.createDataFrame([(c, e, 1 + (e != c % 2), float(e == c % 2)) for c in range(30) for e in range(2)], "c int, e int, o int, a double")
    assert likelihood.fit_candidates(likelihood.stages(sure, "c", "o", ["a"]), 1, [likelihood.Candidate()], steps=60)[0].status == "separable"


def test_ridge_search_equals_single_fits(spark):
    df = spark.createDataFrame(sequential(np.array([0.5, 0.0]), 240), "c int, e int, o int, y int, a double, b double")
    st = likelihood.stages(df, "c", "o", ["a", "b"], "y", depth=1)
    got = likelihood.search_ridge(st, 2, [0.0, 0.1, 10.0], [2, 4])
    for ridge, fold, n, loss, status, theta in got.rows:
        own = likelihood.fit_candidates(st.filter(F.col("fold") < fold), 2, [likelihood.Candidate(None, ridge)])[0]
        assert status == "fitted" and np.allclose(own.theta, theta, atol=1e-8)
        assert near(loss * n, -likelihood.newton_sums(st.filter(F.col("fold") == fold), 2, {0: theta}, {0: F.lit(True)})[0][1], 1e-8)
    mean = {r: np.mean([x[3] for x in got.rows if x[0] == r]) for r in (0.0, 0.1, 10.0)}
    assert got.ridge == min(mean, key=mean.get) and likelihood.search_ridge(st.filter("fold > 9"), 2, [0.0], [2]).ridge is None


def test_ablation_finds_the_group_that_helps(spark):
    rows = [(c, e, dt.date(2020, 1, 1) + dt.timedelta(c // 3), o, y, a, b) for c, e, o, y, a, b in sequential(np.array([1.2, 0.0]), 420)]
    df = spark.createDataFrame(rows, "c int, e int, d date, o int, y int, a double, b double")
    table = oof.oof_table(df, "c", "e", "d", "o", "y", ["a", "b"], {"full": ["a", "b"], "no_a": ["b"], "no_b": ["a"], "none": []})
    sums = table.groupBy("arm", "contest").agg(F.sum("p").alias("s"), F.min("fold").alias("f")).collect()
    assert all(near(r.s, 1, 1e-9) for r in sums) and {r.f for r in sums} == {1, 2, 3, 4, 5}
    got = {r.arm: r for r in oof.arm_deltas(table, "full", 200).collect()}
    assert got["no_a"].helps and got["none"].helps and not got["no_b"].helps and near(got["none"].loss, math.log(6), 1e-9)
    assert got["no_a"].ci_low <= got["no_a"].delta <= got["no_a"].ci_high and got["no_a"].worse_folds == got["no_a"].folds == 5
    with pytest.raises(ValueError, match="no such"):
        oof.oof_table(df, "c", "e", "d", "o", "y", ["a"], {"x": ["q"]})
    one = table.filter("arm = 'full'").drop("arm")
    same = oof.transfer_check(one, one, least_days=1).first()
    assert same.ks == 0 and same.folds == 4 and oof.transfer_check(one.filter("fold = 1"), one).first().verdict == "no_decision"


# --- stakes and pools


def gain(p, o, f):
    return sum(a * math.log(1 - sum(f) + b * c) for a, b, c in zip(p, o, f, strict=True)) + max(0, 1 - sum(p)) * math.log(1 - sum(f))


def test_growth_stakes(spark):
    fields = [([0.5, 0.3, 0.2], [3.0, 2.5, 4.0]), ([0.6, 0.4], [2.5, 2.5]), ([0.2, 0.2, 0.1], [4.0, 6.0, 9.0]), ([0.4, 0.3, 0.3], [2.0, 3.0, 3.2]), ([0.9, 0.05, 0.05], [1.2, 30.0, 15.0])]
    rows = [(c, e, x, y) for c, (p, o) in enumerate(fields) for e, (x, y) in enumerate(zip(p, o, strict=True))]
    rows += [(90, 0, None, 2.0), (90, 1, 0.5, None), (90, 2, 0.7, 1.0), (91, 0, 1.5, 3.0), (91, 1, 1.5, 2.0)]
    df = spark.createDataFrame(rows, "c int, e int, p double, o double")
    for cap in (0.25, 0.9):
        got = {(r.c, r.e): r for r in growth.growth_stakes(df, "c", "e", "p", "o", cap).collect()}
        assert len(got) == len(rows)
        for c, (p, o) in enumerate(fields):
            f = [got[c, e].stake for e in range(len(p))]
            assert sum(f) <= cap + 1e-9 and near(got[c, 0].total, sum(f), 1e-9) and near(got[c, 0].growth, gain(p, o, f), 1e-9)
            steps = np.linspace(0, cap, 26 if len(p) == 3 else 200)
            best = max(gain(p, o, g) for g in itertools.product(steps, repeat=len(p)) if sum(g) <= cap + 1e-12 and sum(g) < 1)
            assert got[c, 0].growth >= best - 1e-12
            # optimality: no bet has a better margin than those held, which share one
            b, wins = 1 - sum(f), [1 - sum(f) + x * y for x, y in zip(f, o, strict=True)]
            margin = [x * y / w for x, y, w in zip(p, o, wins, strict=True)]
            held = [m for m, x in zip(margin, f, strict=True) if x > 1e-9]
            assert not held or (max(held) - min(held) < 1e-6 and max(margin) < max(held) + 1e-6)
        assert [got[90, e].stake for e in range(3)] == [0, 0, 0] and got[91, 0].total > 0
    assert growth.growth_stakes(df.filter("c < 0"), "c", "e", "p", "o").count() == 0
    with pytest.raises(ValueError, match="cap"):
        growth.growth_stakes(df, "c", "e", "p", "o", 1.0)


def test_pool_probabilities(spark):
    rows, true = [], {}
    for c in range(20):
        p = rng.dirichlet(np.ones(int(rng.integers(3, 8))))
        true |= {(c, e): x for e, x in enumerate(p)}
        rows += [(c, a, b, float(7 * (p[a] * p[b] / (1 - p[a]) + p[b] * p[a] / (1 - p[b])))) for a, b in itertools.combinations(range(len(p)), 2)]
    rows += [(50, 0, 1, 2.0), (51, 0, 1, None), (52, 0, 1, 1.0), (52, 0, 2, -3.0), (52, 1, 2, 1.0)]
    out = growth.pool_probabilities(spark.createDataFrame(rows, "c int, a int, b int, s double"), "c", "a", "b", "s").collect()
    got = {(r.c, r.entity): r for r in out}
    assert all(got[k].gap < 1e-6 and near(got[k].p, x, 1e-4) for k, x in true.items())
    assert near(got[50, 0].p, 0.5) and (51, 0) not in got and near(sum(got[52, e].p for e in range(3)), 1)


def test_stage_losses(spark):
    rows = [("x", 1, 0.5, 1), ("x", 2, 0.3, 2), ("x", 3, 0.2, None), ("y", 1, 0.6, 1), ("y", 2, 0.4, 1)]
    got = {r.stage: r for r in growth.stage_losses(spark.createDataFrame(rows, "c string, e int, p double, o int"), "c", "p", "o").collect()}
    assert near(got[1].nll, -math.log(0.5)) and near(got[2].nll, -math.log(0.6)) and near(got[2].over_uniform, -math.log(0.6) - math.log(2)) and got[1].contests == 1 and got[3].contests == 0


# --- probes and gates


def test_probes_find_the_planted_cell(spark):
    rows = []
    for c in range(1500):
        p = rng.dirichlet(np.ones(6) * 3)
        kinds = rng.choice(["plain", "boosted", "null"], 6)
        w = p * np.where(kinds == "boosted", 1.6, 1.0)
        win = rng.choice(6, p=w / w.sum())
        side = rng.choice(["l", "r"], 6)
        for e in range(6):
            for probe, cell in (("kind", None if kinds[e] == "null" else str(kinds[e])), ("side", str(side[e]))):
                rows.append((c, dt.date(2020, 1, 1) + dt.timedelta(c // 3), c // 300, float(p[e]), int(e == win), probe, cell))
    df = spark.createDataFrame(rows, "c int, d date, y int, p double, won int, probe string, cell string")
    tests = {(r.probe, r.cell): r for r in probes.cell_tests(probes.cell_shares(df, "c", "p", "won", "probe", "cell", [])).collect()}
    assert tests["kind", "boosted"].adjusted < 1e-3 and tests["kind", "boosted"].z > 4 and tests["side", "l"].adjusted > 0.05
    own = [(r[0], r[3], r[4]) for r in rows if r[5] == "kind" and r[6] == "boosted"]
    score = sum(w for *_, w in own) - sum(p for _, p, _ in own)
    whole = {c for c in range(1500) if sum(1 for x in own if x[0] == c) == 6}
    assert near(tests["kind", "boosted"].score, score - sum(w - p for c, p, w in own if c in whole), 1e-6)
    got = {r.probe: r for r in probes.run_probe(df, "c", "d", "y", "p", "won", "probe", "cell", 200).collect()}
    assert got["kind"].passes and got["kind"].delta < -0.005 and not got["side"].passes and got["kind"].contests == 1200


def test_normal_tail(spark):
    z = [0.0, 0.5, 1.959964, 3.0, -2.5]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(probes.normal_tail(F.col("z"))).collect()]
    assert all(near(g, math.erfc(abs(x) / math.sqrt(2)), 2e-7) for g, x in zip(got, z, strict=True))


def test_paired_gate(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    rows = [("base", day(i % 60), 1.0, 0.8 + 0.1 * math.sin(i)) for i in range(300)] + [("cand", day(i % 60), 1.0, 1.1 + 0.1 * math.sin(i)) for i in range(200)]
    rows += [("cand", None, 1.0, 9.0), ("base", day(1), None, 1.0), ("other", day(2), 1.0, 50.0)]
    df = spark.createDataFrame(rows, "arm string, day date, stake double, payout double")
    r = probes.paired_gate(df, "base", "cand", reps=300).first()
    assert r.verdict == "adopt" and r.days == 60 and (r.base_bets, r.cand_bets) == (300, 200) and 0.25 < r.ci_low <= r.delta <= r.ci_high
    assert probes.paired_gate(df, "cand", "base", reps=300).first().verdict == "reject"
    assert probes.paired_gate(df.filter("day = '2020-01-01'"), "base", "cand", reps=50).first().verdict == "no_decision"
    assert probes.paired_gate(df.withColumn("payout", F.col("day").isNotNull().cast("double")), "base", "cand", reps=50).first().verdict == "open"


def test_tail_guard(spark):
    rows = [("base", 0.1, 0, 12.0), ("base", 0.3, 1, 12.0), ("cand", 0.3, 0, 12.0), ("cand", 0.5, 1, 12.0), ("base", 0.2, 0, 2.0), ("cand", 0.1, 0, 2.0), ("base", 0.1, 0, 99.0)]
    df = spark.createDataFrame(rows, "arm string, p double, won int, odds double")
    masks = {"long": (F.col("odds") >= 10) & (F.col("odds") < 50), "short": F.col("odds") < 3, "none": F.col("odds") < 0, "single": F.col("odds") > 50}
    got = {r["mask"]: r.passes for r in probes.tail_guard(df, "base", "cand", masks, 0.05).collect()}
    assert got == {"long": False, "short": True, "single": False}


def test_type_gate(spark):
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i % 50)
    rows = [("good", day(i), 0.5 + 0.1 * math.cos(i)) for i in range(100)] + [("bad", day(i), -0.5) for i in range(100)] + [("few", day(i), 3.0) for i in range(9)] + [("new", day(i), 3.0) for i in range(90)] + [("good", day(1), None)]
    got = {r.bet_type: r for r in probes.type_gate(spark.createDataFrame(rows, "bet_type string, day date, diff double"), {"good": 50, "bad": 50, "few": 50}, reps=200).collect()}
    assert {k: r.verdict for k, r in got.items()} == {"good": "adopt", "bad": "reject", "few": "no_decision", "new": "no_decision"}
    assert got["bad"].adjusted == 1 and got["good"].adjusted < 0.05 and got["few"].ci_low is None


# --- availability


def test_availability(spark):
    rows = spark.createDataFrame([(1, 2.0, 3.0, 1, 4.0)], "k int, a double, b double, won int, odds double")
    df = rows.select("k", availability.tagged(F.col("a"), "a", "results", "as_of", "zero"), availability.tagged(F.col("b"), "b", "entries", "entry", "prior"), availability.tagged(F.col("won"), "won", "results", "result"), availability.tagged(F.col("odds"), "odds", "market", "market"))
    assert availability.model_inputs(df) == ["a", "b"] and availability.model_inputs(df, "market") == ["a", "b", "odds"] and availability.model_inputs(df, "entry") == ["b"]
    joined = df.join(rows.select("k", F.lit(1).alias("z")), "k").filter("k = 1")
    assert availability.select_inputs(joined, ["b", "a"], ["k"]).columns == ["k", "b", "a"]
    for bad in ("won", "odds", "z", "nowhere"):
        with pytest.raises(availability.AvailabilityError, match=bad):
            availability.select_inputs(joined, ["a", bad], ["k"])
    with pytest.raises(availability.AvailabilityError):
        availability.model_inputs(df, "result")
    with pytest.raises(availability.AvailabilityError):
        availability.tagged(F.col("a"), "a", "x", "sometime")
    gaps = df.select(*[F.when(F.lit(False), F.col(c)).alias(c, metadata=df.schema[c].metadata) if c != "k" else F.col(c) for c in df.columns])
    assert availability.filled(gaps, {"b": 0.5}).first().asDict() == {"k": 1, "a": 0.0, "b": 0.5, "won": None, "odds": None}
    with pytest.raises(availability.AvailabilityError, match="prior"):
        availability.filled(gaps)


# --- interval joins


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("width", [1.0, 7.0, 1000.0])
def test_interval_join(spark, closed, width):
    def some(n, base):
        out = []
        for i in range(n):
            lo = int(rng.integers(-50, 150))
            hi = lo + int(rng.choice([0, 1, 3, 200, 5000, -2]))
            k = [1, 1, 1, 2, None][int(rng.integers(5))]
            out.append((base + i, k, None if rng.random() < 0.1 else float(lo), None if rng.random() < 0.1 else float(hi)))
        return out + [(base + n, 1, 5.0, 10.0), (base + n + 1, 1, 10.0, 12.0), (base + n + 2, 2, float("nan"), 3.0)]

    a, b = some(70, 0), some(60, 1000)
    left = spark.createDataFrame(a, "i int, k int, lo double, hi double")
    right = spark.createDataFrame(b, "j int, k int, x double, z double")
    got = sorted((r.i, r.j) for r in intervals.interval_join(left, right, "lo", "hi", "x", "z", width, ["k"], closed).collect())

    def meets(p, q):
        (_, k, lo, hi), (_, m, x, z) = p, q
        lo, hi, x, z = (-math.inf if lo is None else lo), (math.inf if hi is None else hi), (-math.inf if x is None else x), (math.inf if z is None else z)
        if k is None or k != m or any(map(math.isnan, (lo, hi, x, z))) or (lo > hi or x > z if closed else lo >= hi or x >= z):
            return False
        return lo <= z and x <= hi if closed else lo < z and x < hi

    assert got == sorted((p[0], q[0]) for p in a for q in b if meets(p, q))


def test_interval_join_edges(spark):
    left = spark.createDataFrame([(1, 0.0, 1.0)], "i int, lo double, hi double")
    right = spark.createDataFrame([(1, 1.0, 2.0)], "j int, x double, z double")
    assert intervals.interval_join(left, right, "lo", "hi", "x", "z", 1.0).count() == 1
    assert intervals.interval_join(left.filter("i < 0"), right, "lo", "hi", "x", "z", 1.0).count() == 0
    with pytest.raises(ValueError, match="rename"):
        intervals.interval_join(left, left, "lo", "hi", "lo", "hi", 1.0)


# --- streams


def put(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


EVENT = "ts timestamp, k string, v double"


def test_late_rows_are_dropped(spark, tmp_path):
    src = lambda: spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    make = lambda: windows.windowed(src(), "ts", "10 minutes", ["k"], {"n": F.count("*")}, "10 minutes")
    put(spark, f"{tmp_path}/in", "a", [(at(1), "a", 1.0), (at(3), "a", 1.0), (at(45), "a", 1.0), (None, "a", 1.0)], EVENT)
    first = windows.drain(make(), f"{tmp_path}/out").collect()
    assert [(r.start, r.n) for r in first] == [(at(0), 2)]
    put(spark, f"{tmp_path}/in", "b", [(at(2), "a", 1.0), (at(41), "a", 1.0), (at(90), None, 1.0)], EVENT)
    again = sorted((r.start, r.k, r.n) for r in windows.drain(make(), f"{tmp_path}/out").collect())
    assert again == [(at(0), "a", 2), (at(40), "a", 2)]  # the row of minute 2 came behind the watermark of minute 35
    assert windows.drain(make(), f"{tmp_path}/out").count() == 2


def test_updates_and_sessions(spark, tmp_path):
    put(spark, f"{tmp_path}/in", "a", [(at(0), "a", 1.0), (at(4), "a", 2.0), (at(30), "a", 4.0), (at(2), "b", 8.0)], EVENT)
    src = lambda: spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    slide = lambda: windows.windowed(src(), "ts", "1 hour", [], {"t": F.sum("v")}, "20 minutes", "10 minutes")
    up = {r.start: r.t for r in windows.drain_updates(slide(), ["start", "end"], f"{tmp_path}/u").collect()}
    assert up == {at(-10): 11.0, at(0): 11.0, at(20): 4.0, at(30): 4.0}
    put(spark, f"{tmp_path}/in", "b", [(at(5), "b", 16.0)], EVENT)
    up = {r.start: r.t for r in windows.drain_updates(slide(), ["start", "end"], f"{tmp_path}/u").collect()}
    assert up == {at(-10): 27.0, at(0): 27.0, at(20): 4.0, at(30): 4.0}
    got = windows.drain(windows.sessions(src(), "ts", "5 minutes", ["k"], {"t": F.sum("v")}, "10 minutes"), f"{tmp_path}/s").collect()
    assert {(r.k, r.start, r.end, r.t) for r in got} == {("a", at(0), at(14), 3.0), ("b", at(2), at(15), 24.0)}


def test_stream_join(spark, tmp_path):
    put(spark, f"{tmp_path}/l", "a", [(at(0), "a", 1.0), (at(10), "a", 2.0), (at(0), None, 3.0)], EVENT)
    put(spark, f"{tmp_path}/r", "a", [(at(0), "a", 10.0), (at(15), "a", 20.0), (at(30), "a", 30.0), (at(5), None, 40.0)], EVENT)
    read = lambda s, *names: spark.readStream.schema(EVENT).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/{s}").toDF(*names)
    out = windows.drain(windows.followed(read("l", "t1", "k", "x"), read("r", "t2", "k", "y"), "k", "t1", "t2", "15 minutes", "1 hour"), f"{tmp_path}/out")
    assert {(r.x, r.y) for r in out.collect()} == {(1.0, 10.0), (1.0, 20.0), (2.0, 20.0)}


def test_keyed_state_survives_reruns(spark, tmp_path):
    schema = "k string, t int, v double"
    src = lambda: spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    run = lambda: {r.k: (r.state, r["at"]) for r in quotes.keyed_state(src(), ["k"], F.col("v"), F.col("t"), f"{tmp_path}/out", buckets=4).collect()}
    want = {}
    for i in range(5):
        rows = [(None if k == 9 else f"k{k}", int(rng.integers(100)) * 10 + i, float(rng.random())) for k in rng.integers(0, 10, 6)]
        put(spark, f"{tmp_path}/in", f"b{i}", rows, schema)
        for k, t, v in rows:
            want[k] = max(want.get(k, (-1, 0)), (t, v))
        assert run() == {k: (v, t) for k, (t, v) in want.items()} or len({r[:2] for r in rows}) < len(rows)
        assert run() == run()
    kept = [p for p in (tmp_path / "out").glob("v*/bucket=*")]
    assert 0 < len(kept) <= 8


# --- versions and loads


def test_versions_repeat(spark, tmp_path):
    row = lambda v: spark.createDataFrame([(v, None)], "v int, n string")
    versions.append_batch(row(1), str(tmp_path), "a", "b1", 1)
    versions.append_batch(row(2), str(tmp_path), "a", "b2", 2)
    versions.append_batch(row(3), str(tmp_path), "z", "b1", 1)
    read = lambda: versions.versions(spark, str(tmp_path), "v int, n string")
    assert {(r.kind, r.v) for r in versions.latest(read()).collect()} == {("a", 2), ("z", 3)}
    versions.append_batch(row(2), str(tmp_path), "a", "b2", 2)
    assert read().count() == 3 and {(r.kind, r.batch, r.v) for r in read().collect()} == {("a", "b1", 1), ("a", "b2", 2), ("z", "b1", 3)}


def test_entries_and_results(spark):
    day = dt.date(2021, 5, 1)
    contests = spark.createDataFrame([("c0", day, "G1")], "contest string, day date, class string")
    entities = spark.createDataFrame([("e1", "Ann", 2018), ("e2", "Bob", 2018), ("e3", "Bob", 2018), ("e4", "Cid", None)], "entity string, name string, birth_year int")
    entries = spark.createDataFrame([("c0", "e1", 1, "j", "started")], "contest string, entity string, number int, agent string, status string")
    ids = spark.createDataFrame([("s9", "e9", "mapped"), ("s1", "e0", "conflict")], "source_id string, canonical_id string, status string")
    rows = [("c1", day, "A", "s1", "Ann", 3, 1, None, None, 1), ("c1", day, "B", "s2", "Bob", 3, 2, "j", None, 2), ("c1", day, "B", "s9", "New", None, 3, "j", "cancelled", 3), ("c1", day, "B", "s4", None, 3, 4, "j", None, 4),
            (None, day, "B", "s5", "x", 3, 5, "j", None, 5), ("c0", day, "G2", "s1", "Ann", 3, 7, "k", None, 6), ("c1", day, "C", None, "x", 3, 5, "j", None, 7)]
    new = spark.createDataFrame(rows, "contest string, day date, class string, source_id string, name string, age int, number int, agent string, status string, line int")
    once = versions.load_entries(new, contests, entities, entries, ids)
    got = {(r.contest, r.entity): (r.number, r.agent, r.status) for r in once["entries"].collect()}
    assert got == {("c0", "e1"): (7, "k", "started"), ("c1", "e1"): (1, None, "started"), ("c1", "nk:s2"): (2, "j", "started"), ("c1", "e9"): (3, "j", "cancelled"), ("c1", "nk:s4"): (4, "j", "started")}
    assert {(r.contest, r["class"]) for r in once["contests"].collect()} == {("c0", "G2"), ("c1", "B")}
    assert {(r.entity, r.birth_year) for r in once["entities"].collect()} >= {("e1", 2018), ("e9", None), ("nk:s2", 2018), ("nk:s4", 2018)}
    twice = versions.load_entries(new, once["contests"], once["entities"], once["entries"], ids)
    assert all(sorted(map(str, twice[k].collect())) == sorted(map(str, once[k].collect())) for k in once)

    have = spark.createDataFrame([("c1", "e1", "finished", 2, 70.0, 9.0)], "contest string, entity string, status string, finish int, seconds double, behind double")
    runs = [("c1", "e1", "finished", 1, 60.0, 1), ("c1", "nk:s2", "finished", 2, 61.5, 2), ("c1", "nk:s4", "finished", None, 62.0, 3), ("c1", "e9", "finished", 3, 63.0, 4), ("c7", "e1", "finished", 1, 1.0, 5)]
    scraped = spark.createDataFrame(runs, "contest string, entity string, status string, finish int, seconds double, line int")
    done, refused = versions.backfill_results(have, scraped, once["entries"])
    assert {(r.entity, r.finish, r.behind) for r in done.collect()} == {("e1", 2, 9.0), ("nk:s2", 2, 1.5)}
    assert {(r.contest, r.entity, r.reason) for r in refused.collect()} == {("c1", "nk:s4", "finished without an order"), ("c1", "e9", "no starter"), ("c7", "e1", "no starter")}
    assert sorted(map(str, versions.backfill_results(done, scraped, once["entries"])[0].collect())) == sorted(map(str, done.collect()))


# --- functions in SQL


def test_functions_in_sql(spark):
    sql_functions.register(spark)
    df = spark.createDataFrame([(1, [3, 1, 2, 1, None]), (2, None), (3, []), (4, [5])], "i int, ids array<long>")
    got = [(r.i, tuple(r.selection)) for r in spark.sql("SELECT i, selection FROM {df}, LATERAL selection_grid(ids, 2, false)", df=df).collect()]
    assert sorted(got) == [(1, (1, 2)), (1, (1, 3)), (1, (2, 3))]
    assert spark.sql("SELECT * FROM {df}, LATERAL selection_grid(ids, 3, true)", df=df).count() == 6
    rows = [("a", 1.0, 2.0), ("a", 2.0, 4.5), ("a", 4.0, 8.0), ("a", None, 1.0), ("b", 1.0, 1.0), ("c", 2.0, 1.0), ("c", 2.0, 5.0), (None, 0.0, 0.0), (None, 1.0, 3.0), ("d", None, None)]
    t = {r.g: r.s for r in spark.sql("SELECT g, ols_trend(x, y) AS s FROM {d} GROUP BY g", d=spark.createDataFrame(rows, "g string, x double, y double")).collect()}
    assert near(t["a"], np.polyfit([1, 2, 4], [2, 4.5, 8], 1)[0]) and t["b"] is None and t["c"] is None and t["d"] is None and near(t[None], 3)
