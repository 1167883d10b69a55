"""Operators against brute force, golden values and leak checks on small tables."""

import datetime as dt
import math
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from furlong.functions import text as t
from furlong.operators import betting, bootstrap, fits, joint, metrics, ordered, rating
from furlong.plans import blocks
from furlong.sources import core, store

rng = np.random.default_rng(11)
ABC = [("c", "A", 0.5), ("c", "B", 0.3), ("c", "C", 0.2)]


@pytest.fixture(scope="module")
def abc(spark):
    return spark.createDataFrame(ABC, "contest_id string, entity_id string, p double")


def test_golden_three(abc):
    pair = {r["first"] + r["second"]: r.prob for r in joint.exacta(abc).collect()}
    want = {"AB": 0.30, "AC": 0.20, "BA": 3 / 14, "BC": 3 / 35, "CA": 0.125, "CB": 0.075}
    assert pair.keys() == want.keys() and all(math.isclose(pair[k], v) for k, v in want.items())
    both = {r.low + r.high: r.prob for r in joint.quinella(abc).collect()}
    assert math.isclose(both["AC"], 0.325) and math.isclose(joint.trio(abc).first().prob, 1)
    assert joint.place(abc).count() == 0 and joint.consistency(abc).first().fails == 0
    assert all(math.isclose(r.prob, 1) for r in joint.wide(abc).collect())
    m = {r.entity_id: (r.win, r.top2, r.top3) for r in joint.marginals(abc).collect()}
    assert math.isclose(m["A"][1], 0.5 + 3 / 14 + 0.125) and m["A"][2] == 1 and math.isclose(sum(x[1] for x in m.values()), 2)


def test_small_fields(spark):
    df = spark.createDataFrame([("x", "A", 1.0), ("y", "A", 0.6), ("y", "B", 0.4)], "contest_id string, entity_id string, p double")
    m = {(r.contest_id, r.entity_id): (r.win, r.top2, r.top3) for r in joint.marginals(df).collect()}
    assert m == {("x", "A"): (1, 1, 1), ("y", "A"): (0.6, 1, 1), ("y", "B"): (0.4, 1, 1)}
    assert [(r.low, r.high, r.prob) for r in joint.wide(df).collect()] == [("A", "B", 1.0)]
    n = joint.normalise_clip(df.withColumn("v", F.lit(0.0)), "contest_id", "v", "o").collect()
    assert sorted(r.o for r in n) == [0.5, 0.5, 1.0]


def test_running_sums_and_paths(spark):
    rows = [(int(g), int(k), float(x)) for g, k, x in zip(rng.integers(0, 3, 300), rng.permutation(300), rng.normal(size=300), strict=True)]
    df = spark.createDataFrame(rows, "g int, k int, x double").repartition(7)
    got = {(r.g, r.k): r.s for r in ordered.running(df, ["k"], {"s": F.col("x")}, ["g"]).collect()}
    dd = {r.g: (r.drawdown, r.lowest, r.highest) for r in ordered.drawdown(df, ["k"], F.col("x"), ["g"]).collect()}
    runs = {r.g: r.longest for r in ordered.longest_run(df, ["k"], F.col("x") > 0, ["g"]).collect()}
    for g in range(3):
        own = sorted((k, x) for h, k, x in rows if h == g)
        path = np.cumsum([x for _, x in own])
        assert all(math.isclose(got[g, k], p, abs_tol=1e-9) for (k, _), p in zip(own, path, strict=True))
        assert np.allclose(dd[g], [(np.maximum(np.maximum.accumulate(path), 0) - path).max(), path.min(), path.max()])
        best = now = 0
        for _, x in own:
            now = 0 if x > 0 else now + 1
            best = max(best, now)
        assert runs[g] == best
    assert np.allclose(ordered.quantiles(df, "x", [0.1, 0.5, 1.0]), np.quantile([x for *_, x in rows], [0.1, 0.5, 1.0]))
    sizes = np.array([len(a) for a in np.array_split(np.arange(300), 7)])
    assert sorted(r["count"] for r in ordered.tiles(df, ["k"], 7, "t").groupBy("t").count().collect()) == sorted(sizes)


def test_metrics_with_ties(spark):
    p, y = rng.integers(1, 10, 400) / 10, rng.integers(0, 2, 400)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")
    pos, neg = p[y == 1], p[y == 0]
    want = ((pos[:, None] > neg).sum() + (pos[:, None] == neg).sum() / 2) / (len(pos) * len(neg))
    assert math.isclose(metrics.auc(df, "p", "y").first().auc, want)
    b = metrics.equal_mass_bins(df, "p", "y", 4).collect()
    assert sum(r.n for r in b) == 400 and min(r.n for r in b[:-1]) >= 50 and len(b) <= 5
    none = df.filter("p > 2")
    assert metrics.auc(none, "p", "y").first().auc is None and metrics.equal_mass_bins(none, "p", "y", 4).count() == 0


def test_draws_and_holm(spark):
    rows = [(r.rep, r["__k"], r.times) for r in bootstrap.draw_counts(spark, 50, 40).collect()]
    assert all(sum(t for r, _, t in rows if r == k) == 50 for k in range(40)) and len({k for _, k, _ in rows}) == 50
    tests = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "cell string, p double")
    got = {r.cell: round(r.adjusted, 6) for r in bootstrap.holm(tests, "p", "cell").collect()}
    assert got == {"a": 0.04, "c": 0.09, "b": 0.09, "d": 0.5}


def test_fits_recover(spark):
    rows = []
    for c in range(3000):
        q = rng.dirichlet(np.ones(5) * 2)
        p = q**1.4 / (q**1.4).sum()
        w = rng.choice(5, p=p)
        rows += [(c, float(q[k]), int(k == w)) for k in range(5)]
    df = spark.createDataFrame(rows, "c int, q double, won int")
    fit = fits.fit_power(df, "c", "won", "q")
    theta = fits.fit_softmax(df.withColumn("f", F.ln("q")), "c", "won", ["f"]).theta
    assert fit["status"] == "fitted" and abs(fit["gamma"] - 1.4) < 0.12 and abs(fit["gamma"] - theta[0]) < 0.01
    assert fits.fit_power(df.filter("c < 20"), "c", "won", "q")["status"] == "few_samples"
    assert fits.fit_power(df.withColumn("won", (F.col("q") == F.max("q").over(fits.Window.partitionBy("c"))).cast("int")), "c", "won", "q")["status"] == "boundary"
    assert fits.fit_power(df.limit(0), "c", "won", "q")["status"] == "few_samples"


def test_settlement(spark):
    runs = [("a", e, o, 1) for e, o in zip(range(1, 9), [1, 2, 3, 4, 5, 6, 7, None], strict=True)] + [("b", 1, 1, 1), ("b", 2, 1, 1), ("b", 3, 3, 1), ("b", 4, None, 0)]
    res = betting.outcomes(spark.createDataFrame(runs, "c string, e int, o int, s int"), "c", "e", "o", "s")
    bets = [("a", "win", [1]), ("a", "win", [2]), ("a", "place", [3]), ("a", "place", [4]), ("a", "exacta", [1, 2]), ("a", "exacta", [2, 1]), ("a", "quinella", [1, 2]), ("a", "wide", [1, 3]), ("a", "wide", [1, 4]),
            ("a", "trifecta", [1, 2, 3]), ("a", "trio", [1, 2, 3]), ("b", "win", [1]), ("b", "win", [3]), ("b", "place", [1]), ("b", "quinella", [1, 2]), ("b", "win", [4])]
    got = betting.settle(spark.createDataFrame(bets, "c string, bet_type string, selection array<int>"), res, "c")
    got = {(r.c, r.bet_type, *r.selection): (r.hit, r.void) for r in got.collect()}
    assert [got[(c, b, *x)] for c, b, x in bets] == [(1, False), (0, False), (1, False), (0, False), (1, False), (0, False), (1, False), (1, False), (0, False), (1, False), (1, False), (None, False), (0, False), (None, False), (None, False), (None, True)]


def entries(days):
    """A panel of 40 contests over some days, with ties and same-day repeats."""
    out = []
    for c in range(40):
        n = int(rng.integers(1, 7))
        w = np.full(n, 1 / n)
        for k, e in enumerate(rng.choice(15, n, replace=False)):
            out.append((c, int(e), days[c % len(days)], int(e) % 3, int(e) % 4, "v", "s", 1500, int(k == 0), int(k < 2), int(k < 3), k + 1, k, float(50 + e), float(100 + 3 * e + c), 2.0 + k, float(w[k]), n, "finished", f"{e % 5}-X", k + 1))
    return out


PANEL = "contest_id int, entity_id int, day date, agent_id int, owner_id int, venue string, sire string, distance int, won int, top2 int, top3 int, finish_order int, line int, weight double, price double, odds double, q double, n int, result_status string, class string, popularity int"


def test_matrix_never_looks_ahead(spark):
    """What happens on a day or after it changes no row of that day or before; projection and targets change no value."""
    days = [dt.date(2020, 1, k) for k in (1, 2, 2, 5, 9)]
    rows = entries(days)
    key = lambda df: {(r.contest_id, r.entity_id): tuple(None if x is None else round(x, 9) for x in r[2:]) for r in df.collect()}
    # what the row itself says is known with the entries; all else must come from earlier days
    names = [c for c, (_, timing, _) in blocks.AVAILABLE.items() if timing in ("static", "as_of") and not c.startswith("weight")]
    whole = key(blocks.asof_matrix(spark.createDataFrame(rows, PANEL), names))
    cut = dt.date(2020, 1, 5)
    changed = [(*r[:8], 1 - r[8], *r[9:11], 9 - r[11], r[12] + 5, r[13] + 3, *r[14:]) if r[2] >= cut else r for r in rows]
    other = key(blocks.asof_matrix(spark.createDataFrame(changed, PANEL), names))
    early = {r[:2] for r in rows if r[2] <= cut}
    assert all(whole[k] == other[k] for k in early) and any(whole[k] != other[k] for k in whole)
    some = ["form_mean3", "career_rate_vs_field", "agent_starts"]
    df = spark.createDataFrame(rows, PANEL)
    part = key(blocks.asof_matrix(df, some, df.filter("contest_id in (3, 7, 11)").select("contest_id")))
    at = [names.index(c) for c in some]
    assert part == {k: tuple(v[i] for i in at) for k, v in whole.items() if k[0] in (3, 7, 11)}
    with pytest.raises(ValueError, match="no such"):
        blocks.asof_matrix(df, ["nothing"])


def test_rating_by_days(spark):
    days = [dt.date(2020, 1, k) for k in (1, 2, 3)]
    rows = [(1, 1, days[0], 1), (1, 2, days[0], 2), (1, 3, days[0], None), (2, 1, days[0], 2), (2, 4, days[0], 1), (3, 1, days[1], 1), (3, 2, days[1], 1), (3, 4, days[1], 3), (4, 1, days[2], 1)]
    got = {(r.c, r.e): (r.rating_before, r.starts_before) for r in rating.rate(spark.createDataFrame(rows, "c int, e int, d date, o int"), "c", "e", "d", "o").collect()}
    r, n, want = {}, {}, {}
    for d in days:
        moves, today = {}, [x for x in rows if x[2] == d]
        for c, e, _, _ in today:
            want[c, e] = (r.get(e, 1500.0), n.get(e, 0))
        for c in {x[0] for x in today}:
            f = [(e, o) for k, e, _, o in today if k == c and o]
            for e, o in f:
                g = [(1 if o < p else 0.5 if o == p else 0) - 1 / (1 + 10 ** ((r.get(x, 1500.0) - r.get(e, 1500.0)) / 400)) for x, p in f if x != e]
                if g:
                    moves[e] = moves.get(e, 0) + 24 * sum(g) / len(g)
        for _, e, _, _ in today:
            n[e] = n.get(e, 0) + 1
        for e, m in moves.items():
            r[e] = r.get(e, 1500.0) + m
    assert got.keys() == want.keys() and all(math.isclose(got[k][0], want[k][0]) and got[k][1] == want[k][1] for k in want)


def test_lines_are_numbered_across_blocks(spark, tmp_path):
    lines = [f"{k},名{k},{'x' * (k % 90)}" if k % 10 else f"{k},short" for k in range(1, 2001)]
    (tmp_path / "y.csv").write_bytes("\n".join(lines).encode("cp932"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows, errors = core.read_year_file(spark, str(tmp_path / "y.csv"), ["k", "name", "x"])
        assert {(int(r.k), r.line) for r in rows.collect()} == {(k, k) for k in range(1, 2001) if k % 10} and rows.filter("name <> concat('名', k)").count() == 0
        assert {r.line for r in errors.collect()} == set(range(10, 2001, 10))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "128m")


def test_text_forms(spark):
    raw = ["ＡＢＣ　", "◎ ｶﾞﾝﾊﾞ", "　", None, "①x", "○ name"]
    df = t.nfkc(spark.createDataFrame([(x,) for x in raw], "s string"), "s", "n").select("s", "n", t.half_width(F.col("s")).alias("h"), t.strip_markers(F.col("s")).alias("m"))
    got = {r.s: (r.n, r.h, r.m) for r in df.collect()}
    assert {k: v[0] for k, v in got.items()} == {x: (unicodedata.normalize("NFKC", x).strip() or None) if x else None for x in raw}
    assert got["ＡＢＣ　"][1] == "ABC" and got["○ name"][2] == "name" and got["　"] == (None, None, None)
    times = spark.createDataFrame([("1.34.5",), ("2:01.0",), ("----",), ("1.34",), (None,)], "s string").select(t.seconds(F.col("s")).alias("x"))
    assert [r.x for r in times.collect()] == [94.5, 121.0, None, None, None]
    a = spark.createDataFrame([([5, 3, 7, 1],), ([4],), ([],)], "a array<int>").select(t.largest_gain(F.col("a")).alias("x"))
    assert [r.x for r in a.collect()] == [6, None, None]


def test_store_fails_closed(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.createDataFrame([(1, dt.date(2020, 1, 1), 0.5), (2, dt.date(2020, 1, 2), -0.0)], "c int, day date, x double")
    with pytest.raises(store.StoreError, match="manifest"):
        store.read_store(spark, path)
    m = store.write_store(df, path, "day", ["c"], {"runs": "f1"})
    assert (m["rows"], m["first"], m["last"]) == (2, "2020-01-01", "2020-01-02") and store.read_store(spark, path, columns=["c"], last="2020-01-02", sources={"runs": "f1"}, verify=True).count() == 2
    for wrong in ({"columns": ["y"]}, {"last": "2020-01-03"}, {"sources": {"runs": "f2"}}):
        with pytest.raises(store.StoreError):
            store.read_store(spark, path, **wrong)
    same = spark.createDataFrame([(2, dt.date(2020, 1, 2), 0.0), (1, dt.date(2020, 1, 1), 0.5)], "c int, day date, x double").select("x", "day", "c")
    assert store.fingerprint(df) == store.fingerprint(same) != store.fingerprint(df.unionByName(same))


def test_keyed_loads(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, None, 1)], "k int, v string, o int")
    new = spark.createDataFrame([(2, "b", 5), (2, "c", 4), (3, None, 9), (1, None, 2)], "k int, v string, o int")
    rows = lambda df: sorted((r.k, r.v) for r in df.collect())
    assert [x[0] for x in rows(core.upsert(old, new, ["k"], "o").fillna("-"))] == [1, 2, 3] and dict(rows(core.upsert(old, new, ["k"], "o").fillna("-"))) == {1: "-", 2: "b", 3: "-"}
    assert dict(rows(core.insert_if_absent(old, new, ["k"], "o").fillna("-"))) == {1: "a", 2: "-", 3: "-"}
    last = new.filter("o <> 4")
    assert dict(rows(core.fill_nulls(old, last, ["k"], ["v"], F.lit(True)))) == {1: "a", 2: "b"} == dict(rows(core.fill_nulls(old, last, ["k"], ["v"], F.lit(False))))
    ids = spark.createDataFrame([(1, 2, "mapped"), (5, 6, "mapped"), (7, 6, "open")], "source_id int, canonical_id int, status string")
    out, refused = core.rekey(spark.createDataFrame([(1, "x"), (2, "x"), (5, "x"), (7, "x")], "id int, t string"), ids, "id", ["id", "t"])
    assert sorted(r.id for r in out.collect()) == [1, 2, 6, 7] and [(r.id, r.wanted) for r in refused.collect()] == [(1, 2)]
