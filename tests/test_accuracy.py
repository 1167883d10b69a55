"""Segments, cohorts, the prediction log, page links and stores by range, against brute force and planted cases."""

import collections
import datetime as dt
import glob
import math

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from furlong import registry
from furlong.functions import text as t
from furlong.operators import betting, cohort, segments as sg
from furlong.plans import accuracy
from furlong.sources import repair, scoring, store

from .test_panel import SF, canon

DAY = dt.date(2020, 1, 1)


@pytest.mark.parametrize("name", sorted(accuracy.QUERIES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {f.rsplit('/', 1)[1][:-8]} AS SELECT * FROM '{f}'")
    got, want = registry.queries()[name](spark, SF).toPandas(), con.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got)
    assert canon(got) == canon(want)


def test_bands(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.0,), (1.0,), (2.5,), (3.0,), (math.inf,)], "x double")
    got = [r[0] for r in df.select(sg.banded(F.col("x"), [1, 3], ["a", "b", "c"])).collect()]
    assert got == [None, None, "a", "b", "b", "c", "c"]


def test_last_starts_against_brute_force(spark):
    rng = np.random.default_rng(11)
    rows = [(i, int(rng.integers(0, 6)), DAY + dt.timedelta(int(rng.integers(0, 40))), int(x) if (x := rng.integers(0, 5)) else None) for i in range(300)]
    rows += [(900, None, DAY, 1), (901, None, DAY + dt.timedelta(9), 2), (902, 1, None, 3)]
    got = {r.c: r for r in sg.last_starts(spark.createDataFrame(rows, "c int, e int, day date, f int"), "e", "day", "c", ["f"], {"good": F.col("f") >= 2}).collect()}
    assert len(got) == len(rows)
    for c, e, day, _ in rows:
        r = got[c]
        if e is None or day is None:
            assert (r.prior_starts, r.prior_good, r.prev_day, r.prev_f, r.prior_gap) == (None,) * 5
            continue
        before = sorted(((d, k), f) for k, x, d, f in rows if x == e and d is not None and d < day)
        assert r.prior_starts == len(before) and r.prior_good == sum(f is not None and f >= 2 for _, f in before)
        assert (r.prev_day, r.prev_f) == ((before[-1][0][0], before[-1][1]) if before else (None, None))
        earlier = [d for (d, _), _ in before if d < before[-1][0][0]]
        assert r.prior_gap == ((before[-1][0][0] - earlier[-1]).days if earlier else None)


def field(rows):
    return [(c, e, DAY + dt.timedelta(c % 5), p, q, won) for c, e, p, q, won in rows]


SCHEMA = "c int, e int, day date, p double, q double, won int"


def test_losses_of_whole_contests_with_one_winner(spark):
    rows = field([(1, 1, 0.6, 0.5, 1), (1, 2, 0.4, 0.5, 0), (2, 1, 0.5, 0.5, 1), (2, 2, 0.5, 0.5, 1), (3, 1, 1.0, 1.0, 1), (4, 1, 0.5, None, 1), (4, 2, 0.5, 0.5, 0), (5, 1, 1.0, 0.5, 0), (5, 2, 0.0, 0.5, 1), (6, 1, 0.5, 0.5, 0), (6, 2, 0.5, 0.5, 0)])
    got = {(r.c, r.e): r for r in sg.with_losses(spark.createDataFrame(rows, SCHEMA), "c", "p", "q", "won").collect()}
    assert set(got) == {(1, 1), (1, 2), (5, 1), (5, 2)}
    assert got[1, 1].winner_nll == pytest.approx(-math.log(0.6)) and got[1, 2].winner_nll is None
    assert got[1, 2].excess == pytest.approx(-math.log(0.6) + math.log(0.5))
    assert math.isfinite(got[5, 2].winner_nll) and got[5, 2].uniform_nll == pytest.approx(math.log(2))


def test_segments_keep_all_rows_and_see_a_planted_one(spark, tmp_path):
    rng = np.random.default_rng(3)
    rows = []
    for c in range(400):
        n = int(rng.integers(2, 6))
        q = rng.dirichlet(np.ones(n) * 3)
        w = rng.choice(n, p=q)
        p = q if c % 2 else np.full(n, 1 / n)
        rows += [(c, i, DAY + dt.timedelta(c % 60), float(p[i]), float(q[i]), int(i == w), ["even", "odd"][c % 2] if c % 10 else None) for i in range(n)]
    df = sg.with_losses(spark.createDataFrame(rows, f"{SCHEMA}, kind string"), "c", "p", "q", "won")
    sums = sg.day_sums(spark, df, {"kind": F.col("kind"), "none": F.lit(None)}, {"place": sg.banded(F.col("e"), [1, 2], ["first", "second", "later"])}, str(tmp_path / "sums"))
    got = {(r.axis, r.bucket): r for r in sg.report(sums, 100).collect()}
    assert set(got) == {("kind", "even"), ("kind", "odd"), ("kind", "missing"), ("none", "missing"), ("place", "first"), ("place", "second"), ("place", "later")}
    for axis in ("kind", "none", "place"):
        assert sum(r.entries for (a, _), r in got.items() if a == axis) == len(rows)
        assert sum(r.winners for (a, _), r in got.items() if a == axis) == 400
    even, odd = got["kind", "even"], got["kind", "odd"]
    assert abs(even.excess) < 1e-12 and odd.excess < 0 and odd.ci_low <= odd.excess <= odd.ci_high and odd.ci_high < 0
    assert odd.winner_nll == pytest.approx(odd.market_nll) and odd.calibration is None
    place = got["place", "first"]
    mine = [(p, y) for _, e, _, p, _, y, _ in rows if e == 0]
    assert place.winner_nll is None and place.calibration == pytest.approx(sum(y - p for p, y in mine) / len(mine))
    bins = collections.defaultdict(float)
    for p, y in mine:
        bins[min(int(p * 10), 9)] += y - p
    assert place.ece == pytest.approx(sum(map(abs, bins.values())) / len(mine))
    assert sum(r.units for r in sg.by_year(sums).collect() if r.axis == "kind") == 400


def test_an_empty_panel_has_no_segments(spark, tmp_path):
    df = sg.with_losses(spark.createDataFrame([], SCHEMA), "c", "p", "q", "won")
    sums = sg.day_sums(spark, df, {"all": F.lit("x")}, {"e": F.col("e")}, str(tmp_path / "sums"))
    assert sg.report(sums, 10).count() == 0 and sg.by_year(sums).count() == 0


def test_each_frozen_contest_is_scored_or_has_its_reason(spark):
    frozen, runs = [], []

    def add(c, orders, ranks=None, ran=None):
        n = len(orders)
        frozen.extend((c, e, (ranks or list(range(1, n + 1)))[e - 1], 1 / n, "s") for e in range(1, n + 1))
        runs.extend((c, e, o) for e, o in enumerate(orders, 1) if ran is None or e in ran)

    add(1, [3, 1, 2, None])
    add(2, [1, 2, 3])
    add(3, [1, 2, 3, 4], ranks=[1, 1, 3, 4])
    add(4, [1, 2, 3, 4], ran={1, 2, 3})
    add(5, [1, 1, 3, 4])
    add(6, [1, 2, None, None])
    add(7, [1, 2, 3, 4], ran=set())
    add(8, [1, 2, 3, 4], ranks=[1, 2, None, 4])
    f = spark.createDataFrame(frozen, "contest_id int, entity_id int, rank int, q double, s string")
    r = spark.createDataFrame(runs, "contest_id int, entity_id int, finish_order int")
    got = {x.contest_id: (x.reason, x.ra, x.rb, x.rc) for x in cohort.outcomes(f, r, "contest_id", "entity_id", "rank", "finish_order").collect()}
    no = (None,) * 3
    assert got == {1: (None, 2, 3, 1), 2: ("invalid_field", *no), 3: ("invalid_field", *no), 4: ("field_changed", *no), 5: ("dead_heat", *no), 6: ("fewer_than_three", *no), 7: ("field_changed", *no), 8: ("invalid_field", *no)}
    (row,) = cohort.report(f, r, {"out": "least(ra, rb, rc) > 1"}, "s").collect()
    assert (row.captured, row.scored, row.invalid_field, row.field_changed, row.dead_heat, row.fewer_than_three) == (8, 1, 3, 2, 1, 1)
    assert row.expected == pytest.approx(1 / 4) and row.observed == 0 and row.brier == pytest.approx(1 / 16)
    assert cohort.report(f.limit(0), r, {"out": "ra > 1"}, "s").count() == 0


def test_the_log_scores_each_contest_once(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(c, e, DAY + dt.timedelta(c // 2), 0.5) for c in range(6) for e in (1, 2)] + [(None, 1, DAY, 0.5)]
    df = spark.createDataFrame(rows, "contest_id long, entity_id long, day date, p double")
    predict = lambda f: f.select("contest_id", "entity_id", F.col("p").alias("win"), F.lit(0.4).alias("top2"), F.lit(0.9).alias("top3"))
    counts = lambda out: {(r.day - DAY).days: (r.scored, r.skipped) for r in out.collect()}
    state = lambda: sorted(map(tuple, scoring.read_log(spark, path).collect()), key=str)
    assert counts(scoring.score_new(df.filter("contest_id < 3"), predict, path, "m", "a", 1)) == {0: (2, 0), 1: (1, 0)}
    assert counts(scoring.score_new(df, predict, path, "m", "b", 2)) == {0: (0, 2), 1: (1, 1), 2: (2, 0)}
    before = state()
    assert len(before) == 12 and {(str(r[3]), str(r[4]), str(r[5])) for r in before} == {("0.500000", "0.500000", "0.900000")}
    assert counts(scoring.score_new(df, predict, path, "m", "b", 2)) == {0: (0, 2), 1: (1, 1), 2: (2, 0)} and state() == before
    assert counts(scoring.score_new(df, predict, path, "m", "c", 3)) == {0: (0, 2), 1: (0, 2), 2: (0, 2)} and state() == before
    assert counts(scoring.score_new(df, predict, path, "other", "a", 4)) == {0: (2, 0), 1: (2, 0), 2: (2, 0)}
    assert scoring.score_new(df.limit(0), predict, path, "m", "d", 5).count() == 0 and len(state()) == 24


def test_a_store_deals_a_year_over_ranges(spark, tmp_path):
    path = str(tmp_path / "store")
    df = spark.range(4000).select(((F.col("id") * 7919) % 4000).alias("k"), F.expr("date_add(date'2020-01-01', cast(id % 300 as int))").alias("day"))
    old = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled",)}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        store.write_store(df, path, "day", ["k"])
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    files = [pq.ParquetFile(f).read(["k"])["k"].to_pylist() for f in glob.glob(f"{path}/rows/__year=2020/*.parquet")]
    assert len(files) > 1 and all(f == sorted(f) for f in files)
    spans = sorted((f[0], f[-1]) for f in files)
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:])) and sum(map(len, files)) == 4000
    assert store.read_store(spark, path, verify=True).count() == 4000


def test_pages_and_track_types(spark):
    html = """<link rel="canonical" href="http://x.y/race/202001"><a class=a HREF = '/horse/2022103995'>x</a><a href="/jockey/result/recent/05386/">y</a><a href="">z</a><a data-href="/no">n</a>"""
    df = spark.createDataFrame([(1, html), (2, "<LINK href='/c' rel='canonical'>"), (3, ""), (4, None)], "i int, html string")
    got = {r.i: r for r in df.select("i", t.hrefs(F.col("html")).alias("h"), t.canonical_href(F.col("html")).alias("c")).collect()}
    assert got[1].h[:3] == ["http://x.y/race/202001", "/horse/2022103995", "/jockey/result/recent/05386/"] and got[1].h[3] == ""
    assert [got[i].c for i in (1, 2, 3, 4)] == ["http://x.y/race/202001", "/c", None, None] and got[3].h == [] and got[4].h is None
    ids = df.limit(1).select(*[t.href_id(F.lit(u), s) for u, s in (("/horse/2022103995", "horse"), ("/jockey/result/recent/05386/", "jockey"), ("/a/b", "horse"), (None, "horse"))]).first()
    assert list(ids) == ["2022103995", "05386", None, None]
    kinds = [("芝", "G1", "春", None, "芝"), (" ダ ", None, None, None, "ダ"), ("芝", "ＪＧ１", None, None, "障"), ("芝", None, None, "中山大障害", "障"), ("", "G1", "x", "y", None), (None, None, None, None, None)]
    rows = spark.createDataFrame([(i, *k) for i, k in enumerate(kinds)], "i int, s string, k string, a string, b string, want string")
    assert all(r.got == r.want for r in rows.withColumn("got", t.track_type(F.col("s"), F.col("k"), F.col("a"), F.col("b"))).collect())


def test_pairs_move_whole_or_stay_with_a_reason(spark):
    ids = [("a", "A"), ("b", "B"), ("b", "C"), ("c", "d"), ("d", "D"), ("e", "gone"), ("f", "F"), ("g", "G"), ("h", "H"), ("i", "H"), ("same", "same"), (None, "A"), ("z", None)]
    ids = spark.createDataFrame([(*x, "mapped") for x in ids] + [("u", "A", "unmapped")], "source_id string, canonical_id string, status string")
    dim = spark.createDataFrame([(k, None if k == "G" else 1, None if k == "a" else "x") for k in "A B C D F G H a b c d e f g h i".split()] + [("a", None, None), (None, 1, "x")], "k string, year int, sex string")
    runs = spark.createDataFrame([("a", 1), ("a", 2), ("A", 3), ("f", 1), ("F", 1), ("f", 2), ("h", 9), ("i", 9), ("e", 1), (None, 1)], "k string, c int")
    odds = spark.createDataFrame([("a", 1, 2.0), ("g", 1, 3.0)], "k string, c int, o double")
    judged = repair.judge(ids, dim, "k", ["year", "sex"], {"runs": (runs, ["k", "c"]), "odds": (odds, ["c"])})
    got = {(r.source_id, r.canonical_id): (r.reason, r.lost, r.rows) for r in judged.collect()}
    assert {k: v[0] for k, v in got.items()} == {("a", "A"): None, ("b", "B"): "ambiguous", ("b", "C"): "ambiguous", ("c", "d"): "chained", ("d", "D"): None, ("e", "gone"): "no_canonical", ("f", "F"): "collision", ("g", "G"): "attribute_loss", ("h", "H"): "collision", ("i", "H"): "collision"}
    assert got["a", "A"] == (None, "", 3) and got["g", "G"] == ("attribute_loss", "year", 1)
    moved = sorted(map(tuple, repair.move(judged, runs, "k").collect()), key=str)
    assert moved == sorted([("A", 1), ("A", 2), ("A", 3), ("f", 1), ("F", 1), ("f", 2), ("h", 9), ("i", 9), ("e", 1), (None, 1)], key=str)
    kept = [r.k for r in repair.without_orphans(judged, dim, "k").collect()]
    assert "a" not in kept and "d" not in kept and {"b", "c", "e", "f", "g", "h", "i", None} <= set(kept)
    assert repair.judge(ids.limit(0), dim, "k", [], {}).count() == 0


def test_coverage_against_counted_selections(spark):
    import itertools

    n = 5
    rows = [(1, name, list(c)) for name, (k, ordered) in betting.BET_TYPES.items() for c in (itertools.permutations if ordered else itertools.combinations)(range(n), k)]
    rows += [(1, "trio", [2, 1, 0]), (2, "quinella", [1, 2]), (3, "wide", [1, 2]), (2, "odd", [1]), (2, "quinella", None), (4, "trio", [1, 2, 3])]
    df = spark.createDataFrame(rows, "c int, bet_type string, selection array<int>")
    fields = spark.createDataFrame([(1, n), (2, 3), (4, 2)], "c int, n int")
    got = {(r.c, r.bet_type): (r.listed, r.expected, r.scope) for r in betting.coverage(df, fields, "c").collect()}
    for name, (k, ordered) in betting.BET_TYPES.items():
        want = math.perm(n, k) if ordered else math.comb(n, k)
        assert got[1, name] == (want, want, "full")
    assert got[2, "quinella"] == (1, 3, "partial") and got[3, "wide"] == (1, None, None) and got[2, "odd"] == (1, None, None) and got[4, "trio"] == (1, 0, "excess")
