"""Queries that must stay within bounded disk and time, and rows on the edge of a comparison."""

import datetime as dt
import functools
import glob
import itertools
import os
import re
import time

import duckdb
import pytest

from furlong import registry
from furlong.operators import asof, growth, joint, segments as sg
from furlong.plans import accuracy, bets
from furlong.sources.panel import market
from tests.test_panel import SF, canon


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.fixture
def no_broadcast(spark):
    """Small tables are joined as large ones are."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    yield
    spark.conf.set(key, before)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_popularity_triples_stay_in_their_contest(spark, duck, no_broadcast):
    """No triple is shuffled: the market is stored by contest, and all of the query is within contests."""
    df = registry.queries()["popularity_triples"](spark, SF)
    assert exchanges(df) == 0
    assert canon(df.toPandas()) == canon(duck.sql(registry.oracle_sql()["popularity_triples"]).df())


def test_matrix_moves_the_wide_row_once(spark, no_broadcast):
    """Entries are looked up in their contest: no exchange is by contest and entity, and one block more adds no move of the wide row."""
    df = registry.queries()["asof_matrix"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"Exchange hashpartitioning\(contest_id#\w+, entity_id#\w+", text)
    assert exchanges(df) <= 30


def test_sums_before_and_joined_entries(spark):
    """Null keys are a key, undated rows have no past, rows of one day do not see each other; a missing entry gives nulls."""
    day = dt.date
    rows = [(1, 7, day(2020, 1, 1), 1, 2), (2, 7, day(2020, 1, 1), 0, None), (3, 7, day(2020, 1, 5), 0, 4), (4, None, day(2020, 1, 3), 1, 1), (5, None, day(2020, 1, 4), 0, 3), (6, 7, None, 1, 1)]
    df = spark.createDataFrame(rows, "c long, k long, day date, won int, place int")
    blocks = {"x": (["k"], {"rate": ("won", "1"), "mean": ("place", "CASE WHEN place IS NOT NULL THEN 1 END")})}
    got = {r.c: (r.x_starts, r.x_rate, r.x_mean) for r in asof.sums_before(df, "day", blocks).collect()}
    assert got[1] == got[2] == (1, 1.0, 1.0) and got[4] == got[6] == (0, None, None)
    assert got[3][0] == 3 and got[5] == (1, 1.0, 1.0)  # the undated row stands before all days
    left = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (3, None)], "c long, e long")
    found = spark.createDataFrame([(1, 10, 0.5, None), (2, 10, None, "b"), (9, 1, 1.0, "z")], "c long, e long, v double, w string")
    out = asof.join_entries(left, found, "c", "e", ["v", "w"])
    assert sorted(out.collect(), key=str) == sorted([(1, 10, 0.5, None), (1, 11, None, None), (2, 10, None, "b"), (3, None, None, None)], key=str)


def test_model_inputs_do_not_shuffle_the_matrix(spark, duck, no_broadcast):
    df = registry.queries()["model_inputs"](spark, SF)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"Exchange hashpartitioning\(contest_id#\w+, entity_id#\w+", text)
    assert canon(df.toPandas()) == canon(duck.sql(registry.oracle_sql()["model_inputs"]).df())


@pytest.mark.parametrize("odds", [(2.0, 2.8, 7.0), (2.2, 4.4, 4.4, 11.0), (3.0, 3.6, 4.0, 7.2), (1.2, 6.0)])
def test_growth_stakes_at_fair_odds(spark, odds):
    """Where all totals from some stake on give the same growth, the least is taken, whatever the last digit of the sums."""
    w = [(1 / o) ** 1.2 for o in odds]
    rows = []
    for c, order in enumerate(itertools.permutations(w)):
        whole = functools.reduce(lambda t, x: t + x, order)  # not sum(), which rounds once
        rows += [(c, e, x / whole, o) for e, (x, o) in enumerate(zip(w, odds))]
    df = spark.createDataFrame(rows, "c long, e long, p double, o double")
    got = {(r.c, r.e): r.stake for r in growth.growth_stakes(df, "c", "e", "p", "o", 0.25).collect()}
    kept = min(p * o for c, _, p, o in rows if c == 0)  # the bank that is left when the entries of the least value are not bet on
    assert kept > 0.75
    assert all(abs(got[c, e] - max(0.0, p - kept / o)) < 1e-9 for c, e, p, o in rows)


def test_policy_gate_takes_the_favourite_sums_once(spark, duck, no_broadcast):
    """Sums taken a second time, in another order, may differ in the last digit: then the favourite beats itself."""
    df = registry.queries()["policy_gate"](spark, SF)
    assert df._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
    assert canon(df.toPandas()) == canon(duck.sql(registry.oracle_sql()["policy_gate"]).df())


def test_yearly_segments_store_no_day_sums(spark, duck, monkeypatch):
    """The points come from one pass, not from sums by day and bin, and equal both the SQL and those of the day sums."""
    want = sg.by_year(accuracy.segment_sums(spark, SF))
    want = {tuple(r)[:5]: r.excess for r in want.collect()}
    monkeypatch.setattr(sg, "day_sums", lambda *a, **k: pytest.fail("day sums were written"))
    df = registry.queries()["segment_axes_by_year"](spark, SF)
    got = {tuple(r)[:5]: r.excess for r in df.collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-5 for k in want)
    assert canon(df.toPandas()) == canon(duck.sql(registry.oracle_sql()["segment_axes_by_year"]).df())


def test_pair_cells_stay_in_their_contest(spark, duck, no_broadcast):
    """Model and market probabilities of a pair come from one join within the contest; nothing is shuffled."""
    cells = bets.pair_cells(spark, SF)
    assert exchanges(cells) == 0
    m = market(spark, SF)
    parts = [{tuple(r)[:3]: r.prob for r in joint.quinella(m, p=p).collect()} for p in ("p", "q")]
    got = {tuple(r)[:3]: (r.prob, r.qprob) for r in joint.quinellas(m, {"prob": "p", "qprob": "q"}).collect()}
    assert got.keys() == parts[0].keys() and all(abs(got[k][i] - parts[i][k]) < 1e-12 for k in got for i in (0, 1))
    assert canon(registry.queries()["portfolio_cells"](spark, SF).toPandas()) == canon(duck.sql(registry.oracle_sql()["portfolio_cells"]).df())


def test_pool_probabilities_end_when_they_rest(spark):
    """What a contest costs depends on how soon it comes to rest, not on the rounds that are allowed; few rounds are kept to."""
    q = [0.5, 0.3, 0.15, 0.05]
    rows = [(c, a, b, q[a] * q[b] / (1 - q[a]) + q[a] * q[b] / (1 - q[b])) for c in range(200) for a in range(4) for b in range(a + 1, 4)]
    pairs = spark.createDataFrame(rows, "contest long, low long, high long, share double")
    start = time.monotonic()
    got = growth.pool_probabilities(pairs, "contest", "low", "high", "share", rounds=100_000).collect()
    assert time.monotonic() - start < 25
    assert len(got) == 800 and all(abs(r.p - q[r.entity]) < 1e-12 and r.gap < 1e-12 for r in got)
    few = {n: growth.pool_probabilities(pairs.filter("contest = 0"), "contest", "low", "high", "share", rounds=n).first().gap for n in (1, 2, 13, 25)}
    assert few[1] > few[2] > few[13] > few[25] > 0
