"""Spark queries against their SQL oracles in DuckDB, and leak checks of the as-of primitives."""

import datetime as dt
import glob
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from furlong import registry
from furlong.operators import asof
from furlong.plans import markets
from furlong.sources import loads
from furlong.sources.panel import with_parts
from furlong.streaming import quotes

SF = "/root/testdata/sf0.001"


def canon(frame):
    def one(x):
        if isinstance(x, (list, tuple)):
            return str(list(x))
        if x is None or pd.isna(x):
            return None
        if isinstance(x, (dt.date, pd.Timestamp)):
            return str(x)[:10]
        return x if isinstance(x, str) else f"{float(x) + 0:.5g}"

    cols = sorted(frame.columns)
    return sorted((tuple(one(x) for x in r) for r in frame[cols].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", ["asof_win_rate", "asof_previous_result", "field_percent_rank", "recent_form_3", "joint_exacta", "auc", "roi_by_year_band", "expectations", "support_reductions", "rank_robust", "capped_allocation", "candidate_pairs", "top_k_hits", "stage_discount_fit", "delimited_audit", "payload_odds", "latest_quotes_stream", "first_snapshot_stream", "asof_matrix", "asof_matrix_projected", "class_change", "speed_figure", "joint_marginals", "joint_wide", "served_predictions", "ece_equal_mass", "drawdown_by_year", "expanding_folds", "settlement_all", "returns_by_type", "exotic_backtest", "two_gamma_fit", "softmax_fit", "year_file", "rekey_facts", "store_roundtrip", "joint_calibration", "bet_log"])
def test_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SF).toPandas()
    want = duck.sql(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


def test_previous_contest(spark, duck):
    """Against the oracle, and against a walk over each entity's starts by day and contest."""
    got = registry.queries()["previous_contest"](spark, SF).toPandas()
    assert canon(got) == canon(duck.sql(registry.oracle_sql()["previous_contest"]).df())
    starts = duck.sql(with_parts("SELECT contest_id, entity_id, day, finish_order, won, odds FROM runs")).df().sort_values(["day", "contest_id"])
    price, last, want = starts[starts.won == 1].groupby("contest_id").odds.min(), {}, []
    for r in starts.itertuples():
        c, finish = last.get(r.entity_id, (None, None))
        want.append((r.contest_id, r.entity_id, finish, price.get(c)))
        last[r.entity_id] = (r.contest_id, r.finish_order)
    assert canon(got) == canon(pd.DataFrame(want, columns=["contest_id", "entity_id", "finish", "winner_odds"]))


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


def test_same_day_is_not_before(spark):
    d = [dt.date(2020, 1, k) for k in (1, 2, 2, 3)]
    runs = spark.createDataFrame([("c1", 1, d[0], 1), ("c2", 1, d[1], 0), ("c3", 1, d[2], 1), ("c4", 1, d[3], 0), ("c5", 2, d[3], 1)], "c string, e int, day date, won int")
    got = {(r.e, r.day): (r.starts, r.wins) for r in asof.daily_before(runs, ["e"], "day", {"starts": F.lit(1), "wins": F.col("won")}).collect()}
    assert got == {(1, d[0]): (0, 0), (1, d[1]): (1, 1), (1, d[3]): (3, 2), (2, d[3]): (0, 0)}
    last = asof.asof_strict(runs, runs.select("e", "day", "c", F.col("won").alias("prev")), ["e"], "day", ["prev"], "c")
    assert {r.c: r.prev for r in last.collect()} == {"c1": None, "c2": 1, "c3": 1, "c4": 1, "c5": None}


def test_state_refuses_late_events(spark, tmp_path):
    src, rows = str(tmp_path / "in"), [(1, "a", 10, 1.0), (2, "a", 20, 2.0)]
    schema, out = "user long, kind string, t long, value double", str(tmp_path / "out")

    def read():
        return quotes.keyed_state(spark.readStream.schema(schema).parquet(src), ["user"], F.col("value"), F.col("t"), out)

    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    assert {r.user: r.state for r in read().collect()} == {1: 1.0, 2: 2.0}
    spark.createDataFrame([(1, "a", 9, 7.0), (2, "a", 21, 8.0), (3, "a", 1, 9.0)], schema).coalesce(1).write.mode("append").parquet(src)
    assert {r.user: r.state for r in read().collect()} == {1: 1.0, 2: 8.0, 3: 9.0}


def test_bad_rows_are_kept_apart(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,2.5\n2,----\n3\n4,1,9\n")
    got = {r.k: (r.v, r.bad_row) for r in loads.read_delimited(spark, str(tmp_path / "x.csv"), "k int, v double").collect()}
    assert got == {1: (2.5, None), 2: (None, "2,----"), 3: (None, "3"), 4: (1.0, "4,1,9")}


def test_payload(spark):
    rows = spark.createDataFrame([(1, '{"7": "2.5", "8": "---"}'), (2, "no json"), (3, None)], "c int, payload string")
    assert {(r.c, r.e): r.odds for r in loads.parse_payload(rows, "payload", "e", "odds").collect()} == {(1, "7"): 2.5, (1, "8"): None}


def test_bootstrap_resamples_days(spark, duck):
    n = 1084
    duck.sql(f"CREATE OR REPLACE TEMP TABLE i AS SELECT range AS k, {n} AS days FROM range({n})")
    w = duck.sql(markets.draws(200)).df()
    times = w.groupby(["rep", "pick"]).size()
    assert (w.groupby("rep").size() == n).all() and w.rep.nunique() == 200 and w.pick.between(0, n - 1).all()
    seen = times.groupby("rep").size() / n  # a resample misses 1/e of the days
    assert abs(seen.mean() - (1 - 1 / math.e)) < 0.005 and seen.std() < 0.02 and times.groupby("rep").max().min() >= 3
    total = np.bincount(w.pick, minlength=n)  # Poisson(200) for each day
    assert 0.8 < total.var() / total.mean() < 1.25
    alike = np.corrcoef(times.unstack(fill_value=0).to_numpy()) - np.eye(200)  # between replicates
    assert np.abs(alike).max() < 0.2 and abs(alike.mean()) < 0.002


def test_bootstrap_interval(spark, duck):
    name = "day_cluster_bootstrap_ci"
    (got,) = registry.queries()[name](spark, SF).collect()
    assert canon(spark.createDataFrame([got]).toPandas()) == canon(duck.sql(registry.oracle_sql()[name]).df())
    d = duck.sql(with_parts("SELECT day, sum(p - won) AS s, count(*) AS n FROM market GROUP BY day")).df()
    pick = np.random.default_rng(1).integers(0, len(d), (2000, len(d)))
    low, high = np.percentile(d.s.to_numpy()[pick].sum(axis=1) / d.n.to_numpy()[pick].sum(axis=1), [2.5, 97.5])
    assert (got.days, got.reps) == (len(d), 2000) and got.ci_low < got.mean_diff < got.ci_high
    assert abs(got.ci_low - low) < 0.1 * (high - low) and abs(got.ci_high - high) < 0.1 * (high - low)


def test_recent_success(spark, duck):
    got = {tuple(r) for r in quotes.fresh_requests(spark, SF).collect()}
    assert got == set(duck.execute(quotes.ORACLE_SQL["recent_success_dedup"]).fetchall()) and {x[2] for x in got} == {True, False}
    rows = spark.createDataFrame([(1, 0, True), (1, 5, False), (1, 10, False), (1, 11, False), (1, 0, False), (None, 5, False), (2, None, False)], "k int, s long, ok boolean")
    rows = rows.withColumn("ts", F.timestamp_micros("s"))
    out = quotes.recent_success(rows, "k", "ts", F.col("ok"), 10).select("k", "s", "skipped").collect()
    assert {tuple(r) for r in out} == {(1, 5, True), (1, 10, True), (1, 11, False), (1, 0, False), (None, 5, False), (2, None, False)}
