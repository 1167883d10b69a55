"""Feature blocks with several reductions, and fits, grids and reports over the contest panel."""

from .markets import PAIR, calibration

TRIPLE = f"{PAIR} JOIN market c ON a.contest_id = c.contest_id AND c.entity_id <> a.entity_id AND c.entity_id <> b.entity_id"


def last(k: int | None, key: str = "entity_id") -> str:
    """Window over the last k source rows of the key, or over all of them."""
    return f"OVER (PARTITION BY {key} ORDER BY day, contest_id ROWS BETWEEN {'UNBOUNDED' if k is None else k - 1} PRECEDING AND CURRENT ROW)"


def asof_block(source: str, reductions: dict[str, str], out: dict[str, str] | None = None, key: str = "entity_id", tie: str = "contest_id") -> str:
    """``reductions`` of the ``source`` rows (key, day, contest_id, x) of earlier days for each run; ``out`` may use them and
    the run's own columns. A probe stands before the sources of its day, in one window per key."""
    cols = ", ".join(f"{e} AS {n}" for n, e in reductions.items())
    held = ", ".join(f"max({n}) OVER (PARTITION BY {key}, grp) AS {n}" for n in reductions)
    final = ", ".join(f"{e} AS {n}" for n, e in (out or {n: f"round({n}, 6) + 0e0" for n in reductions}).items())
    return f"""WITH v AS ({source}),
r AS (SELECT {key}, day, {cols}, row_number() OVER (PARTITION BY {key}, day ORDER BY {tie} DESC) AS last_of_day FROM v),
t AS (SELECT {key}, day, 1 AS src, {", ".join(reductions)} FROM r WHERE last_of_day = 1
  UNION ALL SELECT DISTINCT {key}, day, 0 AS src, {", ".join(f"cast(NULL AS double) AS {n}" for n in reductions)} FROM runs),
g AS (SELECT *, sum(src) OVER (PARTITION BY {key} ORDER BY day, src ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM t),
f AS (SELECT {key}, day, src, {held} FROM g)
SELECT contest_id, entity_id, {final} FROM runs JOIN f USING ({key}, day) WHERE src = 0"""


RELATIVE = "SELECT entity_id, day, contest_id, price / weight - avg(price / weight) OVER (PARTITION BY contest_id) AS x FROM runs WHERE result_status = 'finished'"
SUPPORT = "SELECT entity_id, day, contest_id, ln(q * n) AS x FROM market"
ENTROPY = "SELECT contest_id, min(day) AS day, max(n) AS n, round(-sum(q * ln(q)) / ln(max(n)), 6) AS entropy, max(CASE WHEN popularity = 1 THEN won END) AS fav_won FROM market WHERE n > 1 GROUP BY contest_id"
#: Log loss by year of each score.
LOSSES = "SELECT year(day) AS y, avg(-(won * ln(p) + (1 - won) * ln(1 - p))) AS loss_p, avg(-(won * ln(q) + (1 - won) * ln(1 - q))) AS loss_q FROM market WHERE n > 1 GROUP BY year(day)"

SQL = {
    "pace_block": asof_block(RELATIVE, {"mean5": f"avg(x) {last(5)}", "min5": f"min(x) {last(5)}", "front_rate": f"avg(CASE WHEN x < 0 THEN 1e0 ELSE 0e0 END) {last(None)}"}, {n: f"round({n} + 1e-9, 6) + 0e0" for n in ("mean5", "min5", "front_rate")}),
    "trajectory_block": asof_block(
        "SELECT entity_id, day, contest_id, cast(line - finish_order AS double) AS x FROM runs WHERE finish_order IS NOT NULL",
        {"mean_gain": f"avg(x) {last(None)}", "best_gain": f"max(x) {last(None)}"},
    ),
    "condition_change": asof_block(
        "SELECT entity_id, day, contest_id, cast(weight AS double) AS x FROM runs", {"last_x": "x"},
        {"weight_change": "round(weight - last_x, 6)", "weight_up": "greatest(weight - last_x, 0)", "seen": "CASE WHEN last_x IS NULL THEN 0 ELSE 1 END"},
    ),
    "support_reductions": asof_block(SUPPORT, {
        "last1": "x", "mean3": f"sum(x) {last(3)} / (count(x) {last(3)} + 1)", "career": f"sum(x) {last(None)} / (count(x) {last(None)} + 5)",
        "best5": f"max(x) {last(5)}", "sd5": f"stddev_samp(x) {last(5)}",
        "trend3": f"CASE WHEN count(x) {last(3)} = 3 THEN (x - lag(x, 2) OVER (PARTITION BY entity_id ORDER BY day, contest_id)) / 2 WHEN count(x) {last(3)} = 2 THEN x - lag(x) OVER (PARTITION BY entity_id ORDER BY day, contest_id) END",
    }),
    "contest_level": asof_block(
        "SELECT entity_id, day, contest_id, ln(1 + price) AS x FROM runs", {"level": f"avg(x) {last(None)}"},
        {"level_before": "round(level, 6)", "relative_level": "round(ln(1 + price) - level, 6) + 0e0"},
    ),
    "rank_robust": asof_block(
        "SELECT entity_id, day, contest_id, 1 - cast(rank() OVER (PARTITION BY contest_id ORDER BY odds) - 1 AS double) / (n - 1) AS x FROM market WHERE n > 1",
        {"mean5": f"CASE WHEN count(x) {last(None)} >= 3 THEN avg(x) {last(5)} END", "best": f"CASE WHEN count(x) {last(None)} >= 3 THEN max(x) {last(None)} END"},
    ),
    "residual_form": asof_block(
        "SELECT entity_id, day, contest_id, won - q AS x FROM market",
        {"mean5": f"CASE WHEN count(x) {last(None)} >= 3 THEN avg(x) {last(5)} END", "career": f"CASE WHEN count(x) {last(None)} >= 3 THEN avg(x) {last(None)} END"},
    ),
    "closing_figure": """WITH d AS (SELECT class, day, count(*) AS n, sum(odds) AS s, sum(odds * odds) AS ss FROM runs WHERE result_status = 'finished' GROUP BY class, day),
b AS (SELECT class, day, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(ss) OVER w AS ss FROM d WINDOW w AS (PARTITION BY class ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT contest_id, entity_id, CASE WHEN n >= 50 THEN round(least(5.0, greatest(-5.0, (odds - s / n) / sqrt(ss / n - s / n * (s / n)))), 4) END AS z
FROM runs JOIN b ON runs.class = b.class AND runs.day = b.day WHERE result_status = 'finished'""",
    "seasonal_probe": """SELECT contest_id, entity_id, round(sin(2 * pi() * dayofyear(day) / 365), 6) + 0e0 AS season_sin, round(cos(2 * pi() * dayofyear(day) / 365), 6) + 0e0 AS season_cos,
round(ln(1 + gap), 6) AS log_gap, greatest(gap - 60, 0) AS hinge_60, CASE WHEN gap >= 90 THEN 1 ELSE 0 END AS layoff
FROM (SELECT contest_id, entity_id, day, cast(datediff('day', lag(day) OVER (PARTITION BY entity_id ORDER BY day, contest_id), day) AS bigint) AS gap FROM runs) x""",
    "agent_pair_rate": """WITH d AS (SELECT agent_id, owner_id, day, count(*) AS n, sum(top2) AS h FROM runs GROUP BY agent_id, owner_id, day),
b AS (SELECT agent_id, owner_id, day, sum(n) OVER w AS n, sum(h) OVER w AS h FROM d WINDOW w AS (PARTITION BY agent_id, owner_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT contest_id, entity_id, round(cast(h AS double) / n, 6) AS pair_rate FROM runs JOIN b ON runs.agent_id = b.agent_id AND runs.owner_id = b.owner_id AND runs.day = b.day""",
    "target_encoding_cutoff": """WITH g AS (SELECT class, sum(won) AS s, count(*) AS n FROM runs WHERE day < date '1997-01-01' GROUP BY class)
SELECT contest_id, entity_id, round(coalesce((s + 2e0) / (n + 20e0), 0.1), 6) AS encoded FROM runs LEFT JOIN g ON runs.class = g.class WHERE day >= date '1997-01-01'""",
    "composite_id": """SELECT contest_id, entity_id, concat(lpad(cast(year(day) AS varchar(9)), 4, '0'), lpad(cast(month(day) AS varchar(9)), 2, '0'), lpad(cast(contest_id AS varchar(9)), 9, '0')) AS full_id FROM panel""",
    "selection_keys": """SELECT contest_id, concat_ws('-', cast(f AS varchar(9)), cast(s AS varchar(9))) AS ordered_key, concat_ws('-', cast(least(f, s) AS varchar(9)), cast(greatest(f, s) AS varchar(9))) AS unordered_key
FROM (SELECT contest_id, max(CASE WHEN k = 1 THEN entity_id END) AS f, max(CASE WHEN k = 2 THEN entity_id END) AS s
FROM (SELECT contest_id, entity_id, row_number() OVER (PARTITION BY contest_id ORDER BY odds, entity_id) AS k FROM market) x GROUP BY contest_id) y WHERE s IS NOT NULL""",
    "event_field": """SELECT event_type, cast(json_extract_string(props, '$.k') AS bigint) AS k, cast(count(*) AS bigint) AS n FROM events GROUP BY event_type, cast(json_extract_string(props, '$.k') AS bigint)""",
    "reliability_slope": f"""WITH c AS ({calibration('p')}), m AS (SELECT sum(n) AS w, sum(n * mean_score) / sum(n) AS mx, sum(n * win_rate) / sum(n) AS my FROM c)
SELECT round(sum(n * (mean_score - mx) * (win_rate - my)) / sum(n * (mean_score - mx) * (mean_score - mx)), 4) AS slope, round(max_by(win_rate - mean_score, bin), 5) AS top_gap FROM c CROSS JOIN m""",
    "quintile_edges": f"""SELECT cast(percentile_cont(0.2) WITHIN GROUP (ORDER BY entropy) AS double) AS e1, percentile_cont(0.4) WITHIN GROUP (ORDER BY entropy) AS e2,
percentile_cont(0.6) WITHIN GROUP (ORDER BY entropy) AS e3, percentile_cont(0.8) WITHIN GROUP (ORDER BY entropy) AS e4 FROM ({ENTROPY}) x""",
    "field_size_quantiles": f"SELECT n, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY entropy), 6) AS median, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY entropy), 6) AS p90 FROM ({ENTROPY}) x GROUP BY n",
    "band_diagnostic": f"""WITH e AS ({ENTROPY}), k AS (SELECT percentile_cont(0.33) WITHIN GROUP (ORDER BY entropy) AS a, percentile_cont(0.67) WITHIN GROUP (ORDER BY entropy) AS b FROM e),
s AS (SELECT CASE WHEN entropy <= a THEN 1 WHEN entropy <= b THEN 2 ELSE 3 END AS band, cast(count(*) AS bigint) AS contests, avg(1e0 - fav_won) AS loss FROM e CROSS JOIN k GROUP BY CASE WHEN entropy <= a THEN 1 WHEN entropy <= b THEN 2 ELSE 3 END)
SELECT s.band, s.contests, round(s.loss, 6) AS favourite_loss, round(s.loss - t.loss, 6) AS separation FROM s LEFT JOIN s t ON t.band = s.band - 1""",
    "divergence_summary": """SELECT class, cast(count(*) AS bigint) AS n, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY x), 6) + 0e0 AS median, round(avg(abs(x)), 6) AS mae, round(percentile_disc(0.9) WITHIN GROUP (ORDER BY abs(x)), 6) AS p90
FROM (SELECT class, round(ln(p / q), 6) + 0e0 AS x FROM market) y GROUP BY class""",
    "metrics_rollup": """SELECT y, cast(count(*) AS bigint) AS n, round(avg((p - won) * (p - won)), 6) AS brier FROM (SELECT year(day) AS y, p, won FROM market) x GROUP BY ROLLUP (y)""",
    "model_comparison": f"SELECT y, round(loss_p, 6) AS loss_p, round(loss_q, 6) AS loss_q, round(loss_p - loss_q, 6) AS difference FROM ({LOSSES}) x",
    "adoption_gate": f"SELECT cast(count(*) AS bigint) AS folds, cast(count(CASE WHEN loss_p < loss_q THEN 1 END) AS bigint) AS better, round(max(loss_p - loss_q), 6) AS worst, CASE WHEN 2 * count(CASE WHEN loss_p < loss_q THEN 1 END) > count(*) THEN 'adopt' ELSE 'reject' END AS decision FROM ({LOSSES}) x",
    "paired_arm_join": """WITH a AS (SELECT contest_id, entity_id, p FROM market WHERE p * odds >= 0.8), b AS (SELECT contest_id, entity_id, q FROM market WHERE odds <= 8)
SELECT CASE WHEN p IS NULL THEN 'second_only' WHEN q IS NULL THEN 'first_only' ELSE 'both' END AS side, cast(count(*) AS bigint) AS n
FROM a FULL OUTER JOIN b ON a.contest_id = b.contest_id AND a.entity_id = b.entity_id GROUP BY CASE WHEN p IS NULL THEN 'second_only' WHEN q IS NULL THEN 'first_only' ELSE 'both' END""",
    "coverage_characteristics": """SELECT captured, cast(count(*) AS bigint) AS contests, round(avg(cast(n AS double)), 6) AS mean_field, percentile_cont(0.5) WITHIN GROUP (ORDER BY n) AS median_field
FROM (SELECT contest_id, count(*) AS n, CASE WHEN count(finish_order) = count(*) THEN 1 ELSE 0 END AS captured FROM runs GROUP BY contest_id) x GROUP BY captured""",
    "estimated_pair_odds": f"""WITH d AS (SELECT a.contest_id, a.entity_id AS f, b.entity_id AS s, a.q AS aq, power(b.q, 0.75) AS w FROM {PAIR}),
c AS (SELECT contest_id, f, s, aq * w / sum(w) OVER (PARTITION BY contest_id, f) AS prob FROM d) SELECT contest_id, f, s, round(least(9999.0, 0.75 / prob), 6) AS pair_odds FROM c""",
    "candidate_pairs": f"""SELECT contest_id, f, s, round(ev, 6) AS ev FROM (SELECT contest_id, f, s, ev, row_number() OVER (PARTITION BY contest_id ORDER BY round(ev, 9) DESC, f, s) AS k FROM (
SELECT a.contest_id, a.entity_id AS f, b.entity_id AS s, a.p * b.p / nullif(1 - a.p, 0) * least(9999.0, 0.75 / (a.q * b.q) * (1 - a.q)) AS ev FROM {PAIR}) x WHERE ev >= 0.8) y WHERE k <= 5""",
    "settlement_exacta": """SELECT contest_id, CASE WHEN firsts = 1 AND seconds = 1 THEN f END AS first, CASE WHEN firsts = 1 AND seconds = 1 THEN s END AS second, CASE WHEN firsts = 1 AND seconds = 1 THEN 'settled' ELSE 'ambiguous' END AS state
FROM (SELECT contest_id, count(CASE WHEN finish_order = 1 THEN 1 END) AS firsts, count(CASE WHEN finish_order = 2 THEN 1 END) AS seconds, max(CASE WHEN finish_order = 1 THEN entity_id END) AS f, max(CASE WHEN finish_order = 2 THEN entity_id END) AS s FROM runs GROUP BY contest_id) x""",
    "settlement_place": """SELECT contest_id, entity_id, CASE WHEN n >= 8 AND finish_order <= 3 THEN 1 WHEN n BETWEEN 5 AND 7 AND finish_order <= 2 THEN 1 WHEN n < 5 THEN NULL ELSE 0 END AS hit FROM market""",
    "top_k_hits": f"""WITH z AS (SELECT contest_id, max(CASE WHEN finish_order = 1 THEN entity_id END) AS f, max(CASE WHEN finish_order = 2 THEN entity_id END) AS s FROM runs GROUP BY contest_id
  HAVING count(CASE WHEN finish_order = 1 THEN 1 END) = 1 AND count(CASE WHEN finish_order = 2 THEN 1 END) = 1),
r AS (SELECT a.contest_id, a.entity_id AS ai, b.entity_id AS bi, row_number() OVER (PARTITION BY a.contest_id ORDER BY round(a.p * b.p / (1 - a.p), 9) DESC, a.entity_id, b.entity_id) AS rn FROM {PAIR}),
k AS (SELECT 1 AS k UNION ALL SELECT 3 UNION ALL SELECT 5 UNION ALL SELECT 10 UNION ALL SELECT 20)
SELECT k.k AS k, cast(count(*) AS bigint) AS contests, round(avg(CASE WHEN rn <= k.k THEN 1e0 ELSE 0e0 END), 6) AS hit_rate FROM z JOIN r ON z.contest_id = r.contest_id AND ai = f AND bi = s CROSS JOIN k GROUP BY k.k""",
    "popularity_triples": f"""WITH t AS (SELECT a.contest_id, a.popularity + b.popularity + c.popularity AS total, least(a.popularity, b.popularity, c.popularity) AS best, a.q * b.q / (1 - a.q) * c.q / (1 - a.q - b.q) AS mass FROM {TRIPLE})
SELECT contest_id, round(sum(mass * total), 5) AS expected_sum, round(sum(CASE WHEN total >= 10 THEN mass ELSE 0e0 END), 6) AS wide_open, round(sum(CASE WHEN best > 1 THEN mass ELSE 0e0 END), 6) AS favourite_out FROM t GROUP BY contest_id""",
    "stage_discount_fit": f"""WITH z AS (SELECT contest_id, max(CASE WHEN finish_order = 1 THEN entity_id END) AS f, max(CASE WHEN finish_order = 2 THEN entity_id END) AS s FROM runs GROUP BY contest_id
  HAVING count(CASE WHEN finish_order = 1 THEN 1 END) = 1 AND count(CASE WHEN finish_order = 2 THEN 1 END) = 1),
g AS (SELECT 6e-1 AS lam UNION ALL SELECT 8e-1 UNION ALL SELECT 1e0 UNION ALL SELECT 12e-1),
w AS (SELECT lam, z.contest_id, sum(power(p, lam)) AS total, sum(CASE WHEN entity_id = s THEN power(p, lam) END) AS chosen FROM z JOIN market ON z.contest_id = market.contest_id AND entity_id <> f CROSS JOIN g GROUP BY lam, z.contest_id)
SELECT lam, cast(count(*) AS bigint) AS contests, round(avg(-ln(chosen / total)), 6) + 0e0 AS nll FROM w GROUP BY lam""",
    "two_gamma_fit": """WITH one AS (SELECT contest_id FROM market GROUP BY contest_id HAVING sum(won) = 1), lo AS (SELECT 8e-1 AS lo UNION ALL SELECT 1e0 UNION ALL SELECT 12e-1), hi AS (SELECT 8e-1 AS hi UNION ALL SELECT 1e0 UNION ALL SELECT 12e-1),
g AS (SELECT lo, hi FROM lo CROSS JOIN hi), w AS (SELECT lo, hi, market.contest_id, won, CASE WHEN p < 0.15 THEN power(p, lo) * power(15e-2, 1 - lo) ELSE power(p, hi) * power(15e-2, 1 - hi) END AS w FROM market JOIN one ON market.contest_id = one.contest_id CROSS JOIN g),
z AS (SELECT lo, hi, contest_id, sum(w) AS total, sum(CASE WHEN won = 1 THEN w END) AS winner FROM w GROUP BY lo, hi, contest_id) SELECT lo, hi, round(avg(-ln(winner / total)), 6) AS nll FROM z GROUP BY lo, hi""",
    "residual_tilt": """WITH c AS (SELECT contest_id, year(min(day)) AS y, sum((won - p) * weight) AS score, sum(p * weight * weight) - sum(p * weight) * sum(p * weight) AS info FROM market GROUP BY contest_id HAVING sum(won) = 1),
f AS (SELECT y, sum(score) AS score, sum(info) AS info FROM c GROUP BY y) SELECT a.y AS eval_year, round(sum(b.score) / sum(b.info), 6) + 0e0 AS step FROM f a JOIN f b ON b.y < a.y GROUP BY a.y""",
    # exact water level: total stake is linear between breakpoints x and x - cap
    "capped_allocation": """WITH x AS (SELECT contest_id, entity_id, 2e-1 * p AS x FROM market), b AS (SELECT DISTINCT contest_id, t FROM (SELECT contest_id, x AS t FROM x UNION ALL SELECT contest_id, x - 8e-2 FROM x UNION ALL SELECT contest_id, 0e0 FROM x) u WHERE t >= 0),
g AS (SELECT b.contest_id, t, sum(least(8e-2, greatest(0e0, x - t))) AS stake FROM b JOIN x ON b.contest_id = x.contest_id GROUP BY b.contest_id, t),
n AS (SELECT contest_id, t, stake, lead(t) OVER (PARTITION BY contest_id ORDER BY t) AS t2, lead(stake) OVER (PARTITION BY contest_id ORDER BY t) AS stake2 FROM g),
l AS (SELECT contest_id, max(t + (t2 - t) * (stake - 1e-1) / (stake - stake2)) AS tau FROM n WHERE stake > 1e-1 AND stake2 <= 1e-1 GROUP BY contest_id)
SELECT x.contest_id, entity_id, round(least(8e-2, greatest(0e0, x - coalesce(tau, 0e0))), 6) + 0e0 AS stake FROM x LEFT JOIN l ON x.contest_id = l.contest_id""",
    "bankroll_by_year": """WITH b AS (SELECT year(day) AS y, contest_id, sum(2e-2 * (won * odds - 1)) AS r FROM market WHERE popularity = 1 GROUP BY year(day), contest_id),
c AS (SELECT y, sum(ln(1 + r)) OVER (PARTITION BY y ORDER BY contest_id) AS path FROM b WHERE r > -1) SELECT y, cast(count(*) AS bigint) AS bets, round(min(path), 5) + 0e0 AS lowest_log, round(max(path), 5) + 0e0 AS highest_log FROM c GROUP BY y""",
    "pool_marginal": f"""WITH g AS (SELECT a.contest_id, a.entity_id AS f, b.entity_id AS s, a.q * b.q / (1 - a.q) AS inv FROM {PAIR}), m AS (SELECT contest_id, f AS entity_id, sum(inv) AS w FROM g GROUP BY contest_id, f)
SELECT contest_id, entity_id, round(w / sum(w) OVER (PARTITION BY contest_id), 9) AS share FROM m""",
    "contest_weights": """WITH e AS (SELECT contest_id, 1 / (1 + exp(-10 * max(p - q))) AS w FROM market GROUP BY contest_id), m AS (SELECT avg(w) AS mean_w FROM e) SELECT contest_id, round(w / mean_w, 6) AS weight FROM e CROSS JOIN m""",
    "favourite_return": "SELECT contest_id, max(n) AS n, max(odds) AS odds, CASE WHEN sum(w.won) = 0 THEN 0 ELSE max(w.odds) END AS dividend FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY odds, entity_id) AS k FROM market) w WHERE k = 1 GROUP BY contest_id",
    "training_matrix": """SELECT contest_id, runs.entity_id, won, coalesce(4 - least(finish_order, 4), 0) AS grade, odds, cast(starts_before AS bigint) AS starts_before, round(weight - avg(weight) OVER (PARTITION BY contest_id), 6) AS weight_rel
FROM runs JOIN before ON runs.entity_id = before.entity_id AND runs.day = before.day""",
}
