"""Probabilities, metrics, settlement and returns over the contest panel."""

#: Ordered pairs and triples of a contest stay inside one partition of it and are aggregated at once.
PAIR = "market a JOIN market b ON a.contest_id = b.contest_id AND a.entity_id <> b.entity_id"
CLIP = "least(greatest({}, 1e-15), 1 - 1e-15)"


def calibration(score: str) -> str:
    return f"""SELECT least(cast(floor({score} * 10) AS bigint), 9) AS bin, cast(count(*) AS bigint) AS n, round(avg({score}), 6) AS mean_score, round(avg(cast(won AS double)), 6) AS win_rate FROM market GROUP BY least(cast(floor({score} * 10) AS bigint), 9)"""


#: Rounds of x -> (x + key)**5 modulo the prime 2**31 - 1: each is a bijection, and no product leaves 64 bits.
PRIME, ROUND_KEYS = 2147483647, (716414059, 1299709327, 387276917, 1640531527)


def draws(reps: int) -> str:
    """(rep, pick): for each replicate as many draws, with replacement, of the places 0 .. days - 1 as ``i`` (k, days) has rows."""
    digits = " UNION ALL ".join(f"SELECT {d} AS d" for d in range(10))
    width = len(str(reps - 1))
    number = " + ".join(f"{10**j} * t{j}.d" for j in range(width))
    x = f"SELECT rep, days, cast(k AS bigint) AS z FROM i CROSS JOIN (SELECT cast({number} AS bigint) AS rep FROM {' CROSS JOIN '.join(f'({digits}) t{j}' for j in range(width))}) r WHERE rep < {reps}"
    for j, key in enumerate(ROUND_KEYS):
        x = f"SELECT rep, days, (z + (rep + 1) * {48271 + 2 * j} + {key}) % {PRIME} AS z FROM ({x}) a{j}"
        x = f"SELECT rep, days, z, z * z % {PRIME} AS z2 FROM ({x}) b{j}"
        x = f"SELECT rep, days, z2 * z2 % {PRIME} * z % {PRIME} AS z FROM ({x}) c{j}"
    return f"SELECT rep, z % days AS pick FROM ({x}) z"


def day_bootstrap(reps: int = 2000, alpha: float = 0.05) -> str:
    """Mean difference with its percentile interval over ``reps`` resamples of whole days; no interval below two days."""
    return f"""WITH d AS (SELECT day, sum(p - won) AS s, count(*) AS n FROM market GROUP BY day), i AS (SELECT s, n, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS days FROM d),
w AS ({draws(reps)}), c AS (SELECT rep, pick, count(*) AS times FROM w GROUP BY rep, pick),
m AS (SELECT rep, sum(s * times) / sum(n * times) AS mean_diff FROM c JOIN i ON pick = k GROUP BY rep),
b AS (SELECT count(*) AS reps, percentile_cont({alpha / 2}) WITHIN GROUP (ORDER BY mean_diff) AS low, percentile_cont({1 - alpha / 2}) WITHIN GROUP (ORDER BY mean_diff) AS high FROM m),
t AS (SELECT count(*) AS days, sum(s) / sum(n) AS mean_diff FROM d)
SELECT cast(days AS bigint) AS days, cast(reps AS bigint) AS reps, round(mean_diff, 6) AS mean_diff, round(CASE WHEN days >= 2 THEN low END, 6) AS ci_low, round(CASE WHEN days >= 2 THEN high END, 6) AS ci_high FROM t CROSS JOIN b"""


SQL = {
    "joint_exacta": f"SELECT a.contest_id, a.entity_id AS first, b.entity_id AS second, round(a.p * b.p / (1 - a.p), 6) AS prob FROM {PAIR}",
    "joint_quinella": f"""SELECT a.contest_id, least(a.entity_id, b.entity_id) AS low, greatest(a.entity_id, b.entity_id) AS high, round(sum(a.p * b.p / (1 - a.p)), 6) AS prob
FROM {PAIR} GROUP BY a.contest_id, least(a.entity_id, b.entity_id), greatest(a.entity_id, b.entity_id)""",
    "joint_trifecta_top": f"""SELECT contest_id, f, s, t, round(prob, 6) AS prob FROM (
SELECT a.contest_id, a.entity_id AS f, b.entity_id AS s, c.entity_id AS t, a.p * b.p / (1 - a.p) * c.p / (1 - a.p - b.p) AS prob,
row_number() OVER (PARTITION BY a.contest_id ORDER BY round(a.p * b.p / (1 - a.p) * c.p / (1 - a.p - b.p), 9) DESC, a.entity_id, b.entity_id, c.entity_id) AS rn
FROM {PAIR} JOIN market c ON a.contest_id = c.contest_id AND c.entity_id <> a.entity_id AND c.entity_id <> b.entity_id) x WHERE rn <= 3""",
    "joint_trio": f"""SELECT contest_id, least(f, s, t) AS k1, greatest(f, s, t) AS k3, f + s + t AS key_sum, round(sum(prob), 6) AS prob FROM (
SELECT a.contest_id, a.entity_id AS f, b.entity_id AS s, c.entity_id AS t, a.p * b.p / (1 - a.p) * c.p / (1 - a.p - b.p) AS prob
FROM {PAIR} JOIN market c ON a.contest_id = c.contest_id AND c.entity_id <> a.entity_id AND c.entity_id <> b.entity_id) x GROUP BY contest_id, least(f, s, t), greatest(f, s, t), f + s + t""",
    "top2_marginal": f"SELECT b.contest_id, b.entity_id, round(max(b.p) + sum(b.p * a.p / (1 - a.p)), 6) AS top2 FROM {PAIR} GROUP BY b.contest_id, b.entity_id",
    "top2_discounted": f"""WITH d AS (SELECT a.contest_id, a.entity_id AS ai, b.entity_id AS bi, a.p AS ap, power(b.p, 0.8) AS w FROM {PAIR}),
s AS (SELECT contest_id, ai, bi, ap, w / sum(w) OVER (PARTITION BY contest_id, ai) AS cond FROM d)
SELECT contest_id, bi AS entity_id, round(sum(ap * cond), 6) AS second FROM s GROUP BY contest_id, bi""",
    "joint_consistency": f"""SELECT contest_id, round(sum(prob), 6) AS total FROM (SELECT a.contest_id, a.p * b.p / (1 - a.p) AS prob FROM {PAIR}) x GROUP BY contest_id""",
    "market_recovery": "SELECT contest_id, round(0.8 * sum(1 / odds), 6) AS recovery, round(abs(sum(CASE WHEN won = 1 THEN ln(q) END)), 6) AS winner_nll FROM market GROUP BY contest_id",
    "power_calibration": "SELECT contest_id, entity_id, round(power(q, 0.9) / sum(power(q, 0.9)) OVER (PARTITION BY contest_id), 6) AS q_calibrated FROM market",
    "two_piece_power": """SELECT contest_id, entity_id, round(w / sum(w) OVER (PARTITION BY contest_id), 6) AS p_calibrated FROM (SELECT *, CASE WHEN p < 0.15 THEN power(p, 1.1) * power(0.15, -0.1) ELSE power(p, 0.95) * power(0.15, 0.05) END AS w FROM market) x""",
    "gamma_grid_fit": """WITH one AS (SELECT contest_id FROM market GROUP BY contest_id HAVING sum(won) = 1), g AS (SELECT 0.6 AS gamma UNION ALL SELECT 0.8 UNION ALL SELECT 1.0 UNION ALL SELECT 1.2 UNION ALL SELECT 1.4),
z AS (SELECT gamma, market.contest_id, sum(power(q, gamma)) AS total, sum(CASE WHEN won = 1 THEN power(q, gamma) END) AS winner FROM market JOIN one ON market.contest_id = one.contest_id CROSS JOIN g GROUP BY gamma, market.contest_id)
SELECT cast(gamma AS double) AS gamma, round(avg(-ln(winner / total)), 6) AS nll FROM z GROUP BY gamma""",
    "log_loss_brier": f"SELECT round(avg(-(won * ln({CLIP.format('p')}) + (1 - won) * ln(1 - {CLIP.format('p')}))), 6) AS log_loss, round(avg((p - won) * (p - won)), 6) AS brier FROM market",
    "auc": """WITH s AS (SELECT round(p, 9) AS x, cast(sum(won) AS double) AS pos, cast(sum(1 - won) AS double) AS neg FROM market GROUP BY round(p, 9)),
b AS (SELECT floor(x * 64) AS part, sum(neg) AS neg FROM s GROUP BY floor(x * 64)),
o AS (SELECT part, coalesce(sum(neg) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM b),
r AS (SELECT pos, neg, o.below + coalesce(sum(neg) OVER (PARTITION BY o.part ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM s JOIN o ON floor(x * 64) = o.part)
SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM r""",
    "ndcg": """WITH r AS (SELECT contest_id, won, n, row_number() OVER (PARTITION BY contest_id ORDER BY round(p, 9) DESC, entity_id) AS k, row_number() OVER (PARTITION BY contest_id ORDER BY won DESC, entity_id) AS ideal FROM market WHERE n >= 2)
SELECT contest_id, round(sum(won / (ln(1 + k) / ln(2))) / nullif(sum(won / (ln(1 + ideal) / ln(2))), 0), 6) AS ndcg FROM r GROUP BY contest_id""",
    "ece_equal_width": f"SELECT round(sum(n * abs(mean_score - win_rate)) / sum(n), 5) AS ece FROM ({calibration('p')}) x",
    "reliability_wilson": f"""SELECT bin, n, mean_score, win_rate, round((win_rate + 1.9208 / n - 1.96 * sqrt((win_rate * (1 - win_rate) + 0.9604 / n) / n)) / (1 + 3.8416 / n), 5) AS low,
round((win_rate + 1.9208 / n + 1.96 * sqrt((win_rate * (1 - win_rate) + 0.9604 / n) / n)) / (1 + 3.8416 / n), 5) AS high FROM ({calibration('p')}) x""",
    "ece_by_field_size": "SELECT n, cast(count(*) AS bigint) AS entries, round(abs(avg(p) - avg(cast(won AS double))), 6) AS gap FROM market GROUP BY n",
    "winner_nll": """SELECT cast(count(*) AS bigint) AS contests, cast(count(CASE WHEN winners <> 1 THEN 1 END) AS bigint) AS excluded, round(avg(CASE WHEN winners = 1 THEN -ln(pw) END), 6) AS nll, round(avg(CASE WHEN winners = 1 THEN ln(n) END), 6) AS uniform_nll
FROM (SELECT contest_id, sum(won) AS winners, max(CASE WHEN won = 1 THEN p END) AS pw, max(n) AS n FROM market GROUP BY contest_id) x""",
    "market_edge_buckets": """SELECT edge, cast(count(*) AS bigint) AS n, round(avg(p - q), 6) AS mean_edge, round(avg(cast(won AS double)), 6) AS win_rate FROM (SELECT *, CASE WHEN p - q < -0.02 THEN 'under' WHEN p - q < 0.02 THEN 'near' ELSE 'over' END AS edge FROM market) x GROUP BY edge""",
    "segment_edge": """SELECT axis, segment, cast(count(*) AS bigint) AS n, round(avg(cast(won AS double)), 6) AS win_rate, round(avg(p), 6) AS mean_p, round(avg(q), 6) AS mean_q FROM (
SELECT 'class' AS axis, class AS segment, won, p, q FROM market UNION ALL SELECT 'venue', venue, won, p, q FROM market UNION ALL SELECT 'field', cast(n AS varchar(9)), won, p, q FROM market) x GROUP BY axis, segment""",
    "ks_distance": """WITH s AS (SELECT round(p, 3) AS x, sum(CASE WHEN won = 1 THEN 1.0 ELSE 0.0 END) AS a, sum(CASE WHEN won = 0 THEN 1.0 ELSE 0.0 END) AS b FROM market GROUP BY round(p, 3)),
c AS (SELECT cast(sum(a) OVER (ORDER BY x) AS double) / cast(sum(a) OVER () AS double) - cast(sum(b) OVER (ORDER BY x) AS double) / cast(sum(b) OVER () AS double) AS gap FROM s) SELECT round(max(abs(gap)), 6) AS ks FROM c""",
    "day_cluster_bootstrap": """WITH d AS (SELECT day, sum(p - won) AS s, count(*) AS n FROM market GROUP BY day), i AS (SELECT s, n, row_number() OVER (ORDER BY day) - 1 AS k, count(*) OVER () AS days FROM d),
r AS (SELECT 0 AS rep UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7),
w AS (SELECT rep, (cast(rep AS bigint) * 1103515245 + cast(k AS bigint) * 12345 + 7) % 2147483648 % days AS pick FROM i CROSS JOIN r), c AS (SELECT rep, pick, count(*) AS times FROM w GROUP BY rep, pick)
SELECT rep, round(sum(s * times) / sum(n * times), 6) AS mean_diff FROM c JOIN i ON pick = k GROUP BY rep""",
    "day_cluster_bootstrap_ci": day_bootstrap(),
    "entropy_dispersion": """SELECT contest_id, round(CASE WHEN max(n) > 1 THEN -sum(q * ln(q)) / ln(max(n)) END, 6) AS entropy, round(max(q), 6) AS favourite, round(sum(CASE WHEN rk <= 3 THEN q END), 6) AS top3_share
FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY q DESC, entity_id) AS rk FROM market) x GROUP BY contest_id""",
    "divergence_band": "SELECT contest_id, entity_id, CASE WHEN p < q - greatest(0.03, 0.5 * q) THEN 'below' WHEN p > q + greatest(0.03, 0.5 * q) THEN 'above' ELSE 'near' END AS band FROM market",
    "top_k_by_value": """SELECT contest_id, entity_id, k FROM (SELECT contest_id, entity_id, cast(row_number() OVER (PARTITION BY contest_id ORDER BY round(p * odds, 9) DESC, entity_id) AS bigint) AS k FROM market WHERE p * odds >= 0.5) x WHERE k <= 3""",
    "favourite_lowest_price": "SELECT contest_id, entity_id, odds, won FROM (SELECT *, row_number() OVER (PARTITION BY contest_id ORDER BY odds, entity_id) AS k FROM market) x WHERE k = 1",
    "stride_sample": """SELECT contest_id, entity_id FROM (SELECT contest_id, entity_id, n, row_number() OVER (PARTITION BY contest_id ORDER BY entity_id) - 1 AS k FROM market) x WHERE n <= 3 OR k IN (contest_id % n, (contest_id + n // 3) % n, (contest_id + 2 * n // 3) % n)""",
    "ev_selection": "SELECT contest_id, entity_id, round(p * odds, 6) AS ev FROM market WHERE p * odds >= 0.8 AND odds <= 15",
    "settlement_win": """SELECT contest_id, entity_id, CASE WHEN won = 0 THEN 0 WHEN winners = 1 THEN 1 END AS hit, round(CASE WHEN won = 0 THEN 0 WHEN winners = 1 THEN odds END, 6) AS dividend FROM (SELECT *, sum(won) OVER (PARTITION BY contest_id) AS winners FROM runs) x""",
    "roi_by_year_band": """SELECT year(day) AS y, CASE WHEN odds < 3 THEN 'short' WHEN odds < 8 THEN 'mid' ELSE 'long' END AS band, cast(count(*) AS bigint) AS bets, round(sum(won * odds) / count(*), 6) AS recovery FROM market
GROUP BY year(day), CASE WHEN odds < 3 THEN 'short' WHEN odds < 8 THEN 'mid' ELSE 'long' END""",
    "kelly_fraction": "SELECT contest_id, entity_id, round(least(0.05, greatest(0, 0.5 * (p * odds - 1) / (odds - 1))), 6) AS fraction FROM market WHERE odds > 1",
    "drawdown_by_year": """WITH b AS (SELECT year(day) AS y, contest_id, sum(won * odds - 1) AS r FROM market WHERE popularity = 1 GROUP BY year(day), contest_id),
c AS (SELECT y, contest_id, sum(r) OVER (PARTITION BY y ORDER BY contest_id) AS bank FROM b), d AS (SELECT y, bank, max(bank) OVER (PARTITION BY y ORDER BY contest_id) AS peak FROM c)
SELECT y, round(max(peak - bank), 4) AS drawdown FROM d GROUP BY y""",
    "losing_streak": """WITH b AS (SELECT year(day) AS y, contest_id, max(won) AS hit FROM market WHERE popularity = 1 GROUP BY year(day), contest_id),
g AS (SELECT y, hit, row_number() OVER (PARTITION BY y ORDER BY contest_id) - row_number() OVER (PARTITION BY y, hit ORDER BY contest_id) AS island FROM b)
SELECT y, cast(max(len) AS bigint) AS longest FROM (SELECT y, count(*) AS len FROM g WHERE hit = 0 GROUP BY y, island) x GROUP BY y""",
    "policy_gate": """SELECT policy, y, cast(count(*) AS bigint) AS bets, round(avg(won * odds), 6) AS recovery FROM (SELECT 'ev' AS policy, year(day) AS y, won, odds FROM market WHERE p * odds >= 0.9
UNION ALL SELECT 'favourite', year(day), won, odds FROM market WHERE popularity = 1 UNION ALL SELECT 'uniform', year(day), won, odds FROM market) x GROUP BY policy, y""",
    "paired_arms": """SELECT day, round(sum(-ln(p) + ln(q)), 6) AS diff, cast(count(*) AS bigint) AS contests FROM market WHERE won = 1 GROUP BY day""",
    "popularity_sum": f"""SELECT a.contest_id, a.popularity + b.popularity AS s, round(sum(a.q * b.q / (1 - a.q)), 6) AS mass FROM {PAIR} GROUP BY a.contest_id, a.popularity + b.popularity""",
    "prequential_gamma": """WITH f AS (SELECT year(day) AS y, sum(won * q) AS s, sum(q * q) AS ss FROM market GROUP BY year(day))
SELECT a.y AS eval_year, round(sum(b.s) / sum(b.ss), 6) AS slope FROM f a JOIN f b ON b.y < a.y GROUP BY a.y""",
    "residual_score": "SELECT contest_id, round(sum((won - p) * weight), 4) + 0e0 AS score, round(sum(p * weight * weight) - sum(p * weight) * sum(p * weight), 4) + 0e0 AS information FROM market GROUP BY contest_id",
    "expanding_folds": "SELECT contest_id, cast(ntile(5) OVER (ORDER BY day, contest_id) AS bigint) AS fold FROM (SELECT DISTINCT contest_id, day FROM market) x",
    "served_predictions": """SELECT contest_id, entity_id, round(least(1, greatest(p, 0)), 6) AS win, round(greatest(p, least(1, p * 2)), 6) AS top2, round(greatest(p, least(1, p * 3)), 6) AS top3 FROM market""",
    "shadow_log_rollup": """SELECT year(day) AS y, month(day) AS m, cast(count(*) AS bigint) AS bets, cast(count(CASE WHEN result_status IS NULL THEN 1 END) AS bigint) AS pending, cast(sum(won) AS bigint) AS hits, round(sum(won * odds) / count(*), 6) AS recovery FROM panel WHERE popularity = 1 GROUP BY year(day), month(day)""",
    "holm_by_class": """WITH z AS (SELECT class, abs(sum(won - q)) / sqrt(sum(q * (1 - q))) AS z FROM market GROUP BY class),
r AS (SELECT class, exp(-0.5 * z * z) AS pv, row_number() OVER (ORDER BY exp(-0.5 * z * z), class) AS k, count(*) OVER () AS m FROM z)
SELECT class, round(least(1.0, max(pv * (m - k + 1)) OVER (ORDER BY k)), 6) AS adjusted FROM r""",
}
