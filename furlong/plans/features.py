"""Scans, filters, joins and as-of feature blocks over the contest panel."""

BEFORE = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def rate_before(key: str, hit: str, least: int = 1) -> str:
    return f"""WITH d AS (SELECT {key}, day, count(*) AS starts, sum({hit}) AS hits FROM runs WHERE {key} IS NOT NULL GROUP BY {key}, day),
b AS (SELECT {key}, day, sum(starts) OVER w AS s, sum(hits) OVER w AS h FROM d WINDOW w AS (PARTITION BY {key} ORDER BY day {BEFORE}))
SELECT contest_id, entity_id, round(CASE WHEN s >= {least} THEN cast(h AS double) / s END, 6) AS rate, cast(coalesce(s, 0) AS bigint) AS starts_before
FROM runs JOIN b USING ({key}, day)"""


def cell_rate(*keys: str) -> str:
    k = ", ".join(keys)
    return f"""WITH r AS (SELECT *, CASE WHEN distance <= 1400 THEN 1 WHEN distance <= 1800 THEN 2 WHEN distance <= 2200 THEN 3 ELSE 4 END AS band FROM runs),
d AS (SELECT {k}, day, count(*) AS starts, sum(won) AS wins FROM r GROUP BY {k}, day),
b AS (SELECT {k}, day, sum(starts) OVER w AS s, sum(wins) OVER w AS h FROM d WINDOW w AS (PARTITION BY {k} ORDER BY day {BEFORE}))
SELECT contest_id, entity_id, band, round(cast(h AS double) / s, 6) AS rate FROM r JOIN b USING ({k}, day)"""


def rolling(value: str, k: int, fn: str = "avg") -> str:
    """Mean of the last k values of earlier days, one row per entity and day as source."""
    return f"""WITH v AS (SELECT entity_id, day, contest_id, {value} AS x FROM runs WHERE ({value}) IS NOT NULL),
r AS (SELECT entity_id, day, contest_id, {fn}(x) OVER (PARTITION BY entity_id ORDER BY day, contest_id ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS m,
  row_number() OVER (PARTITION BY entity_id, day ORDER BY contest_id DESC) AS last_of_day FROM v),
s AS (SELECT entity_id, day, m FROM r WHERE last_of_day = 1),
t AS (SELECT entity_id, day, m, 1 AS src FROM s UNION ALL SELECT DISTINCT entity_id, day, cast(NULL AS double) AS m, 0 AS src FROM runs),
g AS (SELECT entity_id, day, src, m, count(m) OVER (PARTITION BY entity_id ORDER BY day, src) AS grp FROM t),
f AS (SELECT entity_id, day, src, max(m) OVER (PARTITION BY entity_id, grp) AS before_value FROM g)
SELECT contest_id, runs.entity_id, round(before_value, 6) AS value FROM runs JOIN f ON runs.entity_id = f.entity_id AND runs.day = f.day AND f.src = 0"""


SQL = {
    "expectations": """SELECT 'entry_status' AS rule, cast(count(CASE WHEN entry_status NOT IN ('started', 'cancelled') THEN 1 END) AS bigint) AS broken FROM panel
UNION ALL SELECT 'finished_has_order', cast(count(CASE WHEN result_status = 'finished' AND finish_order IS NULL THEN 1 END) AS bigint) FROM panel
UNION ALL SELECT 'odds_positive', cast(count(CASE WHEN NOT odds > 0 THEN 1 END) AS bigint) FROM panel
UNION ALL SELECT 'unique_key', cast(count(*) AS bigint) FROM (SELECT contest_id, entity_id FROM panel GROUP BY contest_id, entity_id HAVING count(*) > 1) x
UNION ALL SELECT 'monotone_labels', cast(count(CASE WHEN won > top2 OR top2 > top3 THEN 1 END) AS bigint) FROM panel""",
    "duplicate_report": "SELECT l_orderkey, l_linenumber, cast(count(*) AS bigint) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1",
    "dedupe_keep_newest": """SELECT l_orderkey, l_linenumber, l_partkey, kept FROM (SELECT l_orderkey, l_linenumber, l_partkey,
  CASE WHEN row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END, l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice) = 1 THEN 1 ELSE 0 END AS kept FROM lineitem) x""",
    "upsert_last_write": """WITH loads AS (SELECT user_id, event_type, value, event_id FROM events)
SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS rn FROM loads) x WHERE rn = 1""",
    "insert_if_absent": """SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)
UNION ALL SELECT DISTINCT o_custkey, 'seen' FROM orders""",
    "fill_null_only": """SELECT contest_id, entity_id, coalesce(finish_order, cast(popularity AS bigint)) AS filled, CASE WHEN finish_order IS NULL THEN 1 ELSE 0 END AS was_null FROM panel""",
    "load_audit": """SELECT year(o_orderdate) AS load_year, cast(count(*) AS bigint) AS processed, cast(count(CASE WHEN o_totalprice IS NULL OR o_totalprice <= 0 THEN 1 END) AS bigint) AS errors,
  cast(count(CASE WHEN o_orderdate < date '1996-01-01' THEN 1 END) AS bigint) AS skipped FROM orders GROUP BY year(o_orderdate)""",
    "windowed_load": "SELECT contest_id, entity_id, day, odds FROM panel WHERE day BETWEEN date '1997-01-01' AND date '1997-12-31'",
    "eval_panel_load": """SELECT contest_id, cast(count(*) AS bigint) AS started, cast(count(result_status) AS bigint) AS with_result, cast(sum(won) AS bigint) AS winners,
  CASE WHEN sum(won) = 1 AND count(finish_order) = count(*) THEN 1 ELSE 0 END AS eligible FROM runs GROUP BY contest_id""",
    "page_id_extract": r"""SELECT page_id, regexp_extract(url, '([a-z0-9.-]+)/', 1) AS host, regexp_extract(url, '([0-9]+)[^0-9]*$', 1) AS last_number FROM pages""",
    "coverage_band": """SELECT entity_id, n, CASE WHEN n = 0 THEN 'none' WHEN n < 5 THEN 'low' WHEN n < 20 THEN 'mid' ELSE 'high' END AS band
FROM (SELECT entity_id, cast(count(*) AS bigint) AS n FROM runs GROUP BY entity_id) x""",
    "identity_resolution": """SELECT s_suppkey AS source_id, s_name, CASE WHEN c_custkey IS NULL THEN 'unmapped' WHEN s_nationkey <> c_nationkey THEN 'conflict' ELSE 'mapped' END AS status
FROM supplier LEFT JOIN customer ON replace(s_name, 'Supplier', '') = replace(c_name, 'Customer', '')""",
    "status_normalise": "SELECT contest_id, entity_id, CASE WHEN finish_order >= 1 THEN 'finished' WHEN started = 1 THEN 'stopped' ELSE 'never_ran' END AS status FROM panel",
    "labels_dead_heat": "SELECT contest_id, entity_id, won, top2, top3 FROM panel",
    "static_features": """SELECT contest_id, entity_id, cast(count(*) OVER (PARTITION BY contest_id) AS bigint) AS field_size,
  round(weight - avg(weight) OVER (PARTITION BY contest_id), 6) AS weight_minus_mean, cast(month(day) AS bigint) AS month_of_day,
  cast(CASE WHEN month(day) IN (3, 4, 5) THEN 1 WHEN month(day) IN (6, 7, 8) THEN 2 WHEN month(day) IN (9, 10, 11) THEN 3 ELSE 4 END AS bigint) AS season, round(ln(1 + price), 6) AS log_prize FROM runs""",
    "full_odds_filter": """SELECT year(day) AS y, cast(count(*) AS bigint) AS contests, cast(sum(full_odds) AS bigint) AS full_contests
FROM (SELECT contest_id, min(day) AS day, CASE WHEN count(CASE WHEN odds > 1.2 THEN 1 END) = count(*) THEN 1 ELSE 0 END AS full_odds FROM runs GROUP BY contest_id) x GROUP BY year(day)""",
    "eligibility_ledger": """SELECT reason, cast(count(*) AS bigint) AS n FROM (SELECT contest_id, CASE WHEN count(*) < 2 THEN 'small_field' WHEN sum(won) = 0 THEN 'no_winner' WHEN sum(won) > 1 THEN 'dead_heat' ELSE 'eligible' END AS reason
FROM runs GROUP BY contest_id) x GROUP BY reason""",
    "readiness": """SELECT contest_id, CASE WHEN count(DISTINCT entity_id) < count(*) THEN 'duplicate' WHEN count(CASE WHEN odds > 0 THEN 1 END) < count(*) THEN 'odds_missing'
  WHEN count(finish_order) > 0 THEN 'has_results' ELSE 'ready' END AS state FROM runs GROUP BY contest_id""",
    "pending_anti_join": "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)",
    "career_before": """SELECT contest_id, runs.entity_id, cast(starts_before AS bigint) AS starts_before, cast(wins_before AS bigint) AS wins_before, round(cast(orders_sum AS double) / orders_n, 6) AS avg_finish,
  CASE WHEN starts_before = 0 THEN 1 ELSE 0 END AS is_debut, CASE WHEN starts_before < 3 THEN 1 ELSE 0 END AS low_history FROM runs JOIN before ON runs.entity_id = before.entity_id AND runs.day = before.day""",
    "agent_rate_before": rate_before("agent_id", "won"),
    "owner_rate_before": rate_before("owner_id", "won", 20),
    "venue_rate_before": rate_before("venue", "top3"),
    "aptitude_by_band": cell_rate("entity_id", "band"),
    "aptitude_by_venue_band": cell_rate("venue", "band"),
    "recent_form_3": rolling("finish_order", 3),
    "recent_win_rate_5": rolling("cast(won AS double)", 5),
    "past_market_5": rolling("cast(popularity AS double)", 5),
    "best_last_5": rolling("cast(popularity AS double)", 5, "min"),
    "pedigree_other_offspring": """WITH d AS (SELECT sire, day, count(*) AS s, sum(won) AS w FROM runs GROUP BY sire, day),
sb AS (SELECT sire, day, sum(s) OVER x AS s, sum(w) OVER x AS w FROM d WINDOW x AS (PARTITION BY sire ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT contest_id, runs.entity_id, round(CASE WHEN sb.s - starts_before >= 10 THEN cast(sb.w - wins_before AS double) / (sb.s - starts_before) END, 9) AS other_rate
FROM runs JOIN sb ON runs.sire = sb.sire AND runs.day = sb.day JOIN before ON runs.entity_id = before.entity_id AND runs.day = before.day""",
    "debut_pedigree": """WITH f AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day, contest_id) AS k FROM runs),
d AS (SELECT sire, day, count(*) AS s, sum(won) AS w FROM f WHERE k = 1 GROUP BY sire, day),
b AS (SELECT sire, day, sum(s) OVER x AS s, sum(w) OVER x AS w FROM d WINDOW x AS (PARTITION BY sire ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT contest_id, entity_id, round(coalesce(cast(b.w AS double) / b.s, 0), 6) AS sire_debut_rate FROM f JOIN b ON f.sire = b.sire AND f.day = b.day WHERE k = 1""",
    "leave_one_out_field": """SELECT contest_id, entity_id, round((sum(weight) OVER (PARTITION BY contest_id) - weight) / nullif(count(*) OVER (PARTITION BY contest_id) - 1, 0), 6) AS others_mean FROM runs""",
    "speed_figure": """WITH d AS (SELECT venue, class, day, count(*) AS n, sum(price / weight) AS s, sum(price / weight * (price / weight)) AS ss FROM runs GROUP BY venue, class, day),
b AS (SELECT venue, class, day, sum(n) OVER w AS n, sum(s) OVER w AS s, sum(ss) OVER w AS ss FROM d WINDOW w AS (PARTITION BY venue, class ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT contest_id, entity_id, CASE WHEN n >= 50 THEN round(least(5.0, greatest(-5.0, (price / weight - s / n) / sqrt(ss / n - s / n * (s / n)))), 4) END AS z
FROM runs JOIN b ON runs.venue = b.venue AND runs.class = b.class AND runs.day = b.day""",
    "market_primitive": "SELECT contest_id, entity_id, round(q, 9) AS q, round(ln(q * n), 9) AS support FROM market",
    "support_shrunk": """WITH m AS (SELECT entity_id, day, sum(ln(q * n)) AS s, count(*) AS c FROM market GROUP BY entity_id, day),
b AS (SELECT entity_id, day, sum(s) OVER w AS s, sum(c) OVER w AS c FROM m WINDOW w AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT entity_id, day, round(coalesce(s, 0) / (coalesce(c, 0) + 5), 6) + 0e0 AS support_career FROM b""",
    "rank_percentile": """SELECT contest_id, entity_id, round(CASE WHEN count(*) OVER (PARTITION BY contest_id) > 1 THEN 1 - cast(popularity_started - 1 AS double) / (count(*) OVER (PARTITION BY contest_id) - 1) END, 6) AS pct
FROM (SELECT *, rank() OVER (PARTITION BY contest_id ORDER BY odds) AS popularity_started FROM runs) x""",
    "expectation_residual": "SELECT contest_id, entity_id, round(won - q, 9) AS win_residual, round(1 - cast(finish_order - 1 AS double) / n - q, 9) AS finish_residual FROM market",
    "conditioned_shrunk": """WITH d AS (SELECT entity_id, class, day, sum(won) AS s, count(*) AS n FROM runs GROUP BY entity_id, class, day),
c AS (SELECT entity_id, class, day, sum(s) OVER w AS s, sum(n) OVER w AS n FROM d WINDOW w AS (PARTITION BY entity_id, class ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT contest_id, runs.entity_id, round((coalesce(c.s, 0) + 5 * coalesce(cast(wins_before AS double) / nullif(starts_before, 0), 0)) / (coalesce(c.n, 0) + 5), 6) AS shrunk
FROM runs JOIN c ON runs.entity_id = c.entity_id AND runs.class = c.class AND runs.day = c.day JOIN before ON runs.entity_id = before.entity_id AND runs.day = before.day""",
    "lag_attributes": """SELECT contest_id, entity_id, cast(datediff('day', lag(day) OVER w, day) AS bigint) AS gap1, cast(datediff('day', lag(day, 2) OVER w, day) AS bigint) AS gap2, cast(row_number() OVER w - 1 AS bigint) AS prior_starts
FROM runs WINDOW w AS (PARTITION BY entity_id ORDER BY day, contest_id)""",
    "class_change": """SELECT contest_id, entity_id, cast(substring(class, 1, 1) AS bigint) - cast(substring(lag(class) OVER (PARTITION BY entity_id ORDER BY day, contest_id), 1, 1) AS bigint) AS class_step,
  CASE WHEN agent_id <> lag(agent_id) OVER (PARTITION BY entity_id ORDER BY day, contest_id) THEN 1 ELSE 0 END AS agent_changed FROM runs""",
    "target_encoding": """WITH g AS (SELECT venue, sum(won) AS s, count(*) AS n FROM runs GROUP BY venue), t AS (SELECT avg(cast(won AS double)) AS prior FROM runs)
SELECT venue, round((s + 20 * prior) / (n + 20), 6) AS encoded FROM g CROSS JOIN t""",
    "target_encoding_oof": """WITH f AS (SELECT venue, contest_id % 5 AS fold, sum(won) AS s, count(*) AS n FROM runs GROUP BY venue, contest_id % 5)
SELECT venue, fold, round((sum(s) OVER (PARTITION BY venue) - s + 2e0) / (sum(n) OVER (PARTITION BY venue) - n + 20e0), 6) AS encoded FROM f""",
    "entity_profile": """SELECT entity_id, cast(count(*) AS bigint) AS starts, cast(sum(won) AS bigint) AS wins, cast(sum(top3) AS bigint) AS places, round(avg(cast(finish_order AS double)), 6) AS avg_finish, max(day) AS last_day FROM runs GROUP BY entity_id""",
    "coverage_by_day": """SELECT day, cast(count(DISTINCT contest_id) AS bigint) AS contests, cast(count(DISTINCT CASE WHEN finish_order IS NOT NULL THEN contest_id END) AS bigint) AS with_results FROM panel GROUP BY day""",
    "history_page": """SELECT contest_id, entity_id, day FROM panel WHERE entity_id = (SELECT min(entity_id) FROM panel) ORDER BY day DESC, contest_id LIMIT 10 OFFSET 5""",
    "contest_page": "SELECT contest_id, day, class FROM (SELECT DISTINCT contest_id, day, class FROM panel) x ORDER BY day DESC NULLS LAST, class, contest_id LIMIT 50 OFFSET 100",
    "set_equality": """SELECT (SELECT count(*) FROM (SELECT contest_id FROM runs EXCEPT SELECT o_orderkey FROM orders) a) AS only_left,
  (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT contest_id FROM runs) b) AS only_right""",
    "policy_overlap": """SELECT cast(count(*) AS bigint) AS both_select FROM (SELECT contest_id, entity_id FROM market WHERE p * odds >= 0.9 INTERSECT SELECT contest_id, entity_id FROM market WHERE odds <= 6) x""",
    "subgroup_labels": """SELECT y, segment, cast(count(*) AS bigint) AS n, round(avg(cast(won AS double)), 6) AS win_rate FROM (
  SELECT year(day) AS y, CASE WHEN n <= 3 THEN 'small' WHEN n <= 7 THEN 'mid' ELSE 'large' END AS segment, won FROM market) x GROUP BY y, segment""",
    "event_json_fields": r"""SELECT event_type, cast(count(*) AS bigint) AS n, cast(count(CASE WHEN props LIKE '{%}' THEN 1 END) AS bigint) AS objects FROM events GROUP BY event_type""",
    "race_card": """SELECT contest_id, entity_id, entity_name, s_name AS agent_name, c_name AS owner_name FROM panel LEFT JOIN supplier ON agent_id = s_suppkey LEFT JOIN customer ON owner_id = c_custkey""",
    "folds_by_year": """SELECT y, cast(sum(n) OVER (ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bigint) AS train_rows, n AS valid_rows FROM (SELECT year(day) AS y, cast(count(*) AS bigint) AS n FROM runs GROUP BY year(day)) x""",
}
