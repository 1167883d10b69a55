"""Loads, text fields, grids and the feature store, run over what Spark derives from the tables; oracles start from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as t
from ..operators import joint
from ..sources import core, store
from ..sources.panel import market, panel, runs
from ..sources.places import work_dir

#: Venue names and their codes.
VENUES = {"東京": "05", "中山": "06", "阪神": "09", "京都": "08", "中京": "07"}
YEAR_COLUMNS = ["contest", "day", "venue", "time", "gap", *[f"note_{i}" for i in range(68)]]


def table(s: SparkSession, d: str, name: str) -> DataFrame:
    return s.read.parquet(f"{d}/{name}.parquet")


def timed(s: SparkSession, d: str) -> DataFrame:
    """Orders with a venue name, a finish time, and the text forms of both and of the day."""
    tenth = F.col("o_orderkey") % 1000
    o = table(s, d, "orders").withColumns({"venue": F.element_at(F.array(*[F.lit(v) for v in VENUES]), (F.col("o_custkey") % 5 + 1).cast("int")), "tenths": 600 + tenth})
    m, rest = F.floor(F.col("tenths") / 600), F.col("tenths") % 600
    sep = F.when(F.col("o_orderkey") % 2 == 0, ".").otherwise(":")
    clock = F.concat(m.cast("string"), sep, F.lpad(F.floor(rest / 10).cast("string"), 2, "0"), F.lit("."), (rest % 10).cast("string"))
    return o.withColumns({"clock": F.when(F.col("o_orderkey") % 11 == 0, "----").otherwise(clock), "dotted": F.date_format("o_orderdate", "yyyy.M.d")})


def year_file(s: SparkSession, d: str) -> DataFrame:
    """A file in the feed's own encoding and 73 columns, some rows short of two, read back by venue, bad rows as errors."""
    path = work_dir(s)
    cells = [F.col("o_orderkey").cast("string"), F.col("dotted"), F.col("venue"), F.col("clock"), F.lit("")]
    line = F.concat_ws(",", *cells, *[F.lit("x")] * 66)
    full = F.when(F.col("o_orderkey") % 97 == 0, line).otherwise(F.concat_ws(",", line, F.lit("y"), F.lit("z")))
    with core.wide_charsets(s):
        encoded = timed(s, d).select(F.encode(full, "MS932").cast("string").alias("value"))
    encoded.write.text(path)
    rows, errors = core.read_year_file(s, path, YEAR_COLUMNS)
    code = F.create_map(*[F.lit(x) for kv in VENUES.items() for x in kv])
    good = rows.groupBy(code[F.col("venue")].alias("venue")).agg(F.count("*").alias("n"), F.round(F.sum(t.seconds(F.col("time"))), 1).alias("seconds"), F.max(t.dotted_date(F.col("day"))).alias("last_day"))
    bad = errors.filter("line >= 1").agg(F.count("*").alias("n"))
    return good.unionByName(bad.select(F.lit("error").alias("venue"), "n", F.lit(None).cast("double").alias("seconds"), F.lit(None).cast("date").alias("last_day")))


def core_records(s: SparkSession, d: str) -> DataFrame:
    """Flat entry rows as the rows of each core table."""
    raw = panel(s, d).select("contest_id", "day", "class", "entity_id", "entity_name", "agent_id", "owner_id", "entry_status", "finish_order")
    tables = {"contests": ["contest_id", "day", "class"], "entities": ["entity_id", "entity_name"], "agents": ["agent_id"], "owners": ["owner_id"], "entries": ["contest_id", "entity_id", "entry_status"]}
    out = raw.filter("finish_order is not null").agg(F.lit("results").alias("name"), F.count("*").alias("n"))
    for name, cols in tables.items():
        out = out.unionByName(raw.select(*cols).dropDuplicates(cols[:1] if name != "entries" else cols[:2]).agg(F.lit(name).alias("name"), F.count("*").alias("n")))
    return out


def _loads(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = table(s, d, "events").select("user_id", "event_type", "value", "event_id")
    return e.filter("event_id % 2 = 0"), e.filter("event_id % 2 = 1")


def upsert_last_write(s: SparkSession, d: str) -> DataFrame:
    old, new = _loads(s, d)
    first = core.upsert(old.limit(0), old, ["user_id", "event_type"], "event_id")
    return core.upsert(first.select(*old.columns), new, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


def insert_if_absent(s: SparkSession, d: str) -> DataFrame:
    old, new = _loads(s, d)
    old = core.insert_if_absent(old.limit(0), old.filter("event_type = 'click'"), ["user_id", "event_type"], "event_id")
    return core.insert_if_absent(old, new, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "value")


def fill_null_only(s: SparkSession, d: str) -> DataFrame:
    p = panel(s, d).select("contest_id", "entity_id", F.when(F.col("entity_id") % 3 != 0, F.col("odds")).alias("odds"), (F.col("result_status") == "finished").alias("finished"))
    new = panel(s, d).select("contest_id", "entity_id", F.when(F.col("entity_id") % 5 != 0, F.round(F.col("odds") + 1, 1)).alias("odds"))
    return core.fill_nulls(p, new, ["contest_id", "entity_id"], ["odds"], F.coalesce("finished", F.lit(False))).select("contest_id", "entity_id", "odds")


def rekey_facts(s: SparkSession, d: str) -> DataFrame:
    facts = table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    u = F.col("user_id")
    ids = facts.select("user_id").distinct().select(u.alias("source_id"), (u - u % 4).alias("canonical_id"), F.when(u % 3 == 0, "mapped").otherwise("unmapped").alias("status"))
    out, refused = core.rekey(facts, ids, "user_id", ["user_id", "event_type"])
    left = out.select("user_id", "event_type", "n", F.lit(0).alias("refused"))
    return left.unionByName(refused.select("user_id", "event_type", "n", F.lit(1).alias("refused")))


def _pair_odds(s: SparkSession, d: str) -> DataFrame:
    q = joint.quinella(market(s, d), p="q")
    return q.select("contest_id", "low", "high", F.round(F.least(F.lit(9999.0), 0.75 / F.col("prob")), 6).alias("odds"))


def combination_quotes(s: SparkSession, d: str) -> DataFrame:
    """Quotes of all pairs as one JSON object a contest, keys in either order and some without a number, parsed back."""
    key = F.concat_ws("-", *[F.when(F.col("low") % 2 == 0, F.col(a)).otherwise(F.col(b)) for a, b in (("high", "low"), ("low", "high"))])
    quoted = F.when((F.col("low") + F.col("high")) % 9 == 0, "--").otherwise(F.col("odds").cast("string"))
    payload = _pair_odds(s, d).groupBy("contest_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key, quoted)))).alias("payload"))
    out = core.parse_combinations(payload, "payload")
    return out.select("contest_id", F.col("selection")[0].alias("low"), F.col("selection")[1].alias("high"), "odds")


def place_ranges(s: SparkSession, d: str) -> DataFrame:
    """Place quotes as JSON ranges; every seventh entity's is inverted."""
    a, b = F.round(F.col("odds") * 0.3, 1), F.round(F.col("odds") * 0.5 + 1, 1)
    bad = F.col("entity_id") % 7 == 0
    entry = F.struct(F.col("entity_id").cast("string"), F.array(*[x.cast("string") for x in (F.when(bad, b).otherwise(a), F.when(bad, a).otherwise(b), F.lit(1))]))
    odds = F.struct(F.map_from_entries(F.collect_list(entry)).alias("2"))
    payload = runs(s, d).groupBy("contest_id").agg(F.to_json(F.struct(F.struct(odds.alias("odds")).alias("data"))).alias("payload"))
    return core.parse_ranges(payload, "payload").select("contest_id", F.col("entity").cast("long").alias("entity_id"), "low", "high")


def price_grid(s: SparkSession, d: str) -> DataFrame:
    """One map of prices for each contest, and what it holds for the pair that came first and second."""
    key = F.concat_ws("-", "low", "high")
    grid = _pair_odds(s, d).groupBy("contest_id").agg(F.map_from_entries(F.collect_list(F.struct(key, "odds"))).alias("quotes"))
    pair = F.array_sort(F.collect_list(F.when(F.col("finish_order") <= 2, F.col("entity_id"))))
    first = runs(s, d).groupBy("contest_id").agg(pair.alias("p"), F.count_if(F.col("finish_order") == 1).alias("a"), F.count_if(F.col("finish_order") == 2).alias("b")).filter("a = 1 and b = 1")
    out = grid.join(first, "contest_id")
    return out.select("contest_id", F.size("quotes").alias("n"), F.try_element_at("quotes", F.array_join(F.col("p").cast("array<string>"), "-")).alias("price"))


def lap_profile(s: SparkSession, d: str) -> DataFrame:
    """Each order's quantities as an array in line order: first, last, number, and largest fall from one to the next."""
    rows = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "l_partkey"))).alias("r"))
    a = F.transform("r", lambda x: x["l_quantity"])
    out = rows.select("l_orderkey", a.alias("a"))
    return out.select("l_orderkey", F.size("a").alias("n"), F.col("a")[0].alias("first"), F.element_at("a", -1).alias("last"), t.largest_gain(F.col("a")).alias("gain"), t.running_style(F.col("a")[0].cast("int"), F.lit(30)).alias("style"))


def parse_fields(s: SparkSession, d: str) -> DataFrame:
    o = timed(s, d)
    k = F.col("o_orderkey")
    post = F.when(k % 13 != 0, (k % 9000) - 500)
    return o.select(
        "o_orderkey", t.seconds(F.col("clock")).alias("secs"), t.dotted_date(F.concat(F.lit("　"), F.col("dotted"), F.lit(" "))).alias("day"), t.to_int(F.concat(F.lit(" "), k.cast("string"), F.when(k % 7 == 0, "x").otherwise(""))).alias("number"),
        t.meeting_number(F.upper(F.conv((k % 17).cast("string"), 10, 16))).alias("meeting"), t.horizon(post).alias("horizon"), t.capture_strength(k % 2 == 0, k % 3 != 0, k % 5 != 0, k % 7 != 0).alias("strength"),
        t.has_token(F.concat(F.lit("v=1;prospective="), (k % 12).cast("string")), "prospective=1").alias("prospective"),
        t.contest_key(F.year("o_orderdate"), F.lit("05"), (k % 5).cast("int"), (k % 12).cast("int"), (k % 9).cast("int")).alias("contest"),
    )


def name_forms(s: SparkSession, d: str) -> DataFrame:
    """Names in full-width letters behind a marker, brought back by the translation alone and by exact NFKC."""
    c = table(s, d, "customer")
    wide = F.concat(F.lit("◎　"), F.translate("c_name", t.HALF, t.FULL), F.lit("　"))
    c = t.nfkc(c.withColumn("wide", wide), "wide", "exact")
    return c.select("c_custkey", t.strip_markers(t.half_width(F.col("wide"))).alias("name"), t.strip_markers(F.col("exact")).alias("exact"), t.same_name(F.col("exact"), F.substring("c_name", 1, 8)).alias("same"), t.clean(F.lit(" 　")).alias("nothing"))


def store_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Runs up to 1996 stored, later days added, and the union compared with all of them by fingerprint."""
    cols = ["contest_id", "entity_id", "day", "odds", "won"]
    every, path = runs(s, d).select(*cols), work_dir(s)
    build = lambda after, until: every.filter((F.col("day") > F.lit(after or "0001-01-01").cast("date")) & (F.col("day") <= F.lit(until).cast("date")))
    m = store.write_store(build(None, "1996-12-31"), path, "day", ["contest_id", "entity_id"])
    both = store.with_delta(s, path, build, "day", "2999-12-31")
    whole = store.fingerprint(every)
    facts = (m["rows"], both.count(), store.fingerprint(both) == whole, store.fingerprint(every.repartition(5, "odds")) == whole, store.fingerprint(every.withColumn("won", 1 - F.col("won"))) == whole, store.read_store(s, path, columns=cols, verify=True).count() == m["rows"])
    return s.createDataFrame([facts], "stored long, n long, same boolean, same_in_any_order boolean, same_when_changed boolean, verified boolean")


def size_percentile(s: SparkSession, d: str) -> DataFrame:
    """Each contest's entropy as its place within the frozen quantiles of its field size."""
    m = market(s, d).filter("n > 1")
    e = m.groupBy("contest_id").agg(F.max("n").alias("n"), F.round(-F.sum(F.col("q") * F.ln("q")), 6).alias("x"))
    edges = e.groupBy("n").agg(F.percentile("x", F.array(*[F.lit(k / 5) for k in range(6)])).alias("edges"))
    return e.join(F.broadcast(edges), "n").select("contest_id", F.round(t.percentile_within(F.col("x"), F.col("edges")), 6).alias("place"))


def market_rank(s: SparkSession, d: str) -> DataFrame:
    """The second choice of the market in each contest, by share, ties by id."""
    w = Window.partitionBy("contest_id").orderBy(F.round("q", 9).desc(), "entity_id")
    return market(s, d).withColumn("k", F.row_number().over(w)).filter("k = 2").select("contest_id", "entity_id", "won")


def previous_contest(s: SparkSession, d: str) -> DataFrame:
    """What became of an entity's previous contest, found by its lagged id: its own finish and the winner's price there."""
    w = Window.partitionBy("entity_id").orderBy("day", "contest_id")
    r = runs(s, d).select("contest_id", "entity_id", F.lag("contest_id").over(w).alias("before"))
    own = runs(s, d).select(F.col("contest_id").alias("before"), "entity_id", F.col("finish_order").cast("long").alias("finish"))
    win = runs(s, d).filter("won = 1").groupBy(F.col("contest_id").alias("before")).agg(F.min("odds").alias("winner_odds"))
    return r.join(own, ["before", "entity_id"], "left").join(win, "before", "left").select("contest_id", "entity_id", "finish", "winner_odds")


def latest_metrics(s: SparkSession, d: str) -> DataFrame:
    """A metrics registry: one row for each model and year with its losses, the newest year of each model marked."""
    m = market(s, d).filter("n > 1").withColumn("y", F.year("day"))
    out = None
    for name, c in (("model", "p"), ("market", "q")):
        one = m.groupBy(F.lit(name).alias("name"), "y").agg(F.count("*").alias("n"), F.round(F.avg((F.col(c) - F.col("won")) * (F.col(c) - F.col("won"))), 6).alias("brier"))
        out = one if out is None else out.unionByName(one)
    return out.withColumn("latest", F.col("y") == F.max("y").over(Window.partitionBy("name")))


QUERIES = {f.__name__: f for f in (
    year_file, core_records, upsert_last_write, insert_if_absent, fill_null_only, rekey_facts, combination_quotes, place_ranges, price_grid, lap_profile, parse_fields, name_forms, store_roundtrip, size_percentile, market_rank, previous_contest, latest_metrics,
)}

_SECS = "CASE WHEN o_orderkey % 11 <> 0 THEN (600 + o_orderkey % 1000) / 10e0 END"
_PAIR = "SELECT a.contest_id, a.entity_id AS low, b.entity_id AS high, round(least(9999e0, 75e-2 / (a.q * b.q / (1 - a.q) + b.q * a.q / (1 - b.q))), 6) AS odds FROM market a JOIN market b ON a.contest_id = b.contest_id AND a.entity_id < b.entity_id"
SQL = {
    "year_file": f"""SELECT CASE o_custkey % 5 WHEN 0 THEN '05' WHEN 1 THEN '06' WHEN 2 THEN '09' WHEN 3 THEN '08' ELSE '07' END AS venue, count(*) AS n, round(sum({_SECS}), 1) AS seconds, cast(max(o_orderdate) AS date) AS last_day FROM orders WHERE o_orderkey % 97 <> 0 GROUP BY o_custkey % 5
UNION ALL SELECT 'error', count(*), NULL, NULL FROM orders WHERE o_orderkey % 97 = 0""",
    "core_records": " UNION ALL ".join(f"SELECT '{n}' AS name, count(*) AS n FROM (SELECT DISTINCT {c} FROM panel) x" for n, c in (("contests", "contest_id"), ("entities", "entity_id"), ("agents", "agent_id"), ("owners", "owner_id"), ("entries", "contest_id, entity_id"))) + " UNION ALL SELECT 'results', count(finish_order) FROM panel",
    "upsert_last_write": "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2 DESC, event_id DESC) AS k FROM events) x WHERE k = 1",
    "insert_if_absent": "SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 2, event_id) AS k FROM events WHERE event_id % 2 = 1 OR event_type = 'click') x WHERE k = 1",
    "fill_null_only": "SELECT contest_id, entity_id, CASE WHEN result_status = 'finished' THEN CASE WHEN entity_id % 3 <> 0 THEN odds WHEN entity_id % 5 <> 0 THEN round(odds + 1, 1) END WHEN entity_id % 5 <> 0 THEN round(odds + 1, 1) WHEN entity_id % 3 <> 0 THEN odds END AS odds FROM panel",
    "rekey_facts": """WITH f AS (SELECT user_id, event_type, count(*) AS n, CASE WHEN user_id % 3 = 0 THEN user_id - user_id % 4 ELSE user_id END AS target FROM events GROUP BY user_id, event_type),
r AS (SELECT *, target <> user_id AND (SELECT count(*) FROM f o WHERE o.target = f.target AND o.event_type = f.event_type) > 1 AS refused FROM f)
SELECT CASE WHEN refused THEN user_id ELSE target END AS user_id, event_type, n, 0 AS refused FROM r UNION ALL SELECT user_id, event_type, n, 1 FROM r WHERE refused""",
    "combination_quotes": f"SELECT contest_id, low, high, CASE WHEN (low + high) % 9 <> 0 THEN odds END AS odds FROM ({_PAIR}) x",
    "place_ranges": "SELECT contest_id, entity_id, CASE WHEN entity_id % 7 <> 0 THEN round(odds * 0.3, 1) END AS low, CASE WHEN entity_id % 7 <> 0 THEN round(odds * 0.5 + 1, 1) END AS high FROM runs",
    "price_grid": f"""WITH x AS ({_PAIR}), f AS (SELECT contest_id, min(entity_id) AS low, max(entity_id) AS high FROM runs WHERE finish_order <= 2 GROUP BY contest_id HAVING count(*) = 2 AND min(finish_order) = 1 AND max(finish_order) = 2)
SELECT f.contest_id, cast((SELECT count(*) FROM x WHERE x.contest_id = f.contest_id) AS int) AS n, odds AS price FROM f JOIN x ON x.contest_id = f.contest_id AND x.low = f.low AND x.high = f.high""",
    "lap_profile": """WITH r AS (SELECT l_orderkey, l_quantity AS q, row_number() OVER w AS k, lead(l_quantity) OVER w AS nx FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_partkey))
SELECT l_orderkey, cast(count(*) AS int) AS n, max(CASE WHEN k = 1 THEN q END) AS first, arg_max(q, k) AS last, max(q - nx) AS gain, CASE WHEN max(CASE WHEN k = 1 THEN q END) = 1 THEN 'front' WHEN max(CASE WHEN k = 1 THEN q END) <= 10 THEN 'stalker' WHEN max(CASE WHEN k = 1 THEN q END) <= 20 THEN 'midpack' ELSE 'closer' END AS style FROM r GROUP BY l_orderkey""",
    "parse_fields": f"""SELECT o_orderkey, round({_SECS}, 1) AS secs, cast(o_orderdate AS date) AS day, CASE WHEN o_orderkey % 7 <> 0 THEN cast(o_orderkey AS int) END AS number, CASE WHEN o_orderkey % 17 BETWEEN 1 AND 15 THEN cast(o_orderkey % 17 AS int) END AS meeting,
CASE WHEN o_orderkey % 13 = 0 THEN 'unknown' WHEN o_orderkey % 9000 < 500 THEN 'late' WHEN o_orderkey % 9000 <= 800 THEN 'final' WHEN o_orderkey % 9000 <= 4100 THEN 'hour' ELSE 'early' END AS horizon,
CASE WHEN o_orderkey % 7 = 0 OR o_orderkey % 3 = 0 THEN 'none' WHEN o_orderkey % 2 = 0 AND o_orderkey % 5 <> 0 THEN 'strong' ELSE 'weak' END AS strength, o_orderkey % 12 = 1 AS prospective,
printf('%04d05%02d%02d%02d', year(o_orderdate), o_orderkey % 5, o_orderkey % 12, o_orderkey % 9) AS contest FROM orders""",
    "name_forms": "SELECT c_custkey, c_name AS name, c_name AS exact, true AS same, cast(NULL AS varchar) AS nothing FROM customer",
    "store_roundtrip": "SELECT count(CASE WHEN day <= date '1996-12-31' THEN 1 END) AS stored, count(*) AS n, true AS same, true AS same_in_any_order, false AS same_when_changed, true AS verified FROM runs",
    "size_percentile": "WITH e AS (SELECT contest_id, max(n) AS n, round(-sum(q * ln(q)), 6) AS x FROM market WHERE n > 1 GROUP BY contest_id), g AS (SELECT n, " + ", ".join(f"percentile_cont({k / 5}) WITHIN GROUP (ORDER BY x) AS e{k}" for k in range(6)) + " FROM e GROUP BY n) SELECT contest_id, round(CASE WHEN x >= e5 THEN 1 " + " ".join(f"WHEN x >= e{k} THEN ({k} + (x - e{k}) / (e{k + 1} - e{k})) / 5e0" for k in range(4, -1, -1)) + " ELSE 0 END, 6) AS place FROM e JOIN g ON e.n = g.n",
    "market_rank": "SELECT contest_id, entity_id, won FROM market m WHERE (SELECT count(*) FROM market o WHERE o.contest_id = m.contest_id AND (round(o.q, 9) > round(m.q, 9) OR (round(o.q, 9) = round(m.q, 9) AND o.entity_id < m.entity_id))) = 1",
    "previous_contest": """WITH r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY day, contest_id) AS k FROM runs) SELECT a.contest_id, a.entity_id, cast(b.finish_order AS bigint) AS finish, w.odds AS winner_odds
FROM r a LEFT JOIN r b ON b.entity_id = a.entity_id AND b.k = a.k - 1 LEFT JOIN (SELECT contest_id, min(odds) AS odds FROM runs WHERE won = 1 GROUP BY contest_id) w ON w.contest_id = b.contest_id""",
    "latest_metrics": "WITH a AS (SELECT 'model' AS name, year(day) AS y, p AS s, won FROM market WHERE n > 1 UNION ALL SELECT 'market', year(day), q, won FROM market WHERE n > 1) SELECT name, y, cast(count(*) AS bigint) AS n, round(avg((s - won) * (s - won)), 6) AS brier, y = (SELECT max(year(day)) FROM market WHERE n > 1) AS latest FROM a GROUP BY name, y",
}
