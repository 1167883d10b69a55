"""The contest panel over the order tables, as named subqueries that Spark and DuckDB both read.

contest = order, day = order date, entity = part, agent = supplier; lines of one order and part are one entry."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from .places import work_dir

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Subqueries by name; each may use tables and the subqueries before it.
PARTS = {
    "entries": """SELECT l_orderkey AS contest_id, l_partkey AS entity_id, cast(o_orderdate AS date) AS day, min(l_suppkey) AS agent_id,
  min(o_custkey) AS owner_id, min(o_orderpriority) AS class, min(l_returnflag) AS flag, min(l_linenumber) AS line,
  round(sum(l_extendedprice), 2) AS price, sum(l_quantity) AS weight, round(1 + sum(l_quantity) / 5, 1) AS odds
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, l_partkey, cast(o_orderdate AS date)""",
    "status": """SELECT *, CASE WHEN flag = 'R' AND line = 7 THEN 'cancelled' ELSE 'started' END AS entry_status,
  CASE WHEN flag = 'R' AND line = 7 THEN NULL WHEN flag = 'A' AND line = 6 THEN 'stopped' ELSE 'finished' END AS result_status FROM entries""",
    "ranked": """SELECT *, CASE WHEN result_status = 'finished' THEN rank() OVER (PARTITION BY contest_id, result_status ORDER BY floor(price / 2000) DESC) END AS finish_order,
  rank() OVER (PARTITION BY contest_id ORDER BY odds) AS popularity FROM status""",
    "panel": """SELECT r.*, p_brand AS venue, p_type AS sire, p_size * 60 AS distance, p_name AS entity_name,
  CASE WHEN entry_status = 'started' THEN 1 ELSE 0 END AS started, CASE WHEN finish_order = 1 THEN 1 ELSE 0 END AS won,
  CASE WHEN finish_order <= 2 THEN 1 ELSE 0 END AS top2, CASE WHEN finish_order <= 3 THEN 1 ELSE 0 END AS top3
  FROM ranked r JOIN part ON entity_id = p_partkey""",
    "runs": "SELECT * FROM panel WHERE started = 1",
    # market shares of started entries, and probabilities sharper than the market
    "market": """SELECT *, (1 / odds) / sum(1 / odds) OVER (PARTITION BY contest_id) AS q, count(*) OVER (PARTITION BY contest_id) AS n,
  power(1 / odds, 1.2) / sum(power(1 / odds, 1.2)) OVER (PARTITION BY contest_id) AS p FROM runs""",
    # each entity's day, with what went before it
    "daily": """SELECT entity_id, day, count(*) AS starts, sum(won) AS wins, sum(top3) AS top3s, sum(finish_order) AS orders_sum, count(finish_order) AS orders_n
  FROM runs GROUP BY entity_id, day""",
    "before": """SELECT entity_id, day, coalesce(sum(starts) OVER w, 0) AS starts_before, coalesce(sum(wins) OVER w, 0) AS wins_before,
  coalesce(sum(top3s) OVER w, 0) AS top3_before, sum(orders_sum) OVER w AS orders_sum, sum(orders_n) OVER w AS orders_n FROM daily
  WINDOW w AS (PARTITION BY entity_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
}


def with_parts(body: str, tables: dict[str, str] | None = None) -> str:
    """``body`` behind the subqueries it needs, and behind those of ``tables`` (name to what it reads)."""
    need, text = [], body
    for name in reversed(PARTS):
        if not (tables and name in tables) and re.search(rf"\b{name}\b", text):
            need.insert(0, f"{name} AS ({PARTS[name]})")
            text += PARTS[name]
    if tables:
        need = [f"{t} AS (SELECT * FROM {src})" for t, src in tables.items() if re.search(rf"\b{t}\b", text)] + need
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ", ".join([*need, body[15:]])
    if body.upper().startswith("WITH "):
        return ("WITH " + ", ".join(need) + ", " + body[5:]) if need else body
    return ("WITH " + ", ".join(need) + "\n" + body) if need else body


def run(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """The query as a DataFrame, over the stored panel; Catalyst inlines the subqueries, so only needed columns are read."""
    tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
    names = [n for n in STORED if re.search(rf"\b{n}\b", _expanded(body, STORED))]
    return spark.sql(with_parts(body, tables | {n: stored(spark, sf_dir, n) for n in names}))


#: Parts that are written once for each session and input, by contest.
STORED = ("panel", "market")
_written: dict[tuple[str, str, str], str] = {}


def _expanded(body: str, stop: tuple[str, ...]) -> str:
    """``body`` and the parts it needs, down to those of ``stop``."""
    text = body
    for name in reversed(PARTS):
        if name not in stop and re.search(rf"\b{name}\b", text):
            text += PARTS[name]
    return text


def stored(spark: SparkSession, sf_dir: str, name: str) -> str:
    """Name of a table with a part of the panel, bucketed and sorted by contest: written at its first use in a session, so
    that windows and joins by contest need no exchange, and no query repeats the joins and ranks behind it."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    at = _written.get(key)
    if at is None or not spark.catalog.tableExists(at) or not _there(spark, at):
        at = f"furlong_{name}_{uuid.uuid4().hex}"
        tables = {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in TABLES}
        if name != "panel":
            tables["panel"] = stored(spark, sf_dir, "panel")
        df, n = spark.sql(with_parts(f"SELECT * FROM {name}", tables)), int(spark.conf.get("spark.sql.shuffle.partitions"))
        df.repartition(n, "contest_id").write.bucketBy(n, "contest_id").sortBy("contest_id").option("path", work_dir(spark)).saveAsTable(at)
        _written[key] = at
    return at


def _there(spark: SparkSession, name: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Location'").first()["data_type"])
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(stored(spark, sf_dir, "panel"))


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel(spark, sf_dir).filter("started = 1")


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(stored(spark, sf_dir, "market"))
