"""All queries of the engine and their SQL oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_oracles: dict[str, str] = {}


def register(name: str, query: Query, sql: str | None = None) -> None:
    _queries[name] = query
    if sql:
        _oracles[name] = sql


def queries() -> dict[str, Query]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_oracles)


def _load() -> None:
    from .operators import asof
    from .plans import accuracy, bets, blocks, features, intake, markets, models, readouts, reports, scores
    from .sources import loads
    from .sources.panel import run, runs, with_parts
    from .streaming import quotes, windows

    for name, body in {**features.SQL, **markets.SQL, **reports.SQL}.items():
        spark_body = body.replace("datediff('day', ", "datediff(DAY, ").replace("varchar(9)", "string").replace(" // ", " div ").replace("json_extract_string(", "get_json_object(")
        register(name, lambda s, d, b=spark_body: run(s, d, b), with_parts(body))

    # DataFrame jobs; their oracles are the SQL of the same name above, or their own
    for module in (blocks, scores, bets, intake, readouts, models, accuracy):
        for name, query in module.QUERIES.items():
            register(name, query, with_parts(module.SQL[name]) if name in module.SQL else _oracles.get(name))

    for module in (loads, quotes, windows):
        for name, query in module.QUERIES.items():
            register(name, query, module.ORACLE_SQL[name])

    from pyspark.sql import functions as F

    def win_rate(s: SparkSession, d: str) -> DataFrame:
        r = runs(s, d).select("contest_id", "entity_id", "day", "won")
        b = asof.daily_before(r, ["entity_id"], "day", {"starts": F.lit(1), "wins": F.col("won")})
        out = r.join(b, ["entity_id", "day"])
        return out.select("contest_id", "entity_id", F.col("starts").cast("long").alias("starts_before"), F.round(F.try_divide("wins", "starts"), 6).alias("win_rate"))

    register("asof_win_rate", win_rate, with_parts("""SELECT contest_id, runs.entity_id, cast(starts_before AS bigint) AS starts_before, round(cast(wins_before AS double) / nullif(starts_before, 0), 6) AS win_rate
FROM runs JOIN before ON runs.entity_id = before.entity_id AND runs.day = before.day"""))

    def previous(s: SparkSession, d: str) -> DataFrame:
        r = runs(s, d).select("contest_id", "entity_id", "day", "finish_order")
        src = r.filter("finish_order is not null").select("entity_id", "day", "contest_id", F.col("finish_order").alias("prev_finish"), F.col("day").alias("prev_day"))
        out = asof.asof_strict(r, src, ["entity_id"], "day", ["prev_finish", "prev_day"], "contest_id")
        return out.select("contest_id", "entity_id", F.col("prev_finish").cast("long").alias("prev_finish"), F.datediff("day", "prev_day").cast("long").alias("days_since"))

    register("asof_previous_result", previous, with_parts("""WITH s AS (SELECT entity_id, day, max_by(finish_order, contest_id) AS f FROM runs WHERE finish_order IS NOT NULL GROUP BY entity_id, day)
SELECT contest_id, r.entity_id, cast(s.f AS bigint) AS prev_finish, cast(datediff('day', s.day, r.day) AS bigint) AS days_since
FROM runs r LEFT JOIN s ON s.entity_id = r.entity_id AND s.day = (SELECT max(day) FROM s t WHERE t.entity_id = r.entity_id AND t.day < r.day)"""))
    register("field_percent_rank", lambda s, d: asof.field_rank(runs(s, d), "contest_id", "weight", "pct").select("contest_id", "entity_id", F.round("pct", 6).alias("pct")),
             with_parts("SELECT contest_id, entity_id, round((rank() OVER (PARTITION BY contest_id ORDER BY weight) + (count(*) OVER (PARTITION BY contest_id, weight) - 1) / 2.0) / count(*) OVER (PARTITION BY contest_id), 6) AS pct FROM runs"))
    register("field_others_mean", lambda s, d: asof.loo_mean(runs(s, d), "contest_id", "finish_order", "m").select("contest_id", "entity_id", F.round("m", 6).alias("m")),
             with_parts("SELECT contest_id, entity_id, round(cast(sum(finish_order) OVER w - coalesce(finish_order, 0) AS double) / nullif(count(finish_order) OVER w - CASE WHEN finish_order IS NULL THEN 0 ELSE 1 END, 0), 6) AS m FROM runs WINDOW w AS (PARTITION BY contest_id)"))


_load()
