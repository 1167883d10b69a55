"""Event-time streams: windows, sessions and stream-stream joins under a watermark, drained into tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.places import work_dir


def windowed(stream: DataFrame, time: str, late: str, keys: list[str], sums: dict[str, Column], width: str, slide: str | None = None) -> DataFrame:
    """(start, end, keys, sums) by tumbling windows, or by sliding ones. Rows later than ``late`` behind the newest are dropped,
    and a window's state goes once the newest row has passed its end by ``late``."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, late).groupBy(w.alias("w"), *keys).agg(*[c.alias(n) for n, c in sums.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *sums)


def sessions(stream: DataFrame, time: str, late: str, keys: list[str], sums: dict[str, Column], gap: str) -> DataFrame:
    """(start, end, keys, sums) of runs of rows of a key that lie less than ``gap`` apart; a session ends ``gap`` after its last row."""
    out = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), *keys).agg(*[c.alias(n) for n, c in sums.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, *sums)


def followed(first: DataFrame, second: DataFrame, key: str, first_time: str, second_time: str, within: str, late: str) -> DataFrame:
    """Rows of ``first`` with each row of ``second`` of the same key (named ``key`` in both) that follows within ``within``, a row
    at the same time included. Both watermarks and the range bound what each side keeps: a row leaves once no row to
    come can meet it. Other columns must have names of their own."""
    a = first.withWatermark(first_time, late)
    b = second.withWatermark(second_time, late).withColumnRenamed(key, "__key")
    near = (F.col(second_time) >= F.col(first_time)) & (F.col(second_time) <= F.col(first_time) + F.expr(f"INTERVAL {within}"))
    return a.join(b, (F.col(key) == F.col("__key")) & near).drop("__key")


def drain(rows: DataFrame, path: str) -> DataFrame:
    """The table of all that an append-mode stream has finished, after all its source now holds. Called again, it goes on from
    where the stream stood; results are in the file sink's log once, whatever failed in between."""
    spark = rows.sparkSession
    query = rows.writeStream.format("parquet").outputMode("append").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{path}/rows")


def drain_updates(rows: DataFrame, keys: list[str], path: str) -> DataFrame:
    """The newest row of each of ``keys`` of an update-mode stream, after all that its source now holds. Each micro-batch writes its
    changed rows in a folder of its own number, so a repeated batch changes nothing; rows of later numbers win."""
    spark = rows.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("__batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{path}/rows/b{number}")

    query = rows.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    rest = [c for c in rows.columns if c not in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", __batch long"
    changes = spark.read.schema(schema).parquet(f"{path}/rows/*")
    return changes.groupBy(*keys).agg(F.max_by(F.struct(*rest), "__batch").alias("v")).select(*keys, "v.*").select(*rows.columns)


# --- queries over the event stream

LATE = "1 hour"


def events(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    from .quotes import events

    return events(spark, sf_dir).select(*columns).withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events and their value by day and type, kept up to date by an update-mode stream."""
    s = windowed(events(spark, sf_dir, "ts", "event_type", "value"), "ts", LATE, ["event_type"], {"n": F.count("*"), "total": F.sum("value")}, "1 day")
    return drain_updates(s, ["start", "end", "event_type"], work_dir(spark)).select(F.col("start").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


def sliding_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases in each 6 hours, hour by hour, of the windows that are closed."""
    s = windowed(events(spark, sf_dir, "ts", "event_type", "value").filter("event_type = 'purchase'"), "ts", LATE, [], {"n": F.count("*"), "most": F.max("value")}, "6 hours", "1 hour")
    return drain(s, work_dir(spark)).select(F.col("start").cast("string").alias("start"), "n", "most")


def session_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closed sessions of each user: events less than 2 hours apart."""
    s = sessions(events(spark, sf_dir, "ts", "user_id", "value").filter("user_id is not null"), "ts", LATE, ["user_id"], {"n": F.count("*"), "total": F.sum("value")}, "2 hours")
    return drain(s, work_dir(spark)).select("user_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", F.round("total", 4).alias("total"))


def click_purchase_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases of a user within 3 hours of a click."""
    e = events(spark, sf_dir, "ts", "user_id", "event_type", "event_id")
    clicks = e.filter("event_type = 'click'").select("user_id", F.col("ts").alias("click_ts"), F.col("event_id").alias("click_id"))
    bought = events(spark, sf_dir, "ts", "user_id", "event_type", "event_id").filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_ts"), F.col("event_id").alias("bought_id"))
    out = drain(followed(clicks, bought, "user_id", "click_ts", "bought_ts", "3 hours", LATE), work_dir(spark))
    return out.select("user_id", "click_id", "bought_id")


QUERIES = {f.__name__: f for f in (tumbling_stream, sliding_stream, session_stream, click_purchase_stream)}
_END = "(SELECT max(ts) - INTERVAL 1 HOUR FROM {t})"
ORACLE_SQL = {
    "tumbling_stream": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY date_trunc('day', ts), event_type",
    "sliding_stream": f"""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase' AND ts IS NOT NULL), w AS (SELECT date_trunc('hour', ts) - to_hours(k) AS s, value FROM p, (SELECT unnest(range(0, 6)) AS k) h)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, max(value) AS most FROM w WHERE s + INTERVAL 6 HOUR <= {_END.format(t='p')} GROUP BY s""",
    "session_stream": f"""WITH u AS (SELECT * FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL), g AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM u),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 2 HOUR) AS end_us, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 2 HOUR <= {_END.format(t='u')}""",
    "click_purchase_stream": """SELECT c.user_id, c.event_id AS click_id, p.event_id AS bought_id FROM events c JOIN events p ON c.user_id = p.user_id AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 3 HOUR
WHERE c.event_type = 'click' AND p.event_type = 'purchase'""",
}
