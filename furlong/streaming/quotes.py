"""Incremental tables over the event stream: one row a key, renewed by each micro-batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..sources.places import work_dir


def keyed_state(stream: DataFrame, keys: list[str], value: Column, order: Column, path: str, buckets: int = 32) -> DataFrame:
    """The table (keys, state, at) with the value of largest ``order`` for each key, after all that the stream now holds.

    Keys are dealt over ``buckets``. Each micro-batch is first cut to one row a key, merged with the stored rows of the buckets
    that it touches, and written as new files of those buckets; then a manifest tells which batch wrote each bucket's newest
    files. A repeated batch starts from the manifest before it and gives the same table; an event older than the stored one
    changes nothing; called again on the same path without new data, the stored table comes back. Files that neither
    the newest manifest nor the one before names are deleted."""
    spark = stream.sparkSession
    rows = stream.select(*keys, value.alias("state"), order.alias("at"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    latest = [F.max_by("state", "at").alias("state"), F.max("at").alias("at")]
    at = lambda n, b: f"{path}/v{n}/bucket={b}"

    def merge(batch: DataFrame, number: int) -> None:
        base, before = manifest(spark, path, number)
        batch.groupBy(*keys).agg(*latest).withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).write.mode("overwrite").parquet(f"{path}/batch")
        new = spark.read.schema(schema + ", bucket int").parquet(f"{path}/batch")
        touched = [r["bucket"] for r in new.select("bucket").distinct().collect()]
        for b in touched:
            if b in before:
                new = new.unionByName(spark.read.schema(schema).parquet(at(before[b], b)).withColumn("bucket", F.lit(b)))
        if touched:
            new.groupBy(*keys, "bucket").agg(*latest).repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/v{number}")
        now = before | dict.fromkeys(touched, number)
        spark.createDataFrame([(b, n) for b, n in now.items()], "bucket int, number long").coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/n{number}")
        for b, n in manifest(spark, path, base)[1].items():
            if before[b] != n:
                discard(spark, at(n, b))

    query = rows.writeStream.foreachBatch(merge).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    _, newest = manifest(spark, path, None)
    if not newest:
        return spark.createDataFrame([], rows.schema)
    return spark.read.schema(schema).parquet(*[at(n, b) for b, n in newest.items()])


def manifest(spark: SparkSession, path: str, before: int | None) -> tuple[int, dict[int, int]]:
    """(its number, batch of each bucket's newest files) of the newest finished manifest, or of the newest below ``before``."""
    root = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    numbers = [int(p.getName()[1:]) for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    newest = max((n for n in numbers if before is None or n < before), default=-1)
    if newest < 0:
        return -1, {}
    return newest, {r["bucket"]: r["number"] for r in spark.read.schema("bucket int, number long").parquet(f"{path}/manifest/n{newest}").collect()}


def discard(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)


def latest_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last value of each (user, type) by source time, then id; late events are refused."""
    out = keyed_state(events(spark, sf_dir), ["user_id", "event_type"], F.col("value"), F.struct("ts", "event_id"), work_dir(spark))
    return out.select("user_id", "event_type", F.col("state").alias("value"), F.col("at.event_id").alias("event_id"))


def first_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user, frozen: later ones change nothing."""
    order = F.struct((-F.unix_micros(F.col("ts").cast("timestamp"))).alias("t"), (-F.col("event_id")).alias("i"))
    out = keyed_state(events(spark, sf_dir), ["user_id"], F.col("event_type"), order, work_dir(spark))
    return out.select("user_id", F.col("state").alias("event_type"), (-F.col("at.i")).alias("event_id"))


def recent_success(rows: DataFrame, key: str, time: str, success: Column, freshness_us: int) -> DataFrame:
    """``rows`` that are no success, with skipped: a success of the same key lies before them by ``freshness_us`` at most. Rows without a key or a time are never skipped.

    Keys are split by time, so a hot key is not one task: a success goes to its own span of ``freshness_us`` and the next."""
    t = F.unix_micros(F.col(time).cast("timestamp"))
    done = F.coalesce(success, F.lit(False))
    rows = rows.withColumns({"_at": t, "_done": done, "_span": F.floor(t / freshness_us)})
    rows = rows.withColumn("_span", F.explode(F.when(F.col("_done"), F.array("_span", F.col("_span") + 1)).otherwise(F.array("_span"))))
    before = Window.partitionBy(key, "_span").orderBy("_at").rangeBetween(-freshness_us, -1)
    skipped = F.coalesce(F.max("_done").over(before), F.lit(False)) & F.col(key).isNotNull() & F.col("_at").isNotNull()
    return rows.withColumn("skipped", skipped).filter("not _done").drop("_at", "_done", "_span")


def fresh_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event but a purchase, skipped if its user has bought in the six hours before."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "ts", "event_type")
    return recent_success(rows, "user_id", "ts", F.col("event_type") == "purchase", 6 * 3600 * 10**6).select("event_id", "user_id", "skipped")


QUERIES = {"latest_quotes_stream": latest_quotes, "first_snapshot_stream": first_snapshots, "recent_success_dedup": fresh_requests}
ORACLE_SQL = {
    "recent_success_dedup": """SELECT event_id, user_id, EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'purchase' AND s.ts < e.ts AND s.ts >= e.ts - INTERVAL 6 HOUR) AS skipped
FROM events e WHERE event_type IS DISTINCT FROM 'purchase'""",
    "latest_quotes_stream": "SELECT user_id, event_type, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) x WHERE k = 1",
    "first_snapshot_stream": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) x WHERE k = 1",
}
