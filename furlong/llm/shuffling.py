"""Two-pass external shuffle with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .work import discard, materialize


#: Size that one task of the second pass is given at most, as the session's number of partitions may be too small.
TASK_SIZE = 64 << 20


def external_shuffle(
    rows: DataFrame, n_shards: int, *, seed: int = 17, size: str = "1", bucket_size: int = 8 << 20, path: str | None = None,
) -> DataFrame:
    """Put all rows in random order into shards whose counts differ by one at most: adds shard and slot (gapless from 0).

    Pass one scatters the rows uniformly into buckets of about ``bucket_size`` (the sum of the ``size`` expression) by a
    seeded hash of the row's place in the input, so that equal rows or keys scatter like any others. Pass two shuffles
    each bucket in memory (Fisher-Yates, ``shuffle(array, seed)``) and writes it. Buckets follow each other; shard k of n
    has the ranks from k * rows / n to (k + 1) * rows / n. Only bucket counts are gathered, never rows. The number of
    tasks grows with the size (TASK_SIZE each at most), and the same input files give the same order again, also
    after an executor is lost.

    Nulls, repeated rows and very long texts are rows like any others; an empty table gives an empty result; columns named
    shard or slot are replaced. With ``path`` the shards are written there, by shard."""
    spark = rows.sparkSession
    own = [F.col(f"`{c}`") for c in rows.columns if c not in ("shard", "slot")]
    total = rows.agg(F.sum(F.expr(size)).cast("long")).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_size))
    parts = min(n_buckets, max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // TASK_SIZE))
    numbered = rows.select(F.struct(*own).alias("__row"), F.monotonically_increasing_id().alias("__place"))
    scattered = numbered.withColumn("__bucket", F.pmod(F.xxhash64(F.lit(seed), F.col("__place")), F.lit(n_buckets))).repartition(parts, "__bucket")
    # rows reach a task in the order of the fetches: sorted, buckets and their rows meet the seeded shuffle in one order always
    ordered = scattered.sortWithinPartitions("__bucket", "__place")
    shuffled = ordered.groupBy("__bucket").agg(F.shuffle(F.collect_list("__row"), F.lit(seed)).alias("__rows"))
    staged = materialize(shuffled.select("__bucket", F.posexplode("__rows").alias("__pos", "__row")))

    counts = staged.groupBy("__bucket").agg(F.count("*").alias("n")).withColumn("group", F.floor(F.col("__bucket") / 1024))
    groups = counts.groupBy("group").agg(F.sum("n").alias("gn"))
    groups = groups.select("group", (F.sum("gn").over(Window.orderBy("group")) - F.col("gn")).alias("gbase"))
    inside = F.sum("n").over(Window.partitionBy("group").orderBy("__bucket")) - F.col("n")
    base = counts.withColumn("inside", inside).join(groups, "group").select("__bucket", (F.col("gbase") + F.col("inside")).alias("__base"))
    n_rows = counts.agg(F.sum("n")).first()[0] or 0
    rank = F.col("__base") + F.col("__pos")
    shard = F.floor((rank * n_shards + n_shards - 1) / F.lit(max(n_rows, 1)))
    # the shard s with floor(s * rows / n) <= rank < floor((s + 1) * rows / n), by exact integer steps from a guess
    low = lambda s: F.floor((s.cast("decimal(38,0)") * n_rows) / n_shards).cast("long")
    guess = F.least(shard.cast("long"), F.lit(n_shards - 1))
    fixed = F.when(low(guess) > rank, guess - 1).when((low(guess + 1) <= rank) & (guess + 1 < n_shards), guess + 1).otherwise(guess)
    out = staged.join(base, "__bucket").withColumn("__shard", fixed)
    out = out.select("__row.*", F.col("__shard").cast("int").alias("shard"), (rank - low(F.col("__shard"))).alias("slot"))
    if path:
        out.write.partitionBy("shard").parquet(path)
        discard(staged)
        return spark.read.parquet(path)
    return out


