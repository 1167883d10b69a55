"""Sequential pairwise rating: a whole day is scored against the ratings before it, then they move."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.places import work_dir

START, K, SCALE = 1500.0, 24.0, 400.0


def rated_day(entries: DataFrame, ratings: DataFrame, contest: str, entity: str, order: str) -> tuple[DataFrame, DataFrame]:
    """(entries with their rating before the day, ratings after it). ``ratings`` has (entity, rating, best, starts). Each
    pair of finishers of a contest is one game (1, 0.5 or 0 by finishing order); an entity moves by K times the mean, over
    its pairs of the contest, of result less expectation, and by the sum of that over its contests of the day."""
    e = entries.select(contest, entity, order).join(ratings, entity, "left")
    e = e.withColumns({"rating": F.coalesce("rating", F.lit(START)), "best": F.coalesce("best", F.lit(START)), "starts": F.coalesce("starts", F.lit(0))})
    f = e.filter(F.col(order).isNotNull()).select(F.col(contest).alias("c"), F.col(entity).alias("e"), F.col(order).alias("o"), F.col("rating").alias("r"))
    games = f.alias("a").join(f.alias("b"), (F.col("a.c") == F.col("b.c")) & (F.col("a.e") != F.col("b.e")))
    got = F.when(F.col("a.o") < F.col("b.o"), 1.0).when(F.col("a.o") == F.col("b.o"), 0.5).otherwise(0.0)
    expected = 1 / (1 + F.pow(F.lit(10.0), (F.col("b.r") - F.col("a.r")) / SCALE))
    moves = games.groupBy("a.c", F.col("a.e").alias("e")).agg((K * F.avg(got - expected)).alias("m")).groupBy("e").agg(F.sum("m").alias("m"))
    day = e.groupBy(F.col(entity).alias("e")).agg(F.max("rating").alias("rating"), F.max("best").alias("best"), (F.max("starts") + F.count("*")).alias("starts"))
    day = day.join(moves, "e", "left").withColumn("rating", F.col("rating") + F.coalesce("m", F.lit(0.0)))
    new = day.select(F.col("e").alias(entity), "rating", F.greatest("best", "rating").alias("best"), "starts")
    after = ratings.join(new.select(entity), entity, "left_anti").unionByName(new.select(*ratings.columns))
    return e.select(contest, entity, F.col("rating").alias("rating_before"), F.col("best").alias("best_before"), F.col("starts").alias("starts_before")), after


def rate(runs: DataFrame, contest: str, entity: str, day: str, order: str) -> DataFrame:
    """Ratings of all runs as they stood before their day. Every day depends on the one before, so this is one step a day,
    each a few joins over that day's entries and the table of ratings, which is written anew and read by the next: the
    number of steps is that of the days, whatever the number of entries."""
    spark: SparkSession = runs.sparkSession
    path = work_dir(spark)
    runs.select(contest, entity, F.col(day).alias("__day"), order).write.partitionBy("__day").parquet(f"{path}/runs")
    days = [r["__day"] for r in spark.read.parquet(f"{path}/runs").select("__day").distinct().orderBy("__day").collect()]
    ratings = spark.createDataFrame([], f"{entity} {runs.schema[entity].dataType.simpleString()}, rating double, best double, starts long")
    for k, d in enumerate(days):
        told, after = rated_day(spark.read.parquet(f"{path}/runs").filter(F.col("__day") == F.lit(d)), ratings, contest, entity, order)
        told.write.mode("append").parquet(f"{path}/told")
        after.write.parquet(f"{path}/ratings/{k}")
        ratings = spark.read.parquet(f"{path}/ratings/{k}")
    return spark.read.parquet(f"{path}/told")
