"""Text loads: delimited files with bad rows kept apart, and price payloads in JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .panel import panel, with_parts
from .places import work_dir


def read_delimited(spark: SparkSession, path: str, schema: str, encoding: str = "UTF-8") -> DataFrame:
    """Rows of the schema, with the raw line in ``bad_row`` where it does not fit."""
    reader = spark.read.schema(f"{schema}, bad_row string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "bad_row")
    return reader.option("encoding", encoding).csv(path)


def parse_payload(rows: DataFrame, payload: str, key: str, value: str) -> DataFrame:
    """One row for each entry of a JSON object of prices; what is no number becomes null."""
    entries = rows.withColumn("__m", F.from_json(payload, "map<string,string>"))
    return entries.select(*rows.columns, F.explode("__m").alias(key, "__v")).withColumn(value, F.col("__v").try_cast("double")).drop("__v")


def delimited_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as text, with '----' as price of pending ones, read back with those rows kept as errors."""
    path = work_dir(spark)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    price = F.when(F.col("o_orderstatus") == "P", "----").otherwise(F.col("o_totalprice").cast("string"))
    orders.select("o_orderkey", F.year("o_orderdate").alias("y"), price.alias("price")).write.csv(path)
    back = read_delimited(spark, path, "o_orderkey long, y int, price double")
    return back.groupBy("y").agg(F.count("*").alias("n"), F.count("bad_row").alias("errors"), F.round(F.sum("price"), 1).alias("total"))


def payload_odds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of each contest as one JSON object, parsed back into rows; cancelled entries have none."""
    odds = F.when(F.col("started") == 1, F.col("odds").cast("string")).otherwise("---")
    field = F.map_from_entries(F.collect_list(F.struct(F.col("entity_id").cast("string"), odds)))
    payload = panel(spark, sf_dir).groupBy("contest_id").agg(F.to_json(field).alias("payload"))
    rows = parse_payload(payload, "payload", "entity", "odds")
    return rows.select("contest_id", F.col("entity").cast("long").alias("entity_id"), "odds")


QUERIES = {"delimited_audit": delimited_audit, "payload_odds": payload_odds}
ORACLE_SQL = {
    "delimited_audit": "SELECT year(o_orderdate) AS y, count(*) AS n, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS errors, round(sum(CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END), 1) AS total FROM orders GROUP BY year(o_orderdate)",
    "payload_odds": with_parts("SELECT contest_id, entity_id, CASE WHEN started = 1 THEN odds END AS odds FROM panel"),
}
