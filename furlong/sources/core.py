"""Keyed loads: year files, upserts, re-keying, payloads and grids."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..operators.asof import join_same


@contextmanager
def wide_charsets(spark: SparkSession) -> Iterator[None]:
    """While expressions are built: encodings beyond the standard ones. The session's setting stands again afterwards."""
    key = "spark.sql.legacy.javaCharsets"
    old = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, old)


def read_lines(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, line, text) with line numbers from 1 in each file, however it is split: lines are counted by block, and the
    blocks' totals give what lies before. Text in another encoding is decoded from its bytes."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")).withColumn("i", F.monotonically_increasing_id())
    raw = raw.withColumn("k", F.row_number().over(Window.partitionBy("file", "block").orderBy("i")))
    before = raw.groupBy("file", "block").agg(F.max("k").alias("n"))
    w = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = before.select("file", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("base"))
    out = raw.join(before, ["file", "block"]).select("file", (F.col("base") + F.col("k")).alias("line"), F.col("value").alias("text"))
    if encoding.upper() == "UTF-8":
        return out
    with wide_charsets(spark):
        return out.withColumn("text", F.decode(F.col("text").cast("binary"), encoding))


def read_year_file(spark: SparkSession, path: str, columns: list[str], encoding: str = "MS932") -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a delimited file without a header: rows of exactly these columns as strings with their file and
    line, and (file, line, reason, text) of the others."""
    lines = read_lines(spark, path, encoding).withColumn("parts", F.from_csv("text", F.lit(", ".join(f"c{i} string" for i in range(len(columns) + 1))), {"mode": "PERMISSIVE"}))
    width = len(columns)
    fields = F.size(F.split(F.regexp_replace("text", '"[^"]*"', ""), ","))
    rows = lines.filter(fields == width).select("file", "line", *[F.col(f"parts.c{i}").alias(c) for i, c in enumerate(columns)])
    return rows, lines.filter(fields != width).select("file", "line", F.format_string("%d columns, not %d", fields, F.lit(width)).alias("reason"), "text")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old and new rows by key, the last written one of each: new rows beat old ones, later ones (``order``) earlier ones."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("__new", order)).alias("v")).select(*keys, "v.*")


def insert_if_absent(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows as they are, and the first new row of each key that they lack. Null keys are equal to each other, so a repeated
    load inserts nothing."""
    first = join_same(new, old.select(*keys).distinct(), keys, "left_anti").groupBy(*keys).agg(F.min_by(F.struct(*[c for c in new.columns if c not in keys]), order).alias("v"))
    return old.unionByName(first.select(*keys, "v.*").select(*old.columns))


def fill_nulls(old: DataFrame, new: DataFrame, keys: list[str], columns: list[str], finished: Column) -> DataFrame:
    """Old rows with the columns of the new row of their key: replaced while the result is open, only filled where null once
    ``finished`` (a column over the old row). A null in the new row never replaces anything. Null keys are equal to each other."""
    n = new.select(*keys, *[F.col(c).alias(f"__{c}") for c in columns])
    j = join_same(old, n, keys)
    value = lambda c: F.when(finished, F.coalesce(F.col(c), F.col(f"__{c}"))).otherwise(F.coalesce(F.col(f"__{c}"), F.col(c)))
    return j.select(*[value(c).alias(c) if c in columns else F.col(c) for c in old.columns])


def rekey(facts: DataFrame, ids: DataFrame, key: str, unique: list[str]) -> tuple[DataFrame, DataFrame]:
    """(facts, refused): ``key`` replaced by its canonical id from ``ids`` (source_id, canonical_id, status). Only mapped ids
    move; rows whose new key is taken, by a row under it or by another that moves, stay and are told as refused."""
    m = ids.filter("status = 'mapped'").select(F.col("source_id").alias(key), "canonical_id")
    j = facts.join(m, key, "left").withColumn("__to", F.coalesce("canonical_id", key))
    rest = [c for c in unique if c != key]
    taken = F.count("*").over(Window.partitionBy("__to", *rest)) > 1
    j = j.withColumn("__refused", F.col("canonical_id").isNotNull() & (F.col("canonical_id") != F.col(key)) & taken)
    out = j.select(*[F.when(~F.col("__refused"), F.col("__to")).otherwise(F.col(key)).alias(key) if c == key else F.col(c) for c in facts.columns])
    return out, j.filter("__refused").select(*facts.columns, F.col("__to").alias("wanted"))


def parse_ranges(rows: DataFrame, payload: str) -> DataFrame:
    """(rows' columns, entity, low, high) of {"2": {"<n>": [low, high, rank]}}; an inverted or invalid range is null."""
    m = F.from_json(F.get_json_object(payload, "$.data.odds.2"), "map<string,array<string>>")
    e = rows.select(*rows.columns, F.explode(m).alias("entity", "__r"))
    low, high = F.col("__r")[0].try_cast("double"), F.col("__r")[1].try_cast("double")
    ok = (low > 0) & (high >= low)
    return e.select(*rows.columns, "entity", F.when(ok, low).alias("low"), F.when(ok, high).alias("high"))


def parse_combinations(rows: DataFrame, payload: str) -> DataFrame:
    """(rows' columns, selection, odds) of {"<n>-<m>": "<odds>"}: selections ascending, odds null where they are no number."""
    e = rows.select(*rows.columns, F.explode(F.from_json(payload, "map<string,string>")).alias("__k", "__v"))
    return e.select(*rows.columns, F.array_sort(F.split("__k", "-").cast("array<long>")).alias("selection"), F.col("__v").try_cast("double").alias("odds"))
