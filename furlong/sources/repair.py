"""Repair of split identities: facts of a source id move to its canonical id, pair by pair, or the pair stays and has a reason."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

#: Why a pair is left as it is; the first that holds counts.
REASONS = ("ambiguous", "chained", "no_canonical", "collision", "attribute_loss")


def judge(ids: DataFrame, dimension: DataFrame, key: str, attributes: list[str], facts: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(source_id, canonical_id, reason, lost, rows) for each mapped pair of ``ids`` (source_id, canonical_id, status); a null reason means that
    the pair may move.

    ambiguous: the source has several canonical ids; chained: its canonical id is itself a source; no_canonical: ``dimension`` lacks it;
    collision: in a table of ``facts`` (by name, with the columns that are unique beside the key) a row under the new key would meet another; attribute_loss:
    the canonical row lacks attributes that the source has, named in ``lost``. Null keys move nowhere; null values of other unique columns
    count as equal. ``rows`` counts the facts of the source over all tables."""
    pairs = ids.filter("status = 'mapped' and source_id is not null and canonical_id is not null and source_id <> canonical_id").select("source_id", "canonical_id").distinct()
    pairs = pairs.withColumn("__many", F.count("*").over(Window.partitionBy("source_id")) > 1)
    sources = pairs.select(F.col("source_id").alias("canonical_id")).distinct().withColumn("__chain", F.lit(True))
    at = lambda name, on: dimension.groupBy(F.col(key).alias(on)).agg(F.lit(True).alias(f"__{name}"), *[F.min(a).alias(f"__{name}_{a}") for a in attributes])
    out = pairs.join(sources, "canonical_id", "left").join(at("c", "canonical_id"), "canonical_id", "left").join(at("s", "source_id"), "source_id", "left")
    hits = None
    to = pairs.filter("not __many").select(F.col("source_id").alias(key), "canonical_id")
    for df, unique in facts.values():
        rest = [c for c in unique if c != key]
        j = df.select(key, *rest).join(to, key, "left").withColumn("__to", F.coalesce("canonical_id", key))
        j = j.withColumn("__met", F.count("*").over(Window.partitionBy("__to", *rest)) > 1).filter("canonical_id is not null")
        one = j.groupBy(F.col(key).alias("source_id")).agg(F.count("*").alias("n"), F.max("__met").alias("met"))
        hits = one if hits is None else hits.unionByName(one)
    if hits is not None:
        out = out.join(hits.groupBy("source_id").agg(F.sum("n").alias("__n"), F.max("met").alias("__met")), "source_id", "left")
    else:
        out = out.withColumns({"__n": F.lit(0).cast("long"), "__met": F.lit(False)})
    lost = F.array_compact(F.array(*[F.when(F.col(f"__c_{a}").isNull() & F.col(f"__s_{a}").isNotNull(), a) for a in attributes])) if attributes else F.array().cast("array<string>")
    reason = (
        F.when(F.col("__many"), REASONS[0]).when(F.coalesce("__chain", F.lit(False)), REASONS[1]).when(F.col("__c").isNull(), REASONS[2])
        .when(F.coalesce("__met", F.lit(False)), REASONS[3]).when(F.size(lost) > 0, REASONS[4])
    )
    return out.select("source_id", "canonical_id", reason.alias("reason"), F.array_join(lost, ",").alias("lost"), F.coalesce("__n", F.lit(0)).alias("rows"))


def move(judged: DataFrame, df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with the ids of each of ``columns`` replaced where their pair may move."""
    for c in columns:
        good = judged.filter("reason is null").select(F.col("source_id").alias(c), F.col("canonical_id").alias("__to"))
        df = df.join(good, c, "left").withColumn(c, F.coalesce("__to", c)).select(*df.columns)
    return df


def without_orphans(judged: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """``dimension`` without the sources that have moved; rows with a null key stay."""
    return dimension.join(judged.filter("reason is null").select(F.col("source_id").alias(key)), key, "left_anti")
