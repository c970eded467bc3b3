"""Keyed joins, latest and first views, resume logs, reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each key's last row by ``order``: one partial aggregation, no sort."""
    return df.groupBy(*keys).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("row")).select(*keys, "row.*")


def earliest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each key's first row by ``order``."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("row")).select(*keys, "row.*")


def not_done(work: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose key is not in the log, for resuming."""
    return work.join(log.select(*keys).distinct(), keys, "left_anti")


def any_key(df: DataFrame, keys: list[Column], other: DataFrame, other_keys: list[Column], row_id: str) -> DataFrame:
    """Rows of ``df`` of which any key equals any key of ``other``: keys are exploded and equi-joined, never joined by OR."""
    mine = df.withColumn("key", F.explode(F.array_distinct(F.array(*keys)))).filter("key is not null")
    theirs = other.select(F.explode(F.array(*other_keys)).alias("key")).filter("key is not null").distinct()
    return df.join(mine.join(theirs, "key", "left_semi").select(row_id).distinct(), row_id, "left_semi")


def first_hit(df: DataFrame, key_chain: list[Column], other: DataFrame, other_key: str, value: str, row_id: str) -> DataFrame:
    """The value found by the first of several candidate keys, in one join: keys are exploded with their rank."""
    tries = df.select(row_id, F.posexplode(F.array(*key_chain)).alias("try", other_key)).filter(F.col(other_key).isNotNull())
    hit = tries.join(other.select(other_key, value), other_key).groupBy(row_id).agg(F.min_by(F.struct(F.col(value).alias("v"), "try"), "try").alias("hit"))
    return df.join(hit, row_id, "left").withColumn(value, F.col("hit.v")).withColumn("key_rank", F.col("hit.try")).drop("hit")


def reconcile(expected: DataFrame, actual: DataFrame, key: str, checks: list[str]) -> DataFrame:
    """Status of every key of either side: missing, extra, mismatch of a checked column, or ok."""
    a = expected.select(key, *(F.col(c).alias(f"want_{c}") for c in checks), F.lit(True).alias("wanted"))
    b = actual.select(key, *(F.col(c).alias(f"have_{c}") for c in checks), F.lit(True).alias("had"))
    status = F.when(F.col("had").isNull(), "missing").when(F.col("wanted").isNull(), "extra")
    for c in checks:
        status = status.when(~F.col(f"want_{c}").eqNullSafe(F.col(f"have_{c}")), f"{c}_mismatch")
    return a.join(b, key, "full_outer").select(key, status.otherwise("ok").alias("status"))


def repeated(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")
