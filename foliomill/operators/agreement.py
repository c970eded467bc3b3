"""Agreement of two annotators on binary criteria."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def kappa(df: DataFrame, criterion: str, first: str, second: str) -> DataFrame:
    """Cohen's kappa of two boolean columns for each criterion, over rows with both; null where chance agreement is complete."""
    a, b = F.col(first).cast("int"), F.col(second).cast("int")
    r = df.filter(f"{first} is not null and {second} is not null").groupBy(criterion).agg(F.count("*").alias("n"), F.avg((a == b).cast("int")).alias("po"), F.avg(a).alias("p"), F.avg(b).alias("q"))
    pe = F.col("p") * F.col("q") + (1 - F.col("p")) * (1 - F.col("q"))
    return r.select(criterion, "n", F.round(100 * F.col("po"), 1).alias("agreement"), F.round(100 * F.col("p"), 1).alias("first_share"), F.round(100 * F.col("q"), 1).alias("second_share"), F.when(F.round(pe, 12) == 1, None).otherwise(F.round((F.col("po") - pe) / (1 - pe), 3)).alias("kappa"))


def marks_long(wide: DataFrame, item: str, criteria: list[str]) -> DataFrame:
    """One row for each item, row and criterion; a mark is an x in any case."""
    entries = F.array(*(F.struct(F.lit(c).alias("criterion"), (F.lower(F.trim(F.coalesce(F.col(f"`{c}`"), F.lit("")))) == "x").alias("marked")) for c in criteria))
    return wide.select(F.regexp_replace(F.trim(item), "/+$", "").alias(item), "pos", F.explode(entries).alias("m")).select(item, "pos", "m.criterion", "m.marked")


def paired(long: DataFrame, item: str) -> DataFrame:
    """Both annotators' marks side by side, in file order, for items with exactly two rows."""
    g = long.groupBy(item, "criterion").agg(F.array_sort(F.collect_list(F.struct("pos", "marked"))).alias("rows"))
    return g.filter(F.size("rows") == 2).select(item, "criterion", F.col("rows")[0]["marked"].alias("first"), F.col("rows")[1]["marked"].alias("second"))
