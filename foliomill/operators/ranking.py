"""Row numbers within groups of any size: a group that is too large for one task is sorted by ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliomill.plans.runtime import cut

#: A group of more rows is not sorted in one task.
HOT_ROWS = 1_000_000


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank", most: int | None = None) -> DataFrame:
    """``df`` with each row's place (from 1) in its group by ``order``, which must tell any two rows of a group apart.

    Groups of at most ``most`` rows (HOT_ROWS) go through a window.  If any has more, all rows are sorted by ranges of group and order, so a group of
    any size is spread over tasks; a row's place is its place in its range plus the group's rows in the ranges before.  Null keys are a
    group like any other."""
    most = HOT_ROWS if most is None else most
    sizes = df.groupBy(*keys).count() if keys else df.agg(F.count("*").alias("count"))
    if sizes.filter(F.col("count") > most).isEmpty():
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(*order)).cast("long"))
    by = [*(F.col(k) for k in keys), *order]
    n = max(2, df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The ranges are fixed by the checkpoint; a row's number holds its range in the upper bits and its place there in the lower ones.
    at = F.col("at_row")
    rows = cut(df.repartitionByRange(n, *by).sortWithinPartitions(*by)).withColumn("at_row", F.monotonically_increasing_id())
    rows = rows.withColumn("range_no", F.shiftright(at, 33)).withColumn("at_row", at.bitwiseAND(F.lit((1 << 33) - 1)))
    # A row each group and range; a group has no more of them than there are ranges.
    parts = rows.groupBy(*keys, "range_no").agg(F.min("at_row").alias("begins"), F.count("*").alias("rows"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("carried", F.coalesce(F.sum("rows").over(before), F.lit(0)))
    parts = parts.select(*(F.col(k).alias(f"{k}_of") for k in keys), F.col("range_no").alias("range_of"), "begins", "carried")
    same = F.col("range_no") == F.col("range_of")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_of"))
    place = F.col("at_row") - F.col("begins") + F.col("carried") + 1
    return rows.join(parts, same).select(*df.columns, place.alias(name))


def beside(df: DataFrame, keys: list[str], place: str, value: str, step: int, name: str) -> DataFrame:
    """``df`` with the ``value`` of the row ``step`` places on in its group, by a join on group and place, so no group is in one task."""
    there = df.select(*(F.col(k).alias(f"{k}_there") for k in keys), (F.col(place) - step).alias("place_there"), F.col(value).alias(name))
    same = F.col(place) == F.col("place_there")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_there"))
    return df.join(there, same, "left").drop(*(f"{k}_there" for k in keys), "place_there")


def in_blocks(df: DataFrame, keys: list[str], order: list[Column], value: Column, size: int = 1000, most: int | None = None) -> DataFrame:
    """(keys, block, items): the values of each group in order, in lists of at most ``size``, so that a group of any size has lists of bounded length."""
    rows = ranked(df, keys, order, "place", most).withColumn("block", F.floor((F.col("place") - 1) / size))
    lists = rows.groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("place", value.alias("item")))).alias("x"))
    return lists.select(*keys, "block", F.col("x.item").alias("items"))
