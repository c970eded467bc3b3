"""Ordered rows: deltas, running counts, trailing runs, date windows, bisection, telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def deltas(df: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """Change of value and seconds since the key's previous sample; the first sample of a key has none."""
    w = Window.partitionBy(key).orderBy(time)
    before, then = F.lag(value).over(w), F.lag(time).over(w)
    return df.withColumn("delta", F.col(value) - before).withColumn("seconds", F.unix_micros(F.col(time).cast("timestamp")) / 1e6 - F.unix_micros(then.cast("timestamp")) / 1e6).filter(F.col("delta").isNotNull())


def trailing_run(df: DataFrame, key: str, time: str, value: str, wanted: str) -> DataFrame:
    """Length of each key's last unbroken run of one value: rows after its last other value.  Two aggregations, no sort."""
    last = df.groupBy(key).agg(F.max(F.when(~F.col(value).eqNullSafe(F.lit(wanted)), F.col(time))).alias("last_other"))
    return df.join(last, key).groupBy(key).agg(F.count_if(F.col("last_other").isNull() | (F.col(time) > F.col("last_other"))).alias("run"))


def backward_windows(spark: SparkSession, earliest: str, until: str, days: int) -> DataFrame:
    """Date windows of so many days from the end back to the start, numbered in that order."""
    n = f"cast(ceil((datediff(date'{until}', date'{earliest}') + 1) / {days}D) as int)"
    return spark.sql(f"SELECT id AS window_no, date_add(date'{until}', cast(-id * {days} as int)) AS window_end, greatest(date'{earliest}', date_add(date'{until}', cast(-id * {days} - {days} + 1 as int))) AS window_start FROM range({n})")


def bisect_ranges(daily: DataFrame, day: str, n: str, limit: int) -> DataFrame:
    """Date ranges of at most ``limit`` rows (or one day), by halving the whole range again and again.

    The halving tree is walked as an array of ranges inside one row of daily counts; days bound its size."""
    spark = daily.sparkSession
    daily.createOrReplaceTempView("foliomill_daily")
    return spark.sql(f"""
        WITH RECURSIVE days AS (SELECT {day} AS d, sum({n}) AS n FROM foliomill_daily WHERE {day} IS NOT NULL GROUP BY {day}),
        ends AS (SELECT min(d) AS a, max(d) AS b FROM days),
        cumulated AS (SELECT map_from_entries(collect_list(struct(d, upto))) AS m FROM (SELECT d, sum(n) OVER (ORDER BY d) AS upto FROM (SELECT c.d, coalesce(days.n, 0) AS n FROM (SELECT explode(sequence(date_add(a, -1), b)) AS d FROM ends) c LEFT JOIN days ON days.d = c.d))),
        ranges(a, b, n, m) AS (
            SELECT a, b, m[b] - m[date_add(a, -1)], m FROM ends, cumulated
            UNION ALL
            SELECT if(side = 0, a, date_add(a, cast(floor(datediff(b, a) / 2) as int) + 1)), if(side = 0, date_add(a, cast(floor(datediff(b, a) / 2) as int)), b),
                   m[if(side = 0, date_add(a, cast(floor(datediff(b, a) / 2) as int)), b)] - m[date_add(if(side = 0, a, date_add(a, cast(floor(datediff(b, a) / 2) as int) + 1)), -1)], m
            FROM ranges LATERAL VIEW explode(array(0, 1)) s AS side WHERE n > {limit} AND a < b)
        SELECT a AS range_start, b AS range_end, n FROM ranges WHERE n > 0 AND (n <= {limit} OR a = b)""")


def sample_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, median, nearest-rank 95th percentile, greatest value and share of values over 80."""
    v = F.col(value).cast("double")
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.avg(v), 4).alias("mean"), F.expr(f"percentile_cont(0.5) within group (order by {value})").alias("median"), F.expr(f"percentile_disc(0.95) within group (order by {value})").alias("p95"), F.max(value).alias("most"), F.round(F.avg(F.when(v > 80, 100.0).otherwise(0.0)), 4).alias("over_80"))
