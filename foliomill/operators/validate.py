"""Predicates on paths, sizes and digests, and frames of violations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unsafe_path(c: Column, suffix: str | None = None) -> Column:
    """Null, absolute, with a backslash, or with an empty, dot or dot-dot part; or of another suffix."""
    bad = c.isNull() | F.contains(c, F.lit("\\")) | F.exists(F.split(c, "/"), lambda p: p.isin("", ".", ".."))
    bad = F.coalesce(bad, F.lit(True))
    return bad | ~F.endswith(F.lower(c), F.lit(suffix)) if suffix else bad


def bad_digest(c: Column) -> Column:
    return ~F.coalesce(F.regexp_like(c, F.lit("^[0-9a-f]{64}$")), F.lit(False))


def bad_size(c: Column) -> Column:
    """Null, NaN, negative or not whole."""
    d = c.cast("double")
    return F.coalesce(F.isnan(d) | (d < 0) | (d != F.floor(d)), F.lit(True))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule) of every rule a row breaks."""
    broken = F.array(*(F.when(F.coalesce(bad, F.lit(True)), F.lit(name)) for name, bad in rules.items()))
    return df.select(key, F.explode(F.filter(broken, lambda r: r.isNotNull())).alias("rule"))


def all_inside(expected: Column, actual: Column) -> Column:
    """Whether every expected member is there."""
    return F.size(F.array_except(F.coalesce(expected, F.array()), F.coalesce(actual, F.array()))) == 0


def targets_met(selected: DataFrame, group: str, targets: dict[str, int]) -> DataFrame:
    """Each target's count and whether it is reached; groups without rows count zero."""
    wanted = selected.sparkSession.createDataFrame(list(targets.items()), f"{group} string, target int")
    return F.broadcast(wanted).join(selected.groupBy(group).agg(F.count("*").alias("n")), group, "left").select(group, F.coalesce("n", F.lit(0)).alias("n"), "target", (F.coalesce("n", F.lit(0)) >= F.col("target")).alias("met"))


def check_window(start: int, end: int | None) -> None:
    if start < 0 or end is not None and end < start:
        raise ValueError(f"no window: {start}..{end}")
