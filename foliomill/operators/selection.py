"""Filtering with reasons, quotas, caps, sampling, allocation and packing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliomill.operators import ranking
from foliomill.plans.runtime import cut


def with_rejection(df: DataFrame, rules: list[tuple[Column, str]], name: str = "rejection") -> DataFrame:
    """The first failing rule of each row as ``name``; null for rows that pass."""
    out = F.lit(None).cast("string")
    for failed, reason in reversed(rules):
        out = F.when(failed, F.lit(reason)).otherwise(out)
    return df.withColumn(name, out)


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], n: int | str, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows of each group (``n`` may be a column); Spark prunes within partitions before it shuffles."""
    limit = F.col(n) if isinstance(n, str) else F.lit(n)
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= limit)


def priority_quota(df: DataFrame, key: str, groups: list[tuple[str, Column, int]], order: list[str]) -> DataFrame:
    """Greedy quotas in priority order: a row goes to the first group that matches it and still has room when the row comes.

    Keys must be distinct; ``order`` names columns.  In one pass each group keeps its first rows, as many as its own quota and those before it ask for,
    since these can take no more of its rows; partitions send only so many each.  The quotas, not the rows, bound what is left, and one task
    deals it out."""
    asked, rooms = 0, []
    for k, (_, matches, quota) in enumerate(groups):
        asked += quota
        rooms.append(F.when(matches, F.struct(F.lit(k).alias("group_no"), F.lit(asked).alias("room"))))
    first = df.withColumn("g", F.explode(F.array_compact(F.array(*rooms)))).select(*df.columns, "g.group_no", "g.room")
    first = top_per_group(first, ["group_no"], [F.col(c) for c in order], "room", "place").drop("room")
    names, quotas, columns = [n for n, _, _ in groups], [q for _, _, q in groups], df.columns

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: set = set()
        current, left = -1, 0
        for batch in batches:
            keys, at, who = batch.column(key).to_pylist(), batch.column("group_no").to_pylist(), []
            for i, (k, g) in enumerate(zip(keys, at)):
                if g != current:
                    current, left = g, quotas[g]
                if left and k not in taken:
                    taken.add(k)
                    left -= 1
                    who.append(i)
            kept = batch.take(pa.array(who, pa.int64()))
            out = [kept.column(c) for c in columns] + [pa.array([names[at[i]] for i in who], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=[*columns, "quota_group"])

    schema = T.StructType([*df.schema.fields, T.StructField("quota_group", T.StringType())])
    return first.coalesce(1).sortWithinPartitions("group_no", "place").mapInArrow(deal, schema)


def until_filled(df: DataFrame, accepted: Column, key: str, groups: list[tuple[str, Column, int]], order: list[str]) -> DataFrame:
    """The rows that a scan in ``order`` sees until every quota of ``priority_quota`` is full; all rows if one never is."""
    picked = priority_quota(df.filter(accepted), key, groups, order)
    # One row: the place where the scan stops, or null.
    full = F.lit(True)
    for name, _, quota in groups:
        full = full & (F.count_if(F.col("quota_group") == name) >= quota)
    stop = picked.agg(F.when(full, F.max(F.struct(*order))).alias("stop"))
    return df.join(F.broadcast(stop), F.col("stop").isNull() | (F.struct(*order) <= F.col("stop"))).drop("stop")


def hash_rank(seed: str, *keys: Column) -> Column:
    """A reproducible random order: the digest of seed and key."""
    return F.md5(F.concat_ws("|", F.lit(seed), *keys))


def _digest_rank(df: DataFrame, stratum: str, key: str, seed: str, most: int | None) -> DataFrame:
    return ranking.ranked(df.withColumn("digest", hash_rank(seed, F.col(key))), [stratum], [F.col("digest"), F.col(key)], "rank", most).drop("digest")


def split_by_counts(df: DataFrame, stratum: str, key: str, train: int, test: int, seed: str, most: int | None = None) -> DataFrame:
    """Random train and test rows of each stratum, fixed numbers; the rest is left out."""
    split = F.when(F.col("rank") <= train, "train").when(F.col("rank") <= train + test, "test")
    return _digest_rank(df, stratum, key, seed, most).withColumn("split", split).filter("split is not null")


def split_by_fraction(df: DataFrame, stratum: str, key: str, fraction: float, seed: str, most: int | None = None) -> DataFrame:
    """Test rows of each stratum: the rounded fraction, at least one and not all; a lone row stays in train."""
    n = F.col("size")
    test = F.when(n <= 1, 0).otherwise(F.least(n - 1, F.greatest(F.lit(1), F.round(n * fraction).cast("long"))))
    sizes = df.groupBy(stratum).agg(F.count("*").alias("size")).withColumnRenamed(stratum, "stratum_of")
    rows = _digest_rank(df, stratum, key, seed, most).join(sizes, F.col(stratum).eqNullSafe(F.col("stratum_of")))
    return rows.withColumn("split", F.when(F.col("rank") <= test, "test").otherwise("train")).drop("size", "stratum_of")


def allocate(sizes: DataFrame, key: str, size: str, total: int) -> DataFrame:
    """Largest-remainder shares of ``total`` in proportion to group sizes; ties go to the greater key.  A row for each group, so the two windows
    over all rows see as many rows as there are groups."""
    everything = Window.partitionBy(F.lit(0))
    exact = F.col(size) * F.least(F.lit(total), F.sum(size).over(everything)) / F.sum(size).over(everything)
    base = sizes.withColumn("exact", exact).withColumn("floor", F.floor("exact"))
    left = F.least(F.lit(total), F.sum(size).over(everything)) - F.sum("floor").over(everything)
    rank = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy((F.col("exact") - F.col("floor")).desc(), F.col(key).desc()))
    return base.withColumn("left", left).withColumn("rank", rank).withColumn("allocated", (F.col("floor") + (F.col("rank") <= F.col("left")).cast("int")).cast("long")).drop("exact", "floor", "left", "rank")


def next_fit(df: DataFrame, group: str, order: str, size: str, limit: int, most: int, hot: int | None = None) -> DataFrame:
    """Shards by next fit: a file opens a new shard if the current one is not empty and would pass the byte or file limit.

    The fold is sequential in each group; it runs over the sorted rows as they stream by, so it needs constant memory.  A group of more than
    ``hot`` rows (HOT_ROWS) is cut into ranges: a range is folded from every row at which its first shard may open, of which there are at most
    ``most``, and which soon fall together; from these tables the state at the beginning of each range follows, and then all ranges are
    folded at once."""
    kinds = dict(df.dtypes)
    rows = df.select(group, order, size).filter(f"{group} is not null and {size} is not null")
    schema = f"{group} {kinds[group]}, {order} {kinds[order]}, {size} {kinds[size]}, shard_no long"
    entries: dict[int, tuple] = {}

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, shard, used, n = entries.get(TaskContext.get().partitionId(), (None, 0, 0, 0))
        for pdf in batches:
            out = []
            for g, s in zip(pdf[group], pdf[size]):
                if g != current:
                    current, shard, used, n = g, 0, 0, 0
                if n > 0 and (used + s > limit or n >= most):
                    shard, used, n = shard + 1, 0, 0
                used, n = used + s, n + 1
                out.append(shard)
            yield pdf.assign(shard_no=out)

    hot = ranking.HOT_ROWS if hot is None else hot
    if rows.groupBy(group).count().filter(F.col("count") > hot).isEmpty():
        return rows.repartition(group).sortWithinPartitions(group, order).mapInPandas(fold, schema)

    def tables(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        head: list[int] = []
        at = shard = used = n = 0
        states: list[list] = []  # used, files, and for each row at which the first shard may open the shards opened after it
        for pdf in batches:
            for g, s in zip(pdf[group], pdf[size]):
                if first is None:
                    first = last = g
                if g != last:
                    last, shard, used, n = g, 0, 0, 0
                elif last == first:
                    opening = {at: 0} if at <= most else {}
                    if at <= most:
                        head.append(int(s))
                    stay = []
                    for state in states:
                        if state[0] + s > limit or state[1] >= most:
                            opening.update({k: c + 1 for k, c in state[2].items()})
                        else:
                            stay.append([state[0] + s, state[1] + 1, state[2]])
                    states = stay + ([[s, 1, opening]] if opening else [])
                    at += 1
                if n > 0 and (used + s > limit or n >= most):
                    shard, used, n = shard + 1, 0, 0
                used, n = used + s, n + 1
        if first is not None:
            single = first == last
            ends = [(k, int(u), c, opened) for u, c, ks in states for k, opened in ks.items()] if single else [(-1, int(used), n, shard)]
            # Groups travel as text; no more than an equality is asked of them.
            yield pd.DataFrame([(TaskContext.get().partitionId(), str(first), str(last), single, head if single else [], ends)], columns=["range_no", "first", "last", "single", "head", "ends"])

    n_ranges = max(2, df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = cut(rows.repartitionByRange(n_ranges, group, order).sortWithinPartitions(group, order))
    seen = ranged.mapInPandas(tables, "range_no int, first string, last string, single boolean, head array<long>, ends array<struct<k:int,used:long,n:long,opened:long>>")
    state: tuple = (None, 0, 0, 0)
    texts: dict[int, tuple] = {}
    for r in sorted(seen.collect(), key=lambda r: r["range_no"]):  # a row a range, of at most ``most`` entries
        name, shard, used, n = state if state[0] == r["first"] else (r["first"], 0, 0, 0)
        texts[r["range_no"]] = (name, shard, used, n)
        ends = {e["k"]: e for e in r["ends"]}
        if not r["single"]:
            state = (r["last"], ends[-1]["opened"], ends[-1]["used"], ends[-1]["n"])
            continue
        opens = None
        for k, s in enumerate(r["head"]):
            if n == 0 or used + s > limit or n >= most:
                opens = k
                break
            used, n = used + s, n + 1
        if opens is None:  # the whole range goes into the shard at hand
            state = (name, shard, used, n)
        else:
            e = ends[opens]
            state = (name, shard + (n > 0) + e["opened"], e["used"], e["n"])
    # The state's group is that of the range's first row; the fold compares it with the rows' own.
    firsts = {r["range_no"]: r[group] for r in ranged.withColumn("range_no", F.spark_partition_id()).groupBy("range_no").agg(F.min(group).alias(group)).collect()}
    entries.update({k: (firsts[k], *v[1:]) for k, v in texts.items()})
    return ranged.mapInPandas(fold, schema)


def cap_plan(df: DataFrame, group: str, pages: str, key: str, short: int, long: int, cap: int, most: int | None = None) -> DataFrame:
    """Which rows to delete and why: too short, too long, or beyond the group's cap (the longest first)."""
    df = with_rejection(df, [(F.col(pages) <= short, "short"), (F.col(pages) >= long, "long")], "reason").withColumn("alive", F.col("reason").isNull())
    over = df.groupBy(group).agg((F.sum(F.col("alive").cast("int")) - cap).alias("over")).withColumnRenamed(group, "group_of")
    rows = ranking.ranked(df, [group, "alive"], [F.col(pages).desc(), F.col(key).desc()], "rank", most).join(over, F.col(group).eqNullSafe(F.col("group_of")))
    rows = rows.withColumn("reason", F.when(F.col("alive") & (F.col("rank") <= F.col("over")), "cap").otherwise(F.col("reason")))
    return rows.withColumn("action", F.when(F.col("reason").isNull(), "keep").otherwise("delete")).drop("over", "rank", "alive", "group_of")
