"""Problem 7: mixing sources to target weights.

Weights of the sources are a temperature family: target weight times (token share / target weight) to an exponent, normalised, where token
shares count every record as often as it may be repeated.  The exponent 0 is the target mix, 1 uses up all that the sources can give.  Unless a budget is given, it is the greatest total at which the target mix keeps every
repetition limit, so the exponent stays 0; for a larger budget the least exponent that keeps the limits is bisected.  A source's share of the budget
is realised as whole blocks (each a permutation of all its records) and a last block cut where the budget ends; no source is ever
sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.llm import tokenizer
from foliomill.plans.runtime import at_least, cut, table

SEED = 77
#: Histogram bins of the hash that orders a block.
BINS = 1024
#: A budget as large as all records of the sources that have a target.
ALL = "all"


@dataclass
class Source:
    name: str
    tokens: int
    weight: float
    repeats: int


def token_counts(documents: DataFrame, vocabulary: str = tokenizer.BYTE_BPE_50K) -> DataFrame:
    """(doc_id, source, tokens): sizes in tokens of a public tokenizer; a null or empty text has none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = tokenizer.encoder(vocabulary)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "source": pdf["source"], "tokens": [len(encode(x)) if x else 0 for x in pdf["text"]]})

    # Ids travel as text: a null among long integers would turn a batch's ids into floats.
    rows = at_least(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text"))
    return rows.mapInPandas(run, "doc_id string, source string, tokens long").withColumn("doc_id", F.col("doc_id").cast("long"))


def tempered(sources: list[Source], exponent: float) -> list[float]:
    total = sum(s.tokens * s.repeats for s in sources)
    raw = [s.weight * (s.tokens * s.repeats / total / s.weight) ** exponent for s in sources]
    return [x / sum(raw) for x in raw]


def entropy(weights: list[float]) -> float:
    return -sum(w * math.log(w) for w in weights if w > 0)


def within(sources: list[Source], weights: list[float], budget: float) -> bool:
    return all(w * budget <= s.repeats * s.tokens * (1 + 1e-12) for s, w in zip(sources, weights))


def exponent_for(sources: list[Source], budget: float) -> float:
    """Least exponent in [0, 1] whose weights keep every repetition limit at this budget, by bisection."""
    if within(sources, tempered(sources, 0.0), budget):
        return 0.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if within(sources, tempered(sources, mid), budget) else (mid, high)
    return high


def exponent_for_entropy(sources: list[Source], wanted: float) -> float:
    """Exponent in [0, 1] whose weights have the wanted entropy, as near as the family comes, by bisection."""
    low, high = 0.0, 1.0
    at0, at1 = entropy(tempered(sources, 0.0)), entropy(tempered(sources, 1.0))
    if not min(at0, at1) < wanted < max(at0, at1):
        return 0.0 if abs(at0 - wanted) <= abs(at1 - wanted) else 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if (entropy(tempered(sources, mid)) > wanted) == (at1 > at0) else (mid, high)
    return (low + high) / 2


def plan(counted: DataFrame, targets: DataFrame, budget: float | str | None = None) -> DataFrame:
    """A row each source that has a target and tokens: weight, budget (tokens), blocks (whole permutations), rest (tokens of the last)."""
    spark = counted.sparkSession
    wanted = targets.filter("weight_permille > 0 and max_repeats > 0").select(F.trim("source").alias("source"), "weight_permille", "max_repeats")
    sums = counted.groupBy("source").agg(F.sum("tokens").alias("tokens")).join(F.broadcast(wanted), "source").filter("tokens > 0").orderBy("source").collect()  # a row each target source
    sources = [Source(r["source"], r["tokens"], r["weight_permille"] / 1000, r["max_repeats"]) for r in sums]
    total = sum(s.weight for s in sources)
    for s in sources:
        s.weight /= total
    most = min((s.repeats * s.tokens / s.weight for s in sources), default=0.0)
    if budget == ALL:
        budget = float(sum(s.tokens for s in sources))
    size = most if budget is None else min(budget, sum(s.repeats * s.tokens for s in sources))
    weights = tempered(sources, exponent_for(sources, size)) if sources else []
    rows = []
    for s, w in zip(sources, weights):
        b = min(int(w * size + 1e-6), s.repeats * s.tokens)
        rows.append((s.name, s.tokens, s.weight, w, b, b // s.tokens, b % s.tokens, s.repeats))
    return spark.createDataFrame(rows, "source string, tokens_available long, target_share double, weight double, budget long, blocks long, rest long, max_repeats int")


def mix(documents: DataFrame, targets: DataFrame, budget: float | str | None = None, vocabulary: str = tokenizer.BYTE_BPE_50K) -> tuple[DataFrame, DataFrame]:
    """(uses, plan).  uses: doc_id, source, tokens, block; a row each use of a record, block counting from 0.

    Texts without tokens, null sources, sources without a target and targets without tokens take no part, and the other targets are scaled to 1;
    a record is used at most max_repeats times, in different blocks; repeated rows of a doc_id are separate records; ties of the hash go by
    doc_id; empty tables give empty results; other columns are ignored."""
    counted = cut(token_counts(documents, vocabulary).withColumn("source", F.trim("source")))
    planned = plan(counted, targets, budget)
    part = counted.filter("tokens > 0").join(F.broadcast(planned.select("source", "blocks", "rest")), "source")
    whole = part.withColumn("block", F.explode(F.expr("if(blocks > 0, sequence(0L, blocks - 1), array())"))).select("doc_id", "source", "tokens", F.col("block").cast("int").alias("block"))
    hashed = part.filter("rest > 0").withColumn("order", F.xxhash64(F.lit(SEED), "blocks", "doc_id")).withColumn("bin", F.expr(f"int((order / 18446744073709551616D + 0.5D) * {BINS})"))
    bins = hashed.groupBy("source", "bin", "rest").agg(F.sum("tokens").alias("n"))
    marks = bins.withColumn("upto", F.sum("n").over(Window.partitionBy("source").orderBy("bin"))).filter("upto - n < rest")  # at most BINS rows a source
    marks = marks.select("source", "bin", (F.col("rest") - F.col("upto") + F.col("n")).alias("room"), (F.col("upto") <= F.col("rest")).alias("all"))
    kept = hashed.join(F.broadcast(marks), ["source", "bin"])
    run = F.sum("tokens").over(Window.partitionBy("source").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0))
    edge = kept.filter("not all").withColumn("run", run).filter("run <= room")
    last = kept.filter("all").select("doc_id", "source", "tokens", "blocks").unionByName(edge.select("doc_id", "source", "tokens", "blocks"))
    return whole.unionByName(last.select("doc_id", "source", "tokens", F.col("blocks").cast("int").alias("block"))), planned


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "documents", ["doc_id", "source", "text"]), table(spark, sf_dir, "mix_targets")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(*_tables(spark, sf_dir))[0]


def p7_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A mix of as many tokens as the sources hold.  The targets cannot be kept within the repetition limits at that size, so the exponent is
    bisected to where the limits hold."""
    documents, targets = _tables(spark, sf_dir)
    return mix(documents, targets, ALL)[0]


def p7_full_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of ``p7_full``, as in ``p7_shares``."""
    documents, targets = _tables(spark, sf_dir)
    return shares(documents, targets, ALL)


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of ``p7_mix``."""
    return shares(*_tables(spark, sf_dir))


def shares(documents: DataFrame, targets: DataFrame, budget: float | str | None = None) -> DataFrame:
    """Target and reached share of each source in mix_targets, with the weight planned for it, its tokens and most uses of a record."""
    uses, planned = mix(documents, targets, budget)
    per_doc = uses.groupBy("source", "doc_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("uses"))
    reached = per_doc.groupBy("source").agg(F.sum("tokens").alias("tokens_used"), F.max("uses").alias("most_uses"))
    total = F.sum("tokens_used").over(Window.partitionBy(F.lit(0)))  # a row each source
    names = targets.select(F.trim("source").alias("source"), "weight_permille", "max_repeats")
    rows = names.join(planned.select("source", "tokens_available", "target_share", "weight"), "source", "left").join(reached, "source", "left").withColumn("share", F.round(F.col("tokens_used") / total, 6))
    return rows.select("source", "weight_permille", "max_repeats", F.coalesce("tokens_available", F.lit(0)).alias("tokens_available"), F.round("target_share", 6).alias("target_share"), F.round("weight", 6).alias("weight"), F.coalesce("tokens_used", F.lit(0)).alias("tokens_used"), F.coalesce("most_uses", F.lit(0)).alias("most_uses"), F.coalesce("share", F.lit(0.0)).alias("share"))
