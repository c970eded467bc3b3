"""Throughput of a model backend over a grid of settings."""

from __future__ import annotations

import itertools
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliomill.operators import clues


def representative(requests: DataFrame, prompt: str, count: int) -> DataFrame:
    """``count`` prompts for a benchmark: every n-th of all by length, so that short and long ones have their share.  Prompts are grouped by length first, and
    of each length the first by text are taken; nothing is sorted but the lengths."""
    rows = requests.filter(F.col(prompt).isNotNull()).select(prompt).distinct().withColumn("size", F.length(prompt))
    bounds = rows.agg(F.percentile_approx("size", [k / count for k in range(1, count + 1)], 10_000).alias("sizes")).select(F.posexplode("sizes").alias("place", "size"))
    wanted = bounds.groupBy("size").agg(F.count("*").alias("n"))
    per_size = rows.join(F.broadcast(wanted), "size").withColumn("order", F.xxhash64(prompt))  # at most ``count`` sizes
    first = per_size.groupBy("size", F.pmod("order", F.col("n")).alias("part")).agg(F.min(prompt).alias(prompt))
    return first.select(prompt)


def grid(requests: DataFrame, prompt: str, load: Callable[[dict], Callable[[], clues.Backend]], knobs: dict[str, list], clock: Callable[[], float] = time.perf_counter) -> list[dict]:
    """One run for each combination of knobs (``batch`` is the batch size; the others go to ``load``): requests, failures, seconds, requests and characters a
    second."""
    out = []
    for values in itertools.product(*knobs.values()):
        setting = dict(zip(knobs, values))
        began = clock()
        answers = clues.generate(requests, prompt, load(setting), setting.get("batch", 64))
        n, failed, chars = answers.agg(F.count("*"), F.count("error"), F.coalesce(F.sum(F.length("answer")), F.lit(0))).first()
        seconds = max(clock() - began, 1e-9)
        out.append({**setting, "requests": n, "failed": failed, "seconds": seconds, "requests_per_second": n / seconds, "chars_per_second": chars / seconds})
    return out


def best(runs: list[dict]) -> dict | None:
    """The fastest run without a failure; of equal ones the first; none if all failed."""
    whole = [r for r in runs if not r["failed"]]
    return max(whole, key=lambda r: (r["requests_per_second"], r["chars_per_second"])) if whole else None
