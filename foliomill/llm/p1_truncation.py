"""Problem 1: text cut off by field or transfer limits.

Near-copies come from min-hash banding over the five-word shingles of beginnings (``shingles``): a text whose closing is not whole by its own structure
looks for texts that begin like it.  A pair is verified if the longer holds 0.8 or more of the shorter's shingles and an alignment of their
words ends early in the shorter one; whether it ends inside a word, sentence or item of the longer copy then decides, whatever the closing
looks like.  Texts without such a copy are scored by the terminality of their closing word (``closing``), with the tokens spent on a
text as a hint: a text much shorter than its tokens was cut afterwards.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import closing
from foliomill.llm.shingles import BANDS, LANES, SHINGLE, containment, own_level, signatures
from foliomill.plans.runtime import at_least, cut, small, table

SIMILARITY = 0.8
#: A text of at least this terminality is closed by its own structure, so nothing of it is missing.
WHOLE = 0.999
#: Tokens a character that only one whole text in a thousand has; texts beyond it are doubted twice as much.
SPENT, DOUBT = 0.999, 0.5
#: A large bucket is joined in blocks of so many members.
BLOCK = 1000


def learn_terminality(texts: DataFrame, column: str = "text") -> DataFrame:
    """(slot, closes, total) over all texts, pre-aggregated a batch; at most ``closing.SLOTS`` rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: Counter = Counter()
        for pdf in batches:
            for (kind, key, closes), n in closing.evidence(pdf[column].tolist()).items():
                counts[closing.slot(kind, key), closes] += n
        yield pd.DataFrame([(k, n if c else 0, n) for (k, c), n in counts.items()], columns=["slot", "closes", "total"])

    per_task = texts.select(column).mapInPandas(run, "slot int, closes long, total long")
    return per_task.groupBy("slot").agg(F.sum("closes").alias("closes"), F.sum("total").alias("total"))


def terminality_table(texts: DataFrame, column: str = "text") -> Broadcast:
    """The learned table as two fixed arrays on every executor (8 MB, whatever the corpus)."""
    spark = texts.sparkSession
    rows = learn_terminality(texts, column).toPandas()
    closes, total = np.zeros(closing.SLOTS, np.float32), np.zeros(closing.SLOTS, np.float32)
    closes[rows["slot"].to_numpy()] = rows["closes"].to_numpy()
    total[rows["slot"].to_numpy()] = rows["total"].to_numpy()
    return spark.sparkContext.broadcast((closes, total))


def scored(texts: DataFrame, key: str, model: Broadcast, keep: tuple[str, ...] = ()) -> DataFrame:
    """Each row's terminality, characters, hash of its text, min-hash bands of all its levels (null if it is too short), the level that is its own, and map of
    shingles."""
    types = dict(texts.dtypes)
    schema = ", ".join([f"{key} {types[key]}", *(f"{c} {types[c]}" for c in keep), "terminality double, chars int, words int, text_hash long, bands array<int>, level int", *(f"lane_{k} long" for k in range(LANES))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        closes, total = model.value
        for pdf in batches:
            text = pdf["text"].tolist()
            words, whole, bands, maps = signatures(text)
            out = pdf[[key, *keep]].copy()
            out["terminality"] = [closing.score(x, closes, total) for x in text]
            out["chars"] = [len(x) if x else 0 for x in text]
            out["words"], out["text_hash"] = words, whole
            out["bands"] = [None if x is None else x.ravel() for x in bands]
            out["level"] = [own_level(n) for n in words]
            for k in range(LANES):
                out[f"lane_{k}"] = maps[:, k]
            yield out

    return texts.select(key, *keep, "text").mapInPandas(run, schema)


def common_words(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence (bit-parallel)."""
    at: dict[str, int] = defaultdict(int)
    for i, x in enumerate(a):
        at[x] |= 1 << i
    full = v = (1 << len(a)) - 1
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


_WORDS = re.compile(r"\S+")
_CLOSED = re.compile(r"[.!?。！？][\"'”’»)\]]*$")
_ITEM = re.compile(r"\s*(?:[-*•–—‣◦·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s")


def ending(short: str, long: str) -> int:
    """How ``short``, aligned word by word with ``long``, ends: 0, no alignment, or it does not end early; 1, inside a word, sentence or item of
    ``long``; 2, where one of these ends in ``long``, too.

    The alignment must keep SIMILARITY of the words of ``short``; marks added after the cut do not count."""
    a = closing.strip_marks(short)[0].split()
    spans = [(m.start(), m.end()) for m in _WORDS.finditer(long)]
    b = [long[x:y] for x, y in spans]
    if not a:
        return 0
    n = len(a)
    slack = n // 5 + 1
    if a[:-1] != b[: n - 1] and common_words(a, b[: n + slack]) < SIMILARITY * n:
        return 0
    # Where the last words of the shorter text, as many as possible, stand in the longer one, nearest to their own place.
    for k in range(min(5, n), 0, -1):
        tail = a[n - k :]
        places = [j for j in range(max(k, n - slack), min(len(b), n + slack) + 1) if b[j - k : j - 1] == tail[:-1] and b[j - 1].startswith(tail[-1])]
        if places:
            j = min(places, key=lambda j: abs(j - n))
            break
    else:
        return 0
    if b[j - 1] != a[-1]:
        more = b[j - 1][len(a[-1]) :]
        # What the longer copy has next is a mark between items, or the word or sentence goes on.
        return 2 if set(more) <= set(",;") and j < len(b) else 1 if j < len(b) or any(c.isalnum() for c in more) else 0
    if j == len(b):
        return 0
    rest = long[spans[j - 1][1] : spans[j][1]]
    if _CLOSED.search(a[-1]) and (rest[:1] == "\n" or not b[j][:1].islower()) or "\n" in rest and (_ITEM.match(long, spans[j][0]) or "\n\n" in rest):
        return 2
    return 1


def early_copies(texts: DataFrame, sig: DataFrame, key: str) -> DataFrame:
    """(key, partner, inside): texts that are ``open`` and have a verified copy that goes on where they end; inside is true if one of the
    copies goes on in the middle of a word, sentence or item.

    ``sig`` holds a row for each distinct text (its least key).  An open text meets every other text that has one of its own bands: the
    texts of a band are dealt into blocks of BLOCK, each of which meets all its open texts."""
    lanes = [f"lane_{k}" for k in range(LANES)]
    open_ = sig.filter("open and level >= 0 and bands is not null").select(key, F.explode(F.expr(f"slice(bands, level * {BANDS} + 1, {BANDS})")).alias("bucket"))
    asked = cut(open_.groupBy("bucket").agg(F.count("*").alias("n_open")))
    members = sig.filter("bands is not null").select(F.col(key).alias("partner"), F.explode("bands").alias("bucket")).join(small(asked.select("bucket")), "bucket")
    members = cut(members)
    load = cut(members.groupBy("bucket").agg(F.expr(f"int(ceil(count(*) / {BLOCK}))").alias("blocks")).filter("blocks > 0"))
    short = open_.join(small(load), "bucket").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).select("bucket", "block", key)
    other = members.join(small(load.filter("blocks > 1")), "bucket", "left").select("bucket", F.expr("coalesce(int(pmod(xxhash64(partner), blocks)), 0)").alias("block"), "partner")
    met = short.join(other, ["bucket", "block"]).filter(F.col(key) != F.col("partner")).select(key, "partner").distinct()
    # Every shingle that the longer copy lacks sets at most one bit that it lacks.
    fields = cut(sig.select(key, "words", *lanes))
    a, b = (small(fields.select(F.col(key).alias(name), *(F.col(c).alias(f"{c}_{x}") for c in ("words", *lanes)))) for name, x in ((key, "a"), ("partner", "b")))
    alone = " + ".join(f"bit_count({c}_a & ~{c}_b)" for c in lanes)
    pairs = cut(met.join(a, key).join(b, "partner").filter(f"{alone} <= {1 - SIMILARITY}D * words_a + {SHINGLE}").select(key, "partner"))
    need = pairs.select(key).union(pairs.select("partner")).distinct()
    bodies = texts.join(small(need), key, "left_semi").groupBy(key).agg(F.first("text").alias("text"))
    both = pairs.join(bodies, key).join(bodies.select(F.col(key).alias("partner"), F.col("text").alias("whole")), "partner")

    @F.pandas_udf("int")
    def ends(text: pd.Series, whole: pd.Series) -> pd.Series:
        return pd.Series([ending(a, b) if containment(a, b) >= SIMILARITY else 0 for a, b in zip(text, whole)])

    return both.withColumn("end", ends("text", "whole")).filter("end > 0").groupBy(key).agg(F.min("partner").alias("partner"), F.max(F.expr("end = 1")).alias("inside"))


def truncated(texts: DataFrame, key: str = "result_id", source: str = "source", tokens: str = "generated_tokens", match: bool = True) -> DataFrame:
    """One row a distinct key: source, terminality, partner (of the near-copy that goes on), truncated.

    Rows with a null key are left out; a null, empty or markless text is not truncated; repeated rows of a key count once
    (their least terminality and source, their most tokens); null tokens are no hint; texts of any length are read whole; an empty table gives an empty
    result; other columns of ``texts`` are ignored.  A text closed by its own structure (terminality of WHOLE or more) is whole.  Any other text
    with a verified longer copy is truncated if the copy goes on inside a word, sentence or item; without such a copy if its terminality, times DOUBT for a
    text with more tokens a character than whole texts have, is under ``closing.CUTOFF``.  ``match=False`` leaves the copies out."""
    base = at_least(texts.select(F.col(key).alias("key"), F.col(source).alias("source"), F.col(tokens).cast("int").alias("tokens"), "text").filter("key is not null"))
    model = terminality_table(base)
    rows = cut(scored(base, "key", model, ("source", "tokens")))
    spent = F.col("tokens") / F.greatest(F.col("chars"), F.lit(1))
    usual = rows.filter(f"terminality >= {WHOLE}D and words >= 5 and tokens is not null").agg(F.percentile_approx(spent, SPENT, 10_000)).first()[0]
    doubt = F.when(spent > F.lit(usual), F.lit(DOUBT)).otherwise(F.lit(1.0)) if usual is not None else F.lit(1.0)
    one = rows.filter("bands is not null").groupBy("text_hash").agg(F.min("key").alias("key"), *(F.first(c).alias(c) for c in ("words", "bands", "level")), F.min(F.expr(f"terminality < {WHOLE}D")).alias("open"), *(F.first(f"lane_{k}").alias(f"lane_{k}") for k in range(LANES)))
    if match:
        one = cut(one)
        found = early_copies(base, one, "key")
    else:
        found = one.limit(0).select("key", F.col("key").alias("partner"), F.lit(True).alias("inside"))
    matched = cut(found.join(one.select("key", "text_hash"), "key").select("text_hash", "partner", "inside"))
    same = rows.select("key", "text_hash").join(small(matched), "text_hash").groupBy("key").agg(F.min("partner").alias("partner"), F.max("inside").alias("inside"))
    flat = rows.groupBy("key").agg(F.min("source").alias("source"), F.min("terminality").alias("terminality"), F.min(F.col("terminality") * doubt).alias("doubted"))
    out = flat.join(same, "key", "left")
    verdict = F.when(F.col("terminality") >= WHOLE, False).when(F.col("partner").isNotNull(), F.col("inside")).otherwise(F.col("doubted") < closing.CUTOFF)
    return out.select(F.col("key").alias(key), F.col("source").alias("source"), "terminality", "partner", verdict.alias("truncated"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncated(table(spark, sf_dir, "generation_results", ["result_id", "source", "text", "generated_tokens"])).filter("truncated").select("result_id")


def p1_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of truncated rows for each source (null sources as one group)."""
    rows = truncated(table(spark, sf_dir, "generation_results", ["result_id", "source", "text", "generated_tokens"]))
    return rows.groupBy("source").agg(F.count("*").alias("n_rows"), F.sum(F.col("truncated").cast("long")).alias("n_truncated")).withColumn("share", F.round(F.col("n_truncated") / F.col("n_rows"), 6))
