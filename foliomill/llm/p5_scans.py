"""Problem 5: noise in text from scanned pages.

Word counts and skip-gram vectors are learned from all samples: counts by partial aggregation, vectors by skip-gram with negative
sampling on each split of the samples from one start, averaged by word over the splits.  The splits go by a hash of the sample, so
the vectors do not depend on how the table is stored.  Only words of at least a millionth (vectors: a fifty-thousandth) of all tokens are
kept, which bounds both tables whatever the corpus.  A rare word has the vector that its context gives it; it is linked to neighbours within plausible
glyph edits and corrected in context; then furniture is removed and paragraphs are reflowed (``scan_lines``).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import scan_lines
from foliomill.plans.runtime import at_least, cut, table

#: Least share of all tokens: of a word of the vocabulary (so at most 10^6 words), and of one with a vector (at most 50,000).
WORD_SHARE, VECTOR_SHARE = 1e-6, 2e-5
DIMENSIONS, WIDTH, NEGATIVES, ROUNDS, EPOCHS, BATCH, RATE = 24, 3, 2, 1, 2, 4096, 0.06
#: Tokens whose pairs are counted at once.
PAIR_TOKENS = 1_000_000
#: Samples of a split, on the average: enough to train its vectors on, whatever the size of the table.
SPLIT_SAMPLES = 2048
#: A line is a known head if its form stands alone in at least this share of the samples.
HEAD_SHARE = 0.002


def word_counts(samples: DataFrame) -> DataFrame:
    """(word, n, kind): counts of words (kind w) and, by sample, of lines that may be heads (kind h)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        heads: Counter = Counter()
        samples = 0
        for pdf in batches:
            for text in pdf["markdown"]:
                if not text:
                    continue
                samples += 1
                words.update(scan_lines.vocabulary_tokens(text))
                lines = ["", *text.split("\n"), ""]
                heads.update({c for a, x, b in zip(lines, lines[1:], lines[2:]) if x and not a.strip() and not b.strip() and (c := possible_head(x))})
        cores: Counter = Counter()
        for token, n in words.items():
            c = scan_lines.core(token)
            if c and any(x.isalpha() for x in c):
                cores[c] += n
        rows = [("w", w, n) for w, n in cores.items()] + [("h", w, n) for w, n in heads.items()] + [("t", "", sum(words.values())), ("s", "", samples)]
        yield pd.DataFrame(rows, columns=["kind", "word", "n"])

    return samples.select("markdown").mapInPandas(run, "kind string, word string, n long").groupBy("kind", "word").agg(F.sum("n").alias("n"))


def possible_head(line: str) -> str | None:
    s = line.strip()
    if not s or len(s) > 60 or s[0] in "#|$*>`-•" or s.endswith((".", "!", "?", ":", ",", ";")) or not s[0].isupper() and not s[0].isdigit() or len(s.split()) > 8:
        return None
    c, _ = scan_lines.head_core(s)
    return c if len(c) > 8 and not any(x.isdigit() for x in c) else None


def count_pairs(ids: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (centre, context) pairs of word ids within WIDTH, as centre * size + context, and their counts; negative ids pair with nothing."""
    codes, counts = np.empty(0, np.int64), np.empty(0, np.int64)
    gap = np.full(WIDTH, -1, np.int64)
    start = 0
    while start < len(ids):
        end, tokens = start, 0
        while end < len(ids) and (end == start or tokens + len(ids[end]) <= PAIR_TOKENS):
            tokens += len(ids[end])
            end += 1
        x = np.concatenate([y for text in ids[start:end] for y in (text, gap)])  # texts stand too far apart to pair
        near = []
        for k in range(1, WIDTH + 1):
            a, b = x[:-k], x[k:]
            ok = (a >= 0) & (b >= 0)
            near += [a[ok] * size + b[ok], b[ok] * size + a[ok]]
        new, n = np.unique(np.concatenate(near), return_counts=True)
        codes, place = np.unique(np.concatenate([codes, new]), return_inverse=True)
        counts = np.bincount(place, weights=np.concatenate([counts, n]), minlength=len(codes)).astype(np.int64)
        start = end
    return codes, counts


def add_rows(matrix: np.ndarray, index: np.ndarray, change: np.ndarray) -> None:
    """matrix[index] += RATE * change, repeated rows summed and damped by the root of their number."""
    order = np.argsort(index, kind="stable")
    rows, first, n = np.unique(index[order], return_index=True, return_counts=True)
    matrix[rows] += RATE * np.add.reduceat(change[order], first, axis=0) / np.sqrt(n)[:, None]


def train_partition(ids: list[np.ndarray], inner: np.ndarray, outer: np.ndarray, weights: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Skip-gram with negative sampling over texts of word ids; the updated vectors and how often each word was a centre.

    All pairs of the texts are counted, and each distinct pair is one step weighted by the root of its count, which does what thinning out
    frequent words does, at the cost of the distinct pairs only."""
    rng = np.random.default_rng(seed)
    inner, outer = inner.copy(), outer.copy()
    codes, counts = count_pairs(ids, len(inner))
    a, b = codes // len(inner), codes % len(inner)
    seen = np.bincount(a, weights=counts, minlength=len(inner)).astype(np.int64)
    step = np.minimum(np.sqrt(counts), 8.0).astype(np.float32)
    noise = np.cumsum(weights**0.75)
    order = np.concatenate([rng.permutation(len(codes)) for _ in range(EPOCHS)])
    for at in range(0, len(order), BATCH):
        k = order[at : at + BATCH]
        bad = np.searchsorted(noise, rng.random((len(k), NEGATIVES)) * noise[-1]).clip(0, len(inner) - 1)
        targets = np.concatenate([b[k][:, None], bad], axis=1)
        v, u = inner[a[k]], outer[targets]
        g = -1 / (1 + np.exp(-np.einsum("nd,nkd->nk", v, u)))
        g[:, 0] += 1
        g *= step[k][:, None]
        dv, du = np.einsum("nk,nkd->nd", g, u), (g[:, :, None] * v[:, None, :]).reshape(-1, DIMENSIONS)
        add_rows(inner, a[k], dv)
        add_rows(outer, targets.ravel(), du)
    return inner, outer, seen


class Ids(dict):
    """token -> number of its word, -1 if it has no vector; computed once a word form."""

    def __init__(self, ids: dict[str, int]):
        super().__init__()
        self.ids = ids

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        k = self[token] = self.ids.get(scan_lines.core(token), -1)
        return k


def by_split(samples: DataFrame) -> DataFrame:
    """(sample_id, markdown), each sample once (its least text), a partition each split: the splits depend on the samples only.

    Repeats are dropped before rows are dealt into splits, so a sample that is repeated over and over does not fill one."""
    once = cut(samples.filter("sample_id is not null").groupBy("sample_id").agg(F.min("markdown").alias("markdown")))
    return once.repartition(max(1, -(-once.count() // SPLIT_SAMPLES)), "sample_id")


def skip_gram(samples: DataFrame, counts: dict[str, int], total: int) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """Word ids and both vector tables, by ROUNDS of training on every partition and averaging."""
    words = sorted(w for w, n in counts.items() if n >= max(3, VECTOR_SHARE * total))
    ids = {w: k for k, w in enumerate(words)}
    weights = np.array([counts[w] for w in words], dtype=float)
    rng = np.random.default_rng(5)
    inner = ((rng.random((len(words), DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    outer = np.zeros_like(inner)
    if not words:
        return ids, inner, outer
    spark = samples.sparkSession
    names = [f"v{k}" for k in range(2 * DIMENSIONS)]
    for r in range(ROUNDS):
        state = spark.sparkContext.broadcast((ids, inner, outer, weights))

        def run(batches: Iterator[pd.DataFrame], state=state, r=r) -> Iterator[pd.DataFrame]:
            ids, inner, outer, weights = state.value
            known = Ids(ids)
            # A partition is a split, see ``by_split``; its samples in one order, whatever order they came in.
            split = sorted((x for pdf in batches for x in zip(pdf["sample_id"], pdf["markdown"]) if x[1]), key=lambda x: x[0])
            texts = [np.fromiter((known[w] for w in scan_lines.vocabulary_tokens(x)), np.int64) for _, x in split]
            a, b, seen = train_partition([x for x in texts if len(x) > WIDTH], inner, outer, weights, 100 + r)
            used = np.flatnonzero(seen)
            moved = np.concatenate([a[used], b[used]], axis=1).astype(np.float64) * seen[used, None]
            yield pd.DataFrame(moved, columns=names).assign(id=used, n=seen[used])[["id", "n", *names]]

        moved = samples.select("sample_id", "markdown").mapInPandas(run, "id int, n long, " + ", ".join(f"{c} double" for c in names))
        # Rounded, so that the order of the sums does not show.
        mean = moved.groupBy("id").agg(*(F.round(F.sum(c) / F.sum("n"), 6).alias(c) for c in names)).toPandas()  # a row a word with a vector
        inner, outer = inner.copy(), outer.copy()
        at, values = mean["id"].to_numpy(), mean[names].to_numpy(np.float32)
        inner[at], outer[at] = values[:, :DIMENSIONS], values[:, DIMENSIONS:]
    return ids, inner, outer


def learn(samples: DataFrame) -> Broadcast:
    """The model of all samples, on every executor; its size is bounded by the least shares."""
    counted = cut(word_counts(at_least(samples)))
    scalars = {r["kind"]: r["n"] for r in counted.filter("kind in ('t', 's')").collect()}
    total, n = scalars.get("t", 0), scalars.get("s", 0)
    frequent = counted.filter((F.col("kind") == "w") & (F.col("n") >= max(3, WORD_SHARE * total))).toPandas()
    heads = counted.filter((F.col("kind") == "h") & (F.col("n") >= max(4, HEAD_SHARE * n))).toPandas()
    counts = dict(zip(frequent["word"], frequent["n"].tolist()))
    ids, inner, outer = skip_gram(samples, counts, total)
    return samples.sparkSession.sparkContext.broadcast(scan_lines.Model(counts, total, ids, inner, outer, frozenset(heads["word"])))


def repaired(samples: DataFrame) -> DataFrame:
    """(sample_id, text, noise array<struct<line_no, noise>>), a row each sample.

    Rows without a sample_id are left out; a null or empty markdown gives an empty text and no noise; repeated rows count once (the
    least text); texts are read whole; an empty table gives an empty result; other columns are ignored."""
    base = cut(by_split(samples))
    model = learn(base)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            done = [scan_lines.read(x, model.value) if x else ([], "") for x in pdf["markdown"]]
            yield pd.DataFrame({"sample_id": pdf["sample_id"], "text": [t for _, t in done], "noise": [[{"line_no": n, "noise": k} for n, k in found] for found, _ in done]})

    return at_least(base).mapInPandas(run, "sample_id long, text string, noise array<struct<line_no:int,noise:string>>")


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "text_samples", ["sample_id", "markdown"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(_samples(spark, sf_dir)).select("sample_id", F.explode("noise").alias("x")).select("sample_id", "x.line_no", "x.noise")


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The repaired texts."""
    return repaired(_samples(spark, sf_dir)).select("sample_id", "text")
