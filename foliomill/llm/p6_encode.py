"""Problem 6: encoding of the whole corpus with a public byte-pair tokenizer.

Each task splits its texts into words and hands the words it has not met to DuckDB: token-position rows join the merge table, a
recursive query contracts each word's minimum-rank pair, leftmost first, until no pair is left, and an ordered aggregation decodes the rows into
ids.  Equal pairs of a word that do not overlap are contracted in one round, which leaves the fixpoint as it is.  Very long words are encoded in
overlapping pieces that are joined at a common token, so their cost grows with their length only.  A round overwrites the last, and nothing
is spilled to a local folder.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import tokenizer
from foliomill.plans.runtime import at_least, table

#: Encoded words a task keeps; emptied when full, so memory is bounded.
CACHE_WORDS = 400_000
_PATTERN = regex.compile(tokenizer.WORD_PATTERN)

#: A word of more than LONG bytes is encoded in overlapping pieces of 2 * PIECE bytes, one every PIECE bytes.
LONG, PIECE = 64, 16
#: Token rows of one statement.
ROWS = 120_000

# Rows are keyed, so a round overwrites the last one: a token that is contracted into its left neighbour becomes null.
CONTRACT = """
WITH RECURSIVE step(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM pieces
  UNION ALL
  SELECT w, pos, CASE WHEN pos = best & 4294967295 THEN best >> 32 WHEN before = best & 4294967295 THEN NULL ELSE tok END
  FROM (
    -- the least rank, and of its places the leftmost
    SELECT s.*, min((m.made::BIGINT << 32) | s.pos) OVER (PARTITION BY s.w) AS best
    FROM (SELECT *, lead(tok) OVER here AS nxt, lag(pos) OVER here AS before FROM step WHERE tok IS NOT NULL WINDOW here AS (PARTITION BY w ORDER BY pos)) s
    LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt)
  WHERE best IS NOT NULL
)
SELECT w, list(tok ORDER BY pos) AS ids
FROM step
WHERE tok IS NOT NULL
GROUP BY w
"""

# The same for strings over LONG (pieces that had to be put together): a round contracts all places of the least rank that do not
# overlap, from the left, which leaves the fixpoint as it is and keeps the rounds of one letter over and over few.
CONTRACT_LONG = """
WITH RECURSIVE step(w, pos, tok) USING KEY (w, pos) AS (
  SELECT w, pos, tok FROM pieces
  UNION ALL
  SELECT w, pos, CASE WHEN eaten THEN NULL WHEN taken THEN made ELSE tok END
  FROM (
    SELECT *, coalesce(lag(taken) OVER (PARTITION BY w ORDER BY pos), false) AS eaten
    FROM (
      -- of overlapping equal pairs (a a a) every second one is taken, from the left
      SELECT *, hit AND (row_number() OVER (PARTITION BY w, hit, island ORDER BY pos)) % 2 = 1 AS taken
      FROM (
        SELECT *, idx - row_number() OVER (PARTITION BY w, hit ORDER BY pos) AS island
        FROM (
          SELECT *, made IS NOT NULL AND made = min(made) OVER (PARTITION BY w) AS hit, min(made) OVER (PARTITION BY w) AS best
          FROM (
            SELECT s.w, s.pos, s.tok, s.idx, m.made
            FROM (SELECT *, lead(tok) OVER (PARTITION BY w ORDER BY pos) AS nxt, row_number() OVER (PARTITION BY w ORDER BY pos) AS idx FROM step WHERE tok IS NOT NULL) s
            LEFT JOIN merges m ON m.a = s.tok AND m.b = s.nxt)))
      WHERE best IS NOT NULL))
)
SELECT w, list(tok ORDER BY pos) AS ids
FROM step
WHERE tok IS NOT NULL
GROUP BY w
"""


@functools.lru_cache(maxsize=2)
def connection(vocabulary: str) -> duckdb.DuckDBPyConnection:
    """One in-memory database a process, holding the merge table: (a, b) -> made, ranked by made."""
    ranks = tokenizer.ranks(vocabulary)
    rows = [(ranks[t[:k]], ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})  # no spilling to a local folder
    frame = pd.DataFrame(rows, columns=["a", "b", "made"], dtype="int32")
    con.register("rows", frame)
    con.execute("CREATE TABLE merges AS SELECT * FROM rows")
    con.unregister("rows")
    return con


def contracted(words: list[bytes], vocabulary: str) -> list[list[int]]:
    """Ids of byte strings by the recursive query, ROWS token rows a statement (more only if one string is longer)."""
    ranks = tokenizer.ranks(vocabulary)
    single = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
    con = connection(vocabulary)
    out: list[list[int]] = [[] for _ in words]
    start = 0
    while start < len(words):
        end, rows = start, 0
        while end < len(words) and (end == start or rows + len(words[end]) <= ROWS):
            rows += len(words[end])
            end += 1
        sizes = np.array([len(x) for x in words[start:end]])
        w = np.repeat(np.arange(start, end, dtype=np.int32), sizes)
        pos = (np.arange(rows) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
        con.register("pieces", pd.DataFrame({"w": w, "pos": pos, "tok": single[np.frombuffer(b"".join(words[start:end]), np.uint8)]}))
        for k, ids in con.execute(CONTRACT_LONG if sizes.max() > LONG else CONTRACT).fetchall():
            out[k] = ids
        con.unregister("pieces")
        start = end
    return out


@functools.lru_cache(maxsize=2)
def token_lengths(vocabulary: str) -> np.ndarray:
    ranks = tokenizer.ranks(vocabulary)
    out = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, k in ranks.items():
        out[k] = len(token)
    return out


def common_tokens(a: list[int], b: list[int], shift: int, lengths: np.ndarray) -> tuple[int, int] | None:
    """Places in ``a`` and ``b`` of the first token that both have at the same bytes, ``b`` beginning ``shift`` bytes after ``a``."""
    place = {(int(e), t): j for j, (e, t) in enumerate(zip(np.cumsum(lengths[b]) + shift, b))}
    for i, key in enumerate(zip(np.cumsum(lengths[a]).tolist(), a)):
        if key in place:
            return i, place[key]
    return None


def encode_long(words: list[bytes], vocabulary: str) -> list[list[int]]:
    """Ids of long words, by pieces that overlap.

    A list of tokens is a word's encoding if any two neighbours are each other's encoding, so two pieces may be joined at any token
    that both have at the same place: left of it the pairs are those of the first piece, right of it those of the second.  Pieces without such
    a token are put together and encoded again, at the latest as the whole word."""
    lengths = token_lengths(vocabulary)
    cuts = [[(x, min(x + 2 * PIECE, len(word))) for x in range(0, len(word) - PIECE, PIECE)] for word in words]
    known: list[dict[tuple[int, int], list[int]]] = [{} for _ in words]
    out: list[list[int]] = [[] for _ in words]
    todo = list(range(len(words)))
    while todo:
        fresh = [(k, span) for k in todo for span in cuts[k] if span not in known[k]]
        fresh.sort(key=lambda x: x[1][1] - x[1][0] > LONG)  # the long ones apart
        parts = [words[k][a:b] for k, (a, b) in fresh]
        at = sum(len(x) <= LONG for x in parts)
        for (k, span), ids in zip(fresh, contracted(parts[:at], vocabulary) + contracted(parts[at:], vocabulary)):
            known[k][span] = ids
        left = []
        for k in todo:
            ids, spans = known[k], cuts[k]
            meet = [common_tokens(ids[p], ids[q], q[0] - p[0], lengths) for p, q in zip(spans, spans[1:])]
            if None not in meet:
                begin = 0
                for span, where in zip(spans, meet):
                    out[k] += ids[span][begin : where[0]]
                    begin = where[1]
                out[k] += ids[spans[-1]][begin:]
                continue
            new = [spans[0]]
            for span, where in zip(spans[1:], meet):
                if where is None:
                    new[-1] = (new[-1][0], span[1])
                else:
                    new.append(span)
            cuts[k] = new
            left.append(k)
        todo = left
    return out


def encode_words(words: list[bytes], vocabulary: str = tokenizer.BYTE_BPE_50K) -> list[list[int]]:
    """Ids of distinct words."""
    short, long = ([k for k, x in enumerate(words) if (len(x) > LONG) is big] for big in (False, True))
    out: list[list[int]] = [[] for _ in words]
    for places, encode in ((short, contracted), (long, encode_long)):
        for k, ids in zip(places, encode([words[k] for k in places], vocabulary)):
            out[k] = ids
    return out


def encode_texts(texts: list[str | None], known: dict[str, list[int]], vocabulary: str) -> list[list[int]]:
    split = [_PATTERN.findall(x) if x else [] for x in texts]
    fresh = list({w for words in split for w in words if w not in known})
    if len(known) + len(fresh) > CACHE_WORDS:
        known.clear()
        fresh = list({w for words in split for w in words})
    known.update(zip(fresh, encode_words([w.encode("utf-8", "replace") for w in fresh], vocabulary)))
    return [[i for w in words for i in known[w]] for words in split]


def encoded(documents: DataFrame, vocabulary: str = tokenizer.BYTE_BPE_50K) -> DataFrame:
    """(doc_id, ids), a row each row of documents; a null or empty text gives an empty list; repeated rows stay; texts are encoded whole,
    without special tokens (their spellings are ordinary text); an empty table gives an empty result; other columns are ignored."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, list[int]] = {}
        for pdf in batches:
            for start in range(0, len(pdf), 500):
                part = pdf.iloc[start : start + 500]
                yield pd.DataFrame({"doc_id": part["doc_id"], "ids": encode_texts(part["text"].tolist(), known, vocabulary)})

    # Ids travel as text: a null among long integers would turn a batch's ids into floats.
    return at_least(documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")).mapInPandas(run, "doc_id string, ids array<int>").withColumn("doc_id", F.col("doc_id").cast("long"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents", ["doc_id", "text"]))


def p6_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and characters of each source and language."""
    rows = table(spark, sf_dir, "documents", ["doc_id", "source", "lang", "text"])
    sizes = encoded(rows).select("doc_id", F.size("ids").alias("tokens")).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    return rows.select("doc_id", "source", "lang", F.length("text").alias("chars")).join(sizes, "doc_id").groupBy("source", "lang").agg(F.count("*").alias("n_rows"), F.sum("tokens").alias("tokens"), F.sum("chars").alias("chars"))
