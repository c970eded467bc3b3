"""Problem 3: the same or nearly the same records across splits.

Entries are resolved to documents by a canonical path, then linked by document, by bytes, and by abstract.  Near-equal abstracts
are found by winnowing: rolling hashes of five words, of which each window (the longer the text, the wider, see ``window_of``) selects
its least.  The order of the hashes puts grams of widespread words last (word frequencies come from the whole corpus), so a window that can avoid the phrases everybody uses
does; the choice still depends on the gram alone, so equal passages select equal grams.  Selected grams are joined across the splits,
widespread ones too, in blocks: no gram is left out for its count.  Short abstracts, in which edits leave few runs of five words, are joined on their rarest words instead, an exact
way.  Pairs whose lengths or words rule out the wanted share are dropped; of the rest, a word alignment
(longest common subsequence) and its share of the longer abstract decide.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain
from urllib.parse import unquote

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.shingles import SHINGLE, rolling
from foliomill.plans.runtime import at_least, cut, small, store, table

#: (words, grams a window) of abstracts of at most so many words: any common run of window + SHINGLE - 1 words yields a common seed.  A wider
#: window selects a part of what a narrower one selects, so texts of different windows meet.
WINDOWS = ((60, 3), (100, 6), (1 << 30, 12))
#: An abstract of at most SHORT words is compared with all that can reach SHARE with it: they have a word in common among their rarest ones.
SHORT = 40
#: Grams with more than HOT cross-split pairs are joined in blocks of about BLOCK train abstracts, of STEP pairs at a time.  None of these changes a result:
#: abstracts that share a selected gram, however widespread, are compared.
HOT, BLOCK, STEP = 100, 1000, 1 << 16
#: 64-bit lanes of the map of an abstract's words; in blocks, the halves lie on each other.
LANES = 8
#: Share of the longer abstract's words that must stand in the other in the same order.
SHARE = 0.8

_WORD = re.compile(r"[^\W_]+")


def canonical_path(path: str | None) -> str | None:
    """A split entry or source/relative path, however spelled, in one form: percent signs decoded, one kind of slash, no empty or
    dot parts, composed accents, no case, no outer blanks."""
    if path is None:
        return None
    text = unicodedata.normalize("NFC", unquote(path)).replace("\\", "/").strip().casefold()
    parts: list[str] = []
    for part in (p.strip() for p in text.split("/")):
        if part == ".." and parts:
            parts.pop()
        elif part not in ("", ".", ".."):
            parts.append(part)
    return unicodedata.normalize("NFC", "/".join(parts)) or None


def possible_paths(entry: str | None) -> list[str]:
    """The canonical path of an entry and, should folders stand before its source, its shorter tails of at least two parts."""
    path = canonical_path(entry)
    parts = path.split("/") if path else []
    return ["/".join(parts[k:]) for k in range(max(1, len(parts) - 1))] if path else []


def abstract_words(text: str) -> list[str]:
    """Words of an abstract without case, accents, punctuation and spacing."""
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return _WORD.findall(text.casefold())


def common_share(a: list[str], b: list[str]) -> float:
    """Longest common subsequence of words as a share of the longer list (bit-parallel)."""
    if not a or not b:
        return 0.0
    at: dict[str, int] = defaultdict(int)
    for i, x in enumerate(a):
        at[x] |= 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = ((v + u) | (v - u)) & full
    return (len(a) - v.bit_count()) / max(len(a), len(b))


def share_of_pair(a: list[str], b: list[str]) -> float:
    """``common_share``, or 0 where the words, in whatever order, already rule SHARE out."""
    if (Counter(a) & Counter(b)).total() < SHARE * max(len(a), len(b)) - 1e-9:
        return 0.0
    return common_share(a, b)


def word_weights(abstracts: DataFrame, column: str) -> dict[str, int]:
    """Log-frequency of every word that occurs once in a thousand texts or more, over that of the median word of the texts: words no more
    frequent weigh nothing, so an edit does not draw the choice to itself.  At most a thousand times a text's mean length of words."""
    total = abstracts.count()  # from the footers
    least = max(2, total // 1000)
    words = abstracts.select(F.explode(F.split(F.lower(column), "[ .,;:()]+")).alias("word")).groupBy("word").count()
    # The rarer words are one row, of no word.
    rows = words.groupBy(F.expr(f"if(count >= {least}, word, null)").alias("word")).agg(F.sum("count").alias("count"))
    counts = {r["word"]: r["count"] for r in rows.toLocalIterator()}
    half = sum(counts.values()) / 2
    seen = counts.pop(None, 0)
    weights = {word: int(8 * math.log2(n / least + 1)) for word, n in counts.items()}
    usual = 0
    for word in sorted(weights, key=weights.__getitem__):
        if seen >= half:
            break
        seen, usual = seen + counts[word], weights[word]
    return {word: w - usual for word, w in weights.items() if w > usual}


class Words(dict):
    """word -> number, with the numbers' hashes and weights in arrays; words are numbered as they come."""

    def __init__(self, weights: dict[str, int]):
        super().__init__()
        self.weights, self.hashes, self.rare = weights, [], []

    def __missing__(self, word: str) -> int:
        k = self[word] = len(self)
        self.hashes.append(xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")))
        self.rare.append(self.weights.get(word, 0))
        return k


def window_of(n_words: int) -> int:
    return next(window for most, window in WINDOWS if n_words <= most)


def winnow(texts: list[list[str]], words: Words) -> tuple[list[list[int]], np.ndarray]:
    """Of each text the hashes of the selected grams, and a map of its words: each sets one of LANES * 64 bits, a word's further occurrences as words of their own.

    A gram is selected if some window of ``window_of`` grams has it first in the order: fewer widespread words, then lesser hash."""
    pad = SHINGLE + WINDOWS[-1][1]
    sizes = np.fromiter((len(x) + pad for x in texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    n = int(sizes.sum())
    number = np.full(n, -1, np.int64)
    for x, at in zip(texts, starts.tolist()):
        number[at : at + len(x)] = [words[w] for w in x]
    word = number >= 0
    stream = np.where(word, np.array(words.hashes or [0], np.uint64)[number], np.uint64(0))
    rare = np.where(word, np.array(words.rare or [0], np.int64)[number], 0)
    grams = rolling(stream, SHINGLE)
    m = len(grams)
    before = np.concatenate([[0], np.cumsum(word)])
    whole = (before[SHINGLE:] - before[:-SHINGLE])[:m] == SHINGLE
    common = sum(rare[k : k + m] for k in range(SHINGLE))
    free = np.iinfo(np.uint64).max
    order = np.where(whole, (np.minimum(common, 4095).astype(np.uint64) << np.uint64(52)) | (grams >> np.uint64(12)), free)
    width = np.fromiter((window_of(len(x)) for x in texts), np.int64, len(texts))
    chosen = np.zeros(m, bool)
    for window in np.unique(width).tolist():
        if window == 1:
            picked = np.flatnonzero(whole)
        else:
            windows = np.lib.stride_tricks.sliding_window_view(order, window)  # the padding makes every stream longer than a window
            best = windows.argmin(axis=1) + np.arange(len(windows))
            picked = best[order[best] != free]
        chosen[picked[width[np.searchsorted(starts, picked, side="right") - 1] == window]] = True
    picked = np.flatnonzero(chosen)
    owner = np.searchsorted(starts, picked, side="right") - 1
    bounds = np.searchsorted(owner, np.arange(len(texts) + 1))
    signed = grams[picked].view(np.int64)
    maps = np.zeros(len(texts) * LANES, np.uint64)
    own = np.repeat(np.arange(len(texts)), sizes)[word]
    same = own * (len(words) + 1) + number[word]
    by_word = np.argsort(same, kind="stable")
    first = np.flatnonzero(np.diff(same[by_word], prepend=-1))
    times = np.empty(len(same), np.uint64)
    times[by_word] = np.arange(len(same)) - np.repeat(first, np.diff(first, append=len(same)))
    hashes = stream[word] + times * np.uint64(0x9E3779B97F4A7C15)
    np.bitwise_or.at(maps, own * LANES + (hashes >> np.uint64(6)).astype(np.int64) % LANES, np.uint64(1) << (hashes & np.uint64(63)))
    return [signed[bounds[k] : bounds[k + 1]].tolist() for k in range(len(texts))], maps.reshape(-1, LANES).view(np.int64)


def has_rare_words(n_words: int) -> bool:
    """True for a text that may reach SHARE with a text of at most SHORT words."""
    return n_words * SHARE <= SHORT + 1e-9


def rare_words(text: list[str], words: Words) -> list[int]:
    """Hashes of a text's rarest words, in one order for all texts: of two texts with SHARE of the longer's words in common, each has one of these
    in common with the other.  A word's further occurrences are words of their own."""
    times: dict[str, int] = defaultdict(int)
    keys = []
    for w in text:
        times[w] += 1
        k = words[w]
        keys.append((words.rare[k], xxhash.xxh64_intdigest(f"{w} {times[w]}".encode("utf-8", "surrogatepass"), seed=1) - (1 << 63)))
    return [h for _, h in sorted(keys)[: len(text) - math.ceil(SHARE * len(text) - 1e-9) + 1]]


def abstract_hash(words: list[str]) -> int | None:
    return xxhash.xxh64_intdigest(" ".join(words)) - (1 << 63) if words else None


def featured(pdf_entries: DataFrame) -> DataFrame:
    """One pass over the PDFs, to be stored so that row numbers stay: row_no, document_id, source, sha256, discovered_at, path, abstract_hash, and the abstract's seeds as keys
    and the lanes of its map of words."""
    weights = word_weights(pdf_entries.select(F.col("metadata.abstract").alias("abstract")), "abstract")
    known = pdf_entries.sparkSession.sparkContext.broadcast(weights)  # bounded, see word_weights

    def features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = Words(known.value)
        for whole in batches:
            for start in range(0, len(whole), 1000):  # small steps keep the arrays of a step small
                if len(words) > 1_000_000:
                    words = Words(known.value)
                pdf = whole.iloc[start : start + 1000]
                texts = [abstract_words(x) if x else [] for x in pdf["abstract"]]
                keys, maps = winnow(texts, words)
                keys = [k + rare_words(w, words) if has_rare_words(len(w)) else k for k, w in zip(keys, texts)]
                owner, flat = thinned(np.repeat(np.arange(len(keys)), [len(k) for k in keys]), np.fromiter(chain.from_iterable(keys), np.int64))
                keys = np.split(flat, np.searchsorted(owner, np.arange(1, len(keys))))
                out = pdf[["document_id", "source", "sha256", "discovered_at"]].copy()
                out["path"] = [None if s is None or p is None else canonical_path(f"{s.strip()}/{p}") for s, p in zip(pdf["raw_source"], pdf["original_relative_path"])]
                out["abstract_hash"] = pd.array([abstract_hash(w) for w in texts], dtype="Int64")
                out["words"], out["keys"] = [len(w) for w in texts], keys
                for k in range(LANES):
                    out[f"lane_{k}"] = maps[:, k]
                yield out

    rows = pdf_entries.filter("document_id is not null").select("document_id", F.initcap(F.trim(F.lower("source"))).alias("source"), F.col("source").alias("raw_source"), "original_relative_path", "sha256", F.col("metadata.abstract").alias("abstract"), "discovered_at")
    return at_least(rows).mapInPandas(features, "document_id string, source string, sha256 string, discovered_at timestamp, path string, abstract_hash long, words int, keys array<long>, " + ", ".join(f"lane_{k} long" for k in range(LANES))).withColumn("row_no", F.monotonically_increasing_id())


def resolved(split_index: DataFrame, features: DataFrame) -> DataFrame:
    """(entry_id, split, document_id, source, sha256, abstract_hash, row_no, words) of entries that name a document."""

    @F.pandas_udf("array<string>")
    def path_keys(path: pd.Series) -> pd.Series:
        return path.map(possible_paths)

    fields = ["source", "sha256", "abstract_hash", "row_no", "words"]
    documents = features.groupBy("document_id").agg(F.max_by(F.struct(*fields), F.struct("discovered_at", "sha256", "abstract_hash", "row_no")).alias("d"), F.collect_set("path").alias("paths"))
    by_path = documents.select("document_id", "d.*", F.explode("paths").alias("path"))
    tries = split_index.filter("entry_id is not null and entry is not null and split in ('train', 'test')").select("entry_id", "split", F.posexplode(path_keys("entry")).alias("try", "path"))
    named = tries.join(by_path, "path").drop("path")
    # An entry names the documents of its longest path that names any; nearly always there is one row, and nothing to rank.
    best = named.groupBy("entry_id", "split", "document_id").agg(F.min(F.struct("try", *fields)).alias("m")).select("entry_id", "split", "document_id", "m.*")
    least = best.groupBy("entry_id").agg(F.min("try").alias("least"))
    return best.join(least, "entry_id").filter("try = least").drop("try", "least")


def thinned(owner: np.ndarray, keys: np.ndarray, *_: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, key), each once, in this order.  No gram is given up, whatever its count: anything else given changes nothing."""
    order = np.lexsort((keys, owner))
    owner, keys = owner[order], keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], keys[new]


def seeds_of(nodes: DataFrame, features: DataFrame) -> DataFrame:
    """(key, abstract_hash, side) of all selected grams of every abstract in use; side = train * 2 + test."""
    rows = features.select("row_no", "abstract_hash", "keys").join(small(nodes.select("row_no", "train", "test")), "row_no")
    return rows.select(F.explode("keys").alias("key"), "abstract_hash", (F.col("train") * 2 + F.col("test")).cast("byte").alias("side"))


class Side:
    """Abstracts of one side of a block, in the order of their words: hashes, numbers of words, lanes, the words that an alignment of the wanted share
    must keep of them, and the bits of the map less the words."""

    def __init__(self, hashes: np.ndarray, words: np.ndarray, lanes: np.ndarray):
        order = np.argsort(words, kind="stable")
        self.hashes, self.words, self.lanes = hashes[order], words[order].astype(np.int32), np.ascontiguousarray(lanes[:, order])
        self.least = np.ceil(SHARE * self.words - 1e-6).astype(np.int32)
        self.bits = np.bitwise_count(self.lanes).sum(axis=0, dtype=np.int32) - self.words


def fitting_pairs(a: Side, b: Side) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the pairs that pass ``fitting`` of ``near_abstracts`` by these lanes, which all pairs are put to unless their lengths rule them out."""
    step = max(1, STEP // max(1, len(a.words)))
    for k in range(0, len(b.words), step):
        to = min(k + step, len(b.words))
        lo, hi = np.searchsorted(a.words, b.least[k]), np.searchsorted(a.least, b.words[to - 1], side="right")
        if lo < hi:
            both = np.zeros((to - k, hi - lo), np.int32)
            for x, y in zip(a.lanes[:, lo:hi], b.lanes[:, k:to]):
                both += np.bitwise_count(x & y[:, None])
            fit = both >= np.maximum(a.bits[lo:hi], b.bits[k:to, None]) + np.maximum(a.least[lo:hi], b.least[k:to, None])
            j, i = np.nonzero(fit)
            i, j = i + lo, j + k
            fit = (np.minimum(a.words[i], b.words[j]) >= np.maximum(a.least[i], b.least[j])) & (a.hashes[i] != b.hashes[j])
            if fit.any():
                yield a.hashes[i[fit]], b.hashes[j[fit]]


def blocks_met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of rows (key, block, test, abstract_hash, words, lanes) in this order: the train rows of a block, about BLOCK, are kept, and its test rows
    meet them as they come."""
    def as_batch(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["a", "b"])

    at, kept, train, found, total = None, [], None, [], 0
    for batch in batches:
        if not len(batch):
            continue
        key, block, test, hashes, words, *lanes = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        lanes = np.stack(lanes).view(np.uint64)
        ends = [*(np.flatnonzero((key[1:] != key[:-1]) | (block[1:] != block[:-1])) + 1).tolist(), len(key)]
        for start, end in zip([0, *ends], ends):
            if at != (key[start], block[start]):
                at, kept, train = (key[start], block[start]), [], None
            half = start + int(np.searchsorted(test[start:end], 1))
            if half > start:
                kept.append((hashes[start:half], words[start:half], lanes[:, start:half]))
            if half < end and kept:
                if train is None:
                    train = Side(*(np.concatenate(x, axis=-1) for x in zip(*kept)))
                for pairs in fitting_pairs(train, Side(hashes[half:end], words[half:end], lanes[:, half:end])):
                    found.append(pairs)
                    total += len(pairs[0])
                    if total > STEP:
                        yield as_batch(found)
                        found, total = [], 0
    if total:
        yield as_batch(found)


def near_abstracts(nodes: DataFrame, features: DataFrame, pdf_entries: DataFrame) -> DataFrame:
    """(a, b, share): hashes of a train and a test abstract that nearly agree.  ``nodes`` holds one row for each distinct abstract:
    abstract_hash, train, test, words, document_id (any that has it), row_no (of ``features``, one that has it)."""
    # One shuffle by key serves both the count and the filter: the count uses every column, so that both plans read the same exchange.
    seeds = seeds_of(nodes, features).repartition("key")
    n_train, n_test = F.sum(F.expr("(side >> 1) & 1")), F.sum(F.expr("side & 1"))
    load = seeds.groupBy("key").agg(n_train.alias("n_train"), n_test.alias("n_test"), F.max("abstract_hash").alias("any")).filter("any is not null and n_train > 0 and n_test > 0")
    shared = store(seeds.join(load.select("key", F.expr(f"if(n_train * n_test > {HOT}, int(ceil(n_train / {BLOCK})), 0)").alias("blocks")), "key"))

    lanes, half = [f"lane_{k}" for k in range(LANES)], LANES // 2
    maps = features.select("row_no", *lanes).join(small(nodes.select("row_no", "abstract_hash", "words")), "row_no").drop("row_no")
    maps = small(cut(maps))

    # What an alignment of the wanted share implies, and hence no loss: lengths that differ by a fifth at most, and no more words on one
    # side only than the alignment may leave out there.
    def fitting(lanes: list[str]) -> str:
        alone = lambda x, y: " + ".join(f"bit_count({c}_{x} & ~{c}_{y})" for c in lanes)
        least = f"({SHARE}D * greatest(words_a, words_b) - 1e-6D)"
        return f"a <> b and least(words_a, words_b) >= {least} and {alone('a', 'b')} <= words_a - {least} and {alone('b', 'a')} <= words_b - {least}"

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.withColumnsRenamed({"abstract_hash": x} | {c: f"{c}_{x}" for c in ("words", *lanes)})

    # The map goes with the grams, its halves on each other; pairs that it leaves are put to the whole map.
    folded = [F.col(lanes[k]).bitwiseOR(F.col(lanes[k + half])).alias(lanes[k]) for k in range(half)]
    mapped = shared.join(maps, "abstract_hash").select("key", "blocks", "side", "abstract_hash", "words", *folded)
    train, test = (mapped.filter(f"side & {bit} > 0").drop("side") for bit in (2, 1))
    few = side(train.filter("blocks = 0").drop("blocks"), "a").join(side(test.filter("blocks = 0").drop("blocks"), "b"), "key").filter(fitting(lanes[:half])).select("a", "b")
    # A widespread gram's train abstracts are dealt into blocks, each of which meets all its test abstracts.
    dealt = train.filter("blocks > 0").withColumns({"block": F.expr("int(pmod(xxhash64(abstract_hash), blocks))"), "test": F.lit(0)})
    met = test.filter("blocks > 0").withColumns({"block": F.explode(F.expr("sequence(0, blocks - 1)")), "test": F.lit(1)})
    rows = dealt.union(met).select("key", "block", "test", "abstract_hash", "words", *lanes[:half])
    many = rows.repartition("key", "block").sortWithinPartitions("key", "block", "test").mapInArrow(blocks_met, "a long, b long")
    pairs = cut(few.union(many).distinct().join(side(maps, "a"), "a").join(side(maps, "b"), "b").filter(fitting(lanes)).select("a", "b"))
    used = pairs.select(F.col("a").alias("abstract_hash")).union(pairs.select(F.col("b").alias("abstract_hash"))).distinct()
    wanted = cut(used.join(nodes.select("abstract_hash", "document_id"), "abstract_hash"))
    texts = pdf_entries.select("document_id", "discovered_at", F.col("metadata.abstract").alias("abstract"), "sha256").join(small(wanted), "document_id").groupBy("abstract_hash").agg(F.max_by("abstract", F.struct("discovered_at", "sha256", "abstract")).alias("abstract"))

    @F.pandas_udf("double")
    def aligned(a: pd.Series, b: pd.Series) -> pd.Series:
        words = {x: abstract_words(x or "") for x in {*a, *b}}  # an abstract of many pairs is read once
        return pd.Series([share_of_pair(words[x], words[y]) for x, y in zip(a, b)])

    both = pairs.join(texts.select(F.col("abstract_hash").alias("a"), F.col("abstract").alias("text_a")), "a").join(texts.select(F.col("abstract_hash").alias("b"), F.col("abstract").alias("text_b")), "b")
    return both.select("a", "b", aligned("text_a", "text_b").alias("share")).filter(F.col("share") >= SHARE)


def linked_classes(split_index: DataFrame, pdf_entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places, near): the entries with their document, bytes and abstract, see ``resolved``, and the near pairs of distinct abstracts."""
    features = store(featured(pdf_entries))
    places = cut(resolved(split_index, features))
    nodes = places.filter("abstract_hash is not null").groupBy("abstract_hash").agg(
        F.max(F.expr("int(split = 'train')")).alias("train"), F.max(F.expr("int(split = 'test')")).alias("test"), F.min("document_id").alias("document_id"), F.min("row_no").alias("row_no"), F.max("words").alias("words")
    )
    return places, near_abstracts(cut(nodes), features, pdf_entries)


def overlaps(split_index: DataFrame, pdf_entries: DataFrame) -> DataFrame:
    """(entry_id_a, entry_id_b, kind, coverage, source_a, split_a, source_b, split_b): each pair of a train and a test entry, least id first,
    by its closest kind: file, bytes, abstract.

    Entries that are null, of another split, or without a document form no pair.  A null sha256 or abstract links nothing; equal
    abstracts have a coverage of 1; repeated rows of a document count once, its last by discovered_at; empty tables give an empty result;
    other columns are ignored.  Entries of one document, equal bytes or equal abstracts are joined on that key, once for each kind;
    abstracts are compared as distinct texts, and their entries joined afterwards."""
    places, near = linked_classes(split_index, pdf_entries)
    slim = places.select("entry_id", "split", "source", "document_id", "sha256", "abstract_hash")
    train, test = (slim.filter(F.col("split") == s).select(*(F.col(c).alias(f"{c}_{s}") for c in slim.columns)) for s in ("train", "test"))

    def linked(column: str, rank: int) -> DataFrame:
        return train.join(test, F.col(f"{column}_train") == F.col(f"{column}_test")).withColumns({"rank": F.lit(rank), "share": F.lit(1.0)})

    by_text = near.join(train, F.col("a") == F.col("abstract_hash_train")).join(test, F.col("b") == F.col("abstract_hash_test")).withColumn("rank", F.lit(2)).drop("a", "b")
    every = linked("document_id", 0).unionByName(linked("sha256", 1)).unionByName(linked("abstract_hash", 2)).unionByName(by_text)
    best = every.groupBy("entry_id_train", "entry_id_test").agg(F.min_by(F.struct("rank", "share", "source_train", "source_test"), F.struct("rank", -F.col("share"))).alias("x"))
    first = F.col("entry_id_train") < F.col("entry_id_test")
    pick = lambda yes, no: F.when(first, yes).otherwise(no)
    return best.select(
        F.least("entry_id_train", "entry_id_test").alias("entry_id_a"),
        F.greatest("entry_id_train", "entry_id_test").alias("entry_id_b"),
        F.element_at(F.array(F.lit("file"), F.lit("bytes"), F.lit("abstract")), F.col("x.rank") + 1).alias("kind"),
        F.col("x.share").alias("coverage"),
        pick(F.col("x.source_train"), F.col("x.source_test")).alias("source_a"),
        pick(F.lit("train"), F.lit("test")).alias("split_a"),
        pick(F.col("x.source_test"), F.col("x.source_train")).alias("source_b"),
        pick(F.lit("test"), F.lit("train")).alias("split_b"),
    )


def report(split_index: DataFrame, pdf_entries: DataFrame) -> DataFrame:
    """Overlapping records of each split and source: how many in all and by kind of link, their pairs by kind, and their mean coverage.

    Pairs are counted by classes (entries of one document, of equal bytes, of equal or near abstracts) and never listed, so a class of any size
    costs its entries only.  A record or pair with links of several kinds counts under each."""
    places, near = linked_classes(split_index, pdf_entries)
    near = cut(near)

    def members(column: str) -> DataFrame:
        return places.filter(F.col(column).isNotNull()).select("entry_id", "split", "source", F.col(column).alias("class")).distinct()

    def sizes(column: str) -> DataFrame:
        count = lambda split: F.sum(F.expr(f"int(split = '{split}')"))
        return members(column).groupBy("class").agg(count("train").alias("train"), count("test").alias("test"))

    def by_class(column: str, kind: str) -> DataFrame:
        both = sizes(column).filter("train > 0 and test > 0")
        return members(column).join(both, "class").select("entry_id", "split", "source", F.lit(kind).alias("kind"), F.expr("if(split = 'train', test, train)").alias("pairs"), F.lit(1.0).alias("coverage"))

    def by_text(own: str, other: str, split: str, partner: str) -> DataFrame:
        n = sizes("abstract_hash").select(F.col("class").alias(other), F.col(partner).alias("n"))
        sums = near.join(n, other).groupBy(own).agg(F.sum("n").alias("pairs"), F.max("share").alias("coverage")).withColumnRenamed(own, "class")
        return members("abstract_hash").filter(F.col("split") == split).join(sums, "class").select("entry_id", "split", "source", F.lit("abstract").alias("kind"), "pairs", "coverage")

    links = by_class("document_id", "file").unionByName(by_class("sha256", "bytes")).unionByName(by_class("abstract_hash", "abstract"))
    links = links.unionByName(by_text("a", "b", "train", "test")).unionByName(by_text("b", "a", "test", "train"))
    kinds = ("file", "bytes", "abstract")
    record = links.groupBy("split", "source", "entry_id").agg(F.max("coverage").alias("coverage"), *(F.sum(F.expr(f"if(kind = '{k}', pairs, 0)")).alias(k) for k in kinds))
    return record.groupBy("split", "source").agg(
        F.count("*").alias("n_records"), *(F.sum((F.col(k) > 0).cast("long")).alias(f"n_{k}") for k in kinds), *(F.sum(k).alias(f"pairs_{k}") for k in kinds), F.round(F.avg("coverage"), 4).alias("mean_coverage")
    )


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "split_index", ["entry_id", "split", "entry"]), table(spark, sf_dir, "pdf_entries", ["document_id", "source", "original_relative_path", "sha256", "metadata", "discovered_at"])


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(*_tables(spark, sf_dir)).select("entry_id_a", "entry_id_b")


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(*_tables(spark, sf_dir))
