"""Five-word shingles and one-permutation min-hash of the beginnings of texts, vectorised over a batch of texts.

A text that was cut off is the beginning of its full copy, so min-hashes are taken of beginnings: of the first LEVELS[0] words, of four times as many,
and so on.  A cut text meets its copy at the longest beginning that it still has, however much of it is lost."""

from __future__ import annotations

import re

import numpy as np
import xxhash

SHINGLE = 5
#: Bands of rows: beginnings of Jaccard 0.8 share a band with probability 1 - (1 - 0.8^2)^4 > 0.98, equal ones for certain.
BANDS, ROWS = 4, 2
_BINS = BANDS * ROWS
#: 64-bit lanes of the map of a text's shingles.
LANES = 4
#: Words of the beginnings that are hashed.
LEVELS = tuple(8 * 4**k for k in range(12))
_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WORD = re.compile(r"\w+")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _M1
    x = (x ^ (x >> np.uint64(29))) * _M2
    return x ^ (x >> np.uint64(32))


class WordHash(dict):
    """word -> 64-bit hash, computed once a process; emptied past a million words."""

    def __missing__(self, word: str) -> int:
        if len(self) > 1_000_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


_HASH = WordHash()


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def rolling(stream: np.ndarray, size: int) -> np.ndarray:
    """Polynomial hash of every ``size`` consecutive words of a stream."""
    n = max(0, len(stream) - size + 1)
    acc = np.zeros(n, np.uint64)
    for k in range(size):
        acc = acc * _M1 + stream[k : k + n]
    return mix(acc)


def signatures(texts: list[str | None]) -> tuple[list[int], list[int], list[np.ndarray | None], np.ndarray]:
    """Word counts, whole-text hashes, band hashes and maps of shingles of a batch.

    The band hashes have a row for each level a text reaches (None under LEVELS[0] words).  One-permutation min-hash: a shingle falls into one of
    BANDS * ROWS bins, each bin keeps the least hash of the beginning, an empty bin borrows the next filled one's; a band is the hash of ROWS
    bins and of the level.  In the map each shingle sets one of LANES * 64 bits, so of two maps no more bits than shingles are set in one only."""
    words = [words_of(x) if x else [] for x in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    whole = [xxhash.xxh64_intdigest((x or "").encode("utf-8", "surrogatepass")) - (1 << 63) for x in texts]
    bands: list[np.ndarray | None] = [None] * len(texts)
    maps = np.zeros((len(texts), LANES), np.uint64)
    many = np.flatnonzero(counts >= LEVELS[0])
    if len(many):
        n = counts[many]
        hashes = rolling(np.fromiter((_HASH[w] for i in many for w in words[i]), np.uint64, int(n.sum())), SHINGLE)
        owner = np.repeat(np.arange(len(many)), n)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n))[: len(hashes)]
        inside = owner[: len(hashes)] == owner[SHINGLE - 1 :]
        hashes, owner, place = hashes[inside], owner[: len(hashes)][inside], place[inside]
        np.bitwise_or.at(maps, (many[owner], ((hashes >> np.uint64(38)) % np.uint64(LANES)).astype(np.int64)), np.uint64(1) << (hashes >> np.uint64(32) & np.uint64(63)))
        bounds = np.array(LEVELS)
        levels = np.searchsorted(bounds, n, side="right")  # how many levels each text reaches
        first = np.cumsum(levels) - levels
        level = np.searchsorted(bounds - SHINGLE + 1, place, side="right")  # at which level a shingle comes in
        used = level < levels[owner]
        free = np.iinfo(np.uint64).max
        bins = np.full((int(levels.sum()), _BINS), free, np.uint64)
        np.minimum.at(bins.reshape(-1), (first[owner] + level)[used] * _BINS + (hashes[used] % np.uint64(_BINS)).astype(np.int64), hashes[used] // np.uint64(_BINS))
        for k in range(1, int(levels.max())):  # a beginning holds the shorter ones
            at = first[levels > k] + k
            bins[at] = np.minimum(bins[at], bins[at - 1])
        empty = bins == free
        for _ in range(_BINS):  # an empty bin takes over its right neighbour's value, changed
            if not empty.any():
                break
            right = np.roll(bins, -1, axis=1)
            bins = np.where(empty & (right != free), right ^ _M2, bins)
            empty = bins == free
        of = (np.arange(len(bins)) - np.repeat(first, levels)).astype(np.uint64)
        acc = np.arange(BANDS, dtype=np.uint64)[None, :] + of[:, None] * np.uint64(BANDS)
        for k in range(ROWS):
            acc = mix(acc * _M1 + bins[:, k::ROWS])
        short = (acc >> np.uint64(32)).astype(np.uint32).view(np.int32)  # a chance collision is but one candidate more
        for i, at, size in zip(many.tolist(), first.tolist(), levels.tolist()):
            bands[i] = short[at : at + size]
    return counts.tolist(), whole, bands, maps.view(np.int64)


def own_level(n_words: int) -> int:
    """The level at which a text of so many words, its last perhaps in pieces, looks for its copy; -1 if it is too short."""
    return int(np.searchsorted(np.array(LEVELS), n_words - 1, side="right")) - 1


def containment(a: str, b: str) -> float:
    """Share of the five-word shingles of ``a``, but for those of its last word, that ``b`` has."""

    def sets(w: list[str]) -> set:
        return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))}

    x = sets(words_of(a)[:-1])
    return len(x & sets(words_of(b))) / len(x)
