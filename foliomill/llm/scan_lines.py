"""Line by line reading of scanned pages: furniture, broken words and misread words of one sample."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np

#: Marks that break a word at a line's end; the first may also be a compound's own hyphen.
BREAKS = "-‐¬\xad"
#: Marks that scanners leave inside words.
STRAYS = "~^·¦†|•°*`´¨_¸˙′"
#: What is read for what (scanned form, true forms).
GLYPHS = {
    "0": ("o",), "1": ("l", "i"), "5": ("s",), "6": ("b", "é", "ó", "g"), "8": ("b", "s"), "9": ("g", "q"), "3": ("e",), "!": ("i", "l"), "|": ("l", "i"), "¦": ("l", "i"), "@": ("a",), "†": ("t",), "$": ("s",), "€": ("e",), "£": ("e",), "ſ": ("f", "s"), "¢": ("c",),
    "í": ("i",), "ì": ("i",), "î": ("i",), "ï": ("i",), "ı": ("i",), "é": ("e",), "è": ("e",), "ê": ("e",), "ë": ("e",), "á": ("a",), "à": ("a",), "â": ("a",), "ó": ("o",), "ò": ("o",), "ô": ("o",), "ú": ("u",), "ù": ("u",), "û": ("u",), "ñ": ("n",), "ç": ("c",),
    "c": ("e", "o"), "e": ("c",), "o": ("c", "a"), "a": ("o",), "i": ("l", "t", "j"), "l": ("i", "t"), "t": ("f", "l"), "f": ("t",), "b": ("h",), "h": ("b",), "n": ("u", "r"), "u": ("n", "ü"), "v": ("y",), "y": ("v",), "m": ("rn", "in", "nn"), "d": ("cl",), "w": ("vv",), "g": ("q",), "q": ("g",), "s": ("5",),
    "rn": ("m",), "cl": ("d",), "vv": ("w",), "ii": ("u", "ü", "n"), "li": ("h",), "ri": ("n",), "nn": ("m",), "in": ("m",), "tt": ("u",), "fi": ("ﬁ",), "ss": ("ß",),
}
#: Letters read for digits in page numbers.
_DIGITS = str.maketrans("lIiOoSsBZzgq|!", "11100558229911")
_EDGE = ".,;:()[]{}\"“”‘’'«»<>?…*#/"
_NUMBER_LINE = re.compile(r"[-–]?\d+(?:[.,]\d+)*\s?%?$")
_PAGE = re.compile(r"(?:[\s\-–—_~*·•|=<>\[({./]*)(?:(?:page|pag|pág|página|seite|blatt|folio|fol|p|s|pp|n[°o])\b\.?\s*)?(?P<n>[\dlIOoSBZ|!]{1,5}|\d(?:\s\d){1,3}|[ivxlc]{1,9}|[IVXLC]{1,9})(?:\s*(?:/|of|von|de|sur|aus)\s*[\dlIO]{1,5})?(?:[\s\-–—_~*·•|=<>\])}]*)$", re.I)
_ROMAN = re.compile(r"(?:c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})$", re.I)
_LIST = re.compile(r"\s*(?:[-*•–+]|\(?\d{1,3}[.)]|\(?[a-z][.)])\s+\S")
_HEAD_NUMBER = re.compile(r"^(?P<left>\W{0,2}[\dlOIS]{1,5}\W{0,2}?(?:\s{2,}|\s+[|·•—–]\s+))?(?P<core>.*?)(?P<right>(?:\s{2,}|\s+[|·•—–]\s+)\W{0,2}[\dlOIS]{1,5}\W{0,2})?$")
_SENTENCE_END = re.compile(r"[.!?:;][\"'”’»)\]]*$")
_JOURNAL = re.compile(r",\s*\S{3}[.,]?\s*[\dlOIS]{1,4}\s*\([\dlOIS]{4}\)")
_SIDES = re.compile(r"^\W*[\dlOIS]{1,5}\s{2,}|\s{2,}[\dlOIS]{1,5}\W*$")
_LETTERS3 = re.compile(r"[^\W\d_]{3}")
_ET_AL = re.compile(r"(?i)\bet al\.$")
_NO_WORD = re.compile(r"[^\w ]")
_BLANKS = re.compile(r"\s+")
_SECOND = re.compile(r"\d{1,3}\. ")
_STOP = re.compile(r"[.!?:][\"'”’»)\]]*$")
#: Look-alikes evened out in heads.
_EVEN = str.maketrans("@†|!ſ$€013589íìéèóú", "atlifseolesbgiieeou")


def core(token: str) -> str:
    return token.strip(_EDGE).lower()


def vocabulary_tokens(markdown: str) -> list[str]:
    """Words of a text, without the pieces of words broken at line ends."""
    out: list[str] = []
    broken = False
    for line in markdown.split("\n"):
        words = line.split()
        if not words:
            continue
        if broken:
            words = words[1:]
        broken = bool(words) and words[-1][-1] in BREAKS and len(words[-1]) > 1
        out += words[:-1] if broken else words
    return out


class Tokens(dict):
    """token -> (core, whether it may be a misreading), computed once a word form."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model

    def __missing__(self, token: str) -> tuple[str, bool]:
        if len(self) > 500_000:
            self.clear()
        w, model = core(token), self.model
        n = model.counts.get(w, 0)
        doubtful = bool(w) and (n * 5_000 < model.total or not w.isalpha())
        # A word that no edit turns into another stands, and so does its compound if it is known.
        doubtful = doubtful and bool("-" in w and not n or model.edits(w) or model.edits(w, two=True))
        out = self[token] = (w, doubtful)
        return out


#: A word is a misreading of another if the log-odds for it by context, and COUNTS times those by counts, reach so much: for a word with marks
#: that no word has, for any other word, and for a word of three letters or fewer.  Counts say little more once they differ much, so context has the say.
COUNTS, ODD, PLAIN, SHORT = 0.4, 0.7, 1.5, 2.0


class Model:
    """Corpus word counts, skip-gram vectors, and head lines known from the corpus."""

    def __init__(self, counts: dict[str, int], total: int, ids: dict[str, int], inner: np.ndarray, outer: np.ndarray, heads: frozenset[str]):
        self.counts, self.total, self.ids, self.outer, self.heads = counts, total, ids, outer, heads
        weights = np.array([counts[w] for w in sorted(ids, key=ids.__getitem__)], float) ** 0.75
        # Vectors are taken against the mean word, so that 0 is the fit of any word, and scaled by the spread of fits, so that the context has the same
        # say however long they were trained.
        self.inner = inner
        if len(weights):
            weights /= weights.sum()
            self.inner = inner - weights @ inner
            spread = math.sqrt(np.trace((outer.T * weights) @ outer @ (self.inner.T * weights) @ self.inner))
            self.inner = self.inner / max(spread, 1e-9)
        self.near: dict[str, frozenset[str]] = {}
        self.far: dict[str, frozenset[str]] = {}
        self.tokens = Tokens(self)

    def edits(self, word: str, two: bool = False) -> frozenset[str]:
        """Words of the vocabulary that ``word`` may be a misreading of: one glyph edit away or with stray marks dropped; with ``two``, two edits away."""
        memory = self.far if two else self.near
        if word in memory:
            return memory[word]
        first = self.step(word)
        bare = "".join(c for c in word if c not in STRAYS)
        first.add(bare)
        reached = first if not two else {x for w in first for x in self.step(w)} if len(word) > 4 else set()
        if len(memory) > 500_000:
            memory.clear()
        out = memory[word] = frozenset(w for w in reached if w in self.counts and w != word)
        return out

    @staticmethod
    def step(word: str) -> set[str]:
        out = set()
        for i in range(len(word)):
            if word[i] in STRAYS:
                out.add(word[:i] + word[i + 1 :])
            for size in (1, 2):
                for true in GLYPHS.get(word[i : i + size], ()) if i + size <= len(word) else ():
                    out.add(word[:i] + true + word[i + size :])
        return out

    def around(self, context: list[str]) -> np.ndarray | None:
        """The vector that a context gives the word in it: the mean of its words' outer vectors; None if it has none."""
        known = [self.ids[c] for c in context if c in self.ids]
        return np.add.reduce(self.outer[known]) / len(known) if known else None

    def fit(self, word: str, around: np.ndarray | None) -> float:
        """How much better ``word`` fits a context than any word does, in spreads of the fits; 0 where it is unknown."""
        k = self.ids.get(word)
        return 0.0 if k is None or around is None else float(around @ self.inner[k])

    def correction(self, word: str, context: list[str]) -> str | None:
        """The word that ``word`` is a misreading of; None if it stands.

        A rare word's vector is the one its context gives it.  It links to the neighbours that plausible glyph edits reach: what the context
        says for a neighbour against the word itself, and their counts, decide; the best one counts if that is enough.  Words two edits away are tried if
        none nearer is."""
        letters = sum(map(str.isalpha, word))
        if letters < 1 or len(word) < 2 or (letters == len(word) and len(word) < 3):
            return None
        odd = letters < len(word) and not re.fullmatch(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*", word)
        least = ODD if odd else PLAIN if len(word) > 3 else SHORT
        around = None
        for two in (False, True):
            candidates = self.edits(word, two)
            if not odd:
                candidates = [w for w in candidates if len(w) > 2]
            if not candidates:
                continue
            if around is None:
                around = self.around(context)
                base = COUNTS * math.log(max(self.counts.get(word, 0), 1)) + self.fit(word, around)
            odds, best = max((COUNTS * math.log(self.counts[w]) + self.fit(w, around) - base, w) for w in candidates)
            if odds >= least:
                return best
        return None


def listed(line: str) -> bool:
    """True for an item of a list.  A line that begins with a letter is one only if a mark follows it."""
    return not (line[:1].isalpha() and line[1:2] not in (".", ")")) and bool(_LIST.match(line))


def page_number(s: str) -> int | None:
    """The number of a line that holds only a page number, in whatever dress; -1 for roman numerals; None for other lines."""
    if len(s) > 24 or s.endswith((".", ",", ";", ":")) or re.search(r"\d[.,]\d", s) or "%" in s:
        return None
    m = _PAGE.match(s)
    if not m:
        return None
    n = m["n"].replace(" ", "")
    if re.fullmatch(r"[ivxlc]+", n, re.I) and not re.fullmatch(r"[lIi]+", n):
        return -1 if _ROMAN.match(n) and (n.islower() or n.isupper()) else None
    if not any(c.isdigit() for c in n) and not (len(n) > 1 and set(n) <= set("lIO")):
        return -1 if re.fullmatch(r"[ivx]+", n) and _ROMAN.match(n) else None
    if s.count("(") != s.count(")") or s.count("[") != s.count("]"):
        return None
    d = n.translate(_DIGITS)
    return int(d) if d.isdigit() else None


def head_core(s: str) -> tuple[str, bool]:
    """A line without a page number set apart at its side, with misreadings evened out; whether a number stood there."""
    m = _HEAD_NUMBER.match(s) if "  " in s or "|" in s or "·" in s or "•" in s or "—" in s or "–" in s else None
    text = (m["core"] if m else s).strip()
    side = bool(m and (m["left"] or m["right"]))
    even = _NO_WORD.sub("", text.lower().translate(_EVEN))
    even = even.replace("rn", "m").replace("cl", "d").replace("ii", "u").replace("vv", "w").replace("c", "e").replace("b", "h")
    return _BLANKS.sub(" ", even).strip(), side


def furniture(lines: list[str], heads: frozenset[str] = frozenset()) -> dict[int, str]:
    """Index -> running_header or page_number for the furniture lines of a sample."""
    stripped = [x.strip() for x in lines]
    body = [x for x in stripped if x and not x.startswith(("#", "|"))]
    width = max((len(x) for x in body if not listed(x)), default=0)
    out: dict[int, str] = {}
    cores: dict[int, tuple[str, bool]] = {}

    def block(i: int) -> int:
        """Number lines in the unbroken run around line i."""
        a = b = i
        while a > 0 and _NUMBER_LINE.match(stripped[a - 1]):
            a -= 1
        while b + 1 < len(lines) and _NUMBER_LINE.match(stripped[b + 1]):
            b += 1
        return b - a + 1

    for i, s in enumerate(stripped):
        if not s or s.startswith(("#", "|")):
            continue
        n = page_number(s)
        if n is not None:
            if _NUMBER_LINE.match(s) and block(i) > 1:
                continue
            out[i] = "page_number"
            continue
        if len(s) > 90 or s.startswith(("$", "**", ">", "`")) or "a" <= s[0] <= "z" and s[0] != "l" and "  " not in s or listed(s):
            continue  # a head begins with a capital, or what is read for one, or with a number set apart
        cores[i] = head_core(s)
    times = Counter(c for c, _ in cores.values())

    def previous(i: int) -> str:
        j = i - 1
        while j >= 0 and (not stripped[j] or j in out):
            j -= 1
        return stripped[j] if j >= 0 else ""

    def following(i: int) -> str:
        j = i + 1
        while j < len(lines) and (not stripped[j] or j in out):
            j += 1
        return stripped[j] if j < len(lines) else ""

    for i, (c, side) in cores.items():
        s = stripped[i]
        if not c or not _LETTERS3.search(s):
            continue
        text = _SIDES.sub("", s).strip() if "  " in s else s
        first = text[:1]
        journal = "(" in text and bool(_JOURNAL.search(text))
        if journal or side and (first.isupper() or not first.isalpha()) and len(text) < 70:
            out[i] = "running_header"
        elif c in heads:
            out[i] = "running_header"
        elif first.isupper() and len(text) < 60 and not _SENTENCE_END.search(_ET_AL.sub("et al", text)):
            before, after = previous(i), following(i)
            cuts = bool(before) and not _SENTENCE_END.search(before) and not before.startswith(("#", "|")) and after[:1].islower()
            apart = len(text) < 0.75 * width or text.lower().endswith("et al.")
            if times[c] > 1 and (apart or cuts) or cuts and apart and before[-1:] not in BREAKS + ",":
                out[i] = "running_header"
    # The heads found vouch for lines like them that stand once more.
    seen = {cores[i][0] for i, k in out.items() if k == "running_header" and i in cores}
    for i, (c, _) in cores.items():
        if i not in out and c in seen and len(c) > 3:
            out[i] = "running_header"
    return out


def flow(lines: list[str], gone: dict[int, str]) -> list[tuple[bool, list[int]]]:
    """Blocks as line indices, each with whether it is a paragraph: text lines that follow each other but for furniture and the blanks around it."""
    out: list[tuple[bool, list[int]]] = []
    current: list[int] = []
    blank = False
    passed = False  # furniture since the last text line
    for i, line in enumerate(lines):
        s = line.strip()
        if i in gone:
            passed = True
            continue
        if not s:
            blank = True
            continue
        last = lines[current[-1]].rstrip() if current else ""
        plain = is_plain(line) or bool(current) and not blank and not passed and last[-1:] not in ":" and bool(_SECOND.match(s))  # a sentence that ends in a number
        goes_on = current and plain and (not blank or passed and not _STOP.search(last))
        if goes_on:
            current.append(i)
        else:
            if current:
                out.append((True, current))
            current = [i] if plain else []
            if not plain:
                out.append((False, [i]))
        blank = passed = False
    if current:
        out.append((True, current))
    return out


def is_plain(line: str) -> bool:
    s = line.strip()
    if s[:1].isalpha():
        return not listed(line)
    return bool(s) and not s.startswith(("#", "|", "$")) and not _LIST.match(line) and not _NUMBER_LINE.match(s)


def read(markdown: str, model: Model) -> tuple[list[tuple[int, str]], str]:
    """(line number, noise) of every noisy line, and the repaired text in continuous paragraphs."""
    lines = markdown.split("\n")
    gone = furniture(lines, model.heads)
    found = [(i + 1, kind) for i, kind in gone.items()]
    blocks: list[str] = []
    for paragraph, part in flow(lines, gone):
        if not paragraph:
            blocks.append(("\n" if blocks and blocks[-1][-1:] == "\x00" else "") + lines[part[0]].rstrip() + "\x00")
            continue
        words: list[str] = []
        at: list[int] = []  # the line of each word
        joined: dict[int, tuple[int, int]] = {}  # of words over two lines, the second line and the length of the first piece
        for i in part:
            tokens = lines[i].split()
            if words and words[-1][-1] in BREAKS and at[-1] != i and goes_on(words[-1], tokens[0]):
                head, token = words[-1], tokens[0]
                cut = broken(head, token, model)
                if cut:
                    found.append((at[-1] + 1, "hyphen_break"))
                words[-1] = head[:-1] + token if cut else head[:-1] + "-" + token
                joined[len(words) - 1] = i, len(head) - cut
                tokens = tokens[1:]
            words += tokens
            at += [i] * len(tokens)
        text = list(words)
        known = model.tokens
        for k, token in enumerate(words):
            w, doubtful = known[token]
            if not doubtful:
                continue
            fixed = model.correction(w, [known[x][0] for x in words[max(0, k - 3) : k] + words[k + 1 : k + 4]])
            if fixed is None and "-" in w and w not in model.counts:
                fixed = by_parts(w, model)
            if fixed is None:
                continue
            then, size = joined.get(k, (at[k], len(token)))
            where = token.lower().find(w)
            at_char = where + next((x for x, (p, q) in enumerate(zip(w, fixed)) if p != q), min(len(w), len(fixed)))
            found.append(((at[k] if at_char < size else then) + 1, "misread"))
            text[k] = token[:where] + (fixed.upper() if w.upper() == token[where : where + len(w)] and len(w) > 1 and token[where].isupper() and w.upper() != w and token.isupper() else fixed.capitalize() if token[where : where + 1].isupper() else fixed) + token[where + len(w) :]
        blocks.append(" ".join(text))
    out = ""
    for b in blocks:
        out += b[:-1].lstrip("\n") + "\n" if b.endswith("\x00") else ("\n" if out and not out.endswith("\n\n") else "") + b + "\n\n"
    return sorted(set(found)), out.strip()


def goes_on(head: str, token: str) -> bool:
    """True if a line's last word, which ends in a mark, may go on in the next line's first."""
    return len(head) > 1 and (head[-2].isalnum() or head[-2] in STRAYS) and (token[0].isalpha() or token[0] in "!@†|¦015689^~·")


def by_parts(word: str, model: Model) -> str | None:
    """A compound unknown as a whole is corrected part by part."""
    parts = word.split("-")
    new = [p if model.counts.get(p, 0) else model.correction(p, []) or p for p in parts]
    return "-".join(new) if new != parts and all(model.counts.get(p, 0) or p.isdigit() for p in new) else None


def broken(head: str, token: str, model: Model) -> bool:
    """True if a line's last piece and the next line's first are one word that the break cut, not a compound at its own hyphen."""
    mark = head[-1]
    if mark != "-":
        return True
    a, b = core(head[:-1]), core(token)
    if not a or not b or a[-1:].isdigit() or b[:1].isdigit() and b.isdigit():
        return False
    joined, whole = a + b, f"{a}-{b}"
    n, h = model.counts.get(joined, 0), model.counts.get(whole, 0)
    if n or h:
        return n > h
    for form, yes in ((joined, True), (whole, False)):
        if model.edits(form) or model.edits(form, two=True):
            return yes
    tail = a.rsplit("-", 1)[-1]
    return not (model.counts.get(tail, 0) and model.counts.get(b, 0))
