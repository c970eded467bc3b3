"""How a text ends: structural closure and closing-word terminality.

A text is reduced to its *closing*: the kind of its last unit (JSON value, fence, list item, keyword, prose sentence),
whether that unit is closed by its own structure, and the key of its closing word.  What structure cannot decide
is looked up in a terminality table: of all inner occurrences of a word in the corpus, the share that closes a unit.
The table is hashed to a fixed number of slots, so its size is bounded whatever the corpus.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np

#: Slots of the hashed terminality table: bounds what is sent to the driver and broadcast.
SLOTS = 1 << 20
#: Below this terminality a closing is taken for a cut.
CUTOFF = 0.5
#: The most that a closing known by its words only can have; 1 is for closings by structure.
LEARNED = 0.99

_STRING = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"', re.S)
#: White space and characters without width.
_BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\u200b\u200c\u200d\u2060\ufeff\xad"
_ELLIPSIS = re.compile(r"(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|\.{3,}|…|⋯)$")
#: Marks that carry no text: pictographs, arrows, carets, bars and the like at the very end.
_STRAY = re.compile(r"[←-⇿⌀-➿⬀-⯿️\U0001f000-\U0001faff~^|\\<>=+#@&§¶†‡·°¬¤`]$")
_BULLET = re.compile(r"^\s*(?:[-*•–—‣◦·]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])\s+")
_KEYWORDS = re.compile(r"^\s*[\w\- ]{2,30}\s?:\s")
_ABBREV = re.compile(r"(?:^|[\s(\[])(?:al|e\.g|i\.e|cf|vs|fig|figs|eq|eqs|vol|pp|approx|resp|dr|prof|bzw|z\.b|d\.h|etc\. et|p\. ?ej|sp|ref|refs|tab|abb)\.$", re.I)
_WHOLE_NUMBER = re.compile(r"\(?\d+[.!?]?")
_NUMBER = re.compile(r"(\d+(?:[.,]\d+)*)([.!?]?)")
_CORE = re.compile(r"[^\w'’\-]+")
#: First words of questions and instructions.
_REQUEST = re.compile(r"\W*(?:what|how|which|why|who|is every|are|does|do|describe|list|write|summari[sz]e|explain|que|quels?|quelles?|comment|pourquoi|décrivez|résumez|expliquez|was|wie|welche[rsn]?|warum|beschreiben|fassen|erklären|qué|cuál|cuáles|cómo|por qué|describa|resuma|explique)\b", re.I)
_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-ZÀ-Ý¿¡])")
_SOME = re.compile(r"\w")
_PUNCT_END = re.compile(r"[.!?][\"'”’»)\]]*$")


def shape(number: str) -> str:
    """Digits by their shape: 12 -> 9, 3.45 -> 9.9, 1,234 -> 9,9."""
    return re.sub(r"\d+", "9", number)


def slot(kind: str, key: str) -> int:
    return zlib.crc32(f"{kind}\x1f{key}".encode("utf-8", "surrogatepass")) & (SLOTS - 1)


def json_open(text: str) -> bool:
    """True if a JSON text ends inside a string or with brackets still open."""
    rest = _STRING.sub("", text)
    return '"' in rest or rest.count("[") + rest.count("{") > rest.count("]") + rest.count("}")


def strip_marks(text: str) -> tuple[str, bool, bool]:
    """The text without white space, ellipses and stray marks at its end; whether an ellipsis, and a broken character, stood there."""
    ellipsis = broken = False
    while True:
        s = text.rstrip(_BLANK)
        tail = s[-16:]
        if s.endswith("\ufffd"):
            s, broken = s[:-1], True
        elif m := _ELLIPSIS.search(tail):
            s, ellipsis = s[: len(s) - len(tail) + m.start()], True
        elif not s.endswith("```") and _STRAY.search(tail):
            s = s[:-1]
        if s == text:
            return s, ellipsis, broken
        text = s


def kind_of(s: str) -> str:
    if s.startswith("```"):
        return "fence"
    if s[:1] in "[{" and re.match(r"[\[{]\s*(?:[\[{\"\]}]|-?\d|true|false|null|$)", s):
        return "json"
    if _BULLET.match(s):
        return "list"
    if "," in s and "\n" not in s and _KEYWORDS.match(s) and not _PUNCT_END.search(s):
        return "keywords"
    return "prose"


def core(token: str) -> str:
    return _CORE.sub("", token).lower() if not token.isalpha() else token.lower()


def item_keys(item: str) -> tuple[str, str, str]:
    """Of a list item: closing word, frame (first word and length), first word."""
    words = item.split()
    first = words[0].lower() if words else ""
    return core(words[-1]) if words else "", f"{first} {min(len(words), 40)}", first


def evidence(texts: list[str]) -> Counter:
    """(kind, key, closes) counts of the inner units of texts; the text's own last unit is no evidence."""
    out: Counter = Counter()
    tokens: Counter = Counter()
    for text in texts:
        if not text:
            continue
        s = text.strip()
        kind = kind_of(s) if s else ""
        if kind == "prose":
            words = s.split()
            if words:
                tokens.update(words)
                tokens[words[-1]] -= 1
            for prev, number in zip(words, words[1:-1]):
                if number[0].isdigit() and (m := _NUMBER.fullmatch(number)):
                    out["number", f"{prev.lower()} {shape(m[1])}", bool(m[2])] += 1
        elif kind == "list":
            lines = [_BULLET.sub("", x).rstrip(" ;,.") for x in s.split("\n") if x.strip()]
            for item in lines[:-1]:
                last, frame, first = item_keys(item)
                out["item", last, True] += 1
                out["frame", frame, True] += 1
                out["first", first, True] += 1
                for w in item.split()[:-1]:
                    out["item", core(w), False] += 1
        elif kind == "keywords":
            parts = s.split(":", 1)[1].split(",")
            for part in parts[:-1]:
                words = part.split()
                if words:
                    out["item", core(words[-1]), True] += 1
                for w in words[:-1]:
                    out["item", core(w), False] += 1
    for token, n in tokens.items():
        if n > 0:
            out["word", core(token), bool(_PUNCT_END.search(token))] += n
    return out


def terminality(closes: np.ndarray, total: np.ndarray, kind: str, key: str, unseen: float) -> float:
    k = slot(kind, key)
    return unseen if total[k] == 0 else (closes[k] + 0.2 * unseen) / (total[k] + 0.2)


def score(text: str | None, closes: np.ndarray, total: np.ndarray) -> float:
    """Terminality of a text's closing in [0, 1]; a null or markless-empty text counts as complete (it is another defect)."""
    if not text or not _SOME.search(text):
        return 1.0
    s, ellipsis, broken = strip_marks(text)
    body = s.lstrip()
    if not _SOME.search(s):
        return 1.0
    if broken:
        return 0.0
    kind = kind_of(body)
    if body.count("```") % 2:
        return 0.0
    if kind == "fence":
        inner = re.sub(r"^```\w*|```$", "", body).strip()
        return 0.0 if inner[:1] in ("[", "{") and json_open(inner) else 1.0
    if kind == "json":
        if json_open(body):
            return 0.0
        if body[-1] in "]}":
            return 1.0
    bare = s.rstrip("\"'”’»)]}*_")
    if bare[-1:] == "," and _PUNCT_END.search(bare[:-1]):
        bare = bare[:-1]
    last_line = bare.rsplit("\n", 1)[-1]
    if kind == "list" and _BULLET.match(last_line):
        if _PUNCT_END.search(bare):
            return 1.0
        item = _BULLET.sub("", last_line).strip()
        if not item or item[-1] in ",;:-(":
            return 0.0
        last, frame, first = item_keys(item)
        by_word = min(1.0, terminality(closes, total, "item", last, 0.0) / 0.12)
        n_first = total[slot("first", first)]
        by_frame = 1.0 if n_first < 20 else min(1.0, 40.0 * total[slot("frame", frame)] / n_first)
        return min(by_word, by_frame, LEARNED)
    if kind == "list" and re.match(r"^\s*(?:[-*•–]|\d+[.)]?)\s*$", last_line):
        return 0.0
    if kind == "keywords":
        item = bare.rsplit(",", 1)[-1]
        if not item.strip():
            return 0.0
        return min(LEARNED, terminality(closes, total, "item", core(item.split()[-1]), 0.0) / 0.12)
    if bare[-1:] in ".!?。！？":
        if s[-1:] not in ")]" and bare.count("(") > bare.count(")"):
            sentence = _SENTENCE.split(bare)[-1]
            if sentence.count("(") > sentence.count(")"):
                return 0.0
        if _ABBREV.search(bare[-10:]):
            return 0.0
        if ellipsis and bare[-1] == "." and re.search(r"\.\.$", bare):
            return 0.0
        if bare[-2:-1].isdigit() and len(pair := bare.rsplit(None, 2)[-2:]) == 2 and _WHOLE_NUMBER.fullmatch(pair[1]):  # 44. may be the start of 44.1 %
            return min(LEARNED, terminality(closes, total, "number", f"{pair[0].lower()} 9", 0.6) / 0.1)
        return 1.0
    if bare[-1:] == ":":
        return 1.0 if re.search(r"(?:^|\n)\s*[A-ZÀ-Ý]{3,20}\s?:$", bare) else 0.0
    if bare[-1:] in ",;-–—(/" or ellipsis:
        return 0.0
    words = bare.split()
    if s != bare and s[-1] in "\"”»" and len(words) > 3:  # the quotation is closed, so nothing is missing
        return 1.0
    if body.lower() in ("null", "none", "nil", "n/a", "nan"):
        return 1.0
    if len(words) <= 2:
        return 0.75 * (total[slot("word", core(words[-1]))] > 0) + 0.2
    if bare[-1:].isdigit():
        return 0.0
    # An unstopped sentence after stopped ones is cut; a lone one is whole if its last word all but always closes.
    if re.search(r"[.!?][\"'”’»)\]]*\s", bare):
        return 0.0
    # A question or instruction given back needs no stop; it is cut if its last word is no word.
    if _REQUEST.match(body):
        return LEARNED * (total[slot("word", core(words[-1]))] > 0)
    return min(LEARNED, max(0.0, terminality(closes, total, "word", core(words[-1]), 0.0) - 0.4) / 0.6)
