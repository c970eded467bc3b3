"""The few functions that Catalyst cannot express, as Arrow-batched UDFs around plain Python cores."""

from __future__ import annotations

import difflib
import html
import io
import json
import re
import struct
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

_TEX = re.compile(r"\\[A-Za-z]+")
_LINK = re.compile(r"\[([^\]]*)\]\([^)]*\)")


def plain_text(value: str | None) -> str:
    """Entities resolved, tags and TeX commands dropped, links by their text, marks as blanks, casefolded and squeezed."""
    if not value:
        return ""
    text = _LINK.sub(r"\1", re.sub(r"<[^>]*>", " ", html.unescape(value)))
    return " ".join(re.sub(r"[$_^{}\\]", " ", _TEX.sub(" ", text)).split()).casefold()


def similarity(a: str | None, b: str | None) -> float:
    """Ratcliff-Obershelp ratio of the plain texts; two empty texts agree."""
    x, y = plain_text(a), plain_text(b)
    return 1.0 if not x and not y else 0.0 if not x or not y else difflib.SequenceMatcher(None, x, y).ratio()


class _Open(Exception):
    """The text ended inside a value."""


def parse_loose(text: str) -> list:
    """The JSON values in a text that may be wrapped, joined without commas, or cut off.

    A recursive-descent reader that closes what is open at the end: a cut string or number keeps what it has, a key without a
    value is dropped, and text between values is skipped."""
    found, at = [], 0
    decoder = json.JSONDecoder()
    while True:
        starts = [k for k in (text.find("{", at), text.find("[", at)) if k >= 0]
        if not starts:
            return found
        at = min(starts)
        try:
            value, at = decoder.raw_decode(text, at)
        except ValueError:
            value, at = _closing(text, at)
        found.append(value)


def _closing(text: str, at: int):
    def blank(i: int) -> int:
        while i < len(text) and text[i] in " \t\r\n,:":
            i += 1
        return i

    def value(i: int):
        i = blank(i)
        if i >= len(text):
            raise _Open
        c = text[i]
        if c == "{":
            out: dict = {}
            i = blank(i + 1)
            while i < len(text) and text[i] != "}":
                if text[i] != '"':
                    i = blank(i + 1)
                    continue
                key, i = value(i)
                try:
                    out[key], i = value(i)
                except _Open:
                    return out, len(text)
                i = blank(i)
            return out, min(len(text), i + 1)
        if c == "[":
            items: list = []
            i = blank(i + 1)
            while i < len(text) and text[i] != "]":
                try:
                    item, i = value(i)
                except _Open:
                    break
                items.append(item)
                i = blank(i)
            return items, min(len(text), i + 1)
        if c == '"':
            end = i + 1
            while end < len(text) and text[end] != '"':
                end += 2 if text[end] == "\\" else 1
            raw = text[i + 1 : end]
            try:
                return json.loads(f'"{raw}"', strict=False), end + 1
            except ValueError:
                return raw.rstrip("\\"), end + 1
        word = re.compile(r"[^\s,\]}]+").match(text, i)
        if not word:
            return None, i + 1
        try:
            return json.loads(word[0]), word.end()
        except ValueError:
            return word[0], word.end()

    return value(at)


#: The order in which the fields of a figure clue are told.
FIGURE_FIELDS = ("figure_type", "layout", "visual_elements", "colors_and_styles", "relationships", "distinctive_visual_cues")


def _texts(value) -> Iterator[str]:
    if isinstance(value, str):
        yield value
    elif isinstance(value, dict):
        for v in value.values():
            yield from _texts(v)
    elif isinstance(value, list):
        for v in value:
            yield from _texts(v)
    elif value is not None and not isinstance(value, bool):
        yield str(value)


def components(text: str | None, kind: str | None) -> list[str]:
    """The single cues in a model's output: 'textual category: cue' or 'field: item'; text without JSON is one cue."""
    s = (text or "").strip()
    if not s:
        return []
    values = parse_loose(s)
    rows: list[dict] = []

    def walk(v) -> None:
        if isinstance(v, list):
            for x in v:
                walk(x)
        elif isinstance(v, dict):
            rows.append(v)

    walk(values)
    out = []
    for row in rows:
        if kind == "textual" and isinstance(row.get("cue"), str):
            out.append(f"textual {row.get('category') or 'cue'}: {row['cue']}")
        else:
            rank = {k: i for i, k in enumerate(FIGURE_FIELDS)}
            for field in sorted(row, key=lambda k: rank.get(k, len(rank))):
                out += [f"{field}: {item.strip()}" for item in _texts(row[field]) if item.strip()]
    return [x for x in out if x.strip()] if rows else [s]


def image_size(content: bytes | None) -> tuple[int, int] | None:
    """Width and height of a PNG, GIF or JPEG."""
    b = content or b""
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return struct.unpack(">II", b[16:24])
    if b[:6] in (b"GIF87a", b"GIF89a") and len(b) >= 10:
        return struct.unpack("<HH", b[6:10])
    if b[:2] == b"\xff\xd8":
        i = 2
        while i + 9 < len(b) and b[i] == 0xFF:
            if b[i + 1] in range(0xC0, 0xC4):
                h, w = struct.unpack(">HH", b[i + 5 : i + 9])
                return w, h
            i += 2 + struct.unpack(">H", b[i + 2 : i + 4])[0]
    return None


def safe_member(name: str) -> bool:
    return bool(name) and not name.startswith("/") and "\\" not in name and not any(p in ("", ".", "..") for p in name.split("/"))


def stream_members(file) -> Iterator[dict]:
    """Files of a TAR or ZIP archive, one by one with their bytes, from a file open for reading; unsafe names and repeated members are marked, not
    extracted."""
    seen: set[str] = set()

    def member(name: str, read) -> dict:
        problem = "unsafe" if not safe_member(name) else "duplicate" if name in seen else None
        seen.add(name)
        return {"name": name, "content": None if problem else read(), "problem": problem}

    begin = file.read(4)
    file.seek(0)
    if not begin:
        return
    try:
        if begin[:2] == b"PK":
            with zipfile.ZipFile(file) as z:
                for i in z.infolist():
                    if not i.is_dir():
                        yield member(i.filename, lambda i=i: z.read(i))
        else:
            with tarfile.open(fileobj=file, mode="r|*") as t:
                for m in t:
                    if m.isfile():
                        yield member(m.name, lambda m=m: t.extractfile(m).read())
    except (tarfile.TarError, zipfile.BadZipFile):
        yield {"name": None, "content": None, "problem": "unreadable"}


def archive_members(content: bytes | None) -> list[dict]:
    """``stream_members`` of an archive that is at hand."""
    return list(stream_members(io.BytesIO(content))) if content else []


@F.pandas_udf(T.StringType())
def plain_text_udf(c: pd.Series) -> pd.Series:
    return c.map(plain_text)


@F.pandas_udf(T.DoubleType())
def similarity_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([similarity(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def components_udf(text: pd.Series, kind: pd.Series) -> pd.Series:
    return pd.Series([components(x, k) for x, k in zip(text, kind)])


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType())]))
def image_size_udf(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([image_size(x) or (None, None) for x in content], columns=["width", "height"]).astype("Int32")
