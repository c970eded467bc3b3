"""Column functions over text: normalisation, identifiers, licences, years and Markdown counts.  All run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Canonical licence URL (host and path) -> label.
LICENSE_URLS = {
    "creativecommons.org/licenses/by/1.0": "CC BY 1.0",
    "creativecommons.org/licenses/by/2.0": "CC BY 2.0",
    "creativecommons.org/licenses/by/2.5": "CC BY 2.5",
    "creativecommons.org/licenses/by/3.0": "CC BY 3.0",
    "creativecommons.org/licenses/by/4.0": "CC BY 4.0",
    "creativecommons.org/licenses/by-sa/1.0": "CC BY-SA 1.0",
    "creativecommons.org/licenses/by-sa/2.0": "CC BY-SA 2.0",
    "creativecommons.org/licenses/by-sa/2.5": "CC BY-SA 2.5",
    "creativecommons.org/licenses/by-sa/3.0": "CC BY-SA 3.0",
    "creativecommons.org/licenses/by-sa/4.0": "CC BY-SA 4.0",
    "creativecommons.org/publicdomain/zero/1.0": "CC0 1.0",
    "creativecommons.org/licenses/publicdomain": "CC0 1.0",
}


def truthy(c: Column | str) -> Column:
    """The string, or null where it is null or blank."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.trim(c) != "", c)


def squeeze(c: Column | str) -> Column:
    """White space of any kind collapsed to single blanks and trimmed; null becomes the empty string."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " ")), F.lit(""))


def slug(c: Column | str, length: int = 80) -> Column:
    """Lower-case ASCII letters and digits joined by hyphens, at most ``length`` characters."""
    c = F.col(c) if isinstance(c, str) else c
    return F.rtrim(F.substring(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, length), F.lit("-"))


def safe_name(c: Column | str) -> Column:
    """A file-system-safe name: letters, digits, dot, underscore and hyphen stay, the rest becomes underscores; never empty."""
    c = F.col(c) if isinstance(c, str) else c
    name = F.regexp_replace(F.regexp_replace(c, r"[^\p{L}\p{N}._-]", "_"), r"^[._]+|[._]+$", "")
    return F.coalesce(F.when(name != "", name), F.lit("unknown"))


def document_key(source: Column, natural: Column, path: Column) -> Column:
    """source-slug-hash: readable, and unique by the digest of source and path."""
    digest = F.substring(F.sha1(F.concat(source, F.lit("\x00"), path)), 1, 12)
    return F.concat_ws("-", slug(source), slug(natural), digest)


def license_label(c: Column | str) -> Column:
    """Lower case, underscores and hyphens as blanks, squeezed; 'unspecified' and blank are null."""
    c = F.col(c) if isinstance(c, str) else c
    label = F.trim(F.regexp_replace(F.translate(F.lower(c), "_-", "  "), " +", " "))
    return F.when((label != "") & (label != "unspecified"), label)


def license_family(label: Column) -> Column:
    """cc0, by-nc, by-sa (before by), by, or other; null without a label."""
    return F.when(label.isNull(), None).when(label.startswith("cc0"), "cc0").when(label.startswith("cc by nc"), "cc by-nc").when(label.startswith("cc by sa"), "cc by-sa").when(label.startswith("cc by"), "cc by").otherwise("other")


def canonical_url(c: Column | str) -> Column:
    """https, lower-case host, no port, query, fragment or trailing slash; null for what is no http address."""
    c = F.col(c) if isinstance(c, str) else c
    clean = F.regexp_replace(F.trim(c), r"[?#].*$", "")
    host = F.lower(F.regexp_extract(clean, r"^[hH][tT][tT][pP][sS]?://([^/:]+)", 1))
    path = F.regexp_replace(F.regexp_extract(clean, r"^[hH][tT][tT][pP][sS]?://[^/]+(/.*)?$", 1), "/+$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path))


def license_from_url(c: Column | str) -> Column:
    pairs = F.create_map(*(F.lit(x) for kv in LICENSE_URLS.items() for x in kv))
    return F.try_element_at(pairs, F.regexp_replace(canonical_url(c), "^https://(www\\.)?", ""))


def first_year(c: Column | str, low: int = 1991, high: int = 2100) -> Column:
    """First run of four digits, overlaps included, between the bounds."""
    c = F.col(c) if isinstance(c, str) else c
    windows = F.transform(F.regexp_extract_all(c, F.lit(r"(?=([0-9]{4}))"), F.lit(1)), lambda y: y.cast("int"))
    return F.try_element_at(F.filter(windows, lambda y: y.between(low, high)), F.lit(1))


def word_set(c: Column | str) -> Column:
    """Distinct runs of ASCII letters and digits, lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; two empty sets agree, an empty and a full one do not."""
    common = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - common
    return F.when(union == 0, 1.0).otherwise(common / union)


def flag(c: Column | str) -> Column:
    """Stringly booleans: 1, true, yes and y are true, all else false."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def heading_count(c: Column | str) -> Column:
    return F.regexp_count(c if isinstance(c, Column) else F.col(c), F.lit(r"(?m)^#{1,6} "))


def table_row_count(c: Column | str) -> Column:
    return F.regexp_count(c if isinstance(c, Column) else F.col(c), F.lit(r"(?m)^\|"))


def image_links(c: Column | str) -> Column:
    """Targets of Markdown images and of HTML image tags."""
    c = F.col(c) if isinstance(c, str) else c
    return F.concat(F.regexp_extract_all(c, F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(1)), F.regexp_extract_all(c, F.lit(r"<img[^>]+src=[\"']([^\"']+)"), F.lit(1)))


def section(c: Column | str, title: str) -> Column:
    """Text between a heading of that title and the next heading."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.regexp_extract(c, rf"(?ims)^#{{1,6}}\s+{title}\s*$(.*?)(?=^#{{1,6}}\s|\z)", 1), r"^\s+|\s+$", "")


def without_thinking(c: Column | str) -> Column:
    """A model's text without its thinking: the tagged part dropped, then what follows the last final-channel mark."""
    c = F.col(c) if isinstance(c, str) else c
    return F.trim(F.substring_index(F.regexp_replace(c, "(?s)<think>.*?</think>", ""), "<|channel|>final<|message|>", -1))


def duration(c: Column | str) -> Column:
    """Seconds as 1h02m, 3m05s or 7s."""
    s = (c if isinstance(c, Column) else F.col(c)).cast("long")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int")
    return F.when(s >= 3600, F.format_string("%dh%02dm", h, m)).when(s >= 60, F.format_string("%dm%02ds", m, r)).otherwise(F.format_string("%ds", r))


def first_matching(rules: list[tuple[Column, str]], default: str | None = None) -> Column:
    """The name of the first rule that holds, in order; nulls do not hold."""
    out = F.lit(default)
    for condition, name in reversed(rules):
        out = F.when(condition, F.lit(name)).otherwise(out)
    return out


def bar(n: Column, most: Column, width: int = 32) -> Column:
    """A bar of # as long as ``n`` is of ``most``: nothing for none, at least one mark for some."""
    return F.when((n <= 0) | (most <= 0), "").otherwise(F.repeat(F.lit("#"), F.greatest(F.lit(1), F.round(n / most * width).cast("int"))))
