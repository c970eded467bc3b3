"""Column functions over identifiers, addresses and fixed-format text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill.functions.text import truthy


def last_version(versions: Column) -> Column:
    """The last label of the form vN in an array of structs with a version field."""
    return F.try_element_at(F.filter(versions["version"], lambda v: F.regexp_like(v, F.lit("^v[0-9]+$"))), F.lit(-1))


def versioned_id(paper: Column, version: Column) -> Column:
    """The id with its version, unless it has one."""
    return F.when(F.regexp_like(paper, F.lit("v[0-9]+$")) | version.isNull(), paper).otherwise(F.concat(paper, version))


def pdf_address(paper: Column, host: str = "https://example.org") -> Column:
    return F.concat(F.lit(f"{host}/pdf/"), F.replace(F.url_encode(paper), F.lit("+"), F.lit("%20")), F.lit(".pdf"))


def number_part(c: Column, prefix: str = "PMC") -> Column:
    """An id without its prefix, whatever its case."""
    return F.trim(F.regexp_replace(F.trim(c.cast("string")), f"(?i)^{prefix}", ""))


def https_from_s3(c: Column) -> Column:
    return F.regexp_replace(c, r"^s3://([^/]+)/", r"https://$1.s3.amazonaws.com/")


def url_parameter(c: Column, name: str) -> Column:
    return F.try_parse_url(c, F.lit("QUERY"), F.lit(name))


def anthology_parts(c: Column) -> Column:
    """Of an id like 2024.venue-track.12: struct of year, venue, volume_id and number; null fields for other ids."""
    part = lambda k: F.nullif(F.regexp_extract(c, r"^([0-9]{4})\.(([a-z0-9]+)-[a-z0-9]+)\.([0-9]+)$", k), F.lit(""))
    return F.struct(part(1).cast("int").alias("year"), F.upper(part(3)).alias("venue"), F.concat_ws(".", part(1), part(2)).alias("volume_id"), part(4).cast("int").alias("number"))


def volume_parts(c: Column) -> Column:
    """collection-volume at the last hyphen, as a struct."""
    return F.struct(F.regexp_extract(c, "^(.*)-[^-]*$", 1).alias("collection"), F.substring_index(c, "-", -1).alias("volume"))


def figure_id(paper: Column, number: Column, digest: Column) -> Column:
    return F.concat(paper, F.format_string(".fig.%04d.", number.cast("int")), F.substring(digest, 1, 12))


def collision_free(paper: Column, path: Column, holders: Column) -> Column:
    """The id, with a digest of the path where several rows hold it."""
    return F.when(holders > 1, F.concat(paper, F.lit("-"), F.substring(F.sha2(path, 256), 1, 12))).otherwise(paper)


def stratum(field: Column | None, venue: Column, year: Column) -> Column:
    """A given field, else venue:year, each with a fallback."""
    own = F.concat_ws(":", F.coalesce(truthy(venue), F.lit("unknown")), F.coalesce(year.cast("string"), F.lit("unknown")))
    return own if field is None else F.coalesce(truthy(field.cast("string")), own)


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("::", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def no_nan(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def pixel_budget(tokens: Column, patch: int = 32) -> Column:
    """Pixels of a visual token budget: a token covers a patch of that side."""
    return tokens * F.lit(patch * patch)


def kind(c: Column) -> Column:
    """Synonyms of the two kinds of cue."""
    k = F.lower(F.trim(c))
    return F.when(k.isin("visual", "figure", "image", "vl"), "visual").when(k.isin("textual", "text", "markdown"), "textual").otherwise(k)


def cpu_lines(c: Column) -> Column:
    """Of /proc/stat text: array of cpu, user, system, idle, iowait and total ticks, a struct for each numbered CPU."""
    rows = F.filter(F.split(c, "\n"), lambda x: F.regexp_like(x, F.lit("^cpu[0-9]+ ")))

    def one(line: Column) -> Column:
        f = F.split(F.trim(line), " +")
        ticks = F.transform(F.slice(f, 2, 8), lambda x: x.cast("long"))
        return F.struct(f[0].alias("cpu"), (ticks[0] + ticks[1]).alias("user"), ticks[2].alias("system"), ticks[3].alias("idle"), ticks[4].alias("iowait"), F.aggregate(ticks, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))

    return F.transform(rows, one)


def term_score(text: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains, inside words, too."""
    return F.size(F.filter(F.array(*map(F.lit, terms)), lambda t: F.contains(F.lower(text), t)))


def excluded_type(types: Column, keywords: list[str], preferred: list[str]) -> Column:
    """A type that contains a keyword excludes; so do types of which none is preferred."""
    low = F.transform(types, F.lower)
    bad = F.exists(low, lambda t: F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(t, k)))
    return F.coalesce(bad, F.lit(False)) | F.coalesce((F.size(low) > 0) & ~F.arrays_overlap(low, F.array(*map(F.lit, preferred))), F.lit(False))
