"""Extractions and figures: which file of an extraction to take, its pages, figure windows, component selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliomill.operators import ranking


def page_total(content: Column) -> Column:
    """Pages of an extraction's content list: of pages (a list of lists) their number, of blocks the greatest page_idx plus one; null if there is none."""
    nested = F.regexp_like(content, F.lit(r"^\s*\[\s*\["))
    pages = F.json_array_length(content)
    # A list that holds a list and something else is read as blocks.
    pages = F.when(nested & F.coalesce(F.size(F.from_json(content, "array<array<string>>")) == pages, F.lit(False)), pages)
    index = F.transform(F.from_json(content, "array<struct<page_idx:int>>"), lambda b: b["page_idx"])
    return F.coalesce(pages, F.array_max(index) + 1)


def best_files(files: DataFrame) -> DataFrame:
    """(folder, markdown, content): of the files of each extraction (folder, path, length) the largest Markdown that is not empty, the first by path
    of equal ones, and the content list, the second version's before others, by path; null where there is none."""
    name = F.regexp_extract("path", "[^/]*$", 0)
    markdown = name.endswith(".md") & (F.col("length") > 0)
    content = name.contains("content_list") & name.endswith(".json")
    return files.groupBy("folder").agg(
        F.min_by(F.when(markdown, F.col("path")), F.when(markdown, F.struct(-F.col("length"), "path"))).alias("markdown"),
        F.min_by(F.when(content, F.col("path")), F.when(content, F.struct(~name.contains("content_list_v2"), "path"))).alias("content"),
    )


def figure_window(papers: DataFrame, order: list[Column], figures: str, start: int = 0, end: int | None = None, limit: int | None = None, most: int | None = None) -> DataFrame:
    """One row a figure with its number over all papers in their order, from ``start`` up to ``end`` and at most ``limit`` of them.  Papers are numbered
    before the window is taken; those without figures take no number."""
    rows = papers.select("*", F.posexplode(figures).alias("figure_pos", "figure")).drop(figures)
    numbered = ranking.ranked(rows, [], [*order, F.col("figure_pos")], "figure_index", most).withColumn("figure_index", F.col("figure_index") - 1)
    last = min(x for x in (end, None if limit is None else start + limit, 1 << 62) if x is not None)
    return numbered.filter((F.col("figure_index") >= start) & (F.col("figure_index") < last))


def first_figures(figures: Column, most: int) -> Column:
    """The first ``most`` figures of a paper."""
    return F.slice(figures, 1, most)


def components_of(textual: Column, visual: Column, mode: str) -> Column:
    """The components a query of this mode is made of: the visual ones only, or the textual ones and then the visual ones; null lists are empty."""
    empty = F.array().cast("array<string>")
    seen = F.coalesce(visual, empty)
    return seen if mode == "visual-only" else F.concat(F.coalesce(textual, empty), seen)
