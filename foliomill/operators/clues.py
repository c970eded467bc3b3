"""Cues, prompts, answers and audits: flattening of model output, selection by modality, rendering, batching, contract checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_object(c: Column) -> Column:
    """The text's JSON object as canonical text, else that of its outermost braces, else null; arrays are no objects."""
    inner = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    # Wrapped as an array, the text must have one element: parsers alone let trailing text pass.
    one = lambda x: F.json_array_length(F.concat(F.lit("["), x, F.lit("]"))) == 1
    return F.coalesce(*(F.when(F.startswith(F.ltrim(x), F.lit("{")) & one(x), x) for x in (F.trim(c), inner)))


#: Cues of the textual form: an array of objects with cue and category.
CUES = "array<struct<cue:string,category:string>>"


def cues(c: Column) -> Column:
    """Cues of a clean JSON array, fenced or not, as 'textual category: cue'; null for other texts (those go through the loose reader)."""
    body = F.trim(F.regexp_replace(c, r"^\s*```[a-z]*\s*|\s*```\s*$", ""))
    parsed = F.when(F.startswith(body, F.lit("[")) & F.try_parse_json(body).isNotNull(), F.from_json(body, CUES))
    kept = F.filter(parsed, lambda x: x["cue"].isNotNull())
    return F.transform(kept, lambda x: F.concat(F.lit("textual "), F.coalesce(x["category"], F.lit("cue")), F.lit(": "), x["cue"]))


def shown(cue: Column) -> Column:
    """A cue without its label."""
    return F.trim(F.regexp_replace(F.trim(cue), r"^(?:textual\s+[^:]+|[A-Za-z][A-Za-z0-9_ -]*):\s*", ""))


#: Fixed value: how the query of the null backend begins.
NULL_QUERY = "I'm trying to find a paper I read before. I remember that "


def null_query(cues: Column) -> Column:
    """The query that the null backend writes from the cues."""
    told = F.array_join(F.transform(cues, lambda x: F.rtrim(shown(x), F.lit("."))), " ")
    return F.concat(F.lit(NULL_QUERY), told, F.lit("."))


def bullets(cues: Column) -> Column:
    return F.array_join(F.transform(cues, lambda x: F.concat(F.lit("- "), shown(x))), "\n")


def render(template: str, values: dict[str, Column]) -> Column:
    """A prompt template with its {placeholders} replaced one after the other; a value missing in the template is appended as a section."""
    out = F.lit(template)
    for name, value in values.items():
        value = F.coalesce(value, F.lit(""))
        mark = "{" + name + "}"
        out = F.replace(out, F.lit(mark), value) if mark in template else F.concat(out, F.lit(f"\n\n{name.upper()}:\n"), value)
    return out


def coverage(has_textual: Column, described: Column, expected: Column, relaxed: bool = False) -> Column:
    """A textual cue and all (or any, if relaxed) expected figures; no expected figure is no coverage."""
    figures = F.arrays_overlap(described, expected) if relaxed else F.size(F.array_except(expected, described)) == 0
    return has_textual & (F.size(expected) > 0) & figures


class Backend(Protocol):
    """A batch text generator; it answers prompts in order, one string each."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def generate(df: DataFrame, prompt: str, load: Callable[[], Backend], size: int = 64) -> DataFrame:
    """Answers of a backend that each Python worker loads once.  A failing batch is halved until the failing prompt stands alone, whose error
    is returned as data; the answer count is checked."""
    schema = df.drop(prompt).schema.add("answer", "string").add("error", "string")

    def ask(backend: Backend, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            out = backend(prompts)
            if len(out) != len(prompts):
                raise ValueError(f"{len(out)} answers to {len(prompts)} prompts")
            return [(x, None) for x in out]
        except Exception as error:
            if len(prompts) == 1:
                return [(None, f"{type(error).__name__}: {error}")]
            half = len(prompts) // 2
            return ask(backend, prompts[:half]) + ask(backend, prompts[half:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        backend = load()
        for pdf in batches:
            done: list = []
            for start in range(0, len(pdf), size):
                done += ask(backend, pdf[prompt].iloc[start : start + size].tolist())
            yield pdf.drop(columns=[prompt]).assign(answer=[a for a, _ in done], error=[e for _, e in done])

    return df.mapInPandas(run, schema)


def contract_violations(requests: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """Keys that break one result for each request: unknown, missing, repeated."""
    a = requests.groupBy(key).agg(F.count("*").alias("asked"))
    b = results.groupBy(key).agg(F.count("*").alias("answered"))
    status = F.when(F.col("asked").isNull(), "unknown").when(F.col("answered").isNull(), "missing").when(F.col("answered") > 1, "repeated")
    return a.join(b, key, "full_outer").select(key, status.alias("problem")).filter("problem is not null")
