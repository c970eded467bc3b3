"""Keyed lookups against a service from each partition: batches, retries with back-off, errors as data."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Fetch = Callable[[list[str]], dict[str, str]]


class Permanent(Exception):
    """A failure that another try cannot mend."""


def fetch_all(keys: list[str], fetch: Fetch, retries: int, base: float, wait: Callable[[float], None] = time.sleep) -> list[tuple[str | None, str | None]]:
    """(value, error) of each key; a key the service does not know has neither.  Waits base * 2^n seconds, at most 300, between tries."""
    for n in range(retries + 1):
        try:
            found = fetch(keys)
            return [(found.get(k), None) for k in keys]
        except Permanent as error:
            return [(None, f"Permanent: {error}")] * len(keys)
        except Exception as error:
            if n == retries:
                return [(None, f"{type(error).__name__}: {error}")] * len(keys)
            wait(min(300.0, base * 2**n))
    return []


def lookup(df: DataFrame, key: str, load: Callable[[], Fetch], size: int = 200, retries: int = 3, base: float = 0.5) -> DataFrame:
    """``df`` with value and error columns; each Python worker makes one client and asks in batches of distinct keys."""
    schema = T.StructType([*df.schema.fields, T.StructField("value", T.StringType()), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fetch = load()
        for pdf in batches:
            keys = pdf[key].dropna().unique().tolist()
            known: dict[str, tuple] = {}
            for start in range(0, len(keys), size):
                part = keys[start : start + size]
                known.update(zip(part, fetch_all(part, fetch, retries, base)))
            pairs = [known.get(k, (None, None)) for k in pdf[key]]
            yield pdf.assign(value=[v for v, _ in pairs], error=[e for _, e in pairs])

    return df.mapInPandas(run, schema)
