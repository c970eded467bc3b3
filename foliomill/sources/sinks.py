"""Sinks: JSON lines, fixed-column Parquet and CSV, TAR shards, snapshots, idempotent tables, Markdown reports."""

from __future__ import annotations

import io
import json
import os
import shutil
import tarfile
import time
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.plans.runtime import cut


def write_jsonl(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "overwrite") -> None:
    """JSON lines, null fields kept; partitioned by columns if given."""
    w = df.write.mode(mode).option("ignoreNullFields", False)
    (w.partitionBy(*by) if by else w).json(path)


def put_row(spark: SparkSession, path: str, row: dict, append: bool = True) -> None:
    """One JSON object to a table of JSON lines, keys sorted: appended, or in place of all that is there."""
    line = json.dumps(row, sort_keys=True, ensure_ascii=False)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append" if append else "overwrite").text(path)


def write_groups(df: DataFrame, path: str, by: list[str], first: bool) -> None:
    """JSON lines in a folder for each group.  The ``first`` write of a run replaces the groups it holds and leaves the others; later ones append."""
    w = df.write.option("ignoreNullFields", False).partitionBy(*by)
    (w.mode("overwrite").option("partitionOverwriteMode", "dynamic") if first else w.mode("append")).json(path)


def write_parquet(df: DataFrame, path: str, columns: list[str]) -> None:
    """Exactly these columns in this order; missing ones are null."""
    df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns)).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    df.select(*columns).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_once(df: DataFrame, path: str, overwrite: bool = False) -> str:
    """Keep a table that already has the same rows, refuse to change one that has others unless told to; returns kept or written."""
    spark = df.sparkSession
    try:
        old = spark.read.schema(df.schema).parquet(path)
        same = old.exceptAll(df).isEmpty() and df.exceptAll(old).isEmpty()
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        old = None
    if old is not None and same:
        return "kept"
    if old is not None and not overwrite:
        raise ValueError(f"{path} holds other rows")
    df.write.mode("overwrite").parquet(path)
    return "written"


def write_shards(files: DataFrame, folder: str) -> DataFrame:
    """TAR shards of (shard, name, content, record) rows, and a manifest row for each member: shard, name, size_bytes, sha256.

    Rows of a shard stream through one task in name order; a shard is written under a temporary name and renamed when whole, so a lost task
    leaves no broken shard behind.  ``folder`` must be shared by the executors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import hashlib

        os.makedirs(folder, exist_ok=True)
        current, tar, temp = None, None, ""

        def close() -> None:
            if tar is not None:
                tar.close()
                os.replace(temp, os.path.join(folder, current))

        for pdf in batches:
            rows = []
            for shard, name, content, record in zip(pdf["shard"], pdf["name"], pdf["content"], pdf["record"]):
                if shard != current:
                    close()
                    current, temp = shard, os.path.join(folder, f".{shard}.{os.getpid()}")
                    tar = tarfile.open(temp, "w")
                for member, data in ((f"{name}.pdf", bytes(content or b"")), (f"{name}.json", json.dumps(json.loads(record or "{}"), sort_keys=True).encode())):
                    info = tarfile.TarInfo(member)
                    info.size = len(data)
                    tar.addfile(info, io.BytesIO(data))
                    rows.append((shard, member, len(data), hashlib.sha256(data).hexdigest()))
            yield pd.DataFrame(rows, columns=["shard", "name", "size_bytes", "sha256"])
        close()

    ordered = files.select("shard", "name", "content", "record").repartition("shard").sortWithinPartitions("shard", "name")
    return ordered.mapInPandas(run, "shard string, name string, size_bytes long, sha256 string")


def write_bundle(files: DataFrame, queries: DataFrame, path: str) -> int:
    """One ZIP for review: the files (name, content) in name order, streamed one by one, and queries.json with all rows of ``queries``; written under a temporary
    name and renamed when whole.  A bundle is a sample for people, so its manifest fits the driver; returns the number of files."""
    temp, n = f"{path}.tmp", 0
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    try:
        with zipfile.ZipFile(temp, "w", zipfile.ZIP_DEFLATED) as z:
            for r in files.select("name", "content").orderBy("name").toLocalIterator():
                z.writestr(f"pdfs/{r['name']}", bytes(r["content"] or b""))
                n += 1
            z.writestr("queries.json", json.dumps([r.asDict(recursive=True) for r in queries.toLocalIterator()], indent=2, ensure_ascii=False, default=str) + "\n")
        os.replace(temp, path)
    finally:
        if os.path.exists(temp):
            os.remove(temp)
    return n


def transfer(plan: DataFrame, move: bool = False) -> DataFrame:
    """Carry out an ``action_plan`` of files (source_path, target_path, action) on a shared folder: (target_path, outcome), outcome one of written, existing,
    missing and failed.  A file is copied under a temporary name and renamed, so a task that is run again does no harm."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for source, target, action in zip(pdf["source_path"], pdf["target_path"], pdf["action"]):
                outcome = action
                if action == "planned":
                    try:
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        temp = f"{target}.{os.getpid()}.tmp"
                        shutil.copyfile(source, temp)
                        os.replace(temp, target)
                        if move:
                            os.remove(source)
                        outcome = "written"
                    except FileNotFoundError:
                        outcome = "existing" if os.path.exists(target) else "missing"
                    except OSError as error:
                        outcome = f"failed: {error.strerror}"
                out.append((target, outcome))
            yield pd.DataFrame(out, columns=["target_path", "outcome"])

    return plan.select("source_path", "target_path", "action").mapInPandas(run, "target_path string, outcome string")


def upload(shards: DataFrame, load: Callable[[], Callable[[str], None]], parallel: int = 4, done: DataFrame | None = None, retries: int = 3, base: float = 0.5, wait: Callable[[float], None] = time.sleep) -> DataFrame:
    """Hand shards (place, path) to a service, at most ``parallel`` at a time: (place, path, outcome) in the order of ``place``; outcome is uploaded or the error.

    ``load`` makes a client in each worker; shards in ``done`` (path) are left out; a failing one is tried again with back-off."""
    if done is not None:
        shards = shards.join(done.select("path").distinct(), "path", "left_anti")
    kinds = dict(shards.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = load()
        for pdf in batches:
            out = []
            for path in pdf["path"]:
                outcome = "uploaded"
                for n in range(retries + 1):
                    try:
                        send(path)
                        outcome = "uploaded"
                        break
                    except Exception as error:
                        outcome = f"{type(error).__name__}: {error}"
                        if n < retries:
                            wait(min(300.0, base * 2**n))
                out.append(outcome)
            yield pdf[["place", "path"]].assign(outcome=out)

    sent = cut(shards.select("place", "path").repartition(parallel, "place").mapInPandas(run, f"place {kinds['place']}, path string, outcome string"))
    return sent.orderBy("place")


def delete_files(decisions: DataFrame) -> DataFrame:
    """Delete the files (path, action) whose action is delete; (path, outcome): deleted, gone before, kept or failed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, action in zip(pdf["path"], pdf["action"]):
                outcome = "kept"
                if action == "delete":
                    try:
                        os.remove(path)
                        outcome = "deleted"
                    except FileNotFoundError:
                        outcome = "gone"
                    except OSError as error:
                        outcome = f"failed: {error.strerror}"
                out.append((path, outcome))
            yield pd.DataFrame(out, columns=["path", "outcome"])

    return decisions.select("path", "action").mapInPandas(run, "path string, outcome string")


def action_plan(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """What a copy would do with each file: planned, existing, or missing at the source."""
    x = wanted.join(there.select(key, F.lit(True).alias("at_target")), key, "left")
    return x.withColumn("action", F.when(~F.col("at_source"), "missing").when(F.col("at_target"), "existing").otherwise("planned")).drop("at_target")


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A small result (a report of at most ``most`` rows) as a Markdown table."""
    rows = df.limit(most).collect()
    show = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v)
    head = [f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + [f"| {' | '.join(show(r[c]) for c in df.columns)} |" for r in rows])
