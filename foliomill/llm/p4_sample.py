"""Problem 4: a sample that matches target category proportions.

Documents are grouped by category signature (their cell of source and years); only the counts of the signatures reach the driver, one a
cell.  Swap repair works on those counts: from a random sample that keeps every cell's floor, it exchanges blocks of one signature for
another while that lowers the squared deviation from the targets.  The final counts are materialised by the least seeded hashes of
each cell, found through a histogram of hashes, so no cell is ever sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliomill.plans.runtime import cut, small, table

#: Share of the documents that is drawn: one in SAMPLE_OF, rounded down.
SAMPLE_OF = 10
SEED = 20_240_501
#: Histogram bins of the hash that orders a cell's documents.
BINS = 1024


@dataclass
class Cell:
    cell_id: int
    available: int
    floor: int
    target: float


def latest(pdf_entries: DataFrame) -> DataFrame:
    """(document_id, source, year): each document's last row by discovered_at; source without case and outer blanks."""
    rows = pdf_entries.filter("document_id is not null").select("document_id", F.trim(F.lower("source")).alias("source"), F.col("metadata.year").alias("year"), "discovered_at")
    return rows.groupBy("document_id").agg(F.max_by(F.struct("source", "year"), F.struct("discovered_at", "source", "year")).alias("d")).select("document_id", "d.source", "d.year")


def celled(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """Each document's cell_id (null where its source has no cell): the cell of its year, else the source's cell without years."""
    cells = targets.select("cell_id", F.trim(F.lower("source")).alias("source"), "year_from", "year_to")
    by_source = cells.groupBy("source").agg(F.collect_list(F.struct("cell_id", "year_from", "year_to")).alias("cells"))
    inside = F.expr("filter(cells, c -> year between c.year_from and c.year_to)")
    outside = F.expr("filter(cells, c -> c.year_from is null and c.year_to is null)")
    found = F.coalesce(F.expr("array_min(transform(inside, c -> c.cell_id))"), F.expr("array_min(transform(outside, c -> c.cell_id))"))
    return documents.join(small(by_source, 10_000), "source", "left").withColumn("inside", inside).withColumn("outside", outside).withColumn("cell_id", found).select("document_id", "source", "year", "cell_id")


def swap_repair(cells: list[Cell], size: int, seed: int = SEED) -> dict[int, int]:
    """Rows to draw from each cell.

    The first sample keeps every floor (or all there is) and fills up at random in proportion to what is left.  Then blocks are
    exchanged between the pair of cells whose exchange lowers the squared deviation most, until no exchange of even one row does;
    the deviation is convex in the counts, so no better sample of that size remains."""
    have = np.array([c.available for c in cells], dtype=np.int64)
    floor = np.minimum(have, [c.floor for c in cells])
    aim = np.array([c.target for c in cells])
    size = int(min(max(size, floor.sum()), have.sum()))
    rng = np.random.default_rng(seed)
    left = have - floor
    n = floor + (rng.multivariate_hypergeometric(left, size - int(floor.sum()), method="marginals") if left.sum() else 0)
    while len(cells):
        gap = n - aim  # giving one row away changes the deviation by 1 - 2 gap, taking one by 1 + 2 gap
        give = np.where(n > floor, gap, -np.inf)
        take = np.where(n < have, gap, np.inf)
        i, j = int(give.argmax()), int(take.argmin())
        if not give[i] - take[j] > 1:
            break
        block = int(max(1, min((give[i] - take[j]) // 2, n[i] - floor[i], have[j] - n[j])))
        n[i] -= block
        n[j] += block
    return {c.cell_id: int(x) for c, x in zip(cells, n)}


def plan(documents: DataFrame, targets: DataFrame) -> DataFrame:
    """A row each cell: available, required (the greater of floor and target), drawn.  ``documents`` has a cell_id column."""
    spark = documents.sparkSession
    counts = {r["cell_id"]: r["count"] for r in documents.groupBy("cell_id").count().collect()}  # a row each cell
    size = sum(counts.values()) // SAMPLE_OF
    rows = targets.collect()  # a few dozen rows, fixed
    cells = [Cell(r["cell_id"], counts.get(r["cell_id"], 0), r["min_rows"] or 0, size * (r["target_permille"] or 0) / 1000) for r in sorted(rows, key=lambda r: r["cell_id"])]
    drawn = swap_repair(cells, size)
    out = [(c.cell_id, c.available, max(c.floor, int(c.target + 1e-9)), drawn[c.cell_id], size) for c in cells]
    return spark.createDataFrame(out, "cell_id long, available long, required long, drawn long, sample_size long")


def draw(documents: DataFrame, planned: DataFrame, seed: int = SEED) -> DataFrame:
    """The ``drawn`` documents of least seeded hash of each cell."""
    hashed = documents.filter("cell_id is not null").withColumn("order", F.xxhash64(F.lit(seed), "document_id")).withColumn("bin", F.expr(f"int((order / 18446744073709551616D + 0.5D) * {BINS})"))
    bins = hashed.groupBy("cell_id", "bin").agg(F.count("*").alias("n"))
    upto = F.sum("n").over(Window.partitionBy("cell_id").orderBy("bin"))  # at most BINS rows a cell
    marks = bins.withColumn("upto", upto).join(F.broadcast(planned.select("cell_id", "drawn")), "cell_id").filter("upto - n < drawn").select("cell_id", "bin", (F.col("drawn") - F.col("upto") + F.col("n")).alias("rest"), (F.col("upto") <= F.col("drawn")).alias("all"))
    kept = hashed.join(F.broadcast(marks), ["cell_id", "bin"])  # at most BINS rows a cell
    rank = F.row_number().over(Window.partitionBy("cell_id").orderBy("order", "document_id"))
    edge = kept.filter("not all").withColumn("rank", rank).filter("rank <= rest")
    fields = ["document_id", "source", "year", "cell_id"]
    return kept.filter("all").select(*fields).unionByName(edge.select(*fields))


def _celled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, sf_dir, "sample_targets")
    return celled(latest(table(spark, sf_dir, "pdf_entries", ["document_id", "source", "metadata", "discovered_at"])), targets), targets


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that cannot be filled: the repaired sample falls short of what they require, and they have no more to give.  A null source, or one without cells, belongs to no cell but counts for N; without documents N is 0
    and only floors count; equal cells of one source and year go to the least cell_id; repeated rows count once."""
    return plan(*_celled(spark, sf_dir)).filter("drawn < required and available < required").select("cell_id")


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, targets = _celled(spark, sf_dir)
    documents = cut(documents)
    return draw(documents, plan(documents, targets))


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's target, availability and drawn rows with both shares, and whether it could be filled."""
    documents, targets = _celled(spark, sf_dir)
    planned = plan(documents, targets)
    share = F.round(F.col("drawn") / F.greatest(F.col("sample_size"), F.lit(1)), 6)
    return planned.join(F.broadcast(targets), "cell_id").select("cell_id", "source", "year_from", "year_to", "target_permille", "min_rows", "available", "required", "drawn", share.alias("share"), (F.col("available") >= F.col("required")).alias("filled"))


P4_FOUND_SQL = """
WITH latest AS (
  SELECT document_id, trim(lower(source)) AS source, metadata.year AS year,
         row_number() OVER (PARTITION BY document_id ORDER BY discovered_at DESC NULLS LAST, trim(lower(source)) DESC NULLS LAST, metadata.year DESC NULLS LAST) AS rn
  FROM pdf_entries WHERE document_id IS NOT NULL),
doc AS (SELECT * FROM latest WHERE rn = 1),
placed AS (
  SELECT d.document_id, coalesce(
    (SELECT min(t.cell_id) FROM sample_targets t WHERE trim(lower(t.source)) = d.source AND d.year BETWEEN t.year_from AND t.year_to),
    (SELECT min(t.cell_id) FROM sample_targets t WHERE trim(lower(t.source)) = d.source AND t.year_from IS NULL AND t.year_to IS NULL)) AS cell_id
  FROM doc d),
n AS (SELECT count(*) // 10 AS n FROM doc),
have AS (SELECT cell_id, count(*) AS available FROM placed GROUP BY cell_id)
SELECT t.cell_id FROM sample_targets t LEFT JOIN have h USING (cell_id), n
WHERE coalesce(h.available, 0) < greatest(t.min_rows, n.n * t.target_permille // 1000)
"""
