"""Named queries of the training-data operators, and the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliomill.llm.p1_truncation import p1_found, p1_share
from foliomill.llm.p2_pairs import p2_found, p2_labels
from foliomill.llm.p3_overlap import p3_found, p3_report
from foliomill.llm.p4_sample import P4_FOUND_SQL, p4_found, p4_report, p4_sample
from foliomill.llm.p5_scans import p5_found, p5_text
from foliomill.llm.p6_encode import p6_ids, p6_sizes
from foliomill.llm.p7_mix import p7_full, p7_full_shares, p7_mix, p7_shares
from foliomill.llm.p8_residue import p8_found, p8_kept


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": p1_found,
        "p1_share": p1_share,
        "p2_found": p2_found,
        "p2_labels": p2_labels,
        "p3_found": p3_found,
        "p3_report": p3_report,
        "p4_found": p4_found,
        "p4_sample": p4_sample,
        "p4_report": p4_report,
        "p5_found": p5_found,
        "p5_text": p5_text,
        "p6_ids": p6_ids,
        "p6_sizes": p6_sizes,
        "p7_mix": p7_mix,
        "p7_shares": p7_shares,
        "p7_full": p7_full,
        "p7_full_shares": p7_full_shares,
        "p8_found": p8_found,
        "p8_kept": p8_kept,
    }


def oracle_sql() -> dict[str, str]:
    return {"p4_found": P4_FOUND_SQL}
