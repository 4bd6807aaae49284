"""Folds of documents by the CRC-32 of their id, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, by: int) -> Column:
    """crc32 of the id as text, modulo by; of a null id, that of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(by))


def about(rows: DataFrame, label: str, id_col: str, most: int) -> tuple[DataFrame, dict]:
    """About most rows of each label, chosen by a hash of the id, and how many rows each has in all.

    The share to keep comes from a count over all rows, so the sample is bounded
    whatever the table's size; all rows are kept while a label has most or fewer.
    """
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    keep = F.lit(False)
    for value, n in counts.items():
        keep = keep | ((F.col(label) == F.lit(value)) & (F.pmod(F.xxhash64(F.lit(17), id_col), F.lit(1 << 30)) < int((1 << 30) * min(1.0, most / n))))
    return rows.filter(keep), counts
