"""Small tables whose rows become many: dealt out before they grow, since Spark plans tasks by the bytes of a file."""

from __future__ import annotations

from pyspark.sql import DataFrame


def dealt(rows: DataFrame, each: int, *near: str) -> DataFrame:
    """Rows in tasks of about ``each``, in order of the columns ``near``, so that neighbours come to one task.

    The last of ``near`` should tell rows apart: then many rows at one place are cut like any others.
    The rows are counted first.
    """
    return rows.repartitionByRange(max(1, -(-rows.count() // each)), *near)


def dealt_by(rows: DataFrame, each: int, *keys: str) -> DataFrame:
    """Rows in tasks of about ``each`` by a hash of the columns ``keys``: what they grow into stays there for a join by these keys."""
    return rows.repartition(max(1, -(-rows.count() // each)), *keys)
