"""Computed columns that filters must not repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def computed_once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add ``columns``, each evaluated exactly once per row.

    A filter on a projected column is normally moved below the projection, with
    the column's expression copied into it at every use. That is right for a
    cheap expression; a set of text patterns would be scanned again. A filter
    is not moved below a generator, so the columns are made by one that yields
    a single row.
    """
    kept = [c for c in rows.columns if c not in columns]
    packed = F.array(F.struct(*(column.alias(name) for name, column in columns.items())))
    return rows.select(*kept, F.inline(packed))
