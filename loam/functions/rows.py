"""Columns of a table that are computed once for each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with the columns, each computed once for each row. As a plain column, an expression is copied into every filter behind it,
    once for each place where it is named, and copies of copies multiply; nothing is moved through a generator."""
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    rest = [c for c in df.columns if c not in columns]
    order = [*df.columns, *[c for c in columns if c not in df.columns]]
    return df.select(*rest, F.inline(F.array(row))).select(*order)
