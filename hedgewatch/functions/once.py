"""Keep expensive columns from being computed twice.

Catalyst pushes a filter on a computed column below the projection that
computes it and so evaluates the whole expression chain again. Columns produced
by a generator are not pushed, so one-element ``inline`` acts as a fence that
stays inside whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def with_columns_once(df: DataFrame, columns: dict[str, Column],
                      keep: Column | None = None) -> DataFrame:
    """Add (or replace) ``columns``, evaluating each exactly once per row.

    ``keep`` drops the rows for which it is false or NULL; it refers to columns
    of ``df``.
    """
    row = F.struct(*[c.alias(name) for name, c in columns.items()])
    rows = F.array(row)
    if keep is not None:
        rows = F.when(keep, rows).otherwise(F.slice(rows, 1, 0))
    others = [F.col(f"`{c}`") for c in df.columns if c not in columns]
    return df.select(*others, F.inline(rows))
