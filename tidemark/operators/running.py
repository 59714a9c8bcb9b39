"""Running totals over a global order without a single partition for all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the order that are summed apart, at most; their totals are what one task and the broadcast hold.
RANGES = 4096


def running_before(df: DataFrame, order: str, measures: dict[str, Column], by: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """``df`` with a column for each measure: its sum over the rows before this one in ``order`` (within ``by``).

    Rows are summed within ranges of ``order``; at most ``RANGES`` totals for
    each group are summed up in their turn and joined back, so the order is
    total but the work is spread.
    """
    by, ties = by or [], ties or []
    low, high = df.agg(F.min(order), F.max(order)).head()
    if low is None:
        return df.select("*", *(F.lit(0).cast("bigint").alias(m) for m in measures))
    width = max(1, -(-(int(high) - int(low) + 1) // RANGES))
    ranged = df.withColumn("__range", F.floor((F.col(order) - F.lit(low)) / width).cast("int"))
    totals = ranged.groupBy(*by, "__range").agg(*(F.sum(c).alias(f"__t_{m}") for m, c in measures.items()))
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "__range", *(F.coalesce(F.sum(f"__t_{m}").over(before), F.lit(0)).alias(f"__b_{m}") for m in measures))
    inside = Window.partitionBy(*by, "__range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.select("*", *(F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__i_{m}") for m, c in measures.items())).join(F.broadcast(totals) if not by else totals, [*by, "__range"])
    return out.select(*(F.col(f"`{c}`") for c in df.columns), *((F.col(f"__i_{m}") + F.col(f"__b_{m}")).cast("bigint").alias(m) for m in measures))
