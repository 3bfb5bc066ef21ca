"""Two cameras in lockstep, on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sync_stream(a: DataFrame, b: DataFrame, offset: int, keys: list[str], fps: float, late: str = "10 seconds", slack: float = 1.0) -> DataFrame:
    """`joins.sync_join` of two streams with frame and `ts`: frame f of camera A beside frame f + offset of B, whose time is
    offset / fps later, give or take `slack` seconds. Rows wait for their partner until the watermarks tell that none can come; those
    later than `late` are dropped. Columns of B get the suffix _b."""
    left = a.withWatermark("ts", late)
    right = b.withWatermark("ts", late).select(*(F.col(k).alias(f"_{k}") for k in keys), *(F.col(c).alias(f"{c}_b") for c in b.columns if c not in keys))
    by = f"interval {abs(offset) / fps:.6f} seconds"
    here = F.col("ts") + F.expr(by) if offset >= 0 else F.col("ts") - F.expr(by)
    reach = F.expr(f"interval {slack:.6f} seconds")
    same = (F.col("frame") == F.col("frame_b") - offset) & (F.col("ts_b") >= here - reach) & (F.col("ts_b") <= here + reach)
    for k in keys:
        same &= F.col(k) == F.col(f"_{k}")
    return left.join(right, same).select(*a.columns, *(f"{c}_b" for c in b.columns if c not in keys))
