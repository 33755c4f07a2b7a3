"""Consecutive row numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from shelfscope.session import stored

_SLOT_BITS = 33  # monotonically_increasing_id: partition above, position below


def number_rows(
    df: DataFrame,
    order_by: Sequence[Column | str] = (),
    id_col: str = "id",
    after: DataFrame | None = None,
) -> DataFrame:
    """Add ``id_col`` = 1, 2, 3 ... in the given order (any order when none is given).

    The rows are range-partitioned and sorted, each notes its partition and position,
    and the result is written as Parquet so that both stay fixed. The sizes are counted from
    that one column. Only one row per partition
    (its size) is then ranked to get each partition's offset; that table has as many
    rows as there are partitions, so broadcasting it is safe. Without an order there is
    no shuffle at all.

    ``after`` is a one-row, one-column frame: numbering continues behind its value.
    """
    ordered = df.orderBy(*order_by) if order_by else df
    placed = stored(ordered.withColumn("_slot", F.monotonically_increasing_id()), "numbered", "zstd")
    part = F.shiftright("_slot", _SLOT_BITS).alias("_part")
    sizes = placed.groupBy(part).agg(F.count("*").alias("_size"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset")
    )
    if after is not None:
        base = after.toDF("_base")
        offsets = offsets.crossJoin(F.broadcast(base)).select(
            "_part", (F.col("_offset") + F.coalesce("_base", F.lit(0))).alias("_offset")
        )
    position = F.col("_slot").bitwiseAND((1 << _SLOT_BITS) - 1)
    numbered = (
        placed.withColumn("_part", F.shiftright("_slot", _SLOT_BITS))
        .join(F.broadcast(offsets), "_part")
        .withColumn(id_col, F.col("_offset") + position + 1)
    )
    keep = [c for c in df.columns if c != id_col]
    return numbered.select(id_col, *keep)
