"""Sums over ordered groups of any size: ranges of the order side by side, each after the sums of those before it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.sources.folders import written

PART = "_part"


def ranged(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    """``rows`` cut into ranges of (``by``, ``order``), numbered in ``_part``; equal places share a range.

    A group of any size spans as many ranges as it fills. They are written, so a lost task can't cut them otherwise.
    """
    cut = rows.repartitionByRange(*by, *order).withColumn(PART, F.spark_partition_id())
    return written(cut, "ranged")


def running_before(cut: DataFrame, by: list[str], order: list[str], sums: dict[str, Column]) -> DataFrame:
    """``cut`` (from ``ranged``) with each of ``sums`` over the rows of its group before the row, in ``order``.

    A window holds one range of one group, or one row a range of a group.
    """
    totals = cut.groupBy(*by, PART).agg(*[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    earlier = W.partitionBy(*by).orderBy(PART).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(*by, PART, *[F.coalesce(F.sum(f"_{name}").over(earlier), F.lit(0)).alias(f"_{name}") for name in sums])
    inside = W.partitionBy(*by, PART).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    own = cut.withColumns({name: F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()})
    both = own.join(base, [*by, PART])
    return both.withColumns({name: F.col(name) + F.col(f"_{name}") for name in sums}).drop(*[f"_{name}" for name in sums])


def uncrossed(rows: DataFrame, start: str, end: str, actions: DataFrame) -> DataFrame:
    """``rows`` (entity, ``start``, ``end``, ...) that no action (entity, effective) crosses: start < effective <= end.

    A sweep: ends and actions lie in one order of time, and each end sees the last action up to it, which crosses if it
    lies after the start. Time grows with rows and actions of an entity, not with their product.
    """
    names = [c for c in rows.columns if c != "entity"]
    marks = actions.where("entity IS NOT NULL AND effective IS NOT NULL").select("entity", F.col("effective").alias("_at"))
    kind = rows.schema[end].dataType
    ends = rows.select("entity", F.col(end).alias("_at"), F.struct(*names).alias("_row"))
    both = ends.unionByName(marks.withColumn("_at", F.col("_at").cast(kind)), allowMissingColumns=True)
    so_far = W.partitionBy("entity").orderBy("_at").rangeBetween(W.unboundedPreceding, W.currentRow)  # its own day too
    last = F.max(F.when(F.col("_row").isNull(), F.col("_at"))).over(so_far)
    swept = both.withColumn("_last", last).where("_row IS NOT NULL")
    free = F.coalesce(F.col("_last") <= F.col("_row")[start], F.lit(True))
    return swept.where(free).select("entity", "_row.*").select(*rows.columns)
