"""Numbering rows within groups without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Rows in one broadcast; beyond that the join is left to Spark.
BROADCAST_ROWS = 200_000


def ranked(rows: DataFrame, group: str, order: list[str], name: str = "ranked") -> DataFrame:
    """``rows`` with ``rank``, from 0 on, within each value of ``group`` by ``order`` (ascending, nulls first).

    Rows are range-placed by group and order and numbered where they lie; what stands before each task's part of a group comes from
    one count for each task and group. Ties are broken by the place in the input, so that even equal rows are dealt
    over many tasks; ``order`` should leave only rows tied that are alike. A null group is a group of its own.
    """
    keys = [group, *order, "__tie"]
    placed = rows.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    # the id has the task in its upper bits and the place within it in the lower 33
    numbered = staged(placed.drop("__tie").withColumn("__id", F.monotonically_increasing_id()), name)
    numbered = numbered.withColumn("__task", F.shiftright("__id", 33))
    counts = numbered.groupBy("__task", group).agg(F.min("__id").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(group).orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("__task").alias("__of"),
        F.col(group).alias("__group"),
        (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__base"),
    )
    if bases.count() <= BROADCAST_ROWS:
        bases = F.broadcast(bases)
    same = (F.col("__task") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group"))
    return numbered.join(bases, same).withColumn("rank", F.col("__id") + F.col("__base")).select(*rows.columns, "rank")
