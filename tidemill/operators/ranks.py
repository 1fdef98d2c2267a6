"""Ranks of rows in an order, overall or inside groups, without a task that holds a whole group.

Rows are range-partitioned and sorted once; a row's rank is its place in its partition plus what the partitions before
hold of its group. A group with most of the rows is cut over many partitions like any other rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.session import stage

#: (Partition, group) counts that are sent to every task; with more of them the join shuffles.
BROADCAST_COUNTS = 200_000


def ranked(rows: DataFrame, order: list[Column], group: tuple[str, ...] = (), name: str = "rank") -> DataFrame:
    """The rows with ``name``: how many rows of the same group come before (ties in the order are broken anyhow, so give a unique one)."""
    n_parts = max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    keys = [*map(F.col, group), *order]
    placed = rows.repartitionByRange(n_parts, *keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id())
    # written once, so that a repeated task cannot number rows anew; the upper bits of the number are the partition's
    placed = stage(placed, "ranked").withColumn("_part", F.shiftrightunsigned("_at", 33))
    counts = placed.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy(F.lit(0), *group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_p"), *(F.col(g).alias(f"_g{k}") for k, g in enumerate(group)), (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_offset"))
    offsets = stage(offsets, "offsets")
    if offsets.count() <= BROADCAST_COUNTS:
        offsets = F.broadcast(offsets)
    same = F.col("_part") == F.col("_p")
    for k, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{k}"))
    return placed.join(offsets, same).withColumn(name, F.col("_at") + F.col("_offset")).select(*rows.columns, name)
