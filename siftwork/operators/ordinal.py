"""Global ordinals and batches without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.session import checkpointed


def with_ordinal(df: DataFrame, order: list[str], to: str) -> DataFrame:
    """``df`` with 1, 2, 3, ... in the column ``to``, in the order of ``order`` (unique).

    Rows are range-partitioned and sorted within partitions; the offsets come from one count per
    partition, and that table is what is broadcast.
    """
    s = checkpointed(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    counts = s.groupBy(part.alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_o"))
    own = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return s.withColumn("_p", part).join(F.broadcast(offsets), "_p").withColumn(to, F.col("_o") + own + 1).drop("_m", "_p", "_o")


def rank_in_group(df: DataFrame, group: str, order: list[str], to: str) -> DataFrame:
    """1, 2, 3, ... within each group, also for a group that holds much of the table.

    The group is spread over partitions by its order columns; a row's rank is its global ordinal
    less the group's smallest one.
    """
    numbered = with_ordinal(df, [group, *order], "_g")
    first = numbered.groupBy(group).agg(F.min("_g").alias("_f"))
    return numbered.join(first, group).withColumn(to, (F.col("_g") - F.col("_f") + 1).cast("int")).drop("_g", "_f")


def numbered_id(n: Column | str, prefix: str, digits: int = 5) -> Column:
    """``prefix`` and the number with leading zeros; longer numbers keep all their digits."""
    text = F.col(n).cast("string") if isinstance(n, str) else n.cast("string")
    return F.concat(F.lit(prefix), F.when(F.length(text) < digits, F.lpad(text, digits, "0")).otherwise(text))


def batches(df: DataFrame, order: list[str], size: int, to: str = "batch") -> DataFrame:
    """Consecutive batches of ``size`` rows, numbered from 0."""
    return with_ordinal(df, order, "_i").withColumn(to, F.floor((F.col("_i") - 1) / size).cast("int")).drop("_i")
