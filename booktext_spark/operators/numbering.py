"""Places of rows in groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from booktext_spark.storage import stored


def numbered(rows: DataFrame, by: str, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """rows with their place in each group, from 1, by `order`; ties go in no fixed order, so order should tell rows apart.

    Rows are dealt out by ranges of group and order, so that a group that holds a third of them is in many tasks, and stored once, compressed, in
    that order. A row's place is its number in the range, less the group's first there, plus what the group has in ranges before; so rows
    are shuffled once and no window goes over them. Null groups are one group; an empty table stays empty.
    """
    dealt = rows.repartitionByRange(F.col(by), *order).sortWithinPartitions(F.col(by), *order)
    dealt = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "numbered").withColumn("__range", F.shiftright("__at", 33))
    counted = dealt.groupBy(by, "__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range of a group
    counted = counted.select(F.col(by).alias("__by"), F.col("__range").alias("__of"), (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first") + 1).alias("__add"))
    joined = dealt.join(counted, dealt[by].eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__of")))
    return joined.select(*[dealt[c] for c in rows.columns], (F.col("__at") + F.col("__add")).cast("int").alias(name))
