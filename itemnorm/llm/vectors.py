"""Vector tables of the two search operators: usable rows, and equal vectors as one class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def usable(vec: Column) -> Column:
    """Not null, not empty, no null, no non-finite component."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad, F.lit(False))


def vector_classes(points: DataFrame, ids: int) -> DataFrame:
    """class_id, vec, item_ids: one line per distinct vector with its `ids` smallest item ids.

    points(item_id, vec). class_id is the smallest id. A vector that very many rows share is cut to its
    smallest ids before the shuffle, and no answer of up to `ids` rows can need another one. Rows that
    repeat an id with its vector count once.
    """
    ranked = points.withColumn("_n", F.dense_rank().over(Window.partitionBy("vec").orderBy("item_id"))).where(F.col("_n") <= ids)
    return ranked.groupBy("vec").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids")).select(
        F.col("item_ids")[0].alias("class_id"), "vec", "item_ids"
    )
