"""A bounded sample of labelled points for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from itemnorm.llm.common import hash_bound, hash_place
from itemnorm.session import cut_lineage


def labelled_sample(points: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """item_id, text, label of at most `rows` labelled items, chosen by a hash of the id.

    labels(item_id, label): labels other than 0 and 1 and null ids are ignored; an item labelled more
    than once takes the majority, 1 on a tie. Only ids and labels are ranked; the texts are looked up by
    the chosen ids, a list of `rows` lines. Of points that repeat an id one takes part.
    """
    voted = cut_lineage(
        labels.select("item_id", F.col("label").cast("int").alias("label"))
        .where(F.col("item_id").isNotNull() & F.col("label").isin(0, 1))
        .groupBy("item_id")
        .agg(F.avg("label").alias("share"))
        .select("item_id", (F.col("share") >= 0.5).cast("int").alias("label"), hash_place("item_id").alias("_order"))
    )
    # The smallest hashes lie below this bound, so that about 1.5 * rows lines, and not `rows` of every task, are ranked.
    bound = hash_bound(voted.count(), 1.5 * rows + 100)
    chosen = voted.where(F.col("_order") <= bound).orderBy("_order", "item_id").limit(rows).drop("_order")
    found = points.select("item_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "item_id")
    return found.dropDuplicates(["item_id"])
