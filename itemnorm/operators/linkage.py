"""Average-linkage clustering by cosine distance, as rounds of DataFrame joins.

For unit vectors the mean pairwise distance of two clusters is 1 - mean(A).mean(B), so
a cluster is (sum of vectors, count). Average linkage is reducible: all pairs that are
each other's nearest can merge in the same round, and a merge makes nothing nearer to a third cluster than
the nearer of its two parts was. So a cluster keeps its nearest one until that takes part in a merge, and
a round looks up only the new clusters and those that lost their nearest. Once no more than a
block of clusters is left, one task finishes that bounded remainder.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from itemnorm.functions.vectors import unit
from itemnorm.operators.neighbours import BLOCK, DIGITS, best_neighbours
from itemnorm.session import cut_lineage, drop_written

DISTANCE_THRESHOLD = 0.2
#: Products of a look-up that are fewer than what cells would cost.
DIRECT = 1 << 29
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def cluster_items(
    items: DataFrame, vec: str = "vec", threshold: float = DISTANCE_THRESHOLD, block: int = BLOCK,
    on_round: Callable[[int, int], None] | None = None,
) -> DataFrame:
    """item_idx, cluster_id for items(item_idx, vec). cluster_id is the smallest item_idx inside.

    Two clusters merge while their mean distance is below the threshold. A zero vector
    is at distance 1 from everything and stays alone. Needs a threshold <= 1.
    on_round hears of every round how many clusters are open and how many of them were looked up.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be in (0, 1]")
    units = items.select("item_idx", unit(vec).alias("u"))
    usable = units.where(F.col("u").isNotNull())
    # Copies of one vector are at distance 0 and always end up together.
    nodes = cut_lineage(usable.groupBy("u").agg(F.min("item_idx").alias("node"), F.count("*").alias("n")))
    state = nodes.select("node", F.transform("u", lambda v: v * F.col("n")).alias("total"), "n")
    # marked: the nearest of each cluster as known from the round before, null where it has to be looked up (again).
    merges = marked = None
    while (open_count := state.count()) > block:
        means = state.select("node", F.transform("total", lambda v: v / F.col("n")).alias("mean"))
        dirty = None if marked is None else marked.where("r_id is null").select(F.col("l_id").alias("node"))
        asked = means if dirty is None else means.join(dirty, "node", "left_semi")
        asked_count = open_count if dirty is None else dirty.count()
        if on_round is not None:
            on_round(open_count, asked_count)
        # Few products are made at once, without cells; and groups of cells need not be as small as the remainder that one task finishes.
        direct = asked_count if asked_count * open_count <= DIRECT else 0
        found = best_neighbours(
            asked.select(F.col("node").alias("l_id"), F.col("mean").alias("l_vec")),
            means.select(F.col("node").alias("r_id"), F.col("mean").alias("r_vec")),
            1.0 - threshold,
            skip_self=True,
            strict=True,
            block=max(block, BLOCK, direct),
        )
        nearest = found.select("l_id", "r_id")
        if marked is not None:
            nearest = nearest.unionByName(marked.where("r_id is not null"))
        back = nearest.select(F.col("l_id").alias("r_id"), F.col("r_id").alias("l_id"))
        pairs = nearest.join(back, ["l_id", "r_id"]).where(F.col("l_id") < F.col("r_id")).select(
            F.col("l_id").alias("keep"), F.col("r_id").alias("gone")
        )
        pairs = cut_lineage(pairs)
        if pairs.isEmpty():
            break
        merges = pairs if merges is None else merges.unionByName(pairs)
        # A cluster without a partner inside the threshold gets none by merges of
        # others, whose mean distance to it lies between theirs. It is final and looked up no more.
        before = state
        state = state.join(nearest.select(F.col("l_id").alias("node")), "node", "left_semi")
        absorbed = pairs.join(state.withColumnRenamed("node", "gone"), "gone").select(
            F.col("keep").alias("node"), F.col("total").alias("t2"), F.col("n").alias("n2")
        )
        state = cut_lineage(
            state.join(pairs.select(F.col("gone").alias("node")), "node", "left_anti")
            .join(absorbed, "node", "left")
            .select(
                "node",
                F.when(F.col("t2").isNull(), F.col("total"))
                .otherwise(F.zip_with("total", "t2", lambda a, b: a + b))
                .alias("total"),
                (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n"),
            )
        )
        # Only clusters whose nearest took part in a merge, and the merged ones themselves, are looked up again.
        known = marked
        touched = pairs.select(F.explode(F.array("keep", "gone")).alias("r_id"), F.lit(True).alias("touched"))
        kept = nearest.join(touched.select(F.col("r_id").alias("l_id")), "l_id", "left_anti").join(touched, "r_id", "left")
        merged = pairs.select(F.col("keep").alias("l_id"), F.lit(None).cast("bigint").alias("r_id"))
        marked = cut_lineage(kept.select("l_id", F.when(F.col("touched").isNull(), F.col("r_id")).alias("r_id")).unionByName(merged))
        drop_written(before, found, known)
    else:
        rest = cut_lineage(
            state.withColumn("all", F.lit(0)).groupBy("all").applyInPandas(_finisher(threshold), "keep bigint, gone bigint")
        )
        merges = rest if merges is None else merges.unionByName(rest)
    roots = resolve_roots(merges) if merges is not None else None
    labelled = nodes if roots is None else nodes.join(roots, "node", "left")
    root = F.col("node") if roots is None else F.coalesce("root", "node")
    by_vector = labelled.select("u", root.alias("cluster_id"))
    grouped = usable.join(by_vector, "u").select("item_idx", "cluster_id")
    alone = units.where(F.col("u").isNull()).select("item_idx", F.col("item_idx").alias("cluster_id"))
    return grouped.unionByName(alone)


def _finisher(threshold: float):
    """The same rounds on a bounded set of clusters inside one task."""

    def finish(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("node")
        node = pdf["node"].to_numpy()
        total = np.stack(pdf["total"].to_numpy()).astype(np.float64)
        n = pdf["n"].to_numpy().astype(np.float64)
        alive = np.arange(len(node))
        keep, gone = [], []
        while len(alive) > 1:
            mean = total[alive] / n[alive, None]
            score = np.round(mean @ mean.T, DIGITS)
            np.fill_diagonal(score, -np.inf)
            best = score.argmax(axis=1)
            ok = score[np.arange(len(alive)), best] > 1.0 - threshold
            low = np.flatnonzero(ok & (best[best] == np.arange(len(alive))) & (np.arange(len(alive)) < best))
            if not len(low):
                break
            a, b = alive[low], alive[best[low]]
            total[a] += total[b]
            n[a] += n[b]
            keep.extend(node[a])
            gone.extend(node[b])
            alive = np.setdiff1d(alive, b, assume_unique=True)
        return pd.DataFrame({"keep": np.array(keep, dtype="int64"), "gone": np.array(gone, dtype="int64")})

    return finish


def resolve_roots(merges: DataFrame) -> DataFrame:
    """node -> root for a forest of (keep, gone) edges, by pointer jumping."""
    link = cut_lineage(merges.select(F.col("gone").alias("node"), F.col("keep").alias("root")))
    while True:
        up = link.select(F.col("node").alias("root"), F.col("root").alias("above"))
        jumped = cut_lineage(
            link.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root"), F.col("above").isNotNull().alias("moved"))
        )
        link = jumped.drop("moved")
        if jumped.where("moved").isEmpty():
            return link
