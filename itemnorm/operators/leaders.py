"""Greedy leader grouping: rows in order join the first leader within reach, else lead.

The outcome is the lexicographically first independent set. Clusters of at most a block of distinct vectors are decided by one
bounded task each. Larger ones are decided in steps of their rows in order, a block or as many more as PREFIX_ROWS and STEP_BYTES allow: the
rows of a step look up the earliest leader of the steps before, and a task per cluster decides about them, since what comes before a row
is a known leader or in the same task. Rows are written once by step, so a round reads its step and the leaders.
Where most rows of a step have found a leader, all rows after it look up theirs at once: those that join are gone, and the others
are dealt to steps anew. So a group of near-copies costs one look-up, and a row that finds no leader costs its own step.
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
from itemnorm.operators.ordering import batch_number
from itemnorm.session import cut_lineage, drop_written, scratch_path

DISTANCE_LIMIT = 0.15
#: Stands for no leader; no position is as large.
NONE = 2**63 - 1
#: Rows of a step of a cluster, which one task decides about, where vectors are narrow and the block is smaller.
PREFIX_ROWS = 16384
#: What the vectors of such a step may take.
STEP_BYTES = 32 << 20
#: Rows of a step that are decided before the rows after them are compared with their leaders, all at once.
PART_ROWS = 256
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def leader_groups(
    entries: DataFrame,
    vec: str = "vec",
    limit: float = DISTANCE_LIMIT,
    *,
    key: str = "cluster_id",
    pos: str = "pos",
    block: int = BLOCK,
    on_round: Callable[[int], None] | None = None,
) -> DataFrame:
    """key, pos, leader_pos: pos of the row's leader (itself for a leader).

    on_round hears of every round over clusters beyond a block how many rows are undecided. Zero vectors are at distance 1 from everything and lead alone. Needs a limit < 1.
    """
    if not 0 <= limit < 1:
        raise ValueError("limit must be in [0, 1)")
    units = entries.select(key, F.col(pos).alias("pos"), unit(vec).alias("u"))
    usable = units.where(F.col("u").isNotNull())
    firsts = cut_lineage(usable.groupBy(key, "u").agg(F.min("pos").alias("pos")))
    sizes = firsts.groupBy(key).agg(F.count("*").alias("n"))
    sized = firsts.join(sizes, key)
    least = round(1.0 - limit, 12)
    key_type = firsts.schema[key].dataType.simpleString()
    decided = (
        sized.where(F.col("n") <= block)
        .drop("n")
        .groupBy(key)
        .applyInPandas(_decider(key, least), f"`{key}` {key_type}, pos bigint, leader_pos bigint")
    )
    if not sizes.where(F.col("n") > block).isEmpty():
        big = cut_lineage(sized.where(F.col("n") > block).drop("n"))
        decided = decided.unionByName(_decide_in_rounds(big, key, least, block, on_round))
    decided = cut_lineage(decided.join(firsts, [key, "pos"]))
    copies = usable.join(decided.select(key, "u", "leader_pos"), [key, "u"]).select(key, "pos", "leader_pos")
    alone = units.where(F.col("u").isNull()).select(key, "pos", F.col("pos").alias("leader_pos"))
    return copies.unionByName(alone)


def _decider(key: str, least: float):
    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos = pdf["pos"].to_numpy()
        u = np.stack(pdf["u"].to_numpy()).astype(np.float64)
        leader = np.full(len(pos), -1, dtype=np.int64)
        while (open_ := np.flatnonzero(leader < 0)).size:
            head = open_[0]
            near = np.round(u[open_] @ u[head], DIGITS) >= least
            near[0] = True
            leader[open_[near]] = head
        return pd.DataFrame({key: pdf[key].to_numpy(), "pos": pos, "leader_pos": pos[leader]})

    return decide


def _in_steps(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows(key, pos, u) + step: consecutive rows of a key, `size` of them at most. Written once, in folders by step."""
    spark = rows.sparkSession
    numbered = batch_number(rows.select(key, "pos"), [key], "pos", size, "step").select(key, "pos", F.col("step").cast("int").alias("step"))
    placed = rows.join(numbered, [key, "pos"])
    path = scratch_path(spark, "steps")
    # A step of a key is one file, else every task would leave one for every step, and the driver has to know them all.
    placed.repartition(key, "step").write.partitionBy("step").parquet(path)
    steps = spark.read.schema(placed.select(key, "pos", "u", "step").schema).parquet(path)
    steps._written = path
    return steps


def _prefix_decider(key: str, least: float):
    """Rows in order: the earliest of the leader known before and the near new leaders, else a new leader."""

    def decide(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        pos = pdf["pos"].to_numpy()
        u = np.stack(pdf["u"].to_numpy()).astype(np.float64)
        known = pdf["leader"].to_numpy()
        # The earliest leader inside the task each row is near to; leaders come in order, so the first one stays.
        inside = np.full(len(pos), -1, dtype=np.int64)
        leader = np.empty(len(pos), dtype=np.int64)
        for start in range(0, len(pos), PART_ROWS):
            part = u[start : start + PART_ROWS]
            end = start + len(part)
            near = np.round(part @ part.T, DIGITS) >= least
            leads = []
            for n in range(start, end):
                found = min(known[n], pos[inside[n]] if inside[n] >= 0 else NONE)
                leader[n] = pos[n] if found == NONE else found
                if found == NONE:
                    leads.append(n)
                    after = np.flatnonzero((inside[n + 1 : end] < 0) & near[n - start, n + 1 - start :]) + n + 1
                    inside[after] = n
            if leads:
                for first in range(end, len(pos), 4 * PART_ROWS):
                    rows = np.arange(first, min(len(pos), first + 4 * PART_ROWS))
                    rows = rows[inside[rows] < 0]
                    near = np.round(u[rows] @ u[leads].T, DIGITS) >= least
                    some = near.any(axis=1)
                    inside[rows[some]] = np.array(leads)[near[some].argmax(axis=1)]
        return pd.DataFrame({key: pdf[key].to_numpy(), "pos": pos, "leader_pos": leader})

    return decide


class _Growing:
    """A table that only grows: what is added is written once, beside what is there."""

    def __init__(self, like: DataFrame) -> None:
        self.schema, self.spark = like.schema, like.sparkSession
        self.path = scratch_path(self.spark, "grown")

    def add(self, rows: DataFrame) -> None:
        rows.write.mode("append").parquet(self.path)

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def _decide_in_rounds(big: DataFrame, key: str, least: float, block: int, on_round: Callable[[int], None] | None = None) -> DataFrame:
    key_type = big.schema[key].dataType.simpleString()
    prefix = max(block, min(PREFIX_ROWS, STEP_BYTES // (8 * max(1, len(big.select("u").first()[0])))))
    decided = _Growing(big.select(key, "pos", F.col("pos").alias("leader_pos")))

    def earliest(left: DataFrame, left_count: int, right: DataFrame) -> DataFrame:
        """The earliest leader each row is near to; all leaders come before the rows. The larger side is split, the other one copied to its parts."""
        return best_neighbours(
            left.select(key, F.col("pos").alias("l_id"), F.col("u").alias("l_vec")),
            right.select(key, F.col("pos").alias("r_id"), F.col("u").alias("r_vec")),
            least,
            on=[key],
            prefer="earliest",
            block=min(left_count, right.count()),
            stored=True,
        ).select(key, F.col("l_id").alias("pos"), F.col("r_id").alias("leader"))

    rest, sweeping = big, True
    while rest is not None:
        steps, rest = _in_steps(rest, key, prefix), None
        sizes = dict(steps.groupBy("step").count().collect())  # one line per step
        # Leaders that the rows of these steps have not been compared with.
        leaders = _Growing(big.select(key, "pos", "u"))
        for step in sorted(sizes):
            rows = steps.where(F.col("step") == step).drop("step")
            after = sum(n for s, n in sizes.items() if s > step)
            if on_round is not None:
                on_round(sizes[step] + after)
            known = None
            looked = rows.withColumn("leader", F.lit(NONE))
            if step:
                known = earliest(rows, sizes[step], leaders.table())
                looked = rows.join(known, [key, "pos"], "left").withColumn("leader", F.coalesce("leader", F.lit(NONE)))
            done = cut_lineage(looked.groupBy(key).applyInPandas(_prefix_decider(key, least), f"`{key}` {key_type}, pos bigint, leader_pos bigint"))
            decided.add(done)
            if after:
                leaders.add(rows.join(done.where("leader_pos = pos").select(key, "pos"), [key, "pos"], "left_semi"))
            most = known is not None and after and sweeping and 2 * known.count() > sizes[step]
            drop_written(known, done)
            if most:
                tail = steps.where(F.col("step") > step).drop("step")
                found = earliest(tail, after, leaders.table())
                decided.add(found.withColumnRenamed("leader", "leader_pos"))
                rest = cut_lineage(tail.join(found, [key, "pos"], "left_anti"))
                # Rows whose order misleads are not looked up all at once again.
                sweeping = 2 * rest.count() <= after
                drop_written(found)
                break
        drop_written(steps)
    return decided.table()
