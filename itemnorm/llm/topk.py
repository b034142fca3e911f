"""Exact top-k by inner product with a three-phase uniform threshold.

A vector is cut in slices; a slice's inner products with an item are one list of local scores, and a
point's score is the sum over the lists. Phase 1 gathers the k best of every list and scores those
points exactly: the k-th best of them is a cutoff that the true k-th score reaches. A point whose every
local score is below cutoff / lists cannot reach the cutoff, so phase 2 sends the cutoffs to all
lists and collects every entry from that uniform threshold up. Phase 3 asks for the exact score of every
collected point whose known scores plus the threshold for the missing lists reach the cutoff.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from itemnorm.llm.common import id_type
from itemnorm.llm.vectors import usable, vector_classes
from itemnorm.session import cut_lineage

SCALE = 256
LISTS = 2
#: Distinct items and distinct points whose scores a task holds at once.
ITEM_BLOCK = 256
POINT_BLOCK = 4096


def quantised(vec: F.Column, scale: int = SCALE) -> F.Column:
    """floor(scale * x) of every component, x as double."""
    return F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))


def _matrix(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy().reshape(rows, -1) if rows else np.empty((0, 0), np.int64)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows; in floating point where every sum stays below 2**53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 2**53:
        return (a.astype(float) @ b.astype(float).T).astype(np.int64)
    return a @ b.T


def _slices(dims: int, lists: int) -> list[slice]:
    cuts = np.linspace(0, dims, min(lists, dims) + 1).astype(int)
    return [slice(int(a), int(b)) for a, b in zip(cuts, cuts[1:])]


class _Tiles:
    """Blocks of distinct items against blocks of distinct points with as many components."""

    def __init__(self, items: DataFrame, points: DataFrame, item_block: int, point_block: int):
        sizes = points.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("points"))
        asked = items.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("items"))
        grid = cut_lineage(
            asked.join(sizes, "dims").select(
                "dims", F.ceil(F.col("items") / item_block).cast("bigint").alias("item_blocks"), F.ceil(F.col("points") / point_block).cast("bigint").alias("point_blocks")
            )
        )
        self.items = self._blocked(items, grid, "asked_id", "item_blocks", "item_block", "point_blocks", "point_block")
        self.points = self._blocked(points, grid, "class_id", "point_blocks", "point_block", "item_blocks", "item_block")

    @staticmethod
    def _blocked(df: DataFrame, grid: DataFrame, key: str, own_blocks: str, own: str, other_blocks: str, other: str) -> DataFrame:
        return (
            df.withColumn("dims", F.size("vec"))
            .join(grid, "dims")
            .withColumn(own, F.pmod(F.xxhash64(key), F.col(own_blocks)))
            .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other_blocks) - 1)))
            .drop(own_blocks, other_blocks)
        )

    def run(self, items: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        key = ["dims", "item_block", "point_block"]
        return items.groupBy(*key).cogroup(self.points.groupBy(*key)).applyInArrow(lambda a, b: fn(a, b), schema)


def top_k_points(
    items: DataFrame, points: DataFrame, k: int, lists: int = LISTS, skip_self: bool = False,
    item_block: int = ITEM_BLOCK, point_block: int = POINT_BLOCK,
) -> DataFrame:
    """item_idx, rank, item_id, score: the k points of highest score per item, ties to the smaller id.

    items(item_idx, vec_local), points(item_id, vec_local): integer vectors, see `quantised`; score is
    the inner product. An item meets points of as many components as it has. With skip_self a point with
    the item's own id is left out, and both ids have one type. Rows whose vector or id is null, or whose
    vector is empty or holds null or non-finite components, take no part. Fewer than k points are all
    returned; repeated rows count once. Equal vectors are compared once.
    """
    take = k + 1 if skip_self else k
    id_kind = id_type(points)
    given = items.select("item_idx", F.col("vec_local").alias("vec")).where(F.col("item_idx").isNotNull() & usable(F.col("vec"))).distinct()
    offered = points.select("item_id", F.col("vec_local").alias("vec")).where(F.col("item_id").isNotNull() & usable(F.col("vec")))
    classes = cut_lineage(vector_classes(offered, take))
    vectors = classes.select("class_id", "vec")
    asked = cut_lineage(given.groupBy("vec").agg(F.min("item_idx").alias("asked_id")))
    tiles = _Tiles(asked, vectors, item_block, point_block)
    asked_kind = id_type(given, "item_idx")

    def gather(a: pa.Table, b: pa.Table) -> pa.Table:
        """Phase 1: the best `take` of every list of the tile."""
        out = []
        if a.num_rows and b.num_rows:
            x, y = _matrix(a["vec"], a.num_rows), _matrix(b["vec"], b.num_rows)
            for n, s in enumerate(_slices(x.shape[1], lists)):
                p = _product(x[:, s], y[:, s])
                m = min(take, p.shape[1])
                best = np.argpartition(-p, m - 1, axis=1)[:, :m]
                rows = np.repeat(np.arange(len(x)), m)
                cols = best.ravel()
                out.append(pa.table([a["asked_id"].take(pa.array(rows)), pa.array(np.full(len(rows), n, np.int32)), b["class_id"].take(pa.array(cols)), pa.array(p[rows, cols])], names=["asked_id", "list", "class_id", "local"]))
        return pa.concat_tables(out) if out else empty_lists

    lists_schema = f"asked_id {asked_kind}, list int, class_id {id_kind}, local bigint"
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}
    empty_lists = pa.table({"asked_id": pa.array([], arrow[asked_kind]), "list": pa.array([], pa.int32()), "class_id": pa.array([], arrow[id_kind]), "local": pa.array([], pa.int64())})

    def resolve(pairs: DataFrame) -> DataFrame:
        """Exact scores of (asked_id, class_id) pairs, computed where the point's block is."""
        in_block = pairs.join(tiles.points.where("item_block = 0").select("class_id", "dims", "point_block"), "class_id")
        wanted = in_block.groupBy("asked_id", "dims", "point_block").agg(F.collect_list("class_id").alias("wanted"))
        sent = tiles.items.join(wanted, ["asked_id", "dims", "point_block"])

        def score(a: pa.Table, b: pa.Table) -> pa.Table:
            if not a.num_rows or not b.num_rows:
                return empty_scores
            at = {c: n for n, c in enumerate(b["class_id"].to_pylist())}
            x, y = _matrix(a["vec"], a.num_rows), _matrix(b["vec"], b.num_rows)
            ids, scores = [], []
            asked_ids = a["asked_id"].to_pylist()
            for n, own in enumerate(a["wanted"].to_pylist()):
                scores.append(_product(x[n : n + 1], y[[at[c] for c in own]])[0])
                ids += [(asked_ids[n], c) for c in own]
            return pa.table([pa.array([i for i, _ in ids], arrow[asked_kind]), pa.array([c for _, c in ids], arrow[id_kind]), pa.array(np.concatenate(scores))], names=["asked_id", "class_id", "score"])

        return tiles.run(sent, score, f"asked_id {asked_kind}, class_id {id_kind}, score bigint")

    empty_scores = pa.table({"asked_id": pa.array([], arrow[asked_kind]), "class_id": pa.array([], arrow[id_kind]), "score": pa.array([], pa.int64())})

    # Phase 1.
    by_list = Window.partitionBy("asked_id", "list").orderBy(F.desc("local"), "class_id")
    local = tiles.run(tiles.items, gather, lists_schema).withColumn("n", F.row_number().over(by_list)).where(F.col("n") <= take)
    first = cut_lineage(resolve(local.select("asked_id", "class_id").distinct()))
    by_score = Window.partitionBy("asked_id").orderBy(F.desc("score"), "class_id")
    # With fewer points than asked for there is no cutoff: everything is collected.
    cutoffs = first.withColumn("n", F.row_number().over(by_score)).where(F.col("n") == take).select("asked_id", F.col("score").alias("cutoff"))

    def collect(a: pa.Table, b: pa.Table) -> pa.Table:
        """Phase 2: every entry of a list that reaches the item's uniform threshold."""
        out = []
        if a.num_rows and b.num_rows:
            x, y = _matrix(a["vec"], a.num_rows), _matrix(b["vec"], b.num_rows)
            parts = _slices(x.shape[1], lists)
            cutoff = a["cutoff"].to_pylist()
            for n, s in enumerate(parts):
                p = _product(x[:, s], y[:, s])
                least = np.array([np.iinfo(np.int64).min if c is None else -(-c // len(parts)) for c in cutoff], np.int64)
                rows, cols = np.nonzero(p >= least[:, None])
                out.append(pa.table([a["asked_id"].take(pa.array(rows)), pa.array(np.full(len(rows), n, np.int32)), b["class_id"].take(pa.array(cols)), pa.array(p[rows, cols])], names=["asked_id", "list", "class_id", "local"]))
        return pa.concat_tables(out) if out else empty_lists

    # Phase 2. An entry below the threshold is at most the largest integer under it.
    sent = tiles.items.join(cutoffs, "asked_id", "left")
    entries = tiles.run(sent, collect, lists_schema)
    known = entries.join(asked.select("asked_id", F.least(F.size("vec"), F.lit(lists)).alias("parts")), "asked_id").groupBy("asked_id", "class_id", "parts").agg(
        F.sum("local").alias("known"), F.count("*").alias("lists")
    )
    below = -F.floor(-F.col("cutoff") / F.col("parts")) - 1
    bound = F.col("known") + (F.col("parts") - F.col("lists")) * below
    hopeful = known.join(cutoffs, "asked_id", "left").where(F.col("cutoff").isNull() | (bound >= F.col("cutoff")))
    hopeful = cut_lineage(hopeful.select("asked_id", "class_id", F.when(F.col("lists") == F.col("parts"), F.col("known")).alias("score")))

    # Phase 3: points known in all lists have their score already.
    scored = hopeful.where("score is not null").union(resolve(hopeful.where("score is null").select("asked_id", "class_id")))
    best = Window.partitionBy("asked_id").orderBy(F.desc("score"))
    kept = scored.withColumn("n", F.rank().over(best)).where(F.col("n") <= take)
    rows = kept.join(classes.select("class_id", "item_ids"), "class_id").select("asked_id", "score", F.explode("item_ids").alias("item_id"))
    final = Window.partitionBy("asked_id").orderBy(F.desc("score"), "item_id")
    top = rows.withColumn("n", F.row_number().over(final)).where(F.col("n") <= take)
    answers = given.join(asked, "vec").select("item_idx", "asked_id").join(top, "asked_id")
    if skip_self:
        answers = answers.where(F.col("item_idx") != F.col("item_id"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("item_idx").orderBy(F.desc("score"), "item_id")))
    return ranked.where(F.col("rank") <= k).select("item_idx", "rank", "item_id", "score")
