"""Approximate nearest neighbours: multiprobe p-stable hashing with exact reranking.

A table hashes a vector to the cell floor((a_j . x + b_j) / width) of its `hashes` Gaussian projections a_j.
Two points at distance r differ by a normal variable of spread r in every projection, so for an item the
chance that a neighbour at that distance lies in a perturbed cell is a product of normal interval
masses. Cells are visited in that order of estimated success until their chances add up to what a table
has to find. The radius r of the first visit is the median over a few sampled points of the distance to their k-th neighbour
among all points. It is too small for items in thin regions, so each item whose k-th found point is farther than that visits
again with this distance as its own radius; it is no less than that of its k-th neighbour, so the estimate
errs on the side of more cells. An item whose considered cells cannot reach the chance is compared with all.

Points are stored once per table, in parts of whole cells. Only distances to points of visited cells are computed,
and a part is copied once per item_block of the items that visit it, so copies follow the visits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from itemnorm.llm.common import hash_bound, hash_place, id_type
from itemnorm.llm.vectors import usable, vector_classes
from itemnorm.session import cut_lineage

TABLES = 2
HASHES = 6
#: Cell width in radii; shifts of a cell's coordinate that are considered.
WIDTH = 1.5
SHIFTS = (-2, -1, 0, 1, 2)
#: Chance that a neighbour at the radius lies in a visited cell of some table.
SUCCESS = 0.96
#: Sampled points of each dimension whose k-th neighbour is looked up among all points.
SAMPLE_ITEMS = 64
POINT_BLOCK = 4096
ITEM_BLOCK = 2048


def _erf(x: np.ndarray) -> np.ndarray:
    return np.frompyfunc(math.erf, 1, 1)(x).astype(float)


def sample_radii(classes: DataFrame, k: int) -> dict[int, float]:
    """Per number of components the median distance of SAMPLE_ITEMS points to their k-th neighbour, in one pass over all points.

    The sample are the points of the smallest hashes; a task sends the k + 1 smallest distances of each.
    Where points have fewer neighbours, the farthest counts; 1 where there is none.
    """
    spark = classes.sparkSession
    sizes = {r["dims"]: r["n"] for r in classes.groupBy(F.size("vec").alias("dims")).agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return {}
    bounds = spark.createDataFrame([(d, hash_bound(n, 1.5 * SAMPLE_ITEMS + 100)) for d, n in sizes.items()], "dims int, bound bigint")
    near = classes.select("vec", F.size("vec").alias("dims"), hash_place("class_id").alias("order"), "class_id").join(F.broadcast(bounds), "dims")
    chosen: dict[int, list] = {}
    for row in near.where(F.col("order") <= F.col("bound")).orderBy("order", "class_id").toLocalIterator():
        held = chosen.setdefault(row["dims"], [])
        if len(held) < SAMPLE_ITEMS:
            held.append(row["vec"])
    shared = spark.sparkContext.broadcast({d: np.array(rows, float) for d, rows in chosen.items()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            lengths = np.array(batch.column("vec").value_lengths())
            for d in np.unique(lengths):
                rows = np.flatnonzero(lengths == d)
                y, x = _matrix(batch.column("vec").take(pa.array(rows)), len(rows)), shared.value[int(d)]
                square = np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0)
                held = np.concatenate([best[d], square], axis=1) if d in best else square
                best[d] = np.partition(held, k, axis=1)[:, : k + 1] if held.shape[1] > k + 1 else held
        for d, held in best.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(held.size, d, np.int32)), pa.array(np.repeat(np.arange(len(held)), held.shape[1])), pa.array(np.sqrt(held.ravel()))], names=["dims", "item", "distance"]
            )

    found = classes.select("vec").mapInArrow(run, "dims int, item bigint, distance double")
    nth = Window.partitionBy("dims", "item").orderBy("distance")
    kth = found.withColumn("n", F.row_number().over(nth)).where(F.col("n") <= k + 1).groupBy("dims", "item").agg(F.max("distance").alias("distance"))
    return {r["dims"]: r["radius"] or 1.0 for r in kth.groupBy("dims").agg(F.median("distance").alias("radius")).collect()}


class StableHash:
    """The projections of all tables for vectors of one dimension; the same for the same arguments."""

    def __init__(self, dims: int, radius: float, tables: int, hashes: int, seed: int):
        rng = np.random.default_rng([seed, dims])
        self.radius, self.width = radius, WIDTH * radius
        self.directions = rng.standard_normal((tables, dims, hashes))
        self.offsets = rng.uniform(0, self.width, (tables, hashes))

    def positions(self, x: np.ndarray, table: int) -> np.ndarray:
        return (x @ self.directions[table] + self.offsets[table]) / self.width

    def cells(self, x: np.ndarray, table: int) -> np.ndarray:
        return np.floor(self.positions(x, table)).astype(np.int64)

    def probes(self, x: np.ndarray, table: int, chance: float, radii: np.ndarray | None = None) -> Iterator[np.ndarray | None]:
        """Cells of each row of x, likeliest first, until their chances reach `chance`; None if all do not.

        radii: of each row, in place of the table's.
        """
        at = self.positions(x, table)
        home = np.floor(at).astype(np.int64)
        edges = np.array([*SHIFTS, SHIFTS[-1] + 1])[None, None, :] - (at - home)[:, :, None]
        spread = self.width / (np.full(len(x), self.radius) if radii is None else radii)
        mass = np.diff(0.5 * (1 + _erf(edges * spread[:, None, None] / math.sqrt(2))), axis=2)
        shifts = np.stack(np.meshgrid(*[SHIFTS] * at.shape[1], indexing="ij"), -1).reshape(-1, at.shape[1])
        for own, p in zip(home, mass):
            if p.sum(1).prod() < chance:
                yield None
                continue
            joint = p[0]
            for one in p[1:]:
                joint = (joint[:, None] * one[None, :]).ravel()
            order = np.argsort(-joint, kind="stable")
            n = int(np.searchsorted(np.cumsum(joint[order]), chance)) + 1
            yield own + shifts[order[:n]]


def _matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(float).reshape(rows, -1)


def exact_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of paired rows, squares added in the order of the components."""
    total = np.zeros(len(x))
    for c in range(x.shape[1]):
        d = x[:, c] - y[:, c]
        total += d * d
    return np.sqrt(total)


def nearest_points(
    items: DataFrame, points: DataFrame, k: int, skip_self: bool = False, tables: int = TABLES, hashes: int = HASHES,
    success: float = SUCCESS, seed: int = 7, item_block: int = ITEM_BLOCK, point_block: int = POINT_BLOCK,
) -> DataFrame:
    """item_idx, rank, item_id, score: the k nearest points found per item, ties to the smaller id.

    items(item_idx, vec_local), points(item_id, vec_local): real vectors; score is the Euclidean distance of
    the original vectors in double precision. Every usable point is indexed. An item meets points of as
    many components as it has. With skip_self a point with the item's own id is left out, and both ids
    have one type. Rows whose vector or id is null, or whose vector is empty, zero or holds null or
    non-finite components, take no part. An item visits again by its own distance of the k-th found point where
    that is above the radius of the sample; one whose visited cells hold fewer than k points, or whose
    distance is too large for the cells, is compared with all. Repeated rows count once; equal vectors are indexed once.
    """
    spark = points.sparkSession
    take = k + 1 if skip_self else k
    id_kind, idx_kind = id_type(points), id_type(items, "item_idx")
    nonzero = F.exists("vec", lambda x: x != 0)
    given = items.select("item_idx", F.col("vec_local").alias("vec")).where(F.col("item_idx").isNotNull() & usable(F.col("vec")) & nonzero).distinct()
    offered = points.select("item_id", F.col("vec_local").alias("vec")).where(F.col("item_id").isNotNull() & usable(F.col("vec")) & nonzero)
    classes = cut_lineage(vector_classes(offered, take))
    asked = cut_lineage(given.groupBy("vec").agg(F.min("item_idx").alias("asked_id")))

    hashing = {d: StableHash(d, radius, tables, hashes, seed) for d, radius in sample_radii(classes, k).items()}
    chance = 1 - (1 - success) ** (1 / tables)

    def by_dims(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, StableHash]]:
        sizes = np.array(batch.column("vec").value_lengths())
        for d in np.unique(sizes):
            rows = np.flatnonzero(sizes == d)
            if int(d) in hashing:
                yield rows, _matrix(batch.column("vec").take(pa.array(rows)), len(rows)), hashing[int(d)]

    def hash_points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x, own in by_dims(batch):
                for t in range(tables):
                    ids = batch.column("class_id").take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [ids, pa.array(np.full(len(rows), x.shape[1], np.int32)), pa.array(np.full(len(rows), t, np.int32)), pa.array(own.cells(x, t).tolist(), pa.list_(pa.int64()))], names=["class_id", "dims", "table", "cell"]
                    )

    def probe_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The cells to visit; one line without a cell for an item that no cells are enough for."""
        for batch in batches:
            for rows, x, own in by_dims(batch):
                ids = batch.column("asked_id").take(pa.array(rows)).to_pylist()
                reach = batch.column("reach").take(pa.array(rows)).to_numpy(zero_copy_only=False)  # of null: NaN
                wide = np.flatnonzero(~(reach <= own.radius))
                ids, x, reach = [ids[n] for n in wide], x[wide], np.where(np.isnan(reach), own.radius, reach)[wide]
                for i, *found in zip(ids, *(own.probes(x, t, chance, reach) for t in range(tables))):
                    if any(cells is None for cells in found):
                        found = [None]
                    for t, cells in enumerate(found):
                        n, cells = (1, [None]) if cells is None else (len(cells), cells.tolist())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([i] * n, batch.column("asked_id").type), pa.array(np.full(n, x.shape[1], np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(cells, pa.list_(pa.int64()))], names=["asked_id", "dims", "table", "cell"]
                        )

    hashed = cut_lineage(classes.select("class_id", "vec").mapInArrow(hash_points, f"class_id {id_kind}, dims int, table int, cell array<bigint>"))
    total = classes.groupBy(F.size("vec").alias("dims")).agg(F.ceil(F.count("*") / point_block).cast("bigint").alias("parts"))
    # A cell's number, and in how many parts its points lie: a cell of more than a block is split.
    cells = cut_lineage(
        hashed.groupBy("dims", "table", "cell").agg(F.count("*").alias("n")).join(F.broadcast(total), "dims")
        .select("dims", "table", "cell", F.monotonically_increasing_id().alias("cell_id"), F.ceil(F.col("n") / point_block).cast("bigint").alias("splits"), "parts")
    )
    part = F.pmod(F.xxhash64("cell_id", "split"), F.col("parts")).alias("part")
    indexed = hashed.join(cells, ["dims", "table", "cell"]).withColumn("split", F.pmod(F.xxhash64("class_id"), F.col("splits")))
    indexed = cut_lineage(indexed.select("class_id", "table", "dims", part, "cell_id").join(classes.select("class_id", "vec"), "class_id"))

    def probes(wanted: DataFrame) -> DataFrame:
        return wanted.select("asked_id", "vec", "reach").mapInArrow(probe_items, f"asked_id {idx_kind}, dims int, table int, cell array<bigint>")

    def visits(probed: DataFrame) -> DataFrame:
        return (
            probed.join(cells, ["dims", "table", "cell"])
            .withColumn("split", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("splits") - 1)))
            .select("asked_id", "dims", "table", part, "cell_id")
            .groupBy("asked_id", "dims", "table", "part").agg(F.collect_set("cell_id").alias("visited"))
        )

    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    nothing = pa.table([pa.array([], arrow[idx_kind]), pa.array([], arrow[id_kind]), pa.array([], pa.float64())], names=["asked_id", "class_id", "score"])

    def rerank(a: pa.Table, b: pa.Table) -> pa.Table:
        """The nearest `take` of the part per item, equal distances included."""
        if not a.num_rows or not b.num_rows:
            return nothing
        b = b.sort_by("cell_id")
        y = _matrix(b["vec"], b.num_rows)
        names, starts = np.unique(b["cell_id"].to_numpy(), return_index=True)
        ends = np.append(starts[1:], b.num_rows)
        norms, out = (y**2).sum(1), []
        x = _matrix(a["vec"], a.num_rows)
        for n, own in enumerate(a["visited"].to_pylist()):
            if own is None:  # every cell
                j = np.arange(b.num_rows)
            else:
                at = np.searchsorted(names, own)
                j = np.concatenate([np.arange(starts[c], ends[c]) for c in at])
            square = norms[j] - 2 * (y[j] @ x[n]) + (own_norm := (x[n] ** 2).sum())
            m = min(take, len(j))
            # Rounding in the product form may reorder near ties; all within its error are computed exactly.
            j = j[square <= np.partition(square, m - 1)[m - 1] + 1e-9 * (norms[j].max() + own_norm)]
            out.append((np.full(len(j), n), j, exact_distances(np.broadcast_to(x[n], (len(j), x.shape[1])), y[j])))
        i, j, score = (np.concatenate(c) for c in zip(*out))
        return pa.table([a["asked_id"].take(pa.array(i)), b["class_id"].take(pa.array(j)), pa.array(score)], names=["asked_id", "class_id", "score"])

    schema = f"asked_id {idx_kind}, class_id {id_kind}, score double"

    def compare(wanted: DataFrame) -> DataFrame:
        """wanted(asked_id, dims, table, part, visited): a part meets its visitors in blocks of item_block."""
        wanted = cut_lineage(wanted)
        place = ["dims", "table", "part"]
        blocks = wanted.groupBy(*place).agg(F.ceil(F.count("*") / item_block).cast("bigint").alias("blocks"))
        visitors = wanted.join(blocks, place).withColumn("block", F.pmod(F.xxhash64("asked_id"), F.col("blocks"))).join(own, "asked_id")
        copies = indexed.join(blocks.select(*[F.col(c).alias(c) for c in place], "blocks"), place).withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
        key = [*place, "block"]
        a = visitors.select(*key, "asked_id", "vec", "visited").groupBy(*key)
        return a.cogroup(copies.select(*key, "class_id", "vec", "cell_id").groupBy(*key)).applyInArrow(rerank, schema)

    own = asked.select("asked_id", "vec")
    found = cut_lineage(compare(visits(probes(asked.withColumn("reach", F.lit(None).cast("double"))))).distinct())
    # Each item's own radius, and what it has to visit again for that.
    nth = Window.partitionBy("asked_id").orderBy("score", "class_id")
    enough = found.withColumn("n", F.row_number().over(nth)).where(F.col("n") == take).select("asked_id", F.col("score").alias("reach"))
    again = cut_lineage(probes(asked.join(enough, "asked_id")))
    found = found.union(compare(visits(again.where("cell is not null"))))
    # The rest: items for which the visited cells held too few, or whose radius is too large for them.
    enough = enough.select("asked_id").join(again.where("cell is null").select("asked_id"), "asked_id", "left_anti")
    places = indexed.where("table = 0").select("dims", "part").distinct()
    rest = own.withColumn("dims", F.size("vec")).join(enough, "asked_id", "left_anti").join(places, "dims").select(
        "asked_id", "dims", F.lit(0).alias("table"), "part", F.lit(None).cast("array<bigint>").alias("visited")
    )
    merged = found.union(compare(rest)).distinct()
    best = Window.partitionBy("asked_id").orderBy("score")
    kept = merged.withColumn("n", F.rank().over(best)).where(F.col("n") <= take)
    rows = kept.join(classes.select("class_id", "item_ids"), "class_id").select("asked_id", "score", F.explode("item_ids").alias("item_id"))
    final = Window.partitionBy("asked_id").orderBy("score", "item_id")
    top = rows.withColumn("n", F.row_number().over(final)).where(F.col("n") <= take)
    answers = given.join(asked, "vec").select("item_idx", "asked_id").join(top, "asked_id")
    if skip_self:
        answers = answers.where(F.col("item_idx") != F.col("item_id"))
    ranked = answers.withColumn("rank", F.row_number().over(Window.partitionBy("item_idx").orderBy("score", "item_id")))
    return ranked.where(F.col("rank") <= k).select("item_idx", "rank", "item_id", "score")
