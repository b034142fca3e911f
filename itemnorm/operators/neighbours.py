"""Exact nearest / earliest neighbour join on vectors, routed by a tree of cells.

Every left row gets its best right row (or k best) with similarity >= a bound. Only
winners leave a task; pairs are never emitted. Candidates are found exactly, without
recall loss: each right row lies in a cell of a tree (see cells), and a left row visits the group of cells
that promises most, and then only those whose bounds allow something better than what it found there.
A task holds a tile of neighbouring groups and a block of the left rows that visit any of them, both as large as TILE_BYTES of
vectors allow, and in it a left row meets the groups it visits alone. So a row is copied once per tile and not once per
group, however small the groups; tiles and visits beyond that size are split, so a hot cell becomes many bounded tasks.
Without keys rows are not even copied per tile: both sides are written once as blocks, and a task reads the pair of blocks it
compares (a cartesian product of few large rows), so what is shuffled and written grows as the rows do, though pairs grow faster.

Vectors may be shorter than 1 (means of unit vectors): the score is the dot product,
and dot(l, r) >= s implies cos(l, r) >= s, so bounds on angles stay exact.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window, functions as F

from itemnorm.operators.cells import grow_cells, measure, place_rows, tile_lists, tile_visits
from itemnorm.session import cut_lineage, scratch_path, scratch_run

BLOCK = 4096
DIGITS = 9
#: What the vectors of one side of a task may take.
TILE_BYTES = 16 << 20
#: The same without keys, where a line of a task holds a block of each side as one value, many times over on its way to the worker.
BLOCK_BYTES = 4 << 20
#: Right rows of a task's piece of the product; its square is what the piece may have of scores.
PIECE = 1024
#: Rows of a tile or of left rows that are not worth another task.
LEAST_ROWS = 512
#: Share of visited groups above which a task multiplies its tile as a whole.
DENSE = 0.25
# Functions run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _blocks(df: DataFrame, keys: Sequence[str], rows: int, out: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.ceil(F.count("*") / rows).cast("int").alias(out))


def _tile_rows(df: DataFrame, on: Sequence[str], vec: str, alone: bool = False, whole: bool = False) -> int:
    """Rows of a tile: as many as TILE_BYTES (without keys BLOCK_BYTES) hold, but fewer where the cores would have no work otherwise.

    alone: the other side is not split. whole: this side is split only where it has to be.
    """
    first = df.select(vec).limit(1).collect()
    if not first:
        return LEAST_ROWS
    held = max(1, (TILE_BYTES if on else BLOCK_BYTES) // (8 * max(1, len(first[0][0]))))
    if whole:
        return held
    largest, keys = df.groupBy(*on).agg(F.count("*").alias("n")).agg(F.max("n"), F.count("*")).first() if on else (df.count(), 1)
    tasks = max(1, 2 * df.sparkSession.sparkContext.defaultParallelism / max(1, keys))
    spread = math.ceil(tasks if alone else math.sqrt(tasks))
    return min(held, max(LEAST_ROWS, -(-(largest or 0) // spread)))


def best_neighbours(
    left: DataFrame,
    right: DataFrame,
    min_similarity: float,
    *,
    on: Sequence[str] = (),
    prefer: str = "similar",
    earlier_only: bool = False,
    skip_self: bool = False,
    strict: bool = False,
    k: int = 1,
    block: int = BLOCK,
    stored: bool = False,
) -> DataFrame:
    """on..., l_id, r_id, similarity: the best k right rows per left row.

    left(on..., l_id, l_vec), right(on..., r_id, r_vec). prefer='similar' takes the
    highest similarity (ties: smallest r_id), 'earliest' the smallest r_id.
    earlier_only keeps r_id < l_id; strict makes the bound exclusive. stored: both sides are written tables that need not be written again. The result is written; what it was made from is deleted.
    """
    spark = left.sparkSession
    path = scratch_path(spark, "neighbours")
    with scratch_run(spark):
        found = _best_neighbours(left, right, min_similarity, list(on), prefer, earlier_only, skip_self, strict, k, block, stored)
        found.write.parquet(path)
    best = spark.read.schema(found.schema).parquet(path)
    best._written = path
    return best


def _best_neighbours(
    left: DataFrame, right: DataFrame, min_similarity: float, on: list[str], prefer: str, earlier_only: bool,
    skip_self: bool, strict: bool, k: int, block: int, stored: bool,
) -> DataFrame:
    # Both sides are read many times below: sizes, cells, boxes, blocks, and the joins themselves.
    if not stored:
        left, right = cut_lineage(left), cut_lineage(right)
    # A block of left rows meets every right row in one pass, which is less than placing those in cells.
    left_count = left.count()
    cells = grow_cells(right, right.count(), block) if left_count > block else None
    order = [-F.col("similarity"), F.col("r_id")] if prefer == "similar" else [F.col("r_id")]

    def best_of(found: DataFrame) -> DataFrame:
        if k == 1:
            best = found.groupBy(*on, "l_id").agg(F.min_by(F.struct("r_id", "similarity"), F.struct(*order)).alias("b"))
            return best.select(*on, "l_id", "b.r_id", "b.similarity")
        # At most k lines per (left row, visited block) arrive here.
        w = Window.partitionBy(*on, "l_id").orderBy(*order)
        return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    # Where one side is at most a block, it is copied to the parts of the other, which stays as it is.
    few_left = cells is None and left_count <= block
    tile_rows = _tile_rows(right, on, "r_vec", alone=few_left, whole=cells is None and not few_left)
    left_rows = _tile_rows(left, on, "l_vec", alone=cells is None and not few_left, whole=few_left)

    def meet(left_tiles: DataFrame, right_tiles: DataFrame) -> DataFrame:
        return _meet(left_tiles, right_tiles, on, min_similarity, prefer, earlier_only, skip_self, strict, k, left_rows, tile_rows)

    if cells is None:
        everywhere = left.withColumn("tile", F.lit(0)).withColumn("open", F.lit(None).cast("binary"))
        return best_of(meet(everywhere, right.withColumn("tile", F.lit(0)).withColumn("spot", F.lit(0))))
    placed = cut_lineage(place_rows(right, cells))
    cells = measure(placed, cells)
    groups = len(cells.first_of_group)
    largest = right.groupBy(*on).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    per_tile = max(1, groups // -(-largest // tile_rows))
    held = placed.withColumn("tile", F.floor(F.col("cell") / per_tile).cast("int")).withColumn("spot", F.col("cell") % per_tile).drop("leaf", "angle", "cell")
    least = F.lit(float(min_similarity))
    if prefer != "similar":
        return best_of(meet(cut_lineage(tile_visits(left.withColumn("least", least), cells, per_tile)), held))
    # The most promising group first: what is found there says what others have to promise.
    own = cut_lineage(best_of(meet(cut_lineage(tile_visits(left.withColumn("least", least), cells, per_tile, own=True)), held)))
    full = own if k == 1 else own.where(F.col("rank") == k)
    found = full.select(*on, "l_id", F.greatest(F.col("similarity") - F.lit(10.0**-DIGITS), least).alias("found"))
    reaching = left.join(found, [*on, "l_id"], "left").withColumn("least", F.coalesce("found", least)).drop("found")
    if on:
        others = cut_lineage(tile_visits(reaching, cells, per_tile, own=False))
        return best_of(own.drop("rank").unionByName(meet(others, held)))
    others = cut_lineage(tile_lists(reaching, cells, per_tile))
    blocks = placed.withColumn("tile", F.floor(F.col("cell") / per_tile).cast("int"))
    return best_of(own.drop("rank").unionByName(_meet_blocks(others, blocks, per_tile, skip_self, earlier_only, strict, k, left_rows, tile_rows)))


class _Best:
    """The best k right rows of each left row so far. Right rows are known by their place in the order of ids, so a lower one wins a tie."""

    def __init__(self, rows: int, k: int, least: float | np.ndarray, strict: bool, earliest: bool) -> None:
        self.k, self.strict, self.earliest = k, strict, earliest
        self.least = np.broadcast_to(np.asarray(least, dtype=float), rows)
        self.score = np.full((rows, k), -np.inf)
        self.place = np.full((rows, k), np.iinfo(np.int64).max)

    def offer(self, rows: np.ndarray, places: np.ndarray, scores: np.ndarray, off: float = 0.0, exact: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> bool:
        """Scores of left rows against right rows; those that don't count are -inf.

        off: how far scores may be from what `exact` has for pairs of a left row and a place. False and nothing taken if it would be asked for many.
        """
        # Scores are compared rounded, so what is this far below may still tie.
        slack = 2 * (10.0**-DIGITS + off)
        top = scores.max(axis=1)
        floor = self.least[rows] if self.earliest else np.maximum(self.least[rows], self.score[rows, -1])
        some = (top >= floor - slack) & (top > -np.inf)
        if self.earliest:
            some &= self.place[rows, -1] > places[0]
        some = np.flatnonzero(some)
        if not len(some):
            return True
        if len(some) < len(rows):
            scores = scores[some]
        top, rows, floor = top[some].astype(float), rows[some], floor[some]
        if not self.earliest and self.k == 1:
            floor = np.maximum(floor, top)
        elif not self.earliest and scores.shape[1] > self.k:
            floor = np.maximum(floor, np.partition(scores, -self.k, axis=1)[:, -self.k])
        found = scores >= (floor - slack)[:, None].astype(scores.dtype)
        if self.earliest and self.k == 1:
            # What comes after one that is near beyond doubt is not the earliest.
            sure = scores >= (floor + slack)[:, None].astype(scores.dtype)
            last = np.where(sure.any(axis=1), sure.argmax(axis=1), scores.shape[1])
            found &= np.arange(scores.shape[1])[None, :] <= last[:, None]
        row, column = np.nonzero(found)
        if exact is None:
            score = np.round(scores[row, column], DIGITS)
        elif len(row) > scores.size // 16:
            return False
        else:
            score = np.round(exact(rows[row], places[column]), DIGITS)
        least = self.least[rows[row]]
        reaches = score > least if self.strict else score >= least
        row, place, score = row[reaches], places[column[reaches]], score[reaches]
        # With what was found before, in order of row and preference.
        row = np.concatenate([row, np.repeat(np.arange(len(rows)), self.k)])
        place = np.concatenate([place, self.place[rows].ravel()])
        score = np.concatenate([score, self.score[rows].ravel()])
        order = np.lexsort((place, row)) if self.earliest else np.lexsort((place, -score, row))
        row, place, score = row[order], place[order], score[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < self.k
        self.place[rows] = place[kept].reshape(-1, self.k)
        self.score[rows] = score[kept].reshape(-1, self.k)
        return True


def _compare(
    l_id: np.ndarray, left: np.ndarray, r_id: np.ndarray, right: np.ndarray, bits: np.ndarray | None, spot: np.ndarray,
    least: float | np.ndarray, prefer: str, earlier_only: bool, skip_self: bool, strict: bool, k: int,
) -> _Best:
    """Left rows against the right rows, in order of r_id, whose spot their bits allow; all of them without bits.

    Products are made in single precision, which says which pairs can count; those are made again in double precision.
    """
    best = _Best(len(l_id), k, least, strict, prefer != "similar")
    # How many right rows come before a left row, and the place of the row itself.
    before = np.searchsorted(r_id, l_id) if earlier_only or skip_self else None
    if skip_self:
        own = np.where(r_id[np.minimum(before, len(r_id) - 1)] == l_id, before, -1)

    left_single, right_single = left.astype(np.float32), right.astype(np.float32)
    longest = [float(np.linalg.norm(side, axis=1).max(initial=0)) for side in (left, right)]
    off = (left.shape[1] + 4) * 2.0**-23 * longest[0] * longest[1]

    def exact(rows: np.ndarray, places: np.ndarray) -> np.ndarray:
        scores = np.empty(len(rows))
        for n in range(0, len(rows), PIECE):
            scores[n : n + PIECE] = np.einsum("ij,ij->i", left[rows[n : n + PIECE]], right[places[n : n + PIECE]])
        return scores

    def scored(these: np.ndarray, some: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        scores = left[these] @ right[some].T
        if k > 1 and bits is not None:
            # The group met first must not give its rows twice.
            scores[~bits[these][:, spot[some]]] = -np.inf
        if earlier_only:
            scores[np.arange(len(some))[None, :] >= np.searchsorted(some, before[these])[:, None]] = -np.inf
        if skip_self:
            column = np.minimum(np.searchsorted(some, own[these]), len(some) - 1)
            mine = np.flatnonzero(some[column] == own[these])
            scores[mine, column[mine]] = -np.inf
        return scores

    def meet(rows: np.ndarray, places: np.ndarray) -> None:
        """Left rows against right rows, the latter in order, a piece of the scores at a time."""
        for r in range(0, len(places), PIECE):
            some = places[r : r + PIECE]
            step = PIECE * PIECE // len(some)
            for n in range(0, len(rows), step):
                these = rows[n : n + step]
                if not best.offer(these, some, scored(these, some, left_single, right_single), off, exact):
                    best.offer(these, some, scored(these, some, left, right))

    if bits is None or bits[:, np.unique(spot)].mean() > DENSE:
        meet(np.arange(len(l_id)), np.arange(len(r_id)))
    else:
        order = np.argsort(spot, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(spot[order])) + 1):
            meet(np.flatnonzero(bits[:, spot[places[0]]]), places)
    return best


def _meet(
    left_tiles: DataFrame, right_tiles: DataFrame, on: list[str], min_similarity: float, prefer: str, earlier_only: bool,
    skip_self: bool, strict: bool, k: int, left_rows: int, right_rows: int,
) -> DataFrame:
    """on..., l_id, r_id, similarity: the best k of every block of a tile for the left rows that visit it."""
    group = [*on, "tile"]
    right_blocks = _blocks(right_tiles, group, right_rows, "r_blocks")
    left_blocks = _blocks(left_tiles, group, left_rows, "l_blocks")
    sides = right_blocks.join(left_blocks, group)
    if not on:
        # One line per tile.
        sides = F.broadcast(sides)

    def fresh(*names: str):
        # Both sides may come from one table; new attribute ids keep the cogroup unambiguous.
        return [F.col(c).alias(c) for c in [*group, *names]]

    spread_left = (
        left_tiles.join(sides, group)
        .withColumn("lb", F.pmod(F.xxhash64("l_id"), F.col("l_blocks")).cast("int"))
        .withColumn("rb", F.explode(F.sequence(F.lit(0), F.col("r_blocks") - 1)))
        .select(*fresh("lb", "rb", "l_id", "l_vec", "open"))
    )
    spread_right = (
        right_tiles.join(sides, group)
        .withColumn("rb", F.pmod(F.xxhash64("r_id"), F.col("r_blocks")).cast("int"))
        .withColumn("lb", F.explode(F.sequence(F.lit(0), F.col("l_blocks") - 1)))
        .select(*fresh("lb", "rb", "r_id", "r_vec", "spot"))
    )

    def match(key, lpdf: pd.DataFrame, rpdf: pd.DataFrame) -> pd.DataFrame:
        names = [*on, "l_id", "r_id", "similarity"]
        if not len(lpdf) or not len(rpdf):
            return pd.DataFrame(columns=names)
        rpdf = rpdf.sort_values("r_id", kind="stable")
        l_id, r_id = lpdf["l_id"].to_numpy(), rpdf["r_id"].to_numpy()
        left, right = np.stack(lpdf["l_vec"].to_numpy()), np.stack(rpdf["r_vec"].to_numpy())
        bits = None
        if lpdf["open"].iloc[0] is not None:
            bits = np.frombuffer(b"".join(lpdf["open"]), np.uint8).reshape(len(l_id), -1)
            bits = np.unpackbits(bits, axis=1).astype(bool)
        best = _compare(l_id, left, r_id, right, bits, rpdf["spot"].to_numpy(), min_similarity, prefer, earlier_only, skip_self, strict, k)
        li, n = np.nonzero(best.score > -np.inf)
        out = {name: [key[i]] * len(li) for i, name in enumerate(on)}
        return pd.DataFrame({**out, "l_id": l_id[li], "r_id": r_id[best.place[li, n]], "similarity": best.score[li, n]}, columns=names)

    types = {f.name: f.dataType.simpleString() for f in [*left_tiles.schema.fields, *right_tiles.schema.fields]}
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in on), f"l_id {types['l_id']}", f"r_id {types['r_id']}", "similarity double"])
    parts = [*group, "lb", "rb"]
    return spread_left.groupBy(*parts).cogroup(spread_right.groupBy(*parts)).applyInPandas(match, schema)


def _packed(df: DataFrame, rows: int, names: dict[str, str], lists: str, by: str) -> DataFrame:
    """One line per block of at most about `rows` rows of a tile: tile, the ids as a list, other columns as bytes; `lists`: a column whose values are united."""
    spark = df.sparkSession
    sizes = _blocks(df, ["tile"], rows, "blocks").collect()  # one line per tile
    first, start = {}, 0
    for r in sizes:
        first[r["tile"]] = (start, r["blocks"])
        start += r["blocks"]
    dealt = df.join(F.broadcast(spark.createDataFrame([(t, *v) for t, v in first.items()], "tile int, first int, blocks int")), "tile")
    dealt = dealt.withColumn("block", F.col("first") + F.pmod(F.xxhash64(by), F.col("blocks")).cast("int")).select("tile", "block", by, *names, *([lists] if lists else []))
    id_type = df.schema[by].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(by, kind="stable")
        out = {"tile": pdf["tile"].iloc[:1].to_numpy(), by: [pdf[by].to_numpy()]}
        for name, kind in names.items():
            if kind == "bytes":
                out[name] = [b"".join(pdf[name])]
                continue
            values = np.stack(pdf[name].to_numpy()) if kind == "vector" else pdf[name].to_numpy()
            out[name] = [np.ascontiguousarray(values, dtype="int32" if kind == "int" else "float64").tobytes()]
        if lists:
            out[lists] = [np.unique(np.concatenate(pdf[lists].to_numpy())).astype("int32")]
        return pd.DataFrame(out)

    columns = [f"tile int, {by} array<{id_type}>", *(f"{n} binary" for n in names), *([f"{lists} array<int>"] if lists else [])]
    # A block is a file of its own, so that a task of the product reads one of each side.
    return cut_lineage(dealt.repartition(max(1, start), "block").groupBy("block").applyInPandas(pack, ", ".join(columns)))


def _meet_blocks(
    left: DataFrame, right: DataFrame, per_tile: int, skip_self: bool, earlier_only: bool, strict: bool, k: int, left_rows: int, right_rows: int
) -> DataFrame:
    """l_id, r_id, similarity: as `_meet` for the similar ones without keys; left rows meet the groups their bits (open) name.

    Both sides are shuffled and written once, as blocks; pairs of blocks are read, not sent.
    """
    spark = left.sparkSession
    types = {f.name: f.dataType.simpleString() for f in [*left.schema.fields, *right.schema.fields]}
    schema = f"l_id {types['l_id']}, r_id {types['r_id']}, similarity double"
    asked = _packed(left, left_rows, {"l_vec": "vector", "least": "double", "open": "bytes"}, "tiles", "l_id").drop("tile")
    held = _packed(right, right_rows, {"r_vec": "vector", "cell": "int"}, "", "r_id")
    pairs = asked.join(held, F.expr("array_contains(tiles, tile)")).select("l_id", "l_vec", "least", "open", "tile", "r_id", "r_vec", "cell")

    def match(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                line = {name: batch.column(name)[n] for name in batch.schema.names}
                l_ids, r_ids = line["l_id"].values, line["r_id"].values
                l_id, r_id = (ids.to_numpy(zero_copy_only=False) for ids in (l_ids, r_ids))
                of = lambda name, kind: np.frombuffer(line[name].as_buffer(), kind)
                left, right = of("l_vec", "float64").reshape(len(l_id), -1), of("r_vec", "float64").reshape(len(r_id), -1)
                least, cell = of("least", "float64"), of("cell", "int32")
                first = line["tile"].as_py() * per_tile
                bits = of("open", "uint8").reshape(len(l_id), -1)[:, first // 8 : (first + per_tile + 7) // 8]
                bits = np.unpackbits(bits, axis=1)[:, first % 8 : first % 8 + per_tile].astype(bool)
                some = np.flatnonzero(bits.any(axis=1))
                if not len(some):
                    continue
                best = _compare(l_id[some], left[some], r_id, right, bits[some], cell - first, least[some], "similar", earlier_only, skip_self, strict, k)
                li, place = np.nonzero(best.score > -np.inf)
                yield pa.RecordBatch.from_arrays(
                    [l_ids.take(pa.array(some[li])), r_ids.take(pa.array(best.place[li, place])), pa.array(best.score[li, place])], names=["l_id", "r_id", "similarity"]
                )

    # A line holds two blocks, so a batch is one line.
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = spark.conf.get(key)
    spark.conf.set(key, "1")
    try:
        return cut_lineage(pairs.mapInArrow(match, schema))
    finally:
        spark.conf.set(key, rows)
