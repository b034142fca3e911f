"""A tree of cells over vectors, each with the box of its components, for exact pruning of similarity lookups.

A cell holds vectors near one centre, and its box the greatest and least value of every component in it, an
inverted index in small: a left vector's product with anything inside is at most the product with the
better end of each component. For sparse vectors without negative components, as hashed trigrams are, most
components of a cell are zero and the bound is close; where the angle between the left vector and the centre says less, that bound
counts. Cells are leaves of a tree grown on a sample; neighbouring leaves form groups of about a block of
rows, and a group is visited if any of its leaves can hold a match. Neighbouring groups form tiles: a left row is sent to a tile
once, with a bitmap of the groups it visits there. There are so few groups that the bitmap takes less than the vector, however small the
block and however many the rows. Bounds are computed in single precision and widened by what that may be off.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

#: What the cells of one join may take on the driver and in a broadcast: a centre and two ends of a box per cell.
CELL_BYTES = 16 << 20
#: Sampled rows of a cell.
LEAF = 4
#: Cells whose measures one call puts together.
LEAVES = 128
#: Least rows of a cell in a large table: a cell's bounds cost as much as some products.
CELL_ROWS = 16
MANY_ROWS = 1 << 15
#: Bits of a bitmap of groups per component of a vector.
GROUP_BITS = 16
SLACK = 1e-6
#: How far a product of unit vectors may be off in single precision, per component; an angle that is found from one near 1; and the sine of one.
EPS, ANGLE_EPS, SINE_EPS = 2.0**-22, 1e-2, 5e-4
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Cells:
    """Leaves in the order of the tree: centres of length 1, the group of each, and, once measured, boxes and radii."""

    centres: np.ndarray
    group: np.ndarray
    high: np.ndarray | None = None
    low: np.ndarray | None = None
    radius: np.ndarray | None = None

    def __post_init__(self) -> None:
        self.first_of_group = np.flatnonzero(np.concatenate([[True], self.group[1:] != self.group[:-1]]))

    def parts(self) -> tuple[np.ndarray | None, ...]:
        """What is broadcast: arrays alone, so executors need no copy of the package."""
        return self.centres, self.group, self.high, self.low, self.radius

    @cached_property
    def _centres(self) -> np.ndarray:
        return np.ascontiguousarray(self.centres.T, dtype=np.float32)

    @cached_property
    def _ends(self) -> tuple[np.ndarray, float]:
        """Both ends of the boxes, one below the other, and the length of the longest corner."""
        corner = np.maximum(np.abs(self.high), np.abs(self.low))
        return np.ascontiguousarray(np.hstack([self.high, self.low]).T, dtype=np.float32), float(np.linalg.norm(corner, axis=1).max(initial=0))

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of the nearest centre (or one as near in single precision), and the angle to it."""
        unit = vectors / _length(vectors)
        leaf = (unit.astype(np.float32) @ self._centres).argmax(axis=1)
        return leaf, np.arccos(np.clip(np.einsum("ij,ij->i", unit, self.centres[leaf]), -1.0, 1.0))

    def open_groups(self, vectors: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which groups can hold a product of at least `least` with each vector, and the most promising one of all."""
        width = vectors.shape[1]
        v = vectors.astype(np.float32)
        length = np.linalg.norm(vectors, axis=1, keepdims=True)
        ends, corner = self._ends
        bound = np.hstack([np.maximum(v, 0), np.minimum(v, 0)]) @ ends
        bound += (SLACK + 2 * width * EPS * corner * length).astype(np.float32)
        # cos(angle - radius) from the cosine of the angle, taken a little too great.
        cosine = (vectors / _length(vectors)).astype(np.float32) @ self._centres
        nearest = np.arccos(np.clip(cosine.max(axis=1), -1, 1))
        reach = np.where(least >= 0, np.arccos(np.clip(least, 0, 1)), np.pi) + SLACK
        # A row lies in the leaf of its own nearest centre, hence this limit.
        limit = np.cos(np.minimum(nearest + 2 * reach + ANGLE_EPS, np.pi)) - width * EPS
        open_ = cosine >= limit[:, None].astype(np.float32)
        cosine += np.float32(width * EPS)
        np.minimum(cosine, 1, out=cosine)
        near, far = np.cos(self.radius).astype(np.float32), np.sin(self.radius).astype(np.float32)
        within = cosine >= near
        sine = np.sqrt(np.maximum(1 - cosine * cosine, 0))
        cosine *= near
        sine *= far
        cosine += sine
        cosine += np.float32(SINE_EPS)
        cosine[within] = 1
        cosine *= length.astype(np.float32)
        np.minimum(bound, cosine + np.float32(SLACK), out=bound)
        bound[:, self.radius < 0] = -np.inf
        open_ &= bound >= (least - SLACK)[:, None].astype(np.float32)
        return np.logical_or.reduceat(open_, self.first_of_group, axis=1), np.maximum.reduceat(bound, self.first_of_group, axis=1).argmax(axis=1)


def _length(vectors: np.ndarray) -> np.ndarray:
    """Lengths, but 1 of a zero vector."""
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.where(length == 0, 1.0, length)


def _grow(vectors: np.ndarray, leaf: int, group_rows: float) -> tuple[np.ndarray, np.ndarray]:
    """Centres and groups: nodes are halved along the line between two far rows until they are small."""
    centres, groups = [], []
    count = 0
    stack = [(np.arange(len(vectors)), -1)]
    while stack:
        rows, group = stack.pop()
        if group < 0 and len(rows) <= max(group_rows, 1):
            group, count = count, count + 1
        if len(rows) <= leaf:
            if group < 0:
                group, count = count, count + 1
            centre = vectors[rows].mean(axis=0)
            length = np.linalg.norm(centre)
            centres.append(centre / length if length > 0 else centre)
            groups.append(group)
            continue
        held = vectors[rows]
        far = held[((held - held.mean(axis=0)) ** 2).sum(axis=1).argmax()]
        other = held[((held - far) ** 2).sum(axis=1).argmax()]
        order = np.argsort(held @ (far - other), kind="stable")
        half = len(rows) // 2
        stack += [(rows[order[half:]], group), (rows[order[:half]], group)]
    return np.array(centres), np.array(groups, dtype=np.int64)


def grow_cells(right: DataFrame, rows: int, block: int, cell_bytes: int = CELL_BYTES) -> Cells | None:
    """Cells for right(r_id, r_vec), about LEAF rows in each (CELL_ROWS where they are many) while their number fits cell_bytes, from a sample by hash; None for one block."""
    if rows <= block:
        return None
    width = len(right.select("r_vec").limit(1).collect()[0][0])
    wanted = LEAF * max(1, min(cell_bytes // (3 * 8 * width), rows // CELL_ROWS if rows > MANY_ROWS else rows))
    place = F.shiftrightunsigned(F.xxhash64("r_id"), 1)
    sample = right.select("r_vec", place.alias("h"))
    if rows > wanted:
        sample = sample.where(F.col("h") <= int((2**63 - 1) * (wanted / rows)))
    held = sample.toArrow().sort_by("h")
    if not held.num_rows:
        return None
    vectors = held["r_vec"].combine_chunks().flatten().to_numpy().reshape(held.num_rows, width).astype(np.float64)
    return Cells(*_grow(vectors, LEAF, max(block, rows / (GROUP_BITS * width)) * held.num_rows / rows))


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


def _slices(rows: int, cells: int) -> Iterator[slice]:
    """So many rows at once that a matrix of rows times cells stays small."""
    step = max(1, (1 << 20) // max(1, cells))
    return (slice(n, min(rows, n + step)) for n in range(0, rows, step))


def place_rows(right: DataFrame, cells: Cells) -> DataFrame:
    """right + leaf, cell (the group), angle."""
    shared = right.sparkSession.sparkContext.broadcast(cells.parts())

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Cells(*shared.value)
        for pdf in batches:
            for s in _slices(len(pdf), len(held.group)):
                part = pdf.iloc[s]
                leaf, angle = held.nearest(_vectors(part["r_vec"]))
                yield part.assign(leaf=leaf.astype("int32"), cell=held.group[leaf].astype("int32"), angle=angle)

    return right.mapInPandas(assign, f"{ddl(right)}, leaf int, cell int, angle double")


def _ends_by_leaf(leaf: np.ndarray, high: np.ndarray, low: np.ndarray, angle: np.ndarray) -> tuple[np.ndarray, ...]:
    """One line per leaf: greatest of high and of angle, least of low."""
    order = np.argsort(leaf, kind="stable")
    leaf = leaf[order]
    first = np.flatnonzero(np.concatenate([[True], leaf[1:] != leaf[:-1]]))
    return leaf[first], np.maximum.reduceat(high[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(angle[order], first)


def measure(placed: DataFrame, cells: Cells) -> Cells:
    """The cells with the boxes and radii of the rows in them.

    A task sends one line per cell it has seen; the lines of LEAVES cells are put together at once on the executors, so one line per cell arrives.
    """
    width = cells.centres.shape[1]
    many = len(cells.group)
    schema = "part int, leaf int, high binary, low binary, angle double"

    def lines(leaf: np.ndarray, high: np.ndarray, low: np.ndarray, angle: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"part": (leaf // LEAVES).astype("int32"), "leaf": leaf.astype("int32"), "high": [h.tobytes() for h in high], "low": [x.tobytes() for x in low], "angle": angle})

    def matrix(column: pd.Series) -> np.ndarray:
        return np.frombuffer(b"".join(column), np.float64).reshape(len(column), width)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        high, low, radius = np.full((many, width), -np.inf), np.full((many, width), np.inf), np.full(many, -1.0)
        for pdf in batches:
            if len(pdf):
                v = _vectors(pdf["r_vec"])
                leaf, top, bottom, angle = _ends_by_leaf(pdf["leaf"].to_numpy(), v, v, pdf["angle"].to_numpy())
                high[leaf], low[leaf] = np.maximum(high[leaf], top), np.minimum(low[leaf], bottom)
                radius[leaf] = np.maximum(radius[leaf], angle)
        seen = np.flatnonzero(radius >= 0)
        for n in range(0, len(seen), 1024):
            some = seen[n : n + 1024]
            yield lines(some, high[some], low[some], radius[some])

    def together(pdf: pd.DataFrame) -> pd.DataFrame:
        return lines(*_ends_by_leaf(pdf["leaf"].to_numpy(), matrix(pdf["high"]), matrix(pdf["low"]), pdf["angle"].to_numpy()))

    found = placed.select("leaf", "r_vec", "angle").mapInPandas(partial, schema).groupBy("part").applyInPandas(together, schema).toPandas()
    high, low, radius = np.zeros((many, width)), np.zeros((many, width)), np.full(many, -1.0)
    if len(found):
        leaf = found["leaf"].to_numpy()
        high[leaf], low[leaf] = matrix(found["high"]), matrix(found["low"])
        radius[leaf] = found["angle"].to_numpy() + SLACK
    # A centre of length 0 says nothing about angles.
    radius[(radius >= 0) & (np.linalg.norm(cells.centres, axis=1) == 0)] = np.pi
    return Cells(cells.centres, cells.group, high, low, radius)


def visits(left: DataFrame, cells: Cells, own: bool | None = None) -> DataFrame:
    """left(l_vec, least, ...) without least, and one line per group that can hold a product of at least `least`.

    own: only the most promising group, or all the others.
    """
    groups = cells.group[cells.first_of_group].astype("int32")

    def listed(part: pd.DataFrame, open_: np.ndarray) -> pd.DataFrame:
        return part.assign(cells=[groups[o] for o in open_])

    routed = _routed(left, cells, own, listed, "cells array<int>")
    return routed.withColumn("cell", F.explode("cells")).drop("cells", "least")


def tile_visits(left: DataFrame, cells: Cells, per_tile: int, own: bool | None = None) -> DataFrame:
    """As `visits`, but one line per tile of `per_tile` groups: tile, and in open a bit for each group visited there."""
    tiles = -(-len(cells.first_of_group) // per_tile)

    def marked(part: pd.DataFrame, open_: np.ndarray) -> pd.DataFrame:
        whole = np.zeros((len(part), tiles * per_tile), bool)
        whole[:, : open_.shape[1]] = open_
        whole = whole.reshape(len(part), tiles, per_tile)
        row, tile = np.nonzero(whole.any(axis=2))
        bits = np.packbits(whole[row, tile], axis=1)
        return part.iloc[row].assign(tile=tile.astype("int32"), open=[b.tobytes() for b in bits])

    return _routed(left, cells, own, marked, "tile int, open binary").drop("least")


def tile_lists(left: DataFrame, cells: Cells, per_tile: int) -> DataFrame:
    """left(l_vec, least, ...) with the tile of the most promising group, a bit for each other group that can hold a product of at
    least `least` (open), and the tiles of those groups; rows without any go."""
    shared = left.sparkSession.sparkContext.broadcast(cells.parts())
    starts = np.arange(0, len(cells.first_of_group), per_tile)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Cells(*shared.value)
        for pdf in batches:
            for s in _slices(len(pdf), len(held.group)):
                part = pdf.iloc[s]
                open_, best = held.open_groups(_vectors(part["l_vec"]), part["least"].to_numpy())
                open_[np.arange(len(part)), best] = False
                tiles = np.logical_or.reduceat(open_, starts, axis=1)
                some = tiles.any(axis=1)
                if not some.any():
                    continue
                listed = [np.flatnonzero(t).astype("int32") for t in tiles[some]]
                bits = [b.tobytes() for b in np.packbits(open_[some], axis=1)]
                yield part[some].assign(open=bits, tile=(best[some] // per_tile).astype("int32"), tiles=listed)

    return left.mapInPandas(route, f"{ddl(left)}, open binary, tile int, tiles array<int>")


def _routed(left: DataFrame, cells: Cells, own: bool | None, put, columns: str) -> DataFrame:
    """put(rows, which groups each row visits) over all rows."""
    shared = left.sparkSession.sparkContext.broadcast(cells.parts())

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = Cells(*shared.value)
        for pdf in batches:
            for s in _slices(len(pdf), len(held.group)):
                part = pdf.iloc[s]
                open_, best = held.open_groups(_vectors(part["l_vec"]), part["least"].to_numpy())
                if own is not None:
                    mine = np.zeros(open_.shape, bool)
                    mine[np.arange(len(part)), best] = True
                    open_ &= mine if own else ~mine
                yield put(part, open_)

    return left.mapInPandas(route, f"{ddl(left)}, {columns}")


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
