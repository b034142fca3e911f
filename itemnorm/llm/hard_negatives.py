"""Hard negatives for memory points by Fagin's threshold algorithm.

A block of points keeps one candidate list per dimension, sorted by the points' components. For an anchor the
lists are read in parallel from the end that its component's sign makes the best; every point met is scored
at once by random access to its whole vector, in integers. What has not been met after some depth scores at most
the threshold, the anchor's product with the components at that depth. Reading stops once the threshold
falls strictly below the k-th score of everything that is still asked for, so ties are met too.

Two passes: an anchor's best points of its own label are its positives; each positive opens a window of scores for
points of other labels. A pass first goes over a fixed share of the points, and the k-th scores found
there bound the pass over all others, so that the rows sent on do not grow with points times anchors. Points stay
where they are; anchors travel to them in slices of at most ANCHOR_BYTES.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from itemnorm.llm.best import BestRows
from itemnorm.llm.common import arrow_rows, id_type
from itemnorm.llm.vectors import usable
from itemnorm.session import cut_lineage

ANCHOR_BYTES = 16 << 20
BLOCK = 4096
#: One of so many points is searched first, for the k-th scores that bound the search of the others.
SEED_OF = 16
FIRST_DEPTH, DEPTH_GROWTH = 16, 2
NOTHING = np.iinfo(np.int64).min
ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


class CandidateLists:
    """The candidate lists of one block: per dimension the points by their component, greatest first and least first."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors
        order = np.argsort(vectors, axis=0, kind="stable").T.astype(np.int32)
        values = np.take_along_axis(vectors.T, order, 1)
        self.order = np.concatenate([order[:, ::-1], order])
        self.values = np.concatenate([values[:, ::-1], values])
        self.top = float(np.abs(vectors).max(initial=0))
        self.floats = vectors.astype(float)

    def scores(self, rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Exact integer products; in floating point where every sum stays below 2**53."""
        if self.top * float(np.abs(anchor).max(initial=0)) * len(anchor) < 2**53:
            return (self.floats[rows] @ anchor.astype(float)).astype(np.int64)
        return self.vectors[rows] @ anchor

    def read(self, anchor: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """Points met for the first time, their scores, and the most that a point not met yet can score."""
        points = len(self.vectors)
        dims = np.flatnonzero(anchor)
        weights = anchor[dims]
        if not len(dims):
            yield np.arange(points), np.zeros(points, np.int64), NOTHING
            return
        lists = dims + len(anchor) * (weights < 0)
        met = np.zeros(points, bool)
        depth, step, left = 0, FIRST_DEPTH, points
        while left:
            upto = min(points, depth + step)
            new = np.zeros(points, bool)
            new[self.order[lists, depth:upto].ravel()] = True
            new &= ~met
            rows = np.flatnonzero(new)
            met |= new
            left -= len(rows)
            yield rows, self.scores(rows, anchor), int(weights @ self.values[lists, upto - 1]) if left else NOTHING
            depth, step = upto, step * DEPTH_GROWTH


class _Found:
    """What a task has found: the k best scores of every group, which bound what is still wanted, and the rows."""

    def __init__(self, least: np.ndarray, k: int, id_kind: pa.DataType):
        self.k, self.least = k, least
        self.best = np.full((len(least), k), NOTHING)
        self.kept = BestRows(k, id_kind)
        self.pending: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def wanted(self, groups: np.ndarray) -> np.ndarray:
        """A score per group that its k-th best row reaches, as far as known."""
        return np.maximum(self.least[groups], self.best[groups].min(axis=1))

    def offer(self, groups: np.ndarray, scores: np.ndarray, inside: np.ndarray) -> None:
        """scores of different rows, inside: which count for which group."""
        held = np.concatenate([self.best[groups], np.where(inside, scores, NOTHING)], axis=1)
        self.best[groups] = np.partition(held, held.shape[1] - self.k, axis=1)[:, -self.k :]

    def take(self, groups: np.ndarray, rows: np.ndarray, scores: np.ndarray, inside: np.ndarray) -> None:
        group, place = np.nonzero(inside & (scores >= self.wanted(groups)[:, None]))
        if len(group):
            self.pending.append((groups[group], rows[place], scores[place]))

    def end_of(self, part: pa.RecordBatch, own_ids: pa.Array | None = None) -> None:
        """Every id of the classes taken from this batch, but for the groups' own ids."""
        if self.pending:
            group, rows, score = (np.concatenate(c) for c in zip(*self.pending))
            ids = part["item_ids"].take(pa.array(rows))
            sizes = np.diff(ids.offsets.to_numpy())
            group, score, flat = np.repeat(group, sizes), np.repeat(score, sizes), ids.flatten()
            if own_ids is not None:
                other = pc.not_equal(flat, own_ids.take(pa.array(group)))
                flat, other = flat.filter(other), other.to_numpy(zero_copy_only=False)
                group, score = group[other], score[other]
            self.kept.add(group, score, flat)
            self.pending = []


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch]]:
    """dims, labels, vectors, lines of each batch, one block per number of components."""
    for batch in batches:
        dims = np.array(batch["dims"])
        for n in np.unique(dims):
            part = batch.filter(pa.array(dims == n))
            yield int(n), part["cluster_name"].to_numpy(zero_copy_only=False), part["vec"].flatten().to_numpy().reshape(part.num_rows, -1), part


def hard_negatives(
    anchors: DataFrame, points: DataFrame, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, *,
    anchor_bytes: int = ANCHOR_BYTES, block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    anchors and points: (item_id, cluster_name, vec_local) with integer vectors; a score is an inner product, higher
    scores come first, ties by the smaller id. The positives of an anchor are its first `positives`
    points of the same cluster_name, other ids only. For each the first `negatives` points of another cluster_name whose score lies
    between low and high percent of the positive's are returned; a positive that has none is absent.

    Rows with a null id, cluster_name or vector, or with an empty vector or null components, take no part; vectors of
    different length never meet. Rows that repeat id, cluster_name and vector count once, rows that
    repeat only the id are points of their own. Equal vectors of one cluster are scored once. Empty tables give no rows.
    """
    spark = points.sparkSession
    id_kind = id_type(points)

    def usable_rows(df: DataFrame) -> DataFrame:
        rows = df.select("item_id", "cluster_name", F.col("vec_local").alias("vec"))
        return rows.where(F.col("item_id").isNotNull() & F.col("cluster_name").isNotNull() & usable(F.col("vec"))).withColumn("dims", F.size("vec"))

    ids = max(positives + 1, negatives)
    of_class = Window.partitionBy("cluster_name", "vec").orderBy("item_id")
    ranked = usable_rows(points).withColumn("_n", F.dense_rank().over(of_class)).where(F.col("_n") <= ids)
    classes = ranked.groupBy("cluster_name", "vec", "dims").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    classes = classes.withColumn("seed", F.pmod(F.xxhash64("vec"), F.lit(SEED_OF)) == 0)
    # Blocks of one label, and a label of very many points in many of them.
    classes = cut_lineage(classes.repartitionByRange("dims", "cluster_name", F.xxhash64("vec")).sortWithinPartitions("dims", "cluster_name"))
    asked = cut_lineage(usable_rows(anchors).distinct())
    size = asked.agg(F.sum(F.col("dims") * 8)).first()[0] or 0
    slices = max(1, math.ceil(size / anchor_bytes))
    out = None
    for n in range(slices):
        lines = asked.where(F.pmod(F.xxhash64("item_id", "vec"), F.lit(slices)) == n).toArrow()
        with arrow_rows(spark, block):
            found = _mine(spark, _Anchors(lines), classes, id_kind, positives, negatives, low, high)
        out = found if out is None else out.unionByName(found)
    return out


class _Anchors:
    """A slice of anchors as every task holds it."""

    def __init__(self, lines: pa.Table):
        self.ids = lines["item_id"].combine_chunks()
        self.labels = lines["cluster_name"].to_numpy()
        self.dims = lines["dims"].to_numpy()
        self.vectors = [np.asarray(v, np.int64) for v in lines["vec"].to_numpy()]


def _mine(spark, anchors: _Anchors, classes: DataFrame, id_kind: str, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    schema = f"group bigint, score bigint, item_id {id_kind}"
    arrow_kind = ARROW[id_kind]
    order = Window.partitionBy("group").orderBy(F.desc("score"), "item_id")

    def top(k: int, found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    def two_rounds(k: int, groups: int, searcher: Callable[[object], Callable]) -> DataFrame:
        """The seeds first; the k-th scores they give bound the search of all other classes."""
        def search(part: DataFrame, least: np.ndarray) -> DataFrame:
            return part.drop("seed").mapInArrow(searcher(spark.sparkContext.broadcast(least)), schema)

        least = np.full(groups, NOTHING)
        first = cut_lineage(top(k, search(classes.where("seed"), least)))
        for row in first.where(F.col("rank") == k).select("group", "score").toLocalIterator():  # at most one line per group of the slice
            least[row["group"]] = row["score"]
        return cut_lineage(top(k, first.drop("rank").unionByName(search(classes.where("not seed"), least))))

    shared = spark.sparkContext.broadcast(anchors)
    many = len(anchors.vectors)
    best = two_rounds(positives, many, lambda least: _same_label(shared, least, positives, arrow_kind))
    # A window per anchor and positive: at most `positives` lines per anchor of the slice.
    held = best.select("group", "rank", "score").toArrow()
    group, score = held["group"].to_numpy(), held["score"].to_numpy()
    window = group * positives + held["rank"].to_numpy() - 1
    lows, highs = np.full(many * positives, 1, np.int64), np.zeros(many * positives, np.int64)
    lows[window], highs[window] = -(-(score * low) // 100), (score * high) // 100
    bounds = spark.sparkContext.broadcast((lows, highs))
    mined = two_rounds(negatives, many * positives, lambda least: _other_labels(shared, bounds, least, positives, negatives, arrow_kind))
    numbers = spark.createDataFrame(pa.table([pa.array(np.arange(many), pa.int64()), anchors.ids], names=["anchor", "anchor_id"]))
    pairs = best.select(
        (F.col("group") * positives + F.col("rank") - 1).alias("group"), F.col("group").alias("anchor"), F.col("item_id").alias("positive_id"), F.col("score").alias("positive_score")
    ).join(F.broadcast(numbers), "anchor")
    return mined.select("group", "rank", F.col("item_id").alias("negative_id"), F.col("score").alias("negative_score")).join(pairs, "group").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _same_label(shared, bound, k: int, id_kind: pa.DataType):
    """The k best points of an anchor's label, other ids only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = shared.value
        found = _Found(bound.value, k, id_kind)
        for dims, labels, vectors, part in _blocks(batches):
            for label in np.unique(labels):
                rows = np.flatnonzero(labels == label)
                lists = CandidateLists(vectors[rows])
                for a in np.flatnonzero((anchors.labels == label) & (anchors.dims == dims)):
                    group, met = np.array([a]), []
                    for new, score, threshold in lists.read(anchors.vectors[a]):
                        reach = score >= found.wanted(group)[0]
                        if reach.any():
                            new, score = new[reach], score[reach]
                            # The anchor's own class may hold nothing but the anchor: it proves no k-th score.
                            found.offer(group, score, (lists.vectors[new] != anchors.vectors[a]).any(axis=1)[None, :])
                            met.append((new, score))
                        if threshold < found.wanted(group)[0]:
                            break
                    if met:
                        new, score = (np.concatenate(c) for c in zip(*met))
                        found.take(group, rows[new], score, np.ones((1, len(new)), bool))
            found.end_of(part, anchors.ids)
        yield from found.kept.batches()

    return run


def _other_labels(shared, bounds, bound, windows: int, k: int, id_kind: pa.DataType):
    """The k best points of other labels inside each window of an anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, (lows, highs) = shared.value, bounds.value
        found = _Found(np.maximum(lows, bound.value), k, id_kind)
        for dims, labels, vectors, part in _blocks(batches):
            lists = CandidateLists(vectors)
            for a in np.flatnonzero(anchors.dims == dims):
                group = np.arange(a * windows, (a + 1) * windows)
                group = group[lows[group] <= highs[group]]
                if not len(group):
                    continue
                high, met = highs[group][:, None], []
                wanted = found.wanted(group)
                for new, score, threshold in lists.read(anchors.vectors[a]):
                    reach = score >= wanted.min()
                    reach &= labels[new] != anchors.labels[a]
                    if reach.any():
                        new, score = new[reach], score[reach]
                        found.offer(group, score, (score >= wanted[:, None]) & (score <= high))
                        met.append((new, score))
                        wanted = found.wanted(group)
                    if threshold < wanted.min():
                        break
                if met:
                    new, score = (np.concatenate(c) for c in zip(*met))
                    found.take(group, new, score, score <= high)
            found.end_of(part)
        yield from found.kept.batches()

    return run
