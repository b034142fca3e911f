"""Ranked lexical search by norm buckets.

A point is a sparse vector of impacts, one coordinate per term, and an item asks for the sum of the
coordinates of its terms, an inner product with a vector of ones. Points are put in order of the length
of their vectors and searched in buckets of similar length. By Cauchy-Schwarz no point of a bucket scores
above sqrt(terms) * greatest length, so a bucket below the item's k-th score is skipped. Inside a bucket only
the coordinates that are needed to reach that score are read first; a point goes on if what they give, plus the
smaller of two bounds for the others (their greatest values in the bucket; Cauchy-Schwarz on the rest of its
length), can reach it. The survivors are scored exactly in integers.

The longest buckets are searched first, and the k-th scores found there go out to the search of all others.
Terms, counts and statistics come from all points and whole texts. Items are worked on in slices whose
terms are at most TERM_BYTES (a single item with longer text is a slice of its own), so what is
broadcast does not grow with the tables.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from itemnorm.llm.best import BestRows, kth_scores, least_of
from itemnorm.llm.common import arrow_rows, id_type, text_bytes
from itemnorm.session import cut_lineage

TERM_BYTES = 4 << 20
#: Points of one bucket that are searched together, and the ratio of shortest to longest length that makes a bucket.
BLOCK = 4096
RATIO = 0.9
BUCKETS = 256
#: About this share of the points, the longest ones, gives the first k-th scores.
SEED_SHARE = 1 / 16

_SEPARATORS = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = bytes(0x20 if b in _SEPARATORS else b + 32 if 65 <= b <= 90 else b for b in range(256))

ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


def terms_of(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and of anything outside ASCII, A-Z lower-cased, as UTF-8."""
    return text_bytes(text).translate(_TABLE).split()


def _item_terms(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set(terms_of(t))) for t in batch["item"].to_pylist()]
            yield pa.record_batch([batch["item_idx"], pa.array(found, pa.list_(pa.binary()))], names=["item_idx", "terms"])

    rows = items.select("item_idx", "item").where(F.col("item_idx").isNotNull())
    return rows.mapInArrow(run, f"item_idx {id_type(items, 'item_idx')}, terms array<binary>")


def rank_texts(
    items: DataFrame, points: DataFrame, k: int, *, weight_scale: int = 1000, impact_scale: int = 1_000_000_000,
    saturation: int = 20, share: int = 50, term_bytes: int = TERM_BYTES, block: int = BLOCK,
) -> DataFrame:
    """item_idx, rank, item_id, score: the k points of highest score above 0 per item, ties to the smaller id.

    items(item_idx, item), points(item_id, text). With N points that hold a term, L terms in all, n terms in
    a point, df points that hold a term and tf its occurrences in a point, a term weighs
    w = floor(weight_scale * ln((2N + 2) / (2df + 1))); m = 100 - share + (share * n * N) div L; a point scores the sum of
    w * ((impact_scale * tf) div (1000 * tf + saturation * m)) over the item's distinct terms.

    Null and empty texts have no terms and are never found; an item without terms, or with a null item_idx, has no
    answers; rows that repeat an item_idx ask for the terms of all of them. Repeated points count and
    are returned each; a null item_id counts in the statistics and sorts last. Empty tables give no rows.
    Texts of any length are read whole; other columns are ignored.
    """
    spark = items.sparkSession
    asked = _item_terms(items).select("item_idx", F.explode("terms").alias("term")).distinct().groupBy("item_idx").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    asked = cut_lineage(asked)
    size = asked.agg(F.sum(F.aggregate("terms", F.lit(0).cast("bigint"), lambda a, t: a + F.length(t)))).first()[0] or 0
    slices = max(1, math.ceil(size / term_bytes))
    out = None
    for n in range(slices):
        part = asked.where(F.pmod(F.xxhash64("item_idx"), F.lit(slices)) == n)
        with arrow_rows(spark, block):
            found = _search_slice(part, points, k, weight_scale, impact_scale, saturation, share, block)
        out = found if out is None else out.unionByName(found)
    return out


def _search_slice(asked: DataFrame, points: DataFrame, k: int, weight_scale: int, impact_scale: int, saturation: int, share: int, block: int) -> DataFrame:
    spark = asked.sparkSession
    asked_kind, id_kind = id_type(asked, "item_idx"), id_type(points)
    lines = asked.toArrow()
    vocabulary = {t: i for i, t in enumerate(sorted({t for own in lines["terms"].to_pylist() for t in own}))}
    wanted = [np.array([vocabulary[t] for t in own], np.int64) for own in lines["terms"].to_pylist()]
    empty = spark.createDataFrame([], f"item_idx {asked_kind}, rank int, item_id {id_kind}, score bigint")
    counted = _counted(points, vocabulary)
    whole = counted.agg(F.count_if(F.col("n") > 0).alias("points"), F.sum("n").alias("terms")).first()
    if not whole["terms"] or not vocabulary:
        return empty
    seen = counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = np.zeros(len(vocabulary), np.int64)
    for row in seen.collect():  # one line per term of the slice
        weights[row["term"]] = math.floor(weight_scale * math.log((2 * whole["points"] + 2) / (2 * row["df"] + 1)))
    index, seeds = _by_length(counted, weights, whole["points"], whole["terms"], impact_scale, saturation, share)
    ids = lines.column("item_idx").combine_chunks()
    numbers = spark.createDataFrame(pa.table([pa.array(np.arange(len(ids)), pa.int64()), ids], names=["group", "item_idx"]))

    def search(part: DataFrame, least: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast((wanted, least))
        return part.select("item_id", "terms", "impacts", "length").mapInArrow(_searcher(shared, len(vocabulary), k, ARROW[id_kind]), f"group bigint, score bigint, item_id {id_kind}")

    order = Window.partitionBy("group").orderBy(F.desc("score"), F.asc_nulls_last("item_id"))

    def best(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    first = cut_lineage(best(search(index.where(F.col("bucket") <= seeds), np.ones(len(wanted), np.int64))))
    least = np.ones(len(wanted), np.int64)
    for row in first.where(F.col("rank") == k).select("group", "score").collect():  # one line per item of the slice
        least[row["group"]] = row["score"]
    rest = search(index.where(F.col("bucket") > seeds), least)
    merged = cut_lineage(best(first.drop("rank").unionByName(rest)))
    return merged.join(F.broadcast(numbers), "group").select("item_idx", "rank", "item_id", "score")


def _counted(points: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """item_id, n, and the asked terms of every point with how often they occur."""
    shared = points.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value.get
        for batch in batches:
            sizes, terms, counts, ends = [], [], [], [0]
            for text in batch["text"]:
                own = terms_of(text.as_py())
                held = Counter(map(number, own))
                held.pop(None, None)
                sizes.append(len(own))
                terms.extend(held.keys())
                counts.extend(held.values())
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.record_batch(
                [batch["item_id"], pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int64()))],
                names=["item_id", "n", "terms", "counts"],
            )

    # Small batches here: texts may be long.
    with arrow_rows(points.sparkSession, 500):
        return cut_lineage(points.select("item_id", "text").mapInArrow(run, f"item_id {id_type(points)}, n bigint, terms array<int>, counts array<bigint>"))


def _by_length(counted: DataFrame, weights: np.ndarray, many: int, total: int, impact_scale: int, saturation: int, share: int) -> tuple[DataFrame, int]:
    """The impact vectors in order of length with the bucket of each, and the last bucket of the first search.

    Equal vectors, however many, are dealt over tasks by their ids.
    """
    spark = counted.sparkSession
    shared = spark.sparkContext.broadcast(weights)
    kind = id_type(counted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = shared.value
        for batch in batches:
            offsets = batch["terms"].offsets.to_numpy().astype(np.int64)
            per_row = np.diff(offsets)
            terms = batch["terms"].flatten().to_numpy()
            tf = batch["counts"].flatten().to_numpy()
            m = 100 - share + (share * batch["n"].to_numpy() * many) // total
            impacts = weight[terms] * ((impact_scale * tf) // (1000 * tf + saturation * np.repeat(m, per_row)))
            at = offsets - offsets[0]
            # Rounded up a little, so that the bounds by length stay bounds. Every row has a term.
            length = np.sqrt(np.add.reduceat(impacts.astype(float) ** 2, at[:-1])) * (1 + 1e-9) if len(at) > 1 else np.empty(0)
            at = pa.array(at, pa.int32())
            yield pa.record_batch(
                [batch["item_id"], pa.ListArray.from_arrays(at, pa.array(terms, pa.int32())), pa.ListArray.from_arrays(at, pa.array(impacts, pa.int64())), pa.array(length)],
                names=["item_id", "terms", "impacts", "length"],
            )

    vectors = counted.where(F.size("terms") > 0).mapInArrow(run, f"item_id {kind}, terms array<int>, impacts array<bigint>, length double")
    # A vector of length 0 scores 0 for every item.
    ordered = vectors.where(F.col("length") > 0).repartitionByRange(F.desc("length"), F.xxhash64("item_id")).sortWithinPartitions(F.desc("length"))
    ordered = cut_lineage(ordered)
    longest = ordered.agg(F.max("length")).first()[0]
    if longest is None:
        return ordered.withColumn("bucket", F.lit(0)), 0
    bucket = F.least(F.lit(BUCKETS - 1), F.floor(F.log(F.lit(longest) / F.col("length")) / math.log(1 / RATIO))).cast("int")
    index = ordered.withColumn("bucket", bucket)
    sizes = {r["bucket"]: r["n"] for r in index.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
    seeds, held = 0, 0
    for seeds in sorted(sizes):
        held += sizes[seeds]
        if held >= SEED_SHARE * sum(sizes.values()):
            break
    return index, seeds


def _searcher(shared, terms: int, k: int, id_kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, least = shared.value
        best: list = [None] * len(wanted)
        kept = BestRows(k, id_kind)
        for batch in batches:
            if batch.num_rows:
                bucket = _Bucket(batch, terms)
                for item, own in enumerate(wanted):
                    rows, scores = bucket.search(own, least_of(best, item, k, int(least[item])))
                    if len(rows):
                        kth_scores(best, item, scores, k)
                        reach = scores >= least_of(best, item, k, int(least[item]))
                        kept.add(np.full(int(reach.sum()), item), scores[reach], batch["item_id"].take(pa.array(rows[reach])))
        yield from kept.batches()

    return run


class _Bucket:
    """Points of similar length: their coordinates by point and by term, and the greatest value of every term."""

    def __init__(self, batch: pa.RecordBatch, terms: int):
        offsets = batch["terms"].offsets.to_numpy().astype(np.int64)
        self.at = offsets - offsets[0]
        self.terms = batch["terms"].flatten().to_numpy()
        self.impacts = batch["impacts"].flatten().to_numpy()
        self.length = batch["length"].to_numpy()
        self.longest = float(self.length.max())
        self.points = batch.num_rows
        order = np.argsort(self.terms, kind="stable")
        self.rows = np.repeat(np.arange(self.points), np.diff(self.at))[order]
        self.values = self.impacts[order]
        held, first = np.unique(self.terms[order], return_index=True)
        self.start = np.zeros(terms, np.int64)
        self.stop = np.zeros(terms, np.int64)
        self.top = np.zeros(terms, np.int64)
        self.start[held], self.stop[held] = first, np.append(first[1:], len(order))
        self.top[held] = np.maximum.reduceat(self.values, first)
        self.asked = np.zeros(terms, bool)

    def search(self, own: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Points that score at least `least` with their exact scores."""
        none = np.empty(0, np.int64), np.empty(0, np.int64)
        if math.sqrt(len(own)) * self.longest < least:
            return none
        own = own[self.top[own] > 0]
        own = own[np.argsort(-self.top[own], kind="stable")]
        tops = self.top[own]
        # after[i]: the most that the terms from i on can give.
        after = np.append(np.cumsum(tops[::-1])[::-1], 0)
        if after[0] < least:
            return none
        # A point without any of the first `focus` terms cannot reach the score.
        focus = int(np.argmax(after < least)) if after[-1] < least else len(own)
        part = np.zeros(self.points, np.int64)
        squares = np.zeros(self.points)
        for t in own[:focus]:
            rows, values = self.rows[self.start[t] : self.stop[t]], self.values[self.start[t] : self.stop[t]]
            part[rows] += values
            squares[rows] += values.astype(float) ** 2
        found = np.flatnonzero(part)
        rest = np.sqrt(np.maximum(self.length[found] ** 2 * (1 + 1e-9) - squares[found], 0) * (len(own) - focus))
        found = found[part[found] + np.minimum(float(after[focus]), rest) * (1 + 1e-9) >= least]
        if not len(found) or focus == len(own):
            return found, part[found]
        scores = self._exact(found, own)
        reach = scores >= least
        return found[reach], scores[reach]

    def _exact(self, found: np.ndarray, own: np.ndarray) -> np.ndarray:
        sizes = self.at[found + 1] - self.at[found]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        flat = np.arange(sizes.sum()) - np.repeat(starts - self.at[found], sizes)
        self.asked[own] = True
        values = np.where(self.asked[self.terms[flat]], self.impacts[flat], 0)
        self.asked[own] = False
        return np.add.reduceat(values, starts)
