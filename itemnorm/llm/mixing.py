"""Mixing sources to target weights by the cube method.

A source that has to give t of its s words takes every row floor(t / s) times and each row once more
with the inclusion probability that is left. The flight phase moves these probabilities along vectors
that change neither the words nor the rows taken, until at most two rows of a block are undecided; each
move is drawn up or down so that a row's chance is its inclusion probability, whatever its size. The
undecided rows of all blocks meet again in new blocks, until one small landing problem per source
remains, LANDING rows at most, which is decided by trying all its roundings.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from itemnorm.llm.common import WORD_PATTERN, dense_number, id_type
from itemnorm.session import cut_lineage

#: Rows of one flight.
BLOCK = 4096
#: Rows of a source that the landing decides together.
LANDING = 14
#: Equal rows that share a block; more of them are dealt over several.
CHUNK = 64
#: Rows of one part in which equal rows are numbered.
PART = 4096
#: Sources and their targets are lines of the driver: more are refused.
MAX_SOURCES = 100_000
_EPS = 1e-9


def source_targets(sizes: Sequence[int], weights: Sequence[float], share: float, limit: float) -> list[float]:
    """Words each source gives: `share` of all words by weight, at most `limit` times its own.

    What a limited source can't give is shared out again by weight among the others, until none is above
    its limit. If all are limited, less than the share is reached.
    """
    left, goal, out = set(range(len(sizes))), share * sum(sizes), [0.0] * len(sizes)
    while left:
        weight = sum(weights[k] for k in left)
        over = {k for k in left if goal * weights[k] / weight > limit * sizes[k]}
        if not over:
            for k in left:
                out[k] = goal * weights[k] / weight
            break
        for k in over:
            out[k] = limit * sizes[k]
            goal -= out[k]
        left -= over
    return out


def fly(p: np.ndarray, size: np.ndarray, spare: int = 0, seed: int = 0) -> np.ndarray:
    """Flight phase: three rows at a time move in the null space of (words, rows).

    Each step decides at least one of the three; of the rows before the last `spare` ones, which do not
    fly, at most two stay undecided. A step goes up or down as far as it can, by a draw that leaves every
    row its inclusion probability in the mean.
    """
    draws = np.random.default_rng(seed).random(len(p))
    p = np.where(p < _EPS, 0.0, np.where(p > 1 - _EPS, 1.0, p))
    live: list[int] = []
    for nxt in range(len(p) - spare):
        if 0 < p[nxt] < 1:
            live.append(nxt)
        if len(live) == 3:
            i, j, k = live
            # (u, v, w) with u + v + w = 0 and its words 0.
            v = np.array([size[j] - size[k], size[k] - size[i], size[i] - size[j]], float)
            if not v.any():
                v = np.array([1.0, -1.0, 0.0])
            at = p[live]
            with np.errstate(divide="ignore", invalid="ignore"):
                up = np.where(v > 0, (1 - at) / v, np.where(v < 0, -at / v, np.inf)).min()
                down = np.where(v > 0, at / v, np.where(v < 0, (at - 1) / v, np.inf)).min()
            at = np.clip(at + (up if draws[nxt] * (up + down) < down else -down) * v, 0, 1)
            at[at < _EPS], at[at > 1 - _EPS] = 0.0, 1.0
            p[live] = at
            live = [x for x in live if 0 < p[x] < 1]
    return p


def land(size: np.ndarray, words: float, rows: float) -> np.ndarray:
    """Landing: of all roundings of a few rows, the one whose words, then rows, come nearest."""
    ways = (np.arange(1 << len(size))[:, None] >> np.arange(len(size))) & 1
    return ways[np.lexsort((np.abs(ways.sum(1) - rows), np.abs(ways @ size - words)))[0]].astype(float)


def mix_sources(
    rows: DataFrame, weights: Sequence[float], share: float, limit: float = 2.0, block: int = BLOCK, keep: Sequence[str] = ()
) -> DataFrame:
    """item_id, source, size, source_size, target, copies, taken of every row, and its columns named in keep.

    rows(item_id, text, source, ...): size is the number of words, 0 for a null or empty text. The
    sources by code point, null last, get the weights in turn. target: words the mix takes from the row's
    source; copies: how often the row is taken; taken = copies * size. No row is taken more than `limit`
    times, an integer. The sums of taken words differ from the targets by the landing only: by a few words,
    or, in a source of a few rows, by up to half a row. A row's block follows from a hash of its id and
    size, so reruns agree. Repeated rows, and rows of equal size without an id, are decided one by one: CHUNK
    of them at a time lie in a block, and which of them are taken follows from their stored numbers. Rows
    without words are balanced as rows and add no words; long texts are counted whole. An empty table gives an
    empty result. More than MAX_SOURCES sources are refused.
    """
    spark = rows.sparkSession
    kind = id_type(rows)
    sized = cut_lineage(
        rows.select(*keep, "item_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD_PATTERN)).cast("bigint").alias("size"))
        .withColumn("_number", F.monotonically_increasing_id())
    )
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).limit(MAX_SOURCES + 1).collect()
    if len(totals) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals.sort(key=lambda r: (r["source"] is None, [ord(c) for c in r["source"] or ""]))
    sizes = [r["source_size"] for r in totals]
    targets = source_targets(sizes, [weights[k % len(weights)] for k in range(len(sizes))], share, limit)
    lines = []
    for k, (r, target) in enumerate(zip(totals, targets)):
        times = target / r["source_size"] if r["source_size"] else 0.0
        whole = min(math.floor(times + 1e-12), int(limit))
        p = 0.0 if whole >= limit or times - whole < 1e-12 else times - whole
        lines.append((k, r["source"], r["source_size"], float(target), whole, p, -(-r["n"] // block)))
    by_source = spark.createDataFrame(lines, "k int, source string, source_size bigint, target double, whole int, p double, blocks bigint")
    placed = cut_lineage(
        sized.join(F.broadcast(by_source), sized["source"].eqNullSafe(by_source["source"]))
        .select(*keep, "_number", "item_id", sized["source"], "size", "source_size", "target", "whole", "p", "k", F.greatest("blocks", F.lit(1)).alias("blocks"))
    )

    schema = f"item_id {kind}, size bigint, part bigint, k int, p double, n bigint, blocks bigint"

    def flight(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("item_id", "ascending"), ("size", "ascending"), ("part", "ascending"), ("p", "ascending")])
        size = table["size"].to_numpy()
        # Large rows fly first, so that the landing has rows of ordinary sizes to add up.
        table = table.take(np.argsort(size <= 2 * size.mean(), kind="stable"))
        again = table.take(np.repeat(np.arange(table.num_rows), table["n"].to_numpy()))
        last = table["blocks"][0].as_py() == 1
        # The draws follow from the rows of the block, so reruns agree.
        seed = xxhash.xxh64_intdigest(again["order"].to_numpy().tobytes(), table["k"][0].as_py())
        p = fly(again["p"].to_numpy(), again["size"].to_numpy(), min(LANDING - 2, again.num_rows) if last else 0, seed)
        ones = pa.array(np.ones(len(p), np.int64))
        names = ["item_id", "size", "part", "k", "p", "n", "blocks"]
        return pa.table([*(again[c] for c in names[:4]), pa.array(p), ones, again["blocks"]], names=names)

    equal = cut_lineage(placed.where(F.col("p") > 0).groupBy("item_id", "size", "k", "p", "blocks").agg(F.count("*").alias("n")))
    open_rows = in_chunks(equal)
    done, landing = [], []
    most = max([1, *(line[-1] for line in lines)])
    while True:
        flying = in_blocks(open_rows)
        flown = cut_lineage(flying.groupBy("k", "block").applyInArrow(flight, schema))
        done.append(flown.where("p = 0 or p = 1"))
        landing += flown.where("p > 0 and p < 1 and blocks = 1").collect()  # at most LANDING rows of a source
        if most == 1:
            break
        fewer = F.ceil(2 * F.col("blocks") / block).cast("bigint")
        open_rows = flown.where("p > 0 and p < 1 and blocks > 1").withColumn("blocks", fewer)
        most = -(-2 * most // block)
    decided = done[0]
    for part in done[1:]:
        decided = decided.union(part)
    taken_now = {r["k"]: r["w"] for r in placed.groupBy("k").agg(F.sum(F.col("whole") * F.col("size")).alias("w")).collect()}
    for r in decided.where("p = 1").groupBy("k").agg(F.sum(F.col("size") * F.col("n")).alias("w")).collect():
        taken_now[r["k"]] += r["w"]
    last: dict[int, list] = {}
    for r in sorted(landing, key=lambda r: (r["k"], r["size"], str(r["item_id"]), r["part"], r["p"])):
        last.setdefault(r["k"], []).extend([r] * r["n"])
    landed = []
    for k, own in last.items():
        p, size = np.array([r["p"] for r in own]), np.array([r["size"] for r in own])
        for r, x in zip(own, land(size, targets[k] - taken_now[k], p.sum())):
            landed.append((r["item_id"], r["size"], r["part"], k, float(x), 1, 1))
    decided = decided.union(spark.createDataFrame(landed, schema))
    extra = decided.where("p = 1").groupBy("item_id", "size", "k").agg(F.sum("n").alias("more"))
    taken = equal.select("item_id", "size", "k", "n").join(extra.toDF("_id", "_size", "_k", "more"), _same(F.col("_id"), F.col("_size"), F.col("_k")))
    return _with_extra(placed, cut_lineage(taken.select("item_id", "size", "k", "n", "more")), keep)


def in_chunks(equal: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Lines of n equal rows as parts of at most `chunk`."""
    parts = equal.select("*", F.explode(F.expr(f"sequence(0L, (n - 1) div {chunk})")).alias("part"))
    return parts.withColumn("n", F.least(F.lit(chunk).cast("bigint"), F.col("n") - F.col("part") * chunk))


def in_blocks(open_rows: DataFrame) -> DataFrame:
    """The undecided lines with their block of the source and their order inside it, both from hashes of the line."""
    line = [F.col("item_id").cast("string"), "size", "part"]
    block = F.pmod(F.xxhash64(*line, "blocks"), F.col("blocks")).alias("block")
    return open_rows.select("item_id", "size", "part", "k", "p", "n", "blocks", block, F.xxhash64(*line, F.lit("flight")).alias("order"))


def _same(item_id: Column, size: Column, k: Column) -> Column:
    return F.col("item_id").eqNullSafe(item_id) & (F.col("size") == size) & (F.col("k") == k)


def _with_extra(placed: DataFrame, taken: DataFrame, keep: Sequence[str]) -> DataFrame:
    """copies = whole + 1 for `more` of the n rows that share an id and a size.

    Only where some but not all of them are taken are they numbered, in parts of about PART rows.
    """
    columns = [*keep, "item_id", "source", "size", "source_size", "target", "whole", "more"]
    given = taken.toDF("_id", "_size", "_k", "n", "more")
    joined = placed.join(given, _same(F.col("_id"), F.col("_size"), F.col("_k")), "left").withColumn("more", F.coalesce("more", F.lit(0)))
    some = F.coalesce((F.col("more") > 0) & (F.col("more") < F.col("n")), F.lit(False))
    own = joined.where(some).withColumn("_parts", F.ceil(F.col("n") / PART).cast("int")).drop("_id", "_size", "_k")
    numbered = dense_number(own, ["item_id", "size", "k"], [F.col("_number")], "twin", F.col("_parts"))
    part = numbered.select(*columns, (F.col("twin") < F.col("more")).alias("again"))
    both = part.union(joined.where(~some).select(*columns, (F.col("more") > 0).alias("again")))
    return both.withColumn("copies", F.col("whole") + F.col("again").cast("int")).select(
        *keep, "item_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("bigint").alias("taken")
    )
