"""Packing tokenised texts into fixed-length sequences: linear grouping, configurations, best fit.

Pieces longer than a quarter of a sequence are large. They are sorted by length and cut into groups of
equal cardinality, and a group's lengths are rounded up to its largest; with few sizes left, the
fewest sequences for their counts follow from configurations (which sizes share a sequence), found by
column generation. Real pieces then take the slots of their group, so a sequence has at least the room its
configuration left, and small pieces go where they fit best. The plans are made on counts per length,
which a sequence's capacity bounds; pieces and sequences meet their places in joins on ranks.
"""

from __future__ import annotations

import re
import sys
from array import array
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from itemnorm.llm.common import dense_number, id_type
from itemnorm.session import cut_lineage

CAPACITY = 2048
GROUPS = 256
#: Words, and runs of letters, whose ids a Python worker remembers.
CACHE = 300_000

Tokenise = Callable[[str], bytes]


class WordTokeniser:
    """Ids of whole texts by a tokenizers file, as little-endian unsigned 32-bit bytes.

    For files that lower-case, cut at white space into runs of letters, single digits and runs of other
    signs, and give each run to byte-level BPE by itself (word_bpe_49k.json). A text's ids are then those of
    its space-separated words in a row, and a word of plain signs is cut into runs here, whose ids
    the library's model gives; any other word goes through the library whole. Words and runs are
    remembered, up to CACHE of each.
    """

    PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
    # The file's pattern of runs, for plain signs in lower case.
    RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")

    def __init__(self, path: str):
        self.path = path
        self._words: dict[str, bytes] | None = None

    def __getstate__(self):
        return {"path": self.path, "_words": None}

    def __call__(self, text: str) -> bytes:
        if self._words is None:
            # A Python worker runs many tasks, and each gets its own copy of this module: what takes long to
            # load and to learn is kept with the interpreter.
            held = sys.__dict__.setdefault("_itemnorm_word_ids", {})
            if self.path not in held:
                held[self.path] = _WordIds(self.path, self.PLAIN, self.RUNS)
            self._words = held[self.path]
        return b"".join(map(self._words.__getitem__, text.replace("\n", " ").split(" ")))


class _WordIds(dict):
    def __init__(self, path: str, plain: re.Pattern, runs: re.Pattern):
        from tokenizers import Tokenizer

        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.model, self.plain, self.runs = self.library.model, plain, runs
        self.known: dict[str, bytes] = {}
        # Byte-level alphabet: visible signs stand for themselves, the other bytes follow from 256 on.
        visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
        hidden = [b for b in range(256) if b not in visible]
        self.signs = {b: 256 + n for n, b in enumerate(hidden)}

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE:
            self.clear()
        if "<|" not in word and self.plain.fullmatch(word):
            ids = b"".join([self.known.get(r) or self.run(r) for r in self.runs.findall(word.lower())])
        else:
            ids = array("I", self.library.encode(word, add_special_tokens=False).ids).tobytes()
        self[word] = ids
        return ids

    def run(self, run: str) -> bytes:
        if len(self.known) >= CACHE:
            self.known.clear()
        signs = run if run.isascii() else run.encode().decode("latin-1").translate(self.signs)
        self.known[run] = ids = array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()
        return ids


def token_pieces(points: DataFrame, tokenise: Tokenise, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """row_id, item_id, piece, start, length, token_ids of every point's text with `end_id` behind it.

    Texts longer than the capacity are cut every `capacity` ids; token_ids: little-endian unsigned 32-bit.
    """
    kind = id_type(points)
    end = np.array([end_id], "<u4").tobytes()
    cols = points.select("item_id", "text").withColumn("row_id", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                took, piece, ids = [], [], []
                for k, text in enumerate(part.column(1).to_pylist()):
                    whole = tokenise(text or "") + end
                    for n, at in enumerate(range(0, len(whole), 4 * capacity)):
                        took.append(k)
                        piece.append(n)
                        ids.append(whole[at : at + 4 * capacity])
                at = pa.array(took, pa.int64())
                number = np.array(piece, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(2).take(at), part.column(0).take(at), pa.array(number.astype(np.int32)), pa.array(number * capacity), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=["row_id", "item_id", "piece", "start", "length", "token_ids"],
                )

    return cols.mapInArrow(run, f"row_id bigint, item_id {kind}, piece int, start bigint, length bigint, token_ids binary")


@dataclass(frozen=True)
class Group:
    """Large lengths low..high; all count as high."""

    low: int
    high: int
    count: int


def linear_groups(counts: dict[int, int], groups: int) -> list[Group]:
    """Lengths, longest first, in groups of equal cardinality; equal lengths stay together."""
    total, out, n, high = sum(counts.values()), [], 0, None
    each = max(1, -(-total // groups))
    lengths = sorted(counts, reverse=True)
    for k, length in enumerate(lengths):
        high = length if high is None else high
        n += counts[length]
        if n >= each or k == len(lengths) - 1:
            out.append(Group(length, high, n))
            n, high = 0, None
    return out


def _best_configuration(sizes: list[int], value: np.ndarray, capacity: int) -> tuple[float, tuple[int, ...]]:
    """The most valuable multiset of sizes within the capacity: an unbounded knapsack, one piece more a round."""
    best, chosen = np.zeros(capacity + 1), []
    for _ in range(capacity // min(sizes)):
        with_one = np.full((len(sizes), capacity + 1), -1.0)
        for k, s in enumerate(sizes):
            with_one[k, s:] = best[: capacity + 1 - s] + value[k]
        pick = np.where(with_one.max(0) > best + 1e-12, with_one.argmax(0), -1)
        best = np.maximum(best, with_one.max(0))
        chosen.append(pick)
    out, room = [0] * len(sizes), capacity
    for pick in reversed(chosen):
        if (k := int(pick[room])) >= 0:
            out[k] += 1
            room -= sizes[k]
    return float(best[capacity]), tuple(out)


def configurations(groups: list[Group], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(sizes per sequence, how many such sequences) that hold every group's count.

    The relaxed problem is solved by column generation; its rounded-down part is taken, and what is left,
    at most about one sequence per group, is filled first fit, longest first.
    """
    sizes, demand = [g.high for g in groups], np.array([g.count for g in groups], float)
    m = len(sizes)
    if not m:
        return []
    master = _Master([tuple(capacity // s if i == k else 0 for i in range(m)) for k, s in enumerate(sizes)], demand)
    for _ in range(40 * m):
        gain, config = _best_configuration(sizes, master.duals(), capacity)
        if gain <= 1 + 1e-7 or not any(config):
            break
        master.enter(config)
    taken: Counter = Counter()
    left = [g.count for g in groups]
    for config, amount in master.solution():
        n = int(amount + 1e-9)
        n = min([n, *(left[k] // c for k, c in enumerate(config) if c)])
        if n > 0:
            taken[config] += n
            left = [have - n * c for have, c in zip(left, config)]
    while any(left):
        room, config = capacity, [0] * m
        for k in sorted(range(m), key=lambda k: -sizes[k]):
            n = min(left[k], room // sizes[k])
            config[k], room = n, room - n * sizes[k]
        times = min(left[k] // c for k, c in enumerate(config) if c)
        taken[tuple(config)] += times
        left = [have - times * c for have, c in zip(left, config)]
    return sorted(taken.items(), reverse=True)


class _Master:
    """Least sum of x with columns @ x = demand, x >= 0; the first columns are a diagonal start basis."""

    def __init__(self, columns: list[tuple[int, ...]], demand: np.ndarray):
        self.demand, self.columns = demand, list(columns)
        self.basis = list(range(len(demand)))
        self.inverse = np.diag([1.0 / c[k] for k, c in enumerate(columns)])

    def duals(self) -> np.ndarray:
        return self.inverse.sum(0)

    def enter(self, column: tuple[int, ...]) -> None:
        """Brings a column of reduced cost below 0 into the basis."""
        self.columns.append(column)
        direction, level = self.inverse @ np.array(column, float), self.inverse @ self.demand
        with np.errstate(divide="ignore", invalid="ignore"):
            leave = int(np.argmin(np.where(direction > 1e-9, level / direction, np.inf)))
        self.basis[leave] = len(self.columns) - 1
        row = self.inverse[leave] / direction[leave]
        self.inverse -= np.outer(direction, row)
        self.inverse[leave] = row

    def solution(self) -> list[tuple[tuple[int, ...], float]]:
        return list(zip((self.columns[k] for k in self.basis), np.maximum(self.inverse @ self.demand, 0).tolist()))


@dataclass
class _Bins:
    """Sequences start..start+count-1 of one room class, all with the same room left."""

    room: int
    key: int
    start: int
    count: int


def best_fit(rooms: dict[int, int], small: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Places of small pieces, longest first, each where the least room stays; on counts, not pieces.

    rooms: sequences by room left. Returns lines (length, rank from, rank to, room class, first
    sequence of it, pieces per sequence) and how many new sequences were opened; those are the class
    -1. Piece r of a line goes to sequence first + (r - from) // pieces per sequence.
    """
    import bisect

    by_room: dict[int, list[_Bins]] = {}
    order: list[int] = []

    def put(b: _Bins) -> None:
        if b.room <= 0 or b.count <= 0:
            return
        if b.room not in by_room:
            by_room[b.room] = []
            bisect.insort(order, b.room)
        by_room[b.room].append(b)

    for room, n in rooms.items():
        put(_Bins(room, room, 0, n))
    lines, opened = [], 0
    for length in sorted(small, reverse=True):
        rank, n = 0, small[length]
        while rank < n:
            at = bisect.bisect_left(order, length)
            if at == len(order):
                each = capacity // length
                new = -(-(n - rank) // each)
                put(_Bins(capacity, -1, opened, new))
                opened += new
                continue
            room = order[at]
            held = by_room[room]
            b = held.pop()
            if not held:
                del by_room[room]
                order.pop(at)
            each = room // length
            full = min(b.count, (n - rank) // each)
            if full:
                lines.append((length, rank, rank + full * each, b.key, b.start, each))
                rank += full * each
                put(_Bins(room - each * length, b.key, b.start, full))
            if full < b.count:
                start, count = b.start + full, b.count - full
                if rank < n and n - rank < each:
                    rest = n - rank
                    lines.append((length, rank, n, b.key, start, rest))
                    rank = n
                    put(_Bins(room - rest * length, b.key, start, 1))
                    start, count = start + 1, count - 1
                put(_Bins(room, b.key, start, count))
    return lines, opened


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """row_id, piece, sequence_id, offset: the sequence of every piece and its place there.

    pieces(row_id, piece, length, ...): the pair (row_id, piece) is unique, length is 1..capacity. Only
    counts per length (at most `capacity` lines) and plans over them reach the driver.
    """
    spark = pieces.sparkSession
    sized = pieces.select("row_id", "piece", "length")
    counts = {r["length"]: r["n"] for r in sized.groupBy("length").agg(F.count("*").alias("n")).collect()}
    limit = capacity // 4
    # A piece that fills a sequence alone is its own configuration.
    large = linear_groups({k: n for k, n in counts.items() if k > limit}, groups)
    plan = configurations(large, capacity)
    slots, sequences = [], 0
    filled = [0] * len(large)
    for config, times in plan:
        for k, c in enumerate(config):
            if c:
                slots.append((k, filled[k], filled[k] + c * times, sequences, c))
                filled[k] += c * times
        sequences += times
    group_lines = [(length, k) for k, g in enumerate(large) for length in counts if g.low <= length <= g.high]
    group_of = spark.createDataFrame(group_lines, "length bigint, bin int")
    # A piece's class: its group if it is large, else its own length, as negative number.
    classed = (
        sized.join(F.broadcast(group_of), "length", "left")
        .select("row_id", "piece", "length", F.coalesce(F.col("bin"), -F.col("length").cast("int")).alias("bin"))
    )
    ranked = cut_lineage(dense_number(classed, ["bin"], [F.col("row_id"), F.col("piece")], "rank"))
    slot_lines = spark.createDataFrame(slots, "bin int, low bigint, high bigint, first bigint, each int")
    in_slot = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    place = F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each")).cast("bigint")
    first_fit = cut_lineage(
        ranked.where("bin >= 0").alias("p").join(F.broadcast(slot_lines).alias("s"), (F.col("p.bin") == F.col("s.bin")) & in_slot)
        .select("row_id", "piece", "length", place.alias("sequence_id"))
    )
    rooms = first_fit.groupBy("sequence_id").agg((F.lit(capacity) - F.sum("length")).cast("int").alias("room")).where("room > 0")
    numbered = cut_lineage(dense_number(rooms, ["room"], [F.col("sequence_id")], "number"))
    room_counts = {r["room"]: r["n"] for r in numbered.groupBy("room").agg(F.count("*").alias("n")).collect()}
    small = {k: n for k, n in counts.items() if k <= limit}
    lines, opened = best_fit(room_counts, small, capacity)
    fit_lines = spark.createDataFrame(lines, "bin int, low bigint, high bigint, room int, first bigint, each int").withColumn("bin", -F.col("bin"))
    fitted = cut_lineage(
        ranked.where("bin < 0").alias("p").join(F.broadcast(fit_lines).alias("s"), (F.col("p.bin") == F.col("s.bin")) & in_slot)
        .select("row_id", "piece", "length", "room", place.alias("number"))
    )
    in_new = fitted.where("room = -1").select("row_id", "piece", "length", (F.col("number") + F.lit(sequences)).alias("sequence_id"))
    in_old = fitted.where("room > 0").join(numbered, ["room", "number"]).select("row_id", "piece", "length", "sequence_id")
    placed = first_fit.union(in_new).union(in_old)
    line = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "row_id", "piece").rowsBetween(Window.unboundedPreceding, -1)
    return placed.select("row_id", "piece", "sequence_id", F.coalesce(F.sum("length").over(line), F.lit(0)).alias("offset"))


@dataclass(frozen=True)
class Packing:
    """pieces(row_id, item_id, piece, start, length, token_ids) and places(row_id, piece, sequence_id, offset)."""

    pieces: DataFrame
    places: DataFrame


def pack_points(points: DataFrame, tokenise: Tokenise, capacity: int = CAPACITY, end_id: int = 0, groups: int = GROUPS) -> Packing:
    """Whole texts of points(item_id, text, ...) in as few sequences of `capacity` ids as the method finds.

    A null text counts as empty and is one piece that holds end_id only. Repeated rows are packed each;
    null ids and extra columns change nothing; an empty table gives empty tables. The pieces are written
    once under the shared folder, so that texts are tokenised once.
    """
    pieces = cut_lineage(token_pieces(points, tokenise, capacity, end_id))
    return Packing(pieces, pack_pieces(pieces, capacity, groups))
