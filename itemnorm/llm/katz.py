"""Language-model scores of texts: bigram Katz backoff with Good-Turing discounts.

P(w | h) = d(r) r / T(h) where the pair h w was seen r > 0 times in training, else alpha(h) P(w), and the same
once more below: P(w) = d(c) c / T for known words, the rest for all unknown ones together. alpha(h) is
what the seen words of h leave, divided by what the lower order gives to its unseen words, so the
probabilities of all words, the end and the unknown after any h add up to 1.

Texts are read and tokenised once, into rows of up to CHUNK tokens with their own numbering of words. A
chunk's distinct words, then its distinct pairs, are sent to buckets by hash with how often they occur;
a bucket adds up what all chunks sent and answers each in the order it asked. However often a word or a
pair occurs, a chunk names it once, and the pairs of frequent first words are spread over all buckets.
Arrays travel as compressed binary columns.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from itemnorm.llm.common import arrow_rows, id_type, text_bytes
from itemnorm.session import cut_lineage

CHUNK = 1 << 20
#: Distinct words and distinct pairs, counted once per chunk, that a bucket gets on average.
WORD_BUCKET = 500_000
PAIR_BUCKET = 1_000_000
#: A first word seen more often has its pairs spread over all buckets.
FREQUENT = 5_000
#: Counts up to this are discounted.
DISCOUNTED = 5
START, END = b" ", b""


def pack(values: np.ndarray) -> bytes:
    """An integer or float array as compressed byte planes."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return values.dtype.char.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:1].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8)
    return np.ascontiguousarray(planes.reshape(kind.itemsize, -1).T).view(kind).ravel()


def _slope(n: list[int]) -> float:
    """Slope of the line through log n[r] over log r; 0 with fewer than two counts of counts.

    A count of counts is spread over the gap to its neighbours that are not 0.
    """
    seen = [r for r in range(1, len(n)) if n[r]]
    if len(seen) < 2:
        return 0.0
    before = [0, *seen[:-1]]
    after = [*seen[1:], 2 * seen[-1] - seen[-2]]
    return float(np.polyfit(np.log(seen), [math.log(2 * n[r] / (b - a)) for r, a, b in zip(seen, before, after)], 1)[0])


@dataclass(frozen=True)
class Discounts:
    """Good-Turing factors of the counts 1..DISCOUNTED; larger counts keep theirs."""

    factors: tuple[float, ...]

    @staticmethod
    def fit(n: list[int]) -> "Discounts":
        """n[r]: how many things were seen r times, up to DISCOUNTED + 1; n[0] is not used.

        The chance of a thing seen r times is x[r] times r / T: Turing's (r + 1) n[r + 1] / (r n[r]) up to the first r
        where it leaves (0, 1) or is within its error of a line fitted to log n[r] over log r (Simple
        Good-Turing), that line's ratio from there on, and never less than for a smaller r. As in Katz, the
        factors 1 - m (1 - x[r]) leave n[1] to the unseen. Only where the counts of counts have no falling line
        or nothing but single ones, an absolute discount estimated from n[1] and n[2] stands in for all.
        """
        k = DISCOUNTED
        slope = _slope(n[: k + 2])
        if n[1] and any(n[2 : k + 1]) and slope < -1:
            x, turing = [], True
            for r in range(1, k + 1):
                line, raw = ((r + 1) / r) ** (slope + 1), (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
                if turing:
                    error = (r + 1) / r / n[r] * math.sqrt(n[r + 1] * (1 + n[r + 1] / n[r])) if n[r] else 0.0
                    turing = 0 < raw < 1 and abs(raw - line) > 1.65 * error
                x.append(max(raw if turing else line, *x[-1:], 0.0))
            m = n[1] / sum(n[r] * r * (1 - x[r - 1]) for r in range(1, k + 1))
            return Discounts(tuple(1 - m * (1 - v) for v in x))
        share = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] + n[2] else 0.5
        return Discounts(tuple((r - share) / r for r in range(1, k + 1)))

    def of(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        table = np.array([0.0, *self.factors])
        return counts * np.where(counts <= DISCOUNTED, table[np.minimum(counts, DISCOUNTED)], 1.0)


@dataclass(frozen=True)
class Unigrams:
    """The lower order: discounts, training tokens, distinct words, divisor, chance of an unknown word."""

    discounts: Discounts
    tokens: int
    words: int
    divisor: float
    unknown: float

    @staticmethod
    def fit(n: list[int], tokens: int, words: int) -> "Unigrams":
        d = Discounts.fit(n)
        if not tokens:
            return Unigrams(d, 0, 0, 1.0, 1.0)
        held = tokens - sum(n[r] * r * (1 - d.factors[r - 1]) for r in range(1, DISCOUNTED + 1))
        divisor = float(tokens) if held < tokens else tokens + 1.0
        return Unigrams(d, tokens, words, divisor, 1 - held / divisor)

    def chance(self, counts: np.ndarray) -> np.ndarray:
        return np.where(counts > 0, self.discounts.of(counts) / self.divisor, self.unknown)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))


def _chunks(points: DataFrame) -> DataFrame:
    kind = id_type(points)
    cols = points.select("item_id", "text", F.coalesce("held_out", F.lit(False)).alias("held_out")).withColumn("row_id", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            values = [
                pa.array([first]), pa.array([len(index)], pa.int64()), pa.array([sum(lengths)], pa.int64()),
                pa.ListArray.from_arrays(pa.array([0, len(lengths)], pa.int32()), pa.concat_arrays(ids)),
                pa.array([held], pa.list_(pa.bool_())), pa.array([pack(np.array(lengths, np.int64))], pa.binary()),
                pa.array([pack(np.concatenate(codes))], pa.binary()), pa.array([list(index)], pa.list_(pa.binary())),
            ]
            return pa.RecordBatch.from_arrays(values, names=["chunk", "n_words", "n_tokens", "item_ids", "held_out", "lengths", "codes", "words"])

        first, size = None, 0
        for batch in batches:
            texts, flags, row_ids = batch.column(1), batch.column(2).to_pylist(), batch.column(3)
            for k in range(batch.num_rows):
                if first is None:
                    first, size, index, ids, held, lengths, codes = row_ids[k].as_py(), 0, {START: 0, END: 1}, [], [], [], []
                words = text_bytes(texts[k].as_py()).lower().split()
                own = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int32, len(words))
                codes.append(np.append(own, np.int32(1)))
                lengths.append(len(words) + 1)
                ids.append(batch.column(0).slice(k, 1))
                held.append(flags[k])
                size += len(words) + 1
                if size >= CHUNK:
                    yield out()
                    first = None
        if first is not None:
            yield out()

    schema = f"chunk bigint, n_words bigint, n_tokens bigint, item_ids array<{kind}>, held_out array<boolean>, lengths binary, codes binary, words array<binary>"
    return cut_lineage(cols.mapInArrow(run, schema))


class _Chunk:
    """Tokens of a chunk, and its distinct pairs (previous word, word) in ascending order."""

    def __init__(self, row: dict):
        self.lengths, self.codes = unpack(row["lengths"]), unpack(row["codes"]).astype(np.int64)
        self.held = np.array(row["held_out"], bool)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        self.words = int(row["n_words"])

    def training(self) -> np.ndarray:
        return np.repeat(~self.held, self.lengths)

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, second words, and the pair of every token."""
        before = np.empty_like(self.codes)
        before[1:] = self.codes[:-1]
        before[self.starts] = 0
        both, which = np.unique(before * self.words + self.codes, return_inverse=True)
        return both // self.words, both % self.words, which


def _spread(values: np.ndarray) -> np.ndarray:
    mixed = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(33)


def _asked(first: np.ndarray, second: np.ndarray, ids: np.ndarray, counts: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs whose count has to be asked for, grouped by bucket, and the bucket of each.

    A pair of which one word is unknown in training has none. counts: by word, that of START being the number of
    texts.
    """
    may = np.flatnonzero((counts[first] > 0) & (counts[second] > 0))
    a, b = ids[first[may]], ids[second[may]]
    key = np.where(counts[first[may]] > FREQUENT, _spread(a * 31 + _spread(b).astype(np.int64)), _spread(a))
    bucket = (key % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((b, a, bucket))
    return may[order], bucket[order]


def _runs(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    if len(bucket):
        cuts = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(bucket[a]), slice(a, b)


def _answers(rows: list[dict], words: int) -> dict[str, np.ndarray]:
    """Answers of the word buckets, by the chunk's own numbers."""
    out: dict[str, np.ndarray] = {}
    for row in rows:
        at = unpack(row["pos"])
        for name in ("ids", "counts", "alpha", "divisor"):
            if row.get(name) is not None:
                values = unpack(row[name])
                out.setdefault(name, np.zeros(words, values.dtype))[at] = values
    out["counts"][0] = out["counts"][1]  # a text starts as often as one ends
    return out


def _count_words(tokens: DataFrame, buckets: int) -> DataFrame:
    """Word buckets' answers: chunk, bucket, pos, ids, counts; and a line of chunk -1 with their counts of counts."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                chunk = _Chunk(row.drop_columns(["words"]).to_pylist()[0])
                counts = np.bincount(chunk.codes[chunk.training()], minlength=chunk.words)
                words = row.column("words").flatten()
                bucket = np.fromiter((zlib.crc32(w) % buckets for w in words.to_pylist()), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                for b, part in _runs(bucket[order]):
                    at = order[part]
                    own = words.take(pa.array(at))
                    yield pa.RecordBatch.from_arrays(
                        [row.column("chunk"), pa.array([b]), pa.array([pack(at.astype(np.int32))]), pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own), pa.array([pack(counts[at])])],
                        names=["chunk", "bucket", "pos", "words", "counts"],
                    )

    def add_up(table: pa.Table) -> pa.Table:
        bucket = table["bucket"][0].as_py()
        sizes = [len(w) for w in table["words"]]
        which = pa.chunked_array([c.flatten() for c in table["words"].chunks]).combine_chunks().dictionary_encode()
        which, distinct = which.indices.to_numpy(), len(which.dictionary)
        counts = np.concatenate([unpack(c) for c in table["counts"].to_pylist()])
        total = np.bincount(which, counts, distinct).astype(np.int64)
        parts = np.split(which, np.cumsum(sizes)[:-1])
        stats = [int((total == r).sum()) for r in range(1, DISCOUNTED + 2)] + [int((total > 0).sum()), int(total.sum())]
        return pa.table(
            [pa.array([*table["chunk"].to_pylist(), -1]), pa.array([bucket] * (len(parts) + 1)), pa.array([*table["pos"].to_pylist(), None], pa.binary()), pa.array([*(pack(p.astype(np.int64) * buckets + bucket) for p in parts), None], pa.binary()), pa.array([*(pack(total[p]) for p in parts), None], pa.binary()), pa.array([*[None] * len(parts), stats], pa.list_(pa.int64()))],
            names=["chunk", "bucket", "pos", "ids", "counts", "stats"],
        )

    asked = tokens.select("chunk", "n_words", "lengths", "codes", "held_out", "words").mapInArrow(ask, "chunk bigint, bucket bigint, pos binary, words array<binary>, counts binary")
    counted = asked.groupBy("bucket").applyInArrow(add_up, "chunk bigint, bucket bigint, pos binary, ids binary, counts binary, stats array<bigint>")
    with arrow_rows(tokens.sparkSession, 2):  # a row is a whole chunk
        return cut_lineage(counted)


def _sum_stats(answers: DataFrame, n: int) -> list[int]:
    row = answers.where("chunk = -1 and stats is not null").agg(*[F.coalesce(F.sum(F.col("stats")[k]), F.lit(0)).alias(f"s{k}") for k in range(n)]).first()
    return [int(v) for v in row]


def _count_pairs(tokens: DataFrame, words: DataFrame, buckets: int, word_buckets: int, unigrams: Unigrams) -> DataFrame:
    """Pair buckets' answers: chunk, bucket, counts; and lines of chunk -1 with sums by first word for its word bucket.

    Those have, by first word, how many of its pairs were seen 1..DISCOUNTED times, how often all others
    were, and the lower-order chance of its seen words.
    """

    def ask(chunk_rows: pa.Table, answer_rows: pa.Table) -> pa.Table:
        row = chunk_rows.to_pylist()[0]
        chunk = _Chunk(row)
        known = _answers(answer_rows.to_pylist(), chunk.words)
        first, second, which = chunk.pairs()
        seen = np.bincount(which, chunk.training(), len(first)).astype(np.int64)
        at, bucket = _asked(first, second, known["ids"], known["counts"], buckets)
        lines = []
        for b, part in _runs(bucket):
            own = at[part]
            a = known["ids"][first[own]]
            lines.append((row["chunk"], b, pack(np.diff(a, prepend=0)), pack(known["ids"][second[own]]), pack(seen[own]), pack(known["counts"][second[own]])))
        names = ["chunk", "bucket", "first", "second", "seen", "second_count"]
        kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 4]
        return pa.table([pa.array([x[k] for x in lines], kind) for k, kind in enumerate(kinds)], names=names)

    def add_up(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        a, b = (np.concatenate(x) for x in ([np.cumsum(unpack(r["first"])) for r in rows], [unpack(r["second"]) for r in rows]))
        seen, lower = (np.concatenate([unpack(r[c]) for r in rows]) for c in ("seen", "second_count"))
        order = np.lexsort((b, a))
        fresh = np.ones(len(a), bool)
        fresh[1:] = (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)
        group = np.cumsum(fresh) - 1
        total = np.bincount(group, seen[order]).astype(np.int64)
        back = np.empty(len(a), np.int64)
        back[order] = total[group]
        sizes = np.cumsum([len(unpack(r["seen"])) for r in rows])[:-1]
        head = order[fresh]
        in_training = total > 0
        context, n = a[head][in_training], total[in_training]
        chance = unigrams.chance(lower[head][in_training])
        names, at = np.unique(context, return_inverse=True)
        sums = [np.bincount(at, n == r, len(names)) for r in range(1, DISCOUNTED + 1)]
        sums += [np.bincount(at, np.where(n > DISCOUNTED, n, 0), len(names)), np.bincount(at, chance, len(names))]
        stats = [int((total == r).sum()) for r in range(1, DISCOUNTED + 2)]
        target = names % word_buckets
        order = np.argsort(target, kind="stable")
        lines = [(r["chunk"], r["bucket"], pack(p), None, None, None) for r, p in zip(rows, np.split(back, sizes))]
        for bucket, part in _runs(target[order]):
            own = order[part]
            lines.append((-1, bucket, None, pack(names[own]), pack(np.concatenate([s[own] for s in sums]).astype(float)), None))
        lines.append((-1, rows[0]["bucket"], None, None, None, stats))
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64())]
        return pa.table([pa.array([x[k] for x in lines], kind) for k, kind in enumerate(kinds)], names=["chunk", "bucket", "seen", "contexts", "sums", "stats"])

    asked = (
        tokens.select("chunk", "n_words", "lengths", "codes", "held_out").groupBy("chunk")
        .cogroup(words.where("chunk >= 0").select("chunk", "pos", "ids", "counts").groupBy("chunk"))
        .applyInArrow(lambda a, b: ask(a, b), "chunk bigint, bucket bigint, first binary, second binary, seen binary, second_count binary")
    )
    return cut_lineage(asked.groupBy("bucket").applyInArrow(add_up, "chunk bigint, bucket bigint, seen binary, contexts binary, sums binary, stats array<bigint>"))


def _backoff(words: DataFrame, pairs: DataFrame, discounts: Discounts) -> DataFrame:
    """The word buckets' answers with log10 alpha and T of every word as a first word; alpha 1 where it was none."""

    def weigh(asked: pa.Table, sent: pa.Table) -> pa.Table:
        rows = asked.to_pylist()
        parts = [(unpack(r["contexts"]), unpack(r["sums"]).reshape(DISCOUNTED + 2, -1)) for r in sent.to_pylist()]
        if parts:
            names, at = np.unique(np.concatenate([c for c, _ in parts]), return_inverse=True)
            sums = np.stack([np.bincount(at, s, len(names)) for s in np.concatenate([s for _, s in parts], axis=1)])
            r = np.arange(1, DISCOUNTED + 1)[:, None]
            whole = (sums[:-2] * r).sum(0) + sums[-2]
            held = (sums[:-2] * r * np.array(discounts.factors)[:, None]).sum(0) + sums[-2]
            # Where nothing was discounted, one more imagined token leaves something to the unseen words.
            divisor = np.where(held < whole - 1e-12 * whole, whole, whole + 1)
            alpha = np.log10((1 - held / divisor) / np.maximum(1 - sums[-1], 1e-300))
        out = []
        for row in rows:
            ids = unpack(row["ids"])
            a, t = np.zeros(len(ids)), np.ones(len(ids))
            if parts and len(names):
                k = np.minimum(np.searchsorted(names, ids), len(names) - 1)
                hit = names[k] == ids
                a[hit], t[hit] = alpha[k[hit]], divisor[k[hit]]
            out.append((pack(a), pack(t)))
        return asked.append_column("alpha", pa.array([x for x, _ in out], pa.binary())).append_column("divisor", pa.array([x for _, x in out], pa.binary()))

    schema = "chunk bigint, bucket bigint, pos binary, ids binary, counts binary, alpha binary, divisor binary"
    asked = words.where("chunk >= 0").select("chunk", "bucket", "pos", "ids", "counts")
    sent = pairs.where("contexts is not null").select("bucket", "contexts", "sums")
    return asked.groupBy("bucket").cogroup(sent.groupBy("bucket")).applyInArrow(lambda a, b: weigh(a, b) if a.num_rows else a.append_column("alpha", pa.array([], pa.binary())).append_column("divisor", pa.array([], pa.binary())), schema)


def score_texts(points: DataFrame) -> DataFrame:
    """item_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every point.

    points(item_id, text, held_out, ...): the model learns from the points that are not held out; a null
    flag is false. Tokens are the lower-cased (A-Z) words of the whole text and one end, a null text has the
    end only. n_known: tokens seen in training; base_score: add-half unigram log10 probability; score: that
    of the model. Without training texts every score is 0. Null ids, repeated rows and extra columns change
    nothing; an empty table gives an empty result.
    """
    kind = id_type(points)
    tokens = _chunks(points)
    sizes = tokens.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    word_buckets, pair_buckets = max(8, -(-sizes[0] // WORD_BUCKET)), max(8, -(-sizes[1] // PAIR_BUCKET))
    words = _count_words(tokens, word_buckets)
    *counts, distinct, total = _sum_stats(words, DISCOUNTED + 3)
    unigrams = Unigrams.fit([0, *counts], total, distinct)
    pairs = _count_pairs(tokens, words, pair_buckets, word_buckets, unigrams)
    discounts = Discounts.fit([0, *_sum_stats(pairs, DISCOUNTED + 1)])
    none = F.lit(None).cast("binary")
    replies = (
        _backoff(words, pairs, discounts).select("chunk", F.lit(-1).cast("bigint").alias("bucket"), "pos", "ids", "counts", "alpha", "divisor", none.alias("seen"))
        .union(pairs.where("chunk >= 0").select("chunk", "bucket", none, none, none, none, none, "seen"))
    )

    def score(chunk_rows: pa.Table, reply_rows: pa.Table) -> pa.Table:
        chunk = _Chunk(chunk_rows.drop_columns(["item_ids"]).to_pylist()[0])
        rows = reply_rows.to_pylist()
        known = _answers([r for r in rows if r["pos"] is not None], chunk.words)
        first, second, which = chunk.pairs()
        at, _ = _asked(first, second, known["ids"], known["counts"], pair_buckets)
        seen = np.zeros(len(first), np.int64)
        if len(at):
            seen[at] = np.concatenate([unpack(r["seen"]) for r in sorted((r for r in rows if r["seen"] is not None), key=lambda r: r["bucket"])])
        counts = known["counts"].copy()
        lower = np.log10(unigrams.chance(counts))
        with np.errstate(divide="ignore"):
            upper = np.log10(discounts.of(seen) / known["divisor"][first])
        logs = np.where(seen > 0, upper, known["alpha"][first] + lower[second])[which]
        base = unigrams.base(counts)[chunk.codes]
        add = lambda v: np.add.reduceat(v, chunk.starts)
        n = len(chunk.lengths)
        return pa.table(
            [pa.concat_arrays([c.flatten() for c in chunk_rows["item_ids"].chunks]), pa.array(chunk.held), pa.array(chunk.lengths), pa.array(add((counts[chunk.codes] > 0).astype(np.int64))), pa.array(np.full(n, unigrams.tokens)), pa.array(add(base)), pa.array(add(logs))],
            names=["item_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    schema = f"item_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return (
        tokens.select("chunk", "n_words", "lengths", "codes", "held_out", "item_ids").groupBy("chunk")
        .cogroup(replies.groupBy("chunk")).applyInArrow(lambda a, b: score(a, b), schema)
    )
