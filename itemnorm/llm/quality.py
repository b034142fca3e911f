"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted feature after feature, round after round, on the binned values; what they
add up to is one lookup table per feature and per chosen pair of features. A text is scored by finding
the bins of its features and adding the table entries of a whole batch at once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field
from itertools import combinations
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from itemnorm.llm.common import id_type, map_batches, text_bytes
from itemnorm.llm.labelled import labelled_sample

SAMPLE_ROWS = 20_000
BINS = 32
COARSE = 8
PAIRS = 6
ROUNDS = 150
PAIR_ROUNDS = 60
LEARNING_RATE = 0.15
FEATURES = (
    "log_words", "mean_word_bytes", "upper_share", "digit_share", "punctuation_share", "symbol_share", "bar_share", "shout_share",
    "line_share", "high_byte_share", "space_share", "distinct_words", "top_word_share", "repeated_next", "long_word_share", "byte_entropy",
)
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": b"0123456789", "punctuation": b".,;:?'\"()-", "symbol": b"#$%&*+<=>@\\^_`{}~[]/", "bar": b"|",
    "shout": b"!", "line": b"\n", "space": b" \t\r\n\x0b\x0c",
}
_MEMBERS = {name: np.frombuffer(members, np.uint8) for name, members in _CLASSES.items()}


def text_features(text: str | None) -> list[float]:
    """The FEATURES of one whole text; all zero for an empty one."""
    raw = text_bytes(text)
    words = raw.lower().split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    size, n = len(raw), len(words)
    share = {name: float(counts[members].sum()) / size for name, members in _MEMBERS.items()}
    lengths = np.fromiter(map(len, words), np.int64, n)
    seen = Counter(words)
    part = counts[counts > 0] / size
    return [
        math.log1p(n), float(lengths.mean()), share["upper"], share["digit"], share["punctuation"], share["symbol"], share["bar"], share["shout"],
        share["line"], float(counts[128:].sum()) / size, share["space"], len(seen) / n, max(seen.values()) / n,
        sum(map(eq, words, words[1:])) / n, float((lengths > 12).mean()), float(-(part * np.log2(part)).sum()),
    ]


@dataclass
class QualityModel:
    """Base log-odds, bin edges per feature, a table per feature, and a table per pair of features."""

    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=lambda: [np.empty(0)] * len(FEATURES))
    tables: list[np.ndarray] = field(default_factory=lambda: [np.zeros(1)] * len(FEATURES))
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=lambda: [np.empty(0)] * len(FEATURES))
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, table in enumerate(self.tables):
            out += table[np.searchsorted(self.edges[j], x[:, j], side="left")]
        coarse = {j: np.searchsorted(self.pair_edges[j], x[:, j], side="left") for pair in self.pairs for j in pair}
        for (a, b), table in zip(self.pairs, self.pair_tables):
            out += table[coarse[a], coarse[b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.log_odds(x), -60, 60)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts halfway between neighbouring values around the quantiles, so that ties never split."""
    distinct = np.unique(values)
    if len(distinct) < 2:
        return np.empty(0)
    wanted = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower"))
    at = np.searchsorted(distinct, wanted)
    at = np.unique(np.append(at, 0))
    at = at[at < len(distinct) - 1]
    return (distinct[at] + distinct[at + 1]) / 2


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Newton steps per bin of a tree of that depth over ordered bins."""
    if depth and len(g) > 1:
        left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
        gains = _gain(left_g, left_h) + _gain(g.sum() - left_g, h.sum() - left_h)
        cut = int(np.argmax(gains)) + 1
        if gains[cut - 1] > _gain(g.sum(), h.sum()) + 1e-9:
            return np.concatenate([_shallow_tree(g[:cut], h[:cut], depth - 1), _shallow_tree(g[cut:], h[cut:], depth - 1)])
    return np.full(len(g), g.sum() / (h.sum() + 1.0))


def _four_leaves(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and steps of the best pair of cuts through a grid of gradient and curvature sums."""
    if min(g.shape) < 2:
        return 0.0, np.zeros_like(g)
    cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)

    def quadrants(c: np.ndarray) -> np.ndarray:
        ll = c[:-1, :-1]
        lr, rl = c[:-1, -1:] - ll, c[-1:, :-1] - ll
        return np.stack([ll, lr, rl, c[-1, -1] - ll - lr - rl])

    qg, qh = quadrants(cg), quadrants(ch)
    gains = _gain(qg, qh).sum(0)
    i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
    steps = np.empty_like(g)
    for k, part in enumerate(((slice(None, i + 1), slice(None, j + 1)), (slice(None, i + 1), slice(j + 1, None)), (slice(i + 1, None), slice(None, j + 1)), (slice(i + 1, None), slice(j + 1, None)))):
        steps[part] = qg[k, i, j] / (qh[k, i, j] + 1.0)
    return float(gains[i, j] - _gain(g.sum(), h.sum())), steps


def fit_additive(x: np.ndarray, y: np.ndarray) -> QualityModel:
    """Boosts the main tables first, then the pairs whose residuals gain most."""
    model = QualityModel()
    if not len(y) or y.min() == y.max():
        model.base = 0.0 if not len(y) else float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
        return model
    model.base = float(np.log(y.mean() / (1 - y.mean())))
    model.edges = [_edges(x[:, j], BINS) for j in range(x.shape[1])]
    bins = [np.searchsorted(model.edges[j], x[:, j], side="left") for j in range(x.shape[1])]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    f = np.full(len(y), model.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1.0 / (1.0 + np.exp(-f))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for j, b in enumerate(bins):
            g, h = slopes()
            n = len(model.tables[j])
            step = LEARNING_RATE * _shallow_tree(np.bincount(b, g, n), np.bincount(b, h, n))
            model.tables[j] += step
            f += step[b]
    model.pair_edges = [_edges(x[:, j], COARSE) for j in range(x.shape[1])]
    coarse = [np.searchsorted(model.pair_edges[j], x[:, j], side="left") for j in range(x.shape[1])]
    sizes = [len(e) + 1 for e in model.pair_edges]

    def grid(a: int, b: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(coarse[a] * sizes[b] + coarse[b], v, sizes[a] * sizes[b]).reshape(sizes[a], sizes[b])

    g, h = slopes()
    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda p: (-_four_leaves(grid(*p, g), grid(*p, h))[0], p))
    model.pairs = ranked[:PAIRS]
    model.pair_tables = [np.zeros((sizes[a], sizes[b])) for a, b in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, (a, b) in enumerate(model.pairs):
            g, h = slopes()
            step = LEARNING_RATE * _four_leaves(grid(a, b, g), grid(a, b, h))[1]
            model.pair_tables[k] += step
            f += step[coarse[a], coarse[b]]
    return model


def point_features(points: DataFrame, keep: tuple[str, ...] = ("item_id",)) -> DataFrame:
    """The kept columns and an array of FEATURES per point."""
    cols = points.select(*keep, "text")
    schema = ", ".join(f"`{c}` {id_type(points, c)}" for c in keep) + ", features array<double>"

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = [text_features(t) for t in batch.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(values, pa.list_(pa.float64()))], names=[*keep, "features"])

    return map_batches(cols, run, schema)


def fit_quality(points: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> QualityModel:
    """Model from points(item_id, text) and labels(item_id, label): 1 for good items.

    `rows` bounds the labelled sample: that many feature vectors come to the driver. Without labels the
    model scores 0.5, with labels of one kind their smoothed share.
    """
    frame = point_features(labelled_sample(points, labels, rows), ("item_id", "label")).toPandas().sort_values("item_id")
    x = np.array(frame["features"].tolist(), dtype=float).reshape(len(frame), len(FEATURES))
    return fit_additive(x, frame["label"].to_numpy(dtype=float))


def score_quality(points: DataFrame, model: QualityModel, keep: Sequence[str] = ()) -> DataFrame:
    """item_id, score, predicted of every point: the chance that its label is 1, and score >= 0.5; and its columns named in keep.

    points(item_id, text, ...): the score depends on the whole text only. A null or empty text has the
    score of all-zero features; null ids, repeated rows and extra columns change nothing.
    """
    kept = "".join(f"`{c}` {id_type(points, c)}, " for c in keep)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = np.array([text_features(t) for t in batch.column(1).to_pylist()], dtype=float).reshape(-1, len(FEATURES))
        score = model.score(x)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[2:], batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*keep, "item_id", "score", "predicted"]
        )

    cols = points.select("item_id", "text", *[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)])
    return map_batches(cols, run, f"{kept}item_id {id_type(points)}, score double, predicted int")
