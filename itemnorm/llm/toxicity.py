"""Toxicity: a linear-chain conditional random field tags toxic tokens of a text.

Item labels say which texts are toxic, not where. Tokens get their labels from markers: words and word
starts found in several toxic training texts and hardly in clean ones. The field is trained on those
tokens; its forward-backward marginals give the offending spans of a text, and a small logistic model
over the marginals, fitted on training texts that gave no markers, gives the score.
"""

from __future__ import annotations

import re
import sys
from collections import Counter
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from itemnorm.llm.common import id_type, map_batches
from itemnorm.llm.labelled import labelled_sample

TOKEN = re.compile(r"\w+")
SAMPLE_ROWS = 8_000
STARTS = (4, 5, 6)
MIN_TEXTS = 3
PRECISION = 0.7
#: Tokens of a text that are worked on in one row; the chain runs on from row to row.
PIECE = 64
#: Of the training texts without any marker one in so many trains the field, with that weight.
PLAIN_SHARE = 8
STEPS = 60
CACHE = 200_000


def token_features(word: str) -> list[str]:
    """The lower-case word, and its first letters where it is longer than those."""
    word = word.lower()
    return ["=" + word, *("^" + word[:n] for n in STARTS if len(word) > n)]


class _Emissions(dict):
    """Log-odds of the toxic tag by word; words met once are remembered, up to CACHE of them."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = sum(self.weights.get(f, 0.0) for f in token_features(word))
        return value


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)
    bias: float = 0.0
    #: Log weights of clean->clean, clean->toxic, toxic->clean, toxic->toxic.
    moves: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    document: np.ndarray = field(default_factory=lambda: np.zeros(5))


def _pieces(values: np.ndarray, filler: float) -> np.ndarray:
    rows = -(-len(values) // PIECE)
    out = np.full(rows * PIECE, filler)
    out[: len(values)] = values
    return out.reshape(rows, PIECE)


def _scaled(message: np.ndarray) -> np.ndarray:
    return message / message.sum(0)


def _messages(toxic: np.ndarray, t: np.ndarray, mask: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What reaches the first token of each row from the rows before it, and the last token from those after it.

    A row maps what reaches it to its end by a 2 x 2 matrix. Those of all rows are made side by side, then passed
    on from row to row: the k-th rows of all texts at once, first to last and back.
    """
    n, steps = toxic.shape
    ahead, behind = np.ones((2, n)), np.ones((2, n))
    longest = int(place.max()) if n else 0
    if not longest:
        return ahead, behind
    # through[s, v]: from tag s of the first token to tag v of the last real one.
    through = np.zeros((2, 2, n))
    through[0, 0], through[1, 1] = 1.0, toxic[:, 0]
    for i in range(1, steps):
        moved = np.stack([through[:, 0] * t[0, 0] + through[:, 1] * t[1, 0], (through[:, 0] * t[0, 1] + through[:, 1] * t[1, 1]) * toxic[:, i]], 1)
        through = np.where(mask[:, i], moved / moved.sum((0, 1)), through)
    rows = np.split(np.argsort(place, kind="stable"), np.cumsum(np.bincount(place))[:-1])
    for k in range(1, longest + 1):
        here = rows[k]
        end = (ahead[:, here - 1][:, None] * through[:, :, here - 1]).sum(0)
        ahead[:, here] = _scaled(np.stack([end[0] * t[0, v] + end[1] * t[1, v] for v in (0, 1)]))
    for k in range(longest, 0, -1):
        here = rows[k]
        start = (through[:, :, here] * behind[:, here]).sum(1)
        behind[:, here - 1] = _scaled(np.stack([t[u, 0] * start[0] + t[u, 1] * start[1] for u in (0, 1)]))
    return ahead, behind


def marginals(emissions: np.ndarray, moves: np.ndarray, mask: np.ndarray, place: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Toxic marginals per token, and expected moves summed over all texts, by their weight.

    Rows are pieces of texts, those of one text in order; place: number of a row in its text; mask: real tokens,
    all of them but at a text's end. The chain runs through the whole text.
    """
    n, steps = emissions.shape
    toxic = np.exp(np.clip(emissions, -30, 30))
    t = np.exp(moves)
    ahead, behind = _messages(toxic, t, mask, place)
    forward = np.empty((steps, 2, n))
    backward = np.empty((steps, 2, n))
    forward[0] = _scaled(np.stack([ahead[0], ahead[1] * toxic[:, 0]]))
    for i in range(1, steps):
        a = np.stack([forward[i - 1, 0] * t[0, 0] + forward[i - 1, 1] * t[1, 0], (forward[i - 1, 0] * t[0, 1] + forward[i - 1, 1] * t[1, 1]) * toxic[:, i]])
        forward[i] = np.where(mask[:, i], _scaled(a), forward[i - 1])
    backward[-1] = behind
    for i in range(steps - 2, -1, -1):
        b1 = backward[i + 1, 1] * toxic[:, i + 1]
        b = np.stack([t[0, 0] * backward[i + 1, 0] + t[0, 1] * b1, t[1, 0] * backward[i + 1, 0] + t[1, 1] * b1])
        backward[i] = np.where(mask[:, i + 1], _scaled(b), behind)
    both = forward * backward
    p = (both[:, 1] / both.sum(1)).T
    weight = np.ones(n) if weight is None else weight
    expected = np.zeros((2, 2))

    def add(before, i, rows, share):
        e = [np.ones(len(share)), toxic[rows, i]]
        joint = np.stack([[before[u] * t[u, v] * e[v] * backward[i, v][rows] for v in (0, 1)] for u in (0, 1)])
        return (joint / joint.sum((0, 1)) * share).sum(2)

    everything = slice(None)
    for i in range(1, steps):
        expected += add(forward[i - 1], i, everything, mask[:, i] * weight)
    later = np.flatnonzero(place > 0)
    if len(later):
        expected += add(forward[-1][:, later - 1], 0, later, weight[later])
    return p * mask, expected


def _document_features(p: np.ndarray) -> list[float]:
    """Of the marginals of one text: 1, largest, second, sum of all, share of toxic tokens."""
    if not len(p):
        return [1.0, 0.0, 0.0, 0.0, 0.0]
    top = np.sort(np.partition(p, max(0, len(p) - 2))[-2:])
    return [1.0, float(top[-1]), float(top[0]) if len(p) > 1 else 0.0, float(np.log1p(np.where(p > 0.05, p, 0).sum())), float(min(1.0, 10 * np.where(p > 0.05, p, 0).mean()))]


def _adam(start: np.ndarray, slope, steps: int, rate: float) -> np.ndarray:
    w, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for k in range(1, steps + 1):
        g = slope(w)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return w


def _markers(texts: list[list[str]], labels: np.ndarray) -> list[str]:
    """Features of several toxic texts whose share of toxic texts, both kinds weighed alike, is high."""
    found = (Counter(), Counter())
    for words, label in zip(texts, labels):
        if label:
            found[1].update({f for w in set(words) for f in token_features(w)})
    often = {f for f, n in found[1].items() if n >= MIN_TEXTS}
    for words, label in zip(texts, labels):
        if not label:
            found[0].update({f for w in set(words) for f in token_features(w) if f in often})
    toxic, clean = max(1, int(labels.sum())), max(1, int(len(labels) - labels.sum()))
    kept = []
    for f in often:
        n = found[1][f]
        rate, other = n / toxic, (found[0][f] + 0.5) / clean
        if rate / (rate + other) >= PRECISION and n / (n + found[0][f]) >= 0.5:
            kept.append((-n, f))
    return [f for _, f in sorted(kept)]


def fit_field(texts: list[list[str]], labels: np.ndarray, aggregate: np.ndarray, plain_share: int = PLAIN_SHARE) -> ToxicityModel:
    """aggregate: which texts fit the document model; the others give markers and train the field.

    Texts are trained on whole. Of those without any marker one in `plain_share` takes part, weighted by it.
    """
    model = ToxicityModel()
    if not len(labels) or labels.min() == labels.max():
        share = (labels.sum() + 0.5) / (len(labels) + 1.0) if len(labels) else 0.0
        model.document[0] = np.log(share / (1 - share)) if share else -4.0
        return model
    own = np.flatnonzero(~aggregate)
    features = _markers([texts[i] for i in own], labels[own])
    index = {f: k for k, f in enumerate(features)}
    cache: dict[str, list[int]] = {}
    tag_rows, mask_rows, places, weights, at, which = [], [], [], [], [], []
    count = plain = 0
    for i in own:
        words = texts[i]
        if not words:
            continue
        marks = []
        for w in words:
            if w not in cache:
                cache[w] = [index[f] for f in token_features(w) if f in index]
            marks.append(cache[w])
        hit = np.fromiter((bool(m) for m in marks), bool, len(marks))
        if not hit.any():
            plain += 1
            if plain % plain_share != 1 % plain_share:
                continue
        tag_rows.append(_pieces((hit & bool(labels[i])).astype(float), 0.0))
        mask_rows.append(_pieces(np.ones(len(words)), 0.0) > 0)
        places.append(np.arange(len(mask_rows[-1])))
        weights.append(np.full(len(mask_rows[-1]), 1.0 if hit.any() else float(plain_share)))
        for t in np.flatnonzero(hit):
            for k in marks[t]:
                at.append(count * PIECE + t)
                which.append(k)
        count += len(mask_rows[-1])
    if not count:
        return fit_field([], np.empty(0), np.empty(0, bool))
    tags, mask = np.concatenate(tag_rows), np.concatenate(mask_rows)
    place, weight = np.concatenate(places), np.concatenate(weights)
    share = mask * weight[:, None]
    at_, which_ = np.array(at, np.int64), np.array(which, np.int64)
    seen = np.bincount(which_, tags.ravel()[at_], len(features)) if len(at_) else np.zeros(len(features))
    later = np.flatnonzero(place > 0)

    def moves_of(u: int, v: int) -> float:
        inside = ((tags[:, :-1] == u) & (tags[:, 1:] == v)) * share[:, 1:]
        return inside.sum() + (((tags[later - 1, -1] == u) & (tags[later, 0] == v)) * weight[later]).sum()

    moved = np.array([[moves_of(u, v) for v in (0, 1)] for u in (0, 1)])
    size = share.sum()

    def slope(w: np.ndarray) -> np.ndarray:
        moves, bias, own_weights = w[:4].reshape(2, 2), w[4], w[5:]
        e = np.full(mask.size, bias)
        if len(at_):
            e += np.bincount(at_, own_weights[which_], mask.size)
        p, expected = marginals(e.reshape(mask.shape), moves, mask, place, weight)
        flat = p.ravel()
        # A text with markers has weight 1, so what the features see needs none.
        g = np.concatenate([(moved - expected).ravel(), [(tags * share).sum() - (p * share).sum()], seen - (np.bincount(which_, flat[at_], len(features)) if len(at_) else 0)])
        return g / size - 1e-6 * w

    start = np.zeros(5 + len(features))
    start[4], start[5:] = -4.0, 4.0
    w = _adam(start, slope, STEPS, 0.1)
    model.moves, model.bias = w[:4].reshape(2, 2), float(w[4])
    model.weights = dict(zip(features, w[5:].tolist()))
    fit = np.flatnonzero(aggregate)
    x = np.array([_document_features(p) for p in text_marginals([texts[i] for i in fit], model)]).reshape(len(fit), 5)
    y = labels[fit]
    weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * 0.5 + 0.5 / max(1, len(y))
    model.document = _adam(np.array([-3.0, 3.0, 1.0, 1.0, 1.0]), lambda b: x.T @ ((y - 1 / (1 + np.exp(-(x @ b)))) * weight) - 1e-4 * b, 600, 0.05)
    return model


def text_marginals(texts: list[list[str]], model: ToxicityModel, emissions: _Emissions | None = None) -> list[np.ndarray]:
    """Toxic marginals of the tokens of each text, all pieces of the batch side by side."""
    emissions = _Emissions(model.weights) if emissions is None else emissions
    rows, masks, places, sizes = [], [], [], []
    for words in texts:
        sizes.append(len(words))
        if words:
            values = np.fromiter(map(emissions.__getitem__, words), float, len(words)) + model.bias
            rows.append(_pieces(values, 0.0))
            masks.append(_pieces(np.ones(len(words)), 0.0) > 0)
            places.append(np.arange(len(rows[-1])))
    if not rows:
        return [np.empty(0) for _ in texts]
    p = marginals(np.concatenate(rows), model.moves, np.concatenate(masks), np.concatenate(places))[0]
    out, start = [], 0
    for n in sizes:
        k = -(-n // PIECE)
        out.append(p[start : start + k].ravel()[:n])
        start += k
    return out


def _spans(text: str, p: np.ndarray) -> list[dict[str, int]]:
    """Character offset and length of runs of tokens tagged toxic."""
    tagged, out, last = set(np.flatnonzero(p >= 0.5).tolist()), [], -2
    if not tagged:
        return []
    for k, m in enumerate(TOKEN.finditer(text)):
        if k in tagged:
            if last == k - 1:
                out[-1]["length"] = m.end() - out[-1]["start"]
            else:
                out.append({"start": m.start(), "length": m.end() - m.start()})
            last = k
    return out


def fit_toxicity(points: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, plain_share: int = PLAIN_SHARE) -> ToxicityModel:
    """Model from points(item_id, text) and labels(item_id, label): 1 for toxic items.

    `rows` bounds the labelled sample, on which one task fits; only the model comes to the driver. Of its texts without any marker one in
    `plain_share` trains the field, weighted by it. Without labels, with an empty table, or with labels of
    one kind only, the model gives every text one low, or that kind's, score.
    """

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("item_id")
        texts = [list(map(sys.intern, TOKEN.findall(t))) for t in frame["text"]]
        model = fit_field(texts, frame["label"].to_numpy(dtype=float), np.arange(len(frame)) % 4 == 3, plain_share)
        line = {"features": list(model.weights), "weights": list(model.weights.values()), "bias": model.bias, "moves": model.moves.ravel(), "document": model.document}
        return pd.DataFrame({name: [value] for name, value in line.items()})

    schema = "features array<string>, weights array<double>, bias double, moves array<double>, document array<double>"
    sample = labelled_sample(points, labels, rows).select("item_id", "text", "label")
    fitted = sample.groupBy(F.lit(0).alias("all")).applyInPandas(fit, schema).collect()  # one line, or none
    if not fitted:
        return fit_field([], np.empty(0), np.empty(0, bool))
    line = fitted[0]
    return ToxicityModel(dict(zip(line["features"], line["weights"])), line["bias"], np.array(line["moves"]).reshape(2, 2), np.array(line["document"]))


def score_toxicity(points: DataFrame, model: ToxicityModel, keep: Sequence[str] = ()) -> DataFrame:
    """item_id, score, predicted, spans of every point, and its columns named in keep.

    score: chance that the label is 1; predicted: score >= 0.5; spans: array<struct<start, length>> in
    characters of the text, neighbouring toxic tokens joined. points(item_id, text, ...): a null text
    counts as empty, an empty one has no spans and the score of no toxic token. Null ids, repeated rows
    and extra columns change nothing.
    """
    kept = "".join(f"`{c}` {id_type(points, c)}, " for c in keep)
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
    emissions = _Emissions(model.weights)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, scores, spans = batch.column(1).to_pylist(), [], []
        for first in range(0, len(texts), 200):
            part = [t or "" for t in texts[first : first + 200]]
            tagged = text_marginals([TOKEN.findall(t) for t in part], model, emissions)
            x = np.array([_document_features(p) for p in tagged])
            scores.append(1 / (1 + np.exp(-np.clip(x @ model.document, -60, 60))))
            spans += [_spans(t, p) for t, p in zip(part, tagged)]
        score = np.concatenate(scores) if scores else np.empty(0)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[2:], batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, spans_type)],
            names=[*keep, "item_id", "score", "predicted", "spans"],
        )

    cols = points.select("item_id", "text", *[F.col(c).alias(f"_keep{k}") for k, c in enumerate(keep)])
    return map_batches(cols, run, f"{kept}item_id {id_type(points)}, score double, predicted int, spans array<struct<start:int,length:int>>")
