"""The best rows of many groups inside one task, in memory bounded by groups times rows kept."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class BestRows:
    """Collects (group, score, item_id) and keeps the `k` highest scores of a group, ties to the smaller id, null ids last."""

    def __init__(self, k: int, id_kind: pa.DataType, slack: int = 200_000):
        self.k, self.id_kind, self.slack = k, id_kind, slack
        self.parts: list[pa.Table] = []
        self.rows = self.kept = 0

    def add(self, group: np.ndarray, score: np.ndarray, item_id: pa.Array) -> None:
        if len(group):
            self.parts.append(pa.table([pa.array(group, pa.int64()), pa.array(score, pa.int64()), item_id.cast(self.id_kind)], names=["group", "score", "item_id"]))
            self.rows += len(group)
            if self.rows > self.slack + 2 * self.kept:
                self.compact()

    def compact(self) -> None:
        if not self.parts:
            return
        every = pa.concat_tables(self.parts)
        order = pc.sort_indices(every, sort_keys=[("group", "ascending"), ("score", "descending"), ("item_id", "ascending")])
        ordered = every.take(order)
        group = ordered["group"].to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        place = np.arange(len(group)) - np.repeat(starts, np.diff(np.append(starts, len(group))))
        best = ordered.filter(pa.array(place < self.k)).combine_chunks()
        self.parts, self.rows, self.kept = [best], best.num_rows, best.num_rows

    def batches(self) -> list[pa.RecordBatch]:
        self.compact()
        return self.parts[0].to_batches() if self.parts else []


def kth_scores(best: list, group: int, scores: np.ndarray, k: int) -> None:
    """Keeps the k highest of the group's scores so far in best[group]."""
    held = scores if best[group] is None else np.concatenate([best[group], scores])
    best[group] = np.partition(held, len(held) - k)[-k:] if len(held) > k else held


def least_of(best: list, group: int, k: int, floor: int) -> int:
    """A score that the k-th best row of the group reaches; `floor` while fewer than k rows are known."""
    held = best[group]
    return floor if held is None or len(held) < k else max(floor, int(held.min()))
