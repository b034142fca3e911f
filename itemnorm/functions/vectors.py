"""Vector column functions: cosine, dot, and the built-in hashing embedding."""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, functions as F

from itemnorm.functions.text import col, let, lookup_key

DIMENSIONS = 64
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(
        F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, v: acc + v,
    )


def norm(a: Column | str) -> Column:
    return F.sqrt(
        F.aggregate(col(a), F.lit(0.0), lambda acc, v: acc + v.cast("double") * v.cast("double"))
    )


def cosine_distance(a: Column | str, b: Column | str) -> Column:
    """1 for unequal length, empty or zero vectors; never below 0."""
    product = norm(a) * norm(b)
    usable = (F.size(col(a)) == F.size(col(b))) & (F.size(col(a)) > 0) & (product > 0)
    return F.when(usable, F.greatest(F.lit(0.0), 1.0 - dot(a, b) / product)).otherwise(F.lit(1.0))


def unit(a: Column | str) -> Column:
    """Vector of length 1; a zero or missing vector becomes null."""
    return let(
        F.transform(col(a), lambda v: v.cast("double")),
        lambda vec: let(
            norm(vec),
            lambda length: F.when(length > 0, F.transform(vec, lambda v: v / length)),
        ),
    )


#: Trigrams whose bucket a task remembers.
_REMEMBERED = 1 << 20


def hash_embedding(text: Column | str, dimensions: int = DIMENSIONS) -> Column:
    """Unit vector of hashed character trigrams of the padded lookup key, null for a null text.

    A batch function: a digest per trigram is computed once per task and not once per place in a text.
    """
    return _trigram_vectors(dimensions)(F.concat(F.lit("  "), lookup_key(text), F.lit(" ")))


def _trigram_vectors(dimensions: int):
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        bucket: dict[str, int] = {}

        def vector(padded: str | None) -> np.ndarray | None:
            if padded is None:
                return None
            places = []
            for n in range(len(padded) - 2):
                trigram = padded[n : n + 3]
                place = bucket.get(trigram)
                if place is None:
                    if len(bucket) >= _REMEMBERED:
                        bucket.clear()
                    place = bucket[trigram] = int(hashlib.md5(trigram.encode("utf-8", "surrogatepass")).hexdigest()[:6], 16) % dimensions
                places.append(place)
            counts = np.bincount(places, minlength=dimensions).astype(np.float64)
            return counts / np.sqrt((counts * counts).sum())

        for texts in batches:
            yield pd.Series([vector(t) for t in texts])

    return F.pandas_udf(embed, "array<double>")
