"""Embedding of texts: built-in hashing expression, or a model as a batch function."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from itemnorm.functions.vectors import DIMENSIONS, hash_embedding
from itemnorm.session import cut_lineage

BATCH = 32
Embedder = Callable[[DataFrame], DataFrame]


def hashing_embedder(dimensions: int = DIMENSIONS) -> Embedder:
    """DataFrame(text) -> DataFrame(text, vec), all inside the JVM."""

    def embed_texts(texts: DataFrame) -> DataFrame:
        return texts.select("text", hash_embedding("text", dimensions).alias("vec"))

    return embed_texts


def model_embedder(
    load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = BATCH, optional: bool = False
) -> Embedder:
    """load() runs once per task and returns texts -> vectors, called with `batch` texts at a time.

    optional: a batch the model fails on gets null vectors instead of failing the job.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load()

        def call(texts: list[str]) -> list:
            try:
                return [[float(x) for x in v] for v in model(texts)]
            except Exception:
                if not optional:
                    raise
                return [None] * len(texts)

        for pdf in frames:
            texts = pdf["text"].tolist()
            vectors = [v for start in range(0, len(texts), batch) for v in call(texts[start : start + batch])]
            yield pd.DataFrame({"text": texts, "vec": vectors})

    return lambda texts: texts.select("text").mapInPandas(run, "text string, vec array<double>")


def optional_embedder(load: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = BATCH) -> Embedder:
    return model_embedder(load, batch, optional=True)


def embed(df: DataFrame, text: str, embedder: Embedder | None = None, out: str = "vec") -> DataFrame:
    """Adds the vector of a text column: the built-in one row by row in the JVM, a model's once per distinct text."""
    if embedder is None:
        return df.withColumn(out, hash_embedding(text))
    texts = df.select(F.col(text).alias("text")).distinct()
    vectors = embedder(texts).withColumnsRenamed({"text": text, "vec": out})
    return df.join(vectors, text, "left")


def embed_dual(
    df: DataFrame, text: str, local: Embedder | None = None, alt: Embedder | None = None
) -> DataFrame:
    """vec_local for every row; vec_alt where the alternative provider answered, else null."""
    both = embed(df, text, local, "vec_local")
    if alt is None:
        return both.withColumn("vec_alt", F.lit(None).cast("array<double>"))
    return embed(both, text, alt, "vec_alt")


def embed_preferred(df: DataFrame, text: str, preferred: Embedder, local: Embedder | None = None) -> DataFrame:
    """One provider for the whole run: the preferred one if it answered for every row, else local.

    Vectors of two providers are never mixed, they live in different spaces.
    """
    tried = cut_lineage(embed(df, text, preferred))
    if tried.where(F.col("vec").isNull()).isEmpty():
        return tried
    return embed(df, text, local)
