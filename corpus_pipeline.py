"""The corpus pipeline: quality, toxicity, near-duplicates, mix, packing, each stage over what the last one kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from itemnorm.llm import mixing, packing, quality, queries, simhash, toxicity
from itemnorm.llm.common import prepare
from itemnorm.session import cut_lineage

#: Near-duplicates of the pipeline: words of a shingle, least Jaccard similarity, differing bits the index looks for.
SHINGLE, SIMILARITY, DISTANCE = 5, 0.8, 3
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _points(docs: DataFrame) -> DataFrame:
    """The documents with their id as item_id too, so that a scorer can hand the whole row on."""
    return docs.select(F.col("doc_id").alias("item_id"), *COLUMNS)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on the labels of these documents, predicts as good.

    Each row is judged by its own whole text, without a shuffle. A null text is judged as an empty one, rows that repeat are
    judged alike, and a null id only keeps a row out of the fit. An empty table gives an empty result.
    """
    points = _points(docs)
    labels = queries.document_labels(prepare(spark), sf_dir, "quality", lambda d: queries.remainder(d, 3) != 1)
    scored = quality.score_quality(points, quality.fit_quality(points, labels), keep=COLUMNS)
    return scored.where("predicted = 1").select(*COLUMNS)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity field, fitted on the labels of these documents, does not predict as toxic.

    Nulls, repeated rows, long texts and empty tables as in `keep_good`.
    """
    points = _points(docs)
    labels = queries.document_labels(prepare(spark), sf_dir, "toxic", lambda d: queries.remainder(d, 5) != 0)
    scored = toxicity.score_toxicity(points, toxicity.fit_toxicity(points, labels), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each class of near-duplicates.

    Near-duplicates share SIMILARITY of their shingles of SHINGLE words. The SimHash index meets those up to DISTANCE bits
    apart, bands of least hashes the others (`simhash.similar_firsts`); all pairs met are compared exactly. Null, empty and
    blank texts are one class; an empty table gives an empty result. Of rows that repeat that id one stays; documents without an id stay if nothing with an id is like them.
    """
    prepare(spark)
    numbered = cut_lineage(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    # Rows are told apart by (id, row), so that repeated ids count as copies too.
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("_row"))
    points = numbered.select(F.col("_row").alias("row_id"), key.alias("item_id"), "text")
    kept = simhash.similar_firsts(points, SHINGLE, DISTANCE, SIMILARITY).withColumnRenamed("row_id", "_row")
    return numbered.join(kept, "_row", "left_semi").select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; those it takes no time go.

    Rows are told apart by their own number, so repeated and null ids are drawn one by one. A null or empty text has no
    words: it is balanced as a row. A null source is the last one. An empty table gives an empty result.
    """
    prepare(spark)
    numbered = cut_lineage(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    rows = queries.document_points(numbered, "source", "_row")
    taken = mixing.mix_sources(rows, queries.WEIGHTS, queries.SHARE, queries.LIMIT, keep=["_row"]).where("copies > 0").select("_row", "copies")
    return numbered.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequences and places; columns as in op3.

    A null or empty text is one piece, the end token alone; longer than a sequence is cut in pieces; repeated rows and null
    ids are packed row by row. An empty table gives an empty result.
    """
    prepare(spark)
    return queries.packed_digest(packing.pack_points(queries.document_points(docs), packing.WordTokeniser(queries.tokenizer_path())))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_good),
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_duplicates),
    ("mixing to target weights", mix),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written as Parquet and read again by the next."""
    docs = queries.table(prepare(spark), sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifiers and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL: str | None = None
