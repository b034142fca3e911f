"""Delimited-file scan, header rules, rule dictionaries, and per-cluster exports."""

from __future__ import annotations

import csv
import io
import json
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from itemnorm.functions.text import safe_file_name, text_of

# The two leading columns of every export.
EXPORT_HEADER = ["Обогащенное наименование", "Исходные номенклатуры"]
BOM = "\ufeff"


def read_items(spark: SparkSession, path: str, sep: str = ",", multi_line: bool = False) -> DataFrame:
    """All-string table: stripped cells, "" for missing; the last of equal headers wins.

    A large file is split over many tasks, line by line. For files whose quoted cells hold line breaks
    set multi_line: records are then put together by quote parity, see quoted_records, and such a file is split over
    many tasks too.
    """
    if multi_line:
        return _read_quoted(spark, path, sep)
    reader = spark.read.option("sep", sep).option("quote", '"').option("escape", '"')
    reader = reader.option("encoding", "UTF-8").option("inferSchema", False)
    head = reader.option("header", False).csv(path).head(1)
    if not head:
        raise ValueError(f"no columns in {path}")
    names = _header(head[0])
    df = reader.option("header", True).csv(path).toDF(*[f"_{i}" for i in range(len(names))])
    return _named(df, names)


def _header(cells: Iterable[str | None]) -> list[str]:
    return clean_headers([(v or "").lstrip(BOM) for v in cells], keep_blank=True)


def _named(df: DataFrame, names: list[str]) -> DataFrame:
    last = {name: i for i, name in enumerate(names)}
    return df.select(*[text_of(f"_{i}").alias(name) for name, i in last.items()])


def quoted_records(spark: SparkSession, path: str) -> DataFrame:
    """file, record_no, record: the records of delimited files, line breaks inside quotes kept; record_no counts from 0 in each file.

    A line break ends a record where the quotes before it are even in number. Every task counts the quotes and
    record starts of its own byte range; one line per range carries both on to the ranges after it,
    so no task reads a file from its start. Empty records are left out but counted.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"),
        F.col("value").alias("line"), (F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("quotes"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inside = Window.partitionBy("file", "block").orderBy("n")
    upto = F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # How many records start in a range depends on whether it begins inside quotes: both counts are taken.
    odd = lines.withColumn("odd", upto % 2)
    ranges = odd.groupBy("file", "block").agg(F.sum("quotes").alias("q"), F.count_if(F.col("odd") == 0).alias("even_starts"), F.count_if(F.col("odd") == 1).alias("odd_starts"))
    opened = ranges.withColumn("open", F.coalesce(F.sum("q").over(before), F.lit(0)) % 2)
    starts = F.when(F.col("open") == 0, F.col("even_starts")).otherwise(F.col("odd_starts"))
    ranges = opened.withColumn("first", F.coalesce(F.sum(starts).over(before), F.lit(0))).select("file", "block", "open", "first")
    placed = odd.join(ranges, ["file", "block"]).withColumn("start", ((F.col("odd") + F.col("open")) % 2 == 0).cast("bigint"))
    numbered = placed.withColumn("record_no", F.col("first") + F.sum("start").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    whole = numbered.groupBy("file", "record_no").agg(F.array_sort(F.collect_list(F.struct("block", "n", "line"))).alias("lines"))
    record = F.regexp_replace(F.array_join(F.transform("lines", lambda e: e["line"]), "\n"), "\r$", "")
    return whole.select("file", "record_no", record.alias("record")).where(F.col("record") != "")


def _read_quoted(spark: SparkSession, path: str, sep: str) -> DataFrame:
    records = quoted_records(spark, path)
    options = {"sep": sep, "quote": '"', "escape": '"'}
    first = records.where("record_no = 0").orderBy("file").head(1)
    if not first:
        raise ValueError(f"no columns in {path}")
    names = _header(next(csv.reader(io.StringIO(first[0]["record"], newline=""), delimiter=sep)))
    schema = ", ".join(f"_{i} string" for i in range(len(names)))
    cells = records.where("record_no > 0").select(F.from_csv("record", schema, {**options, "multiLine": "true", "maxCharsPerColumn": "-1"}).alias("r"))
    return _named(cells.select("r.*"), names)


def clean_headers(names: list[str], keep_blank: bool = False) -> list[str]:
    """Stripped header names; a blank one is called col_<n>, counting from 1."""
    stripped = [name.strip() for name in names]
    return stripped if keep_blank else [name or f"col_{i}" for i, name in enumerate(stripped, 1)]


def normalize_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*clean_headers(df.columns))


MAX_RULES_BYTES = 16 << 20


def load_rules(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """canonical -> synonyms, in file order. A configuration file of at most MAX_RULES_BYTES in any store Spark reads."""
    sizes = spark.read.format("binaryFile").load(path).select("length").head(2)
    if len(sizes) != 1 or sizes[0]["length"] > MAX_RULES_BYTES:
        raise ValueError(f"{path} is not one rule file, or larger than {MAX_RULES_BYTES} bytes")
    content = spark.read.format("binaryFile").load(path).select("content").first()["content"]
    return {str(k): [str(s) for s in v] for k, v in json.loads(bytes(content).decode("utf-8")).items()}


def _csv_line(cells: F.Column) -> F.Column:
    """One CSV record, quoting a cell that holds a quote, comma or line break."""
    quoted = F.transform(
        cells,
        lambda c: F.when(
            c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        ).otherwise(c),
    )
    return F.array_join(quoted, ",")


def export_lines(export: DataFrame, clusters: DataFrame) -> DataFrame:
    """file_name, cluster_id, line_pos, line: header line first (with BOM), then the rows.

    export(cluster_id, row_pos, enriched, originals, attribute_values array),
    clusters(cluster_id, file_no, name, attributes).
    """
    named = clusters.select(
        "cluster_id",
        "attributes",
        F.concat(
            F.when(F.col("file_no") < 10, F.format_string("%02d", "file_no")).otherwise(F.col("file_no").cast("string")),
            F.lit("_"),
            safe_file_name("name", F.concat(F.lit("cluster_"), F.col("file_no").cast("string"))),
            F.lit(".csv"),
        ).alias("file_name"),
    )
    lead = F.array(*[F.lit(h) for h in EXPORT_HEADER])
    heads = named.select(
        "file_name",
        "cluster_id",
        F.lit(-1).cast("bigint").alias("line_pos"),
        F.concat(F.lit(BOM), _csv_line(F.concat(lead, "attributes"))).alias("line"),
    )
    body = export.join(named.select("cluster_id", "file_name"), "cluster_id").select(
        "file_name",
        "cluster_id",
        F.col("row_pos").alias("line_pos"),
        _csv_line(F.concat(F.array("enriched", "originals"), "attribute_values")).alias("line"),
    )
    return heads.unionByName(body)


def write_exports(lines: DataFrame, path: str, files_per_cluster: bool = True) -> None:
    """A folder per cluster file; lines of a folder are in order across its part files.

    Range partitioning on (file, position) splits a cluster with very many rows over
    several part files instead of one task; their names sort in line order.
    """
    ordered = lines.repartitionByRange("file_name", "line_pos").sortWithinPartitions("file_name", "line_pos")
    writer = ordered.select("file_name", "line").write
    (writer.partitionBy("file_name") if files_per_cluster else writer).option("lineSep", "\r\n").text(path)


def write_export(lines: DataFrame, path: str) -> None:
    """One cluster's lines as one ordered folder."""
    lines.repartitionByRange("line_pos").sortWithinPartitions("line_pos").select("line").write.option(
        "lineSep", "\r\n"
    ).text(path)
