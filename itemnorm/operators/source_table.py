"""The source table: cleaning, choosing items, and edits of rows and columns.

A source table is all-string plus a row_id that orders it. Ids are never re-numbered,
so exclusions and patches that name rows stay valid after inserts and deletes.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, functions as F

from itemnorm.functions.text import non_blank, strip_u, text_of
from itemnorm.operators.ordering import last_per_key

ROW_ID = "row_id"


def data_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c != ROW_ID]


def stripped(df: DataFrame) -> DataFrame:
    return df.select(ROW_ID, *[text_of(c).alias(c) for c in data_columns(df)])


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.where(non_blank(F.concat(*[text_of(c) for c in data_columns(df)])).isNotNull())


def _digests(df: DataFrame) -> DataFrame:
    """row_id, digest, empty: of each row's stripped cells, so that no text is shuffled.

    The digest covers the cells with their lengths; SHA-256 keeps different rows apart.
    """
    columns = data_columns(df)
    cells = F.concat(*[F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)) for c in columns])
    return stripped(df).select(ROW_ID, F.unhex(F.sha2(cells, 256)).alias("digest"), (F.length(F.concat(*columns)) == 0).alias("empty"))


def clean_rows(df: DataFrame) -> DataFrame:
    """No empty rows, first of equal rows. Digests and ids are shuffled; texts only where the join does not fit a broadcast."""
    first = _digests(df).where(~F.col("empty")).groupBy("digest").agg(F.min(ROW_ID).alias(ROW_ID))
    return stripped(df).join(first.select(ROW_ID), ROW_ID, "left_semi")


def clean_stats(df: DataFrame) -> DataFrame:
    """total_rows, kept_rows, removed_empty, removed_duplicates in one line."""
    groups = _digests(df).groupBy("digest", "empty").agg(F.count("*").alias("n"))
    totals = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_rows"),
        F.count_if(~F.col("empty")).alias("kept_rows"),
        F.coalesce(F.sum(F.when(F.col("empty"), F.col("n"))), F.lit(0)).alias("removed_empty"),
    )
    return totals.withColumn(
        "removed_duplicates", F.col("total_rows") - F.col("kept_rows") - F.col("removed_empty")
    )


def exclude_rows(df: DataFrame, excluded: DataFrame) -> DataFrame:
    """Rows whose id is not listed. A delete is the same anti-join, kept."""
    return df.join(excluded.select(ROW_ID), ROW_ID, "left_anti")


delete_rows = exclude_rows


def configure_items(df: DataFrame, column: str, excluded: DataFrame | None = None) -> DataFrame:
    """item_idx, item: the item column of included rows, blanks gone, duplicates kept."""
    if column not in data_columns(df):
        raise ValueError(f"unknown column {column!r}")
    rows = df if excluded is None else exclude_rows(df, excluded)
    return rows.select(F.col(ROW_ID).alias("item_idx"), strip_u(column).alias("item")).where(
        F.length("item") > 0
    )


def base_attributes(df: DataFrame, column: str, disabled: Iterable[str] = ()) -> list[str]:
    hidden = {column, *disabled}
    return [c for c in data_columns(df) if c not in hidden]


def apply_updates(df: DataFrame, patches: DataFrame) -> DataFrame:
    """Cells from patches(row_id, patch_pos, column, value); the last patch of a cell wins,
    unknown columns are ignored."""
    columns = data_columns(df)
    last = last_per_key(patches.where(F.col("column").isin(columns)), [ROW_ID, "column"], ["patch_pos"])
    wide = last.groupBy(ROW_ID).agg(
        *[F.max(F.when(F.col("column") == c, text_of("value"))).alias(f"_new_{c}") for c in columns]
    )
    return df.join(wide, ROW_ID, "left").select(
        ROW_ID, *[F.coalesce(F.col(f"`_new_{c}`"), F.col(f"`{c}`")).alias(c) for c in columns]
    )


def insert_rows(df: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """New rows on top, the last inserted first; the item cell must not be blank.

    new(insert_pos, <cells>): they get ids below the smallest existing one.
    """
    first = df.agg(F.coalesce(F.min(ROW_ID), F.lit(0))).head()[0]
    missing = [c for c in data_columns(df) if c not in new.columns]
    named = new.where(
        F.coalesce(
            non_blank(column).isNotNull(), F.lit(False)
        )
        | F.raise_error(F.lit("the item cell of a new row is blank")).isNotNull()
    )
    cells = [
        (F.lit("") if c in missing else text_of(c)).alias(c) for c in data_columns(df)
    ]
    placed = named.select((F.lit(first) - 1 - F.col("insert_pos")).alias(ROW_ID), *cells)
    return placed.unionByName(df)


def add_column(df: DataFrame, name: str, after: str | None = None, item_column: str | None = None) -> DataFrame:
    """Empty column behind the anchor: the given one, else the item column, else the first."""
    columns = data_columns(df)
    name = name.strip()
    if not name or name in columns:
        raise ValueError(f"column name {name!r} is blank or taken")
    anchor = next((c for c in (after, item_column) if c in columns), columns[0] if columns else None)
    at = columns.index(anchor) + 1 if anchor is not None else 0
    order = [*columns[:at], name, *columns[at:]]
    return df.withColumn(name, F.lit("")).select(ROW_ID, *order)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    new = new.strip()
    if old not in data_columns(df):
        raise ValueError(f"unknown column {old!r}")
    if not new or (new != old and new in data_columns(df)):
        raise ValueError(f"column name {new!r} is blank or taken")
    return df.withColumnRenamed(old, new)


def delete_column(df: DataFrame, name: str) -> DataFrame:
    if name not in data_columns(df):
        raise ValueError(f"unknown column {name!r}")
    if len(data_columns(df)) == 1:
        raise ValueError("the last column cannot be deleted")
    return df.drop(name)


def item_column_first(columns: list[str], item_column: str | None, new_column: str | None = None) -> list[str]:
    """Item column, then a new column if named, then the rest."""
    if not columns:
        return []
    source = item_column if item_column in columns else columns[0]
    rest = [c for c in columns if c != source]
    new = (new_column or "").strip()
    if new in rest:
        rest = [new, *[c for c in rest if c != new]]
    return [source, *rest]
