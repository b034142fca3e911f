"""Near-duplicate collapse inside each cluster, and the entries that feed it."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from itemnorm.functions.text import clean_map, empty_map, non_blank, render_template, row_source, strip_u, text_of
from itemnorm.model import Catalogue
from itemnorm.operators.leaders import DISTANCE_LIMIT, leader_groups
from itemnorm.operators.merge_values import fold_groups
from itemnorm.operators.neighbours import BLOCK
from itemnorm.operators.ordering import dense_position_pairs
from itemnorm.session import cut_lineage

ROW = ["cluster_id", "row_pos"]


def collapse_rows(entries: DataFrame, clusters: DataFrame, limit: float = DISTANCE_LIMIT, block: int = BLOCK) -> Catalogue:
    """entries(cluster_id, pos, item, enriched_name, values, source, vec) to one row per leader group.

    row_pos is the leader's pos; alias and member positions are entry positions. The
    clusters part keeps only headers of clusters that have entries.
    """
    groups = leader_groups(entries.select("cluster_id", "pos", "vec"), limit=limit, block=block)
    joined = cut_lineage(
        entries.select(
            "cluster_id", "pos", text_of("item").alias("item"), text_of("enriched_name").alias("enriched_name"),
            clean_map("values").alias("values"), F.coalesce(non_blank("source"), F.lit("ai")).alias("source"),
        )
        .join(groups, ["cluster_id", "pos"])
        .withColumnRenamed("leader_pos", "row_pos")
    )
    aliases = (
        joined.where(F.col("item") != "").groupBy(*ROW, F.col("item").alias("alias")).agg(F.min("pos").alias("alias_pos"))
        .select(*ROW, "alias_pos", "alias")
    )
    members = joined.where(F.col("item") != "").select(*ROW, F.col("pos").alias("member_pos"), "item", "values", "source")
    first_alias = aliases.groupBy(*ROW).agg(F.min_by("alias", "alias_pos").alias("_first"))
    values = fold_groups(joined, clusters, ROW, "pos")
    rows = (
        joined.where(F.col("pos") == F.col("row_pos")).drop("values").join(first_alias, ROW, "left").join(values, ROW, "left")
        .withColumn("enriched_name", F.coalesce(F.nullif("enriched_name", F.lit("")), F.nullif("item", F.lit("")), "_first", F.lit("")))
        .select(
            *ROW, F.coalesce("_first", "enriched_name").alias("item"), "enriched_name",
            F.coalesce("values", empty_map()).alias("values"), "source", F.lit(False).alias("deleted"),
        )
    )
    bare = rows.join(aliases.select(*ROW).distinct(), ROW, "left_anti").where(F.col("enriched_name") != "")
    aliases = aliases.unionByName(bare.select(*ROW, F.lit(0).cast("bigint").alias("alias_pos"), F.col("enriched_name").alias("alias")))
    items = rows.select("cluster_id", F.col("row_pos").alias("item_pos"), F.col("enriched_name").alias("item"))
    heads = clusters.join(joined.select("cluster_id").distinct(), "cluster_id", "left_semi")
    return Catalogue(heads, rows, aliases, members, items)


def row_entries(catalogue: Catalogue) -> DataFrame:
    """cluster_id, pos, item, values, source, row_name: members of each row, else its aliases,
    else its item; in row order, then in place order."""
    c = catalogue
    rows = c.rows.select(
        *ROW, text_of("item").alias("row_item"), text_of("enriched_name").alias("row_name"),
        clean_map("values").alias("row_values"), row_source("source").alias("row_src"),
    )
    has_members = c.members.select(*ROW).distinct()
    from_members = c.members.where(non_blank("item").isNotNull()).join(rows, ROW).select(
        *ROW, F.col("member_pos").alias("place"), strip_u("item").alias("item"),
        F.when(F.coalesce(F.size("values"), F.lit(0)) > 0, clean_map("values")).otherwise(F.col("row_values")).alias("values"),
        row_source("source", F.col("row_src")).alias("source"), "row_name",
    )
    bare = rows.join(has_members, ROW, "left_anti")
    named = c.aliases.where(non_blank("alias").isNotNull()).select(*ROW, "alias_pos", strip_u("alias").alias("alias"))
    from_aliases = bare.join(named, ROW).select(
        *ROW, F.col("alias_pos").alias("place"), F.col("alias").alias("item"), F.col("row_values").alias("values"), F.col("row_src").alias("source"), "row_name"
    )
    from_items = bare.join(named.select(*ROW).distinct(), ROW, "left_anti").where(F.col("row_item") != "").select(
        *ROW, F.lit(0).cast("bigint").alias("place"), F.col("row_item").alias("item"), F.col("row_values").alias("values"), F.col("row_src").alias("source"), "row_name"
    )
    lines = from_members.unionByName(from_aliases).unionByName(from_items)
    return dense_position_pairs(lines, ["cluster_id"], "row_pos", "place", "pos").select(
        "cluster_id", "pos", "item", "values", "source", "row_name"
    )


def named_entries(catalogue: Catalogue) -> DataFrame:
    """row_entries with the name each gets: the template rendered, else the row's name, else the item."""
    templates = catalogue.clusters.select("cluster_id", text_of("enriched_name_template").alias("_t"))
    return row_entries(catalogue).join(templates, "cluster_id").select(
        "cluster_id", "pos", "item", "values", "source",
        F.when(F.col("_t") != "", render_template("_t", "values"))
        .otherwise(F.coalesce(F.nullif("row_name", F.lit("")), "item")).alias("enriched_name"),
    )
