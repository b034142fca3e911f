"""From clusters to normalised, named and collapsed rows; collapse again after edits."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from itemnorm.functions.merging import clean_merge_modes, clean_merge_separators
from itemnorm.functions.text import (
    clean_map,
    clean_strings,
    empty_map,
    enriched_or_item,
    non_blank,
    row_source,
    standardize_map,
    strip_u,
    text_of,
)
from itemnorm.model import Catalogue
from itemnorm.operators.collapse import collapse_rows, named_entries
from itemnorm.operators.embedding import Embedder, embed
from itemnorm.operators.enrich import ATTEMPTS, Provider, extract_values, failed_groups, missing_attributes
from itemnorm.operators.leaders import DISTANCE_LIMIT
from itemnorm.operators.neighbours import BLOCK
from itemnorm.operators.ordering import dense_position_pairs
from itemnorm.session import cut_lineage

ROW = ["cluster_id", "row_pos"]


def _input_lines(catalogue: Catalogue) -> DataFrame:
    """cluster_id, row_pos, place, item, source, values: every appearance of an item. Rows give their members, or their item
    without any; a cluster without rows gives its item list as new items."""
    c = catalogue
    rows = c.rows.select(
        *ROW, text_of("item").alias("row_item"), row_source("source").alias("row_src"), clean_map("values").alias("row_values")
    )
    named = c.members.where(non_blank("item").isNotNull())
    from_members = named.join(rows, ROW).select(
        *ROW, F.col("member_pos").alias("place"), strip_u("item").alias("item"), row_source("source", F.col("row_src")).alias("source"),
        F.when(F.coalesce(F.size("values"), F.lit(0)) > 0, clean_map("values")).otherwise(F.col("row_values")).alias("values"),
    )
    bare = rows.join(c.members.select(*ROW).distinct(), ROW, "left_anti").where(F.col("row_item") != "")
    from_rows = bare.select(*ROW, F.lit(0).cast("bigint").alias("place"), F.col("row_item").alias("item"), F.col("row_src").alias("source"), F.col("row_values").alias("values"))
    lines = from_members.unionByName(from_rows)
    listed = c.items.join(lines.select("cluster_id").distinct(), "cluster_id", "left_anti").where(non_blank("item").isNotNull()).select(
        "cluster_id", F.lit(0).cast("bigint").alias("row_pos"), F.col("item_pos").alias("place"), strip_u("item").alias("item"),
        F.lit("ai").alias("source"), empty_map().alias("values"),
    )
    return lines.unionByName(listed)


def input_sizes(catalogue: Catalogue) -> DataFrame:
    """cluster_id, n: how many items `normalize_input` has of each cluster, counted without placing them."""
    return _input_lines(catalogue).select("cluster_id", "item").distinct().groupBy("cluster_id").agg(F.count("*").alias("n"))


def normalize_input(catalogue: Catalogue) -> DataFrame:
    """cluster_id, item_pos, item, source, values: distinct items of each cluster.

    An item stands at its first appearance and takes source and values from its last.
    """
    per_item = _input_lines(catalogue).groupBy("cluster_id", "item").agg(
        F.min(F.struct("row_pos", "place")).alias("at"),
        F.max_by(F.struct("source", "values"), F.struct("row_pos", "place")).alias("last"),
    )
    return dense_position_pairs(
        per_item.select("cluster_id", "item", "at.row_pos", "at.place", "last.source", "last.values"),
        ["cluster_id"], "row_pos", "place", "item_pos",
    ).select("cluster_id", "item_pos", "item", "source", "values")


def with_attribute_mode(inputs: DataFrame, mode: str = "default") -> DataFrame:
    """default as is; all: every item new, values forgotten; missing: every item known, gaps only."""
    if mode not in ("default", "all", "missing"):
        raise ValueError("mode must be default, all or missing")
    if mode == "all":
        return inputs.withColumns({"source": F.lit("ai"), "values": empty_map()})
    if mode == "missing":
        return inputs.withColumn("source", F.lit("memory"))
    return inputs


@dataclass(frozen=True)
class Normalized:
    """items(cluster_id, item_pos, item, enriched_name, values, source) and the collapsed clusters, both only of clusters whose
    batches all had usable answers; the rejected batches; failed(cluster_id, batches, error), the clusters they failed; new cache entries."""

    items: DataFrame
    collapsed: Catalogue
    rejected: DataFrame
    failed: DataFrame
    cache: DataFrame


def normalize(
    catalogue: Catalogue,
    inputs: DataFrame | None = None,
    *,
    provider: Provider | None = None,
    embedder: Embedder | None = None,
    cache: DataFrame | None = None,
    rules: dict[str, list[str]] | None = None,
    limit: float = DISTANCE_LIMIT,
    block: int = BLOCK,
    attempts: int = ATTEMPTS,
) -> Normalized:
    """All clusters in one job: extract or fill values, standardise, name, embed, collapse.

    New items are asked for all attributes of their cluster, known ones for those they lack, in one pass
    over the provider; the two kinds do not share batches.
    """
    heads = catalogue.clusters.select("cluster_id", clean_strings("attributes").alias("attributes"), text_of("enriched_name_template").alias("_t"))
    known = (F.col("source") == "memory").alias("known")
    lines = (normalize_input(catalogue) if inputs is None else inputs).join(heads, "cluster_id")
    lines = cut_lineage(missing_attributes(lines.withColumnRenamed("item_pos", "pos").select("*", known)))
    wanted = lines.select("cluster_id", "pos", "item", "known", F.when(F.col("known"), F.col("missing")).otherwise(F.col("attributes")).alias("attributes"))
    wanted = wanted.where(~F.col("known") | (F.size("attributes") > 0))
    found, rejected, answers = extract_values(wanted, provider, cache, attempts=attempts, groups=["cluster_id", "known"])
    failed = failed_groups(rejected)
    kept = lines if answers.complete else lines.join(failed, "cluster_id", "left_anti")
    own = F.when(F.col("known"), F.coalesce("values", empty_map())).otherwise(empty_map())
    named = kept.join(found.withColumnRenamed("values", "_new"), ["cluster_id", "item"], "left").withColumn(
        "values", standardize_map(F.map_concat(own, F.coalesce("_new", empty_map())), rules)
    )
    named = named.select("cluster_id", "pos", "item", F.when(F.col("known"), F.lit("memory")).otherwise(F.col("source")).alias("source"), "_t", "values")
    entries = cut_lineage(
        embed(named.withColumn("enriched_name", enriched_or_item("_t", "values", "item")).drop("_t"), "enriched_name", embedder)
    )
    clusters = catalogue.clusters.withColumns(
        {"attribute_merge": clean_merge_modes("attribute_merge"), "attribute_merge_separators": clean_merge_separators("attribute_merge_separators")}
    )
    collapsed = collapse_rows(entries, clusters, limit, block)
    items = entries.select("cluster_id", F.col("pos").alias("item_pos"), "item", "enriched_name", "values", "source")
    return Normalized(items, collapsed, rejected, failed, answers.cache)


def rededupe(catalogue: Catalogue, *, embedder: Embedder | None = None, limit: float = DISTANCE_LIMIT, block: int = BLOCK) -> Catalogue:
    """Duplicates found anew after edits; clusters without entries stay as they are."""
    clusters = catalogue.clusters.withColumns(
        {"attribute_merge": clean_merge_modes("attribute_merge"), "attribute_merge_separators": clean_merge_separators("attribute_merge_separators")}
    )
    named = named_entries(catalogue).withColumn("_text", F.coalesce(F.nullif("enriched_name", F.lit("")), "item"))
    entries = cut_lineage(embed(named, "_text", embedder).drop("_text"))
    fresh = collapse_rows(entries, clusters, limit, block)
    done = cut_lineage(entries.select("cluster_id").distinct())
    parts = {
        p: getattr(fresh, p).unionByName(getattr(catalogue, p).join(done, "cluster_id", "left_anti"))
        for p in ("rows", "aliases", "members", "items")
    }
    return Catalogue(catalogue.clusters, **parts)
