"""Building cluster tables: from known items, memory points, new groups; views and exports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from itemnorm.functions.merging import clean_merge_modes, clean_merge_separators
from itemnorm.functions.text import (
    clean_map,
    clean_strings,
    empty_map,
    empty_strings,
    non_blank,
    row_source,
    strip_u,
    text_of,
    value_of,
)
from itemnorm.model import ALIASES, MEMBERS, Catalogue, Memory
from itemnorm.session import cut_lineage
from itemnorm.operators.ordering import (
    dense_position,
    dense_position_pairs,
    dense_text_position,
    first_at,
    first_per_key,
    last_at,
    last_per_key,
    merged_maps,
)

ROW = ["cluster_id", "row_pos"]


def strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>") if values else empty_strings()


def distinct_in_order(df: DataFrame, keys: Sequence[str], value: str, order: Column, out: str) -> DataFrame:
    """Ordered distinct names per key as an array; combined map-side, width = number of names."""
    firsts = df.groupBy(*keys, value).agg(F.min(order).alias("_o"))
    return firsts.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda e: e[value]).alias(out)
    )


def _fill(lines: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "values") -> DataFrame:
    """First non-blank value per attribute in order ("" if all blank), as one map per keys.

    lines(keys, order..., idx, attr, value).
    """
    filled = F.col("value") != ""
    cells = lines.groupBy(*keys, "attr").agg(
        F.min(F.struct(*order, "idx")).alias("_seen"),
        F.coalesce(
            F.min_by(F.when(filled, F.col("value")), F.when(filled, F.struct(*order))), F.lit("")
        ).alias("value"),
    )
    return merged_maps(cells, keys, "attr", "value", F.col("_seen"), out)


def _first_policies(known: DataFrame, column: str, cleaned: Column, out: str) -> DataFrame:
    lines = known.select("cluster_id", "first_idx", F.posexplode(cleaned).alias("idx", "attr", "value"))
    firsts = first_per_key(lines, ["cluster_id", "attr"], ["first_idx", "idx"])
    return merged_maps(firsts, ["cluster_id"], "attr", "value", F.struct("first_idx", "idx"), out)


def known_to_clusters(known: DataFrame, memory: Memory, base: Sequence[str]) -> Catalogue:
    """One cluster per memory cluster name, one row per enriched name.

    known(item_idx, item, item_id, enriched_name, text, cluster_name, attributes,
    attribute_merge, attribute_merge_separators, name_template). Many items may have
    matched one point; a point counts once, at its first item, so the tables below grow
    with the points in use and not with the items that hit them.
    """
    label = F.coalesce(non_blank("cluster_name"), non_blank("text"), strip_u("item"))
    enriched = F.coalesce(non_blank("enriched_name"), non_blank("text"), strip_u("item"))
    labelled = cut_lineage(known.where(non_blank("item").isNotNull()).select(
        "item_idx", strip_u("item").alias("item"), "item_id", label.alias("name"), enriched.alias("enriched_name"),
        "attributes", "attribute_merge", "attribute_merge_separators",
        (F.col("name_template") if "name_template" in known.columns else F.lit(None).cast("string")).alias("name_template"),
    ))
    uses = first_at(labelled, ["name", "enriched_name", "item_id"], "item_idx").withColumnRenamed("item_idx", "first_idx")
    heads = labelled.groupBy("name").agg(
        F.min("item_idx").alias("cluster_id"),
        F.min_by(non_blank("name_template"), F.when(non_blank("name_template").isNotNull(), F.col("item_idx"))).alias("template"),
    )
    rows_pos = labelled.groupBy("name", "enriched_name").agg(F.min("item_idx").alias("row_pos"))
    uses = uses.join(heads.select("name", "cluster_id"), "name").join(rows_pos, ["name", "enriched_name"])

    with_alias = memory.aliases.select("item_id", "alias_pos", strip_u("alias").alias("alias"), "values").where(
        F.length("alias") > 0
    )
    # A point without aliases stands for the items that matched it, each under its own name.
    bare_points = uses.select("item_id").distinct().join(with_alias.select("item_id").distinct(), "item_id", "left_anti")
    bare = (
        labelled.join(bare_points, "item_id", "left_semi")
        .groupBy("name", "enriched_name", "item_id", "item")
        .agg(F.min("item_idx").alias("alias_pos"))
        .select("name", "enriched_name", "item_id", "alias_pos", F.col("item").alias("alias"), F.lit(None).cast("map<string,string>").alias("values"))
    )
    behind = uses.select("name", "enriched_name", "item_id", *ROW, "first_idx", "attributes")
    named = behind.join(with_alias, "item_id").unionByName(behind.join(bare, ["name", "enriched_name", "item_id"]))
    return _assemble(uses, named, heads, base, fill_rows=True)


def _assemble(uses: DataFrame, named: DataFrame, heads: DataFrame, base: Sequence[str], fill_rows: bool) -> Catalogue:
    """uses: one line per (row, point); named: the same exploded to aliases.

    Both feed many outputs and are written out once.
    """
    uses, named = cut_lineage(uses), cut_lineage(named)
    value_lines = uses.select(*ROW, "first_idx", F.posexplode(clean_map("attributes")).alias("idx", "attr", "value"))
    if fill_rows:
        values = _fill(value_lines, ROW, ["first_idx"])
    else:
        firsts = first_at(uses.select(*ROW, "first_idx", "attributes"), ROW, "first_idx")
        values = firsts.select(*ROW, clean_map("attributes").alias("values"))
    member_values = F.when(F.coalesce(F.size("values"), F.lit(0)) > 0, clean_map("values")).otherwise(clean_map("attributes"))
    alias_lines = named.select(*ROW, "first_idx", "alias_pos", "alias", member_values.alias("values"))
    alias_first = alias_lines.groupBy(*ROW, "alias").agg(F.min(F.struct("first_idx", "alias_pos")).alias("o"))
    ranked = alias_first.select(*ROW, "alias", F.col("o.first_idx").alias("a"), F.col("o.alias_pos").alias("b"))
    placed = cut_lineage(dense_position_pairs(ranked, ROW, "a", "b", "alias_pos").select(*ROW, "alias_pos", "alias"))
    exploded = alias_lines.select(
        *ROW, "alias", "first_idx", "alias_pos", F.posexplode_outer("values").alias("idx", "attr", "value")
    )
    member_maps = _fill(
        exploded.where(F.col("attr").isNotNull()), [*ROW, "alias"], ["first_idx", "alias_pos"]
    )
    members = placed.join(member_maps, [*ROW, "alias"], "left").select(
        *ROW,
        F.col("alias_pos").alias("member_pos"),
        F.col("alias").alias("item"),
        F.coalesce("values", empty_map()).alias("values"),
        F.lit("memory").alias("source"),
    )
    first_alias = first_at(placed, ROW, "alias_pos").select(*ROW, F.col("alias").alias("item"))
    rows = (
        uses.select(*ROW, "enriched_name").distinct()
        .join(values, ROW, "left")
        .join(first_alias, ROW, "left")
        .select(
            *ROW, F.coalesce("item", "enriched_name").alias("item"), "enriched_name",
            F.coalesce("values", empty_map()).alias("values"), F.lit("memory").alias("source"),
            F.lit(False).alias("deleted"),
        )
    )
    stage = lambda n, place: F.struct(F.col("first_idx").alias("i"), F.lit(n).alias("s"), place.cast("bigint").alias("p"), F.col("idx").alias("k"))
    attr_lines = value_lines.select("cluster_id", "attr", stage(0, F.lit(0)).alias("o")).unionByName(
        exploded.where(F.col("attr").isNotNull()).select("cluster_id", "attr", stage(1, F.col("alias_pos")).alias("o"))
    )
    attributes = distinct_in_order(attr_lines, ["cluster_id"], "attr", F.col("o"), "attributes")
    policies = uses.select("cluster_id", "first_idx", "attribute_merge", "attribute_merge_separators")
    if fill_rows:
        modes = _first_policies(policies, "attribute_merge", clean_merge_modes("attribute_merge"), "attribute_merge")
        seps = _first_policies(policies, "attribute_merge_separators", clean_merge_separators("attribute_merge_separators"), "attribute_merge_separators")
    else:
        modes = _whole_policy(policies, clean_merge_modes("attribute_merge"), "attribute_merge")
        seps = _whole_policy(policies, clean_merge_separators("attribute_merge_separators"), "attribute_merge_separators")
    clusters = (
        heads.join(attributes, "cluster_id", "left").join(modes, "cluster_id", "left").join(seps, "cluster_id", "left")
        .select(
            "cluster_id", "name", F.coalesce("attributes", strings(base)).alias("attributes"),
            F.coalesce("template", F.lit("")).alias("enriched_name_template"),
            F.coalesce("attribute_merge", empty_map()).alias("attribute_merge"),
            F.coalesce("attribute_merge_separators", empty_map()).alias("attribute_merge_separators"),
            F.lit("memory").alias("source"), F.col("name").alias("memory_cluster_name"),
        )
    )
    items = rows.select("cluster_id", F.col("row_pos").alias("item_pos"), F.col("enriched_name").alias("item"))
    return Catalogue(clusters, rows, placed.select(*ROW, "alias_pos", "alias"), members, items)


def _whole_policy(policies: DataFrame, cleaned: Column, out: str) -> DataFrame:
    """The map of the first point that has one, whole."""
    filled = policies.select("cluster_id", "first_idx", cleaned.alias("m")).where(F.size("m") > 0)
    lines = filled.select("cluster_id", "first_idx", F.map_entries("m").alias(out))
    best = first_per_key(lines, ["cluster_id"], ["first_idx"])
    return best.select("cluster_id", F.map_from_entries(out).alias(out))


def memory_to_clusters(memory: Memory, base: Sequence[str]) -> Catalogue:
    """Clusters rebuilt from memory points; differs from known_to_clusters in that a row keeps
    its first point's values, merge maps come whole, and the template stays blank.

    Points are ordered by their whole id: a cluster's id is the rank of its first point among all, its rows are
    numbered from 0 by the ids of their first points.
    """
    points = memory.points.where(non_blank("text").isNotNull()).select(
        "item_id", strip_u("text").alias("enriched_name"), F.col("cluster_name").alias("name"),
        "attributes", "attribute_merge", "attribute_merge_separators",
    )
    points = cut_lineage(dense_text_position(points, "item_id", "first_idx"))
    heads = points.groupBy("name").agg(F.min("first_idx").alias("cluster_id"), F.lit("").alias("template"))
    firsts = points.groupBy("name", "enriched_name").agg(F.min("first_idx").alias("at"))
    rows_pos = dense_position(firsts, ["name"], "at", "row_pos").select("name", "enriched_name", "row_pos")
    uses = points.join(heads.select("name", "cluster_id"), "name").join(rows_pos, ["name", "enriched_name"])
    with_alias = memory.aliases.select("item_id", "alias_pos", strip_u("alias").alias("alias"), "values").where(
        F.length("alias") > 0
    )
    behind = uses.select("item_id", "enriched_name", *ROW, "first_idx", "attributes")
    bare = behind.join(with_alias.select("item_id").distinct(), "item_id", "left_anti").withColumns(
        {"alias_pos": F.lit(0).cast("bigint"), "alias": F.col("enriched_name"), "values": F.lit(None).cast("map<string,string>")}
    )
    named = behind.join(with_alias, "item_id").unionByName(bare)
    return _assemble(uses, named, heads, base, fill_rows=False)


def new_clusters(groups: DataFrame, profiles: DataFrame, base: Sequence[str]) -> Catalogue:
    """Clusters of unknown items: groups(item_idx, item, cluster_id), profiles(cluster_id, category,
    attributes, name_template). A cluster without a category is called Cluster <n>."""
    ids = dense_position(groups.select("cluster_id").distinct().withColumn("all", F.lit(0)), ["all"], "cluster_id", "n")
    clusters = ids.join(profiles, "cluster_id", "left").select(
        "cluster_id",
        F.coalesce(F.nullif("category", F.lit("")), F.concat(F.lit("Cluster "), (F.col("n") + 1).cast("string"))).alias("name"),
        F.when(F.size("attributes") > 0, F.col("attributes")).otherwise(strings(base)).alias("attributes"),
        text_of("name_template").alias("enriched_name_template"),
        empty_map().alias("attribute_merge"), empty_map().alias("attribute_merge_separators"),
        F.lit("ai").alias("source"), F.lit("").alias("memory_cluster_name"),
    )
    named = groups.where(non_blank("item").isNotNull())
    rows = named.select(
        "cluster_id", F.col("item_idx").alias("row_pos"), "item", F.lit("").alias("enriched_name"),
        empty_map().alias("values"), F.lit("ai").alias("source"), F.lit(False).alias("deleted"),
    )
    spark = groups.sparkSession
    return Catalogue(
        clusters, rows, spark.createDataFrame([], ALIASES), spark.createDataFrame([], MEMBERS),
        named.select("cluster_id", F.col("item_idx").alias("item_pos"), "item"),
    )


def union_catalogues(first: Catalogue, second: Catalogue) -> Catalogue:
    """Two working sets side by side. Cluster ids are first item indexes, so they do not meet."""
    return Catalogue(*[getattr(first, p).unionByName(getattr(second, p)) for p in ("clusters", "rows", "aliases", "members", "items")])


def latest_values(normalized: DataFrame) -> DataFrame:
    """item -> values, the last normalised line of an item wins; normalized(norm_pos, item, values)."""
    named = normalized.where(non_blank("item").isNotNull()).select(
        "norm_pos", strip_u("item").alias("item"), F.map_entries("values").alias("entries")
    )
    last = last_per_key(named, ["item"], ["norm_pos"])
    return last.select("item", F.map_from_entries("entries").alias("values"))


def overlay_rows(catalogue: Catalogue, normalized: DataFrame) -> DataFrame:
    """Rows whose values are overridden by the normalised values of their aliases, in alias order."""
    hits = (
        catalogue.aliases.select(*ROW, "alias_pos", strip_u("alias").alias("item"))
        .join(latest_values(normalized), "item")
        .select(*ROW, "alias_pos", F.posexplode("values").alias("idx", "attr", "value"))
    )
    last = hits.groupBy(*ROW, "attr").agg(
        F.max_by("value", "alias_pos").alias("value"), F.min(F.struct("alias_pos", "idx")).alias("o")
    )
    overlay = merged_maps(last, ROW, "attr", "value", F.col("o"), "overlay")
    return catalogue.rows.join(overlay, ROW, "left").withColumn(
        "values", F.map_concat(F.coalesce("values", empty_map()), F.coalesce("overlay", empty_map()))
    ).drop("overlay")


def memory_names(known: DataFrame, memory: Memory) -> DataFrame:
    """item: names of known items and every alias of the points they matched."""
    own = known.select(strip_u("item").alias("item"))
    theirs = memory.aliases.join(known.select("item_id").distinct(), "item_id", "left_semi").select(
        strip_u("alias").alias("item")
    )
    return own.unionByName(theirs).where(F.length("item") > 0).distinct()


def plain_rows(catalogue: Catalogue, normalized: DataFrame, memory_items: DataFrame) -> DataFrame:
    """Item lines of clusters without enriched names: stored values, then normalised ones;
    the stored row's source, else memory for a known name, else ai."""
    stored = last_per_key(
        catalogue.rows.where(non_blank("item").isNotNull()).select(
            "cluster_id", strip_u("item").alias("item"), "row_pos", F.map_entries("values").alias("stored"), "source"
        ),
        ["cluster_id", "item"], ["row_pos"],
    ).select("cluster_id", "item", F.map_from_entries("stored").alias("stored"), F.col("source").alias("stored_source"))
    latest = latest_values(normalized).withColumnRenamed("values", "fresh")
    known = memory_items.select("item", F.lit("memory").alias("known_source"))
    return (
        catalogue.items.select("cluster_id", "item_pos", strip_u("item").alias("item")).where(F.length("item") > 0)
        .join(stored, ["cluster_id", "item"], "left").join(latest, "item", "left").join(known, "item", "left")
        .select(
            "cluster_id", "item_pos", "item",
            F.map_concat(F.coalesce("stored", empty_map()), F.coalesce("fresh", empty_map())).alias("values"),
            row_source("stored_source", F.coalesce("known_source", F.lit("ai"))).alias("source"),
        )
    )


def inferred_sources(clusters: DataFrame, rows: DataFrame) -> DataFrame:
    """cluster_id, source: the declared one if valid, else from its rows: one kind, manual for both."""
    kinds = rows.select("cluster_id", F.lower(text_of("source")).alias("s")).groupBy("cluster_id").agg(
        F.bool_or(F.col("s") == "memory").alias("m"), F.bool_or(F.col("s") == "ai").alias("a")
    )
    declared = F.lower(text_of("source"))
    return clusters.select("cluster_id", "source").join(kinds, "cluster_id", "left").select(
        "cluster_id",
        F.when(declared.isin("memory", "ai", "manual"), declared)
        .when(F.col("m") & F.col("a"), F.lit("manual"))
        .when(F.col("m"), F.lit("memory")).otherwise(F.lit("ai")).alias("source"),
    )


def attribute_union(clusters: DataFrame, rows: DataFrame, pos: str = "row_pos") -> DataFrame:
    """cluster_id, attributes: declared ones, then names met in row values, in row order."""
    declared = clusters.select("cluster_id", F.posexplode(clean_strings("attributes")).alias("idx", "attr")).select(
        "cluster_id", "attr", F.struct(F.lit(0).alias("s"), F.lit(0).cast("bigint").alias("p"), F.col("idx").alias("k")).alias("o")
    )
    met = rows.select("cluster_id", F.col(pos).alias("p"), F.posexplode(F.map_keys("values")).alias("idx", "attr")).select(
        "cluster_id", strip_u("attr").alias("attr"), F.struct(F.lit(1).alias("s"), F.col("p"), F.col("idx").alias("k")).alias("o")
    ).where(F.length("attr") > 0)
    found = distinct_in_order(declared.unionByName(met), ["cluster_id"], "attr", F.col("o"), "attributes")
    return clusters.select("cluster_id").join(found, "cluster_id", "left").select(
        "cluster_id", F.coalesce("attributes", empty_strings()).alias("attributes")
    )


def complete_values(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """Row values extended to the cluster's attributes, "" where absent."""
    joined = rows.join(attributes.withColumnRenamed("attributes", "_attrs"), "cluster_id")
    names = F.array_union("_attrs", F.map_keys("values"))
    return joined.withColumn(
        "values", F.map_from_arrays(names, F.transform(names, lambda a: value_of(F.col("values"), a)))
    ).drop("_attrs")


def apply_collapsed(catalogue: Catalogue, collapsed: Catalogue) -> Catalogue:
    """Clusters replaced by their collapsed result where there is one; keyed by cluster_id."""
    done = collapsed.clusters.select("cluster_id")
    parts = {
        p: getattr(catalogue, p).join(done, "cluster_id", "left_anti").unionByName(getattr(collapsed, p))
        for p in ("rows", "aliases", "members", "items")
    }
    over = collapsed.clusters.select(
        "cluster_id", *[F.col(c).alias(f"_{c}") for c in collapsed.clusters.columns if c not in ("cluster_id", "source", "memory_cluster_name")]
    )
    clusters = catalogue.clusters.join(over, "cluster_id", "left").select(
        *[F.coalesce(f"_{c}", c).alias(c) if f"_{c}" in over.columns else F.col(c) for c in catalogue.clusters.columns]
    )
    return catalogue.with_(clusters=clusters, **parts)


def name_map(catalogue: Catalogue) -> DataFrame:
    """item -> cluster_name over items, row items, enriched names and aliases.

    A later cluster overwrites an earlier one; blank cluster names read Cluster.
    """
    names = catalogue.clusters.select("cluster_id", F.coalesce(non_blank("name"), F.lit("Cluster")).alias("cluster_name"))
    spellings = (
        catalogue.rows.select("cluster_id", strip_u("enriched_name").alias("item"))
        .unionByName(catalogue.rows.select("cluster_id", strip_u("item").alias("item")))
        .unionByName(catalogue.aliases.select("cluster_id", strip_u("alias").alias("item")))
        .unionByName(catalogue.items.select("cluster_id", strip_u("item").alias("item")))
        .where(F.length("item") > 0)
    )
    owners = spellings.groupBy("item").agg(F.max("cluster_id").alias("cluster_id"))
    return owners.join(names, "cluster_id").select("item", "cluster_name")


def working_view(catalogue: Catalogue, normalized: DataFrame, memory_items: DataFrame) -> Catalogue:
    """Rows with values overlaid, attributes unioned, sources clamped.

    Enriched form if any cluster has an enriched row, else plain form, as one choice
    for the whole set.
    """
    c = catalogue
    enriched = c.rows.where(non_blank("enriched_name").isNotNull())
    if not enriched.isEmpty():
        base = c.with_(rows=enriched, aliases=with_default_aliases(enriched, c.aliases))
        rows = overlay_rows(base, normalized)
        first = first_per_key(base.aliases, ROW, ["alias_pos"]).select(*ROW, F.col("alias").alias("_first"))
        rows = rows.join(first, ROW, "left").select(
            *ROW, F.coalesce("_first", strip_u("enriched_name")).alias("item"), strip_u("enriched_name").alias("enriched_name"),
            clean_map("values").alias("values"), row_source("source").alias("source"), F.lit(False).alias("deleted"),
        )
        aliases = base.aliases
        members = c.members.where(non_blank("item").isNotNull()).join(
            rows.select(*ROW, F.col("source").alias("_row_source")), ROW
        ).select(*ROW, "member_pos", strip_u("item").alias("item"), clean_map("values").alias("values"), row_source("source", F.col("_row_source")).alias("source"))
        items = rows.select("cluster_id", F.col("row_pos").alias("item_pos"), F.col("enriched_name").alias("item"))
    else:
        plain = plain_rows(c, normalized, memory_items)
        rows = plain.select(
            "cluster_id", F.col("item_pos").alias("row_pos"), "item", F.lit("").alias("enriched_name"),
            clean_map("values").alias("values"), "source", F.lit(False).alias("deleted"),
        )
        aliases, members = c.aliases.where(F.lit(False)), c.members.where(F.lit(False))
        items = c.items
    attributes = attribute_union(c.clusters, rows)
    clusters = (
        c.clusters.drop("attributes", "source").join(attributes, "cluster_id").join(inferred_sources(c.clusters, c.rows), "cluster_id")
        .select(
            "cluster_id", F.coalesce(non_blank("name"), F.lit("Cluster")).alias("name"), "attributes",
            text_of("enriched_name_template").alias("enriched_name_template"),
            clean_merge_modes("attribute_merge").alias("attribute_merge"),
            clean_merge_separators("attribute_merge_separators").alias("attribute_merge_separators"),
            "source", text_of("memory_cluster_name").alias("memory_cluster_name"),
        )
    )
    declared = c.clusters.select("cluster_id", clean_strings("attributes").alias("attributes"))
    return Catalogue(clusters, complete_values(rows, declared), aliases, members, items)


def with_default_aliases(rows: DataFrame, aliases: DataFrame) -> DataFrame:
    """Clean aliases of these rows; a row without any gets its item, else its enriched name."""
    own = aliases.select(*ROW, "alias_pos", strip_u("alias").alias("alias")).where(F.length("alias") > 0).join(
        rows.select(*ROW), ROW, "left_semi"
    )
    bare = rows.join(own.select(*ROW).distinct(), ROW, "left_anti").select(
        *ROW, F.lit(0).cast("bigint").alias("alias_pos"), F.coalesce(non_blank("item"), strip_u("enriched_name")).alias("alias")
    )
    return own.unionByName(bare)


def sanitize(catalogue: Catalogue, memory_items: DataFrame, base: Sequence[str]) -> Catalogue:
    """Payload cleaning on save: strip, drop blanks, clamp sources, drop clusters without items."""
    c = catalogue
    items = c.items.select("cluster_id", "item_pos", strip_u("item").alias("item")).where(F.length("item") > 0)
    kept = items.select("cluster_id").distinct()
    live = c.rows.where(~F.coalesce("deleted", F.lit(False)) & non_blank("item").isNotNull()).join(kept, "cluster_id", "left_semi")
    known = memory_items.select("item", F.lit("memory").alias("_known"))
    with_rows = c.rows.where(~F.coalesce("deleted", F.lit(False))).select("cluster_id").distinct()
    fallback = items.join(with_rows, "cluster_id", "left_anti").select(
        "cluster_id", F.col("item_pos").alias("row_pos"), "item", F.lit("").alias("enriched_name"),
        empty_map().alias("values"), F.lit("").alias("source"), F.lit(False).alias("deleted"),
    )
    rows = (
        live.select("cluster_id", "row_pos", strip_u("item").alias("item"), text_of("enriched_name").alias("enriched_name"),
                    clean_map("values").alias("values"), "source", F.lit(False).alias("deleted"))
        .unionByName(fallback).join(known, "item", "left")
        .select("cluster_id", "row_pos", "item", "enriched_name", "values",
                row_source("source", F.coalesce("_known", F.lit("ai"))).alias("source"), "deleted")
    )
    here = rows.select(*ROW, F.col("source").alias("_row_source"))
    members = c.members.where(non_blank("item").isNotNull()).join(here, ROW).select(
        *ROW, "member_pos", strip_u("item").alias("item"), clean_map("values").alias("values"),
        row_source("source", F.col("_row_source")).alias("source"),
    )
    aliases = c.aliases.where(non_blank("alias").isNotNull()).join(here.select(*ROW), ROW, "left_semi").withColumn("alias", strip_u("alias"))
    sources = inferred_sources(c.clusters, rows)
    clusters = c.clusters.join(kept, "cluster_id", "left_semi").drop("source").join(sources, "cluster_id").select(
        "cluster_id", F.coalesce(non_blank("name"), F.lit("Cluster")).alias("name"),
        F.when(F.size(clean_strings("attributes")) > 0, clean_strings("attributes")).otherwise(strings(base)).alias("attributes"),
        text_of("enriched_name_template").alias("enriched_name_template"),
        clean_merge_modes("attribute_merge").alias("attribute_merge"),
        clean_merge_separators("attribute_merge_separators").alias("attribute_merge_separators"),
        "source", text_of("memory_cluster_name").alias("memory_cluster_name"),
    )
    return Catalogue(clusters, rows, aliases, members, items)


def export_rows(catalogue: Catalogue, normalized: DataFrame) -> DataFrame:
    """cluster_id, row_pos, enriched, originals, attribute_values in attribute order.

    A cluster without enriched rows exports its items. `originals` is one cell by the
    file format, so the distinct aliases of a row are joined into one string.
    """
    named = catalogue.rows.where(non_blank("enriched_name").isNotNull())
    overlaid = overlay_rows(catalogue.with_(rows=named), normalized)
    spelled = (
        catalogue.aliases.where(non_blank("alias").isNotNull()).groupBy(*ROW)
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("alias_pos", strip_u("alias").alias("a")))), lambda e: e["a"]), "; ").alias("originals"))
    )
    heads = catalogue.clusters.select("cluster_id", clean_strings("attributes").alias("attributes"))
    cells = F.transform("attributes", lambda a: value_of(F.col("values"), a))
    rows = overlaid.join(spelled, ROW, "left").join(heads, "cluster_id").select(
        *ROW, strip_u("enriched_name").alias("enriched"), F.coalesce("originals", F.lit("")).alias("originals"), cells.alias("attribute_values")
    )
    plain = (
        catalogue.items.join(named.select("cluster_id").distinct(), "cluster_id", "left_anti")
        .select("cluster_id", F.col("item_pos").alias("row_pos"), strip_u("item").alias("item")).where(F.length("item") > 0)
        .join(latest_values(normalized), "item", "left").join(heads, "cluster_id")
        .select(*ROW, F.col("item").alias("enriched"), F.col("item").alias("originals"), cells.alias("attribute_values"))
    )
    return rows.unionByName(plain)


def export_numbers(clusters: DataFrame) -> DataFrame:
    """cluster_id, file_no (from 1, in cluster order), name, attributes."""
    numbered = dense_position(clusters.withColumn("_all", F.lit(0)), ["_all"], "cluster_id", "n")
    return numbered.select("cluster_id", (F.col("n") + 1).alias("file_no"), "name", clean_strings("attributes").alias("attributes"))


def to_wide(catalogue: Catalogue, cluster_id: int, attributes: Sequence[str]) -> DataFrame:
    """Table of one cluster for display: lead column, then one column per attribute."""
    rows = catalogue.rows.where(F.col("cluster_id") == cluster_id)
    use_enriched = not rows.where(non_blank("enriched_name").isNotNull()).isEmpty()
    lead = strip_u("enriched_name") if use_enriched else F.coalesce("item", F.lit(""))
    # The two names the lead column can have.
    title = "Обогащенное стандартизованное наименование" if use_enriched else "Номенклатура"
    return rows.select(
        "row_pos", F.when(F.col("source") == "memory", F.lit("memory")).otherwise(F.lit("ai")).alias("source"), "deleted",
        lead.alias(title), *[F.coalesce(F.try_element_at("values", F.lit(a)), F.lit("")).alias(a) for a in attributes],
    )


def rows_to_memory(catalogue: Catalogue) -> tuple[DataFrame, DataFrame]:
    """(points, aliases) to save: one point per enriched row, one alias line per original.

    Values of an alias: its last member's, else the row's.
    """
    c = catalogue
    heads = c.clusters.select(
        "cluster_id", F.coalesce(non_blank("memory_cluster_name"), non_blank("name"), F.lit("Cluster")).alias("cluster_name"),
        clean_merge_modes("attribute_merge").alias("attribute_merge"), clean_merge_separators("attribute_merge_separators").alias("attribute_merge_separators"),
    )
    rows = c.rows.where(non_blank("enriched_name").isNotNull()).join(heads, "cluster_id")
    points = rows.select(*ROW, strip_u("enriched_name").alias("text"), F.col("values").alias("attributes"), "cluster_name", "attribute_merge", "attribute_merge_separators")
    named = c.aliases.where(non_blank("alias").isNotNull()).select(*ROW, "alias_pos", strip_u("alias").alias("alias")).join(rows.select(*ROW), ROW, "left_semi")
    bare = points.join(named.select(*ROW).distinct(), ROW, "left_anti").select(*ROW, F.lit(0).cast("bigint").alias("alias_pos"), F.col("text").alias("alias"))
    of_member = last_at(
        c.members.where(non_blank("item").isNotNull()).select(*ROW, strip_u("item").alias("alias"), "member_pos", F.map_entries(clean_map("values")).alias("entries")),
        [*ROW, "alias"], "member_pos",
    ).select(*ROW, "alias", F.map_from_entries("entries").alias("own"))
    aliases = (
        named.withColumn("listed", F.lit(True)).unionByName(bare.withColumn("listed", F.lit(False)))
        .join(of_member, [*ROW, "alias"], "left")
        .join(points.select(*ROW, clean_map("attributes").alias("row_values")), ROW)
        .select(*ROW, "alias_pos", "alias", F.when(F.col("listed") | F.col("own").isNotNull(), F.coalesce("own", "row_values")).alias("values"))
    )
    return points, aliases


def normalized_to_memory(normalized: DataFrame, names: DataFrame) -> DataFrame:
    """Points from normalised items when no row has an enriched name; an unmapped item is an error."""
    return (
        normalized.where(non_blank("item").isNotNull()).withColumn("item", strip_u("item")).join(names, "item", "left")
        .select(
            "norm_pos", "item", F.coalesce(non_blank("enriched_name"), "item").alias("text"), F.col("values").alias("attributes"),
            F.coalesce("cluster_name", F.raise_error(F.concat(F.lit("item not in any cluster: "), "item")).cast("string")).alias("cluster_name"),
        )
    )


def load_into(catalogue: Catalogue, loaded: Catalogue) -> Catalogue:
    """Memory clusters brought into the working set: replace those with the same memory name, else append.

    A replaced cluster keeps its id (its place in the list).
    """
    place = catalogue.clusters.where(non_blank("memory_cluster_name").isNotNull()).groupBy(
        strip_u("memory_cluster_name").alias("memory_cluster_name")
    ).agg(F.min("cluster_id").alias("old_id"))
    top = catalogue.clusters.agg(F.coalesce(F.max("cluster_id"), F.lit(-1))).head()[0]
    ranked = dense_position(loaded.clusters.select("cluster_id", "memory_cluster_name").withColumn("_all", F.lit(0)), ["_all"], "cluster_id", "n")
    ids = ranked.join(place, "memory_cluster_name", "left").select(
        "cluster_id", F.coalesce("old_id", F.lit(top) + 1 + F.col("n")).alias("new_id")
    )

    def moved(df: DataFrame) -> DataFrame:
        return df.join(ids, "cluster_id").withColumn("cluster_id", F.col("new_id")).drop("new_id").select(*df.columns)

    gone = ids.select(F.col("new_id").alias("cluster_id"))
    return Catalogue(*[
        getattr(catalogue, p).join(gone, "cluster_id", "left_anti").unionByName(moved(getattr(loaded, p)))
        for p in ("clusters", "rows", "aliases", "members", "items")
    ])


def load_full(catalogue: Catalogue, memory: Memory, wanted: DataFrame, base: Sequence[str]) -> Catalogue:
    """Listed clusters replaced by everything memory holds under their memory name, else under their own.

    A cluster keeps its id. One whose name memory does not know, or that has none, stays as it is.
    """
    name = F.coalesce(non_blank("memory_cluster_name"), non_blank("name")).alias("cluster_name")
    asked = cut_lineage(catalogue.clusters.join(wanted.select("cluster_id").distinct(), "cluster_id", "left_semi").select(F.col("cluster_id").alias("to"), name))
    points = memory.points.join(asked.select("cluster_name").distinct(), "cluster_name", "left_semi")
    loaded = memory_to_clusters(memory.with_(points=points), base)
    places = loaded.clusters.select("cluster_id", F.col("name").alias("cluster_name")).join(asked, "cluster_name").select("cluster_id", "to")

    def placed(df: DataFrame) -> DataFrame:
        return df.join(places, "cluster_id").withColumn("cluster_id", F.col("to")).select(*df.columns)

    gone = places.select(F.col("to").alias("cluster_id"))
    return Catalogue(*[
        getattr(catalogue, p).join(gone, "cluster_id", "left_anti").unionByName(placed(getattr(loaded, p)))
        for p in ("clusters", "rows", "aliases", "members", "items")
    ])


def find_rows(catalogue: Catalogue, hits: DataFrame) -> DataFrame:
    """hits(cluster_name, text, ...) with the row they point at: memory name of the cluster + exact enriched text."""
    names = catalogue.clusters.select("cluster_id", F.coalesce(non_blank("memory_cluster_name"), non_blank("name")).alias("cluster_name"))
    rows = catalogue.rows.select(*ROW, strip_u("enriched_name").alias("text"))
    return hits.join(names, "cluster_name").join(rows, ["cluster_id", "text"])


def select_clusters(clusters: DataFrame, selected: DataFrame | None) -> DataFrame:
    """clusters in selection order; none selected means all; an unknown id is an error.

    selected(sel_pos, cluster_id); a repeated id counts once, at its first place.
    """
    if selected is None or selected.isEmpty():
        return clusters.withColumn("sel_pos", F.col("cluster_id"))
    firsts = selected.groupBy("cluster_id").agg(F.min("sel_pos").alias("sel_pos"))
    joined = firsts.join(clusters.withColumn("_here", F.lit(True)), "cluster_id", "left")
    checked = joined.where(
        F.coalesce("_here", F.raise_error(F.concat(F.lit("cluster out of range: "), F.col("cluster_id").cast("string"))).cast("boolean"))
    )
    return checked.drop("_here").select(*clusters.columns, "sel_pos")
