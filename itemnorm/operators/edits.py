"""Manual edits as batches: every edit is a line of a small table joined to the rows.

One call applies one batch. Where the outcome would depend on the order of edits inside
a batch in a way a join cannot express, the batch is refused with an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from itemnorm.functions.merging import merge_mode
from itemnorm.functions.text import (
    empty_map,
    non_blank,
    render_template,
    row_source,
    strip_u,
    text_of,
    value_of,
)
from itemnorm.model import Catalogue
from itemnorm.session import cut_lineage
from itemnorm.operators.merge_values import recompute_values
from itemnorm.operators.ordering import (
    dense_position,
    dense_position_pairs,
    first_per_key,
    last_per_key,
    running_sum,
)

ROW = ["cluster_id", "row_pos"]
# The lead columns of a cluster's table, which no attribute may be called.
RESERVED = ("Номенклатура", "Обогащенное стандартизованное наименование")


def _refuse(condition: Column, message: str) -> Column:
    """Filter that keeps every line and fails the job on a line that meets the condition."""
    return F.when(condition, F.raise_error(F.lit(message)).cast("boolean")).otherwise(F.lit(True))


def _edit_order(edits: DataFrame, *ties: str) -> Column:
    """Place of an edit inside its batch: edit_pos where the batch has it, then the named columns."""
    return F.struct(*([F.col("edit_pos")] if "edit_pos" in edits.columns else []), *[F.col(t) for t in ties])


def soft_delete(rows: DataFrame, keys: DataFrame, deleted: bool = True) -> DataFrame:
    """Marks (or restores) the listed rows where they stand. Readers order by (deleted, row_pos)."""
    flag = keys.select(*ROW).distinct().withColumn("_hit", F.lit(deleted))
    return rows.join(flag, ROW, "left").withColumn("deleted", F.coalesce("_hit", "deleted")).drop("_hit")


def delete_rows(catalogue: Catalogue, keys: DataFrame, deleted: bool = True) -> Catalogue:
    """keys(cluster_id, row_pos[, edit_pos]): listed rows marked and moved to the end, in edit order.

    A deleted row comes last; a restored one comes behind the last live row, because deleted rows are
    read after all live ones. The moved rows get new positions, which their aliases and members follow.
    A row listed twice counts at its first edit.
    """
    hit = keys.join(catalogue.rows.select(*ROW), ROW, "left_semi")
    place = F.col("edit_pos").cast("bigint") if "edit_pos" in keys.columns else F.col("row_pos")
    once = hit.select(*ROW, place.alias("edit")).groupBy(*ROW).agg(F.min("edit").alias("edit"))
    ranked = cut_lineage(dense_position_pairs(once, ["cluster_id"], "edit", "row_pos", "rank"))
    last = catalogue.rows.groupBy("cluster_id").agg(F.max("row_pos").alias("last"))
    moves = ranked.join(last, "cluster_id").select(*ROW, (F.col("last") + 1 + F.col("rank")).alias("_to"))

    def followed(df: DataFrame) -> DataFrame:
        return df.join(moves, ROW, "left").withColumn("row_pos", F.coalesce("_to", "row_pos")).select(*df.columns)

    rows = catalogue.rows.join(moves, ROW, "left").withColumns(
        {"deleted": F.when(F.col("_to").isNotNull(), F.lit(deleted)).otherwise(F.col("deleted")), "row_pos": F.coalesce("_to", "row_pos")}
    ).select(*catalogue.rows.columns)
    return catalogue.with_(rows=rows, aliases=followed(catalogue.aliases), members=followed(catalogue.members))


def restore_rows(catalogue: Catalogue, keys: DataFrame) -> Catalogue:
    return delete_rows(catalogue, keys, deleted=False)


def live_rows(rows: DataFrame) -> DataFrame:
    return rows.where(~F.coalesce("deleted", F.lit(False)))


def add_attribute(catalogue: Catalogue, names: DataFrame) -> Catalogue:
    """names(cluster_id, attr[, edit_pos]): new attributes on top of the header, the last added first, "" in every row.

    Names that are taken, reserved or repeated in the batch change nothing.
    """
    new = names.join(catalogue.clusters.select("cluster_id", "attributes"), "cluster_id").where(
        ~F.array_contains("attributes", F.col("attr")) & ~F.col("attr").isin(*RESERVED)
    )
    firsts = new.groupBy("cluster_id", "attr").agg(F.min(_edit_order(names, "attr")).alias("o"))
    more = firsts.groupBy("cluster_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "attr")), asc=False), lambda e: e["attr"]).alias("_more"))
    clusters = catalogue.clusters.join(more, "cluster_id", "left").withColumn(
        "attributes", F.concat(F.coalesce("_more", F.array().cast("array<string>")), "attributes")
    ).drop("_more")
    blank = F.map_from_arrays("_more", F.transform("_more", lambda _: F.lit("")))
    rows = catalogue.rows.join(more, "cluster_id", "left").withColumn(
        "values", F.when(F.col("_more").isNotNull(), F.map_concat("values", blank)).otherwise(F.col("values"))
    ).drop("_more")
    return catalogue.with_(clusters=clusters, rows=rows)


def rename_attribute(catalogue: Catalogue, renames: DataFrame) -> Catalogue:
    """renames(cluster_id, old, new[, edit_pos]), one after the other in edit order.

    A rename changes nothing where the new name is blank, equal, reserved or, at its turn, taken.
    """
    listed = renames.withColumn("new", strip_u("new")).groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct(_edit_order(renames, "old", "new").alias("o"), "old", "new"))).alias("_all")
    )

    def step(state: Column, e: Column) -> Column:
        fits = (e["new"] != "") & (e["new"] != e["old"]) & ~e["new"].isin(*RESERVED) & ~e["old"].isin(*RESERVED) & ~F.array_contains(state["attributes"], e["new"])
        return F.struct(
            F.when(fits, F.transform(state["attributes"], lambda a: F.when(a == e["old"], e["new"]).otherwise(a))).otherwise(state["attributes"]).alias("attributes"),
            F.when(fits, F.concat(state["done"], F.array(F.struct(e["old"].alias("old"), e["new"].alias("new"))))).otherwise(state["done"]).alias("done"),
        )

    start = F.struct(F.col("attributes"), F.array().cast("array<struct<old:string,new:string>>").alias("done"))
    folded = catalogue.clusters.join(listed, "cluster_id").select("cluster_id", F.aggregate("_all", start, step).alias("_f"))
    clusters = catalogue.clusters.join(folded, "cluster_id", "left").withColumn("attributes", F.coalesce(F.col("_f.attributes"), "attributes")).drop("_f")

    def moved(values: Column, e: Column) -> Column:
        rest = F.map_filter(values, lambda k, _: (k != e["old"]) & (k != e["new"]))
        return F.map_concat(rest, F.create_map(e["new"], value_of(values, e["old"])))

    rows = catalogue.rows.join(folded.select("cluster_id", F.col("_f.done").alias("_done")), "cluster_id", "left").withColumn(
        "values", F.when(F.size("_done") > 0, F.aggregate("_done", F.col("values"), moved)).otherwise(F.col("values"))
    ).drop("_done")
    return catalogue.with_(clusters=clusters, rows=rows)


def delete_attribute(catalogue: Catalogue, names: DataFrame) -> Catalogue:
    """names(cluster_id, attr): gone from the header and from every row."""
    gone = names.where(~F.col("attr").isin(*RESERVED)).groupBy("cluster_id").agg(F.collect_set("attr").alias("_gone"))
    kept = lambda name: ~F.coalesce(F.array_contains("_gone", name), F.lit(False))
    clusters = catalogue.clusters.join(gone, "cluster_id", "left").withColumn("attributes", F.filter("attributes", kept)).drop("_gone")
    rows = catalogue.rows.join(gone, "cluster_id", "left").withColumn("values", F.map_filter("values", lambda k, _: kept(k))).drop("_gone")
    return catalogue.with_(clusters=clusters, rows=rows)


def rename_clusters(clusters: DataFrame, renames: DataFrame) -> DataFrame:
    """renames(cluster_id, new_name[, edit_pos]); refused where blank or where another cluster has the name.

    Of several edits of one cluster the last counts; of clusters that want one new name the first gets it.
    """
    named = renames.withColumn("new_name", strip_u("new_name")).where(F.length("new_name") > 0)
    order = _edit_order(renames, "cluster_id")
    wanted = named.groupBy("cluster_id").agg(F.max_by("new_name", order).alias("new_name"), F.max(order).alias("o"))
    taken = clusters.select(strip_u("name").alias("new_name"), F.col("cluster_id").alias("owner")).join(wanted, "new_name").where(
        F.col("owner") != F.col("cluster_id")
    ).select("cluster_id").distinct()
    free = wanted.join(taken, "cluster_id", "left_anti")
    allowed = free.groupBy("new_name").agg(F.min_by("cluster_id", "o").alias("cluster_id"))
    return clusters.join(allowed, "cluster_id", "left").withColumn("name", F.coalesce("new_name", "name")).drop("new_name")


def with_members(catalogue: Catalogue, only: DataFrame | None = None) -> Catalogue:
    """Rows (all, or those listed) without members get one per alias, else one for the item,
    with the row's values."""
    rows = catalogue.rows if only is None else catalogue.rows.join(only.select(*ROW).distinct(), ROW, "left_semi")
    bare = rows.join(catalogue.members.select(*ROW).distinct(), ROW, "left_anti").select(
        *ROW, "item", "values", row_source("source").alias("source")
    )
    named = catalogue.aliases.where(non_blank("alias").isNotNull())
    per_alias = bare.drop("item").join(named, ROW).select(
        *ROW, F.col("alias_pos").alias("member_pos"), strip_u("alias").alias("item"), "values", "source"
    )
    own = bare.join(named.select(*ROW).distinct(), ROW, "left_anti").where(non_blank("item").isNotNull()).select(
        *ROW, F.lit(0).cast("bigint").alias("member_pos"), strip_u("item").alias("item"), "values", "source"
    )
    return catalogue.with_(members=catalogue.members.unionByName(per_alias).unionByName(own))


def edit_values(catalogue: Catalogue, edits: DataFrame) -> Catalogue:
    """edits(cluster_id, row_pos, edit_pos, attr, value): sets the row's cell and, unless members
    already disagree on the attribute, theirs too."""
    c = with_members(catalogue, edits).stored("members")
    last = last_per_key(edits, [*ROW, "attr"], ["edit_pos"]).select(*ROW, "attr", "value")
    changes = last.groupBy(*ROW).agg(F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("_new"))
    rows = c.rows.join(changes, ROW, "left").withColumn("values", F.map_concat("values", F.coalesce("_new", empty_map()))).drop("_new")
    held = c.members.join(last.select(*ROW, "attr"), ROW).select(*ROW, "attr", value_of(F.col("values"), F.col("attr")).alias("v"))
    disputed = held.where(F.col("v") != "").groupBy(*ROW, "attr").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("lo") != F.col("hi"))
    passed = last.join(disputed.select(*ROW, "attr"), [*ROW, "attr"], "left_anti").groupBy(*ROW).agg(
        F.map_from_entries(F.collect_list(F.struct("attr", "value"))).alias("_new")
    )
    members = c.members.join(passed, ROW, "left").withColumn("values", F.map_concat("values", F.coalesce("_new", empty_map()))).drop("_new")
    return c.with_(rows=rows, members=members)


def edit_names(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """edits(cluster_id, row_pos, enriched_name, item[, edit_pos]): null leaves a name as it is; the last edit of a name counts."""
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), _edit_order(edits, c)))
    e = edits.groupBy(*ROW).agg(last("enriched_name").alias("_e"), last("item").alias("_i"))
    return rows.join(e, ROW, "left").withColumns(
        {"enriched_name": F.coalesce("_e", "enriched_name"), "item": F.coalesce("_i", "item")}
    ).drop("_e", "_i")


def insert_cluster_rows(catalogue: Catalogue, new: DataFrame) -> Catalogue:
    """new(cluster_id, insert_pos, name, values): rows on top, the last inserted first; blank names skipped."""
    tops = catalogue.rows.groupBy("cluster_id").agg(
        F.min("row_pos").alias("top"), F.bool_or(non_blank("enriched_name").isNotNull()).alias("enriched")
    )
    heads = catalogue.clusters.select("cluster_id", "attributes")
    placed = new.where(non_blank("name").isNotNull()).join(heads, "cluster_id").join(tops, "cluster_id", "left").select(
        "cluster_id", (F.coalesce("top", F.lit(0)) - 1 - F.col("insert_pos")).alias("row_pos"), strip_u("name").alias("item"),
        F.when(F.coalesce("enriched", F.lit(False)), strip_u("name")).otherwise(F.lit("")).alias("enriched_name"),
        F.map_from_arrays("attributes", F.transform("attributes", lambda a: value_of(F.col("values"), a))).alias("values"),
        F.lit("ai").alias("source"), F.lit(False).alias("deleted"),
    )
    zero = F.lit(0).cast("bigint")
    return catalogue.with_(
        rows=catalogue.rows.unionByName(placed),
        aliases=catalogue.aliases.unionByName(placed.select(*ROW, zero.alias("alias_pos"), F.col("item").alias("alias"))),
        members=catalogue.members.unionByName(placed.select(*ROW, zero.alias("member_pos"), "item", "values", "source")),
    )


def regenerate_names(catalogue: Catalogue, only: DataFrame | None = None) -> tuple[Catalogue, DataFrame]:
    """Names rendered again from the template where the result is not blank; plus how many rows
    have a name afterwards, per cluster with a template."""
    templates = catalogue.clusters.select("cluster_id", text_of("enriched_name_template").alias("_t"))
    rows = catalogue.rows.join(templates, "cluster_id", "left")
    wanted = F.col("_t") != ""
    if only is not None:
        rows = rows.join(only.select(*ROW).distinct().withColumn("_only", F.lit(True)), ROW, "left")
        wanted = wanted & F.coalesce("_only", F.lit(False))
    named = rows.withColumn(
        "enriched_name",
        F.when(wanted, F.coalesce(F.nullif(render_template("_t", "values"), F.lit("")), "enriched_name")).otherwise(F.col("enriched_name")),
    )
    counts = named.where(wanted).groupBy("cluster_id").agg(F.count_if(F.length("enriched_name") > 0).alias("updated"))
    return catalogue.with_(rows=named.select(*catalogue.rows.columns)), counts


def set_template(catalogue: Catalogue, templates: DataFrame) -> Catalogue:
    """templates(cluster_id, template[, edit_pos]); the last one of a cluster counts."""
    last = templates.groupBy("cluster_id").agg(F.max_by("template", _edit_order(templates, "template")).alias("template"))
    clusters = catalogue.clusters.join(last, "cluster_id", "left").withColumn(
        "enriched_name_template", F.coalesce(strip_u("template"), "enriched_name_template")
    ).drop("template")
    return catalogue.with_(clusters=clusters)


def _recomputed(catalogue: Catalogue, touched: DataFrame, members: DataFrame | None = None) -> Catalogue:
    """Values of the touched rows from their members; other rows as they are."""
    members = catalogue.members if members is None else members
    hit = touched.select(*ROW).distinct()
    rows = catalogue.rows.join(hit, ROW, "left_semi")
    fresh = cut_lineage(recompute_values(rows, members.join(hit, ROW, "left_semi"), catalogue.clusters))
    updated = rows.join(fresh.withColumnRenamed("values", "_v"), ROW, "left").withColumn("values", F.coalesce("_v", empty_map())).drop("_v")
    return catalogue.with_(rows=catalogue.rows.join(hit, ROW, "left_anti").unionByName(updated.select(*catalogue.rows.columns)))


def set_policy(catalogue: Catalogue, policies: DataFrame) -> Catalogue:
    """policies(cluster_id, attr, mode, separator[, edit_pos]): the last one of an attribute counts; rows recomputed."""
    mode = F.when(F.col("mode") == "accumulative", F.lit("accumulative")).otherwise(F.lit("priority"))
    last = policies.groupBy("cluster_id", "attr").agg(F.max_by(F.struct(mode.alias("mode"), "separator"), _edit_order(policies, "mode", "separator")).alias("p"))
    separator = F.when((F.col("p.mode") == "accumulative") & (F.coalesce("p.separator", F.lit("")) != ""), F.col("p.separator"))
    folded = last.groupBy("cluster_id").agg(
        F.map_from_entries(F.collect_list(F.struct("attr", "p.mode"))).alias("_modes"),
        F.map_from_entries(F.collect_list(F.struct(F.col("attr").alias("k"), separator.alias("v")))).alias("_separators"),
    )
    kept = F.map_filter("attribute_merge_separators", lambda k, _: ~F.map_contains_key("_modes", k))
    new = F.map_filter("_separators", lambda _, v: v.isNotNull())
    changed = F.col("_modes").isNotNull()
    clusters = catalogue.clusters.join(folded, "cluster_id", "left").withColumns(
        {
            "attribute_merge": F.when(changed, F.map_concat("attribute_merge", "_modes")).otherwise(F.col("attribute_merge")),
            "attribute_merge_separators": F.when(changed, F.map_concat(kept, new)).otherwise(F.col("attribute_merge_separators")),
        }
    ).select(*catalogue.clusters.columns)
    touched = catalogue.rows.select(*ROW).join(policies.select("cluster_id").distinct(), "cluster_id", "left_semi")
    c = with_members(catalogue.with_(clusters=clusters), touched).stored("clusters", "rows", "members")
    return _recomputed(c, touched)


def merge_rows(catalogue: Catalogue, merges: DataFrame) -> Catalogue:
    """merges(cluster_id, src, dst, merge_pos): sources disappear into their target row.

    Aliases are united, members appended in merge order, values recomputed, the target's
    name rendered again. A row may be source once and not also a target in one batch.
    """
    both = merges.select("cluster_id", F.explode(F.array("src", "dst")).alias("row_pos"))
    c = with_members(catalogue, both).stored("rows", "aliases", "members")
    sources = merges.groupBy("cluster_id", "src").agg(F.count("*").alias("n"), F.min("dst").alias("dst"), F.min("merge_pos").alias("merge_pos"))
    targets = merges.select("cluster_id", F.col("dst").alias("src"), F.lit(True).alias("_also")).distinct()
    sources = sources.join(targets, ["cluster_id", "src"], "left").where(
        _refuse((F.col("n") > 1) | F.col("_also").isNotNull() | (F.col("src") == F.col("dst")), "a merge source is merged twice or is also a target")
    )
    order = cut_lineage(dense_position(sources.select("cluster_id", "src", "dst", "merge_pos"), ["cluster_id", "dst"], "merge_pos", "rank"))
    moves = order.select("cluster_id", F.col("src").alias("row_pos"), "dst", (F.col("rank") + 1).alias("rank"))
    hit = order.select("cluster_id", F.col("dst").alias("row_pos")).distinct()

    def gathered(df: DataFrame, place: str) -> DataFrame:
        """Lines of touched rows under their target, ranked target first, then sources in order."""
        own = df.join(hit, ROW, "left_semi").withColumn("rank", F.lit(0).cast("bigint"))
        came = df.join(moves, ROW).withColumn("row_pos", F.col("dst")).select(*own.columns)
        return own.unionByName(came)

    members = cut_lineage(_placed(gathered(c.members, "member_pos"), ROW, "member_pos"))
    aliases = gathered(c.aliases.where(non_blank("alias").isNotNull()).withColumn("alias", strip_u("alias")), "alias_pos")
    firsts = aliases.groupBy(*ROW, "alias").agg(F.min(F.struct("rank", "alias_pos")).alias("o")).select(*ROW, "alias", "o.rank", "o.alias_pos")
    united = cut_lineage(_placed(firsts, ROW, "alias_pos").select(*ROW, "alias_pos", "alias"))
    sources_only = moves.select(*ROW)
    touched = hit.unionByName(sources_only)
    rest = {p: getattr(c, p).join(touched, ROW, "left_anti") for p in ("aliases", "members")}
    first_alias = first_per_key(united, ROW, ["alias_pos"]).select(*ROW, F.col("alias").alias("_first"))
    rows = c.rows.join(sources_only, ROW, "left_anti").join(first_alias, ROW, "left").withColumn(
        "item", F.coalesce(non_blank("item"), "_first", F.lit(""))
    ).select(*c.rows.columns)
    merged = c.with_(
        rows=rows,
        aliases=rest["aliases"].unionByName(united),
        members=rest["members"].unionByName(members.select(*c.members.columns)),
    )
    # The target keeps its own value only if its members or the first source's have it.
    early = members.withColumn("early", F.col("rank") <= 1)
    done = _recomputed(merged.stored("rows"), hit, early)
    return regenerate_names(done, only=hit)[0]


def _placed(df: DataFrame, keys: list[str], pos: str) -> DataFrame:
    """Positions after gathering: (rank, old position) ranked densely; rank stays."""
    return dense_position_pairs(df, keys, "rank", pos, "_p").withColumn(pos, F.col("_p")).drop("_p")


def split_aliases(catalogue: Catalogue, splits: DataFrame) -> Catalogue:
    """splits(cluster_id, row_pos, alias): the alias and its member become a row right behind.

    One split per row and call. Row positions are re-numbered densely.
    """
    c = with_members(catalogue, splits).stored("rows", "aliases", "members")
    cuts = splits.where(non_blank("alias").isNotNull()).groupBy(*ROW).agg(
        F.min(strip_u("alias")).alias("name"), F.count("*").alias("n")
    ).where(_refuse(F.col("n") > 1, "two splits of one row in one batch")).drop("n")
    cuts = cut_lineage(cuts.join(c.rows.select(*ROW), ROW, "left_semi"))
    here = c.members.join(cuts, ROW)
    counts = here.groupBy(*ROW).agg(
        F.count("*").alias("n"),
        F.min(F.when(strip_u("item") == F.col("name"), F.col("member_pos"))).alias("by_name"),
        F.min("member_pos").alias("first"),
    )
    taken = counts.select(*ROW, F.coalesce("by_name", F.when(F.col("n") == 1, F.col("first"))).alias("member_pos")).where(F.col("member_pos").isNotNull())
    taken = cut_lineage(taken)
    member = c.members.join(taken, [*ROW, "member_pos"]).select(*ROW, F.col("values").alias("m_values"), F.col("source").alias("m_source"))
    templates = c.clusters.select("cluster_id", text_of("enriched_name_template").alias("_t"))
    info = c.rows.join(cuts, ROW).join(member, ROW, "left").join(templates, "cluster_id").select(
        *ROW, "name", F.coalesce("m_values", "values").alias("values"),
        F.when((F.col("m_source") == "memory") | (F.col("source") == "memory"), F.lit("memory")).otherwise(F.lit("ai")).alias("source"), "_t",
    )
    sized = c.rows.select(*ROW).join(cuts, ROW, "left").select(*ROW, (1 + F.col("name").isNotNull().cast("int")).alias("w"))
    place = cut_lineage(running_sum(sized, ["cluster_id"], "row_pos", "w", "upto").select(*ROW, (F.col("upto") - F.col("w")).alias("new_pos")))

    left_aliases = c.aliases.join(cuts, ROW, "left").where(F.col("name").isNull() | (strip_u("alias") != F.col("name"))).select(*c.aliases.columns)
    emptied = c.rows.join(cuts, ROW, "left_semi").join(left_aliases.select(*ROW).distinct(), ROW, "left_anti")
    fallback = emptied.select(*ROW, F.lit(0).cast("bigint").alias("alias_pos"), F.coalesce(non_blank("item"), non_blank("enriched_name")).alias("alias")).where(F.col("alias").isNotNull())
    aliases = left_aliases.unionByName(fallback)
    left_members = c.members.join(taken, [*ROW, "member_pos"], "left_anti")
    trimmed = with_members(c.with_(aliases=aliases, members=left_members).stored("aliases", "members"), cuts)
    done = _recomputed(trimmed, cuts)
    done = regenerate_names(done, only=cuts)[0]

    def renumbered(df: DataFrame) -> DataFrame:
        return df.join(place, ROW).withColumn("row_pos", F.col("new_pos")).drop("new_pos").select(*df.columns)

    new = renumbered(info).withColumn("row_pos", F.col("row_pos") + 1)
    zero = F.lit(0).cast("bigint")
    new_rows = new.select(
        *ROW, F.col("name").alias("item"),
        F.coalesce(F.nullif(render_template("_t", "values"), F.lit("")), "name").alias("enriched_name"), "values", "source", F.lit(False).alias("deleted"),
    )
    return done.with_(
        rows=renumbered(done.rows).unionByName(new_rows),
        aliases=renumbered(done.aliases).unionByName(new.select(*ROW, zero.alias("alias_pos"), F.col("name").alias("alias"))),
        members=renumbered(done.members).unionByName(new.select(*ROW, zero.alias("member_pos"), F.col("name").alias("item"), "values", "source")),
    )


def move_rows(catalogue: Catalogue, moves: DataFrame) -> Catalogue:
    """moves(cluster_id, row_pos, target_id, move_pos): rows appended to another cluster.

    A row moves once: its first move counts, later ones don't find it. The target gains attributes the row has a value for; missing ones are filled with "".
    """
    c = catalogue
    real = moves.where(F.col("target_id") != F.col("cluster_id")).join(c.rows.select(*ROW), ROW, "left_semi")
    real = real.groupBy(*ROW).agg(F.min(F.struct("move_pos", "target_id")).alias("m")).select(*ROW, "m.target_id", "m.move_pos")
    real = dense_position(real, ["target_id"], "move_pos", "rank")
    last = c.rows.groupBy(F.col("cluster_id").alias("target_id")).agg(F.max("row_pos").alias("last"))
    heads = c.clusters.select("cluster_id", "attributes")
    target_heads = heads.select(F.col("cluster_id").alias("target_id"), F.col("attributes").alias("t_attrs"))
    plan = real.join(last, "target_id", "left").join(target_heads, "target_id").select(
        *ROW, "target_id", "rank", (F.coalesce("last", F.lit(-1)) + 1 + F.col("rank")).alias("new_pos"), "t_attrs"
    )
    moving = c.rows.join(plan, ROW).join(heads, "cluster_id")
    brought = F.filter("attributes", lambda a: ~F.array_contains("t_attrs", a) & (F.coalesce(F.try_element_at("values", a), F.lit("")) != ""))
    gained = moving.select(F.col("target_id").alias("cluster_id"), "rank", F.posexplode(brought).alias("idx", "attr"))
    gained = gained.groupBy("cluster_id", "attr").agg(F.min(F.struct("rank", "idx")).alias("o")).groupBy("cluster_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("o", "attr"))), lambda e: e["attr"]).alias("more")
    )
    clusters = c.clusters.join(gained, "cluster_id", "left").withColumn(
        "attributes", F.concat("attributes", F.coalesce("more", F.array().cast("array<string>")))
    ).drop("more")
    arrived = moving.select(
        F.col("target_id").alias("cluster_id"), F.col("new_pos").alias("row_pos"), "item", "enriched_name", "values", "source", "deleted"
    )
    rows = c.rows.join(plan.select(*ROW), ROW, "left_anti").unionByName(arrived)
    full = clusters.select("cluster_id", F.col("attributes").alias("_attrs")).join(plan.select(F.col("target_id").alias("cluster_id")).distinct(), "cluster_id", "left_semi")
    missing = F.filter("_attrs", lambda a: ~F.map_contains_key("values", a))
    rows = rows.join(full, "cluster_id", "left").withColumn(
        "values",
        F.when(F.col("_attrs").isNotNull(), F.map_concat("values", F.map_from_arrays(missing, F.transform(missing, lambda _: F.lit("")))))
        .otherwise(F.col("values")),
    ).select(*c.rows.columns)

    def followed(df: DataFrame) -> DataFrame:
        to = plan.select(*ROW, "target_id", "new_pos")
        return df.join(to, ROW, "left").withColumns(
            {"cluster_id": F.coalesce("target_id", "cluster_id"), "row_pos": F.coalesce("new_pos", "row_pos")}
        ).select(*df.columns)

    return c.with_(clusters=clusters, rows=rows, aliases=followed(c.aliases), members=followed(c.members))


def priority_conflicts(catalogue: Catalogue) -> DataFrame:
    """cluster_id, row_pos, attr, value, place: competing values of a priority attribute.

    The row's own value comes first if no member has it; reported only where there are
    at least two values.
    """
    held = catalogue.members.select(*ROW, "member_pos", F.posexplode("values").alias("idx", "attr", "value"))
    values = held.select(*ROW, "attr", text_of("value").alias("value"), "member_pos").where(F.col("value") != "").groupBy(*ROW, "attr", "value").agg(F.min("member_pos").alias("place"))
    own = catalogue.rows.select(*ROW, F.explode("values").alias("attr", "value")).select(*ROW, "attr", text_of("value").alias("value")).where(F.col("value") != "")
    extra = own.join(values, [*ROW, "attr", "value"], "left_anti").withColumn("place", F.lit(-1).cast("bigint"))
    modes = catalogue.clusters.select("cluster_id", "attribute_merge")
    everything = values.unionByName(extra.select(*values.columns)).join(modes, "cluster_id").where(merge_mode("attribute_merge", "attr") == "priority").drop("attribute_merge")
    contested = everything.groupBy(*ROW, "attr").agg(F.count("*").alias("n")).where(F.col("n") > 1).select(*ROW, "attr")
    return everything.join(contested, [*ROW, "attr"], "left_semi")


def signatures(catalogue: Catalogue) -> DataFrame:
    """cluster_id, signature: changes with names, attributes, template, source, rows, their order
    and deletion, aliases and members in any order; not with merge policies.

    Lists behind a row enter as sums of two independent hashes, so a row with very many
    aliases is combined map-side and never collected.
    """
    def spread(df: DataFrame, keys: list[str], payload: Column, out: str) -> DataFrame:
        wide = "decimal(38,0)"
        return df.groupBy(*keys).agg(
            F.struct(
                F.count("*").alias("n"),
                F.sum(F.xxhash64(payload).cast(wide)).alias("a"),
                F.sum(F.xxhash64(F.lit("second"), payload).cast(wide)).alias("b"),
            ).alias(out)
        )

    entries = lambda m: F.to_json(F.array_sort(F.map_entries(F.transform_values(F.coalesce(F.col(m), empty_map()), lambda _, v: F.coalesce(v, F.lit(""))))))
    low = lambda c: F.lower(text_of(c))
    alias_sum = spread(catalogue.aliases, ROW, text_of("alias"), "al")
    member_sum = spread(catalogue.members, ROW, F.to_json(F.struct(text_of("item").alias("i"), low("source").alias("s"), entries("values").alias("v"))), "me")
    rows = dense_position(catalogue.rows, ["cluster_id", "deleted"], "row_pos", "place").join(alias_sum, ROW, "left").join(member_sum, ROW, "left")
    line = F.to_json(
        F.struct("place", text_of("item").alias("i"), text_of("enriched_name").alias("e"), low("source").alias("s"), "deleted", entries("values").alias("v"), "al", "me")
    )
    row_sum = spread(rows, ["cluster_id"], line, "ro")
    return catalogue.clusters.join(row_sum, "cluster_id", "left").select(
        "cluster_id",
        F.sha2(
            F.to_json(
                F.struct(
                    text_of("name").alias("n"), low("source").alias("s"), F.array_sort(F.transform("attributes", text_of)).alias("a"),
                    text_of("enriched_name_template").alias("t"), "ro",
                )
            ),
            256,
        ).alias("signature"),
    )


def unsaved_clusters(current: Catalogue, saved: DataFrame) -> DataFrame:
    """cluster_id of clusters whose signature differs from the saved one, or that were never saved."""
    then = saved.select("cluster_id", F.col("signature").alias("_saved"))
    return signatures(current).join(then, "cluster_id", "left").where(
        ~F.col("signature").eqNullSafe(F.col("_saved"))
    ).select("cluster_id")
