"""Fold the attribute values of every group of rows under per-attribute policies.

Works on exploded (group, position, attribute, value) lines, so a group with a third
of all rows is combined map-side: priority is a min_by, accumulative keeps one line
per distinct part. Only the finished cell of an accumulative attribute is collected.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from itemnorm.functions.merging import (
    SEPARATORS,
    SPLIT_PATTERN,
    count_of,
    explicit_separator,
    merge_accumulative,
    merge_mode,
    split_parts,
)
from itemnorm.functions.text import clean_map
from itemnorm.operators.ordering import dense_position, merged_maps, running_sum
from itemnorm.session import cut_lineage

SPAN = 16
#: Values of one group folded in one row before the text outgrows the parts.
FOLD_BLOCK = 1024


def explode_values(df: DataFrame, keys: Sequence[str], pos: str, values: str = "values") -> DataFrame:
    """keys, pos, attr_idx, attr, value: one line per attribute of each row."""
    return df.select(
        *keys, F.col(pos).alias("pos"), F.posexplode(clean_map(values)).alias("attr_idx", "attr", "value")
    )


def with_policies(lines: DataFrame, clusters: DataFrame) -> DataFrame:
    """Adds mode and separator of each attribute from its cluster's header line."""
    policies = clusters.select("cluster_id", "attribute_merge", "attribute_merge_separators")
    joined = lines.join(policies, "cluster_id", "left")
    return joined.select(
        *lines.columns,
        merge_mode("attribute_merge", "attr").alias("mode"),
        explicit_separator("attribute_merge_separators", "attr").alias("sep"),
    )


def final_separators(values: DataFrame, parts: DataFrame, keys: Sequence[str], levels: int = 3) -> DataFrame:
    """Separator left after folding the values in order when none is given explicitly.

    Each fold step picks the separator seen most often in (merged so far, incoming).
    The merged text holds (distinct parts so far - 1) copies of the separator chosen
    before, so a step is a function {; , |} -> {; , |}, and functions compose in
    chunks of positions: no task sees a whole group. Steps without any separator
    character cannot change the choice once two parts exist and are left out.
    Each level shortens positions by SPAN bits; the caller names how many are needed.
    """
    keys = list(keys)
    touched = values.where(F.col("value").rlike(SPLIT_PATTERN))
    news = parts.groupBy(*keys, F.col("first.pos").alias("pos")).agg(F.count("*").alias("new"))
    steps = (
        touched.select(*keys, "pos", "value", F.lit(0).cast("bigint").alias("new"))
        .unionByName(
            news.join(touched.select(*keys).distinct(), keys, "left_semi").select(
                *keys, "pos", F.lit(None).cast("string").alias("value"), "new"
            )
        )
        .groupBy(*keys, "pos")
        .agg(F.max("value").alias("value"), F.sum("new").alias("new"))
    )
    counted = running_sum(steps, keys, "pos", "new", "upto").where(F.col("value").isNotNull())
    held = F.greatest(F.col("upto") - F.col("new") - 1, F.lit(0))

    def image(state: int):
        # Joining one part leaves no separator behind, so `held` is 0 until two parts exist.
        scores = [
            count_of(F.col("value"), ch) + (held if i == state else F.lit(0))
            for i, (ch, _) in enumerate(SEPARATORS)
        ]
        return (
            F.when((scores[0] >= scores[1]) & (scores[0] >= scores[2]), F.lit(0))
            .when(scores[1] >= scores[2], F.lit(1))
            .otherwise(F.lit(2))
        )

    # A merged text of one part carries no separator at all: the choice restarts from ';'.
    fresh = F.col("upto") <= 1
    step = F.array(*[F.when(fresh, F.lit(0)).otherwise(image(s)) for s in range(3)])
    level = counted.select(*keys, "pos", step.alias("f"))
    for _ in range(levels):
        level = (
            level.groupBy(*keys, F.shiftright("pos", SPAN).alias("pos"))
            .agg(F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), "f"))).alias("fs"))
            .select(*keys, "pos", _composed("fs").alias("f"))
        )
    top = level.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col("pos").alias("p"), "f"))).alias("fs")
    )
    chosen = _composed("fs")[0]
    names = F.array(*[F.lit(padded) for _, padded in SEPARATORS])
    return top.select(*keys, F.element_at(names, chosen + 1).alias("found_sep"))


def _composed(steps: str):
    start = F.array(F.lit(0), F.lit(1), F.lit(2))
    return F.aggregate(
        F.col(steps), start, lambda acc, s: F.transform(acc, lambda i: F.element_at(s["f"], i + 1))
    )


def fold_accumulative(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """keys + attr -> merged value, over lines(keys, pos, attr, value, sep), pos unique per key+attr.

    The lines are written once; what is in them decides which of the steps run at all.
    """
    group = [*keys, "attr"]
    pos = "pos"
    filled = cut_lineage(lines.where(F.col("value") != "").select(*group, pos, "value", "sep"))
    padded = [p for _, p in SEPARATORS]
    set_like = F.col("sep").isNull() | F.col("sep").isin(padded)
    facts = filled.agg(
        F.max(F.abs(pos)).alias("far"),
        F.coalesce(F.bool_or(F.col("sep").isNull() & F.col("value").rlike(SPLIT_PATTERN)), F.lit(False)).alias("found"),
        F.coalesce(F.bool_or(~set_like), F.lit(False)).alias("typed"),
    ).head()

    plain = filled.where(set_like)
    exploded = plain.select(
        *group, "sep", F.col(pos).alias("pos"), F.posexplode(split_parts("value")).alias("idx", "part")
    )
    parts = exploded.groupBy(*group, "part").agg(
        F.min(F.struct("pos", "idx")).alias("first"), F.first("sep").alias("sep")
    )
    cells = parts.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("first", "part"))).alias("ps"), F.first("sep").alias("sep")
    )
    if facts["found"]:
        levels = max(0, -(-(int(facts["far"]).bit_length() - SPAN) // SPAN))
        found = final_separators(
            plain.where(F.col("sep").isNull()).select(*group, "pos", "value"),
            parts.where(F.col("sep").isNull()),
            group,
            levels,
        )
        cells = cells.join(found, group, "left")
    else:
        cells = cells.withColumn("found_sep", F.lit(None).cast("string"))
    cells = (
        cells.select(*group, F.array_join(F.col("ps.part"), "\x00").alias("joined"), "sep", "found_sep")
        .select(
            *group,
            F.replace(
                "joined", F.lit("\x00"), F.coalesce("sep", "found_sep", F.lit(SEPARATORS[0][1]))
            ).alias("merged"),
        )
    )
    if not facts["typed"]:
        return cells
    return cells.unionByName(_typed(filled.where(~set_like), group))


def _typed(filled: DataFrame, group: list[str]) -> DataFrame:
    """Values joined by a separator that does not split: all parts in order, but for repeats of the whole text so far.

    While no part holds the separator, the text so far equals a part only as long as it is the first part
    alone: repeats of that are dropped up to the first value that brings another part, and everything
    after it stays. Groups in which a part holds the separator are folded by `_growing_fold`. Only a
    separator that itself holds one of `;,|` is folded value by value in one row: every step splits and
    joins the whole text again, and the text grows with each.
    """
    lines = cut_lineage(filled.select(*group, "pos", "sep", F.posexplode(split_parts("value")).alias("idx", "part")))
    facts = lines.groupBy(*group).agg(
        F.bool_or(F.col("part").contains(F.col("sep"))).alias("held"),
        F.bool_or(F.col("sep").rlike(SPLIT_PATTERN)).alias("split"),
        F.min(F.struct("pos", "idx")).alias("first"),
        F.min_by("part", F.struct("pos", "idx")).alias("alone"),
    )
    known = cut_lineage(lines.join(facts, group))
    others = known.where(F.col("part") != F.col("alone")).groupBy(*group).agg(F.min("pos").alias("other"))
    easy = known.where(~F.col("held") & ~F.col("split")).join(others, group, "left")
    kept = easy.where((F.struct("pos", "idx") == F.col("first")) | (F.col("part") != F.col("alone")) | (F.col("pos") > F.col("other")))
    joined = kept.groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("pos", "idx", "part"))).alias("ps"), F.first("sep").alias("sep")
    ).select(*group, F.array_join(F.col("ps.part"), "\x00").alias("t"), "sep").select(*group, F.replace("t", F.lit("\x00"), "sep").alias("merged"))
    split = facts.where("split").select(*group)
    folded = (
        filled.join(split, group, "left_semi").groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("vs"), F.first("sep").alias("sep"))
        .select(*group, F.aggregate(F.col("vs"), F.lit(""), lambda acc, v: merge_accumulative(acc, v["value"], F.col("sep"))).alias("merged"))
    )
    out = joined.unionByName(folded)
    held = facts.where(F.col("held") & ~F.col("split")).select(*group)
    if held.isEmpty():
        return out
    values = filled.join(held, group, "left_semi").select(*group, "pos", "sep", split_parts("value").alias("ps"))
    return out.unionByName(_growing_fold(values, group))


def _growing_fold(values: DataFrame, group: list[str], block: int = FOLD_BLOCK) -> DataFrame:
    """group, merged over values(group, pos, sep, ps): a part is dropped where it equals the whole text so far.

    The text so far only grows, so once it is longer than the longest part of its group everything stays.
    Until then a group goes on in rounds: values that are the text so far alone are skipped up to the
    first that adds something, and at most `block` values from there are folded in one row. No task
    holds more of a group than that, but for its finished cell.
    """
    lines = cut_lineage(dense_position(values.where(F.size("ps") > 0), group, "pos", "at"))
    state = cut_lineage(
        lines.groupBy(*group)
        .agg(F.first("sep").alias("sep"), F.max(F.array_max(F.transform("ps", F.length))).alias("longest"), F.max("at").alias("last"))
        .select(*group, "sep", "longest", "last", F.lit("").alias("t"), F.lit(-1).cast("bigint").alias("done"))
    )
    is_open = (F.length("t") <= F.col("longest")) & (F.col("done") < F.col("last"))

    def grown(acc, v):
        new = F.filter(v["ps"], lambda p: p != acc["t"])
        added = F.replace(F.array_join(new, "\x00"), F.lit("\x00"), F.col("sep"))
        text = F.when(F.size(new) == 0, acc["t"]).when(acc["t"] == "", added).otherwise(F.concat(acc["t"], "sep", added))
        return F.when(F.length(acc["t"]) > F.col("longest"), acc).otherwise(F.struct(text.alias("t"), (acc["used"] + 1).alias("used")))

    closed = state.where(~is_open)
    while not state.isEmpty():
        opened = state.where(is_open)
        starts = (
            lines.select(*group, "at", "ps").join(opened, group)
            .where((F.col("at") > F.col("done")) & (F.col("ps") != F.array("t")))
            .groupBy(*group).agg(F.min("at").alias("start"))
        )
        placed = cut_lineage(opened.join(starts, group, "left"))
        # Nothing but repeats of the text so far is left.
        closed = closed.unionByName(placed.where(F.col("start").isNull()).drop("start").withColumn("done", F.col("last")))
        going = placed.where(F.col("start").isNotNull())
        taken = (
            lines.select(*group, "at", "ps").join(going.select(*group, "start"), group)
            .where((F.col("at") >= F.col("start")) & (F.col("at") < F.col("start") + block))
            .groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("at", "ps"))).alias("vs"))
        )
        zero = F.struct(F.col("t"), F.lit(0).alias("used"))
        state = cut_lineage(
            going.join(taken, group).withColumn("f", F.aggregate("vs", zero, grown))
            .select(*group, "sep", "longest", "last", F.col("f.t").alias("t"), (F.col("start") + F.col("f.used") - 1).alias("done"))
        )
        closed = closed.unionByName(state.where(~is_open))
    tails = (
        lines.select(*group, "at", "ps").join(closed.select(*group, "done"), group).where(F.col("at") > F.col("done"))
        .groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("at", "ps"))).alias("vs"))
        .select(*group, F.array_join(F.flatten(F.col("vs.ps")), "\x00").alias("tail"))
    )
    tail = F.replace("tail", F.lit("\x00"), F.col("sep"))
    return closed.join(tails, group, "left").select(
        *group, F.when(F.col("tail").isNull(), F.col("t")).otherwise(F.concat("t", "sep", tail)).alias("merged")
    )


def fold_groups(members: DataFrame, clusters: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Values of each group: its first row's values, then every row folded in, in order.

    keys must contain cluster_id. A blank value makes a key only where the policy is
    accumulative or the group's first row has it.
    """
    keys = list(keys)
    lines = cut_lineage(with_policies(explode_values(members, keys, pos), clusters))
    leaders = members.groupBy(*keys).agg(F.min(pos).alias("_leader"))
    group = [*keys, "attr"]
    seen = lines.groupBy(*group).agg(
        F.first("mode").alias("mode"),
        F.min(F.struct("pos", "attr_idx")).alias("seen"),
        F.min_by(
            F.when(F.col("value") != "", F.col("value")),
            F.when(F.col("value") != "", F.col("pos")),
        ).alias("first_value"),
    )
    folded = fold_accumulative(lines.where(F.col("mode") == "accumulative"), keys)
    cells = (
        seen.join(folded, group, "left")
        .join(leaders, keys)
        .where(
            (F.col("mode") == "accumulative")
            | F.col("first_value").isNotNull()
            | (F.col("seen.pos") == F.col("_leader"))
        )
        .select(
            *group,
            "seen",
            F.when(F.col("mode") == "accumulative", F.coalesce("merged", F.lit("")))
            .otherwise(F.coalesce("first_value", F.lit("")))
            .alias("value"),
        )
    )
    return merged_maps(cells, keys, "attr", "value", F.col("seen"), "values")


def recompute_values(rows: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """Values of each row again from its members alone.

    accumulative: distinct whole member values folded from nothing; priority: the row's
    own value if a member has it, else the first member value, else "".
    rows(cluster_id, row_pos, values), members(cluster_id, row_pos, member_pos, values).
    A boolean column `early` on members limits which of them can keep the row's own value.
    """
    keys = ["cluster_id", "row_pos"]
    group = [*keys, "attr"]
    current = explode_values(rows, keys, "row_pos").select(
        *group, F.col("value").alias("current"), F.struct(F.lit(0).cast("bigint").alias("s"), F.col("attr_idx").cast("bigint").alias("i")).alias("o")
    )
    early = F.col("early") if "early" in members.columns else F.lit(True)
    lines = members.select(
        *keys, F.col("member_pos").alias("pos"), early.alias("early"),
        F.posexplode(clean_map("values")).alias("attr_idx", "attr", "value"),
    )
    lines = cut_lineage(lines)
    attributes = current.unionByName(
        lines.select(
            *group,
            F.lit(None).cast("string").alias("current"),
            F.struct((F.col("pos") + 1).alias("s"), F.col("attr_idx").cast("bigint").alias("i")).alias("o"),
        )
    ).groupBy(*group).agg(F.max("current").alias("current"), F.min("o").alias("o"))
    distinct_values = (
        lines.where(F.col("value") != "").groupBy(*group, "value").agg(
            F.min("pos").alias("pos"), F.bool_or("early").alias("early")
        )
    )
    distinct_values = cut_lineage(distinct_values)
    attributes = cut_lineage(attributes)
    per_attr = (
        distinct_values.join(attributes.select(*group, "current"), group)
        .groupBy(*group)
        .agg(
            F.min_by("value", "pos").alias("first_value"),
            F.max(F.when(F.col("early") & (F.col("value") == F.col("current")), F.col("value"))).alias("kept"),
        )
    )
    with_mode = with_policies(attributes, clusters)
    folded = fold_accumulative(
        with_policies(distinct_values, clusters).where(F.col("mode") == "accumulative"), keys
    )
    cells = (
        with_mode.join(per_attr, group, "left")
        .join(folded, group, "left")
        .select(
            *group,
            "o",
            F.when(F.col("mode") == "accumulative", F.coalesce("merged", F.lit("")))
            .otherwise(F.coalesce("kept", "first_value", F.lit("")))
            .alias("value"),
        )
    )
    return merged_maps(cells, keys, "attr", "value", F.col("o"), "values")
