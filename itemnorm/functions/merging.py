"""Column functions that merge two values of one attribute under a policy."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from itemnorm.functions.text import clean_map, col, empty_map, non_blank, strip_u, text_of

# Characters that split a value, and the text each is joined back with.
SEPARATORS = [(";", "; "), (",", ", "), ("|", " | ")]
SPLIT_PATTERN = "[;,|]"


def split_parts(c: Column | str) -> Column:
    pieces = F.transform(F.split(F.coalesce(col(c), F.lit("")), SPLIT_PATTERN), strip_u)
    return F.array_distinct(F.filter(pieces, lambda p: F.length(p) > 0))


def count_of(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def detect_separator(*values: Column | str) -> Column:
    """The separator seen most often; ties go to the earlier one."""
    texts = [F.coalesce(col(v), F.lit("")) for v in values]
    semi, comma, bar = (sum(count_of(t, ch) for t in texts) for ch, _ in SEPARATORS)
    return (
        F.when((semi >= comma) & (semi >= bar), F.lit("; "))
        .when(comma >= bar, F.lit(", "))
        .otherwise(F.lit(" | "))
    )


def normalize_separator(c: Column | str) -> Column:
    """Blank -> null (detect); a known character -> its padded form; else as typed."""
    raw = non_blank(c)
    out = F.when(raw == ";", F.lit("; "))
    for char, padded in SEPARATORS[1:]:
        out = out.when(raw == char, F.lit(padded))
    return out.otherwise(raw)


def merge_accumulative(current: Column | str, incoming: Column | str, separator: Column | str) -> Column:
    joiner = F.coalesce(normalize_separator(separator), detect_separator(current, incoming))
    return F.array_join(F.array_union(split_parts(current), split_parts(incoming)), "\x00").transform(
        lambda joined: F.replace(joined, F.lit("\x00"), joiner)
    )


def merge_priority(current: Column | str, incoming: Column | str) -> Column:
    return F.coalesce(non_blank(current), non_blank(incoming), F.lit(""))


def _policy_entry(policies: Column | str, attribute: Column | str) -> Column:
    maps = F.coalesce(col(policies), empty_map())
    name = strip_u(attribute)
    return F.coalesce(
        F.nullif(F.try_element_at(maps, name), F.lit("")), F.try_element_at(maps, F.lower(name))
    )


def merge_mode(policies: Column | str, attribute: Column | str) -> Column:
    mode = _policy_entry(policies, attribute)
    return F.when(mode.isin("priority", "accumulative"), mode).otherwise(F.lit("priority"))


def explicit_separator(separators: Column | str, attribute: Column | str) -> Column:
    return normalize_separator(_policy_entry(separators, attribute))


def clean_merge_modes(policies: Column | str) -> Column:
    return F.map_filter(clean_map(policies), lambda _, v: v.isin("priority", "accumulative"))


def clean_merge_separators(separators: Column | str) -> Column:
    known = F.transform_values(clean_map(separators), lambda _, v: normalize_separator(v))
    return F.map_filter(known, lambda _, v: v.isNotNull())


def merge_pair(
    current: Column | str, incoming: Column | str, mode: Column | str, separator: Column | str
) -> Column:
    return F.when(
        col(mode) == "accumulative",
        merge_accumulative(text_of(current), text_of(incoming), separator),
    ).otherwise(merge_priority(current, incoming))
