"""Column functions on names, ids, units and templates. All JVM-side, no UDFs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from itemnorm.functions.rule_index import apply_rules

# The characters a Unicode strip removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
_WS_SET = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# Runs that are not already one plain space: single spaces are most of a text and stay untouched.
_WS_RUN = f"[{_WS_SET}&&[^ ]][{_WS_SET}]*| [{_WS_SET}]+"

# Namespace of item ids, and the name used where a memory point has no cluster.
ITEM_NAMESPACE = "a3f2c8e1-5b4d-4e9a-9c7f-1d2e3f4a5b6c"
MEMORY_CLUSTER = "Память"

# Canonical unit and the spellings it replaces; order matters.
UNIT_RULES: dict[str, list[str]] = {
    "кг": ["kg", "килограмм", "килограмма", "килограммов", "kilo", "кг."],
    "г": ["g", "gram", "грамм", "грамма", "граммов", "гр", "гр."],
    "л": ["l", "liter", "литр", "литра", "литров", "л."],
    "мл": ["ml", "milliliter", "миллилитр", "миллилитров", "мл."],
    "мм": ["mm", "millimeter", "миллиметр", "миллиметра", "миллиметров", "мм."],
    "см": ["cm", "centimeter", "сантиметр", "сантиметра", "сантиметров", "см."],
}


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """body(value) with value computed once: a lambda re-evaluates what it closes over per element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_u(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITESPACE))


def text_of(c: Column | str) -> Column:
    """Stripped text, "" for null."""
    return F.coalesce(strip_u(c), F.lit(""))


def non_blank(c: Column | str) -> Column:
    """Stripped text, null when nothing is left."""
    return F.nullif(strip_u(c), F.lit(""))


def collapse_spaces(c: Column | str) -> Column:
    return strip_u(F.regexp_replace(col(c), _WS_RUN, " "))


def lookup_key(c: Column | str) -> Column:
    return collapse_spaces(F.lower(col(c)))


def item_id(c: Column | str) -> Column:
    """UUID version 5 of the stripped lower-case text."""
    namespace = F.unhex(F.lit(ITEM_NAMESPACE.replace("-", "")))
    h = F.sha1(F.concat(namespace, F.encode(F.lower(strip_u(c)), "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def safe_file_name(name: Column | str, fallback: Column | str) -> Column:
    cleaned = F.regexp_replace(text_of(name), r'[\\/:*?"<>|]+', "_")
    return F.coalesce(F.nullif(cleaned, F.lit("")), col(fallback))


def sheet_name(name: Column | str, fallback: Column | str) -> Column:
    return F.substring(F.coalesce(non_blank(name), col(fallback)), 1, 31)


def standardize(c: Column | str, rules: dict[str, list[str]] | None = None) -> Column:
    """Unit spellings to their canonical form, rule by rule, then one space before the unit.

    Only rules whose spellings a text can hold are tried on it, so neither its cost nor the plan grows
    with the number of rules.
    """
    return collapse_spaces(apply_rules(col(c), UNIT_RULES if rules is None else rules))


def standardize_map(values: Column | str, rules: dict[str, list[str]] | None = None) -> Column:
    return F.transform_values(col(values), lambda _, v: standardize(v, rules))


def clean_map(values: Column | str) -> Column:
    """Stripped keys and values, blank keys gone, a repeated key keeps its last value."""
    kept = F.map_filter(
        F.coalesce(col(values), empty_map()), lambda k, _: F.length(strip_u(k)) > 0
    )
    return F.transform_values(
        F.transform_keys(kept, lambda k, _: strip_u(k)), lambda _, v: text_of(v)
    )


def empty_map() -> Column:
    return F.create_map().cast("map<string,string>")


def empty_strings() -> Column:
    return F.array().cast("array<string>")


def clean_strings(values: Column | str) -> Column:
    """Stripped elements, blanks gone, order and repeats kept."""
    stripped = F.transform(F.coalesce(col(values), empty_strings()), strip_u)
    return F.filter(stripped, lambda v: F.length(v) > 0)


def value_of(values: Column, key: Column) -> Column:
    """Map lookup with "" for an absent key."""
    return text_of(F.try_element_at(values, key))


def lower_keys(values: Column | str) -> Column:
    """lower(strip(key)) -> strip(value); the last of equal keys wins."""
    return F.transform_values(
        F.transform_keys(
            F.coalesce(col(values), empty_map()), lambda k, _: F.lower(strip_u(k))
        ),
        lambda _, v: text_of(v),
    )


def render_template(template: Column | str, values: Column | str) -> Column:
    """{name} -> value, names compared by lower(strip); unknown names vanish; one pass."""
    tokens = F.regexp_extract_all(
        F.coalesce(col(template), F.lit("")), F.lit(r"(\{[^{}]+\}|[^{}]+|[{}])"), 1
    )

    def filled(lookup: Column) -> Column:
        def fill(token: Column) -> Column:
            key = F.lower(strip_u(F.substring(token, F.lit(2), F.length(token) - 2)))
            is_slot = F.startswith(token, F.lit("{")) & (F.length(token) > 2)
            return F.when(is_slot, F.coalesce(F.try_element_at(lookup, key), F.lit(""))).otherwise(token)

        return F.array_join(F.transform(tokens, fill), "")

    return collapse_spaces(let(lower_keys(values), filled))


def enriched_or_item(template: Column | str, values: Column | str, item: Column | str) -> Column:
    return F.coalesce(F.nullif(render_template(template, values), F.lit("")), col(item))


def row_source(c: Column | str, fallback: Column | str = "ai") -> Column:
    """memory / ai, anything else is the fallback."""
    value = F.lower(text_of(c))
    other = F.lit(fallback) if isinstance(fallback, str) else fallback
    return F.when(value.isin("memory", "ai"), value).otherwise(other)
