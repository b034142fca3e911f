"""Column functions on raw model answers: JSON extraction, cache keys, freshness."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from itemnorm.functions.text import col, strip_u, text_of

PROFILE_SCHEMA = "category string, attributes array<string>, name_template string"
VALUES_SCHEMA = "normalized array<struct<item:string,values:map<string,string>>>"
CACHE_DAYS = 30


def _is_json(c: Column) -> Column:
    """True for exactly one JSON value: as a member between two others it must stay one member."""
    framed = F.concat(F.lit('{"v":'), c, F.lit(',"z":1}'))
    keys = F.json_object_keys(framed)
    return F.coalesce(F.array_join(keys, ",") == "v,z", F.lit(False))


def _wrapped(c: Column) -> Column:
    """Object as it is; a list of strings under attributes; another list under normalized."""
    body = strip_u(c)
    is_list = F.startswith(body, F.lit("["))
    return F.when(
        _is_json(body),
        F.when(F.startswith(body, F.lit("{")), body)
        .when(is_list & body.rlike(r'^\[\s*"'), F.concat(F.lit('{"attributes":'), body, F.lit("}")))
        .when(is_list, F.concat(F.lit('{"normalized":'), body, F.lit("}"))),
    )


def _keyed_list(c: Column, key: str, pattern: str) -> Column:
    found = F.regexp_extract(c, pattern, 1)
    return F.when(
        (found != "") & _is_json(found), F.concat(F.lit(f'{{"{key}":'), found, F.lit("}"))
    )


def extract_json(response: Column | str) -> Column:
    """The first JSON object or list inside a model answer, as an object; null if there is none."""
    whole = strip_u(response)
    fence = r"(?is)```(?:json)?\s*(.*?)\s*```"
    body = F.when(whole.rlike(fence), strip_u(F.regexp_extract(whole, fence, 1))).otherwise(whole)
    first = F.instr(body, "{")
    last = F.length(body) - F.instr(F.reverse(body), "}") + 1
    has_object = (first > 0) & (F.instr(body, "}") > 0) & (last > first)
    bracket = F.instr(body, "[")
    return F.coalesce(
        _wrapped(body),
        F.when(has_object, _wrapped(F.substring(body, first, last - first + 1))),
        # The two keys that are looked for in answers that are no JSON as a whole.
        _keyed_list(body, "attributes", r'(?is)"attributes"\s*:\s*(\[.*?\])'),
        _keyed_list(body, "normalized", r'(?is)"normalized"\s*:\s*(\[.*\])'),
        F.when(bracket > 0, _wrapped(F.substring(body, bracket, F.length(body)))),
    )


def parse_profile(json: Column | str) -> Column:
    """Profile struct with defaults; null when a field has the wrong type."""
    return F.from_json(col(json), PROFILE_SCHEMA, {"mode": "PERMISSIVE"})


def parse_values(json: Column | str) -> Column:
    return F.from_json(col(json), VALUES_SCHEMA, {"mode": "PERMISSIVE"})


def profile_is_valid(json: Column | str) -> Column:
    """Declared fields, where present, have their declared type."""
    j = col(json)
    category = F.get_json_object(j, "$.category")
    typed_category = j.rlike(r'"category"\s*:\s*"') | category.isNull()
    attributes = F.from_json(F.get_json_object(j, "$.attributes"), "array<string>")
    typed_attributes = F.get_json_object(j, "$.attributes").isNull() | attributes.isNotNull()
    return j.isNotNull() & typed_category & typed_attributes


def values_are_valid(json: Column | str) -> Column:
    """Every entry carries an item and a values object."""
    entries = parse_values(json)["normalized"]
    return F.coalesce(
        F.forall(
            F.coalesce(entries, F.array().cast("array<struct<item:string,values:map<string,string>>>")),
            lambda e: e["item"].isNotNull() & e["values"].isNotNull(),
        ),
        F.lit(False),
    ) & col(json).isNotNull()


def cache_key(
    provider: Column | str, prompt: Column | str, items: Column | str, web_search: bool = False
) -> Column:
    return F.md5(
        F.concat_ws("||", col(provider), F.lit(str(web_search)), col(prompt), F.array_join(col(items), "|"))
    )


def is_fresh(cached_at: Column | str, now: Column | str | None = None, days: int = CACHE_DAYS) -> Column:
    moment = F.current_timestamp() if now is None else col(now)
    return col(cached_at) > moment - F.make_dt_interval(F.lit(days))


def joined_aliases(aliases: Column | str) -> Column:
    return F.array_join(F.filter(F.transform(col(aliases), text_of), lambda a: a != ""), "; ")
