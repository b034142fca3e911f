"""Unit rules found by the atoms of a text, so that their number costs a text nothing.

An atom is a run of word characters, cut after its digits: `x5кг` holds `x5` and `кг`. A spelling stands
between non-word characters, so all its atoms are atoms of a text it occurs in; a canonical unit after a
number starts where an atom starts. A rule can therefore only change a text that holds the atoms of
one of its spellings, or that an earlier rule changes first. The rules a text asks for are looked up
by hash in a literal table and applied in the order of the rule file.
"""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections import Counter, defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

ATOM = r"(?U)([^\W\d]*\d+|[^\W\d]+)"
# Ranges of circled and squared letters, which count as word characters.
_LETTER_SYMBOLS = [(0x24B6, 0x24E9), (0x1F130, 0x1F149), (0x1F150, 0x1F169), (0x1F170, 0x1F189)]


def _is_word(char: str) -> bool:
    kind = unicodedata.category(char)
    return (
        kind[0] in "LM" or kind in ("Nd", "Nl", "Pc") or char in "\u200c\u200d"
        or any(low <= ord(char) <= high for low, high in _LETTER_SYMBOLS)
    )


def _is_digit(char: str) -> bool:
    return unicodedata.category(char) == "Nd"


def fold(word: str) -> str:
    """One form for all spellings that a case-insensitive pattern takes for equal."""
    return word.upper().replace("ẞ", "SS").lower().replace("ς", "σ").replace("\u0307", "")


def folded(word: Column) -> Column:
    # The optimiser takes lower(upper(x)) for lower(x); the replacement in between keeps both.
    upper = F.replace(F.upper(word), F.lit("ẞ"), F.lit("SS"))
    return F.translate(F.lower(upper), "ς\u0307", "σ")


def atoms(text: str) -> set[str]:
    out, current = set(), ""
    for char in text + " ":
        if current and (not _is_word(char) or (_is_digit(current[-1]) and not _is_digit(char))):
            out.add(fold(current))
            current = ""
        if _is_word(char):
            current += char
    return out


def rule_steps(canonical: str, synonyms: Sequence[str]) -> dict[str, str]:
    """Patterns and replacements of one rule: spellings first, then one space after a number."""
    spellings = "|".join(re.escape(s) for s in [canonical, *synonyms])
    put = re.sub(r"([\\$])", r"\\\1", canonical)
    return {
        "find": rf"(?iuU)(?<!\w)(?:{spellings})(?!\w)", "put": put,
        "count": rf"(?iuU)(\d+(?:[.,]\d+)?)\s*{re.escape(canonical)}\b", "spaced": "$1 " + put,
    }


def rule_index(rules: Mapping[str, Sequence[str]]) -> tuple[list[tuple[str, list[str], list[int]]], list[int]]:
    """(key atom, all atoms to be held, rules to apply) lines, and the rules every text takes.

    What earlier rules may write need not be in the text, so it is not asked for. Where nothing
    else is left of a spelling, the earlier rules that write its key atom lead to its rule as well.
    """
    named = list(rules.items())
    written = [atoms(canonical) for canonical, _ in named]
    always: set[int] = set()
    asked: list[tuple[set[str], int, bool]] = []
    before: set[str] = set()
    digits_cut = False
    for i, (canonical, synonyms) in enumerate(named):
        # A unit that starts with a digit may cut a number in two, which makes new atoms with digits.
        digits_cut |= bool(canonical) and _is_digit(canonical[0])
        for spelling in dict.fromkeys([canonical, *synonyms]):
            held = atoms(spelling)
            if not held or (digits_cut and any(_is_digit(c) for c in spelling)):
                always.add(i)
            else:
                asked.append((held - before or held, i, held <= before))
        before |= written[i]
    shared = Counter(a for held, _, _ in asked for a in held)
    lines: dict[tuple[str, tuple[str, ...]], set[int]] = defaultdict(set)
    follow: list[set[int]] = [{i} for i in range(len(named))]
    by_key: dict[str, set[int]] = defaultdict(set)
    for held, i, written_before in asked:
        key = min(held, key=lambda a: (shared[a], a))
        lines[key, (key,) if written_before else tuple(sorted(held))].add(i)
        if written_before:
            by_key[key].add(i)
    for i in reversed(range(len(named))):
        for j in {j for a in written[i] for j in by_key.get(a, ()) if j > i}:
            follow[i] |= follow[j]
    always = {j for i in always for j in follow[i]}
    return [(key, list(held), sorted({j for i in found for j in follow[i]})) for (key, held), found in sorted(lines.items())], sorted(always)


def apply_rules(text: Column, rules: Mapping[str, Sequence[str]]) -> Column:
    """The text after all rules, one after the other; only those it can ask for are tried."""
    lines, always = rule_index(rules)
    size = max(1, 2 * len(lines))
    buckets: list[list[dict]] = [[] for _ in range(size)]
    for key, held, found in lines:
        buckets[zlib.crc32(key.encode()) % size].append({"held": held, "rules": found})
    steps = _literal([rule_steps(c, s) for c, s in rules.items()], "array<struct<find:string,put:string,count:string,spaced:string>>")
    table = _literal(buckets, "array<array<struct<held:array<string>,rules:array<int>>>>")
    words = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(ATOM), 1), folded))

    def asked_for(held: Column) -> Column:
        lines = F.flatten(F.transform(held, lambda w: F.get(table, F.pmod(F.crc32(F.encode(w, "UTF-8")), F.lit(size)).cast("int"))))
        found = F.filter(lines, lambda e: F.size(F.array_except(e["held"], held)) == 0)
        return F.sort_array(F.array_distinct(F.concat(_literal(always, "array<int>"), F.flatten(F.transform(found, lambda e: e["rules"])))))

    def one_rule(acc: Column, i: Column) -> Column:
        step = F.get(steps, i)
        replaced = F.regexp_replace(acc, step["find"], step["put"])
        return F.regexp_replace(replaced, step["count"], step["spaced"])

    # A one-element array binds the atoms once: a lambda computes what it closes over for every element.
    chosen = F.element_at(F.transform(F.array(words), asked_for), 1)
    return F.aggregate(chosen, text, one_rule)


def _literal(value: list, schema: str) -> Column:
    """A nested constant as one expression, whatever its size; the optimiser folds it."""
    return F.from_json(F.lit(json.dumps(value, ensure_ascii=False)), schema)
