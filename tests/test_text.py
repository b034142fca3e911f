import random
import uuid

import pytest
from pyspark.sql import functions as F

from itemnorm.functions import merging as m
from itemnorm.functions import text as t
from itemnorm.functions.responses import extract_json
from itemnorm.functions.rule_index import rule_steps
from itemnorm.functions.vectors import cosine_distance, hash_embedding


def one(spark, expr):
    return spark.range(1).select(expr).head()[0]


def values(spark, cases, build, schema="a string"):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, {schema}")
    return [r[1] for r in df.select("i", build).orderBy("i").collect()]


def test_standardize_units(spark):
    cases = {
        "100 mm": "100 мм", "5 Килограмм": "5 кг", "3 kg и 20 cm": "3 кг и 20 см", "программа": "программа",
        "5kg": "5kg", "5кг": "5 кг", "5 гр.": "5 г.", "1,5 литра": "1,5 л", "  2  ml ": "2 мл",
    }
    assert values(spark, [(c,) for c in cases], t.standardize("a")) == list(cases.values())


def rule_chain(text, rules):
    """Every rule on every text, in order."""
    for canonical, synonyms in rules.items():
        step = rule_steps(canonical, synonyms)
        text = F.regexp_replace(F.regexp_replace(text, step["find"], step["put"]), step["count"], step["spaced"])
    return t.collapse_spaces(text)


PIECES = [
    "kg", "KG", "кг", "г", "гр", "гр.", "5", "12", "1,5", "x5", "x", "л", "Литр", "ml", "мл.", "-", ".", "м", "M3", "м³", "_", "кило", "kilo",
    "куб м", "м2", "%", "ß", "SS", "ẞ", "İ", "i", "\u212a", "ς", "ОДОΣ", "σ", "5x", "25", "\u0301", "ſ", "s", " ", "  ",
]


@pytest.mark.parametrize(
    "rules",
    [
        t.UNIT_RULES,
        # Rules that feed later ones, spellings of several words, units that start with a digit.
        {"kg": ["kilo", "x"], "кг": ["kg", "кило"], "м³": ["куб м", "m3", "м 3"], "5x": ["x 5"], "x5": ["5 x", "2 5"], "%": ["x"], "ss": ["ß", "s"]},
        {"": ["кило"], "г.": ["гр"], "i": ["İ", "K"], "σ": ["ОДОΣ"], "a b": ["kg x", "л"], "b": ["a", "x b"]},
        {"x": ["12"], "м": ["м2", "M3"], "л": ["ml", ""]},
        {"$1": ["kg"], "\\": ["г"]},
        {},
    ],
)
def test_indexed_rules_equal_the_rule_chain(spark, rules):
    draw = random.Random(5)
    texts = ["".join(draw.choice(PIECES) + draw.choice(["", " "]) for _ in range(draw.randint(0, 9))) for _ in range(1500)]
    df = spark.createDataFrame([(x,) for x in [*texts, None, "", "кг " * 5000]], "a string")
    wrong = df.select("a", t.standardize("a", rules).alias("got"), rule_chain(F.col("a"), rules).alias("want")).where(~F.col("got").eqNullSafe(F.col("want")))
    assert wrong.collect() == []


def test_the_plan_does_not_grow_with_the_rules(spark):
    calls = set()
    for n in (3, 500):
        rules = {f"W{i}": [f"red {i}", f"blue bolt {i}"] for i in range(n)}
        plan = spark.range(3).select(t.standardize(F.col("id").cast("string"), rules))._jdf.queryExecution().analyzed().toString()
        calls.add(plan.count("regexp_replace("))
    assert len(calls) == 1
    assert "from_json" not in spark.range(3).select(t.standardize(F.col("id").cast("string")).alias("v"))._jdf.queryExecution().optimizedPlan().toString()


def test_item_id_is_uuid5_and_ignores_case_and_outer_space(spark):
    got = values(spark, [("Фильтр А",), ("  фильтр а ",)], t.item_id("a"))
    want = str(uuid.uuid5(uuid.UUID(t.ITEM_NAMESPACE), "фильтр а"))
    assert got == [want, want]


@pytest.mark.parametrize(
    "template, mapping, want",
    [
        ("{бренд} фильтр {артикул}", {"бренд": "Mann", "артикул": "W 712"}, "Mann фильтр W 712"),
        ("{Brand} {x}", {" brand ": " A "}, "A"),
        ("{{a}}", {"a": "1"}, "{1}"),
        ("{a}", {"a": "$1 \\ "}, "$1 \\"),
        ("  ", {"a": "1"}, ""),
        ("{a} } {", {"a": "{a}"}, "{a} } {"),
    ],
)
def test_render_template(spark, template, mapping, want):
    df = spark.createDataFrame([(template, mapping)], "t string, v map<string,string>")
    assert df.select(t.render_template("t", "v")).head()[0] == want


def test_lookup_key_and_strip_cover_unicode_space(spark):
    assert values(spark, [("　 Ab\t C\n",)], t.lookup_key("a")) == ["ab c"]
    assert values(spark, [("\x1c x y ",)], t.strip_u("a")) == ["x y"]


def test_separators(spark):
    assert values(spark, [(";",), (" , ",), ("|",), (" / ",), (" ",), (None,)], m.normalize_separator("a")) == ["; ", ", ", " | ", "/", None, None]
    assert values(spark, [("a; b,a | ;",)], F.array_join(m.split_parts("a"), "+")) == ["a+b"]
    pairs = [("1", "2", None), ("a, b", "c", None), ("a|b", "", None), ("a", "b", "/"), ("a/b", "a", "/"), ("a,b", "c;d;e", None), ("", "", None)]
    want = ["1; 2", "a, b, c", "a | b", "a/b", "a/b/a", "a; b; c; d; e", ""]
    assert values(spark, pairs, m.merge_accumulative("a", "b", "s"), "a string, b string, s string") == want


def test_merge_mode_falls_back_to_lower_key_and_priority(spark):
    df = spark.createDataFrame([({"size": "accumulative", "x": "sum"},)], "p map<string,string>")
    assert [df.select(m.merge_mode("p", F.lit(k))).head()[0] for k in ("size", " SIZE", "x", "y")] == ["accumulative", "accumulative", "priority", "priority"]


@pytest.mark.parametrize(
    "answer, want",
    [
        ('```json\n{"a": 1}\n```', '{"a": 1}'),
        ('[{"item": "x"}]', '{"normalized":[{"item": "x"}]}'),
        ('["a", "b"]', '{"attributes":["a", "b"]}'),
        ('note {"a":1} tail', '{"a":1}'),
        ('x "attributes": ["q"] , y', '{"attributes":["q"]}'),
        ('x: [1, 2]', '{"normalized":[1, 2]}'),
        ("", None), ("12", None), ("no json", None), ('{"a":1} {"b":2}', None), ('{"a":', None),
    ],
)
def test_extract_json(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "a string")
    assert df.select(extract_json("a")).head()[0] == want


def test_cosine_distance_edges(spark):
    cases = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 1.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0]), ([], [])]
    got = values(spark, cases, F.round(cosine_distance("a", "b"), 9), "a array<double>, b array<double>")
    assert got == [0.0, 1.0, 1.0, 1.0, 1.0]


def test_hash_embedding_is_unit_and_ignores_case(spark):
    a, b = values(spark, [("Болт М8",), ("  болт   м8",)], hash_embedding("a"))
    assert a == b and abs(sum(x * x for x in a) - 1) < 1e-9


def test_a_value_that_repeats_is_standardised_once(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from itemnorm.queries import QUERIES, scalars

    part = spark.range(300).select(
        F.col("id").alias("p_partkey"), F.concat(F.lit("rod "), (F.col("id") % 5).cast("string")).alias("p_name"), (F.col("id") % 5).cast("int").alias("p_size")
    )
    part.write.parquet(f"{tmp_path}/part.parquet")
    worked, first = [], scalars.one_of_each

    def counted(*how):
        out = first(*how)
        worked.append(out.count())
        return out

    monkeypatch.setattr(scalars, "one_of_each", counted)
    got = {r["p_partkey"]: r["value"] for r in QUERIES["scl3_many_rules"](spark, str(tmp_path)).collect()}
    assert got == {n: f"7 K{n % 5}; xrod {n % 5} {n % 5}x" for n in range(300)}
    assert worked == [5]
