"""Folds and prefix sums against sequential loops."""

import random
import re

import pytest

from itemnorm.operators import merge_values
from itemnorm.operators.collapse import collapse_rows
from itemnorm.operators.merge_values import fold_accumulative, fold_groups
from itemnorm.operators.ordering import batch_number, dense_position, running_sum

PADDED = {";": "; ", ",": ", ", "|": " | "}


def parts(s):
    out = []
    for p in re.split("[;,|]", s):
        if p.strip() and p.strip() not in out:
            out.append(p.strip())
    return out


def fold(values, sep):
    current = ""
    for v in values:
        counts = [(current + v).count(ch) for ch in ";,|"]
        joiner = sep or PADDED[";,|"[counts.index(max(counts))]]
        both = parts(current)
        both += [p for p in parts(v) if p not in both]
        current = joiner.join(both)
    return current


def test_fold_equals_sequential_merge(spark, monkeypatch):
    monkeypatch.setattr(merge_values, "SPAN", 2)
    rng = random.Random(3)
    words = ["a", "b", "c", "d", "e"]
    groups = {}
    for g in range(60):
        sep = rng.choice([None, None, None, "; ", "/", " | "])
        values = [rng.choice(["", " ", ";", ",", "|"]).join(rng.choices(words, k=rng.randint(0, 3))) + rng.choice(["", "", ",,", ";;;"]) for _ in range(rng.randint(1, 9))]
        groups[g] = (sep, [v.strip() for v in values])
    lines = [(g, p * 5, "x", v, sep) for g, (sep, vs) in groups.items() for p, v in enumerate(vs)]
    df = spark.createDataFrame(lines, "g int, pos long, attr string, value string, sep string")
    got = {r["g"]: r["merged"] for r in fold_accumulative(df, ["g"]).collect()}
    for g, (sep, vs) in groups.items():
        assert got.get(g, "") == fold(vs, sep), (sep, vs)


def test_fold_groups_policies(spark):
    members = spark.createDataFrame(
        [
            (1, 0, 0, {"size": "1", "color": "", "q": "x"}), (1, 0, 1, {"size": "2", "color": "red"}),
            (1, 0, 2, {"size": "1", "new": " "}), (1, 5, 5, {"size": "a,b"}),
        ],
        "cluster_id long, row_pos long, p long, values map<string,string>",
    )
    clusters = spark.createDataFrame(
        [(1, {"size": "accumulative"}, {})], "cluster_id long, attribute_merge map<string,string>, attribute_merge_separators map<string,string>"
    )
    got = {r["row_pos"]: r["values"] for r in fold_groups(members, clusters, ["cluster_id", "row_pos"], "p").collect()}
    assert got == {0: {"size": "1; 2", "color": "red", "q": "x"}, 5: {"size": "a, b"}}


def test_collapse_near_names(spark):
    entries = spark.createDataFrame(
        [
            (1, 0, "i0", "N", {"s": "1"}, "ai", [1.0, 0.0]), (1, 1, "i1", "N", {"s": "2"}, "memory", [0.99, 0.01]),
            (1, 2, "i2", "M", {"s": "3"}, "ai", [0.0, 1.0]), (1, 3, "i0", "", {"s": "2"}, "ai", [1.0, 0.0]),
        ],
        "cluster_id long, pos long, item string, enriched_name string, values map<string,string>, source string, vec array<double>",
    )
    clusters = spark.createDataFrame(
        [(1, {"s": "accumulative"}, {})], "cluster_id long, attribute_merge map<string,string>, attribute_merge_separators map<string,string>"
    )
    out = collapse_rows(entries, clusters)
    rows = {r["row_pos"]: (r["enriched_name"], r["item"], r["values"], r["source"]) for r in out.rows.collect()}
    assert rows == {0: ("N", "i0", {"s": "1; 2"}, "ai"), 2: ("M", "i2", {"s": "3"}, "ai")}
    assert sorted((r["row_pos"], r["alias"]) for r in out.aliases.collect()) == [(0, "i0"), (0, "i1"), (2, "i2")]
    assert out.members.where("row_pos = 0").count() == 3


def test_running_sum_across_chunks(spark):
    rng = random.Random(1)
    rows = [(k, p, rng.randint(0, 5)) for k in ("hot", "cold") for p in rng.sample(range(-500, 500), 90 if k == "hot" else 3)]
    df = spark.createDataFrame(rows, "k string, p long, v long")
    got = {(r["k"], r["p"]): r["s"] for r in running_sum(df, ["k"], "p", "v", "s", span_bits=4).collect()}
    for k in ("hot", "cold"):
        total = 0
        for _, p, v in sorted(r for r in rows if r[0] == k):
            total += v
            assert got[(k, p)] == total
    places = sorted(r["n"] for r in dense_position(df.where("k = 'hot'"), ["k"], "p", "n").collect())
    assert places == list(range(90))
    sizes = batch_number(df, ["k"], "p", 8).groupBy("k", "batch").count().collect()
    assert max(r["count"] for r in sizes) == 8


def test_typed_separators_equal_the_fold_value_by_value(spark):
    import random
    import re

    from itemnorm.operators.merge_values import fold_accumulative

    def parts_of(text):
        return list(dict.fromkeys(p.strip() for p in re.split("[;,|]", text) if p.strip()))

    rng, lines, want = random.Random(5), [], {}
    for g in range(60):
        sep = rng.choice(["/", " - ", "+", "/;"])
        values = [rng.choice(["a", "b", "a; b", "b, a", "a;a", " a ", "", "c", f"a{sep}b", "|"][: 8 if g % 2 else 10]) for _ in range(rng.randint(1, 9))]
        text = ""
        for k, v in enumerate(values):
            lines.append((g, "x", k, v, sep))
            if v:
                text = sep.join(dict.fromkeys(parts_of(text) + parts_of(v)))
        want[g] = text
    df = spark.createDataFrame(lines, "g bigint, attr string, pos bigint, value string, sep string")
    got = {r["g"]: r["merged"] for r in fold_accumulative(df, ["g"]).collect()}
    assert got == {g: t for g, t in want.items() if g in got} and all(not t for g, t in want.items() if g not in got)


@pytest.mark.parametrize("block", [1, 3, 1024])
def test_growing_fold_in_rounds_equals_the_fold_value_by_value(spark, block):
    rng = random.Random(block)
    lines, want = [], {}
    for g in range(60):
        sep = rng.choice(["/", "--"])
        plain = ["a", "b", "aa"]
        # Texts a fold can have reached, so that repeats of the whole text so far occur.
        reached = [sep.join(rng.choices(plain, k=n)) for n in (2, 2, 3, 4)]
        values = [[p for p in dict.fromkeys(rng.choices(plain[:2] + reached, k=rng.randint(1, 2)))] for _ in range(rng.randint(1, 40))]
        if g % 3 == 0:
            values = [["a"], ["a"], ["b"], *[["a" + sep + "b"]] * 9, ["b"], *[[sep.join("abb")]] * 5]
        if g == 1:
            values = [["a" + sep + "b"]] * 12
        text = ""
        for ps in values:
            new = [p for p in ps if p != text]
            text = sep.join([*([text] if text else []), *new]) if new else text
        want[g] = text
        lines += [(g, 7 * i + 3, sep, ps) for i, ps in enumerate(values)]
    df = spark.createDataFrame(lines, "g int, pos bigint, sep string, ps array<string>").repartition(5)
    got = {r["g"]: r["merged"] for r in merge_values._growing_fold(df, ["g"], block).collect()}
    assert got == want
