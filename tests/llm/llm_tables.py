"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeats, clashing columns."""

from __future__ import annotations

import random

POINT_SCHEMA = "item_id bigint, text string, source string, score double, sequence_id bigint, fingerprint string, _n int, size string, rank int"


def awkward_texts(seed: int = 3) -> list[tuple]:
    rng = random.Random(seed)
    words = ["The", "of", "steel", "pipe", "50", "mm", "bolt", "Ünits", "hé", "a-b", "x|y", "ЛЕНТА"]

    def text(n: int) -> str:
        return " ".join(rng.choice(words) + rng.choice(["", "", ".", ","]) for _ in range(n))

    rows = [(k, text(rng.randint(1, 60)), f"src{k % 5}") for k in range(120)]
    same = text(200)
    rows += [(k, same, "src0") for k in range(120, 160)]
    rows += [(k, same + " " + rng.choice(words), "src0") for k in range(160, 170)]
    rows += [(170, None, "src1"), (171, "", None), (172, " \t\n ", "src2"), (173, text(30_000), "src3"), (174, "one", None), (175, "one two", None)]
    rows += [(176, text(20), "src4"), (176, text(20), "src4"), (177, same, "src1"), (177, same, "src1"), (None, "no id " + text(5), "src2"), (None, None, None)]
    rows += [(178, "word\u00a0no-break\u2003em <|endoftext|> \u0130stanbul ﬁne", "src2"), (179, "\x1c\x1d a\x0bb\x0cc\rd", "src3")]
    return rows


def awkward_points(spark, rows=None):
    rows = awkward_texts() if rows is None else rows
    return spark.createDataFrame([(i, t, s, 0.5, 7, "x", 1, "y", 2) for i, t, s in rows], POINT_SCHEMA).repartition(3)


def empty_points(spark):
    return spark.createDataFrame([], POINT_SCHEMA)


def awkward_vectors(seed: int = 5, n: int = 160, dims: int = 8) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(k, [rng.gauss(0, 1) for _ in range(dims)]) for k in range(n)]
    rows += [(n + k, list(rows[3][1])) for k in range(30)]
    rows += [(n + 40, None), (n + 41, []), (n + 42, [0.0] * dims), (n + 43, [float("nan")] * dims), (n + 44, [1.0, None] + [0.0] * (dims - 2)), (n + 45, [float("inf")] + [0.0] * (dims - 1))]
    rows += [(n + 50, [1.0, 2.0, 3.0]), (n + 51, [1.0, 2.5, 3.0]), (None, [0.5] * dims), (4, list(rows[4][1]))]
    return rows


def good(vec) -> bool:
    return bool(vec) and all(x is not None and abs(x) < float("inf") for x in vec)
