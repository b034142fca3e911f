"""Top-k and nearest-neighbour search against brute force."""

import math
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from llm_tables import awkward_vectors, good  # noqa: E402

from itemnorm.llm.lsh import HASHES, SUCCESS, TABLES, StableHash, nearest_points, sample_radii  # noqa: E402
from itemnorm.llm.topk import quantised, top_k_points, usable  # noqa: E402


def tables(spark, rows, every):
    frame = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "item_id bigint, vec_local array<double>, rank int, class_id string").repartition(3)
    return frame.where(F.col("item_id") % every == 0).withColumnRenamed("item_id", "item_idx"), frame


def ranked(df):
    return sorted((r["item_idx"], r["rank"], r["item_id"], r["score"]) for r in df.collect())


def brute(rows, every, k, score, best_first, keep=good):
    usable_rows = {(i, tuple(v)) for i, v in rows if i is not None and keep(v)}
    out = []
    for q, a in sorted(usable_rows):
        if q % every:
            continue
        found = sorted((best_first * score(a, b), i) for i, b in usable_rows if i != q and len(a) == len(b))
        out += [(q, n + 1, i, best_first * s) for n, (s, i) in enumerate(found[:k])]
    return sorted(out)


@pytest.mark.parametrize("lists,item_block,point_block", [(2, 256, 4096), (3, 4, 16), (8, 5, 7)])
def test_top_k_equals_brute_force(spark, lists, item_block, point_block):
    rows = awkward_vectors()
    items, points = tables(spark, rows, 10)
    whole = F.when(usable(F.col("vec_local")), quantised(F.col("vec_local")))
    got = top_k_points(items.withColumn("vec_local", whole), points.withColumn("vec_local", whole), 5, lists=lists, skip_self=True, item_block=item_block, point_block=point_block)

    def product(a, b):
        return sum(math.floor(256 * x) * math.floor(256 * y) for x, y in zip(a, b))

    assert ranked(got) == brute(rows, 10, 5, product, -1)


def test_top_k_with_zero_items_and_large_components(spark):
    rows = [(k, [0, 0]) for k in range(12)] + [(k, [2**40 + k, -(2**20)]) for k in range(12, 20)]
    frame = spark.createDataFrame(rows, "item_id bigint, vec_local array<bigint>")
    got = ranked(top_k_points(frame.withColumnRenamed("item_id", "item_idx"), frame, 3, skip_self=True, point_block=4))
    top = [(0, 1, 1, 0), (0, 2, 2, 0), (0, 3, 3, 0)]
    assert got[:3] == top and len(got) == 60
    assert got[-1][1] == 3


def test_search_of_empty_tables(spark):
    frame = spark.createDataFrame([], "item_id bigint, vec_local array<bigint>")
    real = spark.createDataFrame([], "item_id bigint, vec_local array<double>")
    assert top_k_points(frame.withColumnRenamed("item_id", "item_idx"), frame, 3).count() == 0
    assert nearest_points(real.withColumnRenamed("item_id", "item_idx"), real, 3).count() == 0


def distance(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += (x - y) * (x - y)
    return math.sqrt(total)


def nonzero(v):
    return good(v) and any(v)


@pytest.mark.parametrize("blocks", [{}, {"item_block": 3, "point_block": 16}])
def test_nearest_points_recall_and_scores(spark, blocks):
    rows = awkward_vectors()
    items, points = tables(spark, rows, 10)
    got = ranked(nearest_points(items, points, 10, skip_self=True, **blocks))
    want = brute(rows, 10, 10, distance, 1, nonzero)
    assert len({(q, i) for q, _, i, _ in got} & {(q, i) for q, _, i, _ in want}) >= 0.9 * len(want)
    assert len(got) == len(want)
    vectors = {i: v for i, v in rows if i is not None and nonzero(v)}
    assert all(s == distance(vectors[q], vectors[i]) for q, _, i, s in got)
    assert [r[:2] for r in got] == [r[:2] for r in want]


def test_recall_outside_of_dense_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((4, 64))
    dense = np.repeat(centres, 600, axis=0) + rng.standard_normal((2400, 64)) * 0.3
    # Thin clusters, wider than the radius of the dense ones, whose items have their neighbours beyond it.
    thin = np.repeat(rng.standard_normal((20, 64)), 80, axis=0) + rng.standard_normal((1600, 64)) * 0.6
    x = np.concatenate([dense, thin])
    x = (x / np.linalg.norm(x, axis=1)[:, None])[rng.permutation(len(x))]
    items, points = tables(spark, list(enumerate(x.tolist())), 40)
    got = {(r["item_idx"], r["item_id"]) for r in nearest_points(items, points, 10, skip_self=True).collect()}
    far = np.linalg.norm(x[::40, None] - x[None], axis=2)
    want = {(40 * n, int(i)) for n, row in enumerate(far) for i in np.argsort(row)[1:11]}
    own = [len({i for q, i in got & want if q == 40 * n}) for n in range(len(far))]
    assert np.mean(own) >= 9.5 and len(got) == len(want)


def test_few_points_of_clustered_vectors_are_measured(spark):
    """The radius is that of neighbours in the whole table, so on clusters few cells are visited and recall stays."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((120, 32)), 100, axis=0) + rng.standard_normal((12_000, 32)) * 0.2
    x = (x / np.linalg.norm(x, axis=1)[:, None])[rng.permutation(len(x))]
    items, points = tables(spark, list(enumerate(x.tolist())), 100)
    classes = points.select(F.col("item_id").alias("class_id"), F.col("vec_local").alias("vec")).cache()
    radius = sample_radii(classes, 10)[32]
    far = np.linalg.norm(x[::100, None] - x[None], axis=2)
    true = np.median(np.sort(far, axis=1)[:, 10])
    assert 0.8 * true < radius < 1.25 * true
    own = StableHash(32, radius, TABLES, HASHES, 7)
    chance = 1 - (1 - SUCCESS) ** (1 / TABLES)
    measured = []
    for t in range(TABLES):
        places = [tuple(c) for c in own.cells(x, t).tolist()]
        for cells in own.probes(x[::100], t, chance):
            held = {tuple(c) for c in cells.tolist()}
            measured.append(np.mean([p in held for p in places]))
    print(f"points measured per item and table: {np.mean(measured):.3f}")
    assert np.mean(measured) < 0.1
    got = {(r["item_idx"], r["item_id"]) for r in nearest_points(items, points, 10, skip_self=True).collect()}
    want = {(100 * n, int(i)) for n, row in enumerate(far) for i in np.argsort(row)[1:11]}
    recall = len(got & want) / len(want)
    print(f"recall {recall:.3f}")
    assert recall >= 0.95 and len(got) == len(want)


def test_few_visited_cells_fall_back_to_all_points(spark):
    rows = awkward_vectors(n=40)
    items, points = tables(spark, rows, 10)
    got = ranked(nearest_points(items, points, 30, skip_self=True, tables=1, success=0.01))
    want = brute(rows, 10, 30, distance, 1, nonzero)
    assert [r[:2] for r in got] == [r[:2] for r in want]


def test_probes_come_in_order_of_success():
    own = StableHash(64, 1.0, 1, 4, 7)  # of many components, so that the four projections are nearly independent
    x = np.random.default_rng(1).standard_normal((1, 64))
    cells = next(own.probes(x, 0, 0.9))
    assert (cells[0] == own.cells(x, 0)[0]).sum() >= 3  # the likeliest differs little from the own cell
    near = x + np.random.default_rng(2).standard_normal((4000, 64)) / 8
    visited = {tuple(c) for c in cells.tolist()}
    assert np.mean([tuple(c) in visited for c in own.cells(near, 0).tolist()]) > 0.85
