"""Neighbour join, clustering and grouping against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemnorm.functions.vectors import hash_embedding, unit
from itemnorm.operators import cells as ce, neighbours as nb
from itemnorm.operators.leaders import leader_groups
from itemnorm.operators.linkage import cluster_items
from itemnorm.operators.neighbours import best_neighbours


def sample(n, d=3, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 4, d))
    v = centres[rng.integers(0, len(centres), n)] + 0.3 * rng.normal(size=(n, d))
    v[3], v[5] = 0, v[4]
    return v


def units(v):
    length = np.linalg.norm(v, axis=1)
    return v / np.where(length == 0, 1, length)[:, None]


def linkage(v, threshold):
    u = units(v)
    dist = 1 - u @ u.T
    clusters = {i: [i] for i in range(len(v))}
    while True:
        best = None
        ids = sorted(clusters)
        for i, a in enumerate(ids):
            for b in ids[i + 1 :]:
                d = dist[np.ix_(clusters[a], clusters[b])].mean()
                if d < threshold and (best is None or d < best[0]):
                    best = (d, a, b)
        if best is None:
            return {i: k for k, m in clusters.items() for i in m}
        clusters[best[1]] += clusters.pop(best[2])


def greedy(v, limit):
    u, zero = units(v), np.linalg.norm(v, axis=1) == 0
    leaders, out = [], {}
    for i in range(len(v)):
        near = [l for l in leaders if not zero[i] and not zero[l] and 1 - u[i] @ u[l] <= limit]
        out[i] = near[0] if near else i
        if not near:
            leaders.append(i)
    return out


def frame(spark, v, names):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(v)], names)


@pytest.mark.parametrize("block", [4096, 8])
def test_average_linkage_equals_brute_force(spark, block):
    v = sample(40)
    got = cluster_items(frame(spark, v, "item_idx long, vec array<double>"), threshold=0.2, block=block).collect()
    assert {r[0]: r[1] for r in got} == linkage(v, 0.2)


def test_rounds_look_up_less_and_less(spark):
    v = sample(150, d=6, seed=7)
    rounds = []
    got = cluster_items(frame(spark, v, "item_idx long, vec array<double>"), threshold=0.3, block=40, on_round=lambda *r: rounds.append(r)).collect()
    print("open and looked up per round:", rounds)
    assert {r[0]: r[1] for r in got} == linkage(v, 0.3)
    assert len(rounds) >= 3 and rounds[0][0] == rounds[0][1]
    assert all(asked < open_ for open_, asked in rounds[2:])
    assert sum(asked for _, asked in rounds) < 0.9 * sum(open_ for open_, _ in rounds)


@pytest.mark.parametrize("block", [4096, 8])
def test_leader_groups_equal_the_sequential_loop(spark, block):
    v = sample(40, seed=1)
    entries = frame(spark, v, "pos long, vec array<double>").withColumn("cluster_id", F.lit(7).cast("bigint"))
    got = leader_groups(entries, limit=0.15, block=block).collect()
    assert {r["pos"]: r["leader_pos"] for r in got} == greedy(v, 0.15)


def test_a_chain_takes_rounds_by_the_block(spark):
    turn = np.arange(60) * 0.5
    v = np.zeros((60, 22))
    v[np.arange(60), (turn // (np.pi / 2)).astype(int)] = np.cos(turn % (np.pi / 2))
    v[np.arange(60), (turn // (np.pi / 2)).astype(int) + 1] = np.sin(turn % (np.pi / 2))
    rounds = []
    entries = frame(spark, v, "pos long, vec array<double>").withColumn("cluster_id", F.lit(7).cast("bigint"))
    got = leader_groups(entries, limit=0.15, block=20, on_round=rounds.append).collect()
    assert {r["pos"]: r["leader_pos"] for r in got} == greedy(v, 0.15) == {n: n - n % 2 for n in range(60)}
    print("undecided per round:", rounds)
    assert len(rounds) <= 5


@pytest.mark.parametrize("k, least", [(1, 0.9), (3, 0.5), (2, -0.5)])
def test_best_neighbours_lose_nothing_to_routing(spark, k, least):
    v = units(sample(120, seed=2))
    keep = [i for i in range(len(v)) if np.linalg.norm(v[i]) > 0]
    df = frame(spark, v, "id long, vec array<double>").select("id", unit("vec").alias("u")).where("u is not null")
    left = df.select(F.col("id").alias("l_id"), F.col("u").alias("l_vec"))
    right = df.select(F.col("id").alias("r_id"), F.col("u").alias("r_vec"))
    got = best_neighbours(left, right, least, skip_self=True, k=k, block=10).collect()
    want = set()
    for i in keep:
        near = sorted((-round(float(v[i] @ v[j]), 9), j) for j in keep if j != i and round(float(v[i] @ v[j]), 9) >= least)
        want |= {(i, j) for _, j in near[:k]}
    assert {(r["l_id"], r["r_id"]) for r in got} == want


def dense(spark, n, d=16):
    v = units(np.random.default_rng(9).normal(size=(n, d)))
    df = frame(spark, v, "id long, vec array<double>")
    return v, df.select(F.col("id").alias("l_id"), F.col("vec").alias("l_vec")), df.select(F.col("id").alias("r_id"), F.col("vec").alias("r_vec"))


def test_no_pair_counts_twice_where_nearly_all_groups_are_visited(spark):
    v, left, right = dense(spark, 600)
    got = best_neighbours(left, right, -0.2, k=3, block=10).collect()
    scores = np.round(v @ v.T, 9)
    want = {(i, int(j), rank) for i in range(600) for rank, j in enumerate(np.argsort(-scores[i], kind="stable")[:3], 1)}
    assert {(r["l_id"], r["r_id"], r["rank"]) for r in got} == want and len(got) == len(want)


def test_rows_are_copied_per_tile_and_not_per_group(spark, monkeypatch):
    v, left, right = dense(spark, 400)
    sent = []

    def written(df, cut=nb.cut_lineage):
        out = cut(df)
        if "l_vec" in df.columns and {"cell", "tile"} & set(df.columns):
            sent.append(out.count())
        return out

    monkeypatch.setattr(nb, "cut_lineage", written)
    got = best_neighbours(left, right, 0.1, skip_self=True, block=4).collect()
    print("lines sent to groups or tiles:", sent)
    scores = np.round(v @ v.T, 9) - 9 * np.eye(400)
    assert {(r["l_id"], r["r_id"]) for r in got} == {(i, int(scores[i].argmax())) for i in range(400) if scores[i].max() >= 0.1}
    assert sent and max(sent) <= 4 * 400


def test_clustering_needs_no_data(spark):
    assert cluster_items(spark.createDataFrame([], "item_idx long, vec array<double>")).count() == 0
    one = spark.createDataFrame([(5, [1.0, 0.0])], "item_idx long, vec array<double>")
    assert [tuple(r) for r in cluster_items(one).collect()] == [(5, 5)]


def names(spark):
    """Spellings of parts on the left, brand and name on the right: vectors of hashed trigrams."""
    parts = [f"{a} {b}" for a in ("large", "small", "hot", "blue", "new", "round", "dark", "green") for b in ("gear", "plate", "rod", "bolt", "ring", "valve", "pump", "belt")]
    left = [(n, f"{p} {t} {7 * n % 50} mm") for n, (p, t) in enumerate((p, t) for p in parts for t in ("promo", "standard", "economy", "medium"))]
    right = [(n, f"Brand#{b} {p}") for n, (p, b) in enumerate((p, b) for p in parts for b in range(11, 36))]
    embedded = lambda rows, side: spark.createDataFrame(rows, f"{side}_id long, text string").select(f"{side}_id", hash_embedding("text").alias(f"{side}_vec"))
    return embedded(left, "l").cache(), embedded(right, "r").cache()


def test_few_groups_are_visited_for_sparse_vectors(spark):
    left, right = names(spark)
    cells = ce.grow_cells(right, right.count(), 64)
    placed = ce.place_rows(right, cells).cache()
    assert placed.count() == right.count()
    measured = ce.measure(placed, cells)
    visited = ce.visits(left.withColumn("least", F.lit(0.7)), measured).cache()
    groups = len(measured.first_of_group)
    assert groups >= 20
    per_row = visited.count() / left.count()
    print(f"groups visited per row: {per_row:.2f} of {groups}")
    assert per_row < groups / 5
    # Nothing that reaches the bound lies in a group that is not visited.
    l, r = {x[0]: np.array(x[1]) for x in left.collect()}, {x["r_id"]: (np.array(x["r_vec"]), x["cell"]) for x in placed.collect()}
    seen = {(x["l_id"], x["cell"]) for x in visited.collect()}
    assert all((i, cell) in seen for i, v in l.items() for w, cell in r.values() if v @ w >= 0.7)


def test_boxes_bound_signed_vectors_and_short_ones(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 5))
    v = units(v) * rng.uniform(0.2, 1, size=(300, 1))
    v[7] = v[8] = v[9]
    cells = ce.Cells(*ce._grow(v, 4, 40))
    leaf, angle = cells.nearest(v)
    high = np.array([v[leaf == n].max(axis=0) if (leaf == n).any() else np.zeros(5) for n in range(len(cells.group))])
    low = np.array([v[leaf == n].min(axis=0) if (leaf == n).any() else np.zeros(5) for n in range(len(cells.group))])
    radius = np.array([angle[leaf == n].max() + ce.SLACK if (leaf == n).any() else -1.0 for n in range(len(cells.group))])
    whole = ce.Cells(cells.centres, cells.group, high, low, radius)
    for least in (0.6, 0.1, -0.3):
        open_, best = whole.open_groups(v, np.full(len(v), least))
        numbers = whole.group[whole.first_of_group]
        for i, j in zip(*np.nonzero(v @ v.T >= least)):
            assert open_[i, np.flatnonzero(numbers == whole.group[leaf[j]])[0]]


def test_trigram_vectors_are_unit_counts_of_hashed_trigrams(spark):
    import hashlib

    texts = ["Болт М8 🙂", "", None, "a" * 50_000, "  two   words "]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, text string").select("n", hash_embedding("text").alias("v")).collect()
    got = {r["n"]: r["v"] for r in rows}
    assert got[2] is None
    for n, t in enumerate(texts):
        if t is not None:
            padded = "  " + " ".join(t.lower().split()) + " "
            counts = np.zeros(64)
            for k in range(len(padded) - 2):
                counts[int(hashlib.md5(padded[k : k + 3].encode()).hexdigest()[:6], 16) % 64] += 1
            assert got[n] == pytest.approx(list(counts / np.linalg.norm(counts)), abs=1e-12)


def test_a_chain_of_corners_is_narrow_and_near_its_neighbours_alone(spark):
    from itemnorm.queries.vectors import chain_vector

    # Rows around every turn of the second, third and fourth digit among them.
    some = sorted({n for start in (0, 520, 6880, 89_700, 100_000, 250_000) for n in range(start, start + 120)})
    held = spark.createDataFrame([(n,) for n in some], "pos long").select("pos", chain_vector("pos", 1_000_000).alias("v")).collect()
    pos, v = np.array([r["pos"] for r in held]), np.array([r["v"] for r in held])
    assert v.shape[1] == 156 and np.allclose(np.linalg.norm(v, axis=1), 1)
    near = v @ v.T >= 0.85
    assert (near == (np.abs(pos[:, None] - pos[None, :]) <= 1)).all()


def test_later_rounds_ask_only_for_rows_that_lost_what_they_waited_for(spark, monkeypatch):
    from itemnorm.operators import leaders
    from itemnorm.queries.vectors import chain_vector

    monkeypatch.setattr(leaders, "PREFIX_ROWS", 40, raising=False)
    asked, find = [], leaders.best_neighbours

    def counted(left, right, *args, **how):
        asked.append(left.count())
        return find(left, right, *args, **how)

    monkeypatch.setattr(leaders, "best_neighbours", counted)
    entries = spark.range(160).select(F.lit(7).cast("bigint").alias("cluster_id"), F.col("id").alias("pos"), chain_vector("id", 160).alias("vec"))
    got = leader_groups(entries, limit=0.15, block=40).collect()
    assert {r["pos"]: r["leader_pos"] for r in got} == {n: n - n % 2 for n in range(160)}
    print("rows looked up:", asked)
    assert sum(asked) < 2.5 * 160


def test_blocks_are_written_once_and_nothing_but_the_result_stays(spark, monkeypatch):
    from itemnorm.session import shared_dir
    from itemnorm.sources.commits import names

    monkeypatch.setattr(nb, "LEAST_ROWS", 50)
    v, left, right = dense(spark, 400)
    folder = f"{shared_dir(spark)}/itemnorm"
    before, sent = set(names(spark, folder)), []

    def written(df, cut=nb.cut_lineage):
        out = cut(df)
        if "l_vec" in df.columns and "tile" in df.columns:
            sent.append(out.count())
        return out

    monkeypatch.setattr(nb, "cut_lineage", written)
    got = best_neighbours(left, right, 0.1, skip_self=True, block=20)
    scores = np.round(v @ v.T, 9) - 9 * np.eye(400)
    assert {(r["l_id"], r["r_id"]) for r in got.collect()} == {(i, int(scores[i].argmax())) for i in range(400) if scores[i].max() >= 0.1}
    print("lines with left vectors:", sent)
    assert max(sent) <= 400
    assert {n.split("-")[0] for n in set(names(spark, folder)) - before} == {"neighbours"}


@pytest.mark.parametrize("near, most", [(True, 400), (False, 800)])
def test_rows_of_large_clusters_meet_leaders_alone(spark, monkeypatch, near, most):
    """Near copies go in one look-up, rows that find no leader are looked up once, and no row meets another that does not lead."""
    from itemnorm.operators import leaders

    monkeypatch.setattr(leaders, "PREFIX_ROWS", 40)
    asked, met, find = [], [], leaders.best_neighbours

    def counted(left, right, *args, **how):
        asked.append(left.count())
        met.append(right.count())
        return find(left, right, *args, **how)

    monkeypatch.setattr(leaders, "best_neighbours", counted)
    rng = np.random.default_rng(5)
    v = rng.normal(size=(400, 8))
    if near:
        v = rng.normal(size=(6, 8))[rng.integers(0, 6, 400)] + 0.02 * v
    v[11] = 0
    key = np.arange(400) % 2
    entries = spark.createDataFrame([(int(k), n, [float(x) for x in r]) for n, (k, r) in enumerate(zip(key, v))], "cluster_id long, pos long, vec array<double>")
    got = leader_groups(entries, limit=0.15, block=40).collect()
    want = {}
    for k in (0, 1):
        rows = np.flatnonzero(key == k)
        want |= {int(rows[n]): int(rows[m]) for n, m in greedy(v[rows], 0.15).items()}
    assert {r["pos"]: r["leader_pos"] for r in got} == want and len(got) == 400
    print("rows looked up:", asked, "leaders met:", met)
    lead = len(set(want.values()))
    assert sum(asked) <= most and max(met) <= lead


def test_texts_that_repeat_are_looked_up_once(spark, monkeypatch):
    from itemnorm.model import POINT_ALIASES, POINTS, Memory
    from itemnorm.operators import matching
    from itemnorm.plans import clusterize as plan

    texts = ["old rod", "new valve 7 mm", "OLD  rod", None]
    items = spark.createDataFrame([(n, texts[n % 4]) for n in range(40)], "item_idx long, item string")
    points = [("p1", "old rod", {"type": "rod"}, "rods", {}, {}, None, None)]
    memory = Memory(spark.createDataFrame(points, POINTS), spark.createDataFrame([], POINT_ALIASES))
    asked = []

    def counted(rows, *how):
        asked.append(rows.count())
        return matching.match_memory(rows, memory)

    want = {(n, "p1") for n in range(40) if n % 4 in (0, 2)}
    found = matching.match_texts(items, counted).collect()
    assert {(r["item_idx"], r["item_id"]) for r in found} == want and len(found) == 20
    monkeypatch.setattr(plan, "match_memory", counted)
    out = plan.clusterize(items.where("item is not null"), memory)
    assert {(r["item_idx"], r["item_id"]) for r in out.matches.collect()} == want
    groups = out.groups.collect()
    assert {r["item_idx"] for r in groups} == set(range(1, 40, 4)) and len({r["cluster_id"] for r in groups}) == 1
    assert asked == [4, 3]


def test_a_bitmap_of_groups_stays_shorter_than_the_vector(spark):
    """However small the block, a left row on its way to the tiles is little longer than its vector; and a block of one side is a few MB."""
    v, left, right = dense(spark, 3000, d=4)
    cells = ce.measure(placed := ce.place_rows(right, ce.grow_cells(right, 3000, 1)).cache(), ce.grow_cells(right, 3000, 1))
    assert placed.count() == 3000
    sent = ce.tile_lists(left.withColumn("least", F.lit(0.5)), cells, 8).collect()
    print("bytes of bitmaps:", max(len(r["open"]) for r in sent))
    assert len(sent) > 2000 and max(len(r["open"]) for r in sent) <= 8 * 4
    assert nb._tile_rows(left, [], "l_vec", whole=True) * 8 * 4 <= 4 << 20


@pytest.mark.parametrize("k, prefer", [(1, "similar"), (3, "similar"), (1, "earliest")])
def test_products_in_single_precision_lose_and_change_nothing(k, prefer):
    rng = np.random.default_rng(3)
    right = units(np.concatenate([rng.normal(size=(60, 24)), np.repeat(rng.normal(size=(30, 24)), 40, axis=0) + 1e-8 * rng.normal(size=(1200, 24))]))
    left = np.concatenate([right[:200:3], units(rng.normal(size=(50, 24)))])
    scores = np.round(left @ right.T, 9)
    least = 0.3
    best = nb._compare(np.arange(len(left)), left, np.arange(len(right)), right, None, np.zeros(len(right), int), least, prefer, False, False, False, k)
    for i in range(len(left)):
        order = np.arange(len(right)) if prefer == "earliest" else np.argsort(-scores[i], kind="stable")
        want = [int(j) for j in order if scores[i, j] >= least][:k]
        assert [int(p) for p, s in zip(best.place[i], best.score[i]) if s > -np.inf] == want


def test_late_rounds_of_linkage_grow_no_cells(spark, monkeypatch):
    v = sample(60, seed=11)
    grown = []
    monkeypatch.setattr(nb, "grow_cells", lambda *a, grow=nb.grow_cells: grown.append(a) or grow(*a))
    got = cluster_items(frame(spark, v, "item_idx long, vec array<double>"), threshold=0.2, block=8).collect()
    assert {r[0]: r[1] for r in got} == linkage(v, 0.2)
    assert not grown


def test_a_step_of_a_cluster_is_one_file_and_leaders_are_not_written_again(spark, monkeypatch):
    from itemnorm.operators import leaders
    from itemnorm.queries.vectors import chain_vector

    monkeypatch.setattr(leaders, "PREFIX_ROWS", 40)
    monkeypatch.setattr(leaders, "PART_ROWS", 16, raising=False)
    files, again = [], []

    def dealt(*how, deal=leaders._in_steps):
        steps = deal(*how)
        files.append(len(steps.inputFiles()))
        return steps

    monkeypatch.setattr(leaders, "_in_steps", dealt)
    monkeypatch.setattr(nb, "cut_lineage", lambda df, cut=nb.cut_lineage: again.append(df.columns) or cut(df))
    chain = spark.range(0, 160, 1, 8).select(F.lit(7).cast("bigint").alias("cluster_id"), F.col("id").alias("pos"), chain_vector("id", 160).alias("vec"))
    got = leader_groups(chain, limit=0.15, block=40).collect()
    assert {r["pos"]: r["leader_pos"] for r in got} == {n: n - n % 2 for n in range(160)}
    assert files == [4] and not again
