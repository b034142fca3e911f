"""Packing, sharding, language model, mix, near-duplicates against brute force."""

import math
import sys
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from llm_tables import awkward_points, awkward_texts, empty_points  # noqa: E402

from itemnorm.llm import katz, mixing, packing, simhash, slots  # noqa: E402
from itemnorm.sources.commits import file_system  # noqa: E402
from itemnorm.llm.queries import packed_digest, tokenizer_path  # noqa: E402
from itemnorm.session import scratch_path  # noqa: E402


def words_of(text):
    return (text or "").encode().lower().split()


# Packing


def test_packing_round_trip_and_places(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    rows = awkward_texts()
    got = packed_digest(packing.pack_points(awkward_points(spark), packing.WordTokeniser(tokenizer_path()))).collect()
    want = Counter()
    for i, t, _ in rows:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for n, at in enumerate(range(0, len(ids), 2048)):
            part = ids[at : at + 2048]
            want[(i, n, at, len(part), zlib.crc32(part.tobytes()))] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by_sequence) <= math.ceil(sum(r["length"] for r in got) / 2048) + 2


@pytest.mark.parametrize("seed", range(4))
def test_plans_place_every_length(spark, seed):
    rng = np.random.default_rng(seed)
    lengths = [int(x) for x in np.where(rng.random(1500) < 0.5, rng.integers(1, 100, 1500), rng.integers(1, 401, 1500))]
    pieces = spark.createDataFrame([(k, 0, n) for k, n in enumerate(lengths)], "row_id bigint, piece int, length bigint")
    places = packing.pack_pieces(pieces, capacity=400, groups=12).collect()
    assert sorted(r["row_id"] for r in places) == list(range(1500))
    used = Counter()
    for r in places:
        used[r["sequence_id"]] += lengths[r["row_id"]]
    assert max(used.values()) <= 400
    assert len(used) <= 1.03 * sum(lengths) / 400 + 3


def test_configurations_hold_all_counts():
    groups = packing.linear_groups({900: 40, 700: 55, 650: 10, 600: 31, 513: 7}, 4)
    assert sum(g.count for g in groups) == 143 and all(g.low <= g.high for g in groups)
    plan = packing.configurations(groups, 2048)
    for k, g in enumerate(groups):
        assert sum(c[k] * n for c, n in plan) >= g.count
    assert all(sum(c[k] * g.high for k, g in enumerate(groups)) <= 2048 for c, _ in plan)


def test_packing_of_an_empty_table(spark):
    assert packed_digest(packing.pack_points(empty_points(spark), packing.WordTokeniser(tokenizer_path()))).count() == 0


# Sharding


def test_shards_balance_bytes_and_number_their_rows(spark):
    path = scratch_path(spark, "map")
    got = slots.shard_points(awkward_points(spark), 4, path).collect()
    rows = awkward_texts()
    assert Counter((r["item_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    total, places, of_slot = Counter(), defaultdict(list), {}
    for r in got:
        total[r["shard"]] += r["size"]
        places[r["shard"]].append(r["place"])
        assert of_slot.setdefault(r["virtual_slot"], r["shard"]) == r["shard"]
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    largest = max(len((t or "").encode()) for _, t, _ in rows)
    rest = [n for n in total.values() if n < largest]
    assert max(rest) - min(rest) <= 0.02 * max(rest)
    first, second = slots.SlotMap.read(spark, path, 1), slots.SlotMap.read(spark, path, 2)
    assert first.shard_of[:5] == (0, 1, 2, 3, 0) and second.shard_of != first.shard_of
    assert slots.shard_points(empty_points(spark), 4, scratch_path(spark, "map")).count() == 0


def test_a_stored_map_is_edited_not_made_anew(spark):
    path = scratch_path(spark, "slot-map")
    rows = [(n, "x" * (n % 50), "s") for n in range(3000)]
    place = lambda more, shards=4: {r["item_id"]: (r["shard"], r["map_version"]) for r in slots.shard_points(awkward_points(spark, rows + more), shards, path, slots=256).collect()}
    first = place([])
    assert {v for _, v in first.values()} == {2}
    assert place([]) == first  # even shards: nothing moves and no version is written
    heavy = [(5000 + n, "y" * 900, "s") for n in range(60)]
    second = place(heavy)
    assert {v for _, v in second.values()} == {3}
    moved = [i for i in first if first[i][0] != second[i][0]]
    assert 0 < len(moved) < len(first) / 2
    loads = Counter()
    for i, text, _ in rows + heavy:
        loads[second[i][0]] += len(text) + 1
    assert max(loads.values()) - min(loads.values()) <= 0.03 * sum(loads.values()) / 4
    spark.range(1).write.parquet(f"{path}/v=4")
    file_system(spark, path)[0].delete(file_system(spark, path)[1](f"{path}/v=4/_SUCCESS"), False)  # a writer that died
    third = place(heavy, 5)
    assert {v for _, v in third.values()} == {5}
    assert all(third[i][0] in (second[i][0], 4) for i in second) and any(s == 4 for s, _ in third.values())
    with pytest.raises(ValueError):
        slots.shard_points(awkward_points(spark), 4, path, slots=128)


def test_slot_map_versions():
    sizes = [int(x) for x in np.random.default_rng(1).integers(1, 1000, 512)]
    start = slots.SlotMap.first(8, 512)
    even = start.rebalanced(sizes, 8)
    loads = Counter()
    for slot, shard in enumerate(even.shard_of):
        loads[shard] += sizes[slot]
    assert even.version == 2 and max(loads.values()) - min(loads.values()) <= 2
    grown = even.grown(sizes, 9)
    moved = [s for s in range(512) if grown.shard_of[s] != even.shard_of[s]]
    assert moved and all(grown.shard_of[s] == 8 for s in moved)
    assert abs(sum(sizes[s] for s in moved) - sum(sizes) / 9) < 0.05 * sum(sizes) / 9
    fewer = even.rebalanced(sizes, 5)
    assert set(fewer.shard_of) == set(range(5))


# Language model


def katz_brute(rows, held):
    """The textbook recursion on dictionaries."""
    train = [[*words_of(t), b""] for i, t, _ in rows if i not in held]
    one, two, first = Counter(), Counter(), Counter()
    for tokens in train:
        for a, b in zip([b" ", *tokens], tokens):
            one[b] += 1
            two[a, b] += 1
            first[a] += 1
    n, v = sum(one.values()), len(one)
    lower = katz.Unigrams.fit([0, *[sum(c == r for c in one.values()) for r in range(1, 7)]], n, v)
    upper = katz.Discounts.fit([0, *[sum(c == r for c in two.values()) for r in range(1, 7)]])

    def p1(w):
        return float(lower.chance(np.array([one[w]]))[0])

    def d2(r):
        return float(upper.of(np.array([r]))[0])

    def context(a):
        seen = [(b, r) for (x, b), r in two.items() if x == a]
        held_mass = sum(d2(r) for _, r in seen)
        t = first[a] if held_mass < first[a] * (1 - 1e-12) else first[a] + 1
        return t, (1 - held_mass / t) / (1 - sum(p1(b) for b, _ in seen))

    def p2(a, b):
        if not first[a]:
            return p1(b)
        t, alpha = context(a)
        return d2(two[a, b]) / t if two[a, b] else alpha * p1(b)

    return one, n, v, p1, p2, first


def test_katz_equals_the_recursion(spark, monkeypatch):
    monkeypatch.setattr(katz, "CHUNK", 300)
    monkeypatch.setattr(katz, "FREQUENT", 20)
    rows = [r for r in awkward_texts() if r[0] is not None and r[0] != 173][:150] + [(900, "new words only", None), (901, None, None)]
    rows = list({r[0]: r for r in rows}.values())
    held = {i for i, _, _ in rows if i % 5 == 1} | {900}
    points = awkward_points(spark, rows).withColumn("held_out", F.col("item_id").isin(*held))
    one, n, v, _, p2, _ = katz_brute(rows, held)
    got = {r["item_id"]: r for r in katz.score_texts(points).collect()}
    assert len(got) == len(rows)
    for i, t, _ in rows:
        tokens = [*words_of(t), b""]
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i in held, len(tokens), sum(one[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens), rel=1e-9)
        assert r["score"] == pytest.approx(sum(math.log10(p2(a, b)) for a, b in zip([b" ", *tokens], tokens)), rel=1e-9)


def test_katz_probabilities_add_up_to_one():
    rows = [r for r in awkward_texts() if r[0] is not None and r[0] < 60]
    one, _, _, p1, p2, first = katz_brute(rows, set())
    unknown = b"never seen"
    assert sum(p1(w) for w in [*one, unknown]) == pytest.approx(1)
    for a in list(first)[:20]:
        assert sum(p2(a, w) for w in [*one, unknown]) == pytest.approx(1)


def test_good_turing_holds_for_tables_with_copies():
    # Counts of counts of words and pairs of documents with repeated passages: n[5] is too large for n[4].
    for n in ([0, 200420, 57120, 23804, 13644, 12859, 6775], [0, 1482341, 227973, 46941, 19718, 17404, 6993]):
        d = katz.Discounts.fit(n).factors
        assert all(0 < a <= b <= 1 for a, b in zip(d, d[1:]))
        assert sum(n[r] * r * (1 - d[r - 1]) for r in range(1, 6)) == pytest.approx(n[1])  # what Good-Turing leaves to the unseen
        share = n[1] / (n[1] + 2 * n[2])
        assert all(abs(d[r - 1] - (r - share) / r) > 0.01 for r in (1, 2, 3))  # no absolute discount


def test_good_turing_of_thin_and_odd_counts():
    assert katz.Discounts.fit([0, 40, 10, 0, 2, 0, 0]).factors[0] > 0
    for n in ([0, 0, 5, 3, 1, 1, 1], [0, 9, 0, 0, 0, 0, 0], [0, 1, 2, 3, 4, 5, 6], [0] * 7):
        share = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] + n[2] else 0.5
        assert katz.Discounts.fit(n).factors == tuple((r - share) / r for r in range(1, 6))
    rng = np.random.default_rng(0)
    for _ in range(2000):
        n = [0, *rng.integers(0, 10 ** rng.integers(1, 7), 6).tolist()]
        assert all(0 < x <= 1 for x in katz.Discounts.fit(n).factors), n


def test_katz_without_training_texts_and_rows(spark):
    held = awkward_points(spark).withColumn("held_out", F.lit(True))
    got = katz.score_texts(held).collect()
    assert len(got) == len(awkward_texts()) and all(r["score"] == 0 and r["train_tokens"] == 0 for r in got)
    assert katz.score_texts(empty_points(spark).withColumn("held_out", F.lit(False))).count() == 0


# Mix


def test_targets_share_the_excess_again():
    assert mixing.source_targets([100, 100, 100], [5, 2, 1], 1.5, 2.0) == [200.0, pytest.approx(500 / 3), pytest.approx(250 / 3)]
    assert mixing.source_targets([10, 1000], [5, 2], 1.5, 2.0)[0] == 20.0
    assert mixing.source_targets([], [5], 1.5, 2.0) == []


def test_flight_keeps_words_and_rows():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 500, 300).astype(float)
    p = np.full(300, 0.37)
    after = mixing.fly(p, size)
    assert ((after > 0) & (after < 1)).sum() <= 2
    assert after.sum() == pytest.approx(p.sum()) and after @ size == pytest.approx(p @ size)


def test_inclusion_does_not_depend_on_size(spark):
    rng = np.random.default_rng(0)
    sizes = np.maximum(1, rng.lognormal(3, 1, (60, 600))).astype(int)
    rows = [(600 * s + k, "w " * int(n), f"src{s:02}") for s, own in enumerate(sizes) for k, n in enumerate(own)]
    points = spark.createDataFrame(rows, "item_id bigint, text string, source string")
    got = mixing.mix_sources(points, (1,), 0.2, 2.0).select("size", "copies", (F.col("target") / F.col("source_size")).alias("p")).toPandas()
    rank = got["size"].rank(method="first") * 10 // (len(got) + 1)
    assert (got["copies"] - got["p"]).groupby(rank).mean().abs().max() < 0.02


@pytest.mark.parametrize("block", [4096, 8])
def test_mix_meets_the_targets(spark, block):
    rows = awkward_texts()
    points = awkward_points(spark)
    got = mixing.mix_sources(points, (5, 2, 1), 1.5, 2.0, block=block).collect()
    assert Counter((r["item_id"], r["source"], r["size"]) for r in got) == Counter((i, s, len(words_of(t))) for i, t, s in rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words_of(t))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    targets = dict(zip(names, mixing.source_targets([sizes[s] for s in names], [(5, 2, 1)[k % 3] for k in range(len(names))], 1.5, 2.0)))
    taken, largest = Counter(), Counter()
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(targets[r["source"]])
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
    for s in names:
        assert abs(taken[s] - targets[s]) <= largest[s] / 2 + 1
    again = mixing.mix_sources(points.repartition(5), (5, 2, 1), 1.5, 2.0, block=block).collect()
    assert Counter((r["item_id"], r["size"], r["copies"]) for r in again) == Counter((r["item_id"], r["size"], r["copies"]) for r in got)


def test_equal_rows_without_ids_are_dealt_over_blocks(spark):
    rows = [(None, "a b c", "s0")] * 10_000 + [(k, "a b", "s1") for k in range(3000)] + [(7, None, None), (7, "", None)]
    given = spark.createDataFrame(rows, "item_id bigint, text string, source string").repartition(5)
    got = [
        sorted(((r["item_id"] is None, r["item_id"] or 0, r["size"], r["copies"]) for r in mixing.mix_sources(given, (5, 2, 1), 1.2, 2.0, block=512).collect()))
        for _ in range(2)
    ]
    assert got[0] == got[1] and len(got[0]) == len(rows)
    total = 36_000
    targets = mixing.source_targets([30_000, 6000, 0], (5, 2, 1), 1.2, 2.0)
    assert sum(targets) == pytest.approx(1.2 * total)
    assert abs(sum(3 * c for no_id, _, _, c in got[0] if no_id) - targets[0]) <= 3
    assert {c for no_id, _, _, c in got[0] if no_id} == {math.floor(targets[0] / 30_000), math.ceil(targets[0] / 30_000)}
    equal = spark.createDataFrame([(None, 3, 0, 0.5, 10_000, 20)], "item_id bigint, size bigint, k int, p double, n bigint, blocks bigint")
    blocks = mixing.in_blocks(mixing.in_chunks(equal)).groupBy("block").agg(F.sum("n").alias("n")).collect()
    assert len(blocks) == 20 and max(r["n"] for r in blocks) <= 2 * 512 + 64 and sum(r["n"] for r in blocks) == 10_000


def test_mix_of_an_empty_table(spark):
    assert mixing.mix_sources(empty_points(spark), (5, 2, 1), 1.5).count() == 0


# Near-duplicates


def print_brute(text):
    words = words_of(text)
    grams = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, distance):
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    values = sorted(root)
    for n, a in enumerate(values):
        for b in values[n + 1 :]:
            if (a ^ b).bit_count() <= distance:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {p: find(p) for p in root}


def test_near_duplicates_equal_brute_force(spark):
    rows = [r for r in awkward_texts() if r[0] != 173]
    got = simhash.near_duplicates(awkward_points(spark, rows)).collect()
    prints = [(i, print_brute(t)) for i, t, _ in rows]
    roots = components({p for _, p in prints}, 3)
    first = {}
    for i, p in prints:
        if i is not None:
            first[roots[p]] = min(i, first.get(roots[p], i))
    assert Counter((r["item_id"], r["fingerprint"] & (2**64 - 1), r["component_id"]) for r in got) == Counter((i, p, first.get(roots[p])) for i, p in prints)
    assert simhash.near_duplicates(empty_points(spark)).count() == 0


@pytest.mark.parametrize("distance,block", [(3, 1024), (3, 8), (2, 16), (6, 64)])
def test_links_connect_all_near_fingerprints(spark, distance, block):
    rng = np.random.default_rng(distance)
    values = {int(x) for x in rng.integers(0, 2**63, 150)}
    chain = int(rng.integers(0, 2**63))
    for _ in range(120):  # a chain whose ends are far apart, and a crowd around one print
        values.add(chain)
        for b in rng.choice(64, rng.integers(1, distance + 1), replace=False):
            chain ^= 1 << int(b)
    centre = int(rng.integers(0, 2**63))
    values |= {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 64, (120, 2))}
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    links = simhash.near_links(spark.createDataFrame(signed, "fingerprint bigint"), distance, block)
    got = {r["node"] & (2**64 - 1): r["root"] & (2**64 - 1) for r in simhash.connected(links).collect()}
    want = components(values, distance)
    classes = lambda m: {frozenset(k for k in m if m[k] == r) for r in set(m.values())}
    assert {c for c in classes({v: got.get(v, v) for v in values})} == classes(want)


def test_long_chains_find_one_root(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(500)] + [(1000, 1001)], "a bigint, b bigint")
    assert {(r["node"], r["root"]) for r in simhash.connected(links).collect()} == {(k, 0) for k in range(501)} | {(1000, 1000), (1001, 1000)}
