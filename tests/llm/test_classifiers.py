"""URL filter, toxicity and quality: brute force, held-out accuracy, awkward rows; and the pipeline's stages."""

import random
import sys
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[2]))
from llm_tables import awkward_points, awkward_texts, empty_points  # noqa: E402

import corpus_pipeline  # noqa: E402
from itemnorm.llm import quality, toxicity, urls  # noqa: E402
from itemnorm.llm.queries import URL_RULES, remainder  # noqa: E402
from itemnorm.session import cut_lineage  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


# URLs


def match_brute(rules, host, path):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: (len(r.host) + len(r.path), len(r.host), r.verdict == "block"), default=None)


def test_trie_equals_brute_force():
    rng = random.Random(1)
    labels, parts = ["a", "b", "example", "com", "org"], ["", "en", "e", "1", "12"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))

    def path():
        return "".join("/" + rng.choice(parts) for _ in range(rng.randint(0, 3)))

    rules = [urls.UrlRule(rng.choice(["allow", "block"]), host(), path()) for _ in range(300)]
    trie = urls.UrlTrie(rules)
    for _ in range(3000):
        h, p = host(), path()
        assert trie.match(h, p) == match_brute(rules, h, p)


def test_filter_urls_of_awkward_rows(spark):
    given = [
        "https://Sub.Example.ORG/en/12?x#y", "http://example.org", "http://example.org/", None, "", "no scheme/", "x://COM/de/z", "a://b://com/fr/", "http://user@a.com:80/fr/", "http://acom/fr/x",
        "http://a.com/fr/\nline", "http://example.org?/es/", "://org/",
    ]
    pages = spark.createDataFrame([(k, u, "x", "y") for k, u in enumerate(given)] + [(2, given[2], "x", "y"), (None, given[2], "x", "y")], "page_id bigint, url string, host string, verdict string")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.filter_urls(pages, URL_RULES).collect()}
    assert (0, "sub.example.org", "/en/12", "example.org/en/1", "block") in got
    assert (1, "example.org", "", None, "allow") in got and (2, "example.org", "/", "org/", "allow") in got and (None, "example.org", "/", "org/", "allow") in got
    assert {(k, "", "", None, "allow") for k in (3, 4, 5)} <= got
    assert (6, "com", "/de/z", "com/de/", "block") in got and (7, "b:", "//com/fr/", None, "allow") in got
    assert (8, "user@a.com:80", "/fr/", None, "allow") in got and (9, "acom", "/fr/x", None, "allow") in got
    assert (10, "a.com", "/fr/\nline", "com/fr/", "allow") in got and (11, "example.org", "", None, "allow") in got and (12, "org", "/", "org/", "allow") in got
    assert urls.filter_urls(pages.limit(0), URL_RULES).count() == 0


# Toxicity


def chain_brute(e, moves):
    """Marginals by listing all taggings."""
    from itertools import product

    weight, toxic = 0.0, np.zeros(len(e))
    for tags in product((0, 1), repeat=len(e)):
        w = np.exp(sum(x for x, t in zip(e, tags) if t) + sum(moves[a, b] for a, b in zip(tags, tags[1:])))
        weight += w
        toxic += w * np.array(tags)
    return toxic / weight


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(2)
    moves, sizes = rng.standard_normal((2, 2)), (7, 1, 4)
    e, mask = rng.standard_normal((3, 7)), np.zeros((3, 7), bool)
    for k, n in enumerate(sizes):
        mask[k, :n] = True
    p, expected = toxicity.marginals(e, moves, mask, np.zeros(len(sizes), int))
    for k, n in enumerate(sizes):
        assert p[k, :n] == pytest.approx(chain_brute(e[k, :n], moves))
    assert expected.sum() == pytest.approx(sum(n - 1 for n in sizes))


def whole_chain(e, moves):
    """Forward and backward over one text, token by token."""
    t, n = np.exp(moves), len(e)
    emit = np.stack([np.ones(n), np.exp(e)], 1)
    forward, backward = np.empty((n, 2)), np.ones((n, 2))
    forward[0] = emit[0] / emit[0].sum()
    for i in range(1, n):
        forward[i] = forward[i - 1] @ t * emit[i]
        forward[i] /= forward[i].sum()
    moved = np.zeros((2, 2))
    for i in range(n - 2, -1, -1):
        backward[i] = t @ (emit[i + 1] * backward[i + 1])
        backward[i] /= backward[i].sum()
        joint = forward[i][:, None] * t * (emit[i + 1] * backward[i + 1])[None, :]
        moved += joint / joint.sum()
    both = forward * backward
    return both[:, 1] / both.sum(1), moved


def test_marginals_run_through_texts_of_many_pieces():
    rng = np.random.default_rng(3)
    moves = np.array([[1.5, -2.0], [-1.0, 2.5]])
    sizes = [1, 63, 64, 65, 128, 129, 700, 30_000, 2]
    texts = [rng.normal(-1, 2, n) for n in sizes]
    weights = rng.choice([1.0, 8.0], len(sizes))
    rows = np.concatenate([toxicity._pieces(e, 0.0) for e in texts])
    mask = np.concatenate([toxicity._pieces(np.ones(len(e)), 0.0) > 0 for e in texts])
    place = np.concatenate([np.arange(-(-n // toxicity.PIECE)) for n in sizes])
    p, expected = toxicity.marginals(rows, moves, mask, place, np.repeat(weights, [-(-n // toxicity.PIECE) for n in sizes]))
    want = [whole_chain(e, moves) for e in texts]
    assert p[mask] == pytest.approx(np.concatenate([w[0] for w in want]), abs=1e-9)
    assert expected == pytest.approx(sum(w * m for w, (_, m) in zip(weights, want)), rel=1e-9)


def test_words_in_front_of_a_text_change_its_spans_only_through_the_chain():
    """A long clean start, of whatever length, leaves the same marginals behind it."""
    model = toxicity.ToxicityModel({"=vile": 4.0, "=near": 1.0}, -2.0, np.array([[1.0, -1.0], [-1.0, 1.0]]))
    tail = ["c"] * 40 + ["vile", "near", "c", "near", "vile"] + ["c"] * 90
    alone = toxicity.text_marginals([["c"] * 200 + tail], model)[0][200:]
    for front in (201, 207, 231, 263, 264):
        assert toxicity.text_marginals([["c"] * front + tail], model)[0][front:] == pytest.approx(alone, abs=1e-9)


def made_texts(seed, n):
    rng = random.Random(seed)
    clean, bad = [f"w{k}" for k in range(300)], ["vilex", "vilemo", "nastor", "nastik"]
    rows, labels = [], []
    for k in range(n):
        words = [rng.choice(clean) for _ in range(rng.randint(5, 150))]
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(4):
                words[rng.randrange(len(words))] = rng.choice(bad) + rng.choice(["", "a", "o"])
        rows.append((k, " ".join(words), "s"))
        labels.append((k, int(toxic)))
    return rows, labels


def test_toxicity_of_held_out_texts_and_spans(spark):
    rows, labels = made_texts(4, 900)
    points = awkward_points(spark, rows)
    model = toxicity.fit_toxicity(points, spark.createDataFrame([x for x in labels if x[0] % 5], "item_id bigint, label int"))
    truth, texts = dict(labels), {i: t for i, t, _ in rows}
    held = [r for r in toxicity.score_toxicity(points, model).collect() if r["item_id"] % 5 == 0]
    assert np.mean([r["predicted"] == truth[r["item_id"]] for r in held]) >= 0.95
    found = Counter(texts[r["item_id"]][s["start"] : s["start"] + s["length"]][:4] for r in held for s in r["spans"])
    assert found["vile"] + found["nast"] >= 0.9 * sum(found.values()) > 0


def test_classifiers_of_awkward_rows(spark):
    rows = awkward_texts()
    points = awkward_points(spark)
    labels = spark.createDataFrame([(k, k % 2) for k in range(150)] + [(3, 5), (4, None), (None, 1), (5, 0), (5, 1), (9999, 1)], "item_id bigint, label int")
    none = labels.limit(0)
    for fit, score in ((toxicity.fit_toxicity, toxicity.score_toxicity), (quality.fit_quality, quality.score_quality)):
        for given in (labels, none, labels.where("label = 1")):
            model = fit(points, given)
            got = score(points, model).collect()
            assert Counter(r["item_id"] for r in got) == Counter(i for i, _, _ in rows)
            assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in got)
        assert score(empty_points(spark), fit(empty_points(spark), labels)).count() == 0
    assert all(r["predicted"] == 0 for r in toxicity.score_toxicity(points, toxicity.fit_toxicity(points, none)).collect())


# Quality


def test_additive_model_learns_main_and_pair_effects():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(quality.FEATURES)))
    y = ((x[:, 2] > 0.6) | ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5))).astype(float)
    model = quality.fit_additive(x[:3000], y[:3000])
    assert (0, 1) in model.pairs
    assert np.mean((model.score(x[3000:]) >= 0.5) == y[3000:]) > 0.93
    j = 5
    assert model.log_odds(x[:1])[0] == pytest.approx(
        model.base + sum(t[np.searchsorted(e, v)] for t, e, v in zip(model.tables, model.edges, x[0]))
        + sum(t[np.searchsorted(model.pair_edges[a], x[0, a]), np.searchsorted(model.pair_edges[b], x[0, b])] for (a, b), t in zip(model.pairs, model.pair_tables))
    )
    assert len(model.tables[j]) == len(model.edges[j]) + 1


def test_quality_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet".replace("sf0.001", "sf0.01")).selectExpr("doc_id item_id", "text")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet".replace("sf0.001", "sf0.01")).selectExpr("doc_id item_id", "quality label")
    train = labels.where(remainder(labels["item_id"], 3) != 1)
    got = quality.score_quality(docs, quality.fit_quality(docs, train)).join(labels.join(train.select("item_id"), "item_id", "left_anti"), "item_id").collect()
    assert len(got) > 50 and np.mean([r["predicted"] == r["label"] for r in got]) > 0.95


# Pipeline


def test_pipeline_stages_on_awkward_documents(spark):
    rows = [(i, t, "en", s, 1, "extra") for i, t, s in awkward_texts()]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, item_id string")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, docs.limit(0)):
            out = cut_lineage(stage(spark, given, SF_DIR))
            if stage is not corpus_pipeline.pack:
                assert out.columns == list(corpus_pipeline.COLUMNS), name


DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return set(zip(*(words[k:] for k in range(5)))) if len(words) >= 5 else ({tuple(words)} if words else set())


def similar_classes(texts):
    """Smallest position each text reaches over pairs of similarity 0.8 on five-word shingles."""
    sets, root = [shingle_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if root[i] != root[j] and (a == b or len(a & b) >= 0.8 * len(a | b)):
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


@pytest.mark.parametrize("rows", [awkward_texts(), awkward_texts()[:1], [(None, None, None)] * 3])
def test_dedup_stage_keeps_one_of_each_class(spark, rows):
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    docs = spark.createDataFrame([(i, t, "en", s, 1) for i, t, s in rows], DOCS).repartition(3)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect()
    roots = similar_classes([t for _, t, _ in rows])
    assert Counter(r["doc_id"] for r in kept) == Counter(rows[r][0] for r in set(roots))


def changed(words, places, name):
    out = list(words)
    for at in places:
        out[at] = f"{name}-{at}"
    return out


def test_dedup_stage_links_near_copies_by_their_similarity(spark):
    rng = np.random.default_rng(4)
    texts = []
    for n in range(150):
        words = [f"w{x}" for x in rng.integers(0, 10**6, 200)]
        # 200 words have 196 shingles: with four changed words 176 of 216 are shared, 0.81; with five 0.77.
        texts += [words, changed(words, (20, 60, 100, 140), f"y{n}"), changed(words, range(10, 200, 20), f"x{n}")]
    texts = [" ".join(t) for t in texts]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect()}
    want = set(similar_classes(texts))
    assert want == {i for i in range(len(texts)) if i % 3 != 1}
    assert want <= kept and len(kept - want) <= 3  # of 150 pairs just above the least similarity each is met with 0.998


def test_dedup_stage_of_a_crowd_and_a_common_passage(spark):
    rng = np.random.default_rng(5)
    base = [f"b{x}" for x in range(120)]
    crowd = [changed(base, [k % 120, (k * 7) % 120], f"c{k}") for k in range(900)]
    passage = [f"p{x}" for x in range(60)]
    sharers = [passage + [f"s{x}" for x in rng.integers(0, 10**6, 40)] for _ in range(900)]
    texts = [" ".join(t) for t in crowd + sharers]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS).repartition(4)
    kept = sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF_DIR).collect())
    assert kept == sorted(set(similar_classes(texts)))


def test_bands_meet_similar_sets_and_bitmaps_lose_none():
    from itemnorm.llm import simhash

    rng, met = np.random.default_rng(6), {0.8: 0, 0.5: 0}
    for similarity in met:
        for _ in range(400):
            members = np.unique(rng.integers(0, 2**63, 300).astype(np.uint64))
            own = int(len(members) * (1 - similarity) / 2)
            a, b = members[own:], members[: len(members) - own]
            met[similarity] += bool(set(simhash.band_keys(a)) & set(simhash.band_keys(b)))
            gap = int(np.bitwise_count((simhash.bitmap(a) ^ simhash.bitmap(b)).view(np.uint64)).sum())
            assert gap <= 2 * own
    assert met[0.8] >= 396 and met[0.5] <= 140
    assert len(simhash.band_keys(np.empty(0, np.uint64))) == 0


def test_mix_stage_repeats_documents(spark):
    rows = [(k, "a b c d", "en", "s0" if k < 10 else "s1", 7) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    got = Counter(r["source"] for r in corpus_pipeline.mix(spark, docs, SF_DIR).collect())
    assert got == {"s0": 20, "s1": 280}


def test_run_over_the_documents_table(spark):
    out = corpus_pipeline.run(spark, SF_DIR)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 100


def test_the_field_is_fitted_in_a_task(spark, monkeypatch):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(n, f"plain words {n} " + ("vile slur here" if n % 3 == 0 else "good day here")) for n in range(120)], "item_id bigint, text string")
    labels = docs.select("item_id", (F.col("item_id") % 3 == 0).cast("int").alias("label"))

    def on_driver(*args):
        raise AssertionError("texts came to the driver")

    monkeypatch.setattr(type(docs), "toPandas", on_driver)
    model = toxicity.fit_toxicity(docs, labels)
    assert "=slur" in model.weights
    assert {r["item_id"] for r in toxicity.score_toxicity(docs, model).where("predicted = 1").collect()} == set(range(0, 120, 3))
