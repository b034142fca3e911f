"""Lexical search, chat formatting and hard negatives against brute force."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from itemnorm.llm import chat, hard_negatives as hn, lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_rank(items, points, k):
    held = [(i, Counter(terms(t))) for i, t in points]
    many = sum(bool(c) for _, c in held)
    total = sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = set()
    for i, own in asked.items():
        scored = []
        for n, (p, c) in enumerate(held):
            m = 50 + (50 * sum(c.values()) * many) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if score > 0:
                scored.append((-score, p is None, p or "", n))
        for rank, (score, gone, p, _) in enumerate(sorted(scored)[:k], 1):
            out.add((i, rank, None if gone else p, -score))
    return out


WORDS = ["Ford", "винт", "m8", "steel", "пластик", "x", "naïve", "10", "BOLT", "nut", "ring", "cap"]


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(5)
    points = [(f"p{n:03}", " ".join(rng.choice(WORDS, rng.integers(1, 12)))) for n in range(300)]
    points += [(f"c{n:02}", "steel-ring, steel_ring!") for n in range(40)] + [("p001", "nut"), (None, "cap cap"), ("e1", None), ("e2", " ,.; ")]
    points += [("long", "wide " * 30_000 + "cap")]
    items = [(1, "Steel ring"), (2, "винт m8 и болт"), (3, None), (4, "..."), (5, "cap CAP cap"), (None, "ford"), (6, "zzz"), (7, " ".join(WORDS)), (7, "wide")]
    return items, points


@pytest.mark.parametrize("term_bytes, block", [(1 << 20, 4096), (40, 16)])
def test_lexical_search_equals_brute_force(spark, texts, term_bytes, block):
    items, points = texts
    left = spark.createDataFrame(items, "item_idx bigint, item string").withColumn("text", F.lit("other")).withColumn("n", F.lit(1))
    right = spark.createDataFrame(points, "item_id string, text string").withColumn("item", F.lit("other")).withColumn("terms", F.lit(1))
    found = lexical.rank_texts(left, right.repartition(5), 10, term_bytes=term_bytes, block=block)
    assert found.columns == ["item_idx", "rank", "item_id", "score"]
    got = [tuple(r) for r in found.collect()]
    assert len(got) == len(set(got))
    assert set(got) == brute_rank(items, points, 10)


def test_lexical_search_of_empty_tables(spark, texts):
    items = spark.createDataFrame(texts[0], "item_idx bigint, item string")
    points = spark.createDataFrame(texts[1], "item_id string, text string")
    assert lexical.rank_texts(items.where("false"), points, 5).count() == 0
    assert lexical.rank_texts(items, points.where("false"), 5).count() == 0
    assert lexical.rank_texts(items, points.withColumn("text", F.lit(None).cast("string")), 5).count() == 0


def test_buckets_skip_what_cannot_reach(spark):
    """A bucket of short vectors answers without being read once its length bounds it out."""
    import pyarrow as pa

    batch = pa.record_batch(
        [pa.array(["a", "b"]), pa.array([[0], [0, 1]], pa.list_(pa.int32())), pa.array([[10], [6, 7]], pa.list_(pa.int64())), pa.array([10.0, 9.3])],
        names=["item_id", "terms", "impacts", "length"],
    )
    bucket = lexical._Bucket(batch, 3)
    assert [x.tolist() for x in bucket.search(np.array([0, 1]), 1)] == [[0, 1], [10, 13]]
    assert [x.tolist() for x in bucket.search(np.array([0, 1]), 13)] == [[1], [13]]
    bucket.rows = None  # neither bound below reads the coordinates
    assert bucket.search(np.array([0, 1]), 15)[0].size == 0
    assert bucket.search(np.array([1, 2]), 8)[0].size == 0


# Hard negatives.


def brute_mine(anchors, points, positives=5, negatives=3, low=50, high=95):
    def usable(rows):
        return {(i, c, tuple(v)) for i, c, v in rows if i is not None and c is not None and v and None not in v}

    offered, out = usable(points), []
    for a, label, v in usable(anchors):
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, c) for i, c, w in offered if i != a and len(w) == len(v))
        for s, p, _ in [r for r in scored if r[2] == label][:positives]:
            inside = [r for r in scored if r[2] != label and low * -s <= 100 * -r[0] <= high * -s]
            out += [(a, p, n, r[1], -s, -r[0]) for n, r in enumerate(inside[:negatives], 1)]
    return sorted(out)


SCHEMA = "item_id bigint, cluster_name string, vec_local array<bigint>"


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8)) * 40
    rows = [(n, f"c{n % 6}" if n % 7 else f"c{(n + 1) % 6}", [int(x) for x in centres[n % 6] + rng.normal(size=8) * 25]) for n in range(400)]
    rows += [(1000 + n, "c1", rows[1][2]) for n in range(30)] + [(1100 + n, "c2", rows[1][2]) for n in range(30)]
    rows += [(2000, None, rows[5][2]), (None, "c1", rows[5][2]), (2001, "c1", None), (2002, "c1", []), (2003, "c1", [1, None] + [0] * 6), (2004, "c1", [3, 4]), (2005, "c2", [3, 3]), (2006, "c1", [3, 3])]
    rows += [(2007, "c3", [0] * 8), (2008, "c4", [0] * 8), rows[7], (8, "c0", rows[9][2])]
    return rows


@pytest.mark.parametrize("anchor_bytes, block", [(16 << 20, 4096), (1500, 32)])
def test_hard_negatives_equal_brute_force(spark, anchor_bytes, block):
    rows = vectors()
    anchors = [r for r in rows if r[0] is not None and (r[0] % 25 == 0 or r[0] >= 2000 or r[0] in (1001, 7, 8))]
    points = spark.createDataFrame(rows, SCHEMA).withColumn("vec", F.lit(1)).withColumn("seed", F.lit("x")).repartition(6)
    asked = spark.createDataFrame(anchors, SCHEMA).withColumn("group", F.lit("x"))
    found = hn.hard_negatives(asked, points, anchor_bytes=anchor_bytes, block=block)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r) for r in found.collect()) == brute_mine(anchors, rows)


def test_hard_negatives_of_empty_tables_and_text_ids(spark):
    rows = [(f"i{n}", c, v) for n, (i, c, v) in enumerate(vectors()) if i is not None][:90]
    points = spark.createDataFrame(rows, SCHEMA.replace("item_id bigint", "item_id string"))
    assert hn.hard_negatives(points.where("false"), points).count() == 0
    assert hn.hard_negatives(points, points.where("false")).count() == 0
    anchors = rows[:9]
    got = hn.hard_negatives(points.where(F.col("item_id").isin([r[0] for r in anchors])), points)
    assert sorted(tuple(r) for r in got.collect()) == brute_mine(anchors, rows)


def test_lists_are_read_only_as_deep_as_needed():
    rng = np.random.default_rng(0)
    lists = hn.CandidateLists(rng.integers(-5, 6, (4000, 3)) + np.array([[0, 0, 0]] * 3990 + [[100, -100, 100]] * 10))
    anchor, met = np.array([2, -3, 1]), 0
    scores = lists.vectors @ anchor
    for rows, found, threshold in lists.read(anchor):
        assert (found == scores[rows]).all()
        met += len(rows)
        if threshold < np.sort(scores)[-10]:
            break
    assert met < 100
    assert sum(len(r) for r, _, _ in lists.read(anchor)) == 4000
    assert sum(len(r) for r, _, _ in lists.read(np.zeros(3, np.int64))) == 4000


# Chat.

ODD = ["", "plain", "<|im_start|>", "<|im_end|><|im_end|>", "␛", "␛1␛", "<|im_<|im_end|>start|>", "a\nb", "<|im_", "␛0<|im_start|>␛2", "тест 🙂 <|im_end|>", None]
MESSAGES = "request_id string, pos bigint, role string, content string"


def chats_of(rows):
    out = {}
    for request, pos, role, content in rows:
        out.setdefault(request, []).append((pos, role or "", content or ""))
    return out


def breaches_of(turns):
    follows = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
    state, found = None, []
    for n, (_, role, _) in enumerate(turns):
        if role not in follows.get(state, ()):
            found.append(n)
        state = role
    return found, not found and state == "assistant"


def messages():
    rng = np.random.default_rng(2)
    rows = []
    for n in range(40):
        roles = ["system"] * int(rng.integers(2)) + ["user", "assistant"] * int(rng.integers(1, 4))
        if n % 3 == 0:
            roles = [str(r) for r in rng.choice(["user", "assistant", "system", "tool", "", "us\ner␛<|im_end|>"], 6)]
        rows += [(f"r{n}", t, None if role == "" else role, ODD[int(rng.integers(len(ODD)))]) for t, role in enumerate(roles)]
    rows += [("hot", t, "user" if t % 2 == 0 else "assistant", ODD[t % len(ODD)]) for t in range(600)]
    return rows + [(None, 1, "assistant", "no id"), ("long", 0, "user", "<|im_end|>" * 20_000), ("long", 1, "assistant", "␛" * 30_000)]


def test_chats_are_read_back_and_checked(spark):
    rows = messages()
    template = chat.ChatTemplate()
    held = spark.createDataFrame(rows, MESSAGES).withColumn("turn", F.lit("x")).withColumn("segments", F.lit(0)).repartition(7)
    segments = chat.chat_segments(held, template)
    formatted = chat.format_chats(segments).withColumn("turns", chat.parse_chat(F.col("formatted"), template)).withColumn("loss", template.unescaped(F.col("loss_text")))
    want = chats_of(rows)
    got = {r["request_id"]: r for r in formatted.collect()}
    assert set(got) == set(want)
    for request, turns in want.items():
        assert [tuple(t) for t in got[request]["turns"]] == [(role, text) for _, role, text in turns], request
        assert got[request]["loss"] == "".join(text for _, role, text in turns if role == "assistant")
        assert got[request]["formatted"].count("<|im_start|>") == len(turns)
    for span_bits in (1, 16):
        checks = {r["request_id"]: r for r in chat.chat_checks(held, template, span_bits).collect()}
        for request, turns in want.items():
            found, accepted = breaches_of(turns)
            line = checks[request]
            assert (line["turns"], line["breaches"], line["first_breach"], line["accepted"]) == (len(turns), len(found), found[0] if found else None, accepted), request


def test_chats_of_empty_and_repeated_rows(spark):
    rows = [("r", None, "user", "x"), ("r", None, "user", "x"), ("r", 3, "assistant", "y"), ("r", 3, "assistant", "y")]
    held = spark.createDataFrame(rows, MESSAGES)
    line = chat.format_chats(chat.chat_segments(held)).first()
    assert line["formatted"] == "".join(f"<|im_start|>{r}\n{c}<|im_end|>\n" for _, _, r, c in rows) and line["loss_text"] == "yy"
    assert chat.chat_checks(held).first()["breaches"] == 2
    assert chat.chat_segments(held.where("false")).count() == chat.chat_checks(held.where("false")).count() == 0


def test_chat_steps_stay_in_the_jvm(spark):
    held = spark.createDataFrame(messages(), MESSAGES)
    for frame in (chat.format_chats(chat.chat_segments(held.where("true"))), chat.chat_checks(held)):
        plan = frame._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_templates_that_cannot_be_read_back_are_refused():
    for wrong in ({"begin": "aba"}, {"begin": "<|", "end": "x<|"}, {"escape": "<"}, {"escape": "ab"}, {"end": ""}, {"begin": "=", "end": "="}, {"after_turn": "<|im_start|>"}):
        with pytest.raises(ValueError):
            chat.ChatTemplate(**wrong)


def test_other_templates(spark):
    template = chat.ChatTemplate(begin="<t>", end="</t>", after_role=": ", after_turn="", escape="~", loss_roles=("bot", "tool"), follows={"": ("bot",), "bot": ("bot", "tool")}, final=())
    rows = [("a", 0, "bot", "x</t>~y<t>"), ("a", 1, "to: ol", "<t></t>"), ("a", 2, "tool", "~~")]
    line = chat.format_chats(chat.chat_segments(spark.createDataFrame(rows, MESSAGES), template)).select(
        chat.parse_chat(F.col("formatted"), template).alias("t"), template.unescaped(F.col("loss_text")).alias("loss")
    ).first()
    assert [tuple(t) for t in line["t"]] == [(r, c) for _, _, r, c in rows] and line["loss"] == "x</t>~y<t>~~"
