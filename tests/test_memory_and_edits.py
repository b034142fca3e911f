import glob
import hashlib
import os
import tempfile
from collections import Counter

import pytest
from pyspark.sql import functions as F

from itemnorm.model import ALIASES, CLUSTERS, ITEMS, MEMBERS, POINT_ALIASES, POINTS, ROWS, Catalogue, Memory
from itemnorm.functions.text import item_id
from itemnorm.operators import edits as ed
from itemnorm.operators import enrich as en
from itemnorm.operators.assemble import export_numbers, export_rows, select_clusters
from itemnorm.operators.matching import match_memory
from itemnorm.operators.ordering import first_at, first_per_key, last_at, last_per_key
from itemnorm.plans.normalize import normalize
from itemnorm.session import scratch_path
from itemnorm.sources import memory_store as ms
from itemnorm.sources.files import export_lines, read_items, write_export


def points(spark, rows):
    df = spark.createDataFrame(rows, "text string, attributes map<string,string>, cluster_name string, vec_local array<double>, vec_alt array<double>")
    empty = F.create_map().cast("map<string,string>")
    names = [c.split(" ")[0] for c in POINTS.split(", ")]
    return df.withColumns({"item_id": item_id("text"), "attribute_merge": empty, "attribute_merge_separators": empty}).select(*names)


def memory(spark):
    pts = points(
        spark,
        [
            ("alpha", {"a": "1"}, "C", [1.0, 0.0], [1.0, 0.0, 0.0]), ("beta", {}, "C", [0.0, 1.0], None),
            ("gamma", {"a": "2"}, " ", [0.1, 0.995], [0.0, 1.0, 0.0]),
        ],
    )
    alias = spark.createDataFrame([("alpha", 0, " First  ALIAS ", None)], "t string, alias_pos long, alias string, values map<string,string>")
    return Memory(pts, alias.select(item_id("t").alias("item_id"), "alias_pos", "alias", "values"))


def test_match_cascade(spark):
    items = spark.createDataFrame(
        [
            (0, "first alias", [0.0, 1.0], [0.0, 1.0, 0.0]), (1, "x", [1.0, 0.01], [0.0, 1.0, 0.0]), (2, "y", [1.0, 0.02], None),
            (3, "z", [0.0, 1.0], None), (4, "GAMMA", [1.0, 0.0], None), (5, "w", [-1.0, 0.0], None),
        ],
        "item_idx long, item string, vec_local array<double>, vec_alt array<double>",
    )
    mem = memory(spark)
    ids = {r["item_id"]: r["text"] for r in mem.points.collect()}
    got = {r["item_idx"]: (ids[r["item_id"]], r["matched_by"]) for r in match_memory(items, mem).collect()}
    # Item 3 is nearest to a point without attributes: no match, not the runner-up.
    assert got == {0: ("alpha", "payload"), 1: ("gamma", "gemini"), 2: ("alpha", "local"), 4: ("gamma", "payload")}


def test_memory_versions_and_partial_writes(spark):
    path = scratch_path(spark, "memory-test")
    assert ms.read_memory(spark, path).points.count() == 0
    ms.write_memory(spark, path, memory(spark))
    mem = ms.read_memory(spark, path)
    assert mem.points.count() == 3
    # Data that was never committed is not read.
    mem.points.write.parquet(f"{path}/data-died/points")
    assert ms.current_version(spark, path) == 1
    kept, removed = ms.memory_delete_cluster(mem, "C ")
    assert removed == 2 and ms.write_memory(spark, path, kept) == 2
    assert [r["text"] for r in ms.read_memory(spark, path, with_vectors=False).points.collect()] == ["gamma"]
    assert ms.memory_load(mem, "Память").points.count() == 1
    assert ms.clear_memory(spark, path) and not ms.clear_memory(spark, path)


def test_small_saves_write_only_what_they_change(spark):
    import os

    path = scratch_path(spark, "memory-test")
    ms.write_memory(spark, path, memory(spark))
    before = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(path) for f in files}
    names = "save_pos long, text string, attributes map<string,string>, cluster_name string, attribute_merge map<string,string>, attribute_merge_separators map<string,string>, vec_local array<double>, vec_alt array<double>"
    new = spark.createDataFrame([(0, "alpha", {"a": "new"}, "D", {}, {}, None, None), (1, "delta", {"a": "1"}, "D", {}, {}, None, None)], names)
    aliases = spark.createDataFrame([(0, 0, "al", None), (1, 0, "de", None)], "save_pos long, alias_pos long, alias string, values map<string,string>")
    base = ms.current_version(spark, path)
    assert ms.save_points(spark, path, new, aliases) == 2
    with pytest.raises(ms.StaleMemory):
        ms.save_points(spark, path, new, aliases, base=base)
    got = {r["text"]: (r["cluster_name"], r["attributes"].get("a")) for r in ms.read_memory(spark, path).points.collect()}
    assert got["alpha"] == ("D", "new") and got["delta"] == ("D", "1") and len(got) == 4
    assert ms.remove_text(spark, path, " delta ") == 1 and ms.remove_text(spark, path, "delta") == 0
    assert ms.remove_cluster(spark, path, "D") == 1
    left = ms.read_memory(spark, path)
    assert {r["text"] for r in left.points.collect()} == set(got) - {"alpha", "delta"}
    assert {r["item_id"] for r in left.aliases.collect()} <= {r["item_id"] for r in left.points.collect()}
    after = {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, files in os.walk(path) for f in files}
    assert {f: after[f] for f in before} == before
    # A long chain is written whole again, an id that comes back counts, and old data can go.
    for _ in range(ms.CHAIN + 1):
        ms.save_points(spark, path, new, aliases)
    assert {r["text"] for r in ms.read_memory(spark, path).points.collect()} == set(got)
    assert ms.vacuum(spark, path) > 0 and ms.read_memory(spark, path).points.count() == 4


def catalogue(spark):
    clusters = spark.createDataFrame(
        [(1, "One", ["a", "b"], "{a}-{b}", {"a": "accumulative"}, {}, "", ""), (2, "Two", ["a"], "", {}, {}, "ai", "")], CLUSTERS
    )
    rows = spark.createDataFrame(
        [
            (1, 0, "i0", "n0", {"a": "1", "b": "x"}, "ai", False), (1, 1, "i1", "n1", {"a": "2", "b": "y"}, "memory", False),
            (1, 2, "i2", "n2", {"a": "3", "b": ""}, "ai", False), (2, 0, "j0", "m0", {"a": "9"}, "ai", False),
        ],
        ROWS,
    )
    aliases = spark.createDataFrame([(1, 0, 0, "i0"), (1, 0, 1, "k0"), (1, 1, 0, "i1"), (1, 2, 0, "i2"), (2, 0, 0, "j0")], ALIASES)
    members = spark.createDataFrame(
        [(1, 0, 0, "i0", {"a": "1", "b": "x"}, "ai"), (1, 0, 1, "k0", {"a": "5", "b": "z"}, "memory")], MEMBERS
    )
    items = spark.createDataFrame([(1, 0, "n0"), (1, 1, "n1"), (1, 2, "n2"), (2, 0, "m0")], ITEMS)
    return Catalogue(clusters, rows, aliases, members, items)


def rows_of(c):
    return {(r["cluster_id"], r["row_pos"]): (r["item"], r["enriched_name"], r["values"]) for r in c.rows.collect()}


def test_merge_rows(spark):
    merges = spark.createDataFrame([(1, 1, 0, 1), (1, 2, 0, 0)], "cluster_id long, src long, dst long, merge_pos long")
    out = ed.merge_rows(catalogue(spark), merges)
    rows = rows_of(out)
    assert rows[(1, 0)] == ("i0", "1; 5; 3; 2-x", {"a": "1; 5; 3; 2", "b": "x"})
    assert set(rows) == {(1, 0), (2, 0)}
    named = out.aliases.where("cluster_id = 1").orderBy("alias_pos").collect()
    assert [r["alias"] for r in named] == ["i0", "k0", "i2", "i1"]
    assert out.members.where("cluster_id = 1").count() == 4
    bad = spark.createDataFrame([(1, 1, 0, 1), (1, 0, 2, 0)], "cluster_id long, src long, dst long, merge_pos long")
    with pytest.raises(Exception, match="merge source"):
        ed.merge_rows(catalogue(spark), bad).rows.collect()


def test_split_alias(spark):
    splits = spark.createDataFrame([(1, 0, " k0 ")], "cluster_id long, row_pos long, alias string")
    out = ed.split_aliases(catalogue(spark), splits)
    rows = rows_of(out)
    assert rows[(1, 0)] == ("i0", "1-x", {"a": "1", "b": "x"})
    assert rows[(1, 1)] == ("k0", "5-z", {"a": "5", "b": "z"})
    assert rows[(1, 2)][0] == "i1" and rows[(1, 3)][0] == "i2" and rows[(2, 0)][0] == "j0"
    assert [r["source"] for r in out.rows.where("cluster_id = 1 and row_pos = 1").collect()] == ["memory"]
    # The only member leaves even under another name; the row falls back to its item.
    lone = ed.split_aliases(catalogue(spark), spark.createDataFrame([(1, 1, "i1")], "cluster_id long, row_pos long, alias string"))
    assert [r["alias"] for r in lone.aliases.where("cluster_id = 1 and row_pos = 1").collect()] == ["i1"]


def test_move_rows_brings_attributes(spark):
    moves = spark.createDataFrame([(1, 1, 2, 0)], "cluster_id long, row_pos long, target_id long, move_pos long")
    out = ed.move_rows(catalogue(spark), moves)
    rows = rows_of(out)
    assert rows[(2, 1)] == ("i1", "n1", {"a": "2", "b": "y"})
    assert rows[(2, 0)][2] == {"a": "9", "b": ""}
    assert out.clusters.where("cluster_id = 2").head()["attributes"] == ["a", "b"]
    assert [r["alias"] for r in out.aliases.where("cluster_id = 2 and row_pos = 1").collect()] == ["i1"]


def test_policy_edit_conflict_and_signature(spark):
    c = catalogue(spark)
    edits = spark.createDataFrame([(1, 0, 0, "b", "new"), (1, 1, 0, "b", "new")], "cluster_id long, row_pos long, edit_pos int, attr string, value string")
    out = ed.edit_values(c, edits)
    members = {(r["row_pos"], r["item"]): r["values"]["b"] for r in out.members.where("cluster_id = 1").collect()}
    assert members == {(0, "i0"): "x", (0, "k0"): "z", (1, "i1"): "new"}
    audit = ed.priority_conflicts(out).orderBy("place").collect()
    assert [(r["row_pos"], r["attr"], r["value"]) for r in audit] == [(0, "b", "new"), (0, "b", "x"), (0, "b", "z")]
    assert [r[0] for r in ed.unsaved_clusters(out, ed.signatures(c)).collect()] == [1]
    policy = spark.createDataFrame([(1, "b", "accumulative", "/")], "cluster_id long, attr string, mode string, separator string")
    assert rows_of(ed.set_policy(c, policy))[(1, 0)][2] == {"a": "1; 5", "b": "x/z"}


def test_export_bytes_and_reading_back(spark):
    c = catalogue(spark)
    c = c.with_(rows=c.rows.withColumn("values", F.map_concat("values", F.create_map(F.lit("a"), F.lit('q,"r"')))))
    norm = spark.createDataFrame([(0, "k0", {"b": "over"})], "norm_pos long, item string, values map<string,string>")
    path = scratch_path(spark, "export-test")
    heads = export_numbers(c.clusters).where("cluster_id = 1")
    write_export(export_lines(export_rows(c, norm).where("cluster_id = 1"), heads), path)
    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{path.replace('file:', '')}/part-*")))
    lines = data.decode("utf-8").split("\r\n")
    assert lines[0] == "﻿Обогащенное наименование,Исходные номенклатуры,a,b"
    assert lines[1] == 'n0,i0; k0,"q,""r""",over'
    back = read_items(spark, path)
    assert back.columns[0] == "Обогащенное наименование" and back.count() == 3


def test_read_items_messy_file(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_bytes("﻿name, size ,name\n a ,1,b\n\"x\ny\",2\n".encode())
    df = read_items(spark, str(path), multi_line=True)
    assert df.columns == ["name", "size"]
    assert [tuple(r) for r in df.collect()] == [("b", "1"), ("", "2")]


def test_batches_are_audited_and_rejected(spark):
    def load():
        def ask(items, attributes, prompt):
            import json

            kept = [i for i in items if i != "lost"]
            return "```json\n" + json.dumps({"normalized": [{"item": i, "values": {a: i + a for a in attributes}} for i in kept]}) + "\n```"

        return ask

    items = spark.createDataFrame([(1, p, f"i{p}", ["a"]) for p in range(10)] + [(2, 0, "lost", ["a"])], "cluster_id long, pos long, item string, attributes array<string>")
    values, rejected, answers = en.extract_values(items, en.python_provider(load))
    assert {r["item"]: r["values"] for r in values.collect()} == {f"i{p}": {"a": f"i{p}a"} for p in range(10)}
    assert [r["items"] for r in rejected.collect()] == [["lost"]]
    again = en.extract_values(items, en.python_provider(load), answers.cache)[2]
    # A refused answer is not cached, so it is asked for again.
    assert [r["items"] for r in again.responses.where("not from_cache").collect()] == [["lost"]]
    usable = items.where("item <> 'lost'")
    assert en.extract_values(usable, en.python_provider(lambda: None), answers.cache)[2].responses.where("not from_cache").count() == 0


def test_a_call_that_raises_fails_its_own_request(spark):
    """Final errors are asked once, passing ones again; the other requests of the same task are answered."""
    folder = tempfile.mkdtemp()

    def load():
        import json
        import os
        import uuid

        def ask(items, attributes, prompt):
            open(os.path.join(folder, f"{items[0]}-{uuid.uuid4().hex}"), "w").close()
            if items[0] == "denied":
                raise PermissionError("no")
            if items[0] == "busy" and len([f for f in os.listdir(folder) if f.startswith("busy")]) < 2:
                raise RuntimeError("429 slow down")
            if items[0] == "never":
                raise TimeoutError("later")
            return json.dumps({"normalized": [{"item": i, "values": {"a": i}} for i in items]})

        return ask

    rows = [(n, 0, item, ["a"]) for n, item in enumerate(["fine", "denied", "busy", "never", "good"])]
    items = spark.createDataFrame(rows, "cluster_id long, pos long, item string, attributes array<string>").coalesce(1)
    values, rejected, answers = en.extract_values(items, en.python_provider(load), attempts=3)
    assert {r["item"] for r in values.collect()} == {"fine", "busy", "good"}
    assert {(r["items"][0], r["error"]) for r in rejected.collect()} == {("denied", "PermissionError: no"), ("never", "TimeoutError: later")}
    assert not answers.complete and answers.cache.count() == 3
    asked = Counter(name.split("-")[0] for name in os.listdir(folder))
    assert asked == {"fine": 1, "denied": 1, "busy": 2, "never": 3, "good": 1}
    assert {(r["cluster_id"], r["batches"], r["error"]) for r in en.failed_groups(rejected).collect()} == {(1, 1, "PermissionError: no"), (3, 1, "TimeoutError: later")}
    broken = en.extract_values(items, en.python_provider(lambda: 1 / 0), attempts=2)[1]
    assert {r["error"] for r in broken.collect()} == {"ZeroDivisionError: division by zero"}


def test_a_profile_that_lacks_a_batch_is_none(spark):
    def load():
        return lambda items, attributes, prompt: "?" if "bad" in items else '{"category": "c", "attributes": ["x"], "name_template": ""}'

    rows = [(1, n, f"i{n}") for n in range(40)] + [(2, n, "bad" if n == 30 else f"j{n}") for n in range(40)]
    items = spark.createDataFrame(rows, "cluster_id long, pos long, item string")
    profiles, rejected, answers = en.profile_clusters(items, en.python_provider(load), ["base"])
    assert [(r["cluster_id"], r["attributes"]) for r in profiles.collect()] == [(1, ["base", "x"])]
    assert [(r["cluster_id"], r["batch"], r["error"]) for r in rejected.collect()] == [(2, 1, None)]
    assert answers.cache.count() == 5


def test_points_whose_ids_share_their_first_digits_stay_apart(spark):
    from itemnorm.model import POINT_ALIASES, POINTS, Memory
    from itemnorm.operators.assemble import memory_to_clusters

    ids = ["01234567-89ab-5cde-8001-000000000001", "01234567-89ab-5cde-8001-000000000002", "01234567-89ab-5cde-8001-000000000000"]
    points = spark.createDataFrame([(i, f"name {n}", {"a": str(n)}, "same" if n < 2 else "other", {}, {}, None, None) for n, i in enumerate(ids)], POINTS)
    aliases = spark.createDataFrame([(i, 0, f"alias {n}", None) for n, i in enumerate(ids)], POINT_ALIASES)
    out = memory_to_clusters(Memory(points, aliases), [])
    assert {(r["cluster_id"], r["row_pos"], r["item"], r["values"]["a"]) for r in out.rows.collect()} == {(1, 0, "alias 0", "0"), (1, 1, "alias 1", "1"), (0, 0, "alias 2", "2")}


def test_normalize_fills_only_gaps_of_known_items(spark):
    seen = en.pattern_extraction({"a": r"a(\d)", "b": r"b(\d+)"})
    c = catalogue(spark)
    members = spark.createDataFrame(
        [(1, 0, 0, "a7 b2", {"a": "known"}, "memory"), (1, 0, 1, "a8 b3", {"a": "forgotten"}, "ai")], MEMBERS
    )
    one = c.with_(clusters=c.clusters.where("cluster_id = 1"), rows=c.rows.where("cluster_id = 1 and row_pos = 0"), members=members, items=c.items.where("cluster_id = 1"))
    out = normalize(one, provider=seen)
    got = {r["item"]: (r["values"], r["enriched_name"]) for r in out.items.collect()}
    assert got == {"a7 b2": ({"a": "known", "b": "2"}, "known-2"), "a8 b3": ({"a": "8", "b": "3"}, "8-3")}


def test_selection_refuses_unknown_clusters(spark):
    c = catalogue(spark).clusters
    assert select_clusters(c, None).count() == 2
    picked = spark.createDataFrame([(0, 2), (1, 1), (2, 2)], "sel_pos long, cluster_id long")
    assert [r["cluster_id"] for r in select_clusters(c, picked).orderBy("sel_pos").collect()] == [2, 1]
    with pytest.raises(Exception, match="out of range"):
        select_clusters(c, spark.createDataFrame([(0, 9)], "sel_pos long, cluster_id long")).collect()


def test_commits_appear_whole_or_not_at_all(spark):
    from itemnorm.sources.commits import file_system, names, put_if_absent, read_commit

    path = scratch_path(spark, "commits")
    file_system(spark, path)[0].mkdirs(file_system(spark, path)[1](path))
    assert put_if_absent(spark, f"{path}/commit-1", {"n": 1})
    assert not put_if_absent(spark, f"{path}/commit-1", {"n": 2})
    assert read_commit(spark, f"{path}/commit-1") == {"n": 1}
    assert names(spark, path) == ["commit-1"]
    with pytest.raises(Exception) as denied:  # no disk of that name: not a taken number
        put_if_absent(spark, "nosuchstore://x/commit-1", {"n": 1})
    assert not isinstance(denied.value, ms.StaleMemory)


def test_a_torn_commit_is_no_version(spark):
    from itemnorm.sources.commits import file_system

    path = scratch_path(spark, "memory")
    first = memory(spark)
    assert ms.write_memory(spark, path, first) == 1
    fs, path_of = file_system(spark, path)
    for name, text in (("commit-2", b""), ("commit-3", b'{"folder": "da'), ("commit-x", b"")):
        stream = fs.create(path_of(f"{path}/{name}"), False)
        stream.write(bytearray(text))
        stream.close()
    assert ms.current_version(spark, path) == 1
    assert ms.read_memory(spark, path).points.count() == first.points.count()
    assert ms.remove_text(spark, path, "alpha", base=1) == 1
    assert ms.current_version(spark, path) == 4
    assert ms.read_memory(spark, path).points.count() == first.points.count() - 1
    with pytest.raises(ms.StaleMemory):
        ms.remove_text(spark, path, "beta", base=1)
    assert ms.remove_text(spark, path, "beta") == 1 and ms.current_version(spark, path) == 5
    ms.write_memory(spark, path, first)
    assert ms.vacuum(spark, path, keep=1) >= 1
    assert ms.current_version(spark, path) == 6 and ms.read_memory(spark, path).points.count() == first.points.count()


def test_a_slice_reads_its_own_files(spark):
    from itemnorm.plans.runs import RunStore, Slices

    c = catalogue(spark)
    plan = spark.createDataFrame([(1, 0), (2, 3)], "cluster_id long, part long")
    slices = Slices(c, plan)
    for part, cluster in ((0, 1), (3, 2)):
        held = slices.read(part)
        for name in ("clusters", "rows", "aliases", "members", "items"):
            got, want = getattr(held, name), getattr(c, name).where(F.col("cluster_id") == cluster)
            assert all(f"/part={part}/" in f for f in got.inputFiles())
            assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect()))
    store = RunStore(spark, scratch_path(spark, "run"))
    assert store.done().count() == 0
    save = store.save(c, spark.createDataFrame([(1, 0, "a", "a", {}, "ai")], "cluster_id long, item_pos long, item string, enriched_name string, values map<string,string>, source string"))
    c.clusters.write.parquet(f"{store.path}/save-dead/clusters")  # a save that died
    assert store.saves() == [save]
    assert {r["cluster_id"] for r in store.done().collect()} == {1, 2} and store.results()[0].clusters.count() == 2


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_quoted_line_breaks_are_read_by_many_tasks(spark, tmp_path, end):
    """Ranges of a few bytes: any of them may begin inside quotes, hold no line end, or begin at one."""
    cells = [(str(n), ["a,b", 'say "x"', f"one{end}two{end}{end}three", "", "x" * (n % 90), f'"{end}"'][n % 6], "end") for n in range(300)]
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n\r') else c
    lines = [",".join(quoted(c) for c in row) for row in [("id", f"no{end}te", "last"), *cells]]
    (tmp_path / "a.csv").write_text(end.join(lines[:150]) + end + end, newline="")
    (tmp_path / "b.csv").write_text(end.join([lines[0], *lines[150:]]), newline="")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = read_items(spark, str(tmp_path), multi_line=True)
        assert got.columns == ["id", f"no{end}te", "last"]
        found = {tuple(r) for r in got.collect()}
        tasks = spark.read.text(str(tmp_path)).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert tasks > 5
    plain = lambda c: c.replace("\r\n", "\n").strip()
    assert {tuple(plain(c) for c in r) for r in found} == {tuple(plain(c) for c in r) for r in cells}


def test_a_cache_is_read_by_bucket_and_forgets_days(spark):
    path = scratch_path(spark, "cache")
    now = F.current_timestamp()
    keys = spark.range(60).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("cache_key"), F.lit("{}").alias("response"))
    assert en.read_cache(spark, path).count() == 0
    en.append_cache(keys.withColumn("cached_at", now), path)
    en.append_cache(keys.withColumn("cached_at", now - F.expr("interval 45 days")), path)
    one = keys.where("cache_key = 'k7'").select("cache_key")
    own = one.select(F.concat(F.lit("b"), en.cache_bucket())).first()[0]
    # Files of other buckets and days are no Parquet any more: whoever opens one fails.
    days = sorted(os.path.basename(p) for p in glob.glob(f"{path}/day=*"))
    spoilt = [f for f in glob.glob(f"{path}/day=*/bucket=*/*.parquet") if f"/{days[1]}/bucket={own}/" not in f]
    for f in spoilt:
        with open(f, "wb") as out:
            out.write(b"not parquet")
        crc = os.path.join(os.path.dirname(f), f".{os.path.basename(f)}.crc")
        if os.path.exists(crc):
            os.remove(crc)
    assert len(days) == 2 and len(spoilt) > 10
    assert [r["cache_key"] for r in en.fresh_entries(en.read_cache(spark, path), one).collect()] == ["k7"]
    assert en.expire_cache(spark, path) == 1 and en.expire_cache(spark, path) == 0
    assert len(glob.glob(f"{path}/day=*")) == 1


def test_first_and_last_rows_at_a_position(spark):
    rows = [(k % 7 or None, "hot" if k % 3 == 0 else f"b{k % 50}", k, {"n": str(k)}) for k in range(600)]
    df = spark.createDataFrame(rows, "cluster_id int, brand string, pos bigint, attributes map<string, string>")
    plain = df.withColumn("attributes", F.map_entries("attributes"))
    for given in (plain, plain.limit(0)):
        for keys in (["cluster_id"], ["brand"], ["cluster_id", "brand"]):
            for at, per in ((first_at, first_per_key), (last_at, last_per_key)):
                got, want = at(given, keys, "pos"), per(given, keys, ["pos"])
                assert got.columns == want.columns
                assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    plan = first_at(df, ["cluster_id"], "pos")._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_quoted_texts_are_written_by_many_tasks(spark, tmp_path, monkeypatch):
    """A table of several files is not pulled through one task on its way into delimited files."""
    from itemnorm.queries import tables

    rows = [(n, f'line {n}\n"quoted", then\nmore ' + "x" * 50, "s") for n in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    files, read = [], tables.read_items

    def counted(spark, path, **how):
        files.extend(p for p in os.listdir(path) if p.endswith(".csv"))
        return read(spark, path, **how)

    monkeypatch.setattr(tables, "read_items", counted)
    got = {r["doc_id"]: r["text_md5"] for r in tables.src1_multi(spark, str(tmp_path)).collect()}
    assert got == {str(n): hashlib.md5(t.encode()).hexdigest() for n, t, _ in rows}
    assert len(files) > 1


def test_slices_of_a_run_are_in_work_side_by_side(spark, monkeypatch):
    import threading

    from itemnorm.plans import runs
    from itemnorm.queries.runs import c1_sliced

    monkeypatch.setattr(runs, "SLICES_AT_ONCE", 3, raising=False)
    now, most, lock, plain = [0], [0], threading.Lock(), runs.normalize

    def counted(*args, **how):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        try:
            return plain(*args, **how)
        finally:
            with lock:
                now[0] -= 1

    monkeypatch.setattr(runs, "normalize", counted)
    assert c1_sliced(spark, "/root/testdata/sf0.01").select("save_no").distinct().count() == 4
    assert 2 <= most[0] <= 3


def test_small_slices_share_their_jobs_and_are_saves_by_themselves(spark, monkeypatch):
    from itemnorm.plans import runs
    from itemnorm.queries.runs import c1_sliced

    calls, plain = [], runs.normalize
    monkeypatch.setattr(runs, "SLICES_AT_ONCE", 1, raising=False)
    monkeypatch.setattr(runs, "normalize", lambda *args, **how: calls.append(1) or plain(*args, **how))
    assert c1_sliced(spark, "/root/testdata/sf0.01").select("save_no").distinct().count() == 4
    assert len(calls) == 1
    assert runs.bundled([(n, 10) for n in range(20)]) == [list(range(8)), list(range(8, 16)), list(range(16, 20))]
    assert runs.bundled([(0, 10), (2, runs.BUNDLE_ITEMS), (3, 1), (4, 1)]) == [[0], [2], [3, 4]]


def test_a_slice_written_with_others_counts_by_its_own_done_file(spark):
    from itemnorm.plans.runs import RunStore

    c, store = catalogue(spark), RunStore(spark, scratch_path(spark, "run"))
    plan = spark.createDataFrame([(1, 0), (2, 3), (9, 4)], "cluster_id long, part long")
    lines = [(n, 0, "a", "a", {}, "ai") for n in (1, 2)]
    normalized = spark.createDataFrame(lines, "cluster_id long, item_pos long, item string, enriched_name string, values map<string,string>, source string")
    saves = store.save_slices(c, normalized, plan, [0, 3, 4])  # nothing is left of cluster 9
    assert store.saves() == sorted(saves) and len(set(saves)) == 3
    assert {r["cluster_id"]: r["save_id"] for r in store.done().collect()} == {1: saves[0], 2: saves[1]}
    os.remove(f"{store.path}/done-{saves[1]}")  # as if the run had died before this one
    held, items = store.results()
    assert [r["cluster_id"] for r in held.clusters.collect()] == [1] and [r["cluster_id"] for r in items.collect()] == [1]
    assert held.rows.columns == c.rows.columns
    assert {r["cluster_id"] for r in store.pending(c.clusters).collect()} == {2}


def test_questions_are_dealt_in_bounded_parts_and_attempts_do_not_nest(spark, monkeypatch):
    monkeypatch.setattr(en, "QUESTIONS_PER_TASK", 50, raising=False)
    good, plans, largest = en.pattern_extraction({"a": r"(\d+)"}), [], []

    def provider(requests):
        plans.append(requests._jdf.queryExecution().optimizedPlan().toString())
        largest.append(requests.select("request_id").groupBy(F.spark_partition_id()).count().agg(F.max("count")).head()[0])
        late = F.col("items")[0].endswith("7") & (F.col("attempt") < 3)
        late = requests.select("request_id", late.alias("late"))
        return good(requests).join(late, "request_id").select("request_id", F.when(~F.col("late"), F.col("response")).alias("response"))

    # Every question is there twice, in two clusters.
    items = spark.range(1000).select((F.col("id") % 2).alias("cluster_id"), F.col("id").alias("pos"), F.concat(F.lit("i"), F.floor(F.col("id") / 2)).alias("item"), F.array(F.lit("a")).alias("attributes"))
    values, rejected, answers = en.extract_values(items, provider, size=1)
    assert {(r["cluster_id"], r["item"]): r["values"]["a"] for r in values.collect()} == {(c, f"i{n}"): str(n) for c in (0, 1) for n in range(500)}
    assert answers.complete and rejected.isEmpty() and answers.cache.count() == 500
    assert len(plans) == 3 and max(largest) <= 100
    assert not any("Join" in p or "Aggregate" in p for p in plans)
