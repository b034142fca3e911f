"""Whole runs: clusterize, normalise, rededupe, checkpoints."""

from pyspark.sql import Window, functions as F

from itemnorm.operators.collapse import named_entries
from itemnorm.operators.enrich import frequency_profile, pattern_extraction, python_provider
from itemnorm.operators.matching import match_memory
from itemnorm.plans.clusterize import clusterize
from itemnorm.plans.normalize import normalize, normalize_input, rededupe, with_attribute_mode
from itemnorm.plans.runs import RunStore, completed_clusters, normalize_run, only_clusters, run_summary
from itemnorm.queries.enrichment import PATTERNS, misprofiled, stubborn
from itemnorm.queries.inputs import FINISHED, GROUPED, PARTS, catalogue, digest_embedder, digest_vector, flat, known_first, memory, parts, sql_item_id
from itemnorm.queries.matching import _KEYS as KEYS
from itemnorm.queries.registry import query
from itemnorm.session import cut_lineage, scratch_path

ROW = ["cluster_id", "row_pos"]


def _run_items(spark, d):
    """Items memory knows by alias, and the benchmark texts, which are new to it."""
    from itemnorm.queries.inputs import table

    p = parts(spark, d).select(F.col("pos").alias("item_idx"), "item")
    top = p.agg(F.max("item_idx")).head()[0]
    return p.unionByName(table(spark, d, "benchmark").select((F.col("item_id") + top + 1).alias("item_idx"), F.col("text").alias("item")))


_PIP1 = f"""WITH {GROUPED}, {KEYS}, t AS (SELECT trim(text, e' \\n\\t\\r') AS item, min(item_id) AS first FROM benchmark GROUP BY ALL),
    w AS (SELECT item, unnest(string_split(lower(trim(regexp_replace(item, '\\s+', ' ', 'g'))), ' ')) AS w FROM t), c AS (SELECT item, w, count(*) AS n FROM w GROUP BY ALL)
    SELECT g.brand AS name, 'memory' AS source, count(DISTINCT g.row_pos) AS n_rows, 'type,size,price' AS attributes
      FROM parts p JOIN keys k ON lower(p.item) = k.key JOIN grouped g ON {sql_item_id('g.enriched_name')} = k.item_id GROUP BY g.brand
    UNION ALL SELECT arg_min(w, (-n, w)), 'ai', (SELECT count(*) FROM benchmark b WHERE trim(b.text, e' \\n\\t\\r') = c.item), 'base' FROM c GROUP BY item"""


@query("pip1_clusterize", _PIP1)
def pip1(spark, d):
    """Items that memory knows by alias, and texts it does not know, each of which is a cluster of its copies."""
    mem = memory(spark, d)
    mem = mem.with_(points=mem.points.withColumn("vec_local", digest_vector(F.col("text")))).stored()
    out = clusterize(_run_items(spark, d), mem, ["base"], local=digest_embedder, profiler=frequency_profile(PATTERNS))
    n = out.catalogue.rows.groupBy("cluster_id").agg(F.count("*").alias("n_rows"))
    return out.catalogue.clusters.join(n, "cluster_id").select("name", "source", "n_rows", F.array_join("attributes", ",").alias("attributes"))


@query(
    "pip1_failed_group",
    f"""WITH {GROUPED}, {KEYS}, hit AS (SELECT p.pos, p.item, g.brand FROM parts p JOIN keys k ON lower(p.item) = k.key JOIN grouped g ON {sql_item_id('g.enriched_name')} = k.item_id),
    named AS (SELECT pos AS item_idx, item, brand AS grp, true AS known FROM hit UNION ALL SELECT item_id + 1 + (SELECT max(pos) FROM parts), text, trim(text, e' \n\t\r'), false FROM benchmark),
    grps AS (SELECT grp, known, min(item_idx) AS cluster_id, count(*) AS items FROM named GROUP BY ALL),
    b AS (SELECT g.cluster_id, item, (row_number() OVER (PARTITION BY g.cluster_id ORDER BY item_idx) - 1) // 18 AS batch FROM named n JOIN grps g ON n.grp = g.grp AND n.known = g.known),
    bad AS (SELECT cluster_id, count(DISTINCT batch) AS batches FROM b WHERE contains(item, ' promo 7') OR contains(item, 'ae') GROUP BY cluster_id)
    SELECT g.cluster_id, g.known, g.items, CASE WHEN d.batches IS NULL THEN 'catalogue' ELSE 'failed' END AS listed, coalesce(d.batches, 0) AS batches FROM grps g LEFT JOIN bad d USING (cluster_id)""",
)
def pip1_failed(spark, d):
    """Known and new groups of which some never get a valid profile: those are not in the catalogue, but listed."""
    mem = memory(spark, d)
    mem = mem.with_(points=mem.points.withColumn("vec_local", digest_vector(F.col("text")))).stored()
    wrong = misprofiled("ae")

    def profiler(requests):
        promo = requests.select("request_id", F.exists("items", lambda i: i.contains(" promo 7")).alias("promo"))
        return wrong(requests).join(promo, "request_id").select("request_id", F.when(~F.col("promo"), F.col("response")).alias("response"))

    out = clusterize(_run_items(spark, d), mem, ["base"], local=digest_embedder, profiler=profiler)
    firsts = out.known.groupBy("cluster_name").agg(F.min("item_idx").alias("cluster_id"), F.count("*").alias("items"))
    sizes = firsts.select("cluster_id", F.lit(True).alias("known"), "items").unionByName(
        out.groups.groupBy("cluster_id").agg(F.count("*").alias("items")).withColumn("known", F.lit(False))
    )
    there = out.catalogue.clusters.select("cluster_id").join(sizes, "cluster_id").withColumns({"listed": F.lit("catalogue"), "batches": F.lit(0).cast("bigint")})
    return there.unionByName(out.failed.withColumn("listed", F.lit("failed")).drop("error"))


def _prepared(spark, d):
    """Working set with attributes that the patterns can find and a template that tells names apart."""
    c = catalogue(spark, d)
    clusters = c.clusters.withColumns({"attributes": F.array(F.lit("type"), F.lit("size")), "enriched_name_template": F.lit("{type} {size}")})
    values = F.create_map(F.lit("type"), F.when(F.col("source") == "memory", F.col("values")["type"]).otherwise(F.lit("")))
    return c.with_(clusters=clusters, members=c.members.withColumn("values", values))


_ITEM = """items AS (SELECT cluster_id, item, arg_max(source, (row_pos, member_pos)) AS source, arg_min(type || ' ' || size || ' мм', (row_pos, member_pos)) AS name, min(type) AS type, min(size) AS size, min(name) AS short FROM (SELECT m.*, g.name FROM members m JOIN grouped g USING (cluster_id, row_pos)) GROUP BY ALL)"""


@query("pip2_normalize_items", f"WITH {GROUPED}, {_ITEM} SELECT cluster_id, item, name AS enriched_name, 'size=' || size || ' мм|type=' || type AS flat_values, source FROM items")
def pip2(spark, d):
    out = normalize(_prepared(spark, d), provider=pattern_extraction(PATTERNS), embedder=digest_embedder, limit=0.000001)
    return out.items.select("cluster_id", "item", "enriched_name", flat().alias("flat_values"), "source")


@query("pip2_normalize_rows", f"WITH {GROUPED}, {_ITEM} SELECT cluster_id, name AS enriched_name, count(*) AS n_aliases, 'size=' || min(size) || ' мм|type=' || min(type) AS flat_values FROM items GROUP BY cluster_id, name")
def pip2_rows(spark, d):
    out = normalize(_prepared(spark, d), provider=pattern_extraction(PATTERNS), embedder=digest_embedder, limit=0.000001).collapsed
    n = out.aliases.groupBy(*ROW).agg(F.count("*").alias("n_aliases"))
    return out.rows.join(n, ROW).select("cluster_id", "enriched_name", "n_aliases", flat().alias("flat_values"))


@query(
    "pip3_normalize_input",
    f"WITH {GROUPED}, i AS (SELECT cluster_id, item, min((row_pos, member_pos)) AS place, arg_max({{'s': source, 'p': price}}, (row_pos, member_pos)) AS last FROM members GROUP BY ALL) SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY place) - 1 AS item_pos, item, last.s AS source, last.p AS price FROM i",
)
def pip3(spark, d):
    return normalize_input(catalogue(spark, d)).select("cluster_id", "item_pos", "item", "source", F.col("values")["price"].alias("price"))


@query(
    "pip4_attribute_mode",
    f"WITH {GROUPED}, i AS (SELECT cluster_id, item FROM members GROUP BY ALL) SELECT cluster_id, item, m.mode, CASE m.mode WHEN 'all' THEN 'ai' ELSE 'memory' END AS source, CASE m.mode WHEN 'all' THEN 0 ELSE 3 END AS n_values FROM i, (VALUES ('all'), ('missing')) m(mode)",
)
def pip4(spark, d):
    inputs = normalize_input(catalogue(spark, d))
    of = lambda mode: with_attribute_mode(inputs, mode).select("cluster_id", "item", F.lit(mode).alias("mode"), "source", F.size("values").alias("n_values"))
    return of("all").unionByName(of("missing"))


@query("pip5_row_entries", f"WITH {GROUPED} SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY row_pos, member_pos) - 1 AS pos, item, type || ' ' || size AS enriched_name, source FROM members")
def pip5_entries(spark, d):
    return named_entries(catalogue(spark, d)).select("cluster_id", "pos", "item", "enriched_name", "source")


@query("pip5_rededupe", f"WITH {GROUPED} SELECT cluster_id, type || ' ' || size AS enriched_name, count(*) AS n_members, 'size=' || size || '|type=' || type AS flat_values FROM members GROUP BY cluster_id, type, size")
def pip5(spark, d):
    out = rededupe(catalogue(spark, d), embedder=digest_embedder, limit=0.000001)
    n = out.members.groupBy(*ROW).agg(F.count("*").alias("n_members"))
    return out.rows.join(n, ROW).select("cluster_id", "enriched_name", "n_members", F.concat(F.lit("size="), F.col("values")["size"], F.lit("|type="), F.col("values")["type"]).alias("flat_values"))


def _half_done(spark, d):
    """A run that took the clusters starting with a known item first, and stopped after them."""
    c = _prepared(spark, d)
    store = RunStore(spark, scratch_path(spark, "run"))
    first = only_clusters(c, known_first(parts(spark, d)))
    out = normalize(first, provider=pattern_extraction(PATTERNS), embedder=digest_embedder, limit=0.000001)
    store.save(out.collapsed, out.items)
    return c, store


@query("c1_checkpoint", f"WITH {GROUPED}, {FINISHED}, {_ITEM} SELECT cluster_id, item, name AS enriched_name FROM items WHERE cluster_id IN (FROM finished)")
def c1(spark, d):
    _, store = _half_done(spark, d)
    return store.results()[1].select("cluster_id", "item", "enriched_name")


@query("c2_resume", f"WITH {GROUPED}, {_ITEM} SELECT cluster_id, item, name AS enriched_name FROM items")
def c2(spark, d):
    c, store = _half_done(spark, d)
    rest = normalize(only_clusters(c, store.pending(c.clusters)), provider=pattern_extraction(PATTERNS), embedder=digest_embedder, limit=0.000001)
    store.save(rest.collapsed, rest.items)
    return store.results()[1].select("cluster_id", "item", "enriched_name")


@query(
    "c1_sliced_run",
    f"""WITH {GROUPED}, {_ITEM}, n AS (SELECT cluster_id, count(*) AS n FROM items GROUP BY cluster_id),
    s AS (SELECT cluster_id, (sum(n) OVER (ORDER BY cluster_id) - n) // 600 AS slice FROM n)
    SELECT cluster_id, item, name AS enriched_name, CAST(dense_rank() OVER (ORDER BY slice) AS INTEGER) AS save_no FROM items JOIN s USING (cluster_id)""",
)
def c1_sliced(spark, d):
    """A run in slices of about 600 items: one save per slice, each holding its own clusters."""
    c, store = _prepared(spark, d), RunStore(spark, scratch_path(spark, "run"))
    normalize_run(c, store, slice_items=600, provider=pattern_extraction(PATTERNS), embedder=digest_embedder, limit=0.000001)
    firsts = store.done().groupBy("save_id").agg(F.min("cluster_id").alias("first"))
    numbered = firsts.select("save_id", F.rank().over(Window.orderBy("first")).alias("save_no"))
    return store.results()[1].join(store.done(), "cluster_id").join(numbered, "save_id").select("cluster_id", "item", "enriched_name", "save_no")


_SPOILT = "spoilt AS (SELECT cluster_id FROM parts GROUP BY cluster_id HAVING bool_or(contains(item, ' promo 7')))"
_HOW = {"embedder": digest_embedder, "limit": 0.000001}


@query("c1_failed_cluster", f"WITH {GROUPED}, {_SPOILT}, {_ITEM} SELECT cluster_id, item, name AS enriched_name FROM items WHERE cluster_id NOT IN (FROM spoilt)")
def c1_failed(spark, d):
    """Clusters with a batch that is never answered as asked have no result and are not done."""
    c, store = _prepared(spark, d).stored("clusters", "members", "rows", "items"), RunStore(spark, scratch_path(spark, "run"))
    normalize_run(c, store, slice_items=500, provider=stubborn(" promo 7", 99), attempts=2, **_HOW)
    return store.results()[1].join(store.done().select("cluster_id"), "cluster_id", "left_semi").select("cluster_id", "item", "enriched_name")


@query("c2_resume_after_failure", f"WITH {GROUPED}, {_SPOILT}, {_ITEM} SELECT cluster_id, item, name AS enriched_name, cluster_id IN (FROM spoilt) AS second_run FROM items")
def c2_after_failure(spark, d):
    c, store = _prepared(spark, d).stored("clusters", "members", "rows", "items"), RunStore(spark, scratch_path(spark, "run"))
    again = cut_lineage(normalize_run(c, store, provider=stubborn(" promo 7", 99), attempts=1, **_HOW).select("cluster_id", F.lit(True).alias("second_run")))
    normalize_run(c, store, provider=pattern_extraction(PATTERNS), **_HOW)
    return store.results()[1].join(again, "cluster_id", "left").select("cluster_id", "item", "enriched_name", F.coalesce("second_run", F.lit(False)).alias("second_run"))


def _raising(words):
    """Provider that raises where an item holds one of the words: for good, or in passing."""
    def load():
        import json
        import re

        def ask(items, attributes, prompt):
            for word, error in words:
                if any(word in i for i in items):
                    raise error(f"{word.strip()} is refused")
            rules = {"type": r" (\w+) \d+ mm", "size": r"(\d+ mm)"}
            return json.dumps({"normalized": [{"item": i, "values": {a: re.search(rules[a], i).group(1) for a in attributes}} for i in items]})

        return ask

    return python_provider(load)


@query(
    "enr2_raising_provider",
    f"""WITH {GROUPED}, {_ITEM}, f AS (SELECT cluster_id, bool_or(contains(item, ' promo 7')) AS final, bool_or(contains(item, ' economy 9 ')) AS passing FROM items GROUP BY cluster_id)
    SELECT i.cluster_id, i.item, CASE WHEN final OR passing THEN NULL ELSE i.name END AS enriched_name, final OR passing AS pending FROM items i JOIN f USING (cluster_id)""",
)
def enr2_raising(spark, d):
    """A model that raises on some items: their clusters stay pending, all others are finished and saved."""
    c, store = _prepared(spark, d).stored("clusters", "members", "rows", "items"), RunStore(spark, scratch_path(spark, "run"))
    provider = _raising([(" promo 7", PermissionError), (" economy 9 ", TimeoutError)])
    waiting = cut_lineage(normalize_run(c, store, slice_items=500, provider=provider, attempts=2, **_HOW).select("cluster_id", F.lit(True).alias("pending")))
    every = normalize_input(c).select("cluster_id", "item")
    done = store.results()[1].select("cluster_id", "item", "enriched_name")
    return every.join(done, ["cluster_id", "item"], "left").join(waiting, "cluster_id", "left").select("cluster_id", "item", "enriched_name", F.coalesce("pending", F.lit(False)).alias("pending"))


@query("c3_restart", f"WITH {PARTS} SELECT DISTINCT cluster_id FROM parts")
def c3(spark, d):
    c, store = _half_done(spark, d)
    return store.restart().pending(c.clusters).select("cluster_id")


@query("c4_completed_clusters", f"WITH {PARTS} SELECT DISTINCT cluster_id FROM parts")
def c4(spark, d):
    p = parts(spark, d)
    claimed = p.select(F.col("cluster_id").cast("string")).unionByName(p.select(F.col("name").alias("cluster_id"))).unionByName(p.select((-1 - F.col("pos")).cast("string").alias("cluster_id")))
    return completed_clusters(claimed, catalogue(spark, d).clusters)


@query("jn10_resume_anti_join", f"WITH {PARTS}, {FINISHED} SELECT DISTINCT cluster_id FROM parts WHERE cluster_id NOT IN (FROM finished)")
def jn10(spark, d):
    c, store = _half_done(spark, d)
    return store.pending(c.clusters).select("cluster_id")


@query(
    "agg10_run_summary",
    f"""WITH {GROUPED}, {FINISHED}, i AS (SELECT m.cluster_id, f.cluster_id AS done FROM (SELECT DISTINCT cluster_id, item FROM members) m LEFT JOIN finished f ON f.cluster_id = m.cluster_id)
    SELECT count(*) AS expected_count, count(done) AS actual_count, count(*) - count(done) AS remaining_items_count, count(DISTINCT done) AS completed_clusters, true AS is_partial FROM i""",
)
def agg10(spark, d):
    c, store = _half_done(spark, d)
    return run_summary(normalize_input(c), store.results()[1], c.clusters, store.done())


@query(
    "m1_clean_catalogue",
    f"""WITH {PARTS}, named AS (SELECT pos, brand || ' ' || type || ' ' || name AS enriched, size || ' мм' AS size, price FROM parts),
    s AS (SELECT enriched, string_agg(size, '; ' ORDER BY p) AS sizes FROM (SELECT enriched, size, min(pos) AS p FROM named GROUP BY ALL) GROUP BY enriched)
    SELECT n.enriched, s.sizes, arg_min(n.price, n.pos) AS price, count(*) AS n_items FROM named n JOIN s USING (enriched) GROUP BY n.enriched, s.sizes""",
)
def m1(spark, d):
    """Flagship: standardise, name from a template, group equal names, merge their values."""
    from itemnorm.functions.text import empty_map, render_template, standardize_map
    from itemnorm.operators.merge_values import fold_groups

    p = parts(spark, d)
    values = F.create_map(F.lit("size"), F.concat("size", F.lit(" mm")), F.lit("price"), "price", F.lit("brand"), "brand", F.lit("type"), "type", F.lit("name"), "name")
    named = cut_lineage(
        p.select("pos", standardize_map(values).alias("values")).withColumn("enriched", render_template(F.lit("{brand} {type} {name}"), "values"))
    )
    ids = named.groupBy("enriched").agg(F.min("pos").alias("cluster_id"))
    entries = named.join(ids, "enriched").select("cluster_id", F.lit(0).cast("bigint").alias("row_pos"), "pos", "values", "enriched")
    clusters = entries.groupBy("cluster_id").agg(F.first("enriched").alias("enriched"), F.count("*").alias("n_items")).withColumns(
        {"attribute_merge": F.create_map(F.lit("size"), F.lit("accumulative")), "attribute_merge_separators": empty_map()}
    )
    folded = fold_groups(entries.drop("enriched"), clusters, ROW, "pos")
    return folded.join(clusters, "cluster_id").select("enriched", F.col("values")["size"].alias("sizes"), F.col("values")["price"].alias("price"), "n_items")
