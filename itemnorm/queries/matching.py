"""Memory: scans, parsing, stats, matching, and writes."""

from pyspark.sql import functions as F

from itemnorm.functions.text import item_id
from itemnorm.functions.vectors import hash_embedding
from itemnorm.model import Memory
from itemnorm.operators import matching as m
from itemnorm.operators.assemble import normalized_to_memory, name_map, rows_to_memory
from itemnorm.operators.embedding import embed_dual, hashing_embedder
from itemnorm.queries.inputs import GROUPED, PARTS, catalogue, digest_vector, flat, memory, parts, sql_embedding, sql_item_id, table
from itemnorm.queries.registry import query
from itemnorm.session import cut_lineage, scratch_path
from itemnorm.sources import memory_store as ms
from itemnorm.sources.commits import file_system

_ID = sql_item_id("enriched_name")


def _stored(spark, d, vectors=False):
    """Memory written to the shared folder and read back."""
    path = scratch_path(spark, "memory")
    ms.write_memory(spark, path, memory(spark, d, vectors))
    return ms.read_memory(spark, path)


@query("src4_rules_standardize", f"WITH {PARTS} SELECT pos, name || ' ' || type || ' ' || size || ' ММ' AS value FROM parts")
def src4(spark, d):
    """A rule file in the shared folder drives the standardiser."""
    from itemnorm.functions.text import standardize
    from itemnorm.sources.files import load_rules

    path = scratch_path(spark, "rules")
    spark.createDataFrame([('{"ММ": ["mm"]}',)], "value string").coalesce(1).write.text(path)
    return parts(spark, d).select("pos", standardize("item", load_rules(spark, f"{path}/part-*")).alias("value"))


@query("src5_memory_scan", f"WITH {GROUPED} SELECT {_ID} AS item_id, enriched_name AS text, brand AS cluster_name FROM grouped")
def src5(spark, d):
    return ms.memory_scan(_stored(spark, d)).select("item_id", "text", "cluster_name")


@query("src6_memory_load", f"WITH {GROUPED} SELECT g.enriched_name AS text, a.alias FROM grouped g JOIN aliases a ON g.row_pos = a.row_pos AND g.cluster_id = a.cluster_id WHERE brand = 'Brand#7'")
def src6(spark, d):
    one = ms.memory_load(_stored(spark, d), " Brand#7 ")
    return one.points.join(one.aliases, "item_id").select("text", "alias")


def _rough(spark, d) -> Memory:
    """Memory with holes: expensive first prices lose their attributes, one brand its name."""
    mem = memory(spark, d)
    holes = F.try_element_at("attributes", F.lit("type")) == "small"
    points = mem.points.withColumns(
        {
            "attributes": F.when(holes, F.create_map().cast("map<string,string>")).otherwise(F.col("attributes")),
            "cluster_name": F.when(F.col("cluster_name") == "Brand#3", F.lit(" ")).otherwise(F.col("cluster_name")),
        }
    )
    return Memory(points, mem.aliases.withColumn("alias", F.concat(F.lit("  "), "alias")))


_PARSED = "SELECT g.enriched_name AS text, CASE WHEN g.brand = 'Brand#3' THEN 'Память' ELSE g.brand END AS cluster_name, count(a.alias) AS aliases, min(a.alias) AS first_alias FROM grouped g JOIN aliases a ON g.cluster_id = a.cluster_id AND g.row_pos = a.row_pos {where} GROUP BY ALL"


def _summary(mem: Memory):
    a = mem.aliases.groupBy("item_id").agg(F.count("alias").alias("aliases"), F.min("alias").alias("first_alias"))
    return mem.points.join(a, "item_id").select("text", "cluster_name", "aliases", "first_alias")


@query("src7_parse_strict", f"WITH {GROUPED} {_PARSED.format(where=chr(87) + 'HERE g.type <> ' + repr('small'))}")
def src7(spark, d):
    return _summary(ms.parse_memory(_rough(spark, d), strict=True))


@query("src8_parse_loose", f"WITH {GROUPED} {_PARSED.format(where='')}")
def src8(spark, d):
    return _summary(ms.parse_memory(_rough(spark, d), strict=False))


@query("src9_memory_stats", f"WITH {GROUPED} SELECT count(*) AS points_count, 64 AS vector_size FROM grouped")
def src9(spark, d):
    return ms.memory_stats(memory(spark, d, vectors=True))


@query("agg13_cluster_names", f"WITH {GROUPED} SELECT DISTINCT CASE WHEN brand = 'Brand#3' THEN 'Память' ELSE brand END AS cluster_name FROM grouped")
def agg13(spark, d):
    return ms.cluster_names(_rough(spark, d)).orderBy("cluster_name")


def _wanted(spark, d):
    """Items to match: every part's item in another spelling, and every benchmark text."""
    p = parts(spark, d).select(F.col("pos").alias("item_idx"), F.upper(F.concat(F.lit("  "), F.replace("item", F.lit(" "), F.lit("  ")))).alias("item"))
    b = table(spark, d, "benchmark").select((-1 - F.col("item_id")).alias("item_idx"), F.col("text").alias("item"))
    return p.unionByName(b)


_ITEMS = "items AS (SELECT pos AS item_idx, item FROM parts UNION ALL SELECT -1 - item_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) FROM benchmark)"
_KEYS = f"""keys AS (SELECT key, arg_min(item_id, (item_id, place)) AS item_id FROM (SELECT lower(a.alias) AS key, {_ID} AS item_id, a.alias_pos AS place FROM aliases a JOIN grouped g ON a.cluster_id = g.cluster_id AND a.row_pos = g.row_pos
  UNION ALL SELECT lower(enriched_name), {_ID}, 4611686018427387904 FROM grouped) GROUP BY key)"""


@query("jn1_alias_match", f"WITH {GROUPED}, {_ITEMS}, {_KEYS} SELECT item_idx, item_id FROM items JOIN keys ON lower(item) = key")
def jn1(spark, d):
    return m.alias_match(_wanted(spark, d), memory(spark, d))


_KNN = f"""{sql_embedding('parts', 'item', 'i')}, {sql_embedding('grouped', 'enriched_name', 'p')},
sims AS (SELECT i.text AS item, p.text AS enriched_name, round(list_inner_product(i.vec, p.vec), 9) AS s FROM i_vec i, p_vec p),
top AS (SELECT item, arg_min({_ID}, (-s, {_ID})) AS item_id, max(s) AS s FROM sims WHERE s >= 0.7 GROUP BY item)"""


def _near(spark, d, mem: Memory, **how):
    mem = mem.stored()
    items = parts(spark, d).select(F.col("pos").alias("item_idx"), "item")
    near = m.match_texts(items, lambda rows: m.knn_match(rows.withColumn("vec_local", hash_embedding("item")), mem, "vec_local", 0.3, **how))
    return near.withColumn("score", F.round("score", 5))


@query("jn2_nearest_match", f"WITH {GROUPED}, {_KNN} SELECT pos AS item_idx, item_id, round(s, 5) AS score FROM parts JOIN top USING (item)")
def jn2(spark, d):
    return _near(spark, d, memory(spark, d, vectors=True))


@query("jn2_small_block", f"WITH {GROUPED}, {_KNN} SELECT pos AS item_idx, item_id, round(s, 5) AS score FROM parts JOIN top USING (item)")
def jn2_small(spark, d):
    """Cells and visits as on a large memory."""
    return _near(spark, d, memory(spark, d, vectors=True), block=64)


@query("jn2_indexed", f"WITH {GROUPED}, {_KNN} SELECT pos AS item_idx, item_id, round(s, 5) AS score FROM parts JOIN top USING (item)")
def jn2_indexed(spark, d):
    """Through the cell tree: groups of cells whose boxes can hold a match are visited, others are not."""
    return _near(spark, d, memory(spark, d, vectors=True), block=256)


@query(
    "jn2_bare_points",
    f"""WITH {GROUPED}, {_KNN}, best AS (SELECT item, arg_min(enriched_name, (-s, {_ID})) AS enriched_name, max(s) AS s FROM sims WHERE s >= 0.7 GROUP BY item)
    SELECT pos AS item_idx, {_ID.replace('enriched_name', 'b.enriched_name')} AS item_id, round(s, 5) AS score FROM parts JOIN best b USING (item) JOIN grouped g ON g.enriched_name = b.enriched_name WHERE g.type <> 'small'""",
)
def jn2_bare(spark, d):
    """Points without attributes are nearest for some items: those have no match, the runner-up is not tried."""
    mem = memory(spark, d, vectors=True)
    none = F.create_map().cast("map<string,string>")
    mem = mem.with_(points=mem.points.withColumn("attributes", F.when(F.col("attributes")["type"] == "small", none).otherwise(F.col("attributes"))))
    return _near(spark, d, mem)


def _mixed(spark, d):
    """Items known by alias (memory type) and others under a spelling memory has not seen."""
    p = parts(spark, d)
    return p.select(
        F.col("pos").alias("item_idx"), F.when(F.col("source") == "memory", F.col("item")).otherwise(F.concat_ws(" ", "name", "brand")).alias("item")
    )


_MIXED = f"""mixed AS (SELECT pos AS item_idx, CASE WHEN source = 'memory' THEN item ELSE name || ' ' || brand END AS item FROM parts),
{sql_embedding('mixed', 'item', 'i')}, {sql_embedding('grouped', 'enriched_name', 'p')},
sims AS (SELECT i.text AS item, p.text AS enriched_name, round(list_inner_product(i.vec, p.vec), 9) AS s FROM i_vec i, p_vec p),
top AS (SELECT item, arg_min({_ID}, (-s, {_ID})) AS near_id, max(s) AS s FROM sims WHERE s >= 0.85 GROUP BY item),
matched AS (SELECT item_idx, m.item, coalesce(k.item_id, t.near_id) AS item_id, CASE WHEN k.item_id IS NOT NULL THEN 'payload' ELSE 'local' END AS matched_by
  FROM mixed m LEFT JOIN keys k ON lower(m.item) = k.key LEFT JOIN top t ON t.item = m.item WHERE coalesce(k.item_id, t.near_id) IS NOT NULL)"""


def _matched(spark, d):
    mem = memory(spark, d, vectors=True).stored()
    items = _mixed(spark, d)
    return items, m.match_texts(items, lambda rows: m.match_memory(embed_dual(rows, "item"), mem)), mem


@query("jn3_match_cascade", f"WITH {GROUPED}, {_KEYS}, {_MIXED} SELECT item_idx, item_id, matched_by FROM matched")
def jn3(spark, d):
    return _matched(spark, d)[1].select("item_idx", "item_id", "matched_by")


@query(
    "jn3_alternative_vector",
    f"""WITH {GROUPED}, {_KEYS}, {_MIXED} SELECT x.item_idx, CASE WHEN k.matched_by = 'payload' THEN k.item_id WHEN p.type = 'promo' THEN {_ID.replace('enriched_name', "p.brand || ' ' || p.name")} ELSE k.item_id END AS item_id,
    CASE WHEN k.matched_by = 'payload' THEN 'payload' WHEN p.type = 'promo' THEN 'gemini' ELSE k.matched_by END AS matched_by
    FROM mixed x JOIN parts p ON p.pos = x.item_idx LEFT JOIN matched k ON k.item_idx = x.item_idx WHERE k.item_id IS NOT NULL OR p.type = 'promo'""",
)
def jn3_alternative(spark, d):
    """An alternative vector, held by promo parts only, beats the local one and yields to an alias."""
    mem = memory(spark, d, vectors=True)
    mem = mem.with_(points=mem.points.withColumn("vec_alt", digest_vector(F.col("text")))).stored()
    p = parts(spark, d).select(F.col("pos").alias("item_idx"), F.when(F.col("type") == "promo", F.concat_ws(" ", "brand", "name")).alias("alt"))
    vec_alt = F.when(F.col("alt").isNotNull(), digest_vector(F.col("alt")))
    found = m.match_texts(_mixed(spark, d).join(p, "item_idx"), lambda rows: m.match_memory(embed_dual(rows, "item").withColumn("vec_alt", vec_alt), mem), ["item", "alt"])
    return found.select("item_idx", "item_id", "matched_by")


@query(
    "jn4_known_unknown",
    f"""WITH {GROUPED}, {_KEYS}, {_MIXED} SELECT x.item_idx, CASE WHEN k.item_id IS NULL THEN x.item ELSE g.enriched_name END AS name, coalesce(g.brand, '') AS cluster_name
    FROM mixed x LEFT JOIN matched k ON k.item_idx = x.item_idx LEFT JOIN grouped g ON {_ID.replace('enriched_name', 'g.enriched_name')} = k.item_id""",
)
def jn4(spark, d):
    items, matches, mem = _matched(spark, d)
    matches = cut_lineage(matches)
    known = m.known_items(items, matches, mem).select("item_idx", F.col("enriched_name").alias("name"), "cluster_name")
    return known.unionByName(m.unknown_items(items, matches).select("item_idx", F.col("item").alias("name"), F.lit("").alias("cluster_name")))


def _fresh(spark, d):
    """What is saved on top of memory: one point per brand and type, and again every existing small point."""
    p = parts(spark, d)
    again = memory(spark, d).points.where(F.try_element_at("attributes", F.lit("type")) == "small")
    new = p.groupBy("brand", "type").agg(F.min("pos").alias("save_pos"), F.max("pos").alias("last"))
    point = new.select(
        "save_pos", F.concat_ws(" ", "brand", "type").alias("text"), F.create_map(F.lit("type"), "type").alias("attributes"), F.lit(" ").alias("cluster_name")
    ).unionByName(
        again.select(F.xxhash64("item_id").alias("save_pos"), F.upper("text").alias("text"), F.create_map(F.lit("type"), F.lit("new")).alias("attributes"), "cluster_name")
    )
    empty = F.create_map().cast("map<string,string>")
    none = F.lit(None).cast("array<double>")
    points = point.withColumns({"attribute_merge": empty, "attribute_merge_separators": empty, "vec_local": none, "vec_alt": none})
    return points, points.select("save_pos", F.lit(0).cast("bigint").alias("alias_pos"), F.col("text").alias("alias"), F.lit(None).cast("map<string,string>").alias("values"))


_UPSERT = f"""fresh AS (SELECT DISTINCT brand || ' ' || type AS text, type, 'Память' AS cluster_name FROM parts
  UNION ALL SELECT upper(enriched_name), 'new', brand FROM grouped WHERE type = 'small'),
upserted AS (SELECT lower(text) AS k, text, type, cluster_name FROM fresh UNION ALL
  SELECT lower(enriched_name), enriched_name, type, brand FROM grouped WHERE lower(enriched_name) NOT IN (SELECT lower(text) FROM fresh))"""


@query("snk1_memory_upsert", f"WITH {GROUPED}, {_UPSERT} SELECT {sql_item_id('text')} AS item_id, text, type, cluster_name FROM upserted")
def snk1(spark, d):
    path = scratch_path(spark, "memory")
    ms.write_memory(spark, path, memory(spark, d))
    ms.save_points(spark, path, *_fresh(spark, d))
    return ms.read_memory(spark, path).points.select("item_id", "text", F.try_element_at("attributes", F.lit("type")).alias("type"), "cluster_name")


@query("snk1_torn_commit", f"WITH {GROUPED}, {_UPSERT} SELECT {sql_item_id('text')} AS item_id, text, type, cluster_name, 3 AS version FROM upserted")
def snk1_torn(spark, d):
    """A commit file that was begun and never written is no version: readers pass it over, and a save goes on from the one before."""
    path = scratch_path(spark, "memory")
    ms.write_memory(spark, path, memory(spark, d))
    fs, path_of = file_system(spark, path)
    fs.create(path_of(f"{path}/commit-2"), False).close()
    version = ms.save_points(spark, path, *_fresh(spark, d), base=1)
    points = ms.read_memory(spark, path).points
    return points.select("item_id", "text", F.try_element_at("attributes", F.lit("type")).alias("type"), "cluster_name", F.lit(version).alias("version"))


@query(
    "snk2_replace_cluster",
    f"WITH {GROUPED}, {_UPSERT} SELECT text, cluster_name FROM upserted u WHERE NOT (cluster_name = 'Brand#5' AND NOT EXISTS (SELECT 1 FROM fresh f WHERE f.text = u.text))",
)
def snk2(spark, d):
    path = scratch_path(spark, "memory")
    ms.write_memory(spark, path, memory(spark, d))
    ms.save_points(spark, path, *_fresh(spark, d), replace_cluster=" Brand#5 ")
    return ms.read_memory(spark, path).points.select("text", "cluster_name")


@query(
    "snk3_rows_to_memory",
    f"""WITH {GROUPED}, last AS (SELECT cluster_id, row_pos, item, arg_max('price=' || price || '|size=' || size || '|type=' || type, member_pos) AS v FROM members GROUP BY ALL)
    SELECT g.enriched_name AS text, g.brand AS cluster_name, a.alias, l.v AS flat_values FROM grouped g JOIN aliases a ON a.cluster_id = g.cluster_id AND a.row_pos = g.row_pos
    JOIN last l ON l.cluster_id = a.cluster_id AND l.row_pos = a.row_pos AND l.item = a.alias""",
)
def snk3(spark, d):
    points, aliases = rows_to_memory(catalogue(spark, d))
    return points.join(aliases, ["cluster_id", "row_pos"]).select("text", "cluster_name", "alias", flat().alias("flat_values"))


@query(
    "snk4_normalized_to_memory",
    f"WITH {PARTS}, owner AS (SELECT item, max(cluster_id) AS cluster_id FROM parts GROUP BY item) SELECT pos AS norm_pos, p.item, upper(p.item) AS text, 'Brand#' || o.cluster_id AS cluster_name FROM parts p JOIN owner o ON o.item = p.item",
)
def snk4(spark, d):
    norm = parts(spark, d).select(F.col("pos").alias("norm_pos"), "item", F.upper("item").alias("enriched_name"), F.create_map("name", "type").alias("values"))
    return normalized_to_memory(norm, name_map(catalogue(spark, d))).select("norm_pos", "item", "text", "cluster_name")


@query("snk5_delete_cluster", f"WITH {GROUPED} SELECT enriched_name AS text, (SELECT count(*) FROM grouped WHERE brand = 'Brand#9') AS removed FROM grouped WHERE brand <> 'Brand#9'")
def snk5(spark, d):
    path = scratch_path(spark, "memory")
    ms.write_memory(spark, path, memory(spark, d))
    removed = ms.remove_cluster(spark, path, " Brand#9")
    return ms.read_memory(spark, path).points.select("text", F.lit(removed).cast("bigint").alias("removed"))


@query("snk6_delete_text", f"WITH {GROUPED} SELECT enriched_name AS text, (SELECT count(*) FROM grouped WHERE enriched_name = 'Brand#7 old rod') AS removed FROM grouped WHERE enriched_name <> 'Brand#7 old rod'")
def snk6(spark, d):
    path = scratch_path(spark, "memory")
    ms.write_memory(spark, path, memory(spark, d))
    removed = ms.remove_text(spark, path, "Brand#7 old rod ")
    return ms.read_memory(spark, path).points.select("text", F.lit(removed).cast("bigint").alias("removed"))


@query("snk7_clear_memory", f"WITH {GROUPED} SELECT count(*) AS before, 0::BIGINT AS after, count(*) > 0 AS existed FROM grouped")
def snk7(spark, d):
    path = scratch_path(spark, "memory")
    ms.write_memory(spark, path, memory(spark, d))
    before = ms.read_memory(spark, path).points.agg(F.count("*").alias("before"))
    existed = ms.clear_memory(spark, path)
    after = ms.read_memory(spark, path).points.agg(F.count("*").alias("after"))
    one = F.lit(1).alias("one")
    return before.select("*", one).join(after.select("*", one), "one").select("before", "after", F.lit(existed).alias("existed"))


@query(
    "snk8_reembed",
    f"WITH {GROUPED}, {sql_embedding('grouped', 'enriched_name')} SELECT {sql_item_id('text')} AS item_id, round(vec[1] + vec[17], 6) AS mark, (SELECT count(*) FROM grouped) AS migrated, 0::BIGINT AS skipped FROM e_vec",
)
def snk8(spark, d):
    renewed, counters = ms.memory_reembed(memory(spark, d), hashing_embedder(), hashing_embedder(32))
    marks = renewed.points.select("item_id", F.round(F.col("vec_local")[0] + F.col("vec_local")[16], 6).alias("mark"), F.lit(1).alias("one"))
    return marks.join(counters.select("migrated", "skipped", F.lit(1).alias("one")), "one").drop("one")
