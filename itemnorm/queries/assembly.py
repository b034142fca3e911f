"""Building, viewing and exporting clusters."""

from pyspark.sql import Window, functions as F

from itemnorm.functions.text import empty_map
from itemnorm.model import Catalogue
from itemnorm.operators import assemble as a
from itemnorm.operators import edits as ed
from itemnorm.operators.collapse import collapse_rows
from itemnorm.operators.merge_values import fold_groups, recompute_values
from itemnorm.queries.inputs import ATTRIBUTES, GROUPED, PARTS, catalogue, digest_vector, flat, memory, parts, sql_item_id, table, values_map
from itemnorm.queries.registry import query
from itemnorm.session import cut_lineage, scratch_path
from itemnorm.sources.files import export_lines, write_export, write_exports

ROW = ["cluster_id", "row_pos"]
_SIZES = "sizes AS (SELECT cluster_id, row_pos, string_agg(size, '; ' ORDER BY p) AS size FROM (SELECT cluster_id, row_pos, size, min(member_pos) AS p FROM members GROUP BY ALL) GROUP BY ALL)"


def known(spark, d):
    """Every part as a known item of the point of its brand and name."""
    mem = memory(spark, d)
    p = parts(spark, d)
    keyed = p.withColumn("text", F.concat_ws(" ", "brand", "name"))
    points = mem.points.select("item_id", "text", "attributes", "cluster_name", "attribute_merge", "attribute_merge_separators")
    joined = keyed.select(F.col("pos").alias("item_idx"), "item", "text").join(points, "text").withColumns(
        {"enriched_name": F.col("text"), "name_template": F.when(F.col("item_idx") > 10, F.concat(F.lit("{type} "), "cluster_name"))}
    )
    return joined, mem


@query(
    "agg3_group_value_merge",
    f"WITH {GROUPED}, {_SIZES} SELECT g.cluster_id, g.row_pos, 'price=' || g.price || '|size=' || s.size || '|type=' || g.type AS flat_values FROM grouped g JOIN sizes s ON g.cluster_id = s.cluster_id AND g.row_pos = s.row_pos",
)
def agg3(spark, d):
    c = catalogue(spark, d)
    return fold_groups(c.members, c.clusters, ROW, "member_pos").select(*ROW, flat().alias("flat_values"))


@query(
    "agg3_long_texts",
    """WITH t AS (SELECT lang, source, doc_id, trim(source || ', ' || lang) AS v FROM documents) SELECT lang, source, source || ', ' || lang AS merged FROM t GROUP BY lang, source""",
)
def agg3_long(spark, d):
    """Accumulative fold of one attribute over big groups with a found separator."""
    docs = table(spark, d, "documents")
    docs = docs.join(docs.groupBy("lang", "source").agg(F.min("doc_id").alias("cluster_id")), ["lang", "source"])
    members = docs.select("cluster_id", F.lit(0).cast("bigint").alias("row_pos"), F.col("doc_id").alias("member_pos"), F.create_map(F.lit("v"), F.concat_ws(",", "source", "lang")).alias("values"))
    clusters = docs.select("cluster_id", "lang", "source").distinct().withColumns(
        {"attribute_merge": F.create_map(F.lit("v"), F.lit("accumulative")), "attribute_merge_separators": empty_map()}
    )
    folded = fold_groups(members, clusters, ROW, "member_pos")
    return folded.join(clusters, "cluster_id").select("lang", "source", F.try_element_at("values", F.lit("v")).alias("merged"))


@query(
    "agg3_separator_changes",
    f"""WITH {PARTS}, r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY pos) AS n FROM parts),
    f AS (SELECT cluster_id, arg_min(size, n) AS first_size FROM r GROUP BY cluster_id), d AS (SELECT cluster_id, min(n) AS other FROM r JOIN f USING (cluster_id) WHERE size <> first_size GROUP BY cluster_id)
    SELECT cluster_id, string_agg(size || ' mm', '/' ORDER BY n) FILTER (n = 1 OR n >= other) AS merged FROM r LEFT JOIN d USING (cluster_id) GROUP BY cluster_id""",
)
def agg3_slash(spark, d):
    """A policy separator that joins but does not split: a value is dropped only where it equals the whole text so far."""
    p = parts(spark, d)
    members = p.select("cluster_id", F.lit(0).cast("bigint").alias("row_pos"), F.col("pos").alias("member_pos"), F.create_map(F.lit("v"), F.concat("size", F.lit(" mm"))).alias("values"))
    clusters = p.select("cluster_id").distinct().withColumns(
        {"attribute_merge": F.create_map(F.lit("v"), F.lit("accumulative")), "attribute_merge_separators": F.create_map(F.lit("v"), F.lit("/"))}
    )
    return fold_groups(members, clusters, ROW, "member_pos").select("cluster_id", F.try_element_at("values", F.lit("v")).alias("merged"))


@query(
    "agg3_hard_separator",
    f"""WITH {PARTS}, v AS (SELECT CASE WHEN pos % 3 = 0 THEN 0 ELSE cluster_id END AS cluster_id, pos,
      CASE CAST(size AS INT) % 4 WHEN 0 THEN 'a/b' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'a/b/a, b' END AS v FROM parts)
    SELECT cluster_id, list_reduce(list_prepend('', list(v ORDER BY pos)), lambda t, x: CASE WHEN len(list_filter(string_split(x, ', '), lambda p: p <> t)) = 0 THEN t
      ELSE CASE WHEN t = '' THEN '' ELSE t || '/' END || array_to_string(list_filter(string_split(x, ', '), lambda p: p <> t), '/') END) AS merged FROM v GROUP BY cluster_id""",
)
def agg3_hard(spark, d):
    """Parts that hold the separator they are joined with; one group has a third of all rows."""
    p = parts(spark, d).withColumn("cluster_id", F.when(F.col("pos") % 3 == 0, F.lit(0).cast("bigint")).otherwise(F.col("cluster_id")))
    value = F.expr("CASE CAST(size AS INT) % 4 WHEN 0 THEN 'a/b' WHEN 1 THEN 'a' WHEN 2 THEN 'b' ELSE 'a/b/a, b' END")
    members = p.select("cluster_id", F.lit(0).cast("bigint").alias("row_pos"), F.col("pos").alias("member_pos"), F.create_map(F.lit("v"), value).alias("values"))
    clusters = p.select("cluster_id").distinct().withColumns(
        {"attribute_merge": F.create_map(F.lit("v"), F.lit("accumulative")), "attribute_merge_separators": F.create_map(F.lit("v"), F.lit("/"))}
    )
    return fold_groups(members, clusters, ROW, "member_pos").select("cluster_id", F.try_element_at("values", F.lit("v")).alias("merged"))


@query(
    "agg4_collapse_rows",
    f"""WITH {GROUPED}, {_SIZES} SELECT g.cluster_id, g.row_pos, g.enriched_name, (SELECT arg_min(alias, alias_pos) FROM aliases a WHERE a.cluster_id = g.cluster_id AND a.row_pos = g.row_pos) AS item,
    'price=' || g.price || '|size=' || s.size || '|type=' || g.type AS flat_values, g.source,
    (SELECT count(*) FROM aliases a WHERE a.cluster_id = g.cluster_id AND a.row_pos = g.row_pos) AS n_aliases, (SELECT count(*) FROM members m WHERE m.cluster_id = g.cluster_id AND m.row_pos = g.row_pos) AS n_members
    FROM grouped g JOIN sizes s ON g.cluster_id = s.cluster_id AND g.row_pos = s.row_pos""",
)
def agg4(spark, d):
    c = catalogue(spark, d)
    entries = cut_lineage(parts(spark, d).select(
        "cluster_id", "pos", "item", F.concat_ws(" ", "brand", "name").alias("enriched_name"), values_map(*ATTRIBUTES).alias("values"), "source",
        digest_vector(F.concat_ws(" ", "brand", "name")).alias("vec"),
    ))
    out = collapse_rows(entries, c.clusters, limit=0.000001)
    n_a = out.aliases.groupBy(*ROW).agg(F.count("*").alias("n_aliases"))
    n_m = out.members.groupBy(*ROW).agg(F.count("*").alias("n_members"))
    return out.rows.join(n_a, ROW).join(n_m, ROW).select(*ROW, "enriched_name", "item", flat().alias("flat_values"), "source", "n_aliases", "n_members")


_FIRST_ALIAS = "(SELECT arg_min(alias, alias_pos) FROM aliases a WHERE a.cluster_id = g.cluster_id AND a.row_pos = g.row_pos)"


@query(
    "agg5_known_to_clusters",
    f"""WITH {GROUPED}, heads AS (SELECT brand, min(pos) AS cluster_id, arg_min(CASE WHEN pos > 10 THEN '{{type}} ' || brand END, CASE WHEN pos > 10 THEN pos END) AS t FROM parts GROUP BY brand)
    SELECT h.cluster_id, h.brand AS name, 'type,size,price' AS attributes, h.t AS template, g.row_pos, g.enriched_name, {_FIRST_ALIAS} AS item, 'price=' || g.price || '|size=' || g.size || '|type=' || g.type AS flat_values,
    (SELECT count(*) FROM aliases a WHERE a.cluster_id = g.cluster_id AND a.row_pos = g.row_pos) AS n_members FROM grouped g JOIN heads h USING (brand)""",
)
def agg5(spark, d):
    k, mem = known(spark, d)
    out = a.known_to_clusters(k, mem, ["base"])
    n = out.members.groupBy(*ROW).agg(F.count("*").alias("n_members"))
    heads = out.clusters.select("cluster_id", "name", F.array_join("attributes", ",").alias("attributes"), F.col("enriched_name_template").alias("template"))
    return out.rows.join(n, ROW).join(heads, "cluster_id").select(
        "cluster_id", "name", "attributes", "template", "row_pos", "enriched_name", "item", flat().alias("flat_values"), "n_members"
    )


@query(
    "agg6_memory_to_clusters",
    f"""WITH {GROUPED} SELECT g.brand AS name, 'type,size,price' AS attributes, 'size=accumulative' AS modes, g.enriched_name, {_FIRST_ALIAS} AS item, 'price=' || g.price || '|size=' || g.size || '|type=' || g.type AS flat_values,
    (SELECT count(*) FROM aliases a WHERE a.cluster_id = g.cluster_id AND a.row_pos = g.row_pos) AS n_members FROM grouped g""",
)
def agg6(spark, d):
    out = a.memory_to_clusters(memory(spark, d), ["base"])
    n = out.members.groupBy(*ROW).agg(F.count("*").alias("n_members"))
    heads = out.clusters.select("cluster_id", "name", F.array_join("attributes", ",").alias("attributes"), flat("attribute_merge").alias("modes"))
    return out.rows.join(n, ROW).join(heads, "cluster_id").select("name", "attributes", "modes", "enriched_name", "item", flat().alias("flat_values"), "n_members")


def _new(spark, d):
    """Groups of names as new clusters, half of them profiled."""
    p = parts(spark, d)
    firsts = p.groupBy("name").agg(F.min("pos").alias("cluster_id"))
    groups = p.drop("cluster_id").join(firsts, "name").select(F.col("pos").alias("item_idx"), "item", "cluster_id")
    profiles = firsts.select(
        "cluster_id", F.when(F.startswith("name", F.lit("r")), F.lit("")).otherwise(F.upper("name")).alias("category"),
        F.array(F.lit("type")).alias("attributes"), F.lit("{type}").alias("name_template"),
    )
    return a.new_clusters(groups, profiles, ["base"])


@query(
    "agg7_default_clusters",
    f"""WITH {PARTS}, f AS (SELECT name, min(pos) AS cluster_id, count(*) AS n FROM parts GROUP BY name), o AS (SELECT *, row_number() OVER (ORDER BY cluster_id) AS i FROM f)
    SELECT cluster_id, CASE WHEN name LIKE 'r%' THEN 'Cluster ' || i ELSE upper(name) END AS name, 'ai' AS source, n FROM o
    UNION ALL SELECT min(pos), brand, 'memory', count(DISTINCT name) FROM parts GROUP BY brand""",
)
def agg7(spark, d):
    k, mem = known(spark, d)
    both = a.union_catalogues(_new(spark, d), a.known_to_clusters(k, mem, []))
    n = both.rows.groupBy("cluster_id", "source").agg(F.count("*").alias("n"))
    return both.clusters.join(n, ["cluster_id", "source"]).select("cluster_id", "name", "source", "n")


@query("agg11_source_inference", f"WITH {GROUPED} SELECT cluster_id, CASE WHEN count(DISTINCT source) > 1 THEN 'manual' ELSE min(source) END AS source FROM grouped GROUP BY cluster_id")
def agg11(spark, d):
    c = catalogue(spark, d)
    return a.inferred_sources(c.clusters, c.rows)


@query(
    "agg12_attribute_union",
    f"""WITH {GROUPED}, met AS (SELECT cluster_id, type, min(row_pos) AS p FROM grouped GROUP BY ALL) SELECT cluster_id, 'type,size,price,' || string_agg(type, ',' ORDER BY p) AS attributes FROM met GROUP BY cluster_id""",
)
def agg12(spark, d):
    c = catalogue(spark, d)
    rows = c.rows.withColumn("values", F.map_concat("values", F.create_map(F.col("values")["type"], F.lit("x"))))
    full = a.complete_values(rows, a.attribute_union(c.clusters, rows))
    names = a.attribute_union(c.clusters, full)
    return names.select("cluster_id", F.array_join("attributes", ",").alias("attributes"))


@query(
    "agg14_priority_conflicts",
    f"""WITH {GROUPED}, v AS (SELECT cluster_id, row_pos, 'type' AS attr, type AS value, min(member_pos) AS place FROM members GROUP BY ALL UNION ALL SELECT cluster_id, row_pos, 'price', price, min(member_pos) FROM members GROUP BY ALL)
    SELECT * FROM v QUALIFY count(*) OVER (PARTITION BY cluster_id, row_pos, attr) > 1""",
)
def agg14(spark, d):
    return ed.priority_conflicts(catalogue(spark, d)).select(*ROW, "attr", "value", "place")


@query(
    "agg15_recompute_values",
    f"WITH {GROUPED}, {_SIZES} SELECT g.cluster_id, g.row_pos, 'price=' || g.price || '|size=' || s.size || '|type=' || g.type AS flat_values FROM grouped g JOIN sizes s ON g.cluster_id = s.cluster_id AND g.row_pos = s.row_pos",
)
def agg15(spark, d):
    c = catalogue(spark, d)
    stale = c.rows.withColumn("values", F.map_concat("values", F.create_map(F.lit("size"), F.lit("999"), F.lit("price"), F.lit("not held"))))
    return recompute_values(stale, c.members, c.clusters).select(*ROW, flat().alias("flat_values"))


@query("agg16_unsaved_clusters", f"WITH {GROUPED} SELECT DISTINCT cluster_id FROM grouped WHERE source = 'memory' AND name LIKE 'small%'")
def agg16(spark, d):
    saved = catalogue(spark, d)
    edited = saved.with_(
        rows=saved.rows.withColumn("deleted", (F.col("source") == "memory") & F.startswith("item", F.lit("small"))),
        clusters=saved.clusters.withColumn("attribute_merge", empty_map()),
    )
    return ed.unsaved_clusters(edited, ed.signatures(saved))


@query("agg17_memory_names", f"WITH {PARTS} SELECT DISTINCT item FROM parts")
def agg17(spark, d):
    k, mem = known(spark, d)
    return a.memory_names(k, mem)


def normalized(spark, d):
    """Fresh values of every item, the last part of a spelling wins."""
    return parts(spark, d).select(F.col("pos").alias("norm_pos"), "item", F.create_map(F.lit("price"), "price", F.lit("brand"), "brand").alias("values"))


_NORM = "norm AS (SELECT item, arg_max(price, pos) AS price, arg_max(brand, pos) AS brand FROM parts GROUP BY item)"
_OVER = f"""{_NORM}, over AS (SELECT a.cluster_id, a.row_pos, arg_max(n.price, a.alias_pos) AS price, arg_max(n.brand, a.alias_pos) AS brand FROM aliases a JOIN norm n ON n.item = a.alias GROUP BY ALL)"""


@query(
    "jn5_overlay_rows",
    f"WITH {GROUPED}, {_OVER} SELECT g.cluster_id, g.row_pos, 'brand=' || o.brand || '|price=' || o.price || '|size=' || g.size || '|type=' || g.type AS flat_values FROM grouped g JOIN over o ON o.cluster_id = g.cluster_id AND o.row_pos = g.row_pos",
)
def jn5(spark, d):
    return a.overlay_rows(catalogue(spark, d), normalized(spark, d)).select(*ROW, flat().alias("flat_values"))


def _plain(spark, d) -> Catalogue:
    """Clusters of single items without enriched names."""
    p = parts(spark, d)
    c = catalogue(spark, d)
    rows = p.where("source = 'memory'").select(
        "cluster_id", F.col("pos").alias("row_pos"), "item", F.lit("").alias("enriched_name"), F.create_map(F.lit("type"), "type").alias("values"), F.lit("?").alias("source"), F.lit(False).alias("deleted")
    )
    return c.with_(rows=rows, aliases=c.aliases.where("false"), members=c.members.where("false"), items=p.select("cluster_id", F.col("pos").alias("item_pos"), "item"))


@query(
    "jn6_plain_rows",
    f"""WITH {PARTS}, {_NORM}, stored AS (SELECT cluster_id, item, arg_max(type, pos) AS type FROM parts WHERE source = 'memory' GROUP BY ALL), mem AS (SELECT DISTINCT item FROM parts WHERE name LIKE 'small%')
    SELECT p.cluster_id, p.pos AS item_pos, 'brand=' || n.brand || '|price=' || n.price || CASE WHEN s.type IS NULL THEN '' ELSE '|type=' || s.type END AS flat_values, CASE WHEN m.item IS NULL THEN 'ai' ELSE 'memory' END AS source
    FROM parts p JOIN norm n ON n.item = p.item LEFT JOIN stored s ON s.cluster_id = p.cluster_id AND s.item = p.item LEFT JOIN mem m ON m.item = p.item""",
)
def jn6(spark, d):
    mem = parts(spark, d).where(F.startswith("name", F.lit("small"))).select("item").distinct()
    return a.plain_rows(_plain(spark, d), normalized(spark, d), mem).select("cluster_id", "item_pos", flat().alias("flat_values"), "source")


@query(
    "jn7_apply_collapsed",
    f"WITH {GROUPED} SELECT cluster_id, row_pos, CASE WHEN cluster_id IN (SELECT cluster_id FROM grouped WHERE name = 'red plate') THEN upper(enriched_name) ELSE enriched_name END AS enriched_name FROM grouped",
)
def jn7(spark, d):
    c = catalogue(spark, d)
    done = c.rows.where("item = 'red plate'").select("cluster_id").distinct()
    part = {p: getattr(c, p).join(done, "cluster_id", "left_semi") for p in ("clusters", "rows", "aliases", "members", "items")}
    fresh = Catalogue(**part).with_(rows=part["rows"].withColumn("enriched_name", F.upper("enriched_name")))
    return a.apply_collapsed(c, fresh).rows.select(*ROW, "enriched_name")


@query(
    "jn8_name_map",
    f"WITH {GROUPED}, s AS (SELECT enriched_name AS item, cluster_id FROM grouped UNION ALL SELECT name, cluster_id FROM grouped UNION ALL SELECT alias, cluster_id FROM aliases) SELECT item, 'Brand#' || max(cluster_id) AS cluster_name FROM s GROUP BY item",
)
def jn8(spark, d):
    return a.name_map(catalogue(spark, d))


@query(
    "jn12_load_memory_cluster",
    f"WITH {GROUPED} SELECT cluster_id, brand AS name, count(*) AS n, CASE WHEN cluster_id <= 5 THEN 'memory' ELSE '' END AS source FROM grouped GROUP BY ALL",
)
def jn12(spark, d):
    c = catalogue(spark, d)
    names = [f"Brand#{i}" for i in range(1, 6)]
    mem = memory(spark, d)
    loaded = a.memory_to_clusters(mem.with_(points=mem.points.where(F.col("cluster_name").isin(names))), [])
    out = a.load_into(c, loaded)
    n = out.rows.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return out.clusters.join(n, "cluster_id").select("cluster_id", "name", "n", "source")


@query(
    "agg6_dense_positions",
    f"""WITH {GROUPED} SELECT brand AS name, enriched_name, row_number() OVER (PARTITION BY brand ORDER BY {sql_item_id('enriched_name')}) - 1 AS row_pos,
    dense_rank() OVER (ORDER BY first_id) - 1 AS cluster_rank FROM (SELECT *, min({sql_item_id('enriched_name')}) OVER (PARTITION BY brand) AS first_id FROM grouped)""",
)
def agg6_dense(spark, d):
    out = a.memory_to_clusters(memory(spark, d), ["base"])
    heads = out.clusters.select("cluster_id", "name", (F.row_number().over(Window.orderBy("cluster_id")) - 1).alias("cluster_rank"))
    return out.rows.join(heads, "cluster_id").select("name", "enriched_name", "row_pos", "cluster_rank")


@query(
    "jn12_load_full",
    f"""WITH {GROUPED} SELECT cluster_id, brand AS name, enriched_name, CASE WHEN cluster_id <= 10 THEN row_number() OVER (PARTITION BY cluster_id ORDER BY {sql_item_id('enriched_name')}) - 1 ELSE row_pos END AS row_pos,
    CASE WHEN cluster_id <= 10 THEN 'memory' ELSE '' END AS source FROM grouped""",
)
def jn12_full(spark, d):
    """Ten clusters filled from memory: the odd ones by their own name, the even ones by their memory name."""
    c = catalogue(spark, d)
    odd = F.col("cluster_id") % 2 == 1
    c = c.with_(clusters=c.clusters.withColumn("memory_cluster_name", F.when(odd, F.lit(" ")).otherwise(F.col("memory_cluster_name"))))
    out = a.load_full(c, memory(spark, d), c.clusters.where("cluster_id <= 10 OR cluster_id > 1000").select("cluster_id"), [])
    heads = out.clusters.select("cluster_id", "name", F.col("source").alias("cluster_source"))
    return out.rows.join(heads, "cluster_id").select("cluster_id", "name", "enriched_name", "row_pos", F.col("cluster_source").alias("source"))


@query("jn13_find_rows", f"WITH {GROUPED} SELECT cluster_id, row_pos, enriched_name AS text FROM grouped")
def jn13(spark, d):
    hits = memory(spark, d).points.select("cluster_name", "text")
    return a.find_rows(catalogue(spark, d), hits).select(*ROW, "text")


@query("prj16_cluster_rename", f"WITH {PARTS} SELECT DISTINCT cluster_id, CASE WHEN cluster_id = 1 THEN brand ELSE 'Group ' || cluster_id END AS name FROM parts")
def prj16(spark, d):
    c = catalogue(spark, d).clusters
    return ed.rename_clusters(
        c, c.select("cluster_id", F.when(F.col("cluster_id") == 1, F.lit("Brand#2")).otherwise(F.concat(F.lit(" Group "), F.col("cluster_id").cast("string"))).alias("new_name"))
    ).select("cluster_id", "name")


@query(
    "prj16_same_new_name",
    f"WITH {PARTS} SELECT DISTINCT cluster_id, CASE WHEN cluster_id = (SELECT max(cluster_id) FROM parts) THEN 'same' WHEN cluster_id = 2 THEN 'second' ELSE brand END AS name FROM parts",
)
def prj16_same(spark, d):
    """All clusters want one name: the first edit, that of the highest id, gets it. Cluster 2 edits again."""
    c = catalogue(spark, d).clusters
    all_same = c.select("cluster_id", F.lit("same ").alias("new_name"), (-F.col("cluster_id")).alias("edit_pos"))
    again = c.where("cluster_id = 2").select("cluster_id", F.lit("second").alias("new_name"), F.lit(1).cast("bigint").alias("edit_pos"))
    return ed.rename_clusters(c, all_same.unionByName(again)).select("cluster_id", "name")


@query(
    "prj19_sanitize",
    f"""WITH {GROUPED} SELECT cluster_id, row_pos, name AS item, CASE WHEN name LIKE 'small%' THEN 'memory' ELSE 'ai' END AS source FROM grouped WHERE type <> 'promo'""",
)
def prj19(spark, d):
    c = catalogue(spark, d)
    messy = c.with_(rows=c.rows.withColumns({"item": F.concat(F.lit("  "), "item"), "source": F.lit("other"), "deleted": F.col("values")["type"] == "promo"}))
    names = parts(spark, d).where(F.startswith("name", F.lit("small"))).select(F.col("name").alias("item")).distinct()
    return a.sanitize(messy, names, ["base"]).rows.select(*ROW, "item", "source")


@query("set1_union_clusters", f"WITH {PARTS} SELECT 'ai' AS source, count(DISTINCT name) AS n FROM parts UNION ALL SELECT 'memory', count(DISTINCT brand) FROM parts")
def set1(spark, d):
    k, mem = known(spark, d)
    return a.union_catalogues(_new(spark, d), a.known_to_clusters(k, mem, [])).clusters.groupBy("source").agg(F.count("*").alias("n"))


@query("set3_ordered_union", f"WITH {PARTS}, f AS (SELECT cluster_id, type, min(pos) AS p FROM parts GROUP BY ALL) SELECT cluster_id, string_agg(type, ',' ORDER BY p) AS types FROM f GROUP BY cluster_id")
def set3(spark, d):
    out = a.distinct_in_order(parts(spark, d).select("cluster_id", "type", "pos"), ["cluster_id"], "type", F.col("pos"), "types")
    return out.select("cluster_id", F.array_join("types", ",").alias("types"))


@query("set4_select_clusters", f"WITH {PARTS}, s AS (SELECT cluster_id, min(pos) AS sel_pos FROM parts WHERE type = 'small' GROUP BY cluster_id) SELECT cluster_id, 'Brand#' || cluster_id AS name, sel_pos FROM s")
def set4(spark, d):
    picked = parts(spark, d).where("type = 'small'").select(F.col("pos").alias("sel_pos"), "cluster_id")
    return a.select_clusters(catalogue(spark, d).clusters, picked).select("cluster_id", "name", "sel_pos")


@query(
    "pip11_working_view",
    f"""WITH {GROUPED}, {_OVER} SELECT g.cluster_id, g.row_pos, g.enriched_name, {_FIRST_ALIAS} AS item, 'brand=' || o.brand || '|price=' || o.price || '|size=' || g.size || '|type=' || g.type AS flat_values,
    g.source, 'type,size,price,brand' AS attributes FROM grouped g JOIN over o ON o.cluster_id = g.cluster_id AND o.row_pos = g.row_pos""",
)
def pip11(spark, d):
    view = a.working_view(catalogue(spark, d), normalized(spark, d), parts(spark, d).select("item").distinct())
    heads = view.clusters.select("cluster_id", F.array_join("attributes", ",").alias("attributes"))
    return view.rows.join(heads, "cluster_id").select(*ROW, "enriched_name", "item", flat().alias("flat_values"), "source", "attributes")


_EXPORT = f"""{_OVER}, exported AS (SELECT g.cluster_id, g.row_pos, g.brand, g.enriched_name AS enriched, (SELECT string_agg(alias, '; ' ORDER BY alias_pos) FROM aliases a WHERE a.cluster_id = g.cluster_id AND a.row_pos = g.row_pos) AS originals,
  g.type || ',' || g.size || ',' || o.price AS cells FROM grouped g JOIN over o ON o.cluster_id = g.cluster_id AND o.row_pos = g.row_pos)"""


@query("exp1_export_rows", f"WITH {GROUPED}, {_EXPORT} SELECT cluster_id, row_pos, enriched, originals, cells FROM exported")
def exp1(spark, d):
    out = a.export_rows(catalogue(spark, d), normalized(spark, d))
    return out.select(*ROW, "enriched", "originals", F.array_join("attribute_values", ",").alias("cells"))


@query("exp2_wide_view", f"WITH {GROUPED} SELECT row_pos, enriched_name AS \"Обогащенное стандартизованное наименование\", type, size, price FROM grouped WHERE cluster_id = 7")
def exp2(spark, d):
    return a.to_wide(catalogue(spark, d), 7, ATTRIBUTES).drop("source", "deleted")


@query("win4_file_numbers", f"WITH {PARTS} SELECT cluster_id, row_number() OVER (ORDER BY cluster_id) AS file_no, brand AS name FROM (SELECT DISTINCT cluster_id, brand FROM parts)")
def win4(spark, d):
    return a.export_numbers(catalogue(spark, d).clusters).select("cluster_id", "file_no", "name")


# Spark's text reader drops the byte-order mark a file starts with; the tests look for it in the bytes.
@query("snk9_export_cluster", f"WITH {GROUPED}, {_EXPORT} SELECT enriched || ',' || originals || ',' || cells AS value FROM exported WHERE cluster_id = 7 UNION ALL SELECT 'Обогащенное наименование,Исходные номенклатуры,type,size,price'")
def snk9(spark, d):
    c = catalogue(spark, d)
    heads = a.export_numbers(c.clusters).where("cluster_id = 7")
    one = c.with_(rows=c.rows.where("cluster_id = 7"), items=c.items.where("cluster_id = 7"), clusters=c.clusters.where("cluster_id = 7"))
    path = scratch_path(spark, "export")
    write_export(export_lines(a.export_rows(one, normalized(spark, d)), heads), path)
    return spark.read.option("lineSep", "\r\n").text(path)


@query(
    "snk10_export_all",
    f"""WITH {GROUPED}, {_EXPORT}, f AS (SELECT cluster_id, printf('%02d', row_number() OVER (ORDER BY cluster_id)) || '_' || brand || '.csv' AS file_name FROM (SELECT DISTINCT cluster_id, brand FROM grouped))
    SELECT file_name, enriched || ',' || originals || ',' || cells AS value FROM exported JOIN f USING (cluster_id) UNION ALL SELECT file_name, 'Обогащенное наименование,Исходные номенклатуры,type,size,price' FROM f""",
)
def snk10(spark, d):
    c = catalogue(spark, d)
    path = scratch_path(spark, "export")
    write_exports(export_lines(a.export_rows(c, normalized(spark, d)), a.export_numbers(c.clusters)), path)
    return spark.read.option("lineSep", "\r\n").text(path).select("file_name", "value")
