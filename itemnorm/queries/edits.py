"""Batch edits of cluster rows."""

from pyspark.sql import Window, functions as F

from itemnorm.operators import edits as ed
from itemnorm.queries.inputs import GROUPED, PARTS, catalogue, flat, parts, values_map
from itemnorm.queries.registry import query

ROW = ["cluster_id", "row_pos"]
_FIRST_ALIAS = "(SELECT arg_min(alias, alias_pos) FROM aliases a WHERE a.cluster_id = g.cluster_id AND a.row_pos = g.row_pos)"


def _rows(c):
    return c.rows.select(*ROW, "item", "enriched_name", flat().alias("flat_values"))


def _flat(type_="g.type", size="g.size", price="g.price"):
    return f"'price=' || {price} || '|size=' || {size} || '|type=' || {type_}"


@query("prj14_soft_delete", f"WITH {GROUPED} SELECT cluster_id, row_pos, type = 'small' AS deleted FROM grouped WHERE NOT (type = 'promo')")
def prj14(spark, d):
    rows = catalogue(spark, d).rows
    of = lambda t: rows.where(F.col("values")["type"] == t).select(*ROW)
    gone = ed.soft_delete(ed.soft_delete(rows, of("small").unionByName(of("large"))), of("large"), deleted=False)
    promo = ed.soft_delete(rows, of("promo"))
    return gone.join(ed.live_rows(promo).select(*ROW), ROW, "left_semi").select(*ROW, "deleted")


@query(
    "prj14_restore_order",
    f"""WITH {GROUPED}, e AS (SELECT cluster_id, name, row_pos, type, CASE WHEN type = 'small' THEN 1 WHEN type = 'large' THEN 2 ELSE 0 END AS stage FROM grouped),
    o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY stage = 1, stage, CASE stage WHEN 0 THEN row_pos ELSE -row_pos END) - 1 AS place FROM e)
    SELECT cluster_id, name AS item, place, type = 'small' AS deleted, (SELECT count(*) FROM members m WHERE m.cluster_id = o.cluster_id AND m.row_pos = o.row_pos) AS n_members FROM o""",
)
def prj14_order(spark, d):
    """Small and large rows deleted from the last to the first, then the large ones restored likewise: they follow the live rows."""
    c = catalogue(spark, d).stored("rows", "aliases", "members")
    of = lambda c, *t: c.rows.where(F.col("values")["type"].isin(*t)).select(*ROW, (-F.col("row_pos")).alias("edit_pos"))
    c = ed.delete_rows(c, of(c, "small", "large")).stored("rows", "members")
    back = c.rows.where(F.col("values")["type"] == "large").select(*ROW, F.col("row_pos").alias("edit_pos"))
    c = ed.restore_rows(c, back)
    n = c.members.groupBy(*ROW).agg(F.count("*").alias("n_members"))
    order = Window.partitionBy("cluster_id").orderBy("deleted", "row_pos")
    return c.rows.withColumn("place", F.row_number().over(order) - 1).join(n, ROW).select("cluster_id", "item", "place", "deleted", "n_members")


@query(
    "prj15_many_edits",
    f"""WITH {GROUPED} SELECT cluster_id, row_pos, 'c,a,kind,cost' AS attributes, 'a=|c=|cost=' || price || '|kind=' || size AS flat_values, (SELECT count(*) FROM grouped x WHERE x.cluster_id = g.cluster_id) AS n_rows FROM grouped g""",
)
def prj15_many(spark, d):
    """Several adds, deletes and renames of one cluster in each batch; rows are neither lost nor multiplied."""
    c = catalogue(spark, d)
    each = c.clusters.select("cluster_id")
    one = lambda row, names: F.struct(*[F.lit(v).alias(n) for v, n in zip(row, ("edit_pos", *names))])
    lines = lambda rows, *names: each.select("cluster_id", F.inline(F.array(*[one(r, names) for r in rows])))
    c = ed.add_attribute(c, lines([(0, "a"), (1, "b"), (2, "c"), (3, "a"), (4, "size"), (5, ed.RESERVED[0])], "attr"))
    c = ed.delete_attribute(c, lines([(0, "b"), (1, "type"), (2, "b"), (3, ed.RESERVED[1])], "attr"))
    c = ed.rename_attribute(c, lines([(0, "size", "x"), (1, "price", " cost "), (2, "x", "kind"), (3, "a", "c"), (4, "kind", ed.RESERVED[0])], "old", "new"))
    c = ed.set_template(c, lines([(0, "{kind}"), (1, "{cost}")], "template"))
    heads = c.clusters.select("cluster_id", F.array_join("attributes", ",").alias("attributes"))
    n = c.rows.groupBy("cluster_id").agg(F.count("*").alias("n_rows"))
    return c.rows.join(heads, "cluster_id").join(n, "cluster_id").select(*ROW, "attributes", flat().alias("flat_values"), "n_rows")


@query(
    "prj15_attribute_edits",
    f"WITH {GROUPED} SELECT cluster_id, row_pos, 'note,kind,price' AS attributes, 'kind=' || type || '|note=|price=' || price AS flat_values FROM grouped",
)
def prj15(spark, d):
    c = catalogue(spark, d)
    each = c.clusters.select("cluster_id")
    c = ed.add_attribute(c, each.withColumn("attr", F.lit("note")))
    c = ed.add_attribute(c, each.withColumn("attr", F.lit("type")))
    c = ed.rename_attribute(c, each.withColumns({"old": F.lit("type"), "new": F.lit(" kind ")}))
    c = ed.rename_attribute(c, each.withColumns({"old": F.lit("size"), "new": F.lit("price")}))
    c = ed.delete_attribute(c, each.withColumn("attr", F.lit("size")))
    heads = c.clusters.select("cluster_id", F.array_join("attributes", ",").alias("attributes"))
    return c.rows.join(heads, "cluster_id").select(*ROW, "attributes", flat().alias("flat_values"))


@query(
    "prj17_edit_values",
    f"""WITH {GROUPED}, n AS (SELECT cluster_id, row_pos, count(DISTINCT type) AS types FROM members GROUP BY ALL)
    SELECT m.cluster_id, m.row_pos, m.member_pos, CASE WHEN n.types = 1 THEN 'edited' ELSE m.type END AS member_type, 'edited' AS row_type FROM members m JOIN n ON n.cluster_id = m.cluster_id AND n.row_pos = m.row_pos""",
)
def prj17(spark, d):
    c = catalogue(spark, d)
    edits = c.rows.select(*ROW, F.lit(1).alias("edit_pos"), F.lit("type").alias("attr"), F.lit("edited").alias("value"))
    edits = edits.unionByName(edits.withColumns({"edit_pos": F.lit(0), "value": F.lit("overruled")}))
    out = ed.edit_values(c, edits)
    row_type = out.rows.select(*ROW, F.col("values")["type"].alias("row_type"))
    return out.members.select(*ROW, "member_pos", F.col("values")["type"].alias("member_type")).join(row_type, ROW)


@query(
    "prj20_insert_cluster_rows",
    f"""WITH {GROUPED}, lo AS (SELECT cluster_id, min(row_pos) AS top FROM grouped GROUP BY cluster_id), f AS (SELECT cluster_id, type, size, min(pos) AS pos FROM parts GROUP BY ALL)
    SELECT f.cluster_id, lo.top - 1 - f.pos AS row_pos, type || ' ' || size AS item, type || ' ' || size AS enriched_name, 'price=|size=' || size || '|type=' AS flat_values FROM f JOIN lo USING (cluster_id)
    UNION ALL SELECT cluster_id, row_pos, name, enriched_name, {_flat()} FROM grouped g""",
)
def prj20(spark, d):
    p = parts(spark, d).groupBy("cluster_id", "type", "size").agg(F.min("pos").alias("insert_pos"))
    new = p.select("cluster_id", "insert_pos", F.concat_ws(" ", "type", "size").alias("name"), values_map("size").alias("values"))
    blank = p.select("cluster_id", "insert_pos", F.lit("  ").alias("name"), values_map("size").alias("values"))
    return _rows(ed.insert_cluster_rows(catalogue(spark, d), new.unionByName(blank)))


@query(
    "jn11_move_rows",
    f"""WITH {GROUPED}, mv AS (SELECT *, row_number() OVER (ORDER BY row_pos) - 1 AS r FROM grouped WHERE name = 'small ring' AND cluster_id <> 1), mx AS (SELECT max(row_pos) AS last FROM grouped WHERE cluster_id = 1)
    SELECT 1::BIGINT AS cluster_id, mx.last + 1 + r AS row_pos, enriched_name, {_flat()} AS flat_values FROM mv g, mx UNION ALL SELECT cluster_id, row_pos, enriched_name, {_flat()} FROM grouped g WHERE NOT (name = 'small ring' AND cluster_id <> 1)""",
)
def jn11(spark, d):
    c = catalogue(spark, d)
    moves = c.rows.where("item = 'small ring'").select(*ROW, F.lit(1).cast("bigint").alias("target_id"), F.col("row_pos").alias("move_pos"))
    return _rows(ed.move_rows(c, moves)).drop("item")


@query(
    "jn11_repeated_move",
    f"""WITH {GROUPED}, mv AS (SELECT *, row_number() OVER (ORDER BY row_pos) - 1 AS r FROM grouped WHERE name = 'small ring' AND cluster_id <> 1), mx AS (SELECT max(row_pos) AS last FROM grouped WHERE cluster_id = 1)
    SELECT 1::BIGINT AS cluster_id, mx.last + 1 + r AS row_pos, enriched_name FROM mv g, mx UNION ALL SELECT cluster_id, row_pos, enriched_name FROM grouped g WHERE NOT (name = 'small ring' AND cluster_id <> 1)""",
)
def jn11_repeated(spark, d):
    """Each row named twice: to cluster 1, then to cluster 2; it moves once."""
    c = catalogue(spark, d)
    first = c.rows.where("item = 'small ring' AND cluster_id <> 1").select(*ROW, F.lit(1).cast("bigint").alias("target_id"), F.col("row_pos").alias("move_pos"))
    later = first.withColumns({"target_id": F.lit(2).cast("bigint"), "move_pos": F.col("move_pos") + 1_000_000_000})
    return _rows(ed.move_rows(c, later.unionByName(first))).select(*ROW, "enriched_name")


_SIZES = "string_agg(size, '; ' ORDER BY p)"


@query(
    "pip7_merge_rows",
    f"""WITH {GROUPED}, t AS (SELECT cluster_id, min(row_pos) AS dst FROM grouped GROUP BY cluster_id), r AS (SELECT g.*, t.dst, g.row_pos = t.dst AS own FROM grouped g JOIN t USING (cluster_id)),
    m AS (SELECT mm.*, t.dst FROM members mm JOIN t USING (cluster_id)), s AS (SELECT cluster_id, {_SIZES} AS size FROM (SELECT cluster_id, size, arg_min({{'a': row_pos, 'b': member_pos}}, (row_pos, member_pos)) AS p FROM m GROUP BY ALL) GROUP BY cluster_id)
    SELECT r.cluster_id, r.row_pos, {_flat('r.type', 's.size', 'r.price')} AS flat_values, (SELECT count(*) FROM members x WHERE x.cluster_id = r.cluster_id) AS n_members,
    (SELECT count(DISTINCT alias) FROM aliases x WHERE x.cluster_id = r.cluster_id) AS n_aliases, r.type || ' ' || s.size AS enriched_name FROM r JOIN s USING (cluster_id) WHERE own""",
)
def pip7(spark, d):
    """All rows of a cluster into its first one."""
    c = catalogue(spark, d)
    first = c.rows.groupBy("cluster_id").agg(F.min("row_pos").alias("dst"))
    merges = c.rows.select(*ROW).join(first, "cluster_id").where("row_pos <> dst").select(
        "cluster_id", F.col("row_pos").alias("src"), "dst", F.col("row_pos").alias("merge_pos")
    )
    out = ed.merge_rows(c, merges)
    n_m = out.members.groupBy(*ROW).agg(F.count("*").alias("n_members"))
    n_a = out.aliases.groupBy(*ROW).agg(F.count("*").alias("n_aliases"))
    return out.rows.join(n_m, ROW).join(n_a, ROW).select(*ROW, flat().alias("flat_values"), "n_members", "n_aliases", "enriched_name")


@query(
    "pip8_split_aliases",
    f"""WITH {GROUPED}, cut AS (SELECT cluster_id, row_pos, arg_min(alias, alias_pos) AS alias, min(alias_pos) AS pos, count(*) AS n FROM aliases GROUP BY ALL),
    pl AS (SELECT cluster_id, row_pos, (row_number() OVER (PARTITION BY cluster_id ORDER BY row_pos) - 1) * 2 AS new_pos FROM grouped)
    SELECT pl.cluster_id, pl.new_pos + 1 AS row_pos, cut.alias AS item, m.type || ' ' || m.size AS enriched_name FROM cut JOIN pl USING (cluster_id, row_pos) JOIN members m ON m.cluster_id = cut.cluster_id AND m.row_pos = cut.row_pos AND m.member_pos = cut.pos
    UNION ALL SELECT pl.cluster_id, pl.new_pos, g.name, NULL FROM grouped g JOIN pl USING (cluster_id, row_pos)""",
)
def pip8(spark, d):
    """The first alias of every row split off; names of the rows left behind are checked in the tests."""
    c = catalogue(spark, d)
    splits = c.aliases.groupBy(*ROW).agg(F.min_by("alias", "alias_pos").alias("alias"))
    out = ed.split_aliases(c, splits)
    return out.rows.select(*ROW, "item", F.when(F.col("row_pos") % 2 == 1, F.col("enriched_name")).alias("enriched_name"))


@query(
    "pip9_default_members",
    f"WITH {GROUPED} SELECT cluster_id, row_pos, alias_pos AS member_pos, alias AS item, {_flat('type', 'size', 'price')} AS flat_values FROM aliases JOIN grouped USING (cluster_id, row_pos)",
)
def pip9(spark, d):
    c = catalogue(spark, d)
    return ed.with_members(c.with_(members=c.members.where("false"))).members.select(*ROW, "member_pos", "item", flat().alias("flat_values"))


@query(
    "pip10_set_policy",
    f"""WITH {GROUPED}, s AS (SELECT cluster_id, row_pos, string_agg(type, '+' ORDER BY p) AS type FROM (SELECT cluster_id, row_pos, type, min(member_pos) AS p FROM members GROUP BY ALL) GROUP BY ALL),
    z AS (SELECT cluster_id, row_pos, {_SIZES} AS size FROM (SELECT cluster_id, row_pos, size, min(member_pos) AS p FROM members GROUP BY ALL) GROUP BY ALL)
    SELECT g.cluster_id, g.row_pos, {_flat('s.type', 'z.size')} AS flat_values, 'size=accumulative|type=accumulative' AS modes FROM grouped g JOIN s USING (cluster_id, row_pos) JOIN z USING (cluster_id, row_pos)""",
)
def pip10(spark, d):
    c = catalogue(spark, d)
    policy = c.clusters.select("cluster_id", F.lit("type").alias("attr"), F.lit("accumulative").alias("mode"), F.lit("+").alias("separator"))
    out = ed.set_policy(c, policy)
    heads = out.clusters.select("cluster_id", flat("attribute_merge").alias("modes"))
    return out.rows.join(heads, "cluster_id").select(*ROW, flat().alias("flat_values"), "modes")


@query(
    "pip6_regenerate_names",
    f"WITH {GROUPED} SELECT cluster_id, row_pos, CASE WHEN cluster_id = 3 THEN enriched_name ELSE type || ' / ' || price END AS enriched_name FROM grouped",
)
def pip6(spark, d):
    c = catalogue(spark, d)
    templates = c.clusters.select("cluster_id", F.when(F.col("cluster_id") == 3, F.lit(" ")).otherwise(F.lit("{Type} / {PRICE}")).alias("template"))
    return ed.regenerate_names(ed.set_template(c, templates))[0].rows.select(*ROW, "enriched_name")
