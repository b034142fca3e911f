"""Source table: scan, cleaning, edits, ordering, paging."""

from pyspark.sql import functions as F

from itemnorm.functions.text import safe_file_name, sheet_name
from itemnorm.operators import source_table as st
from itemnorm.operators.ordering import batch_number, dense_position, first_at, last_at, page, with_row_id
from itemnorm.queries.inputs import PARTS, parts, source_table, table
from itemnorm.queries.registry import query
from itemnorm.session import cut_lineage, scratch_path
from itemnorm.sources.files import clean_headers, normalize_headers, read_items


@query("src1_csv_scan", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment || ', \"x\"' AS c_mktsegment FROM customer")
def src1(spark, d):
    path = scratch_path(spark, "csv")
    c = table(spark, d, "customer").select(
        "c_custkey", F.concat(F.lit("  "), "c_name").alias("c_name"), "c_nationkey", F.concat("c_mktsegment", F.lit(', "x" ')).alias(" c_mktsegment ")
    )
    c.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False
    ).csv(path)
    return read_items(spark, path)


@query("src1_multi_line", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, md5(trim(text, e' \\n\\t\\r')) AS text_md5, coalesce(source, '') AS source FROM documents")
def src1_multi(spark, d):
    """Texts with line breaks and quotes, written out by the tasks that read them and read back in ranges of 64 kB, most of which begin inside a record."""
    path = scratch_path(spark, "csv")
    docs = table(spark, d, "documents").select("doc_id", F.btrim("text", F.lit(" \n\t\r")).alias("text"), "source")
    docs.write.option("header", True).option("quote", '"').option("escape", '"').csv(path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(64 << 10))
    try:
        held = cut_lineage(read_items(spark, path, multi_line=True))
    finally:
        spark.conf.set(key, before)
    return held.select("doc_id", F.md5("text").alias("text_md5"), "source")


@query("src2_headers", "SELECT CAST(s_suppkey AS VARCHAR) AS col_1, s_name AS name, CAST(s_nationkey AS VARCHAR) AS col_3 FROM supplier")
def src2(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string"), "s_name", F.col("s_nationkey").cast("string"))
    return normalize_headers(s.toDF(" ", " name ", ""))


@query("src3_row_index", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS place FROM lineitem")
def src3(spark, d):
    """Dense place of each line inside its order, from a stable row id."""
    l = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    ordered = l.repartitionByRange("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").sortWithinPartitions(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    fixed = cut_lineage(with_row_id(ordered))
    return dense_position(fixed, ["l_orderkey"], "row_id", "place").select("l_orderkey", "l_linenumber", "place")


@query("prj1_drop_empty_rows", "SELECT o.doc_id AS row_id, CASE WHEN l.quality = 1 THEN CAST(l.quality AS VARCHAR) ELSE '' END AS quality, CASE WHEN l.toxic = 1 THEN 'toxic' ELSE '' END AS toxic FROM labels o JOIN labels l USING (doc_id) WHERE l.quality = 1 OR l.toxic = 1")
def prj1(spark, d):
    l = table(spark, d, "labels").select(
        F.col("doc_id").alias("row_id"), F.when(F.col("quality") == 1, F.lit("1")).otherwise(F.lit("")).alias("quality"),
        F.when(F.col("toxic") == 1, F.lit("toxic")).otherwise(F.lit("")).alias("toxic"),
    )
    return st.drop_empty_rows(l)


@query("prj2_clean_rows", "SELECT min(doc_id) AS row_id, trim(text, e' \\n\\t\\r') AS text, lang FROM documents GROUP BY trim(text, e' \\n\\t\\r'), lang HAVING trim(text, e' \\n\\t\\r') || lang <> ''")
def prj2(spark, d):
    return st.clean_rows(source_table(spark, d).drop("source"))


@query(
    "prj3_clean_stats",
    """WITH s AS (SELECT trim(text, e' \\n\\t\\r') AS text, lang FROM documents), g AS (SELECT text, lang, count(*) AS n FROM s GROUP BY ALL)
    SELECT CAST(sum(n) AS BIGINT) AS total_rows, count(*) FILTER (text || lang <> '') AS kept_rows, CAST(coalesce(sum(n) FILTER (text || lang = ''), 0) AS BIGINT) AS removed_empty,
    CAST(coalesce(sum(n - 1) FILTER (text || lang <> ''), 0) AS BIGINT) AS removed_duplicates FROM g""",
)
def prj3(spark, d):
    return st.clean_stats(source_table(spark, d).drop("source"))


@query("prj4_configure_items", "SELECT doc_id AS item_idx, trim(text, e' \\n\\t\\r') AS item FROM documents WHERE trim(text, e' \\n\\t\\r') <> '' AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def prj4(spark, d):
    toxic = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("row_id"))
    return st.configure_items(source_table(spark, d), "text", toxic)


@query("prj5_base_attributes", "SELECT c_custkey AS row_id, c_nationkey, c_mktsegment FROM customer")
def prj5(spark, d):
    c = table(spark, d, "customer").withColumnRenamed("c_custkey", "row_id")
    return c.select("row_id", *st.base_attributes(c, "c_name", ["c_acctbal"]))


@query("prj6_exclude_rows", "SELECT doc_id AS row_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 0)")
def prj6(spark, d):
    poor = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("row_id"))
    return st.exclude_rows(source_table(spark, d), poor).select("row_id", "lang")


@query(
    "prj7_apply_updates",
    """SELECT d.doc_id AS row_id, CASE WHEN l.doc_id IS NOT NULL THEN 'toxic' || l.toxic ELSE d.lang END AS lang, d.source FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def prj7(spark, d):
    l = table(spark, d, "labels")
    row = F.col("doc_id").alias("row_id")
    patch = lambda pos, column, value: l.select(row, F.lit(pos).alias("patch_pos"), F.lit(column).alias("column"), value.alias("value"))
    patches = (
        patch(0, "lang", F.concat(F.lit("quality"), F.col("quality").cast("string")))
        .unionByName(patch(1, "lang", F.concat(F.lit("toxic"), F.col("toxic").cast("string"))))
        .unionByName(patch(2, "no such column", F.lit("x")))
    )
    return st.apply_updates(source_table(spark, d).drop("text"), patches)


@query(
    "prj8_insert_rows",
    """SELECT doc_id AS row_id, text, lang, source FROM documents UNION ALL
    SELECT (SELECT min(doc_id) FROM documents) - 1 - item_id, trim(text, e' \\n\\t\\r'), '', '' FROM benchmark""",
)
def prj8(spark, d):
    new = table(spark, d, "benchmark").select(F.col("item_id").alias("insert_pos"), "text")
    return st.insert_rows(source_table(spark, d), new, "text")


@query("prj9_delete_rows", "SELECT c_custkey AS row_id, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def prj9(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_name")
    return st.delete_rows(c, table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("row_id")))


@query("prj10_add_column", "SELECT c_custkey AS row_id, c_name, '' AS note, c_mktsegment FROM customer")
def prj10(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_name", "c_mktsegment")
    return st.add_column(c, " note ", item_column="c_name")


@query("prj11_rename_column", "SELECT c_custkey AS row_id, c_name AS title, c_mktsegment FROM customer")
def prj11(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_name", "c_mktsegment")
    return st.rename_column(c, "c_name", "title")


@query("prj12_delete_column", "SELECT c_custkey AS row_id, c_name FROM customer")
def prj12(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_name", "c_mktsegment")
    return st.delete_column(c, "c_mktsegment")


@query("prj13_item_column_first", "SELECT c_mktsegment, c_nationkey, c_custkey, c_name FROM customer")
def prj13(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return c.select(*st.item_column_first(c.columns, "c_mktsegment", "c_nationkey"))


@query(
    "prj18_safe_names",
    r"""SELECT page_id, regexp_replace(url, '[\\/:*?"<>|]+', '_', 'g') AS file_name, substr(url, 1, 31) AS sheet FROM pages""",
)
def prj18(spark, d):
    return table(spark, d, "pages").select("page_id", safe_file_name("url", F.lit("x")).alias("file_name"), sheet_name("url", F.lit("x")).alias("sheet"))


@query("win1_first_last", f"WITH {PARTS} SELECT name, arg_min(item, pos) AS first_item, arg_max(item, pos) AS last_item FROM parts GROUP BY name")
def win1(spark, d):
    p = parts(spark, d).select("name", "pos", "item")
    first = first_at(p, ["name"], "pos").select("name", F.col("item").alias("first_item"))
    return first.join(last_at(p, ["name"], "pos").select("name", F.col("item").alias("last_item")), "name")


@query("win2_batches", f"WITH {PARTS}, n AS (SELECT cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY pos) - 1) // 8 AS batch FROM parts) SELECT cluster_id, batch, count(*) AS items FROM n GROUP BY ALL")
def win2(spark, d):
    p = parts(spark, d).select("cluster_id", "pos")
    return batch_number(p, ["cluster_id"], "pos", 8).groupBy("cluster_id", "batch").agg(F.count("*").alias("items"))


@query(
    "win3_page",
    """SELECT o_orderkey AS row_id, o_orderstatus, 3 AS page, (SELECT count(*) FROM orders) AS total_rows, CAST(ceil((SELECT count(*) FROM orders) / 100) AS INTEGER) AS total_pages
    FROM orders ORDER BY o_orderkey LIMIT 100 OFFSET 200""",
)
def win3(spark, d):
    return page(table(spark, d, "orders").select(F.col("o_orderkey").alias("row_id"), "o_orderstatus"), 3, 100)


@query("srt3_input_order", "SELECT row_id, row_number() OVER (ORDER BY row_id) - 1 AS place FROM (SELECT min(doc_id) AS row_id FROM documents GROUP BY trim(text, e' \\n\\t\\r'), lang)")
def srt3(spark, d):
    """Kept rows with their dense place in input order, without one global window."""
    kept = st.clean_rows(source_table(spark, d).drop("source")).select("row_id", F.lit(0).alias("all"))
    return dense_position(kept, ["all"], "row_id", "place").select("row_id", "place")
