"""Scalar functions over whole columns of the driver tables."""

from pyspark.sql import functions as F

from itemnorm.functions.merging import (
    clean_merge_modes,
    clean_merge_separators,
    detect_separator,
    explicit_separator,
    merge_accumulative,
    merge_mode,
    merge_priority,
    normalize_separator,
    split_parts,
)
from itemnorm.functions.responses import cache_key, extract_json, is_fresh, joined_aliases, parse_values, values_are_valid
from itemnorm.functions.text import (
    enriched_or_item,
    item_id,
    lookup_key,
    lower_keys,
    render_template,
    standardize,
    standardize_map,
)
from itemnorm.functions.vectors import cosine_distance
from itemnorm.operators.ordering import for_all_alike, one_of_each
from itemnorm.queries.inputs import flat, parts, sql_item_id, table
from itemnorm.queries.registry import query
from itemnorm.session import cut_lineage


@query("scl1_lookup_key", "SELECT doc_id, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) AS lookup_key FROM documents")
def scl1(spark, d):
    return table(spark, d, "documents").select("doc_id", lookup_key("text").alias("lookup_key"))


@query("scl2_item_id", f"SELECT p_partkey, {sql_item_id('p_brand || p_name')} AS item_id FROM part")
def scl2(spark, d):
    return table(spark, d, "part").select("p_partkey", item_id(F.concat("p_brand", "p_name")).alias("item_id"))


# p_type picks the spelling of the unit; every spelling has one canonical outcome.
SPELLED = {
    "ECONOMY": (" MM", " мм"), "SMALL": ("   Килограмм", " кг"), "MEDIUM": ("kg", "kg"),
    "LARGE": ("кг", " кг"), "STANDARD": (" гр.", " г."), "PROMO": (" Литров  x", " л x"),
}


def _unit(which: int) -> str:
    return " ".join(f"WHEN '{k}' THEN '{v[which]}'" for k, v in SPELLED.items())


@query("scl3_standardize", f"SELECT p_partkey, p_size || CASE p_type {_unit(1)} ELSE ' см' END AS value FROM part")
def scl3(spark, d):
    raw = F.concat(F.col("p_size").cast("string"), F.expr(f"CASE p_type {_unit(0)} ELSE ' cm' END"))
    return table(spark, d, "part").select("p_partkey", standardize(raw).alias("value"))


@query(
    "scl3_many_rules",
    """SELECT p_partkey, '7 K' || min(p_partkey) OVER (PARTITION BY p_name, p_size) || '; x' || p_name || ' ' || p_size || 'x' AS value FROM part""",
)
def scl3_many(spark, d):
    """Thousands of rules, one per name and size of a part (names and sizes are fixed lists, whatever the number of parts)."""
    p = table(spark, d, "part")
    found = p.groupBy("p_name", "p_size").agg(F.min("p_partkey").alias("first")).collect()
    rules = {f"K{r['first']}": [f"{r['p_name']} {r['p_size']}"] for r in sorted(found, key=lambda r: r["first"])}
    size = F.col("p_size").cast("string")
    raw = F.concat(F.lit("7  "), F.upper("p_name"), F.lit(" "), size, F.lit("; x"), "p_name", F.lit(" "), size, F.lit("x"))
    # A text that repeats is standardised once.
    firsts = cut_lineage(one_of_each(p, "p_partkey", ["p_name", "p_size"]))
    return for_all_alike(p, firsts, firsts.select("p_partkey", standardize(raw, rules).alias("value")), "p_partkey", ["p_name", "p_size"])


@query("scl4_standardize_map", f"SELECT p_partkey, 'name=' || p_name || '|size=' || p_size || CASE p_type {_unit(1)} ELSE ' см' END AS flat_values FROM part")
def scl4(spark, d):
    raw = F.concat(F.col("p_size").cast("string"), F.expr(f"CASE p_type {_unit(0)} ELSE ' cm' END"))
    df = table(spark, d, "part").select("p_partkey", F.create_map(F.lit("name"), "p_name", F.lit("size"), raw).alias("m"))
    return df.select("p_partkey", standardize_map("m").alias("values")).select("p_partkey", flat().alias("flat_values"))


@query(
    "scl5_render_template",
    "SELECT p_partkey, p_brand || ' {' || p_name || '} ' || '$1 ' || p_size AS name FROM part",
)
def scl5(spark, d):
    values = F.create_map(F.lit(" Brand"), "p_brand", F.lit("NAME "), "p_name", F.lit("size"), F.concat(F.lit("$1  "), F.col("p_size").cast("string")))
    return table(spark, d, "part").select("p_partkey", render_template(F.lit("{brand} {{name}}  {SIZE} {nothing}"), values).alias("name"))


@query("scl6_enriched_or_item", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_brand ELSE p_name END AS name FROM part")
def scl6(spark, d):
    values = F.create_map(F.lit("b"), F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.lit("")))
    return table(spark, d, "part").select("p_partkey", enriched_or_item(F.lit("{b}"), values, "p_name").alias("name"))


@query(
    "scl7_split_parts",
    """WITH pieces AS (SELECT doc_id, idx, trim(part) AS part FROM (SELECT doc_id, unnest(list_transform(string_split_regex(text, '[;,|]'), lambda x, i: {'idx': i, 'part': x}), recursive := true) FROM documents)),
    firsts AS (SELECT doc_id, trim(part, e' \\n\\t\\r') AS part, min(idx) AS idx FROM pieces WHERE trim(part, e' \\n\\t\\r') <> '' GROUP BY ALL)
    SELECT d.doc_id, coalesce(string_agg(part, ' ; ' ORDER BY idx), '') AS pieces, count(part) AS n FROM documents d LEFT JOIN firsts f ON f.doc_id = d.doc_id GROUP BY d.doc_id""",
)
def scl7(spark, d):
    return table(spark, d, "documents").select("doc_id", split_parts("text").alias("p")).select(
        "doc_id", F.array_join("p", " ; ").alias("pieces"), F.size("p").cast("bigint").alias("n")
    )


_COUNTS = "(length({c}) - length(replace({c}, '{ch}', '')))"


def _sep_sql(*cols: str) -> str:
    n = {ch: " + ".join(_COUNTS.format(c=c, ch=ch) for c in cols) for ch in ";,|"}
    return f"CASE WHEN {n[';']} >= {n[',']} AND {n[';']} >= {n['|']} THEN '; ' WHEN {n[',']} >= {n['|']} THEN ', ' ELSE ' | ' END"


@query("scl8_detect_separator", f"SELECT doc_id, {_sep_sql('text', 'source')} AS sep FROM documents")
def scl8(spark, d):
    return table(spark, d, "documents").select("doc_id", detect_separator("text", "source").alias("sep"))


@query(
    "scl9_merge_accumulative",
    """SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_name || '/' || p_brand || '/x' WHEN p_type = 'SMALL' THEN p_name || ' | ' || p_brand || ' | x'
    ELSE p_name || ', ' || p_brand || ', x' END AS merged FROM part""",
)
def scl9(spark, d):
    sep = F.expr("CASE p_type WHEN 'PROMO' THEN '/' WHEN 'SMALL' THEN '|' END")
    cur, inc = F.concat_ws(",", "p_name", "p_brand"), F.concat_ws(",", "p_brand", F.lit("x"), "p_name")
    return table(spark, d, "part").select("p_partkey", merge_accumulative(cur, inc, sep).alias("merged"))


@query("scl10_merge_priority", "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_brand END AS merged FROM part")
def scl10(spark, d):
    cur = F.when(F.col("p_size") > 25, F.col("p_name")).otherwise(F.lit("  "))
    return table(spark, d, "part").select("p_partkey", merge_priority(cur, "p_brand").alias("merged"))


@query("scl11_merge_mode", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN 'accumulative' ELSE 'priority' END AS mode FROM part")
def scl11(spark, d):
    modes = F.create_map(F.lit("economy"), F.lit("accumulative"), F.lit("SMALL"), F.lit("sum"))
    return table(spark, d, "part").select("p_partkey", merge_mode(modes, "p_type").alias("mode"))


@query("scl12_normalize_separator", "SELECT p_partkey, CASE p_type WHEN 'ECONOMY' THEN '; ' WHEN 'SMALL' THEN ' | ' WHEN 'LARGE' THEN NULL ELSE '/' END AS sep FROM part")
def scl12(spark, d):
    raw = F.expr("CASE p_type WHEN 'ECONOMY' THEN ' ;' WHEN 'SMALL' THEN '|' WHEN 'LARGE' THEN ' ' ELSE ' / ' END")
    seps = F.create_map(F.lower("p_type"), raw)
    return table(spark, d, "part").select("p_partkey", explicit_separator(seps, "p_type").alias("sep"))


@query("scl13_clean_policies", "SELECT p_partkey, p_name || '=accumulative' AS modes, p_name || '=, ' AS seps FROM part")
def scl13(spark, d):
    modes = F.create_map(F.concat(F.lit(" "), "p_name"), F.lit(" accumulative "), F.lit("other"), F.lit("sum"), F.lit(" "), F.lit("priority"))
    seps = F.create_map("p_name", F.lit(","), F.lit("blank"), F.lit("  "))
    df = table(spark, d, "part").select("p_partkey", clean_merge_modes(modes).alias("m"), clean_merge_separators(seps).alias("s"))
    return df.select("p_partkey", flat("m").alias("modes"), flat("s").alias("seps"))


@query(
    "scl14_cosine_distance",
    """SELECT a.vec_id, round(greatest(0, 1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS distance
    FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
)
def scl14(spark, d):
    a = table(spark, d, "embeddings").select("vec_id", "embedding")
    b = a.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return a.join(b, "vec_id").select("vec_id", F.round(cosine_distance("embedding", "other"), 6).alias("distance"))


@query("scl15_map_values_lookup", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS VARCHAR) AS k, event_type AS last_wins FROM events")
def scl15(spark, d):
    raw = F.map_concat(
        F.from_json("props", "map<string,string>"), F.create_map(F.lit(" X"), F.lit("first"), F.lit("x "), F.concat(F.lit(" "), "event_type"))
    )
    df = table(spark, d, "events").select("event_id", lower_keys(raw).alias("m"))
    return df.select("event_id", F.try_element_at("m", F.lit("k")).alias("k"), F.try_element_at("m", F.lit("x")).alias("last_wins"))


@query(
    "scl16_extract_json",
    """SELECT event_id, CASE event_type WHEN 'view' THEN '{"attributes":["a' || user_id || '", "b"]}' WHEN 'error' THEN '{"normalized":[{"item": "x"}]}'
    WHEN 'login' THEN '{"attributes":["q", "w"]}' ELSE props END AS json FROM events""",
)
def scl16(spark, d):
    user = F.col("user_id").cast("string")
    answer = (
        F.when(F.col("event_type") == "view", F.concat(F.lit('["a'), user, F.lit('", "b"]')))
        .when(F.col("event_type") == "error", F.lit('```\n[{"item": "x"}]\n```'))
        .when(F.col("event_type") == "login", F.lit('so: "attributes" : ["q", "w"] and more'))
        .when(F.col("event_type") == "click", F.concat(F.lit("```json\n"), "props", F.lit("\n``` done")))
        .otherwise(F.concat(F.lit("Answer: "), "props", F.lit(" bye")))
    )
    return table(spark, d, "events").select("event_id", extract_json(answer).alias("json"))


@query(
    "scl17_response_check",
    """SELECT event_id, event_type <> 'error' AS valid, CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS value FROM events""",
)
def scl17(spark, d):
    body = F.when(
        F.col("event_type") != "error",
        F.concat(F.lit('{"normalized":[{"item":"'), "event_type", F.lit('","values":'), "props", F.lit("}]}")),
    ).otherwise(F.lit('{"normalized":[{"values":{"k":"1"}}]}'))
    df = table(spark, d, "events").select("event_id", body.alias("json"))
    value = parse_values("json")["normalized"][0]["values"]
    return df.select("event_id", values_are_valid("json").alias("valid"), F.when(values_are_valid("json"), F.try_element_at(value, F.lit("k"))).alias("value"))


@query("scl18_cache_key", "SELECT p_partkey, md5('patterns||True||extract size||' || p_name || '|' || p_brand) AS cache_key FROM part")
def scl18(spark, d):
    return table(spark, d, "part").select(
        "p_partkey", cache_key(F.lit("patterns"), F.lit("extract size"), F.array("p_name", "p_brand"), True).alias("cache_key")
    )


@query("scl19_joined_aliases", "SELECT p_partkey, p_name || '; ' || p_brand AS originals FROM part")
def scl19(spark, d):
    return table(spark, d, "part").select("p_partkey", joined_aliases(F.array("p_name", F.lit(" "), F.concat(F.lit(" "), "p_brand"))).alias("originals"))


@query(
    "scl20_cache_freshness",
    "SELECT event_id, ts > (SELECT max(ts) FROM events) - INTERVAL 30 DAY AS fresh FROM events",
)
def scl20(spark, d):
    e = table(spark, d, "events")
    newest = e.agg(F.max("ts")).head()[0]
    return e.select("event_id", is_fresh("ts", F.lit(newest)).alias("fresh"))
