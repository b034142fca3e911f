"""Batches, answers, cache, profiles, extraction."""

from pyspark.sql import functions as F

from itemnorm.functions.responses import extract_json, parse_profile, profile_is_valid
from itemnorm.operators import enrich as en
from itemnorm.queries.inputs import FINISHED, PARTS, flat, known_first, parts, table
from itemnorm.queries.registry import query
from itemnorm.session import cut_lineage, scratch_path

PATTERNS = {"size": r"(\d+ mm)", "type": r" (\w+) \d+ mm"}


def _items(spark, d):
    return parts(spark, d).select("cluster_id", "pos", "item")


@query(
    "agg8_combine_profiles",
    """WITH c AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '' ELSE role END AS category, CASE WHEN turn > 1 THEN role || turn ELSE '' END AS tpl, role FROM conversations),
    a AS (SELECT conv_id, role, min(turn) AS p FROM c GROUP BY ALL)
    SELECT conv_id AS cluster_id, coalesce(arg_min(nullif(category, ''), CASE WHEN category <> '' THEN turn END), 'Без категории') AS category, coalesce(arg_min(nullif(tpl, ''), CASE WHEN tpl <> '' THEN turn END), '') AS name_template,
    (SELECT 'base,' || string_agg(role, ',' ORDER BY p) FROM a WHERE a.conv_id = c.conv_id) AS attributes FROM c GROUP BY conv_id""",
)
def agg8(spark, d):
    c = table(spark, d, "conversations").select(
        F.col("conv_id").alias("cluster_id"), F.col("turn").alias("batch"),
        F.when(F.col("role") == "user", F.lit("  ")).otherwise(F.col("role")).alias("category"),
        F.array("role", F.lit("base")).alias("attributes"),
        F.when(F.col("turn") > 1, F.concat("role", F.col("turn").cast("string"))).otherwise(F.lit("")).alias("name_template"),
    )
    out = en.combine_profiles(c, ["base"])
    return out.select("cluster_id", "category", "name_template", F.array_join("attributes", ",").alias("attributes"))


@query(
    "agg9_missing_attr_groups",
    f"WITH {PARTS} SELECT cluster_id, CASE WHEN source = 'memory' THEN 'color' ELSE 'size,color' END AS missing, count(*) AS items FROM parts GROUP BY ALL",
)
def agg9(spark, d):
    p = parts(spark, d).select(
        "cluster_id", "pos", "item", F.array(F.lit("type"), F.lit("size"), F.lit("color")).alias("attributes"),
        F.create_map(F.lit("type"), "type", F.lit("size"), F.when(F.col("source") == "memory", F.col("size")).otherwise(F.lit(" "))).alias("values"),
    )
    return en.missing_attr_groups(p).select("cluster_id", F.array_join("missing", ",").alias("missing"), "items")


@query(
    "jn9_audit_batches",
    """WITH b AS (SELECT user_id AS batch_id, event_id, event_type FROM events), r AS (SELECT batch_id, CASE event_type WHEN 'error' THEN '' WHEN 'click' THEN 'other' ELSE CAST(event_id AS VARCHAR) END AS item FROM b),
    q AS (SELECT batch_id, count(*) AS expected, count(*) AS actual, count(*) FILTER (event_type = 'error') AS blank, count(*) FILTER (event_type IN ('error', 'click')) AS missing, count(DISTINCT CASE WHEN event_type = 'click' THEN 1 END) AS extra FROM b GROUP BY batch_id)
    SELECT *, blank = 0 AND missing = 0 AND extra = 0 AS complete FROM q""",
)
def jn9(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("batch_id"), F.col("event_id").cast("string").alias("item"), "event_type")
    back = F.when(F.col("event_type") == "error", F.lit(" ")).when(F.col("event_type") == "click", F.lit("other")).otherwise(F.col("item"))
    return en.audit_batches(e, e.select("batch_id", back.alias("item")))


@query("set2_set_difference", "WITH m AS (SELECT DISTINCT trim(text, e' \\n\\t\\r') AS item FROM benchmark) SELECT count(*) AS expected, count(*) FILTER (item NOT IN (SELECT trim(text, e' \\n\\t\\r') FROM documents)) AS missing FROM m")
def set2(spark, d):
    one = F.lit(0).alias("batch_id")
    asked = table(spark, d, "benchmark").select(one, F.trim(F.btrim("text", F.lit(" \n\t\r"))).alias("item")).distinct()
    given = table(spark, d, "documents").select(one, "text").select("batch_id", F.col("text").alias("item"))
    return en.audit_batches(asked, given).select("expected", "missing")


_PROFILE = f"""{PARTS}, b AS (SELECT cluster_id, (row_number() OVER (PARTITION BY cluster_id ORDER BY pos) - 1) // 18 AS batch, item FROM parts),
words AS (SELECT cluster_id, batch, unnest(string_split(item, ' ')) AS w FROM b), counted AS (SELECT cluster_id, batch, w, count(*) AS n FROM words GROUP BY ALL)"""


@query(
    "enr1_profile_clusters",
    f"""WITH {_PROFILE}, best AS (SELECT cluster_id, arg_min(w, (-n, w)) AS category FROM counted WHERE batch = 0 GROUP BY cluster_id)
    SELECT cluster_id, category, 'base,size,type' AS attributes, '{{size}} {{type}}' AS name_template FROM best""",
)
def enr1(spark, d):
    profiles, _, _ = en.profile_clusters(_items(spark, d), en.frequency_profile(PATTERNS), ["base"])
    return profiles.select("cluster_id", "category", F.array_join("attributes", ",").alias("attributes"), "name_template")


def misprofiled(text: str):
    """Provider of profiles that answers in no JSON where an item holds `text`."""
    good = en.frequency_profile(PATTERNS)

    def answer(requests):
        wrong = requests.select("request_id", F.exists("items", lambda i: i.contains(text)).alias("wrong"))
        return good(requests).join(wrong, "request_id").select("request_id", F.when(F.col("wrong"), F.lit("no idea")).otherwise(F.col("response")).alias("response"))

    return answer


@query(
    "enr1_rejected",
    f"""WITH {_PROFILE}, best AS (SELECT cluster_id, arg_min(w, (-n, w)) AS category FROM counted WHERE batch = 0 GROUP BY cluster_id),
    bad AS (SELECT cluster_id, count(DISTINCT batch) AS batches FROM b WHERE contains(item, ' promo 7') GROUP BY cluster_id)
    SELECT b.cluster_id, CASE WHEN d.batches IS NULL THEN category END AS category, coalesce(d.batches, 0) AS batches FROM best b LEFT JOIN bad d USING (cluster_id)""",
)
def enr1_rejected(spark, d):
    """Clusters with a batch that is never answered in JSON: no profile, and listed with their rejected batches."""
    items = _items(spark, d)
    profiles, rejected, _ = en.profile_clusters(items, misprofiled(" promo 7"), ["base"])
    every = items.select("cluster_id").distinct().join(profiles.select("cluster_id", "category"), "cluster_id", "left")
    return every.join(en.failed_groups(rejected), "cluster_id", "left").select("cluster_id", "category", F.coalesce("batches", F.lit(0)).alias("batches"))


@query(
    "enr2_extract_values",
    f"WITH {PARTS} SELECT DISTINCT cluster_id, item, 'size=' || size || ' mm|type=' || type AS flat_values FROM parts",
)
def enr2(spark, d):
    asked = _items(spark, d).withColumn("attributes", F.array(F.lit("type"), F.lit("size")))
    values, _, _ = en.extract_values(asked, en.pattern_extraction(PATTERNS))
    return values.select("cluster_id", "item", flat().alias("flat_values"))


def stubborn(text: str, wrong_attempts: int):
    """Provider that leaves out an item in every batch with `text` in an item, the first so many times."""
    good = en.pattern_extraction(PATTERNS)

    def answer(requests):
        wrong = F.exists("items", lambda i: i.contains(text)) & (F.col("attempt") <= wrong_attempts)
        flags = requests.select("request_id", wrong.alias("wrong"))
        return good(requests).join(flags, "request_id").select(
            "request_id", F.when(F.col("wrong"), F.lit('{"normalized": [{"item": "other", "values": {}}]}')).otherwise(F.col("response")).alias("response")
        )

    return answer


_BATCHES = f"{PARTS}, b AS (SELECT *, (row_number() OVER (PARTITION BY cluster_id ORDER BY pos) - 1) // 8 AS batch FROM parts)"


@query(
    "enr2_rejected",
    f"""WITH {_BATCHES}, bad AS (SELECT cluster_id, batch FROM b GROUP BY ALL HAVING bool_or(contains(item, ' promo 7')))
    SELECT cluster_id, item, bool_or((cluster_id, batch) NOT IN (FROM bad)) AS answered, count(*) FILTER ((cluster_id, batch) IN (FROM bad)) AS refused FROM b GROUP BY ALL""",
)
def enr2_rejected(spark, d):
    """Batches that are never answered as asked: refused as a whole, the others answered; nothing of them is cached."""
    asked = cut_lineage(_items(spark, d).withColumn("attributes", F.array(F.lit("type"), F.lit("size"))))
    values, rejected, answers = en.extract_values(asked, stubborn(" promo 7", en.ATTEMPTS))
    kept = answers.cache.where(F.col("response").contains('"other"')).select(F.lit("cached a refused answer").alias("item"))
    refused = rejected.select("cluster_id", F.explode("items").alias("item")).groupBy("cluster_id", "item").agg(F.count("*").alias("refused"))
    out = asked.select("cluster_id", "item").distinct().unionByName(kept.withColumn("cluster_id", F.lit(0).cast("bigint")))
    return out.join(values.select("cluster_id", "item", F.lit(True).alias("answered")), ["cluster_id", "item"], "left").join(refused, ["cluster_id", "item"], "left").select(
        "cluster_id", "item", F.coalesce("answered", F.lit(False)).alias("answered"), F.coalesce("refused", F.lit(0)).alias("refused")
    )


@query("enr2_retry", f"WITH {PARTS} SELECT DISTINCT cluster_id, item, 'size=' || size || ' mm|type=' || type AS flat_values FROM parts")
def enr2_retry(spark, d):
    """A cache that holds bad answers, and a provider wrong at the first attempt: the second one is used."""
    path = scratch_path(spark, "cache")
    asked = cut_lineage(_items(spark, d).withColumn("attributes", F.array(F.lit("type"), F.lit("size"))))
    _, _, bad = en.extract_values(asked, stubborn("", en.ATTEMPTS))
    lines = bad.responses.select("cache_key", "response", F.current_timestamp().alias("cached_at"))
    en.append_cache(lines, path)
    values, _, _ = en.extract_values(asked, stubborn(" promo 7", 1), spark.read.schema(en.CACHE).parquet(path))
    return values.select("cluster_id", "item", flat().alias("flat_values"))


@query(
    "enr3_fill_gaps",
    f"""WITH {PARTS}, asked AS (SELECT DISTINCT cluster_id, item FROM parts WHERE source = 'memory')
    SELECT p.cluster_id, p.pos, 'price=' || price || '|size=' || CASE WHEN a.item IS NULL THEN 'known' ELSE size || ' mm' END || '|type=' || type AS flat_values FROM parts p LEFT JOIN asked a ON a.cluster_id = p.cluster_id AND a.item = p.item""",
)
def enr3(spark, d):
    size = F.when(F.col("source") == "memory", F.lit(" ")).otherwise(F.lit("known"))
    p = parts(spark, d).select(
        "cluster_id", "pos", "item", F.array(F.lit("type"), F.lit("size"), F.lit("price")).alias("attributes"),
        F.create_map(F.lit("type"), "type", F.lit("size"), size, F.lit("price"), "price").alias("values"),
    )
    filled, _, _ = en.fill_gaps(p, en.pattern_extraction(PATTERNS))
    return filled.select("cluster_id", "pos", flat().alias("flat_values"))


@query(
    "enr4_response_cache",
    f"WITH {_PROFILE}, {FINISHED} SELECT cluster_id, batch, cluster_id IN (FROM finished) AS from_cache FROM b GROUP BY ALL",
)
def enr4(spark, d):
    """Clusters starting with a known item answered and cached, then everything asked again."""
    path = scratch_path(spark, "cache")
    items = _items(spark, d)
    _, _, first = en.profile_clusters(items.join(known_first(parts(spark, d)), "cluster_id", "left_semi"), en.frequency_profile(PATTERNS), ["base"])
    en.append_cache(first.cache, path)
    cache = spark.read.schema(en.CACHE).parquet(path)
    _, _, second = en.profile_clusters(items, en.frequency_profile(PATTERNS), ["base"], cache)
    return second.responses.where("valid").select("cluster_id", "batch", "from_cache")


@query(
    "enr4_pruned_cache",
    f"WITH {_PROFILE}, {FINISHED} SELECT cluster_id, batch, cluster_id IN (FROM finished) AS from_cache FROM b GROUP BY ALL",
)
def enr4_pruned(spark, d):
    """The same through a cache kept in days and buckets, beside entries of expired days, which are removed."""
    path = scratch_path(spark, "cache")
    items = _items(spark, d)
    _, _, first = en.profile_clusters(items.join(known_first(parts(spark, d)), "cluster_id", "left_semi"), en.frequency_profile(PATTERNS), ["base"])
    en.append_cache(first.cache, path)
    asked = en.profile_clusters(items, en.frequency_profile(PATTERNS), ["base"])[2].cache
    en.append_cache(asked.withColumn("cached_at", F.col("cached_at") - F.expr("interval 40 days")), path)
    _, _, second = en.profile_clusters(items, en.frequency_profile(PATTERNS), ["base"], en.read_cache(spark, path))
    expired = en.expire_cache(spark, path)
    return second.responses.where("valid").where(F.lit(expired == 1)).select("cluster_id", "batch", "from_cache")


@query("scl17_profile_check", "SELECT event_id, event_type <> 'error' AS valid, CASE WHEN event_type <> 'error' THEN event_type END AS category FROM events")
def scl17_profile(spark, d):
    body = F.when(
        F.col("event_type") == "error", F.lit('{"category": "x", "attributes": "not a list"}')
    ).otherwise(F.concat(F.lit('{"category": "'), "event_type", F.lit('", "attributes": ["a"]}')))
    df = table(spark, d, "events").select("event_id", extract_json(body).alias("json"))
    return df.select("event_id", profile_is_valid("json").alias("valid"), F.when(profile_is_valid("json"), parse_profile("json")["category"]).alias("category"))
