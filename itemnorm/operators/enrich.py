"""Batched requests to a model, answers checked and parsed, cached, combined.

A provider is DataFrame -> DataFrame: it gets one line per question
(request_id, items, attributes, prompt, attempt) and returns (request_id, response text), and, where a
question can fail by itself, error and retriable.
Built-in providers are plain column expressions; a real model is wrapped by
python_provider and runs in mapInPandas. A question whose answer is not usable is asked
again, past the cache, up to ATTEMPTS times, one that failed for good is not; only usable answers are cached.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from itemnorm.functions.responses import (
    CACHE_DAYS,
    cache_key,
    extract_json,
    is_fresh,
    parse_profile,
    parse_values,
    profile_is_valid,
    values_are_valid,
)
from itemnorm.functions.text import clean_map, empty_map, lookup_key, non_blank, strip_u, text_of, value_of
from itemnorm.operators.assemble import distinct_in_order, strings
from itemnorm.operators.ordering import batch_number, first_at, last_per_key
from itemnorm.session import cut_lineage
from itemnorm.sources.commits import file_system, names

PROFILE_BATCH = 18
EXTRACT_BATCH = 8
ATTEMPTS = 3
# Fixed value: the category of a cluster nobody named.
NO_CATEGORY = "Без категории"
CACHE = "cache_key string, response string, cached_at timestamp"

Provider = Callable[[DataFrame], DataFrame]

# Patterns of the built-in extraction provider: attribute -> first capture group.
DEFAULT_PATTERNS = {
    "размер": r"(?iU)(\d+(?:[.,]\d+)?\s*(?:мм|mm|см|cm))(?!\w)",
    "вес": r"(?iU)(\d+(?:[.,]\d+)?\s*(?:кг|kg|г|g))(?!\w)",
    "код": r"(?iU)#(\w+)",
}


def batched(items: DataFrame, size: int, groups: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    """One line per batch: groups..., batch, items array of at most `size`, carried columns.

    items(groups..., pos, item, carry...). Batches of a hot group are numbered in chunks,
    so no task holds the group.
    """
    numbered = batch_number(items, groups, "pos", size)
    return numbered.groupBy(*groups, "batch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "item"))), lambda e: e["item"]).alias("items"),
        *[F.first(c).alias(c) for c in carry],
    )


def with_keys(batches: DataFrame, kind: str, provider_name: str) -> DataFrame:
    """Adds prompt (what is asked, without the items), cache_key and request_id.

    request_id is a digest of the whole question, lists delimited: equal questions share it, and nothing else does.
    A batch itself is known by its group columns and its number.
    """
    prompt = F.concat_ws(" ", F.lit(kind), F.array_join("attributes", ", "))
    return batches.withColumn("prompt", prompt).withColumns(
        {
            "cache_key": cache_key(F.lit(provider_name), "prompt", "items", web_search=kind == "extract"),
            "request_id": F.sha2(F.to_json(F.struct(F.lit(kind).alias("k"), F.lit(provider_name).alias("p"), "attributes", "items")), 256),
        }
    )


# What a message of an error that may pass says.
PASSING = ("429", "rate limit", "rate_limit", "too many requests", "quota", "resource exhausted", "resource_exhausted", "json", "empty llm response", "validation error")


def may_pass(error: Exception) -> bool:
    """Errors of limits, connections and malformed answers may pass; all others are final."""
    if isinstance(error, (ValueError, TimeoutError, ConnectionError)):
        return True
    text = str(error).lower()
    return any(mark in text for mark in PASSING)


def python_provider(
    load: Callable[[], Callable[[list[str], list[str], str], str]], retriable: Callable[[Exception], bool] = may_pass
) -> Provider:
    """load() runs once per task; its result is called with (items, attributes, prompt) per request.

    A call that raises fails its own request: the line carries the error and whether asking again may help,
    and the other requests of the task go on. A model that cannot be loaded fails the requests of its task.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = failed = None
        try:
            ask = load()
        except Exception as error:  # noqa: BLE001
            failed = error

        def answer(*request) -> tuple[str | None, str | None, bool | None]:
            try:
                if failed is not None:
                    raise failed
                return ask(*request), None, None
            except Exception as error:  # noqa: BLE001
                return None, f"{type(error).__name__}: {error}", bool(retriable(error))

        for pdf in frames:
            answers = [answer(list(i), list(a), p) for i, a, p in zip(pdf["items"], pdf["attributes"], pdf["prompt"], strict=True)]
            columns = list(zip(*answers)) or [(), (), ()]
            yield pd.DataFrame({"request_id": pdf["request_id"], **{c: pd.Series(v, dtype=object, index=pdf.index) for c, v in zip(("response", "error", "retriable"), columns)}})

    return lambda requests: requests.select("request_id", "items", "attributes", "prompt").mapInPandas(
        run, "request_id string, response string, error string, retriable boolean"
    )


def _any_matches(items: str, pattern: str) -> Column:
    return F.exists(items, lambda i: i.rlike(pattern))


def frequency_profile(patterns: dict[str, str] | None = None) -> Provider:
    """Built-in profile: most frequent word as category, attributes whose pattern hits an item."""
    rules = DEFAULT_PATTERNS if patterns is None else patterns

    def answer(requests: DataFrame) -> DataFrame:
        words = F.filter(F.flatten(F.transform("items", lambda i: F.split(lookup_key(i), " "))), lambda w: w != "")
        counted = F.transform(
            F.array_distinct("_w"), lambda w: F.struct(-F.size(F.filter("_w", lambda x: x == w)), w.alias("w"))
        )
        hits = F.array(*[F.when(_any_matches("items", p), F.lit(a)) for a, p in rules.items()])
        found = F.filter(F.array_compact(hits), lambda a: ~F.array_contains("attributes", a))
        slots = F.array_join(F.transform(F.col("_a"), lambda a: F.concat(F.lit("{"), a, F.lit("}"))), " ")
        return (
            requests.withColumn("_w", words).withColumn("_a", found)
            .select(
                "request_id",
                F.to_json(
                    F.struct(
                        F.coalesce(F.array_min(counted)["w"], F.lit("")).alias("category"),
                        F.col("_a").alias("attributes"), slots.alias("name_template"),
                    )
                ).alias("response"),
            )
        )

    return answer


def pattern_extraction(patterns: dict[str, str] | None = None) -> Provider:
    """Built-in extraction: first match of each requested attribute's pattern, "" without one."""
    rules = DEFAULT_PATTERNS if patterns is None else patterns

    def pick(item: Column, attribute: Column) -> Column:
        out = F.lit("")
        for name, pattern in rules.items():
            out = F.when(attribute == name, F.regexp_extract(item, pattern, 1)).otherwise(out)
        return out

    def answer(requests: DataFrame) -> DataFrame:
        entry = lambda i: F.struct(
            i.alias("item"),
            F.map_from_arrays("attributes", F.transform("attributes", lambda a: pick(i, a))).alias("values"),
        )
        return requests.select(
            "request_id", F.to_json(F.struct(F.transform("items", entry).alias("normalized"))).alias("response")
        )

    return answer


@dataclass(frozen=True)
class Answers:
    """responses: batches + response, json, from_cache, valid (usable), error (what the provider raised last, if it did);
    cache: entries to append, usable answers only; complete: every batch has a usable answer."""

    responses: DataFrame
    cache: DataFrame
    complete: bool


#: Questions a task holds at most, about. Their texts compress well, so shuffled bytes say little about what a task sorts.
QUESTIONS_PER_TASK = 16_384


def _dealt(questions: DataFrame) -> DataFrame:
    """Stored, distinct questions in parts that do not grow with their number; provider and judge join by the same parts."""
    parts = -(-questions.count() // QUESTIONS_PER_TASK)
    if parts <= 1:
        return questions
    return questions.repartition(max(parts, int(questions.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "request_id")


def ask(
    requests: DataFrame,
    provider: Provider,
    usable: Callable[[DataFrame], DataFrame],
    cache: DataFrame | None = None,
    attempts: int = ATTEMPTS,
) -> Answers:
    """Answers of all batches: from fresh cache entries first, else from the provider; equal questions are asked once.

    usable: lines (request_id, items, json) to the same lines with a boolean `valid`. What is not valid is
    asked again, the cache left aside; the last answer stays, marked as not valid. Each attempt is
    written out, so a lost executor repeats no question that was answered; what follows reads those tables. So are the
    questions that are open before it, or an attempt would hold the joins of all before.
    """
    numbered = cut_lineage(requests.withColumn("_row", F.monotonically_increasing_id()))
    requests = numbered.drop("_row")
    question = ["request_id", "cache_key", "items", "attributes", "prompt"]
    open_ = cut_lineage(first_at(numbered.select("_row", *question), ["request_id"], "_row").select(*question))
    done, fresh = [], []

    def judged(asked: DataFrame, answered: DataFrame, from_cache: bool) -> DataFrame:
        for name, kind in (("error", "string"), ("retriable", "boolean")):
            if name not in answered.columns:
                answered = answered.withColumn(name, F.lit(None).cast(kind))
        answered = answered.select("request_id", "response", "error", F.coalesce("retriable", F.lit(True)).alias("retriable"))
        lines = asked.join(answered, "request_id").withColumns({"json": extract_json("response"), "from_cache": F.lit(from_cache)})
        sure = F.coalesce("valid", F.lit(False)) & F.col("error").isNull()
        kept = ["request_id", "cache_key", "response", "json", "from_cache", "error", "retriable", sure.alias("valid")]
        return cut_lineage(usable(lines.select("request_id", "cache_key", "items", "response", "json", "from_cache", "error", "retriable")).select(*kept))

    if cache is not None:
        keys = open_.select("cache_key").distinct()
        held = fresh_entries(cache, keys)
        known = last_per_key(held, ["cache_key"], ["cached_at"]).select("cache_key", "response")
        found = judged(_dealt(open_), open_.select("request_id", "cache_key").join(known, "cache_key").select("request_id", "response"), True)
        done.append(found.where("valid"))
        open_ = cut_lineage(open_.join(done[-1].select("request_id"), "request_id", "left_anti"))
    complete = True
    for attempt in range(1, attempts + 1):
        now = _dealt(open_).withColumn("attempt", F.lit(attempt))
        answers = judged(now, provider(now), False)
        fresh.append(answers.where("valid"))
        # What failed for good is not asked again; what the provider left out is.
        closed = answers.where(F.col("valid") | ~F.col("retriable"))
        complete = complete and answers.where(~F.col("valid") & ~F.col("retriable")).isEmpty()
        again = open_.select("request_id").join(closed.select("request_id"), "request_id", "left_anti")
        last = again.isEmpty()
        if last or attempt == attempts:
            complete = complete and last
            done.append(answers)
            break
        done.append(closed)
        open_ = cut_lineage(open_.join(closed.select("request_id"), "request_id", "left_anti"))
    answered, accepted = reduce(DataFrame.unionByName, done), reduce(DataFrame.unionByName, fresh)
    responses = requests.join(answered.drop("cache_key", "retriable"), "request_id", "left").withColumn("valid", F.coalesce("valid", F.lit(False)))
    entries = accepted.select("cache_key", "response", F.current_timestamp().alias("cached_at"))
    return Answers(responses, entries, complete)


#: Hexadecimal digits of a key's digest that name its bucket.
BUCKET_DIGITS = 1


def cache_bucket(key: str = "cache_key") -> Column:
    return F.substring(F.md5(F.col(key).cast("binary")), 1, BUCKET_DIGITS)


def append_cache(entries: DataFrame, path: str) -> None:
    """Adds entries to the cache under path, in folders by the day of the answer and the bucket of the key."""
    placed = entries.withColumns({"day": F.to_date("cached_at"), "bucket": F.concat(F.lit("b"), cache_bucket())})
    placed.repartition("day", "bucket").write.mode("append").partitionBy("day", "bucket").parquet(path)


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The cache under path; `ask` reads only the days that are fresh and the buckets it has keys in. Empty where there is none."""
    schema = f"{CACHE}, day date, bucket string"
    return spark.read.schema(schema).parquet(path) if names(spark, path) else spark.createDataFrame([], schema)


def fresh_entries(cache: DataFrame, keys: DataFrame) -> DataFrame:
    """Fresh entries of cache for keys(cache_key). Of a cache kept in days and buckets no other day and bucket is read."""
    held = cache.where(is_fresh("cached_at"))
    if {"day", "bucket"} <= set(cache.columns):
        wanted = [r[0] for r in keys.select(F.concat(F.lit("b"), cache_bucket())).distinct().collect()]  # at most 16 ** BUCKET_DIGITS
        held = held.where(F.col("bucket").isin(wanted) & (F.col("day") >= F.date_sub(F.current_date(), CACHE_DAYS + 1)))
    return held.join(keys, "cache_key", "left_semi")


def expire_cache(spark: SparkSession, path: str, days: int = CACHE_DAYS) -> int:
    """Deletes the days whose answers are all older than `days`; how many went."""
    fs, path_of = file_system(spark, path)
    last = spark.range(1).select(F.date_sub(F.current_date(), days + 1).cast("string")).head()[0]
    old = [n for n in names(spark, path) if n.startswith("day=") and n.removeprefix("day=") < last]
    return sum(bool(fs.delete(path_of(f"{path}/{n}"), True)) for n in old)


def profile_clusters(
    items: DataFrame,
    provider: Provider | None = None,
    base: Sequence[str] = (),
    cache: DataFrame | None = None,
    provider_name: str = "frequency",
    size: int = PROFILE_BATCH,
) -> tuple[DataFrame, DataFrame, Answers]:
    """(profiles, rejected batches, answers) for items(cluster_id, pos, item).

    profiles(cluster_id, category, attributes, name_template) holds the clusters whose batches all have a usable
    answer. A cluster with a rejected batch has no profile: a part of its answers would be a wrong one.
    """
    batches = batched(items, size, ["cluster_id"]).withColumn("attributes", strings(base))
    requests = with_keys(batches, "profile", provider_name)
    answers = ask(requests, provider or frequency_profile(), lambda lines: lines.withColumn("valid", profile_is_valid("json")), cache)
    rejected = answers.responses.where("not valid")
    whole = answers.responses if answers.complete else answers.responses.join(rejected.select("cluster_id").distinct(), "cluster_id", "left_anti")
    parsed = whole.select("cluster_id", "batch", parse_profile("json").alias("p"))
    return combine_profiles(parsed.select("cluster_id", "batch", "p.*"), base), rejected, answers


def failed_groups(rejected: DataFrame) -> DataFrame:
    """cluster_id, batches, error: the groups of rejected batches, how many they have, and the error of the first that raised."""
    return rejected.groupBy("cluster_id").agg(
        F.count("*").alias("batches"), F.min_by("error", F.when(F.col("error").isNotNull(), F.col("batch"))).alias("error")
    )


def combine_profiles(profiles: DataFrame, base: Sequence[str] = ()) -> DataFrame:
    """First non-blank category and template over batches; base attributes, then all batches', distinct."""
    def first_of(c: str) -> Column:
        v = non_blank(c)
        return F.min_by(v, F.when(v.isNotNull(), F.col("batch")))

    heads = profiles.groupBy("cluster_id").agg(
        F.coalesce(first_of("category"), F.lit(NO_CATEGORY)).alias("category"),
        F.coalesce(first_of("name_template"), F.lit("")).alias("name_template"),
    )
    named = distinct_in_order(
        profiles.select("cluster_id", F.col("batch"), F.posexplode("attributes").alias("idx", "attr")),
        ["cluster_id"], "attr", F.struct("batch", "idx"), "found",
    )
    return heads.join(named, "cluster_id", "left").select(
        "cluster_id", "category",
        F.array_distinct(F.concat(strings(base), F.coalesce("found", F.array().cast("array<string>")))).alias("attributes"),
        "name_template",
    )


def audit_batches(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Per batch: expected, actual, blank, missing, extra, complete.

    requested(batch_id, item), returned(batch_id, item). Complete means equal counts, no
    blank item, and the same set of names.
    """
    asked = requested.groupBy("batch_id", "item").agg(F.count("*").alias("n_asked"))
    given = returned.groupBy("batch_id", strip_u("item").alias("item")).agg(F.count("*").alias("n_given"))
    both = asked.join(given, ["batch_id", "item"], "full_outer")
    blank = F.col("n_given").isNotNull() & (text_of("item") == "")
    out = both.groupBy("batch_id").agg(
        F.coalesce(F.sum("n_asked"), F.lit(0)).alias("expected"),
        F.coalesce(F.sum("n_given"), F.lit(0)).alias("actual"),
        F.coalesce(F.sum(F.when(blank, F.col("n_given"))), F.lit(0)).alias("blank"),
        F.count_if(F.col("n_given").isNull()).alias("missing"),
        F.count_if(F.col("n_asked").isNull() & ~blank).alias("extra"),
    )
    return out.withColumn(
        "complete", (F.col("expected") == F.col("actual")) & (F.col("blank") == 0) & (F.col("missing") == 0) & (F.col("extra") == 0)
    )


def complete_answers(lines: DataFrame) -> DataFrame:
    """lines(request_id, items, json, ...) with valid: well formed, and exactly the items asked for, as audit_batches
    counts them. A batch holds its items in one line, so nothing moves."""
    given = F.transform(parse_values("json")["normalized"], lambda e: text_of(e["item"]))
    same = (
        (F.size("items") == F.size(given)) & ~F.array_contains(given, "")
        & (F.size(F.array_except("items", given)) == 0) & (F.size(F.array_except(given, F.col("items"))) == 0)
    )
    return lines.withColumn("valid", F.coalesce(values_are_valid("json"), F.lit(False)) & F.coalesce(same, F.lit(False)))


def extract_values(
    items: DataFrame,
    provider: Provider | None = None,
    cache: DataFrame | None = None,
    provider_name: str = "patterns",
    size: int = EXTRACT_BATCH,
    attempts: int = ATTEMPTS,
    groups: Sequence[str] = ("cluster_id",),
) -> tuple[DataFrame, DataFrame, Answers]:
    """(values, rejected batches, answers) for items(cluster_id, pos, item, attributes).

    values(cluster_id, item, values): one map per distinct item name of a cluster, the
    last answer of a repeated name wins. Items of the same groups and the same attribute list share
    batches. A batch whose answer stays incomplete or malformed after all attempts is rejected as a whole.
    """
    keys = list(dict.fromkeys(["cluster_id", *groups, "attributes"]))
    requests = with_keys(batched(items, size, keys), "extract", provider_name)
    answers = ask(requests, provider or pattern_extraction(), complete_answers, cache, attempts)
    good = answers.responses.where("valid").select("cluster_id", "batch", F.posexplode(parse_values("json")["normalized"]).alias("resp_pos", "entry"))
    lines = good.where(non_blank("entry.item").isNotNull()).select(
        "cluster_id", strip_u("entry.item").alias("item"), "batch", "resp_pos", F.map_entries(clean_map("entry.values")).alias("entries")
    )
    values = last_per_key(lines, ["cluster_id", "item"], ["batch", "resp_pos"]).select(
        "cluster_id", "item", F.map_from_entries("entries").alias("values")
    )
    return values, answers.responses.where("not valid"), answers


def missing_attributes(items: DataFrame) -> DataFrame:
    """items + missing: attributes absent or blank in values, in header order."""
    gap = F.filter("attributes", lambda a: (a != "") & (value_of(F.col("values"), a) == ""))
    return items.withColumn("missing", gap)


def missing_attr_groups(items: DataFrame) -> DataFrame:
    """cluster_id, missing, items: how many items lack exactly this list of attributes."""
    return missing_attributes(items).where(F.size("missing") > 0).groupBy("cluster_id", "missing").agg(F.count("*").alias("items"))


def fill_gaps(
    items: DataFrame, provider: Provider | None = None, cache: DataFrame | None = None, provider_name: str = "patterns"
) -> tuple[DataFrame, DataFrame, Answers]:
    """Known items(cluster_id, pos, item, attributes, values): only missing attributes are asked for,
    answers overlay what is known. Returns (cluster_id, pos, item, values), rejected, answers."""
    gaps = cut_lineage(missing_attributes(items))
    wanted = gaps.where(F.size("missing") > 0).select("cluster_id", "pos", "item", F.col("missing").alias("attributes"))
    found, rejected, answers = extract_values(wanted, provider, cache, provider_name)
    out = gaps.join(found.withColumnRenamed("values", "_new"), ["cluster_id", "item"], "left").select(
        "cluster_id", "pos", "item",
        F.map_concat(F.coalesce("values", empty_map()), F.coalesce("_new", empty_map())).alias("values"),
    )
    return out, rejected, answers
