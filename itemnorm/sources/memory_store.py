"""Memory of known items on Parquet: points and aliases in folders, and one commit file per version.

    <path>/data-<id>/points   points a version added, sorted by cluster, and their aliases beside them
    <path>/data-<id>/gone     ids whose earlier points a version replaced or removed
    <path>/commit-<n>         the folder of version n, the version it builds on, and whether it holds everything

A small save writes only what it changes; readers put the folders of a chain together, an id's points of a
version counting unless a later version lists the id as gone. Every CHAIN versions one is written
whole. A commit file appears whole, once, and is never overwritten: a writer that started from an older version
than the current one finds that out or finds its number taken, and fails, and data of a job that died is never read. A
commit file that is torn all the same is no version: readers go back to the one before, and its number is left out.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from itemnorm.functions.text import MEMORY_CLUSTER, clean_map, item_id, strip_u, text_of
from itemnorm.model import POINT_ALIASES, POINTS, Memory
from itemnorm.operators.ordering import last_per_key
from itemnorm.session import cut_lineage
from itemnorm.sources.commits import file_system, names, put_if_absent, read_commit

#: Versions that a reader puts together before a save writes everything again.
CHAIN = 8
GONE = "item_id string"


class StaleMemory(RuntimeError):
    """The memory has a newer version than the one the writer started from."""


def _numbers(spark: SparkSession, path: str) -> list[int]:
    """Numbers of all commit files, newest first."""
    tails = [n.removeprefix("commit-") for n in names(spark, path) if n.startswith("commit-")]
    return sorted((int(t) for t in tails if t.isdigit()), reverse=True)


def _held(spark: SparkSession, path: str, version: int) -> dict | None:
    held = read_commit(spark, f"{path}/commit-{version}")
    return held if held and {"folder", "whole"} <= held.keys() else None


def current_version(spark: SparkSession, path: str) -> int:
    """Newest committed version, 0 when there is none."""
    return next((n for n in _numbers(spark, path) if _held(spark, path, n)), 0)


def _commit(spark: SparkSession, path: str, base: int, folder: str, whole: bool) -> int:
    """The number after all others: who read the same list of commits wants the same number, and one of them gets it."""
    number = max(_numbers(spark, path), default=0) + 1
    if current_version(spark, path) != base or not put_if_absent(spark, f"{path}/commit-{number}", {"folder": folder, "whole": whole, "base": base}):
        raise StaleMemory(f"{path} has a newer version than {base}")
    return number


def _chain(spark: SparkSession, path: str, version: int) -> list[tuple[int, str, bool]]:
    """(version, folder, whole) from the given version back to the last whole one."""
    out: list[tuple[int, str, bool]] = []
    while version and not (out and out[-1][2]):
        held = _held(spark, path, version)
        if held is None:
            raise ValueError(f"{version} is no version of {path}")
        out.append((version, held["folder"], held["whole"]))
        version = held.get("base", version - 1)
    return out


def empty_memory(spark: SparkSession) -> Memory:
    return Memory(spark.createDataFrame([], POINTS), spark.createDataFrame([], POINT_ALIASES))


def read_memory(spark: SparkSession, path: str, with_vectors: bool = True, version: int | None = None) -> Memory:
    """The current or the given version; without vectors their columns are never read from disk."""
    chain = _chain(spark, path, current_version(spark, path) if version is None else version)
    if not chain:
        return empty_memory(spark)
    gone = None
    if len(chain) > 1:
        lists = [spark.read.schema(GONE).parquet(f"{path}/{f}/gone").withColumn("_gone", F.lit(v)) for v, f, whole in chain if not whole]
        gone = reduce(DataFrame.unionByName, lists).groupBy("item_id").agg(F.max("_gone").alias("_gone"))

    def part(name: str, schema: str) -> DataFrame:
        frames = [spark.read.schema(schema).parquet(f"{path}/{f}/{name}") for _, f, _ in chain]
        if not with_vectors and name == "points":
            frames = [f.drop("vec_local", "vec_alt") for f in frames]
        if gone is None:
            return frames[0]
        tagged = reduce(DataFrame.unionByName, [f.withColumn("_v", F.lit(v)) for f, (v, _, _) in zip(frames, chain)])
        return tagged.join(gone, "item_id", "left").where(F.col("_gone").isNull() | (F.col("_v") >= F.col("_gone"))).select(*frames[0].columns)

    return Memory(part("points", POINTS), part("aliases", POINT_ALIASES))


def _write(spark: SparkSession, path: str, memory: Memory, gone: DataFrame | None, base: int) -> int:
    """Range partitioning by cluster gives files narrow cluster_name ranges, so a load of one cluster skips
    files by their statistics, and a huge cluster still spans files."""
    folder = f"data-{uuid.uuid4().hex}"
    memory.points.repartitionByRange("cluster_name", "item_id").sortWithinPartitions("cluster_name", "item_id").write.parquet(
        f"{path}/{folder}/points"
    )
    memory.aliases.repartitionByRange("item_id", "alias_pos").sortWithinPartitions("item_id").write.parquet(f"{path}/{folder}/aliases")
    if gone is not None:
        gone.select("item_id").distinct().write.parquet(f"{path}/{folder}/gone")
    return _commit(spark, path, base, folder, gone is None)


def write_memory(spark: SparkSession, path: str, memory: Memory, base: int | None = None) -> int:
    """Writes everything as the next version and returns its number; base: the version the memory was read at."""
    return _write(spark, path, memory, None, current_version(spark, path) if base is None else base)


def _change(spark: SparkSession, path: str, added: Memory, gone: DataFrame, base: int) -> int:
    if not base or len(_chain(spark, path, base)) >= CHAIN:
        old = read_memory(spark, path, version=base)
        out = gone.select("item_id").distinct()
        whole = Memory(*[getattr(old, p).join(out, "item_id", "left_anti").unionByName(getattr(added, p)) for p in ("points", "aliases")])
        return _write(spark, path, whole, None, base)
    return _write(spark, path, added, gone, base)


def save_points(spark: SparkSession, path: str, new_points: DataFrame, new_aliases: DataFrame, replace_cluster: str | None = None, base: int | None = None) -> int:
    """Upsert on disk, after removing the points of replace_cluster; arguments as in memory_upsert."""
    base = current_version(spark, path) if base is None else base
    added = memory_upsert(empty_memory(spark), new_points, new_aliases)
    added = Memory(cut_lineage(added.points), added.aliases)
    gone = added.points.select("item_id")
    if replace_cluster is not None:
        gone = gone.union(_ids(read_memory(spark, path, with_vectors=False, version=base), _of_cluster(replace_cluster)))
    return _change(spark, path, added, gone, base)


def remove_cluster(spark: SparkSession, path: str, cluster_name: str, base: int | None = None) -> int:
    """Deletes one cluster on disk by listing its ids as gone; how many points that removed."""
    return _remove(spark, path, _of_cluster(cluster_name), base)


def remove_text(spark: SparkSession, path: str, text: str, base: int | None = None) -> int:
    return _remove(spark, path, _of_text(text), base)


def _remove(spark: SparkSession, path: str, doomed: Column, base: int | None) -> int:
    base = current_version(spark, path) if base is None else base
    ids = cut_lineage(_ids(read_memory(spark, path, with_vectors=False, version=base), doomed))
    removed = ids.count()
    if removed:
        _change(spark, path, empty_memory(spark), ids, base)
    return removed


def _ids(memory: Memory, wanted: Column) -> DataFrame:
    return memory.points.where(wanted).select("item_id")


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Deletes data that only versions older than the last `keep` use; how many folders went."""
    fs, path_of = file_system(spark, path)
    numbers = _numbers(spark, path)
    versions = [n for n in numbers if _held(spark, path, n)]
    chains = [line for v in versions[:keep] for line in _chain(spark, path, v)]
    used = {folder for _, folder, _ in chains}
    oldest = min((v for v, _, _ in chains), default=1)
    gone = 0
    for version in (n for n in numbers if n < oldest):
        held = _held(spark, path, version)
        if held and held["folder"] not in used:
            gone += bool(fs.delete(path_of(f"{path}/{held['folder']}"), True))
        fs.delete(path_of(f"{path}/commit-{version}"), False)
    return gone


def clear_memory(spark: SparkSession, path: str) -> bool:
    """Makes an empty version current; tells whether there was anything before."""
    base = current_version(spark, path)
    had = not read_memory(spark, path, with_vectors=False, version=base).points.isEmpty()
    if base:
        write_memory(spark, path, empty_memory(spark), base)
    return had


def memory_scan(memory: Memory) -> DataFrame:
    return memory.points.drop("vec_local", "vec_alt")


def cluster_label(c: str = "cluster_name") -> F.Column:
    """Stripped cluster name, the default name where blank."""
    return F.coalesce(F.nullif(text_of(c), F.lit("")), F.lit(MEMORY_CLUSTER))


def parse_memory(memory: Memory, strict: bool = True) -> Memory:
    """Clean payloads; strict drops points without attributes and their aliases."""
    points = memory.points
    if strict:
        points = points.where(F.coalesce(F.size("attributes"), F.lit(0)) > 0)
    points = points.select(
        "item_id",
        text_of("text").alias("text"),
        F.coalesce(F.col("attributes"), F.create_map().cast("map<string,string>")).alias("attributes"),
        cluster_label().alias("cluster_name"),
        _non_blank_map("attribute_merge").alias("attribute_merge"),
        _non_blank_map("attribute_merge_separators").alias("attribute_merge_separators"),
        *[c for c in ("vec_local", "vec_alt") if c in points.columns],
    )
    aliases = memory.aliases.select(
        "item_id",
        "alias_pos",
        strip_u("alias").alias("alias"),
        F.when(F.col("values").isNotNull(), clean_map("values")).alias("values"),
    ).where(F.length("alias") > 0)
    if strict:
        aliases = aliases.join(points.select("item_id"), "item_id", "left_semi")
    return Memory(points, aliases)


def _non_blank_map(c: str) -> F.Column:
    return F.map_filter(clean_map(c), lambda _, v: F.length(v) > 0)


def memory_load(memory: Memory, cluster_name: str) -> Memory:
    """Points of one cluster; the default cluster also holds those without a name, a blank name none."""
    name = cluster_name.strip()
    wanted = (F.col("cluster_name") == name) & F.lit(bool(name))
    if name == MEMORY_CLUSTER:
        wanted = wanted | (text_of("cluster_name") == "")
    points = memory.points.where(wanted)
    return Memory(points, memory.aliases.join(points.select("item_id"), "item_id", "left_semi"))


def memory_stats(memory: Memory) -> DataFrame:
    return memory.points.agg(
        F.count("*").alias("points_count"), F.coalesce(F.max(F.size("vec_local")), F.lit(0)).alias("vector_size")
    )


def cluster_names(memory: Memory) -> DataFrame:
    return memory.points.select(cluster_label().alias("cluster_name")).distinct()


def memory_upsert(memory: Memory, new_points: DataFrame, new_aliases: DataFrame) -> Memory:
    """New points replace old ones with the same id entirely; in one batch the last wins.

    new_points(save_pos, text, attributes, cluster_name, merge maps, vec_local, vec_alt),
    new_aliases(save_pos, alias_pos, alias, values).
    """
    last = last_per_key(new_points.withColumn("item_id", item_id("text")), ["item_id"], ["save_pos"])
    fresh = last.select(
        "item_id",
        "text",
        F.coalesce("attributes", F.create_map().cast("map<string,string>")).alias("attributes"),
        cluster_label().alias("cluster_name"),
        _non_blank_map("attribute_merge").alias("attribute_merge"),
        _non_blank_map("attribute_merge_separators").alias("attribute_merge_separators"),
        "vec_local",
        "vec_alt",
    )
    fresh_aliases = (
        new_aliases.join(last.select("save_pos", "item_id"), "save_pos")
        .select("item_id", "alias_pos", strip_u("alias").alias("alias"), "values")
        .where(F.length("alias") > 0)
    )
    gone = fresh.select("item_id")
    return Memory(
        memory.points.join(gone, "item_id", "left_anti").unionByName(fresh),
        memory.aliases.join(gone, "item_id", "left_anti").unionByName(fresh_aliases),
    )


def _without(memory: Memory, doomed: F.Column) -> Memory:
    points = memory.points.where(~doomed)
    return Memory(points, memory.aliases.join(points.select("item_id"), "item_id", "left_semi"))


def _of_cluster(cluster_name: str) -> Column:
    return (cluster_label() == cluster_name.strip()) & F.lit(bool(cluster_name.strip()))


def _of_text(text: str) -> Column:
    return (text_of("text") == text.strip()) & F.lit(bool(text.strip()))


def memory_delete_cluster(memory: Memory, cluster_name: str) -> tuple[Memory, int]:
    """Memory without one cluster, and how many points that removed."""
    doomed = _of_cluster(cluster_name)
    return _without(memory, doomed), memory.points.where(doomed).count()


def memory_delete_text(memory: Memory, text: str) -> tuple[Memory, int]:
    doomed = _of_text(text)
    return _without(memory, doomed), memory.points.where(doomed).count()


def memory_replace_cluster(
    memory: Memory, cluster_name: str, new_points: DataFrame, new_aliases: DataFrame
) -> Memory:
    """Saving one selected cluster: its old points go first, then the upsert."""
    kept, _ = memory_delete_cluster(memory, cluster_name)
    return memory_upsert(kept, new_points, new_aliases)


def memory_reembed(memory: Memory, embed_local, embed_alt=None) -> tuple[Memory, DataFrame]:
    """Vectors computed anew for every point with a text; counters of what happened.

    embed_local / embed_alt: functions DataFrame(text) -> DataFrame(text, vec).
    """
    loose = parse_memory(memory, strict=False)
    kept = loose.points.where(F.length("text") > 0).drop("vec_local", "vec_alt")
    texts = kept.select("text").distinct()
    local = embed_local(texts).withColumnRenamed("vec", "vec_local")
    points = kept.join(local, "text", "left")
    if embed_alt is None:
        points = points.withColumn("vec_alt", F.lit(None).cast("array<double>"))
    else:
        points = points.join(embed_alt(texts).withColumnRenamed("vec", "vec_alt"), "text", "left")
    points = points.select(*[f.split(" ")[0] for f in POINTS.split(", ")])
    renewed = Memory(points, loose.aliases.join(kept.select("item_id"), "item_id", "left_semi"))
    counters = loose.points.agg(
        F.count_if(F.length("text") > 0).alias("migrated"), F.count_if(F.length("text") == 0).alias("skipped")
    )
    return renewed, counters
