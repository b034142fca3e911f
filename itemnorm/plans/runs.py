"""Long runs in pieces: results and done markers on disk, resume, restart, summary."""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from itemnorm.model import ALIASES, CLUSTERS, ITEMS, MEMBERS, ROWS, Catalogue
from itemnorm.operators.ordering import running_sum
from itemnorm.plans.normalize import input_sizes, normalize
from itemnorm.session import cut_lineage, scratch_path, scratch_run
from itemnorm.sources.commits import names, put_if_absent

SCHEMAS = {"clusters": CLUSTERS, "rows": ROWS, "aliases": ALIASES, "members": MEMBERS, "items": ITEMS}
#: Bundles of slices in work at a time. A small slice keeps few cores busy, and most of its time goes into starting jobs.
SLICES_AT_ONCE = 4
#: Neighbouring slices that share their jobs: so many, and with more than one slice so many items, at most.
BUNDLE_SLICES, BUNDLE_ITEMS = 8, 250_000
NORMALIZED = "cluster_id bigint, item_pos bigint, item string, enriched_name string, values map<string,string>, source string"


class RunStore:
    """Results of finished clusters under one folder.

        <path>/save-<id>/<table>   what one save holds
        <path>/done-<id>           appears last and whole, when all of it is there

    Slices worked on together are written together, as save-<id>/<table>/slice=<n>, and each counts by its own done-<id>-<n>.
    A save without its done file is never read, so one that died half-way leaves nothing behind, and a cluster counts as done
    only when all of it is there. A save reads no other save.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def saves(self) -> list[str]:
        """Ids of the saves that count."""
        return sorted(n.removeprefix("done-") for n in names(self.spark, self.path) if n.startswith("done-"))

    def _read(self, part: str, schema: str) -> DataFrame:
        saves = self.saves()
        if not saves:
            return self.spark.createDataFrame([], f"{schema}, save_id string")
        folders, sliced = [], defaultdict(list)
        for save_id in saves:
            first, _, slice_ = save_id.partition("-")
            if slice_:
                sliced[f"{self.path}/save-{first}/{part}"].append(f"slice={slice_}")
            else:
                folders.append(f"{self.path}/save-{first}/{part}")
        for folder, wanted in sliced.items():
            folders += [f"{folder}/{n}" for n in sorted(set(wanted) & set(names(self.spark, folder)))]  # a slice without a row has no folder
        if not folders:
            return self.spark.createDataFrame([], f"{schema}, save_id string")
        file = F.col("_metadata.file_path")
        first = F.regexp_extract(file, r"/save-([0-9a-f]+)/[^/]+/(?:slice=\d+/)?[^/]+$", 1)
        slice_ = F.nullif(F.regexp_extract(file, r"/slice=(\d+)/[^/]+$", 1), F.lit(""))
        return self.spark.read.schema(schema).parquet(*folders).withColumn("save_id", F.concat_ws("-", first, slice_))

    def save(self, collapsed: Catalogue, normalized: DataFrame) -> str:
        save_id = uuid.uuid4().hex
        parts = {p: getattr(collapsed, p) for p in SCHEMAS} | {"normalized": normalized}
        for part, df in parts.items():
            df.write.parquet(f"{self.path}/save-{save_id}/{part}")
        put_if_absent(self.spark, f"{self.path}/done-{save_id}", {"tables": sorted(parts)})
        return save_id

    def save_slices(self, collapsed: Catalogue, normalized: DataFrame, plan: DataFrame, parts: Sequence[int]) -> list[str]:
        """Saves the slices `parts` of plan(cluster_id, part), written in one job per table; each is a save by itself."""
        save_id = uuid.uuid4().hex
        tables = {p: getattr(collapsed, p) for p in SCHEMAS} | {"normalized": normalized}
        for table, df in tables.items():
            placed = df.join(plan.select("cluster_id", F.col("part").alias("slice")), "cluster_id")
            placed.repartition("slice").write.partitionBy("slice").parquet(f"{self.path}/save-{save_id}/{table}")
        saves = [f"{save_id}-{part}" for part in parts]
        for each in saves:
            put_if_absent(self.spark, f"{self.path}/done-{each}", {"tables": sorted(tables)})
        return saves

    def done(self) -> DataFrame:
        """cluster_id, save_id: a cluster saved twice counts by one of its saves."""
        return self._read("clusters", CLUSTERS).groupBy("cluster_id").agg(F.max("save_id").alias("save_id"))

    def results(self) -> tuple[Catalogue, DataFrame]:
        done = self.done()
        read = lambda part, schema: self._read(part, schema).join(done, ["cluster_id", "save_id"], "left_semi").drop("save_id")
        return Catalogue(**{p: read(p, s) for p, s in SCHEMAS.items()}), read("normalized", NORMALIZED)

    def pending(self, clusters: DataFrame) -> DataFrame:
        """Clusters not finished yet."""
        return clusters.join(self.done().select("cluster_id"), "cluster_id", "left_anti")

    def restart(self) -> "RunStore":
        """A store that has seen nothing: a new folder, earlier results stay unread."""
        return RunStore(self.spark, f"{self.path}-{uuid.uuid4().hex}")


def only_clusters(catalogue: Catalogue, clusters: DataFrame) -> Catalogue:
    keep = clusters.select("cluster_id")
    return Catalogue(*[getattr(catalogue, p).join(keep, "cluster_id", "left_semi") for p in SCHEMAS])


class Slices:
    """A catalogue written once, every table partitioned by slice, so that a slice is read without the rest."""

    def __init__(self, catalogue: Catalogue, plan: DataFrame) -> None:
        """plan(cluster_id, part): clusters without a line are left out."""
        self.spark = plan.sparkSession
        self.path = scratch_path(self.spark, "slices")
        for table in SCHEMAS:
            rows = getattr(catalogue, table).join(plan.select("cluster_id", "part"), "cluster_id")
            # Rows of a slice lie in few files, and a slice of one huge cluster in as many as it needs.
            order = ["part", "cluster_id", *(c for c in ("row_pos", "item_pos") if c in rows.columns)]
            rows.repartitionByRange(*order).write.partitionBy("part").parquet(f"{self.path}/{table}")

    def read(self, *parts: int) -> Catalogue:
        def table(name: str) -> DataFrame:
            held = set(names(self.spark, f"{self.path}/{name}"))
            folders = [f"{self.path}/{name}/part={part}" for part in parts if f"part={part}" in held]
            if not folders:
                return self.spark.createDataFrame([], SCHEMAS[name])
            return self.spark.read.schema(SCHEMAS[name]).parquet(*folders)

        return Catalogue(**{name: table(name) for name in SCHEMAS})


def bundled(sizes: Sequence[tuple[int, int]]) -> list[list[int]]:
    """Slices (part, items), in order, in bundles of neighbours that share their jobs. As long as all of them fit,
    there are bundles for SLICES_AT_ONCE threads."""
    most = min(BUNDLE_SLICES, -(-len(sizes) // SLICES_AT_ONCE))
    bundles, held = [], 0
    for part, items in sizes:
        if bundles and len(bundles[-1]) < most and held + items <= BUNDLE_ITEMS:
            bundles[-1].append(part)
            held += items
        else:
            bundles.append([part])
            held = items
    return bundles


def normalize_run(catalogue: Catalogue, store: RunStore, *, slice_items: int = 1_000_000, **how) -> DataFrame:
    """Normalises pending clusters slice by slice and saves each slice; the clusters still pending after it.

    A slice holds whole clusters in id order, about slice_items items of them (one larger cluster is a
    slice by itself). The pending part of the catalogue is written once by slice, and a slice reads its own files only.
    Small neighbouring slices are worked on in the same jobs, as a bundle, because a job costs about the same for one of them as for
    eight; each is still a save by itself. SLICES_AT_ONCE bundles are in work at a time, begun in order; when one fails no further one is begun.
    All intermediate tables of a bundle go once it is saved. A run that dies keeps what it
    saved, loses the bundles in work, and another one goes on from there. Clusters with a batch that had no usable answer are not
    saved and stay pending. how: arguments of normalize.
    """
    with scratch_run(store.spark):
        waiting = store.pending(catalogue.clusters).select("cluster_id")
        sizes = input_sizes(only_clusters(catalogue, waiting)).withColumn("all", F.lit(0))
        upto = running_sum(sizes, ["all"], "cluster_id", "n", "upto")
        plan = cut_lineage(upto.select("cluster_id", "n", F.floor((F.col("upto") - F.col("n")) / slice_items).alias("part")))
        slices = Slices(catalogue, plan)
        bundles = bundled([tuple(row) for row in plan.groupBy("part").agg(F.sum("n")).orderBy("part").collect()])

        @inheritable_thread_target(store.spark)
        def work(parts: list[int]) -> None:
            with scratch_run(store.spark):
                out = normalize(slices.read(*parts), **how)
                if len(parts) == 1:
                    store.save(out.collapsed, out.items)
                else:
                    store.save_slices(out.collapsed, out.items, plan, parts)

        pool = ThreadPoolExecutor(SLICES_AT_ONCE)
        try:
            for bundle in [pool.submit(work, parts) for parts in bundles]:
                bundle.result()
        finally:
            pool.shutdown(cancel_futures=True)
    return store.pending(catalogue.clusters)


def completed_clusters(claimed: DataFrame, clusters: DataFrame) -> DataFrame:
    """Claimed ids that are whole numbers of existing clusters, distinct; claimed(cluster_id string)."""
    ids = claimed.select(F.expr("try_cast(cluster_id as bigint)").alias("cluster_id")).where(F.col("cluster_id").isNotNull())
    return ids.distinct().join(clusters.select("cluster_id"), "cluster_id", "left_semi")


def run_summary(inputs: DataFrame, normalized: DataFrame, clusters: DataFrame, done: DataFrame) -> DataFrame:
    """expected_count, actual_count, remaining_items_count, completed_clusters, is_partial in one line."""
    expected = inputs.agg(F.count("*").alias("expected_count"))
    actual = normalized.agg(F.count("*").alias("actual_count"))
    state = clusters.select("cluster_id").join(done.select("cluster_id").distinct().withColumn("_d", F.lit(True)), "cluster_id", "left").agg(
        F.count_if("_d").alias("completed_clusters"), (F.count_if(F.col("_d").isNull()) > 0).alias("is_partial")
    )
    one = lambda df: df.withColumn("_one", F.lit(1))
    remaining: Column = F.greatest(F.lit(0), F.col("expected_count") - F.col("actual_count"))
    return one(expected).join(one(actual), "_one").join(one(state), "_one").select(
        "expected_count", "actual_count", remaining.alias("remaining_items_count"), "completed_clusters", "is_partial"
    )
