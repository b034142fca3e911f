"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from itemnorm.session import configure

WORD_PATTERN = r"[^ \t-\r]+"  # [^\x20\x09-\x0D]+ in Java's and RE2's spelling

BATCH_ROWS = 500


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """So many rows in an Arrow batch for jobs that run inside."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def prepare(spark: SparkSession) -> SparkSession:
    """Settings for long texts: far fewer rows in an Arrow batch than Spark's default."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def text_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """One output batch per input batch; rows never move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield fn(batch)

    return df.mapInArrow(run, schema)


def id_type(df: DataFrame, name: str = "item_id") -> str:
    return df.schema[name].dataType.simpleString()


def hash_place(*columns: Column | str) -> Column:
    """A hash from 0 to 2**63 - 1, by which a bounded sample is chosen."""
    return F.shiftrightunsigned(F.xxhash64(*columns), 1)


def hash_bound(total: int, wanted: float) -> int:
    """Largest hash_place of about `wanted` of `total` rows."""
    top = 2**63 - 1
    return top if total <= wanted else int(top * (wanted / total))


def spread_join(rows: DataFrame, keyed: DataFrame, keys: list[str], by: str, salts: int = 16) -> DataFrame:
    """rows joined with `keyed`, one line per key, so that a hot key's rows are dealt over `salts` tasks by column `by`."""
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int"))
    copies = keyed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*keys, "_salt"]).drop("_salt")


def dense_number(df: DataFrame, keys: list[str], order: list[Column], out: str, salts: int | Column = 64) -> DataFrame:
    """0-based number inside each key without a task that holds a whole key.

    Rows are numbered inside `salts` hashed parts of a key (a column: so many of that key), and a part starts where the parts before it
    end. Which row gets which number is fixed by the row's own values, so a retry numbers alike. The
    order is total inside a part, not across parts.
    """
    from pyspark.sql import Window

    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    inside = Window.partitionBy(*keys, "_salt").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = salted.groupBy(*keys, "_salt").agg(F.count("*").alias("_n")).select(
        *keys, "_salt", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")
    )
    joined = salted.withColumn("_inside", F.row_number().over(inside) - 1)
    same = joined["_salt"] == starts["_salt"]
    for key in keys:
        same = same & joined[key].eqNullSafe(starts[key])
    kept = [joined[c] for c in df.columns]
    return joined.join(starts, same).select(*kept, (F.col("_start") + F.col("_inside")).alias(out))
