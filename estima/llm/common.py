"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from estima.session import ensure_checkpoint_dir

#: Keys with at least rows / HOT_SHARE rows count as hot; so there are at most HOT_SHARE of them.
HOT_SHARE = 1000


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A fresh folder name under the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


#: Bytes of a batch handed to a Python worker, unless the session sets its own.
BATCH_BYTES = 4 << 20
_PER_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Hand texts to Python workers in batches of few bytes: a batch is held several times over, as the
    JVM's buffers, as Arrow and as Python strings. A size that the user has set stays."""
    if spark.conf.get(_PER_BATCH, None) == spark.sparkContext._jvm.org.apache.spark.sql.internal.SQLConf().getConfString(_PER_BATCH, None):
        spark.conf.set(_PER_BATCH, str(BATCH_BYTES))


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back.

    Cuts the lineage, survives lost executors and, unlike ``checkpoint()``, lets later
    reads take single columns. The schema is passed on, so an empty table is read back too.
    """
    folder = shared_folder(df.sparkSession, tag)
    _FOLDERS.append(folder)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


#: Folders of :func:`written` that are still there, in the order in which they were named.
_FOLDERS: list[str] = []


def folders_so_far() -> int:
    return len(_FOLDERS)


def drop_written(spark: SparkSession, first: int = 0) -> None:
    """Remove what :func:`written` has left since there were ``first`` folders: for a caller whose
    result is stored elsewhere."""
    while len(_FOLDERS) > first:
        drop_folder(spark, _FOLDERS.pop())


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Remove a folder that :func:`shared_folder` named."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def release() -> None:
    """Give back what this process holds but no longer uses: a reused Python worker would keep the
    most that any of its tasks has needed."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(fn: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``fn`` over a task's batches, and then :func:`release`."""
    def run(batches: Iterator) -> Iterator:
        try:
            yield from fn(batches)
        finally:
            release()
    return run


def crc32_text(c: Column) -> Column:
    """crc32 of the value written as text; a null counts as the empty text."""
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def least_hashes(rows: DataFrame, most: int, *keys: str) -> DataFrame:
    """About ``most`` rows (never more), those whose hash of ``keys`` is smallest: the same rows however the
    table is split. Only rows below a threshold of the hash are sorted, so no task hands up ``most`` rows of its own."""
    total = rows.count()
    share = (most + 4 * most**0.5 + 16) / max(1, total)
    at = F.xxhash64(*keys)
    if share < 1:
        rows = rows.where(at < F.lit(int(-(1 << 63) + share * (1 << 64))))
    return rows.orderBy(at, *keys).limit(most)


def utf8_bytes(c: Column) -> Column:
    """UTF-8 bytes of a text; a null has none."""
    return F.coalesce(F.octet_length(c).cast("long"), F.lit(0).cast("long"))


def join_unique(left: DataFrame, right: DataFrame, key: str, rows: int, count: str, small: int = 0) -> DataFrame:
    """``left`` left-joined with ``right`` (one row per ``key``; column ``count``: how many
    rows of ``left`` have the key), safe when one key holds a large share of ``left``. Up to
    ``small`` rows (for narrow rows only) all of ``left`` would fit a task: a plain join then.

    The hot keys (``count`` >= rows / HOT_SHARE) are at most HOT_SHARE, so their rows of
    ``right`` are broadcast; the rest is a shuffle join whose largest group is small.
    """
    least = max(2, -(-rows // HOT_SHARE))
    extra = [c for c in right.columns if c not in (key, count)]
    right = right.where(F.col(key).isNotNull())
    if rows <= small:
        return left.join(right.select(key, *extra), key, "left").select(*left.columns, *extra)
    hot = right.where(F.col(count) >= least).select(F.col(key).alias("__hot"), *[F.col(c).alias(f"__{c}") for c in extra])
    got = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left")
    is_hot = F.col("__hot").isNotNull()
    there = got.where(is_hot).select(*left.columns, *[F.col(f"__{c}").alias(c) for c in extra])
    cold = got.where(~is_hot).select(*left.columns).join(right.where(F.col(count) < least).select(key, *extra), key, "left")
    return there.unionByName(cold.select(*left.columns, *extra))


def join_matched(left: DataFrame, right: DataFrame, key: str, rows: int, count: str) -> DataFrame:
    """The rows of :func:`join_unique` that have found one (``count`` says of how many rows). The hot keys
    are named in a filter, so rows without a match meet no broadcast and rows of hot keys no shuffle."""
    least = max(2, -(-rows // HOT_SHARE))
    extra = [c for c in right.columns if c not in (key, count)]
    hot = right.where(F.col(count) >= least).select(key, *extra)
    names = [r[0] for r in hot.where(F.col(key).isNotNull()).select(key).collect()]  # at most HOT_SHARE
    cold = right.where(F.col(count) < least).select(key, *extra)
    is_hot = F.col(key).isin(names)
    there = left.where(is_hot).join(F.broadcast(hot), key)
    return there.unionByName(left.where(~is_hot).join(cold, key)).select(*left.columns, *extra)


def numbered(df: DataFrame, groups: list[str], name: str, weight: str | None = None) -> DataFrame:
    """Adds ``name``: 0, 1, 2, ... gapless within each combination of ``groups``; with
    ``weight`` (a column of whole numbers), the sum of the weights before the row.

    ``df`` must be a written table with a column ``__row`` that ``monotonically_increasing_id``
    gave at the write: its upper bits are the number of the task that wrote the row. Rows are
    numbered per task and group, then shifted by what earlier tasks hold of the group, so no
    window is larger than one task's rows even when one group holds most of the table.
    """
    one = F.col(weight).cast("long") if weight else F.lit(1).cast("long")
    part = df.withColumn("__part", F.shiftright("__row", 33)).withColumn("__w", one)
    counts = part.groupBy("__part", *groups).agg(F.sum("__w").alias("__n"))
    # chunks of tasks bound the window over tasks as well: first within a chunk, then over chunks
    counts = counts.withColumn("__chunk", F.floor(F.col("__part") / 256))
    before = (Window.unboundedPreceding, -1)
    inner = Window.partitionBy(*groups, "__chunk").orderBy("__part").rowsBetween(*before)
    chunks = counts.groupBy(*groups, "__chunk").agg(F.sum("__n").alias("__m"))
    outer = Window.partitionBy(*groups, F.lit(0)).orderBy("__chunk").rowsBetween(*before)
    chunks = chunks.withColumn("__before", F.coalesce(F.sum("__m").over(outer), F.lit(0))).drop("__m")
    offsets = counts.withColumn("__in", F.coalesce(F.sum("__n").over(inner), F.lit(0))).join(
        chunks, [*groups, "__chunk"]).select("__part", *groups, (F.col("__in") + F.col("__before")).alias("__first"))
    own = Window.partitionBy("__part", *groups).orderBy("__row").rowsBetween(*before)
    ranked = part.withColumn("__k", F.coalesce(F.sum("__w").over(own), F.lit(0)))
    return ranked.join(offsets, ["__part", *groups]).withColumn(
        name, (F.col("__k") + F.col("__first")).cast("long")).drop("__part", "__k", "__first", "__w")
