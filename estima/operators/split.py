"""Reproducible split, folds and permutations, all keyed by md5 of a row key.

None of these depend on partitioning or task retries. Global ranks are taken
without a single-partition window: rows are bucketed by a hash prefix, bucket
sizes (a small table) give each bucket's offset, and ``row_number`` runs per
bucket only.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from estima.functions.hashing import hash_bucket, hash_hex
from estima.operators.columns import join_on_keys


def split_train_test(df: DataFrame, key_cols: Sequence[str], test_pct: int = 20,
                     flag_col: str = "is_test") -> DataFrame:
    """Add ``is_test``: true for rows whose key hashes into the first
    ``test_pct`` of 100 buckets (about, not exactly, ``test_pct`` percent)."""
    return df.withColumn(flag_col, hash_bucket(key_cols, 100) < F.lit(test_pct))


def train_rows(df: DataFrame, flag_col: str = "is_test") -> DataFrame:
    return df.where(~F.col(flag_col))


def test_rows(df: DataFrame, flag_col: str = "is_test") -> DataFrame:
    return df.where(F.col(flag_col))


def kfold(df: DataFrame, key_cols: Sequence[str], k: int = 3, fold_col: str = "fold",
          salt: str = "fold") -> DataFrame:
    """Add an integer fold id in ``[0, k)``, hashed from the key."""
    return df.withColumn(fold_col, hash_bucket(key_cols, k, salt).cast("int"))


ROWS_PER_BUCKET = 1_000_000


def prefix_digits(n_rows: int, rows_per_bucket: int = ROWS_PER_BUCKET) -> int:
    """Hex digits of hash prefix so that buckets hold about ``rows_per_bucket`` rows."""
    return int(min(8, max(1, math.ceil(math.log(max(n_rows, 1) / rows_per_bucket, 16)))))


def hash_rank(df: DataFrame, hash_col: str, partition_cols: Sequence[str] = (),
              tie_cols: Sequence[str] = (), rank_col: str = "rank",
              digits: int | None = None) -> DataFrame:
    """1-based rank of each row by ``(hash_col, *tie_cols)`` within ``partition_cols``.

    Equivalent to ``row_number() over (partition by p order by h, ties)`` but the
    sort is split over ``16**digits`` hash-prefix buckets per partition, so no task
    sees more than about rows / 16**digits rows. ``digits=None`` sizes the prefix
    from a row count (about a million rows per bucket). The hash must come from a
    unique key: rows with equal hashes share a bucket.
    """
    if digits is None:
        digits = prefix_digits(df.count())
    p = list(partition_cols)
    b = "__bucket"
    with_b = df.withColumn(b, F.substring(F.col(hash_col), 1, digits))
    counts = with_b.groupBy(*p, b).agg(F.count(F.lit(1)).alias("__n"))
    w_off = (Window.partitionBy(*p).orderBy(b)
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(*p, b, F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__off"))
    w_rn = Window.partitionBy(*p, b).orderBy(F.col(hash_col), *[F.col(c) for c in tie_cols])
    ranked = join_on_keys(with_b, offsets, [*p, b])  # null partition values form a partition
    return ranked.withColumn(rank_col, (F.col("__off") + F.row_number().over(w_rn)).cast("bigint")) \
                 .drop(b, "__off")


def permute_column(df: DataFrame, key_cols: Sequence[str], column: str, repeat: int = 0,
                   seed: int = 0, out_col: str | None = None, digits: int | None = None) -> DataFrame:
    """Shuffle one column across rows, all other columns fixed.

    Row at rank r of ordering A (md5 of the key) receives the value of the row at
    rank r of ordering B (md5 of key|column|seed|repeat): a uniform random
    permutation that is a pure function of the data. Cost: two bucketed ranks and
    one equi-join on rank.
    """
    out_col = out_col or column
    ha, hb = "__ha", "__hb"
    if digits is None:
        digits = prefix_digits(df.count())
    a = hash_rank(df.withColumn(ha, hash_hex(key_cols)), ha, tie_cols=key_cols,
                  rank_col="__ra", digits=digits)
    salt = f"{column}|{seed}|{repeat}"
    b = hash_rank(df.select(*key_cols, column).withColumn(hb, hash_hex(key_cols, salt)), hb,
                  tie_cols=key_cols, rank_col="__rb", digits=digits)
    b = b.select(F.col("__rb"), F.col(column).alias("__perm"))
    joined = a.join(b, a["__ra"] == b["__rb"], "inner")
    cols = [F.col("__perm").alias(out_col) if c == out_col else F.col(c) for c in df.columns]
    if out_col not in df.columns:
        cols.append(F.col("__perm").alias(out_col))
    return joined.select(*cols)


def sorted_rank(df: DataFrame, col: str, rank_col: str = "rank", rows_per_partition: int = 1_000_000,
                n_rows: int | None = None) -> DataFrame:
    """0-based rank of each row by ``col`` over the whole frame (distinct values
    expected), without a single-partition window: range-partition by ``col``
    (partitions are ordered), count rows per partition (one row per partition),
    turn the counts into offsets and number rows within each partition. The ranged frame is
    checkpointed: range bounds are sampled, and both readers must see the same partitions."""
    from pyspark.sql import Window

    from estima.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    n = n_rows if n_rows is not None else df.count()
    parts = max(1, math.ceil(n / rows_per_partition))
    ranged = df.repartitionByRange(parts, F.col(col)).withColumn("__pid", F.spark_partition_id())
    ranged = ranged.checkpoint(eager=True)
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__n"))
    w_off = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = counts.select("__pid", F.coalesce(F.sum("__n").over(w_off), F.lit(0)).alias("__off"))
    w = Window.partitionBy("__pid").orderBy(F.col(col))
    return (ranged.join(F.broadcast(offsets), "__pid")
            .withColumn(rank_col, (F.col("__off") + F.row_number().over(w) - 1).cast("bigint"))
            .drop("__pid", "__off"))
