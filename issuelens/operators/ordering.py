"""Consecutive numbering of a sorted DataFrame without a global window.

A window with ORDER BY and no PARTITION BY pulls every row into one task.
Instead: sort (range-partitioned, distributed) and store the sorted rows with
their partition's number, then number rows inside each partition, count rows
per partition (one row per partition), turn those counts into offsets, and
join them back.  The number is stored data: ranges are sampled anew whenever
a sort is planned, so two plans of one sort need not cut it alike, and a
partition id may not be computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from issuelens.session import ensure_checkpoint_dir


def _stored(df: DataFrame, *order_cols: str) -> DataFrame:
    """``df`` sorted and checkpointed in the shared folder, with its partition as ``_pid``."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.sort(*order_cols).withColumn("_pid", F.spark_partition_id()).checkpoint()


def with_index(df: DataFrame, order_cols: list[str], index_col: str = "idx",
               total_col: str | None = None) -> DataFrame:
    """Add a 1-based consecutive ``index_col`` in ``order_cols`` order.

    With ``total_col`` the total row count is attached as well.
    """
    s = _stored(df, *order_cols)
    s = s.withColumn("_local", F.row_number().over(Window.partitionBy("_pid").orderBy(*order_cols)))
    counts = s.groupBy("_pid").agg(F.count(F.lit(1)).alias("_cnt"))
    # one row per partition: a bounded table, so the global window is cheap
    w = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                            F.sum("_cnt").over(Window.partitionBy()).alias("_tot"))
    out = s.join(offsets, "_pid").withColumn(index_col, F.col("_off") + F.col("_local"))
    if total_col:
        out = out.withColumn(total_col, F.col("_tot"))
    return out.drop("_pid", "_local", "_off", "_tot")


def with_key_rank(df: DataFrame, key: str, order_cols: list[str], rank_col: str = "rank") -> DataFrame:
    """1-based rank of every row inside its ``key`` group, in ``order_cols`` order.

    Skew-safe: a global sort range-partitions on ``(key, order)``, so a key
    holding a third of all rows is spread over many partitions.  Each
    partition numbers its rows per key; a table with one row per
    (partition, key) gives every key's offset in each partition, and a join
    adds it back.  No task ever sees more than its own partition.
    """
    s = _stored(df, key, *order_cols)
    s = s.withColumn("_local", F.row_number().over(Window.partitionBy("_pid", key).orderBy(*order_cols)))
    counts = s.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_cnt"))
    # rows per key in this table = partitions the key spans (bounded)
    w = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_pid").alias("_p"), F.col(key).alias("_k"), F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"))
    return (s.join(offsets, (s["_pid"] == offsets["_p"]) & s[key].eqNullSafe(offsets["_k"]))
            .withColumn(rank_col, F.col("_off") + F.col("_local"))
            .drop("_pid", "_p", "_k", "_local", "_off"))


def with_key_running_sum(df: DataFrame, key: str, order_cols: list[str], value_col: str,
                         rank_col: str = "rank", sum_col: str = "running") -> DataFrame:
    """Rank and inclusive running sum of ``value_col`` inside each key (skew-safe).

    Same layout as ``with_key_rank``: per-partition running values plus a
    per-(partition, key) offset table, so a hot key never lands in one task.
    """
    s = _stored(df, key, *order_cols)
    w_local = Window.partitionBy("_pid", key).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
    s = (s.withColumn("_local", F.row_number().over(Window.partitionBy("_pid", key).orderBy(*order_cols)))
         .withColumn("_lsum", F.sum(value_col).over(w_local)))
    per = s.groupBy("_pid", key).agg(F.count(F.lit(1)).alias("_cnt"), F.sum(value_col).alias("_tot"))
    w = Window.partitionBy(key).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per.select(F.col("_pid").alias("_p"), F.col(key).alias("_k"), F.coalesce(F.sum("_cnt").over(w), F.lit(0)).alias("_off"),
                         F.coalesce(F.sum("_tot").over(w), F.lit(0)).alias("_soff"))
    return (s.join(offsets, (s["_pid"] == offsets["_p"]) & s[key].eqNullSafe(offsets["_k"]))
            .withColumn(rank_col, F.col("_off") + F.col("_local"))
            .withColumn(sum_col, F.col("_soff") + F.coalesce(F.col("_lsum"), F.lit(0)))
            .drop("_pid", "_p", "_k", "_local", "_off", "_lsum", "_soff"))
