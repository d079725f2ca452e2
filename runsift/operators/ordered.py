"""Ordered columns that stay parallel when one group is huge.

A plain window sends a whole group to one task. Here a group is cut into chunks
of its order column: the chunk is windowed locally, one summary row per chunk is
windowed across chunks (that table is smaller by the chunk size), and the two are
joined on the chunk key both sides are already partitioned by.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CHUNK = 65_536


def _chunked(df: DataFrame, order: str, chunk: int) -> DataFrame:
    return df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk)))


def _joined(local: DataFrame, heads: DataFrame, keys: Sequence[str]) -> DataFrame:
    cond = [local[k].eqNullSafe(heads[k]) for k in keys] + [local["_chunk"] == heads["_chunk"]]
    extra = [c for c in heads.columns if c not in (*keys, "_chunk")]
    out = local
    return out.join(heads, cond, "left").select(*[local[c] for c in local.columns], *[heads[c] for c in extra])


def running_sum(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str,
                chunk: int = CHUNK) -> DataFrame:
    """Running total of ``value`` in ``order`` (inclusive), per ``keys``."""
    keys = list(keys)
    src = _chunked(df.withColumn("_v", value), order, chunk)
    local = src.withColumn("_local", F.sum("_v").over(
        W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    heads = src.groupBy(*keys, "_chunk").agg(F.sum("_v").alias("_s")).select(
        *keys, "_chunk", F.sum("_s").over(
            W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    out = _joined(local, heads, keys)
    return out.withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0))).drop(
        "_v", "_chunk", "_local", "_before")


def ordinal(df: DataFrame, keys: Sequence[str], order: str, name: str, chunk: int = CHUNK) -> DataFrame:
    """1-based position inside ``keys`` by ``order``."""
    return running_sum(df, keys, order, F.lit(1), name, chunk)


def carry_forward(df: DataFrame, keys: Sequence[str], order: str, value: Column, name: str,
                  chunk: int = CHUNK) -> DataFrame:
    """Latest non-null ``value`` at or before each row, per ``keys``."""
    keys = list(keys)
    src = _chunked(df.withColumn("_v", value), order, chunk)
    local = src.withColumn("_local", F.last("_v", ignorenulls=True).over(
        W.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(W.unboundedPreceding, 0)))
    # every chunk needs a row, also one without a value of its own
    chunks = src.groupBy(*keys, "_chunk").agg(
        F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_t"))
    heads = chunks.select(*keys, "_chunk", F.last("_t", ignorenulls=True).over(
        W.partitionBy(*keys).orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)).alias("_before"))
    out = _joined(local, heads, keys)
    return out.withColumn(name, F.coalesce("_local", "_before")).drop("_v", "_chunk", "_local", "_before")
