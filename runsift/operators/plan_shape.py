"""Keeping an expensive column from being computed more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """Compute columns once. The optimizer folds a projection into whatever reads it
    and pushes filters through it; exploding one row keeps the columns apart."""
    rest = [c for c in df.columns if c not in columns]
    out = df.select(*rest, F.explode(F.array(F.struct(*columns))).alias("_s"))
    return out.select(*rest, *[F.col("_s")[c].alias(c) for c in columns])
