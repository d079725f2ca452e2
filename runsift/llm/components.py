"""Connected components of a table of links, by alternating large-star and small-star steps.

Each step is a grouped minimum and a join on the grouped node; the links left at the end join every node to the
smallest of its component. The number of steps grows with the logarithm of the longest path. Links between a node and
itself, repeated links and links with a null end are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import Steps, checkpointed


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, F.col("u") == F.col("k")).select(F.col("v").alias("b"), F.col("m").alias("a")).distinct()


def _small(links: DataFrame) -> DataFrame:
    low = links.groupBy("b").agg(F.min("a").alias("m"))
    moved = links.join(low.select(F.col("b").alias("k"), "m"), F.col("b") == F.col("k")).where("a != m").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return moved.unionAll(low.select("b", F.col("m").alias("a"))).distinct()


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links, sorted, and the smallest node that each can reach."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = at[:len(a)], at[len(a):]
    found = np.arange(len(nodes))
    while True:
        left, right = found[one], found[two]
        apart = left != right
        if not apart.any():
            return nodes, nodes[found]
        one, two = one[apart], two[apart]
        np.minimum.at(found, np.maximum(left, right)[apart], np.minimum(left, right)[apart])
        while True:
            last, found = found, found[found]
            if (last == found).all():
                break


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [*batches]
    if links:
        nodes, found = smallest(*(np.concatenate([x.column(c).to_numpy() for x in links]) for c in ("a", "b")))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(found)], names=["node", "component"])


def components(links: DataFrame, a: str = "a", b: str = "b", steps: Steps | None = None, at_once: int = 0) -> DataFrame:
    """node, component (smallest node reachable) for every node that some link has. With ``steps``, each step's links are a table
    there, dropped after the next one; the last stays. Up to ``at_once`` links between bigint nodes, for which ``steps`` must be given, are
    joined in one task."""
    links = links.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} != {b}").distinct()

    def keep(df: DataFrame) -> DataFrame:
        return checkpointed(df) if steps is None else steps.store(df, "component-links")

    links = keep(links)
    digest = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    before = links.agg(*digest).first()
    if 0 < before[0] <= at_once:
        found = steps.store(links.coalesce(1).mapInArrow(_at_once, "node bigint, component bigint"), "components")
        steps.drop(links)
        return found
    while before[0]:
        last, links = links, keep(_small(_large(links)))
        if steps is not None:
            steps.drop(last)
        now = links.agg(*digest).first()
        if now == before:
            break
        before = now
    return links.select(F.col("b").alias("node"), F.col("a").alias("component")).unionAll(links.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
