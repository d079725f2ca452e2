"""Near-duplicate vectors by a pivot-permutation index.

A vector is described by its ``near`` closest pivots, nearest first. Inverted lists hold, for each pivot, the vectors
described by it. Two vectors are candidates when they share at least ``shared`` pivots; they are compared once, in the
list of their first common pivot, and verified by cosine in double precision. Pivots are vectors drawn by hash, about
twice the root of the number of vectors (``most_pivots`` at most), which bounds what is sent to tasks.

Equal vectors form one class, so a group of copies is one entry. Lists are cut into blocks of about ``block`` vectors by
hash, and each pair of blocks is a task of its own, so no list is too long. Tasks emit for each vector its number of
links and the smallest vector joined to it there, never the pairs.

Null vectors, zero vectors and those with null or non-finite components link with nothing; vectors of different lengths
do not link either. Rows of one id count as copies of one vector; a vector with a null id links with nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import stored
from runsift.llm.components import components


def _packed(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, type]:
    """id, vec (bytes of doubles or floats as in the input; null if not usable); the number type."""
    double = vectors.schema[vec_col].dataType.elementType.simpleString() != "float"
    kind = np.float64 if double else np.float32

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column("vec"):
                values = value.values
                good = None
                if values is not None and len(values) and not values.null_count:
                    x = values.to_numpy(zero_copy_only=False).astype(kind)
                    if np.isfinite(x).all() and x.any():
                        good = x.tobytes()
                out.append(good)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "vec"])

    source = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>" if double else "array<float>").alias("vec"))
    return source.mapInArrow(run, f"id {vectors.schema[id_col].dataType.simpleString()}, vec binary"), kind


def _units(rows: list[bytes], kind, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, padded to ``dim``; their lengths."""
    parts = [np.frombuffer(r, kind) for r in rows]
    sizes = np.array([len(p) for p in parts])
    if len(parts) and (sizes == dim).all():
        out = np.array(parts, np.float64)
    else:
        out = np.zeros((len(parts), dim))
        for row, p in zip(out, parts, strict=True):
            row[:min(len(p), dim)] = p[:dim]
    out /= np.abs(out).max(1, keepdims=True).clip(1e-300)
    return out / np.linalg.norm(out, axis=1, keepdims=True).clip(1e-300), sizes


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, near: int = 8, shared: int = 2, most_pivots: int = 1024, block: int = 512,
                    id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, n_links (other vectors linked directly), component_id (smallest id reachable by links), kept (id = component_id)."""
    id_type = vectors.schema[id_col].dataType.simpleString()
    packed, kind = _packed(vectors, id_col, vec_col)
    rows = stored(packed.withColumn("key", F.md5("vec")), "vectors")
    classes = stored(rows.where("vec IS NOT NULL AND id IS NOT NULL").groupBy("key").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.min("vec").alias("vec")), "vector-classes")
    n = classes.count()
    n_pivots = max(1, min(most_pivots, n, max(16, int(2 * n ** 0.5))))
    drawn = [bytes(r[0]) for r in classes.orderBy(F.xxhash64("key"), "key").select("vec").limit(n_pivots).collect()]
    dim = max((len(v) // np.dtype(kind).itemsize for v in drawn), default=1)
    pivots = _units(drawn, kind, dim)[0]
    words = -(-len(drawn) // 64) if drawn else 1
    k = min(near, len(drawn))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, 2048)
                at += 2048
                x, _ = _units([v.as_py() for v in part.column("vec")], kind, dim)
                sims = x @ pivots.T
                closest = np.argsort(-sims, axis=1, kind="stable")[:, :k].astype(np.int32)  # the permutation, cut at its head
                rows_ = np.repeat(np.arange(part.num_rows), k)
                order = pa.FixedSizeListArray.from_arrays(pa.array(closest.ravel()), k).cast(pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(closest.ravel()), *[part.column(c).take(pa.array(rows_)) for c in ("id", "n", "vec")], order.take(pa.array(rows_))],
                                                 names=["pivot", "id", "n", "vec", "pivots"])

    described = classes.select("id", "n", "vec").mapInArrow(describe, f"pivot int, id {id_type}, n bigint, vec binary, pivots array<int>")
    lists = stored(described, "pivot-lists")
    sizes = lists.groupBy("pivot").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))  # a row a pivot: most_pivots at most
    dealt = lists.join(F.broadcast(sizes), "pivot").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")})

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("id")
        pivot = table.column("pivot")[0].as_py()
        ids, mult, own = table.column("id").to_pylist(), table.column("n").to_numpy(), table.column("own").to_numpy()
        raw = table.column("vec").to_pylist()
        x, lengths = _units(raw, kind, max(len(v) // np.dtype(kind).itemsize for v in raw))
        bits = np.zeros((len(ids), words), np.uint64)
        for row, described_ in zip(bits, table.column("pivots").to_pylist(), strict=True):
            for p in described_:
                row[p // 64] |= np.uint64(1 << (p % 64))
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left = np.flatnonzero(own == i)
        right = np.flatnonzero(own == j)
        count = np.zeros((len(left), len(right)), np.uint16)
        earlier = np.zeros((len(left), len(right)), bool)
        for w in range(words):
            both = bits[left, w][:, None] & bits[right, w][None, :]
            count += np.bitwise_count(both)
            if w < pivot // 64:
                earlier |= both != 0
            elif w == pivot // 64:
                earlier |= (both & np.uint64((1 << (pivot % 64)) - 1)) != 0
        found = (count >= min(shared, k)) & ~earlier & (lengths[left][:, None] == lengths[right][None, :])
        links = found & ((x[left] @ x[right].T) >= cosine)
        if i == j:
            np.fill_diagonal(links, False)
        total = np.zeros(len(ids), np.int64)
        total[left] += links @ mult[right]
        if i != j:
            total[right] += links.T @ mult[left]
        low = np.arange(len(ids))
        while True:  # smallest row joined to each, inside this block
            new = low.copy()
            new[left] = np.minimum(new[left], np.where(links, low[right][None, :], len(ids)).min(1, initial=len(ids)))
            new[right] = np.minimum(new[right], np.where(links, low[left][:, None], len(ids)).min(0, initial=len(ids)))
            new = new[new]
            if (new == low).all():
                break
            low = new
        hit = np.flatnonzero((total > 0) | (low != np.arange(len(ids))))
        return pa.table({"id": pa.array([ids[h] for h in hit], table.column("id").type), "links": pa.array(total[hit], pa.int64()),
                         "low": pa.array([ids[h] for h in low[hit]], table.column("id").type)})

    compared = stored(dealt.groupBy("pivot", "i", "j").applyInArrow(compare, f"id {id_type}, links bigint, low {id_type}"), "vector-links")
    joined = components(compared.select(F.col("id").alias("a"), F.col("low").alias("b")))
    linked = compared.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = classes.select("key", "id", "n").join(linked, "id", "left").join(joined.withColumnRenamed("node", "id"), "id", "left").select(
        "key", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = rows.select("id", F.when(F.col("id").isNotNull(), F.col("key")).alias("key")).join(per_class, "key", "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
