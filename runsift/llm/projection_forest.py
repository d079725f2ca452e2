"""Approximate nearest neighbours by a forest of random-projection trees.

Nearness is the inner product in double precision. Vectors get one more component, the root of what their squared length
lacks to the largest one's, so that the nearest of a query by inner product are the nearest by angle (for unit vectors
nothing changes). A node of a tree splits at the median of the projections on a random direction; directions and medians
come from at most ``sample`` vectors drawn by hash, so a forest has a bounded size, and every vector is dealt to its leaf
of every tree.

A query searches all trees through one priority queue: the node with the least total of squared distances to the
splitting planes that were crossed is taken next, whatever its tree, until ``pops`` leaves are reached. The candidates in
these leaves are ranked again by their exact product, in double precision, added up from the first component on. ``pops``
is not given but measured: up to ``checks`` queries drawn by hash are answered by brute force over all vectors, and the
least number of leaves is taken that holds ``recall`` of their neighbours.

Equal vectors are one class, of which the ``k + 1`` smallest ids can be among a query's ``k`` nearest, so groups of copies
are one entry, and equal queries are searched once. Leaves are compared in blocks of at most about ``block`` vectors by as many
queries. A block gives for each query its ``k + 1`` best at most, and none below what the query is known to
reach within the sample: pairs of a leaf are never listed.

Vectors that are null, empty, zero or hold null or non-finite components take no part, nor do rows without an id. Of
several rows of one id the smallest vector counts. Vectors of different lengths are not compared. A query with fewer
candidates returns all of them, without any no row. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsift.llm.common import small, stored

#: Values that one step of a task holds at a time.
STEP = 1 << 22


@dataclass
class Forest:
    """Trees of one vector length, nodes in heap order; a leaf's number is its node's less the number of inner nodes."""

    normals: np.ndarray  # tree, node, component
    offsets: np.ndarray  # tree, node
    largest: float  # length of the longest vector
    sample: np.ndarray  # the vectors it was fitted on
    dealt: np.ndarray  # their leaves: vector, tree

    @property
    def depth(self) -> int:
        return (self.offsets.shape[1] + 1).bit_length() - 1

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """Vectors in units of the longest, with the component that makes all of them equally long."""
        x = x / self.largest
        return np.concatenate([x, np.sqrt(np.clip(1 - (x * x).sum(1), 0, None))[:, None]], axis=1)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector (row) in each tree (column)."""
        x = self.lifted(x)
        out = np.zeros((len(x), len(self.normals)), np.int64)
        for t in range(len(self.normals)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, self.normals[t][node]) > self.offsets[t][node])
            out[:, t] = node - self.offsets.shape[1]
        return out

    def visits(self, query: np.ndarray, pops: int, sizes: np.ndarray | None = None, least: int = 0) -> list[tuple[int, int]]:
        """The first ``pops`` (tree, leaf) reached by one priority queue over all trees, and more until the leaves of one
        tree have ``least`` vectors by ``sizes`` (tree, leaf)."""
        q = query / np.abs(query).max()
        side = self.normals @ np.append(q / np.linalg.norm(q), 0.0) - self.offsets  # of unit length: the angle decides
        inner = self.offsets.shape[1]
        heap = [(0.0, t, 0) for t in range(len(self.normals))]
        out: list[tuple[int, int]] = []
        held = [0] * len(self.normals)
        while heap and (len(out) < pops or max(held) < least):
            crossed, t, node = heapq.heappop(heap)
            while node < inner:
                s = float(side[t, node])
                near = 2 * node + 1 + int(s > 0)
                heapq.heappush(heap, (crossed + s * s, t, 4 * node + 3 - near))
                node = near
            out.append((t, node - inner))
            if sizes is not None:
                held[t] += int(sizes[t, node - inner])
        return out


def fit(sample: np.ndarray, largest: float, leaves: int, trees: int, seed: int) -> Forest:
    """Trees over the vectors of ``sample`` with up to ``leaves`` leaves (a power of two) each."""
    depth = max(0, min(leaves, max(1, len(sample) // 16)).bit_length() - 1)
    rng = np.random.default_rng([seed, sample.shape[1]])
    normals = rng.normal(size=(trees, 2 ** depth - 1, sample.shape[1] + 1))
    normals /= np.linalg.norm(normals, axis=2, keepdims=True)
    forest = Forest(normals, np.zeros((trees, 2 ** depth - 1)), largest, sample, np.zeros((len(sample), trees), np.int64))
    x = forest.lifted(sample)
    for t in range(trees):
        node = np.zeros(len(x), np.int64)
        for level in range(depth):
            at = (x * normals[t][node]).sum(1)
            for n in range(2 ** level - 1, 2 ** (level + 1) - 1):
                own = at[node == n]
                forest.offsets[t, n] = np.median(own) if len(own) else 0.0
            node = 2 * node + 1 + (at > forest.offsets[t][node])
        forest.dealt[:, t] = node - (2 ** depth - 1)
    return forest


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products row by row, added up from the first component on."""
    return np.add.accumulate(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one length."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return array.flatten().to_numpy(zero_copy_only=False).reshape(len(array), -1)


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """Pieces of rows whose vectors have the same length, of about STEP values."""
    lengths = batch.column("vec").value_lengths().to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        for at in range(0, len(rows), max(1, STEP // max(1, int(n)))):
            yield int(n), batch.take(pa.array(rows[at:at + max(1, STEP // max(1, int(n)))]))


def best(queries: np.ndarray, there: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, product): at least each query's ``k`` best vectors of ``there``, of equal ones the first, and none below its floor."""
    scores = queries @ there.T
    low = np.maximum(floor, np.partition(scores, -k, axis=1)[:, -k]) if len(there) > k else floor
    row, col = np.nonzero(scores >= (low - 1e-9 * np.maximum(1.0, np.abs(low)))[:, None])  # blocked products may differ in their last bits
    if len(row) <= 4 * k * len(queries):
        return row, col, products(queries[row], there[col])
    scores = np.zeros_like(scores)
    for j in range(queries.shape[1]):  # many ties: all products in the same order of addition
        scores += queries[:, j, None] * there[None, :, j]
    col = np.argsort(-scores, axis=1, kind="stable")[:, :k]
    row = np.repeat(np.arange(len(queries)), col.shape[1])
    found = scores[row, col.ravel()]
    keep = found >= floor[row] - 1e-9 * np.maximum(1.0, np.abs(floor[row]))
    return row[keep], col.ravel()[keep], found[keep]


#: The floor of a query that nothing is known about; lower than any product of usual vectors.
NOTHING = -1e300


def vector_rows(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """id, vec (array<double>), key (hash of vec): one usable vector for each id."""
    usable = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists("vec", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    rows = rows.where(F.coalesce(usable, F.lit(False))).withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))  # no negative zeros
    return rows.groupBy("id").agg(F.min("vec").alias("vec")).withColumn("key", F.xxhash64("vec"))


def vector_classes(rows: DataFrame, k: int, every: int) -> DataFrame:
    """key, vec, cid (smallest id), ids (the k + 1 smallest), asked (an id is divisible by ``every``) of equal vectors."""
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("key", "vec").orderBy("id"))).where(F.col("place") <= k + 1)
    heads = first.groupBy("key", "vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # k + 1 ids at most
    asked = rows.where(F.col("id") % every == 0).select("key", "vec").distinct().withColumn("asked", F.lit(True))
    return heads.join(asked, ["key", "vec"], "left").select("key", "vec", F.col("ids")[0].alias("cid"), "ids", F.coalesce("asked", F.lit(False)).alias("asked"))


def _drawn(classes: DataFrame, most: int, seed: int) -> list[tuple[int, np.ndarray]]:
    """(cid, vec) of up to ``most`` classes drawn by hash; tasks pass on about twice as many."""
    n = classes.count()
    share = min(1.0, 2 * most / max(1, n) + 64 / max(1, n))
    place = F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(1 << 30))
    return [(r["cid"], np.array(r["vec"])) for r in classes.where(place < int(share * (1 << 30))).orderBy(place, "cid").select("cid", "vec").limit(most).collect()]


def _answers(classes: DataFrame, asked: list[tuple[int, np.ndarray]], k: int) -> dict[int, list[tuple[float, int, np.ndarray]]]:
    """Brute force: the ``k`` best (score, class, vector) of a bounded list of queries, other classes only."""
    by_length: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for n in {len(v) for _, v in asked}:
        own = [(c, v) for c, v in asked if len(v) == n]
        by_length[n] = (np.array([c for c, _ in own]), np.array([v for _, v in own]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, part in _by_length(batch):
                if n not in by_length:
                    continue
                ids, queries = by_length[n]
                cids = part.column("cid").to_numpy()
                row, col, score = best(queries, _matrix(part.column("vec")), k + 1, np.full(len(ids), NOTHING))
                other = ids[row] != cids[col]
                row, col, score = row[other], col[other], score[other]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(cids[col]), part.column("vec").take(pa.array(col)), pa.array(score)], names=["query", "cid", "vec", "score"])

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "cid"))
    out: dict[int, list[tuple[float, int, np.ndarray]]] = {}
    for r in classes.select("cid", "vec").mapInArrow(run, "query bigint, cid bigint, vec array<double>, score double").withColumn("place", place).where(F.col("place") <= k).collect():
        out.setdefault(r["query"], []).append((r["score"], r["cid"], np.array(r["vec"])))
    return out


def needed_pops(forests: dict[int, Forest], asked: list[tuple[int, np.ndarray]], answers: dict[int, list[tuple[float, int, np.ndarray]]], recall: float) -> int:
    """The least number of leaves that holds a share ``recall`` of all answers."""
    at = []
    for query, vec in asked:
        hits = answers.get(query, [])
        if not hits:
            continue
        forest = forests[len(vec)]
        order = {leaf: i for i, leaf in enumerate(forest.visits(vec, forest.normals.shape[0] * (forest.offsets.shape[1] + 1)))}
        leaves = forest.leaves(np.array([v for _, _, v in hits]))
        at += [min(order[(t, int(leaf))] for t, leaf in enumerate(row)) for row in leaves]
    return sorted(at)[max(0, int(np.ceil(recall * len(at))) - 1)] + 1 if at else 1


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, trees: int = 8, leaves: int = 256, sample: int = 8192, checks: int = 128, recall: float = 0.95,
            block: int = 4096, seed: int = 11, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found for each id that ``every`` divides."""
    rows = stored(vector_rows(vectors, id_col, vec_col), "forest-rows")
    classes = stored(vector_classes(rows, k, every), "forest-classes")
    drawn = _drawn(classes, sample, seed)
    longest = F.array_max(F.transform("vec", F.abs))
    length = longest * F.sqrt(F.aggregate(F.transform("vec", lambda x: x / longest), F.lit(0.0), lambda a, x: a + x * x))
    lengths = classes.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows"), F.max(length).alias("most")).orderBy(F.desc("rows"), "n").limit(64).collect()
    forests: dict[int, Forest] = {}
    for r in lengths:  # vectors of a rarer length are one leaf
        own = np.array([v for _, v in drawn if len(v) == r["n"]]).reshape(-1, r["n"])
        forests[r["n"]] = fit(own, float(r["most"]), leaves, trees if len(own) else 1, seed)
    asked = [(c, v) for c, v in _drawn(classes.where("asked"), checks, seed + 1) if len(v) in forests]
    pops = needed_pops(forests, asked, _answers(classes, asked, k), recall) if asked else 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, part in _by_length(batch):
                x = _matrix(part.column("vec"))
                found = forests[n].leaves(x) if n in forests else np.zeros((len(x), 1), np.int64)
                for t in range(found.shape[1]):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), n, np.int32)), pa.array(np.full(len(x), t, np.int32)), pa.array(found[:, t].astype(np.int32)), part.column("cid"), part.column("vec")],
                                                     names=["n", "tree", "leaf", "cid", "vec"])

    place = ["n", "tree", "leaf"]
    entries = stored(classes.select("cid", "vec").mapInArrow(deal, "n int, tree int, leaf int, cid bigint, vec array<double>"), "forest-leaves")
    held = {n: np.zeros((f.normals.shape[0], f.offsets.shape[1] + 1), np.int64) for n, f in forests.items()}
    for r in entries.where(F.col("n").isin(list(forests))).groupBy(*place).count().collect():  # leaves of the forests, whose number is a parameter
        held[r["n"]][r["tree"], r["leaf"]] = r["count"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, part in _by_length(batch):
                x = _matrix(part.column("vec"))
                forest = forests.get(n)
                rows, places, floor = [], [], np.full(len(x), NOTHING)
                for i, q in enumerate(x):
                    visits = forest.visits(q, pops, held[n], k + 1) if forest is not None else [(0, 0)]
                    rows += [i] * len(visits)
                    places += visits
                    if forest is not None and len(forest.sample) > k:
                        open_ = np.zeros(held[n].shape, bool)
                        open_[tuple(np.array(visits).T)] = True
                        known = open_[np.arange(len(open_)), forest.dealt].any(1)
                        if known.sum() > k:  # the query itself may be among them
                            floor[i] = np.partition(forest.sample[known] @ q, -(k + 1))[-(k + 1)]
                for at in range(0, len(rows), 1 << 14):
                    own, there = np.array(rows[at:at + (1 << 14)]), np.array(places[at:at + (1 << 14)], np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), n, np.int32)), pa.array(there[:, 0]), pa.array(there[:, 1]), part.column("cid").take(pa.array(own)), part.column("vec").take(pa.array(own)),
                                                      pa.array(floor[own])], names=["n", "tree", "leaf", "cid", "vec", "floor"])

    visits = stored(classes.where("asked").select("cid", "vec").mapInArrow(ask, "n int, tree int, leaf int, cid bigint, vec array<double>, floor double"), "forest-visits")
    sizes = entries.groupBy(*place).agg(F.ceil(F.count("*") / block).alias("across")).join(visits.groupBy(*place).agg(F.ceil(F.count("*") / block).alias("down")), place)
    sizes = small(stored(sizes, "forest-sizes"))  # a row a leaf

    def dealt(df: DataFrame, own: str, other: str) -> DataFrame:
        return df.join(sizes, place).withColumn(f"in_{own}", F.pmod(F.xxhash64("cid"), F.col(own))).withColumn(
            f"in_{other}", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(other) - 1))).drop("across", "down")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 2 + [np.zeros(0)]
        if left.num_rows and right.num_rows:
            right = right.sort_by("cid")
            queries, there = _matrix(left.column("vec")), _matrix(right.column("vec"))
            ids, cids, floor = left.column("cid").to_numpy(), right.column("cid").to_numpy(), left.column("floor").to_numpy()
            parts = []
            for at in range(0, len(ids), 512):
                row, col, score = best(queries[at:at + 512], there, k + 1, floor[at:at + 512])
                parts.append((ids[at + row], cids[col], score))
            out = [np.concatenate(p) for p in zip(*parts, strict=True)]
        return pa.table({"query": pa.array(out[0], pa.int64()), "cid": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    keys = [*place, "in_across", "in_down"]
    left, right = dealt(visits, "down", "across"), dealt(entries, "across", "down")
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(compare, "query bigint, cid bigint, score double")
    hits = stored(hits, "forest-hits").distinct()
    nearest_first = Window.partitionBy("query").orderBy(F.desc("score"), "cid")
    top = hits.withColumn("place", F.row_number().over(nearest_first)).where(F.col("place") <= k + 1)
    named = top.join(classes.select("cid", "ids"), "cid").select("query", "score", F.explode("ids").alias("vec_id"))
    by_id = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    lists = named.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("found"))  # k + 1 at most
    asking = rows.where(F.col("id") % every == 0).join(classes.select("key", "vec", F.col("cid").alias("query")), ["key", "vec"]).select("id", "query")
    own = asking.join(lists, "query").select("id", F.posexplode(F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("id")), 1, k)).alias("rank", "hit"))
    return own.select(F.col("id").alias("query_id"), (F.col("rank") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
