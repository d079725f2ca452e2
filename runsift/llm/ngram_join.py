"""Similarity join of word shingle sets by vertical partitioning.

All shingles have one global order: rare ones first, by a sketch of document frequencies over the whole table, then by
hash. The order is cut into ``fragments``; a document's set falls into a segment in each. For a pair, the overlaps of
segments are counted fragment by fragment, one job each, and added up; a pair goes as soon as all that is left of the smaller
set could not make it a link. So pairs carry the segments of one fragment at a time, and most unlike ones those of the first only.

Pairs to count come from the heads of the sets: with Jaccard similarity ``percent`` / 100 or more, two sets share one of
the first n - ceil(n * percent / 100) + 1 shingles. Sizes and a 512-bit parity signature, whose differing bits are at
most the differing shingles, drop pairs that cannot link. To find all links between groups without listing all pairs of
a group, there are two rounds: first each document is compared with the first document of the bucket it shares most, then
all pairs in a bucket that are not yet in one group. Every link is either verified or between members of one group.

Documents with equal sets form a class that enters once. Empty and null texts link with nothing. Rows of one id count as
one document. Rows with a null id are returned with a null component.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import Steps, chunks, small, summed
from runsift.llm.components import components
from runsift.llm.shingles import mix, shingles, word_hashes

#: Counters of the frequency sketch (2^18, 1 MB: all that is sent to tasks).
SKETCH = 1 << 18
_SIGNATURE = 8  # 64-bit words
#: Rows of a block of a bucket.
BLOCK = 4096


def _sets(batch: pa.RecordBatch, size: int, column: str = "text") -> Iterator[np.ndarray]:
    words, counts = word_hashes([t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()])
    at = 0
    for n in counts.tolist():
        yield shingles(words[at:at + n], size)
        at += n


def frequency_sketch(docs: DataFrame, size: int, text_col: str = "text") -> np.ndarray:
    """How many documents have a shingle of each residue of the hash; summed in two steps over all partitions."""

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        found = list(_sets(batch, size, text_col))
        if found:
            total += np.bincount((np.concatenate(found) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)

    return np.minimum(summed(docs.select(text_col), text_col, SKETCH, add), (1 << 31) - 1).astype(np.uint32)


def fragment_cuts(sketch: np.ndarray, fragments: int) -> np.ndarray:
    """Counts at which the global order is cut, so that fragments hold about equally many shingles."""
    counts = np.sort(sketch)
    load = np.cumsum(counts.astype(np.float64))
    return np.unique(counts[np.searchsorted(load, load[-1] * np.arange(1, fragments) / fragments)]) if load[-1] else counts[:0]


def dealt(rows: DataFrame, members: int, weight: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """Cut buckets (key, id, ...) into blocks of about ``members`` rows (or units of ``weight``), so that every pair of blocks of a bucket
    is one value of (key, i, j): the rows as left (own block i) and as right (own block j) sides. Buckets of one block are not copied."""
    sizes = rows.groupBy("key").agg(F.ceil(F.sum(weight if weight is not None else F.lit(1)) / members).cast("int").alias("blocks"))
    cut = rows.join(sizes, "key").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    return cut.withColumnsRenamed({"own": "i", "other": "j"}), cut.withColumnsRenamed({"own": "j", "other": "i"})


def bucket_links(entries: DataFrame, nodes: DataFrame, near: Callable[[str, str], Column], verify: Callable[[DataFrame], DataFrame],
                 steps: Steps, across: Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """Links (a < b) that join all nodes as all true links would, from buckets (key, id) of possible partners.

    ``nodes`` has a row for each id with what ``near(left, right)``, a cheap necessary condition on prefixed columns, reads;
    ``verify`` keeps the true links of a table of pairs, stored. Every pair that shares a key is verified, fails ``near``, or is
    in one group already. ``across``, if given, gets the mixed buckets (key, id, g) and the pairs
    already compared, and finds the links between groups in their stead. ``entries`` and ``nodes`` must be stored tables; ``entries`` is dropped.
    """
    columns = [c for c in nodes.columns if c != "id"]
    left = nodes.select(F.col("id").alias("a"), *[F.col(c).alias(f"l_{c}") for c in columns])
    right = nodes.select(F.col("id").alias("b"), *[F.col(c).alias(f"r_{c}") for c in columns])
    buckets = entries.groupBy("key").agg(F.count("*").alias("c"), F.min("id").alias("lead")).where("c > 1").drop("c")
    shared = steps.store(entries.join(buckets, "key"), "buckets")
    steps.drop(entries)
    pairs = shared.where("id != lead").groupBy(F.col("lead").alias("a"), F.col("id").alias("b")).agg(F.count("*").alias("n"))
    pairs = pairs.join(left, "a").join(right, "b").where(near("l_", "r_"))
    best = steps.store(pairs.groupBy("b").agg(F.min_by("a", F.struct(-F.col("n"), "a")).alias("a")).select("a", "b"), "first-pairs")
    first = verify(best)
    groups = components(first, steps=steps)
    grouped = shared.select("key", "id").join(groups.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("g", F.coalesce("component", "id")).drop("component")
    grouped = steps.store(grouped, "grouped-buckets")
    steps.drop(shared)
    mixed = grouped.groupBy("key").agg(F.min("g").alias("low"), F.max("g").alias("high")).where("low < high").select("key")
    rest = steps.store(grouped.join(mixed, "key", "left_semi"), "mixed-buckets")
    steps.drop(grouped)
    if across is not None:
        found = across(rest, best)
    else:
        one, two = dealt(rest.join(nodes, "id"), BLOCK)
        one = one.select("key", "i", "j", F.col("id").alias("a"), F.col("g").alias("l_g"), *[F.col(c).alias(f"l_{c}") for c in columns])
        two = two.select("key", "i", "j", F.col("id").alias("b"), F.col("g").alias("r_g"), *[F.col(c).alias(f"r_{c}") for c in columns])
        cross = one.join(two, ["key", "i", "j"]).where((F.col("a") < F.col("b")) & (F.col("l_g") != F.col("r_g")) & near("l_", "r_")).select("a", "b").distinct()
        cross = steps.store(cross.join(best, ["a", "b"], "left_anti"), "cross-pairs")
        found = verify(cross)
        steps.drop(cross)
    links = steps.store(first.unionAll(found), "links")
    steps.drop(best, first, found, rest)
    return links


def jaccard_groups(docs: DataFrame, percent: int = 80, size: int = 5, fragments: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_shingles, component_id: the smallest id reachable over links of Jaccard similarity >= percent / 100."""
    id_type = docs.schema[id_col].dataType.simpleString()
    docs, steps = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), Steps()
    sketch = frequency_sketch(docs, size)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.arange(64, dtype=np.uint64)
        for batch in chunks(batches, "text", 1 << 20):
            sizes, prints, heads, signs = [], [], [], []
            for found in _sets(batch, size):
                n = len(found)
                sizes.append(n)
                prints.append([int(x.astype(np.int64)) for x in (found.sum(dtype=np.uint64), mix(found).sum(dtype=np.uint64))] if n else [0, 0])
                head = n - -(-percent * n // 100) + 1 if n else 0
                order = np.lexsort((found, sketch[(found & np.uint64(SKETCH - 1)).astype(np.int64)]))[:head]
                heads.append(found[order].astype(np.int64))
                places = mix(found) & np.uint64(511)
                parity = (np.bincount(places.astype(np.int64), minlength=512) & 1).astype(np.uint64).reshape(_SIGNATURE, 64)
                signs.append((parity << bits).sum(1, dtype=np.uint64).astype(np.int64))
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(sizes, pa.int64()), pa.array([p[0] for p in prints], pa.int64()), pa.array([p[1] for p in prints], pa.int64()),
                pa.array(heads, pa.list_(pa.int64())), *[pa.array([int(s[k]) for s in signs], pa.int64()) for k in range(_SIGNATURE)],
            ], names=["id", "n", "f1", "f2", "head", *[f"s{k}" for k in range(_SIGNATURE)]])

    signature = ", ".join(f"s{k} bigint" for k in range(_SIGNATURE))
    rows = steps.store(docs.mapInArrow(describe, f"id {id_type}, n bigint, f1 bigint, f2 bigint, head array<bigint>, {signature}"), "shingle-heads")
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))
    reps = rows.join(classes.select(F.col("rep").alias("id"), "n", "f1", "f2"), ["id", "n", "f1", "f2"], "left_semi").dropDuplicates(["id", "n", "f1", "f2"])
    nodes = steps.store(reps.drop("f1", "f2", "head"), "shingle-classes")
    entries = steps.store(reps.select("id", F.explode("head").alias("key")), "shingle-keys")
    prints = steps.store(rows.select("id", "n", "f1", "f2"), "shingle-prints")
    steps.drop(rows)
    classes = prints.where("n > 0 AND id IS NOT NULL").groupBy("n", "f1", "f2").agg(F.min("id").alias("rep"))

    def near(left: str, right: str) -> Column:
        a, b = F.col(f"{left}n"), F.col(f"{right}n")
        apart = sum((F.bit_count(F.col(f"{left}s{k}").bitwiseXOR(F.col(f"{right}s{k}"))) for k in range(_SIGNATURE)), F.lit(0))
        least = F.ceil((a + b) * percent / (100 + percent) - 1e-9)
        return (a * 100 >= b * percent) & (b * 100 >= a * percent) & (apart <= a + b - 2 * least)

    cuts = fragment_cuts(sketch, fragments)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            ids, which, parts, total = [], [], [], []
            for row, found in enumerate(_sets(batch, size)):
                fragment = np.searchsorted(cuts, sketch[(found & np.uint64(SKETCH - 1)).astype(np.int64)])
                order = np.argsort(fragment, kind="stable")
                heads = np.flatnonzero(np.concatenate([[True], np.diff(fragment[order]) > 0])) if len(found) else []
                for part in np.split(found[order], heads[1:]) if len(found) else []:
                    ids.append(row)
                    parts.append(part.astype(np.int64))
                    total.append(len(found))
                which.extend(fragment[order][heads].tolist() if len(found) else [])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(ids, pa.int64())), pa.array(which, pa.int32()), pa.array(total, pa.int64()), pa.array(parts, pa.list_(pa.int64()))],
                                             names=["id", "fragment", "n", "segment"])

    def verify(pairs: DataFrame) -> DataFrame:
        needed = steps.store(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "pair-ids")
        texts = docs.join(small(needed), "id", "left_semi").dropDuplicates(["id"])
        cut = steps.store(texts.mapInArrow(segments, f"id {id_type}, fragment int, n bigint, segment array<bigint>"), "segments", by="fragment")
        sizes = steps.store(cut.groupBy("id").agg(F.max("n").alias("n")), "segment-sizes")
        open_ = pairs.join(small(sizes).select(F.col("id").alias("a"), F.col("n").alias("n_a")), "a").join(small(sizes).select(F.col("id").alias("b"), F.col("n").alias("n_b")), "b")
        open_ = steps.store(open_.select("a", "b", "n_a", "n_b", F.lit(0).cast("bigint").alias("common"), F.col("n_a").alias("left_a"), F.col("n_b").alias("left_b")), "open-pairs")
        steps.drop(needed, sizes)
        for k in range(len(cuts) + 1):
            if open_.isEmpty():
                break
            part, before = cut.where(F.col("fragment") == k), open_
            both = before.join(part.select(F.col("id").alias("a"), F.col("segment").alias("one")), "a", "left").join(part.select(F.col("id").alias("b"), F.col("segment").alias("two")), "b", "left")
            both = both.withColumns({"common": F.col("common") + F.when(F.col("one").isNull() | F.col("two").isNull(), 0).otherwise(F.size(F.array_intersect("one", "two"))),
                                     "left_a": F.col("left_a") - F.when(F.col("one").isNull(), 0).otherwise(F.size("one")),
                                     "left_b": F.col("left_b") - F.when(F.col("two").isNull(), 0).otherwise(F.size("two"))}).select(before.columns)
            most = F.col("common") + F.least("left_a", "left_b")
            open_ = steps.store(both.where(most * 100 >= (F.col("n_a") + F.col("n_b") - most) * percent), "open-pairs")
            steps.drop(before)
        out = steps.store(open_.select("a", "b"), "verified")
        steps.drop(open_, cut)
        return out

    groups = components(bucket_links(entries, nodes, near, verify, steps), steps=steps)
    steps.drop(nodes)
    named = classes.join(groups.select(F.col("node").alias("rep"), "component"), "rep", "left").select("n", "f1", "f2", F.coalesce("component", "rep").alias("component"))
    out = prints.join(named, ["n", "f1", "f2"], "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), F.coalesce("component", "id")).alias("component_id"))
