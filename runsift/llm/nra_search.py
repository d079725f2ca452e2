"""Ranked lexical search by NRA (no random access) over impact-sorted lists.

Terms are runs of characters other than ASCII separators (everything in ASCII but letters and digits), with only A-Z in
lower case. A document's part of a score is ``w * ((1000000000*tf) div (1000*tf + 8*m))`` for each term of an item,
repeats included, where ``w = floor(1000*ln((2*N+2)/(2*df+1)))`` and ``m = 100 - 75 + (75*n*N) div L``: N documents have
terms, L terms are in all of them, n in this one, df documents hold the term, tf times it is in this one.

Documents are read once: each row of the index has the length of a document and its counts of the items' terms, which is
all that scores need. N, L and df are counted over all of them. The index is then searched shard by shard, a shard being
a run of index rows of one task with about ``postings`` entries: its entries are sorted by term and falling impact, and for each item the
lists are read in order, in growing blocks. Every document met has a lower bound (what was read of it) and an upper one
(plus the last impact read from each list that has not shown it). An item's reading ends when no document, met or not,
can still enter the ten best or tie with them, and the scores of those that can are fully read. The best of earlier
shards of a task set the bar for later ones; ranks over all tasks come from one window that cuts in every task first.

Items are dealt by hash to blocks of about ``item_chars`` characters, the only rows that come to the driver; a block is
one pass over the documents, so items may be any number.

Null and empty texts have no terms: such a document counts in nothing and such an item returns no rows. Each row is a
document or item of its own, so repeated rows are ranked repeatedly. Documents without an id are ranked, after others of
the same score; items without an id return rows with a null one. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
import string
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runsift.llm.common import chunks, stored

#: Bytes to their place in a term: letters in lower case, separators as a space.
_BYTES = bytes(c if c >= 128 or chr(c) in string.digits + string.ascii_lowercase else c + 32 if chr(c) in string.ascii_uppercase else 32 for c in range(256))


def terms_of(data: bytes) -> list[bytes]:
    """Terms of a UTF-8 text in order."""
    return data.translate(_BYTES).split()


def term_index(docs: DataFrame, terms: dict[bytes, int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n (terms with repeats), terms and tfs (numbers of the given terms the text holds, ascending, and their counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2 << 20):
            found = [terms_of(t or b"") for t in batch.column("text").to_pylist()]
            n = np.array([len(f) for f in found], np.int64)
            number = np.concatenate([np.fromiter(map(terms.get, f, repeat(-1)), np.int64, len(f)) for f in found])
            doc = np.repeat(np.arange(len(found)), n)
            hit = number >= 0
            key, tf = np.unique(doc[hit] * len(terms) + number[hit], return_counts=True)
            ends = np.concatenate([[0], np.searchsorted(key, (np.arange(len(found)) + 1) * len(terms))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("id"), pa.array(n),
                pa.ListArray.from_arrays(pa.array(ends), pa.array((key % max(1, len(terms))).astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(tf.astype(np.int64)))], names=["id", "n", "terms", "tfs"])

    source = docs.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    return source.mapInArrow(run, f"id {docs.schema[id_col].dataType.simpleString()}, n bigint, terms array<int>, tfs array<bigint>")


class Shard:
    """Impact-sorted lists of some documents."""

    def __init__(self, ids: list, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, n_terms: int):
        self.ids = ids
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(n_terms + 1))

    def best(self, item: list[tuple[int, int]], k: int, bar: int, first: int = 64) -> tuple[list[tuple[int, object]], int]:
        """(score, id) of the documents that may be among the ``k`` best of ``item``, a list of (term, weight), given
        that ``k`` documents with a score of at least ``bar`` are known (0: not known); and the number of entries read."""
        lists = [(self.start[t], self.start[t + 1], w) for t, w in item if self.start[t] < self.start[t + 1] and w]
        if not lists:
            return [], 0
        at = np.array([a for a, _, _ in lists])
        end = np.array([b for _, b, _ in lists])
        weight = np.array([w for _, _, w in lists], np.int64)
        head = weight * self.impact[at]
        if head.sum() < bar:
            return [], 0
        lower = np.zeros(len(self.ids), np.int64)
        unread = np.ones((len(self.ids), len(lists)), bool)
        taken, step = 0, first
        while True:
            for j in range(len(lists)):
                to = min(end[j], at[j] + step)
                if to > at[j]:
                    met = self.doc[at[j]:to]
                    lower[met] += weight[j] * self.impact[at[j]:to]
                    unread[met, j] = False
                    taken += len(met)
                    at[j] = to
                    head[j] = weight[j] * self.impact[to - 1] if to < end[j] else 0
            step *= 2
            low = max(bar, int(np.partition(lower, -k)[-k]) if len(lower) >= k else 0, 1)
            rest = int(head.sum())
            open_ = np.flatnonzero(lower + rest >= low)
            gap = unread[open_] @ head
            open_, gap = open_[lower[open_] + gap >= low], gap[lower[open_] + gap >= low]
            # a document not met yet has lower 0 and all of rest as its gap, so it is among the open ones while it matters
            if not gap.any():
                return [(int(lower[d]), self.ids[d]) for d in open_], taken


def _order(hit: tuple[int, object]) -> tuple:
    return -hit[0], hit[1] is None, hit[1] if hit[1] is not None else 0


def _hits(index: DataFrame, wanted: list[list[tuple[int, int]]], n_docs: int, n_all: int, n_terms: int, k: int, postings: int) -> DataFrame:
    """row (number of the item), id, score: the best of each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list[tuple[int, object]]] = [[] for _ in wanted]
        waiting: list[pa.RecordBatch] = []
        held, id_type = 0, pa.null()

        def search_shard() -> None:
            table = pa.Table.from_batches(waiting)
            terms, tfs = (table.column(c).combine_chunks() for c in ("terms", "tfs"))
            lengths = table.column("n").to_pylist()
            m = np.array([25 + 75 * n * n_docs // n_all for n in lengths], np.int64)  # whole numbers of any size
            shard = Shard(table.column("id").to_pylist(), m, np.repeat(np.arange(len(m)), terms.value_lengths().to_numpy()),
                          terms.flatten().to_numpy(), tfs.flatten().to_numpy(), n_terms)
            for row, item in enumerate(wanted):
                bar = best[row][-1][0] if len(best[row]) == k else 0
                found, _ = shard.best(item, k, bar)
                if found:
                    best[row] = sorted(best[row] + found, key=_order)[:k]

        for batch in batches:
            id_type = batch.schema.field("id").type
            for part in _cut(batch, postings):
                size = len(part.column("terms").flatten())
                if waiting and held + size > postings:
                    search_shard()
                    waiting, held = [], 0
                if size:
                    waiting.append(part)
                    held += size
        if waiting:
            search_shard()
        flat = [(row, d, score) for row, hits in enumerate(best) for score, d in hits]
        if flat:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], id_type), pa.array([x[2] for x in flat], pa.int64())],
                                             names=["row", "id", "score"])

    return index.where(F.size("terms") > 0).mapInArrow(run, f"row int, id {index.schema['id'].dataType.simpleString()}, score bigint")


def _cut(batch: pa.RecordBatch, postings: int) -> Iterator[pa.RecordBatch]:
    """Pieces of about ``postings`` entries, and one row at least."""
    ends = np.cumsum(batch.column("terms").value_lengths().to_numpy())
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + postings, side="right")))
        yield batch.slice(at, end - at)
        at = end


def search(docs: DataFrame, items: DataFrame, k: int = 10, postings: int = 1 << 20, item_chars: int = 4 << 20,
           id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_col, rank (1 to ``k``), id_col, score: each item's best documents."""
    spark = docs.sparkSession
    item_type = items.schema[item_col].dataType.simpleString()
    asked = stored(items.select(F.col(item_col).alias("item"), F.encode(F.col(item_text_col), "UTF-8").alias("text")), "search-items")
    blocks = max(1, math.ceil((asked.agg(F.sum(F.length("text"))).first()[0] or 0) / item_chars))
    found = []
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).collect()
        counts = [Counter(terms_of(bytes(r["text"] or b""))) for r in rows]
        terms = {t: i for i, t in enumerate(sorted({t for c in counts for t in c}))}
        index = stored(term_index(docs, terms, id_col, text_col), "search-index")
        n_docs, n_all = index.where("n > 0").agg(F.count("*"), F.sum(F.col("n").cast("decimal(38,0)"))).first()
        df = {r["t"]: r["df"] for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect()}
        weights = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in df}
        wanted = [[(terms[t], weights[terms[t]] * q) for t, q in c.items() if terms[t] in weights] for c in counts]
        names = spark.createDataFrame([(i, r["item"]) for i, r in enumerate(rows)], f"row int, item {item_type}")
        place = Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        ranked = _hits(index, wanted, int(n_docs or 0), int(n_all or 0), len(terms), k, postings).withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k)
        found.append(stored(ranked.join(F.broadcast(names), "row").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score"), "search-hits"))
    return reduce(DataFrame.unionAll, found)
