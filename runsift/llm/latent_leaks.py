"""Benchmark decontamination by latent semantic retrieval.

Texts are cut into passages of ``WINDOW`` words, weighted by TF-IDF over hashed words. A word in more than a fiftieth of all
stretches of ``STRIDE`` words weighs nothing, unless that were most words of the text. A randomised SVD, distributed over all
passages of the corpus, gives the latent space: one pass sums A'(A R) for a random matrix R, from which the leading right
singular vectors follow on the driver (matrices of fixed size). In it a leak gets its cosine, the highest of the item's passages and the text's around it.
The latent space is a score and no filter, unless ``cosine`` is given: a cosine loses leaks at any useful threshold. Every
item is compared with the text from every ``STRIDE`` words on, 3 ``STRIDE`` words longer than the item: where bit sets show
that too few of an item's words are near, no common subsequence can be long enough (exact, and nearly all pairs end there);
else the longest common subsequence of item and text must cover ``least`` of the item, or ``least_paraphrase`` of it if the
item's answer, its last words, is there too.

Items come in blocks of ``BLOCK_ITEMS``, one pass over the documents each. A document's passages do not meet others, so
there is no shuffle of texts and no group. Null texts and texts or items without words match nothing; repeated rows are
judged alike; items with equal words are each reported. Rows without an id are judged like others.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import chunks, summed
from runsift.llm.shingles import PUNCTUATION, mix, word_hashes

#: Words of a passage and between starts; hashed words; dimensions of the latent space; items of one pass.
WINDOW, STRIDE, TERMS, RANK, BLOCK_ITEMS = 32, 16, 1 << 13, 64, 5000
#: A word in more than one in so many stretches weighs nothing; bits of the word sets that bound a common subsequence.
COMMON, BITS = 50, 1024
_SCALE = 1 << 20


def _terms(words: np.ndarray) -> np.ndarray:
    return (mix(words) & np.uint64(TERMS - 1)).astype(np.int64)


def _passages(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the half passage (STRIDE words of one text) of every word, and the text of every half passage."""
    halves = -(-counts // STRIDE)
    first = np.cumsum(halves) - halves
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(first, counts) + inside // STRIDE, np.repeat(np.arange(len(counts)), halves)


def _texts(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t.lower().encode() if t else b"" for t in batch.column(column).to_pylist()]


def weights_of(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """IDF of hashed words over the passages (here: stretches of STRIDE words) of all documents."""

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        words, counts = word_hashes(_texts(batch, text_col), PUNCTUATION)
        passage, _ = _passages(counts)
        if len(passage):
            grid = np.sort(_grid(words, passage, int(passage[-1]) + 1), axis=1)
            grid[:, 1:][grid[:, 1:] == grid[:, :-1]] = TERMS
            total[:TERMS] += np.bincount(grid.ravel(), minlength=TERMS + 1)[:TERMS]
            total[TERMS] += len(grid)

    sums = summed(docs.select(text_col), text_col, TERMS + 64, add)
    n, seen = int(sums[TERMS]), sums[:TERMS]
    if n <= 10 * COMMON:
        return np.ones(TERMS)
    idf = np.log((n + 1) / (seen + 1))
    order = np.argsort(idf)
    half = idf[order[np.searchsorted(np.cumsum(seen[order]), seen.sum() / 2)]]  # half of all words are rarer
    return np.maximum(0, idf - min(np.log(COMMON), 0.9 * half))


def _grid(words: np.ndarray, passage: np.ndarray, n: int) -> np.ndarray:
    """Hashed words of each stretch, STRIDE a row; TERMS where a text's last one is shorter."""
    out = np.full((n, STRIDE), TERMS, np.int64)
    first = np.searchsorted(passage, np.arange(n))
    out[passage, np.arange(len(words)) - first[passage]] = _terms(words)
    return out


def _projected(grid: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sum of the rows of ``table`` for the words of each stretch."""
    table = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])
    out = table[grid[:, 0]]
    for k in range(1, STRIDE):
        out += table[grid[:, k]]
    return out


def latent_space(docs: DataFrame, weights: np.ndarray, text_col: str = "text", seed: int = 5) -> np.ndarray:
    """TERMS x RANK: leading right singular vectors of the TF-IDF matrix of all passages, times the weights.

    The pass sums Z = A'(A R) in fixed point, so the order of adding does not matter. With A'A close to Z (R'Z)^-1 Z' (Nystroem),
    the singular vectors are those of Z (R'Z)^-1/2.
    """
    random = np.random.default_rng(seed).standard_normal((TERMS, RANK)).astype(np.float32)
    table = (random * weights[:, None]).astype(np.float32)
    weighted = weights.astype(np.float32)

    def add(total: np.ndarray, batch: pa.RecordBatch) -> None:
        words, counts = word_hashes(_texts(batch, text_col), PUNCTUATION)
        passage, _ = _passages(counts)
        if not len(passage):
            return
        grid = _grid(words, passage, int(passage[-1]) + 1)
        norm2 = np.append(weighted ** 2, 0)[grid].sum(1).clip(1e-6)
        latent = _projected(grid, table) / norm2[:, None].astype(np.float32)
        terms = np.where(np.append(weighted, 0)[grid] > 0, grid, TERMS).ravel()
        order = np.argsort(terms.astype(np.int16), kind="stable")  # small integers: a counting sort
        sizes = np.bincount(terms, minlength=TERMS + 1)[:TERMS]
        first = np.cumsum(sizes) - sizes
        often = np.argsort(-sizes, kind="stable")  # the j-th places of all terms that have one, at a time
        sums = np.zeros((TERMS, RANK), np.float32)
        for j in range(int(sizes.max())):
            m = int(np.searchsorted(-sizes[often], -j, side="left"))
            sums[:m] += latent[order[first[often[:m]] + j] // STRIDE]
        total.reshape(TERMS, RANK)[often] += np.rint(sums.astype(np.float64) * (weighted[often][:, None] * _SCALE)).astype(np.int64)

    z = summed(docs.select(text_col), text_col, TERMS * RANK, add).reshape(TERMS, RANK) / _SCALE
    middle = random.T.astype(np.float64) @ z
    values, vectors = np.linalg.eigh((middle + middle.T) / 2)
    root = vectors[:, values > 1e-9 * max(values.max(), 1e-9)]
    half = root / np.sqrt(values[values > 1e-9 * max(values.max(), 1e-9)])
    left = np.linalg.svd(z @ half, full_matrices=False)[0] if half.shape[1] else np.zeros((TERMS, 0))
    space = np.zeros((TERMS, RANK))
    space[:, :left.shape[1]] = left
    return (space * weights[:, None]).astype(np.float32)


def common_subsequence(where: dict[int, int], text: list[int]) -> int:
    """Length of the longest common subsequence; ``where`` maps each word of one side to the bits of its places."""
    rows = 0
    for word in text:
        own = where.get(word, 0)
        if own:
            both = own | rows
            rows = both & ~(both - (rows << 1 | 1))
    return rows.bit_count()


def _places(words: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for i, w in enumerate(words):
        out[w] = out.get(w, 0) | 1 << i
    return out


def _bit_sets(words: np.ndarray, group: np.ndarray, n: int) -> np.ndarray:
    """Set of the words of each group, as bits of their hashes."""
    out = np.zeros((n, BITS // 64), np.uint64)
    bits = (mix(words ^ np.uint64(77)) & np.uint64(BITS - 1)).astype(np.int64)
    np.bitwise_or.at(out, (group, bits // 64), np.uint64(1) << (bits % 64).astype(np.uint64))
    return out


def _spread(sets: np.ndarray, n: int) -> np.ndarray:
    """Union of each set with the ones after it, ``n`` in all."""
    done = 1
    while done < n:
        step = min(done, n - done)
        longer = sets.copy()
        longer[:-step] |= sets[step:]
        sets, done = longer, done + step
    return sets


def leaks(docs: DataFrame, benchmark: DataFrame, cosine: float | None = None, least: float = 0.7, least_paraphrase: float = 0.6, answer_words: int = 8, answer_least: float = 0.75,
          id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each document and item found in it: id_col, item_col, cosine (highest of its passages; at least ``cosine``, if given), coverage (of the item by
    the longest common subsequence), answered (its answer is there), start (first word of the passage)."""
    doc_type, item_type = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col].dataType.simpleString()
    weights = weights_of(docs, text_col)
    space = latent_space(docs, weights, text_col)
    items = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).where("item IS NOT NULL AND text IS NOT NULL")
    blocks = max(1, -(-items.count() // BLOCK_ITEMS))
    parts = []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).collect()
        parts.append(_search(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), [(r[0], r[1]) for r in rows], weights, space, cosine, least,
                             least_paraphrase, answer_words, answer_least, doc_type, item_type))
    return reduce(DataFrame.unionAll, parts).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "cosine", "coverage", "answered", "start")


def _search(docs, items, weights, space, cosine, least, least_paraphrase, answer_words, answer_least, doc_type, item_type) -> DataFrame:
    hashes, counts = word_hashes([t.lower().encode() for _, t in items], PUNCTUATION)
    ends = np.cumsum(counts)
    words = [hashes[e - n:e] for e, n in zip(ends, counts, strict=True)]
    owner, offset, queries = [], [], []
    for i, w in enumerate(words):
        for at in sorted({*range(0, max(1, len(w) - WINDOW + 1), STRIDE), max(0, len(w) - WINDOW)}) if len(w) else ():
            owner.append(i)
            offset.append(at)
            queries.append(space[_terms(w[at:at + WINDOW])].sum(0))
    norm = np.linalg.norm(np.array(queries).reshape(-1, RANK), axis=1)
    targets = (np.array(queries).reshape(-1, RANK) / norm[:, None].clip(1e-9)).astype(np.float32)
    owner, offset = np.array(owner, np.int64), np.array(offset, np.int64)
    first_query = np.searchsorted(owner, np.arange(len(items) + 1))
    own_words = [w.tolist() for w in words]
    places, answers = [_places(w) for w in own_words], [_places(w[-answer_words:]) for w in own_words]
    names = [i for i, _ in items]
    sizes = np.array(counts, np.int64)
    item_sets = _bit_sets(hashes, np.repeat(np.arange(len(items)), counts), len(items))
    reach = -(-(sizes + 3 * STRIDE) // STRIDE)  # stretches that hold what is compared with an item
    by_reach = [(int(r), np.flatnonzero((reach == r) & (sizes > 0))) for r in np.unique(reach[sizes > 0])]
    most_missing = np.floor((1 - min(least, least_paraphrase)) * sizes + 1e-9)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_arrow = None
        for batch in chunks(batches, "text", 1 << 20):
            found, counts_ = word_hashes(_texts(batch, "text"), PUNCTUATION)
            passage, text = _passages(counts_)
            best: dict[tuple[int, int], tuple] = {}
            if len(passage) and len(targets):  # the text compared from stretch k on begins a stretch before, as an item may
                halves = _projected(_grid(found, passage, len(text)), space)
                windows = halves.copy()
                same = text[1:] == text[:-1]
                windows[:-1][same] += halves[1:][same]
                norms = np.linalg.norm(windows, axis=1)
                first_half = np.searchsorted(text, np.arange(len(counts_)))
                first_word = np.cumsum(counts_) - counts_
                sets = _bit_sets(found, passage, len(text))
                before = np.concatenate([sets[:1] & np.uint64(0), sets])
                for r, own in by_reach:
                    absent = ~_spread(before, r)
                    for at in range(0, len(text), 2048):
                        part = absent[at:min(at + 2048, len(text))]
                        for some in np.array_split(own, -(-len(own) // 512)):
                            missing = np.zeros((len(part), len(some)), np.uint16)
                            for k in range(BITS // 64):
                                missing += np.bitwise_count(part[:, k, None] & item_sets[some, k])
                            for w_, q_ in zip(*(x.tolist() for x in np.nonzero(missing <= most_missing[some])), strict=True):
                                row, i, w = int(text[at + w_]), int(some[q_]), at + w_
                                n = len(own_words[i])
                                start = (w - int(first_half[row]) - 1) * STRIDE
                                a, b = max(0, start), min(int(counts_[row]), start + n + 3 * STRIDE)
                                around = found[int(first_word[row]) + a:int(first_word[row]) + b].tolist()
                                cover = common_subsequence(places[i], around) / n
                                if cover >= least_paraphrase:
                                    answered = common_subsequence(answers[i], around) >= answer_least * min(answer_words, n)
                                    here = slice(max(w - 1, int(first_half[row])), min(w - 1 + r, int(np.searchsorted(text, row, "right"))))
                                    close = windows[here] / norms[here, None].clip(1e-9) @ targets[first_query[i]:first_query[i + 1]].T
                                    value = (cover, answered, float(close.max()), a)
                                    if (cover >= least or answered) and (cosine is None or value[2] >= cosine) and value > best.get((row, i), (0,)):
                                        best[row, i] = value
            if item_arrow is None:
                item_arrow = pa.array(names) if names else pa.array([], pa.int64())
            keys = list(best)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc").take(pa.array([k[0] for k in keys], pa.int64())), item_arrow.take(pa.array([k[1] for k in keys], pa.int64())),
                pa.array([min(1.0, best[k][2]) for k in keys], pa.float64()), pa.array([best[k][0] for k in keys], pa.float64()),
                pa.array([bool(best[k][1]) for k in keys], pa.bool_()), pa.array([best[k][3] for k in keys], pa.int64()),
            ], names=["doc", "item", "cosine", "coverage", "answered", "start"])

    return docs.mapInArrow(run, f"doc {doc_type}, item {item_type}, cosine double, coverage double, answered boolean, start bigint")
