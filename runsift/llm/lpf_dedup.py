"""Repeated substrings by suffix arrays and longest-previous-factor arrays, over all documents.

Every window of ``least`` bytes has an anchor: of its 64-byte grams the one with the smallest hash, a function of the
window alone. Equal windows have equal anchors, so only windows of one anchor need comparing, and an anchor that occurs
once needs nothing more. The windows of an anchor occurrence form one span of text. Equal spans are counted in one
grouping (they repeat as a whole); the distinct spans of an anchor go to one task, where a suffix array over their bytes is
built by doubling, previous and next smaller positions in suffix order give the longest earlier match of every position,
and windows whose match is ``least`` or longer are repeats.

An anchor whose distinct spans exceed ``GROUP_BYTES`` is not sorted in one task: its windows are counted by hash instead,
which is as exact and has no large groups.

``keep="first"`` keeps the first copy of each window, by (id, position); ``keep="none"`` removes every copy. Matches never
cross documents. Null texts count as empty. Rows of one id count as one document given several times. Rows with a null id
are returned whole and match nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import chunks, stored
from runsift.llm.fuzzy_lines import BROADCAST_LINES
from runsift.llm.shingles import mix

#: Bytes of a gram; bytes of text looked at together; bytes of the spans of one anchor sorted in one task; bytes of one suffix array.
GRAM, PIECE, GROUP_BYTES, ARRAY_BYTES = 64, 1 << 20, 1 << 20, 1 << 18
_BASE = 0x9E3779B97F4A7C15
_LOW = (1 << 24) - 1
_LEVELS = (128, 64, 32, 16, 8)


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = pow(_BASE, -1, 1 << 64)
    return np.cumprod(np.full(n, _BASE, np.uint64)), np.cumprod(np.full(n, inverse, np.uint64))


def _sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of every ``width`` neighbours."""
    n = len(x)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def anchors(texts: list[bytes], least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(text, first window, last window, anchor hash) of each run of windows with one anchor, for pieces of the texts."""
    parts, size = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(0, len(text) - least + 1), PIECE):
            part = text[at:at + PIECE + least - 1]
            if size + len(part) > PIECE and parts:
                yield _anchors(parts, least)
                parts, size = [], 0
            parts.append((row, at, part))
            size += len(part)
    if parts:
        yield _anchors(parts, least)


def _anchors(parts: list[tuple[int, int, bytes]], least: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
    n = len(data)
    up, down = _powers(4 * PIECE)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    grams = mix((sums[GRAM:] - sums[:-GRAM]) * down[:n - GRAM + 1])
    keys = (grams & ~np.uint64(_LOW)) | (np.uint64(_LOW) - np.arange(len(grams), dtype=np.uint64))
    place = _LOW - (_sliding_least(keys, least - GRAM + 1) & np.uint64(_LOW)).astype(np.int64)  # rightmost of equals
    sizes = np.array([len(p[2]) for p in parts])
    starts = np.cumsum(sizes) - sizes
    counts = np.maximum(sizes - least + 1, 0)
    windows = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts, counts)
    part = np.repeat(np.arange(len(parts)), counts)
    place = place[windows]
    heads = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (part[1:] != part[:-1])]))
    tails = np.append(heads[1:], len(windows)) - 1
    shift = np.array([p[1] for p in parts]) - starts
    own = part[heads]
    return np.array([p[0] for p in parts])[own], windows[heads] + shift[own], windows[tails] + shift[own], grams[place[heads]].view(np.int64)


def suffix_ranks(data: np.ndarray) -> tuple[np.ndarray, dict[int, np.ndarray], np.ndarray]:
    """(suffixes in order of their first 256 bytes, ranks by the first 8, 16, ... 128 bytes, first 8 bytes as integers)."""
    n = len(data)
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    words = np.zeros(n, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | padded[k:n + k]
    ranks, length = {}, 8
    order = np.argsort(words)
    rank = np.empty(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], words[order][1:] != words[order][:-1]]))
    while length < 256:
        ranks[length] = rank
        after = np.full(n, -1, np.int64)
        after[:max(0, n - length)] = rank[length:]
        keys = rank * np.int64(n + 1) + after + 1
        order = np.argsort(keys)
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], keys[order][1:] != keys[order][:-1]]))
        length *= 2
    return order, ranks, words


def common_prefix(ranks: dict[int, np.ndarray], words: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Length of the common prefix of suffixes p and q, up to 255; positions below 0 have none."""
    n = len(words)
    bad = (p < 0) | (q < 0)
    p, q = np.where(bad, 0, p), np.where(bad, 0, q)
    off = np.zeros(len(p), np.int64)
    for level in _LEVELS:
        inside = (p + off < n) & (q + off < n)
        a, b = np.minimum(p + off, n - 1), np.minimum(q + off, n - 1)
        off += level * (inside & (ranks[level][a] == ranks[level][b]))
    inside = (p + off < n) & (q + off < n)
    differ = words[np.minimum(p + off, n - 1)] ^ words[np.minimum(q + off, n - 1)]
    for k in range(7):
        off += inside & ((differ >> np.uint64(56 - 8 * k)) == 0)
    return np.where(bad, 0, np.minimum(off, n - np.maximum(p, q)))


def smaller_before(order: np.ndarray) -> np.ndarray:
    """For each place in suffix order, the place before it, nearest, that holds a smaller position; -1 if none.

    Pointers skip places whose positions are larger, all at a time, each turn from pointer to pointer.
    """
    back = np.arange(len(order)) - 1
    todo = np.flatnonzero(back >= 0)
    while len(todo):
        todo = todo[order[back[todo]] > order[todo]]
        back[todo] = back[back[todo]]
        todo = todo[back[todo] >= 0]
    return back


def longest_previous(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By position: the longest match with an earlier position, and with any other, both up to 255."""
    n = len(data)
    order, ranks, words = suffix_ranks(data)
    before = smaller_before(order)
    after = n - 1 - smaller_before(order[::-1])[::-1]
    lpf, any_ = np.zeros(n, np.int64), np.zeros(n, np.int64)
    left = np.where(before >= 0, order[before], -1)
    right = np.where(after < n, order[np.minimum(after, n - 1)], -1)
    lpf[order] = np.maximum(common_prefix(ranks, words, order, left), common_prefix(ranks, words, order, right))
    beside = common_prefix(ranks, words, order[:-1], order[1:])
    any_[order[:-1]] = beside
    any_[order[1:]] = np.maximum(any_[order[1:]], beside)
    return lpf, any_


def _runs(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last of each run of neighbouring integers."""
    cut = np.flatnonzero(np.diff(hits) > 1)
    return hits[np.append(0, cut + 1)], hits[np.append(cut, len(hits) - 1)]


def repeated_spans(docs: DataFrame, least: int = 200, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, start, end (bytes of the UTF-8 text, end exclusive; spans may overlap) of all repeats that go."""
    if not GRAM < least <= 255 or keep not in ("none", "first"):
        raise ValueError(f"least must be in {GRAM + 1}..255 and keep none or first")
    id_type = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where("doc IS NOT NULL")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", PIECE):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            for row, first, last, anchor in anchors(texts, least):
                content = [xxhash.xxh3_64_intdigest(texts[r][a:b]) - (1 << 63) for r, a, b in zip(row.tolist(), first.tolist(), (last + least).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(content, pa.int64()), batch.column("doc").take(pa.array(row)), pa.array(first), pa.array(last - first + least)],
                                                 names=["anchor", "content", "doc", "start", "size"])

    found = docs.mapInArrow(describe, f"anchor bigint, content bigint, doc {id_type}, start bigint, size bigint")
    often = found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor")
    shared = stored(found.join(often, "anchor", "left_semi"), "anchors")
    classes = stored(shared.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(F.struct("doc", "start")).alias("first"), F.min("size").alias("size")), "spans")
    groups = classes.groupBy("anchor").agg(F.count("*").alias("c"), F.min("n").alias("fewest"), F.sum("size").alias("bytes"))
    groups = groups.where("c > 1 AND fewest = 1" if keep == "none" else "c > 1")
    wanted = stored(classes.join(groups, "anchor").select("anchor", "n", "first.doc", "first.start", "size", (F.col("bytes") > GROUP_BYTES).alias("hot")), "distinct-spans")

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", PIECE):
            rows, out = [], {"anchor": [], "n": [], "start": [], "hot": [], "span": []}
            for row, (text, spans) in enumerate(zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist(), strict=True)):
                for s in spans:
                    rows.append(row)
                    for name in ("anchor", "n", "start", "hot"):
                        out[name].append(s[name])
                    out["span"].append(text[s["start"]:s["start"] + s["size"]])
            yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["n"], pa.int64()), batch.column("doc").take(pa.array(rows, pa.int64())), pa.array(out["start"], pa.int64()),
                                              pa.array(out["hot"], pa.bool_()), pa.array(out["span"], pa.binary())], names=["anchor", "n", "doc", "start", "hot", "span"])

    listed = wanted.groupBy("doc").agg(F.collect_list(F.struct("anchor", "n", "start", "size", "hot")).alias("spans"))  # at most a document's own spans
    listed = F.broadcast(listed) if wanted.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else listed
    spans = docs.join(listed, "doc").mapInArrow(pick, f"anchor bigint, n bigint, doc {id_type}, start bigint, hot boolean, span binary").dropDuplicates(["anchor", "doc", "start"])
    spans = stored(spans, "span-texts")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Spans come in order of anchor; some anchors at a time."""
        parts, size, last = [], 0, None
        for batch in batches:
            anchor, weights = batch.column("anchor").to_numpy(), pa.compute.binary_length(batch.column("span")).to_numpy()
            at = 0
            for end in [*(np.flatnonzero(anchor[1:] != anchor[:-1]) + 1).tolist(), batch.num_rows]:
                if end <= at:
                    continue
                if size > ARRAY_BYTES and last != anchor[at]:
                    yield _matches(parts, least, keep)
                    parts, size = [], 0
                parts.append(batch.slice(at, end - at))
                size, last, at = size + int(weights[at:end].sum()), anchor[at], end
        if parts:
            yield _matches(parts, least, keep)

    result = f"doc {id_type}, start bigint, end bigint"
    sorted_ = spans.where("NOT hot").drop("hot").repartition("anchor").sortWithinPartitions("anchor").mapInArrow(compare, result)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "span", 1 << 18):
            rows, starts, hashes = [], [], []
            for row, (span, start) in enumerate(zip(batch.column("span").to_pylist(), batch.column("start").to_pylist(), strict=True)):
                for i in range(len(span) - least + 1):
                    rows.append(row)
                    starts.append(start + i)
                    hashes.append(xxhash.xxh3_64_intdigest(span[i:i + least]) - (1 << 63))
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), batch.column("n").take(at), batch.column("doc").take(at), pa.array(starts, pa.int64())], names=["h", "n", "doc", "start"])

    hashed = spans.where("hot").mapInArrow(windows, f"h bigint, n bigint, doc {id_type}, start bigint")
    copies = hashed.groupBy("h").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "start")).alias("first")).where("n > 1").drop("n")
    again = hashed.join(copies, "h")
    again = again if keep == "none" else again.where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    whole = shared.join(classes.where("n > 1").select("anchor", "content", "first"), ["anchor", "content"])
    whole = whole if keep == "none" else whole.where((F.col("doc") != F.col("first.doc")) | (F.col("start") != F.col("first.start")))
    return sorted_.unionAll(again.select("doc", "start", (F.col("start") + least).alias("end"))).unionAll(whole.select("doc", "start", (F.col("start") + F.col("size")).alias("end")))


def _matches(parts: list[pa.RecordBatch], least: int, keep: str) -> pa.RecordBatch:
    """Repeats among some spans: suffix array, longest earlier matches, runs of windows that have one."""
    table = pa.Table.from_batches(parts).sort_by([("doc", "ascending"), ("start", "ascending")])
    texts = table.column("span").to_pylist()
    data = np.frombuffer(b"\xff".join(texts) + b"\xff", np.uint8)  # a byte that UTF-8 never has
    earlier, other = longest_previous(data)
    match = earlier if keep == "first" else other
    at, rows, starts, ends = 0, [], [], []
    begin = table.column("start").to_pylist()
    for row, text in enumerate(texts):
        hits = np.flatnonzero(match[at:at + len(text) - least + 1] >= least)
        at += len(text) + 1
        if len(hits):
            for a, b in zip(*(x.tolist() for x in _runs(hits)), strict=True):
                rows.append(row)
                starts.append(begin[row] + a)
                ends.append(begin[row] + b + least)
    docs = table.column("doc").combine_chunks()
    return pa.RecordBatch.from_arrays([docs.take(pa.array(rows, pa.int64())), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["doc", "start", "end"])


def remove_repeats(docs: DataFrame, least: int = 200, keep: str = "none", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, kept (bytes left), n_bytes, n_removed, spans (maximal removed runs: start, end), kept_sha256 of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    gone = stored(repeated_spans(docs, least, keep, id_col, text_col).distinct(), "repeats")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            out = {"kept": [], "n_bytes": [], "n_removed": [], "spans": [], "kept_sha256": []}
            for text, spans in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("gone").to_pylist(), strict=True):
                text, merged = text or b"", []
                for s in sorted((s["start"], s["end"]) for s in spans or ()):
                    if merged and s[0] <= merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], s[1])
                    else:
                        merged.append(list(s))
                edges = [0, *(e for s in merged for e in s), len(text)]
                left = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                for name, value in zip(out, (left, len(text), len(text) - len(left), [{"start": a, "end": b} for a, b in merged], hashlib.sha256(left).hexdigest()), strict=True):
                    out[name].append(value)
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(out["kept"], pa.binary()), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()),
                                              pa.array(out["spans"], span), pa.array(out["kept_sha256"], pa.string())], names=[id_col, *out])

    listed = gone.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("gone"))
    listed = F.broadcast(listed) if gone.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else listed
    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).join(listed, "doc", "left")
    return source.mapInArrow(cut, f"{id_col} {id_type}, kept binary, n_bytes bigint, n_removed bigint, spans array<struct<start:bigint,end:bigint>>, kept_sha256 string")
