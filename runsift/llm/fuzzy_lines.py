"""Fuzzy line deduplication: shared word runs, MinHash bands, bits of words, edit similarity, one occurrence kept for each group.

A line is normalised to its words in lower case. Equal normalised lines are one line class. Two classes link when the edit
similarity of the normalised lines is at least ``similarity``; that check is exact. Candidates share a join key: one of the
``RUNS`` smallest hashes of their runs of three words, for lines of fewer than ``SHORT`` words a MinHash band of their
character trigrams, or for lines of at most ``TINY`` characters the text without one character. Every pair that shares a key is a candidate, however
many lines have the key. Neither line may lack more than ``WORD_SHARE`` of the other's words, as told by 512 bits of each, or, of two short
lines, their SimHashes of trigrams must differ in at most ``GRAM_BITS`` of 128 bits; tiny lines need neither. Pairs of short lines whose runs of
two or three characters already differ by more than the edits allowed are dropped. The bounds are set
from recall at similarity 0.8: long lines in which nearly every word has a typo can be missed. Of each connected group the
first occurrence, by (id, line number), stays; all other occurrences go. Lines without a word are never removed.

Null texts stay null. Rows of one id count as one document. Rows with a null id are left as they are.
A line class is named by a 64-bit hash of its text.

Keys and sketches are shuffled as packed rows: the numbers that go to one part in one binary value. Keys are dealt by key to find those that several
classes share, what is found by class to meet the sketches, and again by key to list pairs, in ``ROUNDS`` one after the other. Pairs that are
already in one group are not listed; to have few of them, each line is first linked with the first line of the keys that it shares most, and in
buckets of more than ``LISTED`` lines with the likeliest line, before all the others are listed. Short lines carry their text and are compared
there; other texts go to bins of pairs, so a text is sent once for all pairs of a bin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import Steps, chunks, stored
from runsift.llm.components import components
from runsift.llm.edits import alike
from runsift.llm.shingles import SPACES, _bytes, mix, word_hashes

#: Word runs of a line that are keys; words below which a line has trigram keys; bands and MinHashes of each; characters of
#: lines keyed by what is left without one.
RUNS, SHORT, BANDS, ROWS, TINY = 16, 12, 24, 3, 14
#: Share of the words of a line that the other may lack, unless their bits differ in so few places; bits of the SimHashes of trigrams
#: (128) that may differ; words of a line beyond which a half, a fourth and so on of them have bits.
WORD_SHARE, WORD_BITS, GRAM_BITS, WORDS = 0.6, 8, 48, 128
WORD_SIMS, GRAM_SIMS, TWOS, THREES = [f"w{k}" for k in range(8)], ["c0", "c1"], [f"p{k}" for k in range(8)], [f"q{k}" for k in range(16)]
NODE = ["size", "short", "rate", *WORD_SIMS, *GRAM_SIMS, *TWOS, *THREES]
#: 64-bit numbers of the sketch of any line (size, rate and short in one, bits of words), of a short line before its text, and with it (if
#: it has up to 96 bytes).
LONG_SKETCH, TEXT, SHORT_SKETCH = 1 + len(WORD_SIMS), len(NODE) - 2, len(NODE) - 2 + 12
#: Turns in which keys are shuffled, and in which pairs are listed, each of a share of the keys.
KEY_TURNS, ROUNDS = 2, 4
#: Keys, line classes, and lines of buckets in a part.
PART_KEYS, PART_LINES, BIN_LINES = 1 << 18, 1 << 14, 1 << 14
#: Lines of a block of a larger bucket; lines up to which a bucket's pairs are listed one by one; lines compared with all others at once.
PAIRED, LISTED, AT_ONCE = 1 << 14, 48, 64
#: Pairs that a task looks at in one turn, and pairs of a bin that is verified.
TURN, BIN_PAIRS = 1 << 20, 1 << 14
#: Bins up to which all are verified in one job, and jobs for more.
FEW_BINS, JOBS = 24, 4
#: Links that are joined to groups in one task; pairs of a bin that are looked through at once, and that are compared at once.
LINKS, PAIRS, COMPARED = 2_000_000, 1 << 18, 1 << 13
#: Bytes and lines that are described in one turn; bits of a hash beside the number of a line in it.
DESCRIBED, DESCRIBED_LINES, KEPT = 1 << 18, 1 << 16, 47
#: Line classes that a task remembers having described.
SEEN = 1_000_000
#: Line numbers up to which a table of lines may be broadcast.
BROADCAST_LINES = 1_000_000
#: Rows of packed numbers, dealt by part.
PACKED = "part int, kind int, a binary, b binary, c binary, n bigint"
#: Words summed in a byte lane, and the lowest bit of each lane.
_LANE, _ONES = 255, np.uint64(0x0101010101010101)
_WORD = re.compile(r"\w+")
_STEP, _BACK = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)


def normalised(line: str) -> str:
    return " ".join(_WORD.findall(line.lower()))


def line_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "replace")) - (1 << 63)


def simhashes(lines: list[str]) -> np.ndarray:
    """SimHash of the words of each normalised line, as signed 64-bit integers."""
    return _signs(*word_hashes([t.encode("utf-8", "replace") for t in lines]))


def _signs(words: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """SimHash of each run of hashes, ``counts`` long."""
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    first = np.cumsum(counts) - counts
    step = 1 << 16  # words at a time
    at = 0
    while at < len(full):
        end = max(at + 1, int(np.searchsorted(first[full], first[full[at]] + step)))
        rows = full[at:end]
        part = words[first[rows[0]]:first[rows[-1]] + counts[rows[-1]]]
        most = counts[rows]
        cuts = first[rows] - first[rows[0]]
        parts = -(-most // _LANE)  # byte lanes hold sums of so many words at a time
        own = np.repeat(np.arange(len(rows)), parts)
        begin = cuts[own] + (np.arange(len(own)) - np.repeat(np.cumsum(parts) - parts, parts)) * _LANE
        signs = np.zeros(len(rows), np.uint64)
        for bit in range(8):
            lanes = np.add.reduceat((part >> np.uint64(bit)) & _ONES, begin).view(np.uint8).reshape(-1, 8)
            ones = np.add.reduceat(lanes, np.cumsum(parts) - parts, axis=0, dtype=np.int64)
            signs |= (ones * 2 > most[:, None]).astype(np.uint8).view(np.uint64).ravel() << np.uint64(bit)
        out[rows] = signs
        at = end
    return out.view(np.int64)


def _trigrams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the character trigrams of each line between two spaces, and how many each has."""
    chars = np.frombuffer("".join(f" {t} " for t in lines).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    counts = np.array([len(t) for t in lines], np.int64)
    at = np.arange(int(counts.sum())) + 2 * np.repeat(np.arange(len(lines)), counts)
    return mix(chars[at] << np.uint64(42) | chars[at + 1] << np.uint64(21) | chars[at + 2]), counts


def _ordinals(ordered: np.ndarray) -> np.ndarray:
    """How many equal numbers stand before each one of an ordered array."""
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return np.arange(len(ordered)) - np.repeat(first, np.diff(np.append(first, len(ordered))))


def _bits(own: np.ndarray, hashes: np.ndarray, size: int, columns: list[str], rate: np.ndarray | None = None) -> np.ndarray:
    """Hashes of each of ``size`` lines (fewer than 2 ** (64 - KEPT)) as rows of bits, each with its ordinal among equal ones."""
    ordered = np.sort(own.astype(np.uint64) << np.uint64(KEPT) | hashes >> np.uint64(64 - KEPT))
    own = (ordered >> np.uint64(KEPT)).astype(np.int64)
    bits = mix((ordered & np.uint64((1 << KEPT) - 1)) + _ordinals(ordered).astype(np.uint64) * np.uint64(_STEP))
    if rate is not None and rate.any():
        kept = bits >> np.uint64(32) & ((np.uint64(1) << rate[own].astype(np.uint64)) - np.uint64(1)) == 0
        own, bits = own[kept], bits[kept]
    out = np.zeros((size, 64 * len(columns)), np.uint8)
    out[own, (bits & np.uint64(64 * len(columns) - 1)).astype(np.int64)] = 1
    return np.packbits(out, axis=1, bitorder="little").view(np.int64).reshape(size, len(columns))


def _char_runs(lines: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of the runs of two or three characters of each line between two spaces."""
    counts = np.array([len(t) + 3 - run for t in lines], np.int64)
    chars = np.frombuffer("".join(f" {t} " for t in lines).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    own = np.repeat(np.arange(len(lines)), counts)
    at = np.arange(int(counts.sum())) + (run - 1) * own
    return own, mix(reduce(lambda found, k: found << np.uint64(21) | chars[at + k], range(1, run), chars[at]))


@lru_cache(maxsize=4)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _STEP and of its inverse modulo 2 ** 64."""
    return tuple(np.concatenate([[np.uint64(1)], np.cumprod(np.full(size - 1, x, np.uint64))]) for x in (_STEP, _BACK))


def _words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of lines that each end in a line break, in order, and the number of words before the end of each line."""
    values = _bytes(SPACES)[data]
    powers, back = _powers(1 << max(12, len(data).bit_length()))
    sums = np.cumsum(values * powers[:len(data)])
    ends = np.flatnonzero(values == 0)
    start = np.concatenate([ends[:0], [0], ends[:-1] + 1])
    full = ends > start
    before = np.concatenate([np.zeros(1, np.uint64), sums])[start]
    words = mix((sums[ends] - before) * back[start] + (ends - start).astype(np.uint64))
    return words[full], np.cumsum(full)[data[ends] == 10]


def _runs(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Line and hash of the RUNS smallest distinct runs of three words of each line."""
    own = np.repeat(np.arange(len(counts)), counts)
    full = np.flatnonzero(own[2:] == own[:-2])
    ordered = np.sort(own[full].astype(np.uint64) << np.uint64(KEPT) | mix(mix(mix(words[full]) + words[full + 1]) + words[full + 2]) >> np.uint64(64 - KEPT))
    ordered = ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if len(ordered) else ordered
    own = (ordered >> np.uint64(KEPT)).astype(np.int64)
    kept = np.arange(len(own)) - np.searchsorted(own, own) < RUNS
    return own[kept], mix(ordered[kept] & np.uint64((1 << KEPT) - 1))


def _bands(grams: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A key for each line and band, of ROWS MinHashes."""
    out = np.zeros((len(counts), BANDS), np.uint64)
    first = np.cumsum(counts) - counts
    for band in range(BANDS if len(counts) else 0):
        key = np.full(len(counts), band + 1, np.uint64)
        for row in range(ROWS):
            key = mix(key + np.minimum.reduceat(mix(grams ^ np.uint64((band * ROWS + row + 1) * 0x9E3779B97F4A7)), first))
        out[:, band] = key
    return out


def _described(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sketches of normalised lines, a row each (the columns behind bits of words are 0 but for short lines), which lines are short, and
    the line and value of each join key, by line."""
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    words, ends = _words(data)
    counts = np.diff(ends, prepend=0)
    short, rate = counts < SHORT, np.ceil(np.log2(np.maximum(counts, 1) / WORDS)).clip(0).astype(np.int64)
    sizes = np.add.reduceat((data & 0xC0 != 0x80).astype(np.int64), np.cumsum([0, *(len(x) + 1 for x in lines[:-1])])) - 1
    out = np.zeros((len(lines), SHORT_SKETCH), np.int64)
    out[:, 0] = sizes | rate << 32 | short.astype(np.int64) << 40
    out[:, 1:LONG_SKETCH] = _bits(np.repeat(np.arange(len(lines)), counts), words, len(lines), WORD_SIMS, rate)
    own, keys = _runs(words, counts)
    few = np.flatnonzero(short)
    if len(few):
        texts = [lines[i].decode() for i in few]
        grams, sizes = _trigrams(texts)
        at = LONG_SKETCH
        for k in range(len(GRAM_SIMS)):
            out[few, at + k] = _signs(mix(grams + np.uint64(k)), sizes)
        at += len(GRAM_SIMS)
        for run, columns in ((2, TWOS), (3, THREES)):
            out[few, at:at + len(columns)] = _bits(*_char_runs(texts, run), len(few), columns)
            at += len(columns)
        room = 8 * (SHORT_SKETCH - TEXT)
        out[few, TEXT:] = np.frombuffer(b"".join((lines[i] if len(lines[i]) <= room else b"").ljust(room, b"\0") for i in few), np.int64).reshape(len(few), -1)
        less = [(i, line_hash(x)) for i, t in zip(few.tolist(), texts, strict=True) if len(t) <= TINY for x in {t, *(t[:k] + t[k + 1:] for k in range(len(t)))}]
        own = np.concatenate([own, np.repeat(few, BANDS), np.array([x[0] for x in less], np.int64)])
        keys = np.concatenate([keys, _bands(grams, sizes).ravel(), np.array([x[1] for x in less], np.int64).view(np.uint64)])
        order = np.argsort(own, kind="stable")
        own, keys = own[order], keys[order]
    return out, short, own, keys.view(np.int64)


def _nodes(sketch: np.ndarray) -> dict[str, np.ndarray]:
    """The columns of NODE from sketches."""
    return {"size": sketch[:, 0] & 0xFFFFFFFF, "short": (sketch[:, 0] >> 40).astype(bool), "rate": sketch[:, 0] >> 32 & 0xFF, **{c: sketch[:, 1 + k] for k, c in enumerate(NODE[3:])}}


def _columns(sketch: np.ndarray) -> list[np.ndarray]:
    return [x if k < 3 else np.ascontiguousarray(x).view(np.uint64) for k, x in enumerate(_nodes(sketch).values())]


def sketches(lines: list[str]) -> tuple[dict[str, np.ndarray], list[np.ndarray]]:
    """Columns of NODE of normalised lines, and the join keys of each."""
    out, _, own, keys = _described([t.encode("utf-8", "replace") for t in lines]) if lines else (np.zeros((0, SHORT_SKETCH), np.int64), *[np.zeros(0, np.int64)] * 3)
    return _nodes(out), np.split(keys, np.searchsorted(own, np.arange(1, len(lines)))) if lines else []


@lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """Of each code point: its lower case if that is part of a word, 10 of a line break, else 0."""
    every = "".join(map(chr, [*range(0xD800), *[0] * 0x800, *range(0xE000, 0x110000)]))
    lower = every.replace("\u0130", "i").replace("\u03a3", "\u03c3").lower()  # those two have a lower case by context, or of two characters
    word = np.zeros(0x110000, bool)
    word[np.frombuffer("".join(_WORD.findall(every)).encode("utf-32-le"), np.uint32)] = True
    codes = np.frombuffer(lower.encode("utf-32-le"), np.uint32)
    out = np.where(word[codes], codes, 0).astype(np.uint32)
    out[10] = 10
    return out


def normalised_lines(texts: list[str]) -> list[bytes]:
    """All lines of the texts, one after the other, normalised."""
    whole = "\n".join(texts)
    if not whole:
        return [b""] * len(texts)
    if "\u0130" in whole or "\u03a3" in whole:
        whole = whole.lower()
    codes = _folded()[np.frombuffer(whole.encode("utf-32-le", "replace"), np.uint32)]
    kept = codes != 0
    kept[1:] |= codes[:-1] > 10  # one space behind a word
    codes = codes[kept]
    codes[codes == 0] = 32
    last = codes == 32
    last[:-1] &= codes[1:] == 10
    return codes[~last].tobytes().decode("utf-32-le").encode().split(b"\n")


def _binary(lengths: np.ndarray, data: np.ndarray) -> pa.Array:
    """Binary values of so many bytes each, one after the other in ``data``."""
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _numbers(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """The 64-bit numbers of all values of a binary column."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64)


def _lines(docs: DataFrame, id_type: str) -> DataFrame:
    """A row for each line with a word: h (line class), doc, line (number); keys and sketch, as bytes, in the first row of a class that a task
    meets, empty in most others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in chunks(batches, "text", DESCRIBED):
            texts = [t or "" for t in batch.column("text").to_pylist()]
            if len(seen) > SEEN:
                seen.clear()
            counts = np.array([t.count("\n") + 1 for t in texts], np.int64)
            lines = normalised_lines(texts)
            full = np.flatnonzero(np.fromiter(map(len, lines), np.int64, len(lines)))
            if not len(full):
                continue
            lines = [lines[i] for i in full.tolist()]
            names = [xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in lines]
            new = []
            for i, h in enumerate(names):
                if h not in seen:
                    seen.add(h)
                    new.append(i)
            lengths = np.zeros((2, len(lines)), np.int64)
            keys = sketch = np.zeros(0, np.int64)
            if new:
                size = np.cumsum([len(lines[i]) for i in new]) // DESCRIBED * len(lines) + np.arange(len(new)) // DESCRIBED_LINES
                pieces = [(part, *_described([lines[new[i]] for i in part])) for part in np.split(np.arange(len(new)), np.flatnonzero(np.diff(size)) + 1)]
                sketch, short, keys = (np.concatenate([x[k] for x in pieces]) for k in (1, 2, 4))
                lengths[0, new] = 8 * np.concatenate([np.bincount(x[3], minlength=len(x[0])) for x in pieces])
                lengths[1, new] = 8 * np.where(short, SHORT_SKETCH, LONG_SKETCH)
                sketch = sketch[np.arange(SHORT_SKETCH) < lengths[1, new][:, None] // 8]
            rows = np.repeat(np.arange(len(texts)), counts)[full]
            numbers = full - (np.cumsum(counts) - counts)[rows]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), batch.column("doc").take(pa.array(rows)), pa.array(numbers), _binary(lengths[0], keys), _binary(lengths[1], sketch)], names=["h", "doc", "line", "keys", "sketch"])

    return docs.where("doc IS NOT NULL").mapInArrow(run, f"h bigint, doc {id_type}, line bigint, keys binary, sketch binary")


def _packed(kind: int, part: np.ndarray, *columns: np.ndarray) -> pa.Table:
    """Rows of PACKED: the rows of up to three arrays of numbers, those of one part in one row."""
    order = np.argsort(part, kind="stable")
    parts, first = np.unique(part[order], return_index=True)
    counts = np.diff(np.append(first, len(part)))
    out = [_binary(counts * 8 * (c.size // max(1, len(c))), c[order]) for c in columns]
    out += [pa.array([b""] * len(parts), pa.binary())] * (3 - len(out))
    return pa.table([pa.array(parts, pa.int32()), pa.array(np.full(len(parts), kind, np.int32)), *out, pa.array(counts, pa.int64())], names=["part", "kind", "a", "b", "c", "n"])


def _of(rows: pa.Table, kind: int) -> list[np.ndarray]:
    """The columns a, b and c of the packed rows of a kind."""
    rows = rows.filter(pa.compute.equal(rows.column("kind"), kind))
    return [_numbers(rows.column(c)) for c in "abc"]


#: Kinds of packed rows: sketches of long and of short lines, components, pairs with the sketch of the second line of either; from the last
#: on keys, by round, those of buckets up to LISTED lines and of larger ones.
_SKETCHES, _COMPONENTS, _PAIRS, _KEYS = (0, 1), 2, (3, 4), 8


def _dealt(numbers: np.ndarray, parts: int) -> np.ndarray:
    return (mix(numbers.view(np.uint64)) % np.uint64(parts)).astype(np.int32)


def _sketched(ids: np.ndarray, sketch: np.ndarray, part: np.ndarray, kinds: tuple[int, int], *more: np.ndarray) -> Iterator[pa.Table]:
    """Packed rows of lines with their sketches, of long and of short lines."""
    short = (sketch[:, 0] >> 40).astype(bool)
    for kind, rows, width in ((kinds[0], ~short, LONG_SKETCH), (kinds[1], short, SHORT_SKETCH)):
        if rows.any():
            yield _packed(kind, part[rows], ids[rows], sketch[rows, :width], *(x[rows] for x in more))


def _sketches(rows: pa.Table, kinds: tuple[int, int], width: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What ``_sketched`` has packed: ids (rows of ``width`` numbers), sketches (0 where those of long lines end), other numbers."""
    found = [_of(rows, kind) for kind in kinds]
    ids, more = (np.concatenate([x[k] for x in found]) for k in (0, 2))
    sketch = np.zeros((len(ids) // width, SHORT_SKETCH), np.int64)
    long = len(found[0][0]) // width
    sketch[:long, :LONG_SKETCH] = found[0][1].reshape(-1, LONG_SKETCH)
    sketch[long:] = found[1][1].reshape(-1, SHORT_SKETCH)
    return ids.reshape(-1, width) if width > 1 else ids, sketch, more


def _empty() -> pa.Table:
    return _packed(0, np.zeros(0, np.int32))


def _shared_keys(rows: pa.Table, parts: int, rounds: int) -> pa.Table:
    """Keys that several lines have, with each such line, the smallest line of the key and the number of them, dealt by line."""
    keys, ids, _ = _of(rows, _KEYS)
    order = np.argsort(keys)
    for several in (False, True):  # twice: a line can be there more than once
        if several:
            order = np.lexsort((ids, keys))
        keys, ids = keys[order], ids[order]
        if several and len(keys):
            new = np.concatenate([[True], (keys[1:] != keys[:-1]) | (ids[1:] != ids[:-1])])
            keys, ids = keys[new], ids[new]
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(keys)))
        lead, n = np.repeat(ids[first], n), np.repeat(n, n)
        keys, ids, lead, n = keys[n > 1], ids[n > 1], lead[n > 1], n[n > 1]
    kind, columns = _KEYS + 2 * (int(rows.column("part")[0].as_py()) % rounds), (_dealt(ids, parts), np.stack([keys, ids], axis=1), lead, n)
    return pa.concat_tables([_empty(), *(_packed(kind + large, *(x[(n > LISTED) == large] for x in columns)) for large in (False, True))])


def _lead_pairs(rows: pa.Table, parts: int) -> pa.Table:
    """Of each line with a shared key: its sketch, and the first line of the keys that it shares most, as a pair dealt by that first line. Where a first
    line may have many pairs they go to several parts, as copies of its sketch do."""
    ids, sketch, _ = _sketches(rows, _SKETCHES)
    shared = [_of(rows, kind) for kind in sorted(set(rows.column("kind").to_pylist())) if kind >= _KEYS]
    if not shared:
        return _empty()
    own, (lead, n) = np.concatenate([x[0] for x in shared]).reshape(-1, 2)[:, 1], (np.concatenate([x[k] for x in shared]) for k in (1, 2))
    ids, at = np.unique(ids, return_index=True)
    sketch, place = sketch[at], np.searchsorted(ids, own)
    used = np.unique(place)
    out = list(_sketched(ids[used], sketch[used], _dealt(ids[used], parts), _SKETCHES))
    heads = lead == own
    size = np.zeros(len(ids), np.int64)
    np.maximum.at(size, place[heads], n[heads])
    copies = np.minimum(-(-size // PAIRED), parts)
    head = np.repeat(np.arange(len(ids)), copies)
    turn = np.arange(len(head)) - np.repeat(np.cumsum(copies) - copies, copies)
    out += _sketched(ids[head], sketch[head], (_dealt(ids[head], parts) + turn) % parts + parts, _SKETCHES)
    order = np.lexsort((lead[~heads], place[~heads]))
    place, lead, n = place[~heads][order], lead[~heads][order], n[~heads][order]
    first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (lead[1:] != lead[:-1])])) if len(place) else place
    times = np.diff(np.append(first, len(place)))
    place, lead, n = place[first], lead[first], np.minimum.reduceat(n, first) if len(first) else n
    order = np.lexsort((lead, -times, place))
    order = order[np.concatenate([[True], np.diff(place[order]) > 0])] if len(order) else order
    place, lead, n = place[order], lead[order], n[order]
    turn = _dealt(ids[place], 1 << 30) % np.minimum(-(-n // PAIRED), parts)
    out += _sketched(lead, sketch[place], (_dealt(lead, parts) + turn) % parts + parts, _PAIRS, ids[place])
    return pa.concat_tables(out)


def _near(left: list[np.ndarray], one: np.ndarray, right: list[np.ndarray], two: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of a line of ``left`` and one of ``right`` the sketches do not rule out; the columns are those of NODE."""
    sizes = left[0][one], right[0][two]
    rest = np.flatnonzero(np.minimum(*sizes) >= np.maximum(*sizes) * (similarity - 1e-9))
    one, two = one[rest], two[rest]
    both, tiny = left[1][one] & right[1][two], np.maximum(left[0][one], right[0][two]) <= TINY
    if not len(one):
        return rest
    common, counts = _common([x[one] for x in left[3:11]], [x[two] for x in right[3:11]])
    good = _enough(common, *counts, left[2][one], right[2][two]) | both & tiny
    more = np.flatnonzero(both & ~good)
    good[more] = sum((np.bitwise_count(x[one[more]] ^ y[two[more]]) for x, y in zip(left[11:13], right[11:13], strict=True)), np.uint8(0)) <= GRAM_BITS
    rest, one, two = rest[good], one[good], two[good]
    return rest[_char_near(left, one, right, two, similarity)]


def _char_near(left: list[np.ndarray], one: np.ndarray, right: list[np.ndarray], two: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs, by number, have enough runs of two and of three characters in common, if both lines are short: an edit takes away so many at most."""
    good = np.ones(len(one), bool)
    for run, columns in ((2, slice(13, 21)), (3, slice(21, 37))):
        rest = np.flatnonzero(good & left[1][one] & right[1][two])
        x, y = one[rest], two[rest]
        common, counts = _common([c[x] for c in left[columns]], [c[y] for c in right[columns]])
        good[rest] = np.maximum(*counts) - common <= run * np.floor((1 - similarity) * np.maximum(left[0][x], right[0][y]) + 1e-6)
    return np.flatnonzero(good)


def _common(one: list[np.ndarray], two: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """How many bits are set in both, and in each."""
    def count(columns: list[np.ndarray]) -> np.ndarray:
        return sum((np.bitwise_count(x).astype(np.int16) for x in columns), np.int16(0))
    return count([x & y for x, y in zip(one, two, strict=True)]), [count(one), count(two)]


def _enough(common: np.ndarray, one: np.ndarray, two: np.ndarray, rate: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether lines may have enough words in common, from their bits: chance hits of a line's bits on the other's do not count as common."""
    of, by = np.maximum(one, two), np.minimum(one, two)
    if rate.min() != rate.max() or other.min() != other.max() or rate.min() != other.min():  # the line of which fewer words have bits is looked for in the other
        of, by = np.where(rate > other, one, np.where(rate < other, two, of)), np.where(rate > other, two, np.where(rate < other, one, by))
    out = common >= of * (np.float32(1 - WORD_SHARE) + by * np.float32(WORD_SHARE / (64 * len(WORD_SIMS))))
    if one.min() <= 2 * WORD_BITS:
        out |= one.astype(np.int16) + two - 2 * common.astype(np.int16) <= WORD_BITS
    return out


def _near_pairs(rows: pa.Table, similarity: float) -> Iterator[pa.Table]:
    """Pairs a, b (a < b) of lines in one block pair (key, i, j) and different groups that sketches do not rule out, with the block pair's hash."""
    every = [rows.column(c).to_numpy() for c in ("id", "g", "own", "single", "cell")]
    return _cell_pairs(*every, [rows.column(c).to_numpy() if k < 3 else rows.column(c).to_numpy().view(np.uint64) for k, c in enumerate(NODE)], similarity)


def _cell_pairs(ids: np.ndarray, groups: np.ndarray, own: np.ndarray, single: np.ndarray, names: np.ndarray, node: list[np.ndarray], similarity: float, nearest: bool = False) -> Iterator[pa.Table]:
    """As ``_near_pairs``; ``nearest``: in a cell of more than LISTED lines only the likeliest pair of each line with one behind it by size."""
    cell = np.unique(names, return_inverse=True)[1]
    order = np.lexsort((node[0], cell))
    cell, ids, groups, own, single, names = (x[order] for x in (cell, ids, groups, own, single, names))
    node = [x[order] for x in node]
    size, short, rate = node[:3]
    if not len(cell):
        return
    # lines of a cell by size: partners are those behind a line up to the largest size that can be similar
    most = np.minimum(size / max(similarity - 1e-9, 1e-9) + 1, size.max()).astype(np.int64)
    width = int(size.max()) + 1
    counts = np.searchsorted(cell * width + size, cell * width + most, side="right") - np.arange(len(cell)) - 1
    bounds = np.append(np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell))
    large = np.diff(bounds) > LISTED

    def apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        return np.flatnonzero((groups[one] != groups[two]) & (single[one] | (own[one] != own[two])))

    def table(one: np.ndarray, two: np.ndarray, place: int = 0) -> pa.Table:
        return pa.table({"a": np.minimum(ids[one], ids[two]), "b": np.maximum(ids[one], ids[two]), "cell": names[one] + place})

    each = np.where(np.repeat(large, np.diff(bounds)), 0, counts)
    total = np.cumsum(each)
    at = 0
    while at < len(cell):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + TURN, side="right")))
        part = each[at:to]
        one = np.repeat(np.arange(at, to), part)
        two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(part) - part, part)
        rest = apart(one, two)
        rest = rest[_near(node, one[rest], node, two[rest], similarity)]
        yield table(one[rest], two[rest])
        at = to

    words, grams = node[3:11], node[11:13]
    ones = reduce(np.add, map(np.bitwise_count, words))  # WORDS at most
    for begin, end in ((bounds[i], bounds[i + 1]) for i in np.flatnonzero(large).tolist()):
        for first in range(begin, end, AT_ONCE):
            last = min(end, first + AT_ONCE)
            to = int((np.arange(first, last) + counts[first:last]).max()) + 1
            if to <= first + 1:
                continue
            lines, others = np.s_[first:last, None], np.s_[None, first:to]
            common = reduce(np.add, (np.bitwise_count(x[lines] & x[others]) for x in words))
            near = _enough(common, ones[lines], ones[others], rate[lines], rate[others])
            if short[first:to].any():
                near |= short[lines] & short[others] & (sum((np.bitwise_count(x[lines] ^ x[others]) for x in grams), np.uint8(0)) <= GRAM_BITS)
                near |= (size[lines] <= TINY) & (size[others] <= TINY)
            near &= np.arange(first, to) - np.arange(first, last)[:, None] - 1 < counts[first:last, None]
            near &= np.arange(first, to) > np.arange(first, last)[:, None]
            one, two = np.nonzero(near)
            common, one, two = common[one, two], one + first, two + first
            rest = apart(one, two)
            rest = rest[_char_near(node, one[rest], node, two[rest], similarity)]
            if nearest:
                share = common[rest] / np.maximum(ones[one[rest]], ones[two[rest]])
                rest = rest[np.lexsort((-share, one[rest]))]
                rest = rest[np.diff(one[rest], prepend=-1) > 0]
            yield table(one[rest], two[rest], first - begin)  # so that the pairs of a large cell go to many bins


def duplicate_lines(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, line, group (line class of the group's first member), of all occurrences that go."""
    id_type = docs.schema[id_col].dataType.simpleString()
    docs, steps = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), Steps()
    every = steps.store(_lines(docs, id_type), "described-lines")
    lines = steps.store(every.select("h", "doc", "line"), "lines")
    classes = steps.store(lines.groupBy(F.col("h").alias("id")).agg(F.min(F.struct("doc", "line")).alias("first"), F.count("*").alias("n")), "line-classes")
    described = every.where("length(sketch) > 0")
    found = described.agg(F.count("*"), F.coalesce(F.sum(F.length("keys")), F.lit(0))).first()
    parts, key_parts = -(-found[0] // PART_LINES) + 1, -(-found[1] // 8 // PART_KEYS) + 1
    rounds = min(ROUNDS, key_parts)

    def keys_of(batches: Iterator[pa.RecordBatch], turn: int) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in chain(batches, [None]):
            if batch is not None:
                keys, ids = _numbers(batch.column("keys")), np.repeat(batch.column("h").to_numpy(), pa.compute.binary_length(batch.column("keys")).to_numpy() // 8)
                part = _dealt(keys, key_parts)
                here = part % KEY_TURNS == turn
                held.append((part[here], keys[here], ids[here]))
                size += len(held[-1][0])
            if size >= PART_KEYS or size and batch is None:
                yield from _packed(_KEYS, *(np.concatenate([x[k] for x in held]) for k in range(3))).to_batches()
                held, size = [], 0

    def sketches_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lengths = batch.column("h").to_numpy(), pa.compute.binary_length(batch.column("sketch")).to_numpy() // 8
            sketch = np.zeros((len(ids), SHORT_SKETCH), np.int64)
            sketch[np.arange(SHORT_SKETCH) < lengths[:, None]] = _numbers(batch.column("sketch"))
            for rows in _sketched(ids, sketch, _dealt(ids, parts), _SKETCHES):
                yield from rows.to_batches()

    sketched = steps.store(described.select("h", "sketch").mapInArrow(sketches_of, PACKED), "line-sketches")
    halves = [described.select("h", "keys").mapInArrow(lambda x, k=turn: keys_of(x, k), PACKED).groupBy("part") for turn in range(min(KEY_TURNS, key_parts))]
    halves = [steps.store(half.applyInArrow(lambda t: _shared_keys(t, parts, rounds), PACKED), "shared-keys") for half in halves]
    shared = reduce(DataFrame.unionAll, halves)
    entries = {r.kind: r.n for r in shared.groupBy("kind").agg(F.sum("n").alias("n")).collect()}
    steps.drop(every)
    leads = sketched.unionAll(shared).groupBy("part").applyInArrow(lambda t: _lead_pairs(t, parts), PACKED)
    leads = steps.store(leads, "lead-pairs")
    steps.drop(sketched)
    nodes = leads.where(F.col("part") < parts)

    def near_leads(rows: pa.Table) -> pa.Table:
        heads, sketch, _ = _sketches(rows, _SKETCHES)
        a, other, b = _sketches(rows, _PAIRS)
        order = np.argsort(heads)
        sketch = sketch[order[np.searchsorted(heads, a, sorter=order)]]
        good = _near(_columns(sketch), np.arange(len(a)), _columns(other), np.arange(len(a)), similarity)
        return pa.table({"a": a[good], "b": b[good], "cell": a[good]})

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 2 << 20):
            ids, texts = [], []
            for text, wanted in zip(batch.column("text").to_pylist(), batch.column("wanted").to_pylist(), strict=True):
                parts = (text or "").split("\n")
                for w in wanted:
                    norm = normalised(parts[w["line"]]) if w["line"] < len(parts) else ""
                    if norm and line_hash(norm) == w["id"]:
                        ids.append(w["id"])
                        texts.append(norm)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["id", "norm"])

    def compare(pairs: pa.Table, texts: pa.Table) -> pa.Table:
        texts = texts.sort_by("id")
        ids, norms = texts.column("id").to_numpy(), texts.column("norm").to_pylist()
        places = [np.searchsorted(ids, pairs.column(c).to_numpy()) for c in ("a", "b")]
        good = alike(*([norms[i] for i in p.tolist()] for p in places), similarity)
        return pairs.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    def texts_of(ids: DataFrame) -> DataFrame:
        needed = steps.store(ids.join(classes, "id").select("id", "first.doc", "first.line"), "wanted-lines")
        texts = _with_lines(docs, needed, F.struct("line", "id"), "wanted", "inner").mapInArrow(pick, "id bigint, norm string").dropDuplicates(["id"])
        texts = steps.store(texts, "line-texts")
        steps.drop(needed)
        return texts

    def verify(pairs: DataFrame) -> list[DataFrame]:
        """The similar ones of stored pairs (a, b, cell), in bins of pairs by cell; a bin has the text of each of its lines once."""
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
        bins = -(-pairs.count() // BIN_PAIRS) + 1
        jobs, found = 1 if bins <= FEW_BINS else JOBS, []
        binned = pairs.select("a", "b", F.pmod(F.xxhash64("cell"), F.lit(bins)).alias("bin"))
        for job in range(jobs):
            part = binned.where(F.col("bin") % jobs == job)
            sent = part.select(F.col("bin").alias("own"), F.explode(F.array("a", "b")).alias("id")).distinct().join(texts, "id")
            found.append(steps.store(part.groupBy("bin").cogroup(sent.groupBy("own")).applyInArrow(lambda _, p, t: compare(p, t), "a bigint, b bigint"), "verified"))
        steps.drop(texts)
        return found

    # first each line with the first line of the bucket it shares most, then in large buckets with the likeliest that is not yet in one group,
    # in others with all that are not; at last all pairs in large buckets that are not yet in one group
    best = steps.store(leads.where(F.col("part") >= parts).groupBy("part").applyInArrow(near_leads, "a bigint, b bigint, cell bigint"), "first-pairs")
    known, found = [best], verify(best)

    def components_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, component = (batch.column(c).to_numpy() for c in ("node", "component"))
            yield from _packed(_COMPONENTS, _dealt(node, parts), node, component).to_batches()

    def cells_of(rows: pa.Table, bins: int) -> pa.Table:
        """Lines of shared keys with group and sketch, dealt by key; a larger bucket is cut into blocks, of which each pair meets in one place."""
        shared = [_of(rows, kind) for kind in sorted(set(rows.column("kind").to_pylist())) if kind >= _KEYS]
        if not shared:
            return _empty()
        (ids, sketch, _), (node, component, _) = _sketches(rows, _SKETCHES), _of(rows, _COMPONENTS)
        (keys, line), n = np.concatenate([x[0] for x in shared]).reshape(-1, 2).T, np.concatenate([x[2] for x in shared])
        order = np.argsort(ids)
        line = order[np.searchsorted(ids, line, sorter=order)]
        node, at = np.unique(node, return_index=True)
        group, place = ids.copy(), np.searchsorted(node, ids).clip(0, max(0, len(node) - 1))
        if len(node):
            known = node[place] == ids
            group[known] = component[at][place[known]]
        blocks = -(-n // PAIRED)
        own = (mix(ids[line].view(np.uint64)) % blocks.astype(np.uint64)).astype(np.int64)
        row = np.repeat(np.arange(len(n)), blocks)
        other = np.arange(len(row)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        line, own = line[row], own[row]
        cell = mix(mix(keys[row].view(np.uint64)) + (np.minimum(own, other) << 32 | np.maximum(own, other)).view(np.uint64)).view(np.int64)
        return pa.concat_tables(list(_sketched(np.stack([cell, ids[line], group[line], own << 1 | (own == other)], axis=1), sketch[line], _dealt(cell, bins), _SKETCHES)))

    def listed_in(rows: pa.Table, nearest: bool) -> pa.Table:
        """Near pairs of a bin; those of which both texts are there are compared, and ``sure`` if similar."""
        lines, sketch, _ = _sketches(rows, _SKETCHES, 4)
        cell, ids, groups, own = lines.T
        names, at = np.unique(ids, return_index=True)
        texts = [t.rstrip(b"\0").decode() for t in np.ascontiguousarray(sketch[at, TEXT:]).view(f"V{8 * (SHORT_SKETCH - TEXT)}").ravel().tolist()]
        there = sketch[at, TEXT:].any(axis=1)

        def settled(found: list[pa.Table]) -> pa.Table:
            pairs = pa.concat_tables(found).group_by(["a", "b"]).aggregate([("cell", "min")])
            one, two = (np.searchsorted(names, pairs.column(c).to_numpy()) for c in ("a", "b"))
            sure = there[one] & there[two]
            good = np.ones(len(sure), bool)
            for rest in np.split(np.flatnonzero(sure), range(COMPARED, int(sure.sum()), COMPARED)):
                good[rest] = alike([texts[i] for i in one[rest].tolist()], [texts[i] for i in two[rest].tolist()], similarity)
            return pa.table([*(pairs.column(c) for c in ("a", "b", "cell_min")), pa.array(sure)], names=["a", "b", "cell", "sure"]).filter(pa.array(good))

        out, found = [], [pa.table({c: np.zeros(0, np.int64) for c in ("a", "b", "cell")})]
        for pairs in _cell_pairs(ids, groups, own >> 1, (own & 1).astype(bool), cell, _columns(sketch), similarity, nearest):
            found.append(pairs)
            if sum(map(len, found)) > PAIRS:
                out.append(settled(found))
                found = found[:1]
        out.append(settled(found))
        return pa.concat_tables(out)

    def across(kinds: list[int], linked: DataFrame, nearest: bool) -> DataFrame:
        bins = -(-sum(entries.get(kind, 0) for kind in kinds) // BIN_LINES) + 1
        rows = nodes.unionAll(shared.where(F.col("kind").isin(kinds))).unionAll(linked.mapInArrow(components_of, PACKED))
        rows = rows.groupBy("part").applyInArrow(lambda t: cells_of(t, bins), PACKED)
        return steps.store(rows.groupBy("part").applyInArrow(lambda t: listed_in(t, nearest), "a bigint, b bigint, cell bigint, sure boolean"), "near-pairs")

    every_round = [[_KEYS + 2 * k, _KEYS + 2 * k + 1] for k in range(rounds)]
    large = sum(n for kind, n in entries.items() if kind % 2)
    turns = -(-large * rounds // max(1, sum(entries.values())))
    large_rounds = [[_KEYS + 2 * k + 1 for k in range(turn, rounds, turns)] for turn in range(turns)]
    for kinds, nearest in ((every_round, True), (large_rounds, False)):
        if kinds and entries:
            linked = components(reduce(DataFrame.unionAll, found), steps=steps, at_once=LINKS)
            listed = [across(x, linked, nearest) for x in kinds]
            pairs = reduce(DataFrame.unionAll, listed)
            found.append(steps.store(pairs.where("sure").select("a", "b").distinct(), "verified"))
            pairs = pairs.where("NOT sure").groupBy("a", "b").agg(F.min("cell").alias("cell")).join(reduce(DataFrame.unionAll, known).select("a", "b"), ["a", "b"], "left_anti")
            known.append(steps.store(pairs, "cross-pairs"))
            steps.drop(*listed)
            found += verify(known[-1])
    steps.drop(leads, *halves)
    groups = components(reduce(DataFrame.unionAll, found), steps=steps, at_once=LINKS)
    steps.drop(*known, *found)
    grouped = classes.join(groups.select(F.col("node").alias("id"), "component"), "id", "left").where("component IS NOT NULL OR n > 1")
    grouped = grouped.select("id", "first", "n", F.coalesce("component", "id").alias("group"))
    kept = grouped.groupBy("group").agg(F.min("first").alias("keep"))
    members = grouped.select("id", "group").join(kept, "group")
    found = lines.select(F.col("h").alias("id"), "doc", "line").join(members, "id")
    return found.where((F.col("doc") != F.col("keep.doc")) | (F.col("line") != F.col("keep.line"))).select("doc", "line", "group")


def _with_lines(docs: DataFrame, lines: DataFrame, value: Column, name: str, how: str) -> DataFrame:
    """Add the listed lines of each document; ``lines`` (doc, line, ...) must be stored. One list is at most a document long."""
    listed = lines.groupBy("doc").agg(F.collect_list(value).alias(name))
    return docs.join(F.broadcast(listed) if lines.limit(BROADCAST_LINES + 1).count() <= BROADCAST_LINES else listed, "doc", how)


def drop_duplicate_lines(docs: DataFrame, similarity: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, text_col (without the lines that go), n_lines, n_removed of every document."""
    id_type = docs.schema[id_col].dataType.simpleString()
    gone = stored(duplicate_lines(docs, similarity, id_col, text_col).distinct(), "duplicate-lines")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            texts, sizes, removed = [], [], []
            for text, lines in zip(batch.column("text").to_pylist(), batch.column("gone").to_pylist(), strict=True):
                parts = (text or "").split("\n")
                out = set(lines or ())
                kept = [p for n, p in enumerate(parts) if n not in out]
                texts.append("\n".join(kept) if text is not None else None)
                sizes.append(len(parts) if text else 0)
                removed.append(len(parts) - len(kept))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array(texts, pa.string()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64())], names=[id_col, text_col, "n_lines", "n_removed"])

    source = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text"))
    return _with_lines(source, gone, F.col("line"), "gone", "left").mapInArrow(rewrite, f"{id_col} {id_type}, {text_col} string, n_lines bigint, n_removed bigint")
