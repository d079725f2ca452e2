"""Language of words in code-switched text by a linear-chain conditional random field.

Each word is a position of the chain; its features are its character n-grams of 1 to 4 letters with marks
for the word's ends (so those at an end are its affixes), the whole word, and the lexicons that list it.
Transition weights between languages are learned with them. Labels are marginals of forward-backward; a
document's language is the one with the most expected words.

Training takes word sequences cut from documents of known language, a bounded number for each language
(``per_lang`` documents, picked by hash; ``words`` of each), and joins pieces of up to three documents, so that
sequences switch between languages. Prediction covers all words of whole texts: it works on arrays of characters,
and long texts are cut into blocks whose transfer matrices are multiplied, so a text's length does not matter.

Null text, or text without a letter, gives ``und`` and score 0. Without labelled rows every document is ``und``.
Rows are independent: repeated rows get the same answer. A word is a run of letters and combining marks.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import chunks

#: Rows of the hashed feature table (a power of two), n-gram orders, words of a block.
FEATURES, ORDERS, BLOCK = 1 << 17, 4, 32
_MIX = np.uint32(0x9E3779B1)


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """By code point: 1 letter, 2 combining mark, else 0."""
    kinds = {"L": 1, "M": 2}
    return np.array([kinds.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)], np.uint8)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


@dataclass
class Words:
    """Words of a chunk of texts, as ranges of an array of code points that has a mark before and after each."""

    codes: np.ndarray
    start: np.ndarray  # first letter
    end: np.ndarray  # past the last letter
    text: np.ndarray  # number of the text


def words_of(texts: list[str]) -> Words:
    codes = _codes("\n".join([t.lower().replace("\n", " ") for t in texts]) + "\n")
    kinds = _kinds()[codes]
    inside = np.concatenate([[False], kinds > 0, [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edges[::2], edges[1::2]
    if len(start):
        letters = np.concatenate([[0], np.cumsum(kinds == 1)])
        real = letters[end] > letters[start]
        start, end = start[real], end[real]
    breaks = np.flatnonzero(codes == 10)
    return Words(codes, start, end, np.searchsorted(breaks, start))


def _hashes(words: Words) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row of the feature table, number of the word) for the n-grams of all words, order by order; last the whole words."""
    n = words.end - words.start
    at = np.repeat(words.start - np.concatenate([[0], np.cumsum(n + 2)[:-1]]), n + 2) + np.arange(int((n + 2).sum())) - 1
    word = np.repeat(np.arange(len(n)), n + 2)
    first = np.cumsum(n + 2) - (n + 2)
    edge = np.zeros(len(at), bool)
    edge[first] = True
    edge[first + n + 1] = True
    codes = np.where(edge, 1, words.codes[np.clip(at, 0, len(words.codes) - 1)]).astype(np.uint32)
    out, gram = [], codes * _MIX
    for order in range(1, ORDERS + 1):
        if order > 1:
            gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + codes[order - 1:] * _MIX
        last = len(codes) - order + 1
        same = word[:last] == word[order - 1:] if last > 0 else np.zeros(0, bool)
        mixed = (gram[same] ^ (gram[same] >> np.uint32(13))) * np.uint32(0xC2B2AE35) + np.uint32(order)
        out.append((((mixed ^ (mixed >> np.uint32(16))) & np.uint32(FEATURES - 1)).astype(np.int64), word[:last][same]))
    return out


def _word_keys(words: Words) -> np.ndarray:
    """64-bit keys of whole words."""
    n = words.end - words.start
    if not len(n):
        return np.zeros(0, np.uint64)
    first = np.cumsum(n) - n
    inside = np.arange(int(n.sum())) - np.repeat(first, n)
    codes = words.codes[np.repeat(words.start, n) + inside].astype(np.uint64) + np.uint64(7)
    power = np.cumprod(np.full(int(n.max()), 0x9E3779B97F4A7C15, np.uint64))
    sums = np.add.reduceat(codes * power[inside], first)
    return (sums ^ (sums >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # features x languages
    lexicon: np.ndarray  # sorted keys of listed words
    listed: np.ndarray  # languages of each, 0 or 1
    lexicon_weights: np.ndarray  # languages x languages
    bias: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: Words) -> np.ndarray:
        """Scores of each language for each word; a word that comes again in the chunk is looked up."""
        if not len(words.start):
            return np.zeros((0, len(self.langs)))
        keys, first, again = np.unique(_word_keys(words), return_index=True, return_inverse=True)
        distinct = Words(words.codes, words.start[first], words.end[first], words.text[first])
        out = np.tile(self.bias, (len(keys), 1))
        for rows, word in _hashes(distinct):
            if len(rows):
                heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                out[word[heads]] += np.add.reduceat(self.weights[rows], heads, axis=0)
        if len(self.lexicon):
            at = np.minimum(np.searchsorted(self.lexicon, keys), len(self.lexicon) - 1)
            found = self.lexicon[at] == keys
            out[found] += self.listed[at[found]] @ self.lexicon_weights
        return out[again]

    def marginals(self, emissions: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Probability of each language for each word by forward-backward over each text's chain.

        Chains are cut into blocks; blocks of all texts advance together, first as transfer matrices, then as vectors
        from the block's true borders.
        """
        n, k = emissions.shape
        if not n:
            return emissions
        # a word's odds are held to e^60, so that eight steps stay within doubles
        step = np.exp(self.transitions - self.transitions.max())
        heads = np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        sizes = np.diff(np.append(heads, n))
        blocks = -(-sizes // BLOCK)
        first = np.cumsum(blocks) - blocks  # first block of each chain
        total = int(blocks.sum())
        inside = np.arange(n) - np.repeat(heads, sizes)
        block, row = np.repeat(first, sizes) + inside // BLOCK, inside % BLOCK
        grid = np.ones((BLOCK, total, k))
        used = np.zeros((BLOCK, total), bool)
        grid[row, block] = np.exp(np.maximum(emissions - emissions.max(1, keepdims=True), -60))
        used[row, block] = True
        start = np.zeros((BLOCK, total), bool)  # the first word of a chain has no transition before it
        start[0, first] = True

        def scaled(x):
            return x / x.sum(tuple(range(1, x.ndim)), keepdims=True)

        through = np.tile(np.eye(k), (total, 1, 1))
        for t in range(BLOCK):
            moved = np.where(start[t][:, None, None], through, through @ step) * grid[t][:, None, :]
            through = np.where(used[t][:, None, None], moved, through)
            if t % 8 == 7:  # often enough for doubles
                through = scaled(through)
        begin, finish = np.ones((total, k)) / k, np.ones((total, k)) / k
        last = first + blocks - 1
        for at in range(1, int(blocks.max())):  # borders of long chains, all chains at a time
            own = first[blocks > at]
            begin[own + at] = scaled((begin[own + at - 1][:, None, :] @ through[own + at - 1])[:, 0])
            own = last[blocks > at]
            finish[own - at] = scaled((through[own - at + 1] @ finish[own - at + 1][:, :, None])[:, :, 0])
        ahead = np.empty((BLOCK, total, k))
        vector = begin
        for t in range(BLOCK):
            moved = np.where(start[t][:, None], vector, vector @ step) * grid[t]
            vector = np.where(used[t][:, None], moved, vector)
            if t % 8 == 7:
                vector = scaled(vector)
            ahead[t] = vector
        vector = finish
        out = np.empty((BLOCK, total, k))
        for t in range(BLOCK - 1, -1, -1):
            out[t] = vector
            vector = np.where((used[t] & ~start[t])[:, None], (vector * grid[t]) @ step.T, vector)
            if t % 8 == 0:
                vector = scaled(vector)
        both = ahead[row, block] * out[row, block]
        return both / both.sum(1, keepdims=True)


def _training_set(rows: list[tuple[str, str]], seed: int, length: int) -> tuple[list[str], list[np.ndarray], list[str]]:
    """Sequences of words: pieces of one to three documents each, joined; their labels."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in rows})
    pieces: list[tuple[list[str], int]] = []
    for text, lang in rows:
        words = text.split()
        pieces += [(words[a:a + length], langs.index(lang)) for a in range(0, len(words), length)]
    order = rng.permutation(len(pieces))
    texts, labels, at = [], [], 0
    while at < len(order):
        part = order[at:at + rng.integers(1, 4)]
        at += len(part)
        words, tags = [], []
        for p in part:
            own, tag = pieces[p]
            cut = rng.integers(min(4, len(own)), len(own) + 1) if len(part) > 1 else len(own)
            words += own[:cut]
            tags += [tag] * cut
        texts.append(words)
        labels.append(tags)
    return texts, labels, langs


def fit(rows: list[tuple[str, str]], seed: int = 7, epochs: int = 3, length: int = 48, lexicon_size: int = 2000, rate: float = 0.3) -> Crf | None:
    """Train on (text, lang) rows; AdaGrad on the log-likelihood of the labels. None without rows."""
    sequences, labels, langs = _training_set(rows, seed, length)
    k = len(langs)
    kept_words: list[Words] = []
    kept_tags: list[np.ndarray] = []
    for words, tags in zip(sequences, labels, strict=True):
        found = words_of([" ".join(words)])
        # the tag of a letter run is that of the space-separated word it stands in
        space = np.cumsum(found.codes == 32)
        if len(found.start):
            kept_words.append(found)
            kept_tags.append(np.array(tags)[space[found.start]])
    if not kept_words:
        return None
    counts: dict[int, np.ndarray] = {}
    for found, tags in zip(kept_words, kept_tags, strict=True):
        for key, tag in zip(_word_keys(found).tolist(), tags.tolist(), strict=True):
            counts.setdefault(key, np.zeros(k))[tag] += 1
    listed: dict[int, np.ndarray] = {}
    for lang in range(k):
        best = sorted((key for key, c in counts.items() if c[lang] >= 3 and c[lang] >= 0.6 * c.sum()), key=lambda key: (-counts[key][lang], key))
        for key in best[:lexicon_size]:
            listed.setdefault(key, np.zeros(k))[lang] = 1
    keys = np.array(sorted(listed), np.uint64)
    model = Crf(langs, np.zeros((FEATURES, k), np.float32), keys, np.array([listed[x] for x in keys.tolist()]).reshape(-1, k), np.zeros((k, k)), np.zeros(k), np.zeros((k, k)))
    if k == 1:
        return model
    rng = np.random.default_rng(seed)
    squares = [np.full(x.shape, 1e-6) for x in (model.weights, model.lexicon_weights, model.bias, model.transitions)]
    batch = 32
    for _ in range(epochs):
        order = rng.permutation(len(kept_words))
        for at in range(0, len(order), batch):
            part = order[at:at + batch]
            shift = np.cumsum([0, *[len(kept_words[p].codes) for p in part]])
            words = Words(np.concatenate([kept_words[p].codes for p in part]), np.concatenate([kept_words[p].start + s for p, s in zip(part, shift[:-1], strict=True)]),
                          np.concatenate([kept_words[p].end + s for p, s in zip(part, shift[:-1], strict=True)]), np.repeat(np.arange(len(part)), [len(kept_words[p].start) for p in part]))
            tags = np.concatenate([kept_tags[p] for p in part])
            error = model.marginals(model.emissions(words), words.text)
            pair = words.text[1:] == words.text[:-1]
            # expected transitions from the marginals of neighbours under the current transition weights
            joint = error[:-1][pair][:, :, None] * np.exp(model.transitions)[None] * error[1:][pair][:, None, :] / np.maximum(error[:-1][pair] @ np.exp(model.transitions), 1e-12)[:, None, :]
            expected = (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            seen = np.zeros((k, k))
            np.add.at(seen, (tags[:-1][pair], tags[1:][pair]), 1)
            error[np.arange(len(tags)), tags] -= 1
            gradient = np.zeros(model.weights.shape)
            for rows_, word in _hashes(words):
                for lang in range(k):
                    gradient[:, lang] += np.bincount(rows_, weights=error[word, lang], minlength=FEATURES)
            lexical = np.zeros((k, k))
            if len(keys):
                own = _word_keys(words)
                where = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                hit = keys[where] == own
                lexical = model.listed[where[hit]].T @ error[hit]
            for target, grad, square in zip((model.weights, model.lexicon_weights, model.bias, model.transitions),
                                            (gradient, lexical, error.sum(0), expected - seen + 0.01 * model.transitions), squares, strict=True):
                grad = grad / len(part)
                square += grad * grad
                target -= rate * grad / np.sqrt(square)
    return model


def train(docs: DataFrame, per_lang: int = 300, words: int = 400, most_langs: int = 64, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Crf | None:
    """Fit on at most ``per_lang`` labelled documents of each language, picked by hash of the id, ``words`` words of each.

    The sample is the bounded one a classifier may be fitted on; its choice depends on ids and labels only.
    """
    labelled = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"more than {most_langs} languages")
    rows: list[tuple[str, str]] = []
    for lang, n in sorted(counts.items()):
        share = min(1.0, 2.0 * per_lang / n)  # enough by hash, then the lowest hashes: no sort of the whole table
        key = F.xxhash64(F.col(id_col), F.lit(11))
        part = labelled.where((F.col(lang_col) == lang) & (F.abs(key % 1_000_000) < int(share * 1_000_000) + 1))
        picked = part.orderBy(key, F.xxhash64(text_col)).select(F.array_join(F.slice(F.split(text_col, r"\s+"), 1, words), " ")).limit(per_lang)
        rows += [(r[0], lang) for r in picked.collect()]
    return fit(rows) if rows else None


def predict(docs: DataFrame, model: Crf | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Language of every whole text: ``id_col``, lang_pred, score (share of the expected words), n_words, n_switches
    (neighbouring words whose most likely languages differ), word_langs (expected words of each language, as a map)."""
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, n_words bigint, n_switches bigint, word_langs map<string,double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, text_col, 2 << 20):
            texts = [t or "" for t in batch.column(text_col).to_pylist()]
            found = words_of(texts)
            n = np.bincount(found.text, minlength=len(texts))[:len(texts)]
            langs, scores, switches, maps = ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), np.int64), [[] for _ in texts]
            if model is not None and len(found.start):
                p = model.marginals(model.emissions(found), found.text)
                sums = np.zeros((len(texts), len(model.langs)))
                for lang in range(len(model.langs)):
                    sums[:, lang] = np.bincount(found.text, weights=p[:, lang], minlength=len(texts))[:len(texts)]
                best = p.argmax(1)
                changed = (best[1:] != best[:-1]) & (found.text[1:] == found.text[:-1])
                switches = np.bincount(found.text[1:], weights=changed, minlength=len(texts))[:len(texts)].astype(np.int64)
                top = sums.argmax(1)
                for i in np.flatnonzero(n).tolist():
                    langs[i] = model.langs[top[i]]
                    scores[i] = min(1.0, sums[i, top[i]] / n[i])
                    maps[i] = list(zip(model.langs, sums[i].tolist(), strict=True))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(langs), pa.array(scores), pa.array(n, pa.int64()), pa.array(switches),
                                              pa.array(maps, pa.map_(pa.string(), pa.float64()))], names=[id_col, "lang_pred", "score", "n_words", "n_switches", "word_langs"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
