"""Token counts by prefix dynamic programming over a sentencepiece BPE model.

For every prefix of a text the table holds the last token of its encoding and the number of tokens:
``count[i] = count[i - len(last[i])] + 1``, where ``last[i]`` is the one token that ends at ``i`` and may
stand after ``last[i - len(last[i])]``. So every prefix has its exact count, and questions of truncation
and budget need no further encoding. No piece crosses from a word into the next space, so the table is
built word by word, and words met before are looked up (in a table emptied at a bound).

Null and empty texts have no tokens. Rows are independent: no shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from runsift.llm.bpe import PairRule
from runsift.llm.common import chunks

MARK = "▁"
_WORDS = re.compile(f"{MARK}+[^{MARK}]*")


class PrefixTable:
    """Prefix counts of words, for one model file."""

    def __init__(self, path: str, most: int = 700_000):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        order = {s: k for k, s in enumerate(sorted({model.get_score(i) for i in normal}, reverse=True))}
        # only runs of spaces share a rank
        self.rule = PairRule({model.id_to_piece(i): order[model.get_score(i)] for i in normal}, ties=lambda left, right: left[-1] == MARK)
        crossing = [p for p in self.rule.rank if MARK in p[1:] and p.strip(MARK)]
        if crossing:
            raise ValueError(f"pieces cross word boundaries: {crossing[:3]}")
        if model.encode(" a") == model.encode("a") or model.encode(" a", out_type=str)[-1:] != ["a"]:
            raise ValueError("only models with a dummy prefix and without normalisation are supported")
        self.words: dict[str, tuple] = {}
        self.most = most

    def word(self, word: str) -> tuple[list, list]:
        """(last token, count) of every prefix of one word, the empty prefix first."""
        rule = self.rule
        rank, longest, whole, fits = rule.rank, rule.longest, rule.whole, rule.fits
        last: list = [""]
        count = [0]
        known = self.words.get(word[:-1])
        if known is not None:
            last, count = list(known[0]), list(known[1])
        for i in range(len(last), len(word) + 1):
            got, n = None, 0
            for j in range(max(0, i - longest), i):
                token = word[j:i]
                if token in rank and (before := last[j]) is not None and whole(token) and (not before or before not in rank or fits(before, token)):
                    got, n = token, count[j] + 1
                    break
            if got is None and (char := word[i - 1]) not in rank:  # byte fallback
                got, n = char, count[i - 1] + len(char.encode("utf-8", "surrogatepass"))
            last.append(got)
            count.append(n)
        return last, count

    def of(self, word: str) -> tuple[list, list]:
        got = self.words.get(word)
        if got is None:
            got = self.word(word)
            if len(word) <= 48:
                if len(self.words) >= self.most:
                    self.words.clear()
                self.words[word] = got
        return got

    @staticmethod
    def split(text: str) -> list[str]:
        """Words with the spaces before them; the first has the model's own leading space."""
        return _WORDS.findall(MARK + text.replace(" ", MARK)) if text else []


class Counter(PrefixTable):
    """Counts of whole texts; keeps one number for each word met, and tables only where a cut falls."""

    def __init__(self, path: str, most: int = 1_200_000):
        super().__init__(path, most=60_000)
        self.total: dict[str, int] = {}
        self.most_totals = most

    def _total(self, word: str) -> int:
        got = self.total.get(word)
        if got is None:
            got = (self.of(word) if len(word) < 24 else self.word(word))[1][-1]
            if len(word) <= 48:
                if len(self.total) >= self.most_totals:
                    self.total.clear()
                self.total[word] = got
        return got

    def counts(self, words: list[str]) -> list[int]:
        found = list(map(self.total.get, words))
        if None in found:
            found = [self._total(w) if c is None else c for w, c in zip(words, found, strict=True)]
        return found

    def cut(self, words: list[str], counts: list[int], budget: int) -> int:
        """Characters of the longest prefix of the text with at most ``budget`` tokens."""
        left, at = budget, 0
        for word, n in zip(words, counts, strict=True):
            if n > left:
                inside = self.word(word)[1]
                at += max(i for i, c in enumerate(inside) if c <= left)
                break
            left -= n
            at += len(word)
        return max(0, at - 1)  # the leading space is the model's


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, budget: int = 4096, prefixes: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exact token count of every whole text and the longest prefix within ``budget`` tokens.

    Returns ``id_col``, n_bytes, n_tokens, over_limit (n_tokens > budget), limit_chars (characters of the longest
    prefix of at most ``budget`` tokens) and prefix_counts (with ``prefixes``: tokens of each prefix of 0, 1, 2, ...
    characters; else null). Null texts count as empty.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_bytes bigint, n_tokens bigint, over_limit boolean, limit_chars bigint, prefix_counts array<int>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = counter(path)
        for batch in chunks(batches, text_col):
            sizes, totals, cuts, tables = [], [], [], []
            for text in batch.column(text_col).to_pylist():
                text = text or ""
                words = tool.split(text)
                counts = tool.counts(words)
                n = sum(counts)
                sizes.append(len(text.encode()))
                totals.append(n)
                cuts.append(tool.cut(words, counts, budget) if n > budget else len(text))
                if prefixes:
                    row, base = [0], 0
                    for k, word in enumerate(words):
                        inside = tool.word(word)[1]
                        row.extend(base + c for c in (inside[2:] if k == 0 else inside[1:]))
                        base += inside[-1]
                    tables.append(row)
            yield pa.RecordBatch.from_arrays([
                batch.column(id_col), pa.array(sizes, pa.int64()), pa.array(totals, pa.int64()), pa.array([n > budget for n in totals]),
                pa.array(cuts, pa.int64()), pa.array(tables if prefixes else [None] * len(totals), pa.list_(pa.int32())),
            ], names=[id_col, "n_bytes", "n_tokens", "over_limit", "limit_chars", "prefix_counts"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
