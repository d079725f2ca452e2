"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A state of the transducer is (last token that is certain, bytes whose tokens are still open); moves are kept by the
open bytes alone, with a choice where the last token matters. One more byte gives the next state and the tokens that no continuation can change any more; a token is certain
after a lookahead of at most the longest token. States and moves are built when first met and kept in
tables that are emptied at a bound, so memory does not grow with the corpus. Decoding maps ids to bytes
and runs an incremental UTF-8 machine over them, whose moves are kept by (state, token).

Null and empty texts give no tokens. Rows are independent: no shuffle, ties and repeated rows do not matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runsift.llm.bpe import PairRule
from runsift.llm.common import chunks


#: White space on both sides of a space.
_WIDE = re.compile(r"\s \s")


class Transducer:
    """Tokens of one pre-split piece of text, byte by byte.

    States are kept without the certain token before them: all that a move needs of it is whether the open bytes, where
    they are one token, may follow it. So states with the same open bytes and splits are one, whatever came before.
    """

    def __init__(self, ranks: dict[bytes, int], most_states: int = 300_000):
        self.ranks, self.rule, self.most = ranks, PairRule(ranks, most=300_000), most_states
        self.open = {t[:n] for t in ranks for n in range(1, len(t))}  # proper prefixes of tokens
        self._reset()

    def _reset(self) -> None:
        self.number: dict[tuple, int] = {}
        self.states: list[tuple] = []
        self.moves: dict[int, list] = {}  # by state * 256 + byte: open bytes if they are a token, move if they may not stand there, move if they may
        self.ends: dict[int, tuple] = {}
        self.start = None, self._state(b"", (0,), (0,))

    def _state(self, data: bytes, starts: tuple[int, ...], live: tuple[int, ...]) -> int:
        """``starts[i]``: where the last token of the first i open bytes begins; -1 if no path through the certain token leads
        there. ``live``: places, in order, from which a longer token can still start."""
        got = self.number.get((data, starts))
        if got is None:
            got = self.number[data, starts] = len(self.states)
            self.states.append((data, starts, live))
        return got

    def _made(self, state: int, byte: int, fits: bool) -> tuple[int, tuple, bytes | None]:
        """Next state, tokens that are certain now, the last of them; ``fits``: all open bytes are a token that may follow the certain one."""
        data, starts, live = self.states[state]
        rule, ranks, open_ = self.rule, self.ranks, self.open
        data += bytes((byte,))
        end, begin, still = len(data), 0 if fits else -1, []
        for j in live:  # the first that fits is the last token of the longer prefix
            token = data[j:]
            if begin < 0 and j and token in ranks and rule.whole(token) and rule.fits(data[starts[j]:j], token):
                begin = j
            if token in open_:
                still.append(j)
        starts += (begin,)
        path = [end]
        while path[-1]:
            path.append(starts[path[-1]])
        certain = end
        for j in still:
            while j not in path:
                j = starts[j]
            if j < certain:
                certain = j
                if not j:
                    break
        still.append(end)
        if not certain:
            return self._state(data, starts, tuple(still)), (), None
        out = tuple([ranks[data[starts[i]:i]] for i in reversed(path) if 0 < i <= certain])
        last, kept = data[starts[certain]:certain], [0]
        for i in range(certain + 1, end + 1):
            before = starts[i] - certain
            kept.append(before if before >= 0 and kept[before] >= 0 else -1)
        return self._state(data[certain:], tuple(kept), tuple([j - certain for j in still])), out, last

    def _choice(self, state: int, byte: int) -> list:
        data = self.states[state][0] + bytes((byte,))
        return [data if data in self.ranks and self.rule.whole(data) else None, None, None]

    def _run(self, at: tuple[bytes | None, int], data: bytes, out: list[int]) -> tuple[bytes | None, int]:
        """Move over ``data`` from (certain token, state), and add the tokens that are certain to ``out``."""
        (prev, state), moves, fits = at, self.moves, self.rule.fits
        for byte in data:
            key = state << 8 | byte
            choice = moves.get(key)
            if choice is None:
                choice = moves[key] = self._choice(state, byte)
            token = choice[0]
            good = 2 if token is not None and (prev is None or fits(prev, token)) else 1
            move = choice[good]
            if move is None:
                move = choice[good] = self._made(state, byte, good == 2)
            state, sure, last = move
            if sure:
                out += sure
                prev = last
        return prev, state

    def _move(self, at: tuple[bytes | None, int], byte: int) -> tuple[tuple[bytes | None, int], list]:
        out: list[int] = []
        return self._run(at, bytes((byte,)), out), out

    def _end(self, at: tuple[bytes | None, int]) -> tuple:
        rest = self.ends.get(at[1])
        if rest is None:
            data, starts, _ = self.states[at[1]]
            out, end = [], len(data)
            while end:
                out.append(self.ranks[data[starts[end]:end]])
                end = starts[end]
            rest = self.ends[at[1]] = tuple(out[::-1])
        return rest

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(self.states) > self.most:
            self._reset()
        out: list[int] = []
        out += self._end(self._run(self.start, piece, out))
        return out


class Utf8Machine:
    """Incremental UTF-8: a state is (bytes so far of an unfinished character). Bad bytes become U+FFFD, as ``errors="replace"``."""

    def __init__(self, vocab: list[bytes]):
        self.vocab = vocab
        self.moves: dict[bytes, dict[int, tuple[bytes, str]]] = {b"": {}}
        self.plain: list[str | None] = []  # tokens of whole characters
        for token in vocab:
            rest, text = self.feed(b"", token)
            self.plain.append(text if rest == b"" and text.encode() == token else None)

    @staticmethod
    def _need(lead: int) -> int:
        return 1 if lead < 0x80 else 2 if 0xC2 <= lead <= 0xDF else 3 if 0xE0 <= lead <= 0xEF else 4 if 0xF0 <= lead <= 0xF4 else 0

    @staticmethod
    def _second(lead: int) -> tuple[int, int]:
        """Range of the byte after ``lead``: no overlong forms, surrogates, or code points past U+10FFFF."""
        return {0xE0: (0xA0, 0xBF), 0xED: (0x80, 0x9F), 0xF0: (0x90, 0xBF), 0xF4: (0x80, 0x8F)}.get(lead, (0x80, 0xBF))

    def feed(self, state: bytes, token: bytes) -> tuple[bytes, str]:
        """(state, bytes) to (next state, finished text)."""
        out: list[str] = []
        for byte in token:
            if state:
                low, high = self._second(state[0]) if len(state) == 1 else (0x80, 0xBF)
                if low <= byte <= high:
                    state += bytes((byte,))
                    if len(state) == self._need(state[0]):
                        out.append(state.decode())
                        state = b""
                    continue
                out.append("�")
                state = b""
            need = self._need(byte)
            if need == 1:
                out.append(chr(byte))
            elif need:
                state = bytes((byte,))
            else:
                out.append("�")
        return state, "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Tokens of whole characters are looked up; the machine runs over the stretches between them."""
        if len(ids) < 2:
            return "".join(self.stream(ids))
        pieces = itemgetter(*ids)(self.plain)
        if None in pieces:
            pieces, at = list(pieces), 0
            while at < len(pieces):
                if pieces[at] is None:
                    end = at + 1
                    while end < len(pieces) and pieces[end] is None:
                        end += 1
                    pieces[at:end] = ["".join(self.stream(ids[at:end])), *[""] * (end - at - 1)]
                    at = end
                at += 1
        return "".join(pieces)

    def stream(self, ids) -> Iterator[str]:
        """Text as tokens come in; an unfinished character waits for its other bytes."""
        state = b""
        for i in ids:
            known = self.moves.setdefault(state, {})
            step = known.get(i)
            if step is None:
                step = known[i] = self.feed(state, self.vocab[i])
            state, text = step
            if text:
                yield text
        if state:
            yield "�"


class Codec:
    """Encoder and decoder for one rank file and split pattern; ``most`` bounds the tables of finished pieces and words."""

    def __init__(self, path: str, pattern: str, most: int = 600_000):
        import regex

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}
        vocab = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            vocab[i] = token
        self.split, self.fst, self.utf8, self.vocab = regex.compile(pattern).findall, Transducer(ranks), Utf8Machine(vocab), vocab
        self.done: dict[str, bytes] = {}  # pieces of the pattern, but for a space with letters
        self.letters: dict[str, bytes] = {}  # a space and letters: outlasts the table of words, which holds much that is soon made of these
        self.words: dict[str, bytes] = {}  # a space and what stands up to the next one
        self.most = most

    def _known(self, table: dict[str, bytes], key: str, piece: str) -> bytes:
        value = table.get(key)
        if value is None:
            ids = self.fst.encode(piece.encode())
            value = struct.pack(f"<{len(ids)}I", *ids)
            if len(key) <= 64:
                if len(table) >= self.most:
                    table.clear()
                table[key] = value
        return value

    def _pieces(self, text: str) -> bytes:
        out = []
        for piece in self.split(text):
            word = piece[1:] if piece[0] == " " else ""
            out.append(self._known(self.letters, word, piece) if word.isalpha() else self._known(self.done, piece, piece))
        return b"".join(out)

    def _word(self, word: str) -> bytes:
        """Ids of a space and ``word``, which holds no space."""
        if word.isalpha():
            return self._known(self.letters, word, " " + word)
        if word[-1] in ".," and word[:-1].isalpha():
            return self._known(self.letters, word[:-1], " " + word[:-1]) + self._known(self.done, word[-1], word[-1])
        return self._pieces(" " + word)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers.

        With one space between words and no other white space on both sides of it, no match of the pattern goes over
        a space, so that each word has its ids whatever stands around it.
        """
        if "  " in text or text[-1:] == " " or _WIDE.search(text):
            return self._pieces(text)
        first, *words = text.split(" ")
        found = list(map(self.words.get, words))
        if None in found:
            if len(self.words) > self.most:
                self.words.clear()
            for k in [k for k, value in enumerate(found) if value is None]:
                word = words[k]
                value = self.words.get(word)
                if value is None:
                    value = self._word(word)
                    if len(word) <= 64:
                        self.words[word] = value
                found[k] = value
        return self._pieces(first) + b"".join(found)

    def decode(self, ids: bytes) -> str:
        return self.utf8.decode(np.frombuffer(ids, "<u4").tolist())


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def encode_decode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
    """Token ids of every whole text and the text decoded from them.

    Returns ``id_col``, n_tokens, ids (binary, little-endian unsigned 32-bit; null unless ``keep``), decoded
    (string, null unless ``keep``), ids_sha256 and decoded_sha256 of ids and of the decoded bytes.
    """
    schema = f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens bigint, ids binary, decoded string, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = codec(path, pattern)
        for batch in chunks(batches, text_col):
            ids = [tool.encode(t) if t else b"" for t in batch.column(text_col).to_pylist()]
            texts = [tool.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([
                batch.column(id_col), pa.array([len(i) // 4 for i in ids], pa.int64()),
                pa.array(ids if keep else [None] * len(ids), pa.binary()), pa.array(texts if keep else [None] * len(ids), pa.string()),
                pa.array([hashlib.sha256(i).hexdigest() for i in ids]), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts]),
            ], names=[id_col, "n_tokens", "ids", "decoded", "ids_sha256", "decoded_sha256"])

    return docs.select(id_col, text_col).mapInArrow(run, schema)
