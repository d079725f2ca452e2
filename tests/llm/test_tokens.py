"""Token operators against the libraries they stand for."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from runsift.llm import arrow_shards, bpe_fst, prefix_tokens

PIECE, WORD, BYTE = (public_tokenizers.path(n) for n in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"))
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(BYTE, "rb"))}
TIK = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def samples(n=300):
    rng = random.Random(3)
    parts = ["a", "e", "th", "▁", " ", "  ", "\n", "\t", "é", "ß", "日", "😀", "\x00", ".", "token", "0", "17", "İ", "<s>", "<0x0A>", "|", "a" * 20, " " * 17, "l'", "<|endoftext|>", "\x1c", "Σ"]
    return ["", " ", "a", " " * 100 + "b" + " " * 33, "x" * 3000, *("".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(n))]


def test_prefix_counts_equal_the_library(corpus, long_text):
    texts = [*samples(), long_text, None]
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: r for r in prefix_tokens.token_counts(corpus(texts), PIECE, budget=40).collect()}
    for i, text in enumerate(texts):
        n = len(model.encode(text or ""))
        assert (got[i].n_bytes, got[i].n_tokens, got[i].over_limit) == (len((text or "").encode()), n, n > 40)


def test_every_prefix_and_cut(corpus):
    texts = samples(40)
    model = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for r in prefix_tokens.token_counts(corpus(texts), PIECE, budget=5, prefixes=True).collect():
        text = texts[r.doc_id]
        if len(text) > 200:
            continue
        want = [len(model.encode(text[:i])) for i in range(len(text) + 1)]
        assert r.prefix_counts == want
        assert r.limit_chars == max(i for i, n in enumerate(want) if n <= 5)


def test_transducer_equals_the_library(corpus, long_text):
    texts = [*samples(), long_text, None]
    for r in bpe_fst.encode_decode(corpus(texts), BYTE, public_tokenizers.PATTERN).collect():
        text = texts[r.doc_id] or ""
        ids = TIK.encode_ordinary(text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and r.decoded == text
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_transducer_emits_before_the_end():
    fst = bpe_fst.Transducer(RANKS)
    state, sure = fst.start, []
    for byte in b"internationalisationinternational":
        state, out = fst._move(state, byte)
        sure += out
    assert sure and sure + list(fst._end(state)) == TIK.encode_ordinary("internationalisationinternational")


def test_utf8_machine_like_replacement():
    vocab = [bytes((b,)) for b in range(256)]
    machine = bpe_fst.Utf8Machine(vocab)
    rng = random.Random(4)
    for _ in range(2000):
        data = bytes(rng.choice([65, 0xC3, 0xA9, 0xE2, 0x82, 0xAC, 0xF0, 0x9F, 0x98, 0x80, 0xED, 0xA0, 0xFF]) for _ in range(rng.randint(0, 9)))
        assert machine.decode(list(data)) == data.decode("utf-8", "replace")


def test_empty_tables(corpus):
    none = corpus([])
    assert prefix_tokens.token_counts(none, PIECE).count() == 0
    assert bpe_fst.encode_decode(none, BYTE, public_tokenizers.PATTERN).count() == 0
    assert arrow_shards.read_documents(arrow_shards.write_shards(none, WORD, 2)).count() == 0


def test_shards_round_trip(corpus, long_text):
    texts = [*samples(150), long_text, None]
    ids = [5 * i for i in range(len(texts))][::-1]
    manifest = arrow_shards.write_shards(corpus(texts, ids), WORD, 2, length=64)
    tool, base = Tokenizer.from_file(WORD), 0
    got = sorted(arrow_shards.read_documents(manifest).collect())
    for r, (doc, text) in zip(got, sorted(zip(ids, texts, strict=True)), strict=True):
        want = [*tool.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens) == (doc, base, len(want))
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes()) and r.ids == np.array(want, "<u4").tobytes()
        base += len(want)
    for m in manifest.collect():
        file = arrow_shards.SequenceFile(m.tokens_file)
        sequences = [file[i] for i in range(len(file))]
        assert sum(int(mask.sum()) for _, mask in sequences) == m.n_tokens
        assert all(len(t) == 64 and mask.all() for t, mask in sequences[:-1])


def test_repeated_rows_follow_each_other(corpus):
    got = arrow_shards.read_documents(arrow_shards.write_shards(corpus(["b", "a", "a"], [1, 1, None]), WORD, 2)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, 1, 1] and [r.start for r in got] == [0, 2, 4]


def test_transducer_states_hold_no_token_before():
    """States with the same open bytes and splits are one, whatever token came before them."""
    rng = random.Random(6)
    parts = ["re", "th", "tion", "ing", "oush", "he", "an", "é", "ß", "nd", "bler"]
    fst = bpe_fst.Transducer(RANKS)
    for _ in range(2000):
        word = "".join(rng.choice(parts) for _ in range(rng.randint(2, 6)))
        assert fst.encode(word.encode()) == TIK.encode_ordinary(word)
    assert len(fst.states) == len({s[-3:-1] for s in fst.states})


def test_letter_words_outlast_the_table_of_words():
    """Words with marks fill the table of words again and again; the letters in them are encoded once."""
    tool, seen = bpe_fst.Codec(BYTE, public_tokenizers.PATTERN, most=60), []
    encode = tool.fst.encode
    tool.fst.encode = lambda piece: seen.append(piece) or encode(piece)
    shards = arrow_shards.WordEncoder(WORD, most=60)
    learn, asked = shards._letter_words, []
    shards._letter_words = lambda words: asked.extend(words) or learn(words)
    for k in range(40):
        text = " ".join(["so", *(f"{w}{mark}" for w in ("qwertz", "asdfgh", "yxcvbn") for mark in ("", ".", ",", f"!{k}", f"?{k}", f"#{k}"))])
        assert np.frombuffer(tool.encode(text), "<u4").tolist() == TIK.encode_ordinary(text)
        assert np.frombuffer(shards.encode([text])[0], shards.width).tolist() == shards.tool.encode(text, add_special_tokens=False).ids
    assert seen.count(b" qwertz") == 1 and asked.count("qwertz") == 1
