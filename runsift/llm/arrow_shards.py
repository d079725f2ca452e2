"""Token ids as Arrow files of equal-length sequences.

Documents are dealt by range of id, so shard k holds ids below those of shard k + 1. A shard is one file in
the Arrow IPC file format whose batches have ``tokens`` and ``mask`` as fixed-size lists: sequence i is row
i % BATCH of batch i // BATCH, read without copying. Only the last sequence of a shard is padded (mask
false). A second Arrow file lists the shard's documents with their first id and length.

Files get names of their own for each task attempt, and only those listed in the manifest, a table written when
all shards are, are ever read: attempts that a lost executor leaves behind do not count. Files go to the shared
folder through ``pyarrow.fs``, by its URI (file, hdfs, s3, gs).

Null texts are empty documents; documents without an id come first; rows with one id follow each other in
order of a hash of their text.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runsift.llm.common import chunks, shared_path

#: Ids in a sequence and sequences in a batch.
SEQUENCE, BATCH = 2048, 64
#: Control characters that split() drops and the tokenizer may not; texts with them are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85]")
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ɏ]+")


class WordEncoder:
    """Ids by the tokenizers library; white space always ends a token, so words met before are looked up."""

    def __init__(self, path: str, most: int = 500_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.width = np.dtype("<u2" if max(self.tool.get_vocab().values()) < 1 << 16 else "<u4")
        vocab = self.tool.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.words: dict[str, bytes] = {}
        self.letters: dict[str, bytes] = {}  # words of letters: outlasts the other table, which holds them with a mark as well
        self.most = most

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _letter_words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters, encoded many at a time as one text: the token that ends each word is marked as such."""
        out: list[bytes] = []
        texts = [" ".join(words[at:at + 256]) for at in range(0, len(words), 256)]
        for at, ids in enumerate(self._ids(texts)):
            ids = np.frombuffer(ids, self.width)
            ends = np.flatnonzero(self.last[ids]) + 1
            part = words[at * 256:at * 256 + 256]
            if len(ends) == len(part):
                data, step = ids.tobytes(), self.width.itemsize
                edges = [0, *(ends * step).tolist()]
                out += [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]
            else:
                out += self._ids(part)
        return out

    def _learn(self, new: set[str]) -> None:
        """Put the ids of new words into the tables."""
        known, letters = self.words, self.letters
        if len(letters) > self.most:
            letters.clear()
        marked = [w for w in new if w[-1] in ".," and _LETTERS.fullmatch(w, 0, len(w) - 1)]
        new.difference_update(marked)
        stems = [w[:-1] for w in marked]
        plain = [w for w in new if w not in letters and not _LETTERS.fullmatch(w)]
        spelt = list({w for w in [*new.difference(plain), *stems] if w not in letters})
        letters.update(zip(spelt, self._letter_words(spelt), strict=True))
        known.update([(w, letters[w]) for w in new.difference(plain)])
        plain += {".", ","} - known.keys() - set(plain)
        for at in range(0, len(plain), 4096):
            part = plain[at:at + 4096]
            known.update(zip(part, self._ids(part), strict=True))
        known.update([(w, letters[stem] + known[w[-1]]) for w, stem in zip(marked, stems, strict=True)])  # letters, then one full stop or comma: the ids of each

    def encode(self, texts: list[str]) -> list[bytes]:
        known, split = self.words, [None if _ODD.search(t) else t.split() for t in texts]
        if len(known) > self.most:
            known.clear()
        found = [None if words is None else list(map(known.get, words)) for words in split]
        gaps = [(words, ids, [k for k, x in enumerate(ids) if x is None]) for words, ids in zip(split, found, strict=True) if ids and None in ids]
        if gaps:
            self._learn({words[k] for words, _, places in gaps for k in places})
        for words, ids, places in gaps:
            for k in places:
                ids[k] = known[words[k]]
        return [self._ids([t])[0] if ids is None else b"".join(ids) for t, ids in zip(texts, found, strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[\w+.-]+://?", uri) else f"file://{uri}")


def _sequences(tokens: np.ndarray, valid: int, length: int) -> pa.RecordBatch:
    mask = np.arange(len(tokens)) < valid
    return pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(tokens), length), pa.FixedSizeListArray.from_arrays(pa.array(mask), length)],
                                      names=["tokens", "mask"])


class ShardWriter:
    """Append documents; keeps at most one batch of ids in memory."""

    def __init__(self, fs, path: str, width: np.dtype, length: int):
        self.length, self.width = length, width
        empty = _sequences(np.zeros(0, width), 0, length)
        self.out = fs.open_output_stream(path)
        self.file = pa.ipc.new_file(self.out, empty.schema)
        self.left = np.zeros(0, width)
        self.total = 0

    def add(self, documents: list[bytes], end: bytes) -> None:
        """Ids of documents, each followed by ``end``; joined once, whatever the number of documents."""
        ids = np.frombuffer(end.join([*documents, b""]), self.width)
        self.total += len(ids)
        most = self.length * BATCH
        if len(self.left) + len(ids) < most:
            self.left = np.concatenate([self.left, ids])
            return
        head = most - len(self.left)
        self.file.write_batch(_sequences(np.concatenate([self.left, ids[:head]]), most, self.length))
        while len(ids) - head >= most:
            self.file.write_batch(_sequences(ids[head:head + most], most, self.length))
            head += most
        self.left = ids[head:].copy()

    def close(self) -> None:
        if n := len(self.left):
            padded = np.zeros(-(-n // self.length) * self.length, self.width)
            padded[:n] = self.left
            self.file.write_batch(_sequences(padded, n, self.length))
        self.file.close()
        self.out.close()


class SequenceFile:
    """Random access to the sequences of one shard, without copying."""

    def __init__(self, uri: str):
        fs, path = _filesystem(uri)
        source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.file = pa.ipc.open_file(source)
        self.n_batches = self.file.num_record_batches
        self.length = self.file.schema.field("tokens").type.list_size

    def __len__(self) -> int:
        return (self.n_batches - 1) * BATCH + self.file.get_batch(self.n_batches - 1).num_rows if self.n_batches else 0

    def batch(self, k: int) -> np.ndarray:
        """All ids of a batch, one after the other."""
        return self.file.get_batch(k).column("tokens").values.to_numpy()

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, mask) of sequence i."""
        batch, row = self.file.get_batch(i // BATCH), i % BATCH
        part = slice(row * self.length, (row + 1) * self.length)
        return batch.column("tokens").values.to_numpy()[part], batch.column("mask").values.to_numpy(zero_copy_only=False)[part]

    def ids(self, start: int, n: int) -> np.ndarray:
        """Ids start .. start + n of the shard; a view unless they cross batches."""
        most, parts = self.length * BATCH, []
        while n > 0:
            part = self.batch(start // most)[start % most:start % most + n]
            parts.append(part)
            start, n = start + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.zeros(0, np.uint16)


def write_shards(docs: DataFrame, path: str, end_id: int, folder: str | None = None, length: int = SEQUENCE,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text, append ``end_id``, and write shards to ``folder`` (default: a new one in the shared folder).

    Returns the manifest, read from the table it was written to: shard, tokens_file, docs_file, n_docs, n_tokens.
    """
    spark = docs.sparkSession
    folder = folder or shared_path(spark, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tool, shard = encoder(path), TaskContext.get().partitionId()
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        name = f"shard-{shard:06d}-{uuid.uuid4().hex[:12]}"
        tokens, index, table, n_docs = None, None, None, 0
        for batch in chunks(batches, text_col, 2 << 20):
            tokens = tokens or ShardWriter(fs, f"{root}/{name}.tokens.arrow", tool.width, length)
            found = tool.encode([t or "" for t in batch.column(text_col).to_pylist()])
            sizes = np.array([len(ids) // tool.width.itemsize + 1 for ids in found], np.int64)
            starts = tokens.total + np.cumsum(sizes) - sizes
            tokens.add(found, tool.width.type(end_id).tobytes())
            rows = pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], names=["doc", "start", "n_tokens"])
            if index is None:
                index = fs.open_output_stream(f"{root}/{name}.docs.arrow")
                table = pa.ipc.new_file(index, rows.schema)
            table.write_batch(rows)
            n_docs += len(starts)
        if tokens is not None:
            tokens.close()
            table.close()
            index.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "tokens_file": [f"{folder}/{name}.tokens.arrow"], "docs_file": [f"{folder}/{name}.docs.arrow"],
                                              "n_docs": [n_docs], "n_tokens": [tokens.total]},
                                             pa.schema([("shard", pa.int32()), ("tokens_file", pa.string()), ("docs_file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))

    order = [F.col(id_col).asc_nulls_first(), F.xxhash64(text_col)]
    dealt = docs.select(id_col, text_col).repartitionByRange(*order).sortWithinPartitions(*order)
    manifest = f"{folder}/manifest"
    dealt.mapInArrow(run, "shard int, tokens_file string, docs_file string, n_docs bigint, n_tokens bigint").write.parquet(manifest)
    return spark.read.parquet(manifest)


def read_documents(manifest: DataFrame, id_col: str = "doc_id", id_type: str = "bigint", keep: bool = True) -> DataFrame:
    """Documents from the files of a manifest: id, start (ids of all documents before it), n_tokens, ids_crc32, ids (with ``keep``).

    A shard's offset is the sum over the shards before it; there is one row a shard, and no other row is gathered.
    """
    spark = manifest.sparkSession
    base, rows = 0, []
    for r in sorted(manifest.select("shard", "tokens_file", "docs_file", "n_tokens").collect()):
        rows.append((r[1], r[2], base))
        base += r[3]
    schema = f"{id_col} {id_type}, start bigint, n_tokens bigint, ids_crc32 bigint, ids binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                tokens = SequenceFile(r["tokens_file"])
                fs, path = _filesystem(r["docs_file"])
                docs = pa.ipc.open_file(fs.open_input_file(path))
                for k in range(docs.num_record_batches):
                    part = docs.get_batch(k)
                    starts, sizes = part.column("start").to_numpy(), part.column("n_tokens").to_numpy()
                    ids = [tokens.ids(s, n).astype("<u4").tobytes() for s, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(starts + r["base"]), pa.array(sizes), pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                                                      pa.array(ids if keep else [None] * len(ids), pa.binary())], names=[id_col, "start", "n_tokens", "ids_crc32", "ids"])

    files = spark.createDataFrame(rows, "tokens_file string, docs_file string, base bigint")
    return files.repartition(max(1, len(rows))).mapInArrow(run, schema)
