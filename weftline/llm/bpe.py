"""Byte-level BPE by a priority queue of merge ranks over a linked symbol list.

``encode_documents`` gives each document's token ids, ``decode_documents`` turns
ids back into text. Texts are cut where the vocabulary's own word pattern always
cuts, so a word's ids do not depend on its surroundings and can be remembered.

Defined cases: a null text is the empty text, which has no ids; a special token's
string inside a text becomes that token's id, as the tokenizers library does by
default; rows that repeat give rows that repeat; other columns are dropped.
"""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from weftline.llm.common import texts

#: Words that a worker remembers before it forgets the older half, and the longest word that it remembers, in characters.
REMEMBERED, LONGEST = 400_000, 64

# The word pattern of the byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Remembered(dict):
    """A dictionary of short strings that computes what it lacks and keeps two generations at most, so its bytes are bounded."""

    def __init__(self, compute, most: int = REMEMBERED):
        super().__init__()
        self.compute, self.most, self.older = compute, most, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if isinstance(key, str) and len(key) > LONGEST:
            return value
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def byte_symbols() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(rest)}


class ByteBpe:
    """Encoder and decoder of one byte-level vocabulary file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        self.merges = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}
        symbols = byte_symbols()
        self.first = [vocab[symbols[b]] for b in range(256)]
        back = {s: b for b, s in symbols.items()}
        self.pieces = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces |= {i: s.encode() for s, i in self.special.items()}
        self.words = regex.compile(WORDS)
        self.special_cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.by_word = Remembered(self._merge)
        self.by_chunk = Remembered(self._chunk)

    def _merge(self, word: str) -> bytes:
        """The ids of one word as little-endian 32-bit integers."""
        ids = [self.first[b] for b in word.encode()]
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = []
        merges = self.merges
        for i in range(n - 1):
            if found := merges.get((ids[i], ids[i + 1])):
                heap.append((found[0], i, ids[i], ids[i + 1], found[1]))
        heapq.heapify(heap)
        while heap:
            _, i, a, b, joined = heapq.heappop(heap)
            j = right[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:  # stale: one of the two has merged meanwhile
                continue
            ids[i], ids[j] = joined, -1
            k = right[i] = right[j]
            if k >= 0:
                left[k] = i
                if found := merges.get((joined, ids[k])):
                    heapq.heappush(heap, (found[0], i, joined, ids[k], found[1]))
            if (h := left[i]) >= 0 and (found := merges.get((ids[h], joined))):
                heapq.heappush(heap, (found[0], h, ids[h], joined, found[1]))
        return b"".join(x.to_bytes(4, "little") for x in ids if x >= 0)

    def _chunk(self, chunk: str) -> bytes:
        return b"".join(map(self.by_word.__getitem__, self.words.findall(chunk)))

    def _plain(self, text: str) -> bytes:
        # A single space between two non-space characters always begins a word.
        if DOUBLE.search(text):
            chunks = SINGLE.split(text)
        else:
            chunks = text.split(" ")
        head = chunks[0]
        return b"".join((self.by_chunk[head] if head else b"", *map(self.by_chunk.__getitem__, [" " + c for c in chunks[1:]])))

    def encode(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if self.special_cut and any(s in text for s in self.special):
            parts = self.special_cut.split(text)
            return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else self._plain(p) for k, p in enumerate(parts))
        return self._plain(text)

    def decode(self, ids) -> str:
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", errors="replace")


DOUBLE = re.compile(r"\s\s")
SINGLE = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=4)
def codec(path: str) -> ByteBpe:
    """The worker's own codec of a vocabulary file."""
    return ByteBpe(path)


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>) of each document; no shuffle."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = codec(vocabulary)
        for batch in batches:
            ids = [np.frombuffer(own.encode(t), dtype="<i4") for t in batch.column(1).to_pylist()]
            ends = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=[id_col, "ids"])

    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return texts(docs, id_col, text_col).mapInArrow(encode, schema)


def decode_documents(encoded: DataFrame, vocabulary: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of each row of ids; null ids decode to the empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(vocabulary)
        for batch in batches:
            out = [own.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[id_col, "text"])

    schema = T.StructType([encoded.schema[id_col], T.StructField("text", T.StringType())])
    return encoded.select(id_col, ids_col).mapInArrow(decode, schema)


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ids (binary, little-endian 32-bit) and the decoded text's UTF-8, in one pass."""

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        own = codec(vocabulary)
        for batch in batches:
            ids = [own.encode(t) for t in batch.column(1).to_pylist()]
            back = [own.decode(np.frombuffer(x, dtype="<u4").tolist()).encode() for x in ids]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.array(back, pa.binary())], names=[id_col, "ids", "decoded"])

    schema = T.StructType([docs.schema[id_col], T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.BinaryType())])
    return texts(docs, id_col, text_col).mapInArrow(both, schema)
