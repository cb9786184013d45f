"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's ids, with the
end id, are cut into full windows and a rest; the rest goes to the open window in
which it leaves the least room. When none holds it, the fullest window is emitted,
topped up from the rest itself where its gap is worth a cut. The windows that stay
open at the end of the partitions are packed once more, over fewer partitions.

Defined cases: a null or empty text has the end id alone; a document of any length
is cut into pieces; every id lies in exactly one piece; rows that repeat are packed
each for itself; an empty table gives no pieces; other columns are dropped.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.bpe import LONGEST
from weftline.llm.common import texts, written

#: Chunks whose ids a worker remembers, in each of two generations.
KNOWN_CHUNKS = 400_000
#: Tokens of a window, windows that a partition keeps open, least gap worth a cut, partitions whose leftovers meet.
WINDOW, OPEN, LEAST_CUT, MEET = 2048, 32, 16, 64

FORMATS = [struct.Struct(f"<{n}I").pack for n in range(32)]


#: Marks that the pattern always cuts off a word of letters and digits.
MARKS = frozenset(".,;:!?")


def word_and_mark(chunk: str) -> tuple[str, str]:
    """A word, in lower case as the vocabulary reads it, and the mark after it; any other chunk as it is.

    Only ASCII is put in lower case here, and only letters and digits, so special tokens stay themselves.
    """
    word, mark = (chunk[:-1], chunk[-1]) if chunk[-1:] in MARKS else (chunk, "")
    if not word.isalnum():
        return chunk, ""
    return word.lower() if word.isascii() else word, mark


class WordIds:
    """Ids of texts by the tokenizers library, remembered by space-free chunk.

    The vocabulary's pattern drops white space and never crosses it, so a text's
    ids are those of its chunks one after the other.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        self.own.no_truncation()
        self.own.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks = {m: struct.pack(f"<{len(ids)}I", *ids) for m in ("", *MARKS) for ids in [self.own.encode(m, add_special_tokens=False).ids]}

    def encode_all(self, batch: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [t.replace("\n", " ").split(" ") for t in batch]
        if len(self.known) > KNOWN_CHUNKS:
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        todo = []
        for chunk in set().union(*split).difference(known):
            if (found := older.get(chunk)) is None:
                todo.append(chunk)
            else:
                known[chunk] = found
        parts = [word_and_mark(chunk) for chunk in todo]
        words = []
        for word in {w for w, _ in parts}.difference(known):
            if (found := older.get(word)) is None:
                words.append(word)
            else:
                known[word] = found
        for k in range(0, len(words), 20_000):
            part = words[k : k + 20_000]
            for word, found in zip(part, self.own.encode_batch_fast(part, add_special_tokens=False), strict=True):
                ids = found.ids
                known[word] = FORMATS[len(ids)](*ids) if len(ids) < len(FORMATS) else struct.pack(f"<{len(ids)}I", *ids)
        for chunk, (word, mark) in zip(todo, parts, strict=True):
            known[chunk] = known[word] + self.marks[mark]
        out = [b"".join(map(known.__getitem__, s)) for s in split]
        for chunk in {*todo, *words}:
            if len(chunk) > LONGEST:  # long ones would fill the memory
                del known[chunk]
        return out


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


class Windows:
    """The open windows of one partition and what leaves them."""

    def __init__(self, partition: int, round_no: int, size: int, most: int, least_cut: int):
        self.size, self.most, self.least_cut = size, most, least_cut
        self.open: dict[int, list] = {}
        self.room: dict[int, int] = {}
        self.key = ((round_no << 24) + partition) << 34  # 5 bits of rounds, 24 of partitions, 34 of windows

    def _new(self) -> int:
        self.key += 1
        self.open[self.key], self.room[self.key] = [], self.size
        return self.key

    def _put(self, key: int, piece: tuple) -> None:
        self.open[key].append((*piece, self.size - self.room[key]))
        self.room[key] -= piece[2]

    def _emit(self, key: int):
        del self.room[key]
        return key, self.open.pop(key)

    def place(self, doc, start: int, ids: bytes, total: int):
        """Place ids ``start`` and on of a document; yields (window, pieces) of what is emitted."""
        n = len(ids) // 4
        done = 0
        while n - done >= self.size:  # whole windows need no place among the open ones
            key = self._new()
            self._put(key, (doc, start + done, self.size, total, ids[4 * done : 4 * (done + self.size)]))
            done += self.size
            yield self._emit(key)
        while done < n:
            need = n - done
            fits = [(room, key) for key, room in self.room.items() if room >= need]
            if fits:
                room, key = min(fits)
            elif len(self.open) < self.most:
                key = self._new()
            else:  # none fits: the fullest leaves, topped up where the gap is worth a cut
                room, key = min((room, key) for key, room in self.room.items())
                if room >= self.least_cut:
                    self._put(key, (doc, start + done, room, total, ids[4 * done : 4 * (done + room)]))
                    done += room
                yield self._emit(key)
                continue
            self._put(key, (doc, start + done, need, total, ids[4 * done : 4 * n]))
            done = n
            if self.room[key] == 0:
                yield self._emit(key)

    def rest(self):
        for key in list(self.open):
            yield self._emit(key)


def _schema(id_field: T.StructField) -> T.StructType:
    long = T.LongType()
    return T.StructType([id_field, *(T.StructField(c, long) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")), T.StructField("open", T.BooleanType()), T.StructField("ids", T.BinaryType())])


def _rows(id_type: pa.DataType, windows, is_open: bool, keep_ids: bool, id_col: str) -> pa.RecordBatch:
    out: list[list] = [[] for _ in range(9)]
    for key, pieces in windows:
        for doc, start, length, total, ids, offset in pieces:
            for column, value in zip(out, (doc, start, length, zlib.crc32(ids), total, key, offset, is_open, ids if keep_ids or is_open else None), strict=True):
                column.append(value)
    kinds = [id_type, *[pa.int64()] * 6, pa.bool_(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "open", "ids"])


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, most_open: int = OPEN, least_cut: int = LEAST_CUT, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if ``keep_ids``, its ids.

    The first round's rows are written to the shared folder, since both the full
    windows and the leftovers are read from them; leftovers then meet, those of
    ``MEET`` partitions at a time, until the last round has one partition.
    """
    end = end_id.to_bytes(4, "little")
    schema = _schema(docs.schema[id_col])

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, space, id_type = word_ids(vocabulary), Windows(TaskContext.get().partitionId(), 0, window, most_open, least_cut), None
        for batch in batches:
            id_type = batch.schema.field(0).type
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                full = []
                for doc, ids in zip(part.column(0).to_pylist(), own.encode_all(part.column(1).to_pylist()), strict=True):
                    ids += end
                    full += space.place(doc, 0, ids, len(ids) // 4)
                yield _rows(id_type, full, False, keep_ids, id_col)
        if id_type is not None:
            yield _rows(id_type, space.rest(), True, keep_ids, id_col)

    def again(round_no: int):
        def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            space, id_type = Windows(TaskContext.get().partitionId(), round_no, window, most_open, least_cut), None
            for batch in batches:
                id_type = batch.schema.field(0).type
                full = []
                for doc, start, ids, total in zip(*(batch.column(c).to_pylist() for c in (id_col, "start", "ids", "doc_tokens")), strict=True):
                    full += space.place(doc, start, ids, total)
                yield _rows(id_type, full, False, keep_ids, id_col)
            if id_type is not None:
                yield _rows(id_type, space.rest(), True, keep_ids, id_col)

        return later

    source = texts(docs, id_col, text_col)
    rows = written(source.mapInArrow(first, schema), "packed")
    done = [rows.where(~F.col("open"))]
    left, parts, round_no = rows.where("open"), source.rdd.getNumPartitions(), 0
    while True:
        parts, round_no = -(-parts // MEET), round_no + 1
        # pieces of one round-0 window stay together, longest windows dealt evenly by their key
        met = left.repartition(parts, F.col("sequence_id")).sortWithinPartitions(F.col("length").desc(), "sequence_id", "offset") if parts > 1 else left.coalesce(1).sortWithinPartitions(F.col("length").desc(), "sequence_id", "offset")
        rows = written(met.mapInArrow(again(round_no), schema), "packed")
        if parts <= 1:
            break
        done.append(rows.where(~F.col("open")))
        left = rows.where("open")
    out = rows
    for part in done:
        out = out.unionByName(part)
    return out.drop("open") if keep_ids else out.drop("open", "ids")
