"""Splitting files into chunks, and the search document of a chunk."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import nesting
from weftline.functions.text import symbol_tokens

# Largest and least size of a chunk and overlap, in non-space characters, by profile.
PROFILES = {"quality": (500, 50, 40), "balanced": (700, 100, 32), "performance": (900, 120, 24)}


#: Bytes of kept columns that a batch of chunks repeats at most.
REPEATED = 8 << 20


def line_chunks(files: DataFrame, most: int = 700, content: str = "content", keep: tuple[str, ...] | None = None, code: str | None = None) -> DataFrame:
    """One row per chunk of consecutive lines with at most ``most`` non-space characters, a longer line alone.

    The columns ``keep`` (all where none are named), then chunk_index, start_index,
    end_index (of the text), raw_start, raw_end (gapless) and nws_size, and the raw
    text of the chunk as ``code`` where that is named. Files stay where they are; each
    takes time and memory in proportion to its length, unless its text is kept, which
    every chunk then repeats. A null text has no chunk.
    """
    kept = [c for c in files.columns if keep is None or c in keep]
    own = ("chunk_index", "start_index", "end_index", "raw_start", "raw_end", "nws_size")

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str], list[np.ndarray]]]:
        """Parts of a batch whose chunks repeat at most ``REPEATED`` bytes of kept columns, or which are one file."""
        each = sum((batch.column(k).nbytes for k in range(len(kept))), 0) / max(batch.num_rows, 1)
        first, texts, found, size = 0, [], [], 0.0
        for row in range(batch.num_rows):
            text = batch.column(batch.num_columns - 1)[row].as_py()
            spans = line_spans(text, most)
            more = len(spans) * (each + 4 * len(text) * (content in kept)) + 4 * len(text) * (code is not None)
            if found and size + more > REPEATED:
                yield batch.slice(first, row - first), texts, found
                first, texts, found, size = row, [], [], 0.0
            texts.append(text)
            found.append(spans)
            size += more
        if found:
            yield batch.slice(first), texts, found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts, found in (piece for whole in batches for piece in pieces(whole)):
            row = np.repeat(np.arange(len(found)), [len(f) for f in found])
            spans = np.concatenate([np.zeros((0, 5), dtype=np.int32), *found])
            index = np.concatenate([np.zeros(0, dtype=np.int32), *(np.arange(len(f), dtype=np.int32) for f in found)])
            shown = [[t[a:b] for t, f in zip(texts, found, strict=True) for a, b in f[:, 2:4].tolist()]] if code else []
            # a file whose own chunks repeat more than that is dealt over several batches
            step = max(1, REPEATED // (4 * max(int(spans[:, 3].max(initial=1)), 1))) if content in kept else max(len(row), 1)
            for k in range(0, len(row), step):
                part = slice(k, k + step)
                at = pa.array(row[part])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(len(kept))), pa.array(index[part]), *(pa.array(np.ascontiguousarray(spans[part, c])) for c in range(5)), *(pa.array(x[part], pa.string()) for x in shown)], names=names)

    schema = T.StructType([*(files.schema[c] for c in kept), *(T.StructField(c, T.IntegerType()) for c in own), *([T.StructField(code, T.StringType())] if code else [])])
    names = schema.names
    rows = files.where(F.col(content).isNotNull()).select(*kept, F.col(content).alias("_content"))
    return rows.mapInArrow(run, schema)


def line_spans(text: str, most: int) -> np.ndarray:
    """(start, end, raw_start, raw_end, non-space size) of each chunk of a text."""
    lines = text.split("\n")
    chars = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
    blank = np.fromiter((x.count(" ") + x.count("\t") + x.count("\r") for x in lines), dtype=np.int64, count=len(lines))
    ends = np.cumsum(chars + 1) - 1  # of each line in the text
    size = np.cumsum(chars - blank)
    cuts, first, before = [], 0, 0
    while first < len(lines):
        last = max(first + 1, int(np.searchsorted(size, before + most, side="right")))
        cuts.append(last - 1)
        first, before = last, int(size[last - 1])
    end, total = ends[cuts], size[cuts]
    start = np.concatenate(([0], end[:-1] + 1))
    raw_end = np.concatenate((end[:-1] + 1, [len(text)]))
    return np.stack([start, end, start, raw_end, np.diff(total, prepend=0)], axis=1).astype(np.int32)


def vector_text(breadcrumb: Column, code: Column) -> Column:
    return F.concat(F.lit("// Context: "), breadcrumb, F.lit("\n"), code)


def search_document(chunks: DataFrame, breadcrumb: str = "breadcrumb", code: str = "display_code") -> DataFrame:
    """``chunks`` with symbol_tokens, body (code without comments) and comments."""
    blocks, line, hashed = r"(/\*[\s\S]*?\*/)", r"(?m)(//.*)$", r"(?m)(?:^|(?<=\s))(#.*)$"
    one = F.regexp_replace(code, blocks, "\n")
    two = F.regexp_replace(one, line, "")
    three = F.regexp_replace(two, hashed, "")
    comments = F.concat(F.regexp_extract_all(code, F.lit(blocks), 1), F.regexp_extract_all(one, F.lit(line), 1), F.regexp_extract_all(two, F.lit(hashed), 1))
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    return chunks.withColumns({
        "symbol_tokens": F.array_join(symbol_tokens(F.concat_ws("\n", breadcrumb, code)), " "),
        "body": F.coalesce(F.nullif(trimmed(three), F.lit("")), trimmed(F.col(code))),
        "comments": trimmed(F.array_join(comments, "\n")),
    })


Chunker = Callable[[str, str, int, int], list[tuple[int, int, str]]]
#: By language: a function of (path, text, most, least) that gives (start, end, breadcrumb) of each chunk.
CHUNKERS: dict[str, Chunker] = {}


def register(language: str) -> Callable[[Chunker], Chunker]:
    def add(chunker: Chunker) -> Chunker:
        CHUNKERS[language] = chunker
        return chunker

    return add


def _size(text: str) -> int:
    return len(text.translate(str.maketrans("", "", " \t\r\n")))


#: Share of a budget for windows of unlike breadcrumbs, and more for a tiny window; characters a chunk may have for each non-space one.
UNLIKE, TINY, RAW = 0.7, 1.5, 4


@dataclass
class _Window:
    """Neighbouring pieces of a text that make a chunk: start, end and whether it is a comment, of each."""

    pieces: list[tuple[int, int, bool]]
    size: int
    crumb: tuple[str, ...]


def _windows(t: nesting.Tokens, node: nesting.Node, crumb: tuple[str, ...], size, most: int, least: int) -> list[_Window]:
    """A node that fits, or its parts: what stands before, between and after its blocks' statements, and those split in turn."""
    if node.name is not None:
        crumb = (*crumb, f"{node.prefix}{node.name}")
    whole = [_Window([(node.start, node.end, node.comment)], size(node.start, node.end), crumb)]
    inner = nesting.children(t, node) if whole[0].size > most else []
    if not inner:
        return whole
    parts, at = [], node.start
    for child in inner:
        parts += _between(t, at, child.start, crumb, size) + _windows(t, child, crumb, size, most, least)
        at = child.end
    return merged(parts + _between(t, at, node.end, crumb, size), size, most, least)


def _between(t: nesting.Tokens, start: int, end: int, crumb: tuple[str, ...], size) -> list[_Window]:
    piece = t.text[start:end]
    a, b = start + len(piece) - len(piece.lstrip()), end - len(piece) + len(piece.rstrip())
    return [_Window([(a, b, False)], size(a, b), crumb)] if a < b else []


def merged(windows: list[_Window], size, most: int, least: int) -> list[_Window]:
    """Neighbours joined within the budgets; comments at a window's end go to the next one first."""
    out: list[_Window] = []
    for new in windows:
        now = out[-1] if out else None
        if now:
            moved = []
            while now.pieces and now.pieces[-1][2]:
                moved.insert(0, now.pieces.pop())
            if moved:
                now.size -= sum(size(a, b) for a, b, _ in moved)
                new = _Window([*moved, *new.pieces], size(moved[0][0], new.pieces[-1][1]), new.crumb)
            if not now.pieces:
                out[-1] = new
                continue
            start, end = now.pieces[0][0], new.pieces[-1][1]
            both, shorter = size(start, end), min(len(now.crumb), len(new.crumb))
            share = 1.0 if now.crumb[:shorter] == new.crumb[:shorter] else UNLIKE
            fits = both <= most * share or (now.size < least and both < most * share * TINY)
            if fits and end - start <= most * RAW * share:
                now.pieces, now.size = now.pieces + new.pieces, both
                now.crumb = new.crumb if len(new.crumb) > len(now.crumb) else now.crumb
                continue
        out.append(new)
    return out


def structural_chunks(language: str) -> Chunker:
    """The chunker of a language whose nesting is known."""

    def chunks(path: str, text: str, most: int, least: int) -> list[tuple[int, int, str]]:
        blank = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sums = np.concatenate(([0], np.cumsum(~np.isin(blank, [32, 9, 10, 13]))))
        size = lambda a, b: int(sums[b] - sums[a])
        if sums[-1] <= most:
            return [(0, len(text), path)]
        t = nesting.tokens(text, language)
        parts = [w for n in nesting.nodes(t) for w in _windows(t, n, (path,), size, most, least)]
        found = merged(parts, size, most, least)
        ends = [w.pieces[-1][1] for w in found[:-1]] + [len(text)]
        return [(a, b, " > ".join(w.crumb)) for a, b, w in zip([0, *ends], ends, found, strict=False)]

    return chunks


for _language in nesting.DECLARATIONS:
    register(_language)(structural_chunks(_language))


def semantic_chunks(files: DataFrame, profile: str = "balanced") -> DataFrame:
    """path, chunk_index, raw_start, raw_end, vec_start, breadcrumb of the files whose language has a chunker.

    Raw spans join to the text. What is embedded begins earlier by the profile's
    overlap, unless that would be over a quarter of the characters a chunk may have. A
    file that the chunker can't parse has no row; such files take the line split.
    """
    most, least, overlap = PROFILES[profile]
    return _chunked(files, most, least, overlap)


def _chunked(files: DataFrame, most: int, least: int, overlap: int) -> DataFrame:
    chunkers = dict(CHUNKERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, language, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    chunks = chunkers[language](path, text, most, least)
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for k, (a, b, crumb) in enumerate(chunks):
                    start = a + len(text[a:b]) - len(text[a:b].lstrip())
                    before = overlap_start(text, chunks[k - 1][0], start, overlap) if k else start
                    out.append((path, k, a, b, before if start - before <= most * RAW / 4 else start, crumb))
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), *[pa.int32()] * 4, pa.string()))], names=["path", "chunk_index", "raw_start", "raw_end", "vec_start", "breadcrumb"])

    source = files.where(F.col("language").isin(*chunkers) & F.col("content").isNotNull()).select("path", "language", "content")
    return source.mapInArrow(run, "path string, chunk_index int, raw_start int, raw_end int, vec_start int, breadcrumb string")


def overlap_start(text: str, floor: int, start: int, overlap: int) -> int:
    """Start of a chunk's embedded text: back by ``overlap`` non-space characters, not past ``floor``; the chunk's own start where there are fewer."""
    if overlap <= 0 or _size(text[floor:start]) < overlap:
        return start
    low, high = floor, start
    while low < high:
        middle = (low + high + 1) // 2
        if _size(text[middle:start]) >= overlap:
            low = middle
        else:
            high = middle - 1
    return low
