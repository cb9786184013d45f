"""Fill-in-middle: texts cut in three at unit borders, the middle moved to the end.

An Arrow-batched pandas UDF walks each text once with the regex library and keeps the
units' end offsets in a compact array, 4 bytes a unit; two look-ups in it cut the
text. hashlib gives the seeds, from the id alone, and the digests.

Forms: ``plain`` is the text itself; ``psm`` is <P>prefix<S>suffix<M>middle; ``spm``
is <S>suffix<P>prefix<M>middle. A text that holds a mark stays plain, so ``restored``
gives back every text exactly.

Defined cases: a null text is the empty one, of 0 units and plain; a null id has the
seed of an id without digits; rows that repeat give rows that repeat, with one result;
a text of white space alone is one unit; other columns, whatever their names, are
dropped; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from array import array
from itertools import chain

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A unit is what is no white space with the white space before it, or white space at the end; and the marks.
UNIT = regex.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def unit_ends(text: str) -> array:
    """0 and the end offset of each unit."""
    return array("I", chain((0,), (m.end() for m in UNIT.finditer(text))))


def draws(doc_id: str, seed: int) -> list[int]:
    """Four numbers below 2^32 that follow from seed and id."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transformed(doc_id: str, text: str, seed: int = 42, share: int = 50, spm_share: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of prefix and middle, output) of one text."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    ends = unit_ends(text)
    n = len(ends) - 1
    if not text or h3 % 100 >= share or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = text[: ends[a]], text[ends[a] : ends[b]], text[ends[b] :]
    if h4 % 100 < spm_share:
        return n, "spm", len(prefix), len(middle), f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", len(prefix), len(middle), f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text of an output, from output and form alone."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    one, _, rest = output.removeprefix(first).partition(second)
    two, _, middle = rest.partition(MIDDLE)
    return one + middle + two if form == "psm" else two + middle + one


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, seed: int = 42, share: int = 50, spm_share: int = 80, outputs: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 and, where asked for, output.

    ``share`` percent of the texts are cut, ``spm_share`` percent of those with the suffix first.
    """
    fields = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()), ("output_sha256", T.StringType()), ("restored_sha256", T.StringType())]
    schema = T.StructType([T.StructField(c, t) for c, t in [*fields, *([("output", T.StringType())] if outputs else [])]])

    def cut(ids: pd.Series, texts: pd.Series) -> pd.DataFrame:
        rows = []
        for doc_id, text in zip(ids, texts, strict=True):
            *facts, output = transformed(doc_id, text, seed, share, spm_share)
            row = (*facts, _digest(output), _digest(rebuilt(output, facts[1])))
            rows.append((*row, output) if outputs else row)
        found = pd.DataFrame(rows, columns=schema.names)
        return found.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    empty = F.lit("")
    parts = F.pandas_udf(cut, schema)(F.coalesce(F.col(id_col).cast("string"), empty), F.coalesce(text_col, empty))
    return docs.select(F.col(id_col), parts.alias("_parts")).select(id_col, "_parts.*")


def restored(outputs: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "text") -> DataFrame:
    """``outputs`` with the text that each was made from."""

    def back(output: pd.Series, form: pd.Series) -> pd.Series:
        return pd.Series([rebuilt(o, f) for o, f in zip(output, form, strict=True)], dtype=object)

    return outputs.withColumn(text_col, F.pandas_udf(back, "string")(output_col, form_col))
