"""Query parsing and row filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import CODE_LANGUAGES, LANGUAGES, glob_regex

# Fixed value: the shape of a field in a query.
FIELD = r"(?i)\b(kind|lang|language|path|name):(\S+)"


def parsed_query(query: Column) -> Column:
    """struct<natural, kind, lang, path, name>: field values as arrays, and the text without them."""
    fields, values = F.regexp_extract_all(query, F.lit(FIELD), 1), F.regexp_extract_all(query, F.lit(FIELD), 2)
    pairs = F.zip_with(F.transform(fields, lambda f: F.when(F.lower(f) == "language", "lang").otherwise(F.lower(f))), values, lambda f, v: F.struct(f.alias("f"), v.alias("v")))
    rest = F.trim(F.regexp_replace(F.regexp_replace(query, FIELD, " "), r"\s+", " "))
    of = lambda name: F.transform(F.filter(pairs, lambda p: p["f"] == name), lambda p: p["v"]).alias(name)
    return F.struct(F.when(rest == "", query).otherwise(rest).alias("natural"), *(of(n) for n in ("kind", "lang", "path", "name")))


def parse_text(query: str) -> dict[str, list[str] | str]:
    """The same of one query, on the driver."""
    out: dict[str, list[str] | str] = {n: [] for n in ("kind", "lang", "path", "name")}
    for field, value in re.findall(FIELD, query):
        out["lang" if field.lower() == "language" else field.lower()].append(value)
    rest = " ".join(re.sub(FIELD, " ", query).split())
    return out | {"natural": rest or query}


def chunk_kind(breadcrumb: Column) -> Column:
    """Kind that the last part of a breadcrumb declares, null if none."""
    last = F.element_at(F.split(breadcrumb, " > "), -1)
    return F.nullif(F.lower(F.regexp_extract(last, r"(?i)^(class|function|method|interface|type|const|enum)\s+(\w+)", 1)), F.lit(""))


def symbol_name(breadcrumb: Column) -> Column:
    last = F.element_at(F.split(breadcrumb, " > "), -1)
    declared = F.regexp_extract(last, r"(?i)^(class|function|method|interface|type|const|enum)\s+(\w+)", 2)
    return F.coalesce(F.nullif(declared, F.lit("")), F.nullif(F.regexp_extract(breadcrumb, r"[:.](\w+)$", 1), F.lit("")))


def field_filter(rows: DataFrame, filters: dict, path: str = "file_path", breadcrumb: str = "breadcrumb", language: str = "language") -> DataFrame:
    """Rows that meet every field, a field being met by any of its values."""
    inside = lambda col, values: F.coalesce(F.lower(col).rlike("|".join(re.escape(v.lower()) for v in values)), F.lit(False))
    if filters.get("kind"):
        rows = rows.where(inside(chunk_kind(F.col(breadcrumb)), filters["kind"]))
    if filters.get("lang"):
        rows = rows.where(F.lower(language).isin([v.lower() for v in filters["lang"]]))
    if filters.get("path"):
        rows = rows.where(inside(F.col(path), filters["path"]))
    if filters.get("name"):
        rows = rows.where(inside(F.coalesce(symbol_name(F.col(breadcrumb)), F.col(breadcrumb), F.lit("")), filters["name"]))
    return rows


def loose_filter(rows: DataFrame, filters: dict, path: str = "file_path", breadcrumb: str = "breadcrumb", language: str = "language") -> DataFrame:
    """The other matcher: languages by part, paths by pattern anywhere in the path, kinds and names as in ``field_filter``."""
    rows = field_filter(rows, {k: filters.get(k) for k in ("kind", "name")}, path, breadcrumb, language)
    if filters.get("lang"):
        rows = rows.where(F.coalesce(F.lower(language).rlike("|".join(re.escape(v.lower()) for v in filters["lang"])), F.lit(False)))
    if filters.get("path"):
        rows = rows.where(F.coalesce(F.lower(path).rlike("|".join(glob_regex(v.lower())[1:-1] for v in filters["path"])), F.lit(False)))
    return rows


def languages_for(code_only: bool = False, include: list[str] | None = None, exclude: list[str] | None = None) -> list[str] | None:
    """The languages to keep, null for all; an empty choice means all as well."""
    known = set(LANGUAGES.values()) | {"unknown"}
    if include is not None and exclude is not None and set(include) & set(exclude):
        raise ValueError(f"languages both included and excluded: {sorted(set(include) & set(exclude))}")
    if strange := sorted((set(include or ()) | set(exclude or ())) - known):
        raise ValueError(f"unknown languages: {strange}")
    if not code_only and include is None and exclude is None:
        return None
    if include is not None:
        chosen = [x for x in include if not code_only or x in CODE_LANGUAGES]
    else:
        chosen = list(CODE_LANGUAGES) if code_only else sorted(known)
    return [x for x in chosen if x not in set(exclude or ())] or None


def channels(request: Column, terms: Column) -> Column:
    """struct<vector, lexical, rerank>: what each kind of search is asked."""
    asked = F.trim(request)
    own = F.array_distinct(F.filter(F.transform(F.coalesce(terms, F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != ""))
    joined = F.array_join(own, " ")
    return F.struct(asked.alias("vector"), F.trim(F.concat_ws(" ", joined, asked)).alias("lexical"), F.trim(F.concat_ws(" ", asked, joined)).alias("rerank"))
