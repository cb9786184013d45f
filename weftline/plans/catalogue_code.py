"""Queries over source files that are made from the documents' ids, and their SQL.

The input tables hold no source code, so each document stands for a file whose path
and statements follow from its id. The SQL states the result from the ids alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as fx
from weftline.operators import access, analytics, chunking, context, filters, imports, indexing, reports, retrieval
from weftline.plans.catalogue import BM25, CHUNKS, FILES, ORACLE_SQL, QUERIES, TERMS, _bm25_sql, _chunks, _scored, query
from weftline.plans.lineage import written
from weftline.sources import readers
from weftline.sources.tables import files, table


def spelled(template: str, own: Column | None = None) -> Column:
    """A text with {d+k} replaced by the id plus k and {p+k} by that number's remainder by 10."""
    own = F.col("doc_id") if own is None else own
    parts = []
    for k, piece in enumerate(template.replace("{", "\x00{").replace("}", "}\x00").split("\x00")):
        if piece.startswith("{") and piece.endswith("}") and piece[1:2] in ("d", "p") and piece[2:-1].lstrip("+").isdigit() | (piece[2:-1] == ""):
            moved = own + int(piece[2:-1] or 0)
            parts.append((moved % 10 if piece[1] == "p" else moved).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


def spelled_sql(template: str, own: str = "a.doc_id") -> str:
    """The same in SQL."""
    parts = []
    for piece in template.replace("{", "\x00{").replace("}", "}\x00").split("\x00"):
        if piece.startswith("{") and piece.endswith("}") and piece[1:2] in ("d", "p") and (piece[2:-1].lstrip("+").isdigit() or piece[2:-1] == ""):
            moved = f"({own} + {int(piece[2:-1] or 0)})"
            parts.append(f"({moved} % 10)::VARCHAR" if piece[1] == "p" else f"{moved}::VARCHAR")
        elif piece:
            parts.append("'" + piece.replace("'", "''") + "'")
    return " || ".join(parts)


PATH = "lib/src/p{p}/M{d}."
#: By language: extension, text of a file, and its imports that mean a file: what is written, the distance of the file's id, or None and the distance of the folder's number.
SOURCES: dict[str, tuple[str, str, list[tuple[str, int | None, int]]]] = {
    "typescript": ("ts", "import x from './M{d+10}';\nexport * from \"../p{p+3}/M{d+3}.js\";\nconst y = require('./M{d+20}.ts');\nimport z from 'react';\n", [("./M{d+10}", 10, 0), ("../p{p+3}/M{d+3}.js", 3, 0), ("./M{d+20}.ts", 20, 0)]),
    "python": ("py", "from .M{d+10} import a\nimport src.p{p+3}.M{d+3}\nfrom . import nothing\nimport os\n", [(".M{d+10}", 10, 0), ("src.p{p+3}.M{d+3}", 3, 0)]),
    "go": ("go", 'import "src/p{p+3}"\nimport (\n\t"fmt"\n\tq "lib/src/p{p+4}"\n)\nvar s = "a/b"\n', [("src/p{p+3}", None, 3), ("lib/src/p{p+4}", None, 4)]),
    "java": ("java", "import src.p{p+3}.M{d+3};\nimport static java.util.List;\nimport src.p{p+4}.*;\n", [("src.p{p+3}.M{d+3}", 3, 0), ("src.p{p+4}.*", None, 4)]),
    "kotlin": ("kt", "import src.p{p+3}.M{d+3}\nimport src.p{p+5}.M{d+5} as X\nimport src.p{p+4}.*\n", [("src.p{p+3}.M{d+3}", 3, 0), ("src.p{p+5}.M{d+5}", 5, 0), ("src.p{p+4}.*", None, 4)]),
    "php": ("php", "use src\\p{p+3}\\M{d+3};\nuse function src\\p{p+5}\\M{d+5} as f;\nuse Vendor\\Thing;\n", [("src\\p{p+3}\\M{d+3}", 3, 0), ("src\\p{p+5}\\M{d+5}", 5, 0)]),
    "ruby": ("rb", "require_relative 'M{d+10}'\nrequire 'src/p{p+3}/M{d+3}'\nautoload :M, 'src/p{p+5}/M{d+5}'\nrequire 'json'\n", [("require_relative:M{d+10}", 10, 0), ("require:src/p{p+3}/M{d+3}", 3, 0), ("autoload:src/p{p+5}/M{d+5}", 5, 0)]),
    "swift": ("swift", "import M{d+10}\n@testable import Foundation\n", [("M{d+10}", 10, 0)]),
    "dart": ("dart", "import './M{d+10}.dart';\nexport '../p{p+3}/M{d+3}';\nimport 'package:x/y.dart';\n", [("./M{d+10}.dart", 10, 0), ("../p{p+3}/M{d+3}", 3, 0)]),
    "rust": ("rs", "mod M{d+10};\nuse crate::p{p+3}::M{d+3};\nuse super::p{p+5}::M{d+5};\nuse self::M{d+20};\nuse std::io;\n", [("mod:M{d+10}", 10, 0), ("use:crate::p{p+3}::M{d+3}", 3, 0), ("use:super::p{p+5}::M{d+5}", 5, 0), ("use:self::M{d+20}", 20, 0)]),
    "c": ("c", '#include "M{d+10}.c"\n#include <stdio.h>\n#include "src/p{p+5}/M{d+5}.c"\n', [("M{d+10}.c", 10, 0), ("src/p{p+5}/M{d+5}.c", 5, 0)]),
    "csharp": ("cs", "using src.p{p+3}.M{d+3};\nusing static src.p{p+5}.M{d+5};\nglobal using A = src.p{p+4}.M{d+4};\nusing System;\n", [("src.p{p+3}.M{d+3}", 3, 0), ("src.p{p+5}.M{d+5}", 5, 0), ("src.p{p+4}.M{d+4}", 4, 0)]),
}


def sources(spark: SparkSession, sf: str, language: str) -> DataFrame:
    ext, content, _ = SOURCES[language]
    return table(spark, sf, "documents").select("doc_id", spelled(PATH + ext).alias("path"), spelled(content).alias("content"))


def _imports_sql(language: str) -> str:
    ext, _, expected = SOURCES[language]
    own, there = spelled_sql(PATH + ext), spelled_sql(PATH + ext, "b.doc_id")
    parts = []
    for written_as, distance, folder in expected:
        said = spelled_sql(written_as)
        if distance is None:  # of a folder, the file that shares most folders, then the first by name
            parts.append(f"SELECT {own} AS from_path, {said} AS import, min({there}) AS to_path FROM documents a JOIN documents b ON b.doc_id % 10 = (a.doc_id + {folder}) % 10 GROUP BY a.doc_id")
        else:
            parts.append(f"SELECT {own} AS from_path, {said} AS import, {there} AS to_path FROM documents a JOIN documents b ON b.doc_id = a.doc_id + {distance}")
    return " UNION ALL ".join(parts)


def _imports_of(language: str):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return imports.resolved(sources(spark, sf, language).drop("doc_id")).select("from_path", "import", "to_path")

    return run


for _language in SOURCES:
    QUERIES[f"imports_{_language}"] = _imports_of(_language)
    ORACLE_SQL[f"imports_{_language}"] = _imports_sql(_language)

# Half of the files in one folder, the rest in several, some at the root; imports differ by file, in comments and strings there are none.
_UNEVEN_PATH = "CASE WHEN doc_id % 5 = 0 THEN 'tools' WHEN doc_id % 2 = 0 THEN 'app/core/lib' WHEN doc_id % 11 = 3 THEN 'app/m' || doc_id % 7 || '/deep/core/lib' ELSE 'app/m' || doc_id % 7 || '/core/lib' END || '/M' || doc_id || CASE WHEN doc_id % 13 = 1 THEN '_test.go' ELSE '.go' END"
_UNEVEN_TEXT = """CASE doc_id % 4 WHEN 0 THEN 'import "core/lib"' || chr(10) WHEN 1 THEN 'package p' || chr(10) || 'import x "app/m' || doc_id % 9 || '/core"' || chr(10) WHEN 2 THEN 'var s = "import \"core/lib\""' || chr(10) ELSE 'import "lib' || doc_id % 3 || '/none"' || chr(10) || 'import "m' || doc_id % 7 || '/core/lib"' END"""
_SHARED = "len(list_filter(generate_series(1, least(len(string_split(a, '/')), len(string_split(b, '/')))), lambda k: string_split(a, '/')[1 : k] = string_split(b, '/')[1 : k] AND a <> ''))"


@query(
    f"""WITH f AS (SELECT doc_id, {_UNEVEN_PATH} AS path, {_UNEVEN_TEXT} AS content FROM documents), g AS (SELECT *, regexp_replace(path, '/[^/]*$', '') AS folder, ends_with(path, '_test.go') AS test FROM f),
    i AS (SELECT DISTINCT path AS from_path, folder AS a, unnest(regexp_extract_all(content, '(?m)^import (?:x )?"([^"]+)"', 1)) AS import FROM g), d AS (SELECT folder AS b, min(path) FILTER (NOT test) AS plain, min(path) AS any_path FROM g GROUP BY folder),
    asked AS (SELECT DISTINCT a, import FROM i), s AS (SELECT a, import, coalesce(plain, any_path) AS to_path, plain IS NULL AS test, {_SHARED} AS shared FROM asked JOIN d ON contains('/' || b || '/', '/' || import || '/')),
    best AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a, import ORDER BY test, shared DESC, to_path) = 1) SELECT from_path, import, to_path FROM i JOIN best USING (a, import)"""
)
def imports_uneven_tree(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    own = lambda n: (d % n).cast("string")
    folder = F.when(d % 5 == 0, "tools").when(d % 2 == 0, "app/core/lib").when(d % 11 == 3, F.concat(F.lit("app/m"), own(7), F.lit("/deep/core/lib"))).otherwise(F.concat(F.lit("app/m"), own(7), F.lit("/core/lib")))
    path = F.concat(folder, F.lit("/M"), d.cast("string"), F.when(d % 13 == 1, "_test.go").otherwise(".go"))
    content = F.when(d % 4 == 0, 'import "core/lib"\n').when(d % 4 == 1, F.concat(F.lit('package p\nimport x "app/m'), own(9), F.lit('/core"\n'))).when(d % 4 == 2, 'var s = "import \\"core/lib\\""\n').otherwise(F.concat(F.lit('import "lib'), own(3), F.lit('/none"\nimport "m'), own(7), F.lit('/core/lib"')))
    rows = table(spark, sf, "documents").select(path.alias("path"), content.alias("content"))
    return imports.resolved(rows).select("from_path", "import", "to_path")


_NUMBERED = "a.doc_id::VARCHAR"


# Each file imports the next two; a file whose id ends in 5 is a barrel. Seeds are the first chunks of the files that hold a term.
@query(
    f"""{CHUNKS}, named AS (SELECT doc_id, 'd' || doc_id || CASE WHEN doc_id % 10 = 5 THEN '/index.ts' ELSE '/m.ts' END AS path FROM documents),
    seeds AS (SELECT doc_id, 1.0::DOUBLE / (1 + doc_id) AS score FROM documents WHERE contains(lower(coalesce(text, '')), 'license') AND text IS NOT NULL),
    e AS (SELECT a.doc_id AS f, b.doc_id AS t, b.doc_id - a.doc_id AS pos FROM documents a JOIN documents b ON b.doc_id - a.doc_id IN (1, 2)),
    near AS (SELECT t, score FROM seeds JOIN e ON f = seeds.doc_id), barrels AS (SELECT t AS b, max(score) AS score FROM near WHERE t % 10 = 5 AND t NOT IN (SELECT doc_id FROM seeds) GROUP BY t),
    far AS (SELECT e.t, score FROM barrels JOIN e ON f = b), reached AS (SELECT t, max(s) AS s FROM (SELECT t, score * 0.6::DOUBLE AS s FROM near UNION ALL SELECT t, score * 0.6::DOUBLE * 0.7::DOUBLE FROM far) GROUP BY t),
    first AS (SELECT doc_id, chunk_index FROM chunks WHERE chunk_index < 2)
    SELECT path, chunk_index, round(s, 9) AS score FROM reached JOIN first ON t = first.doc_id JOIN named ON named.doc_id = t WHERE NOT (chunk_index = 0 AND t IN (SELECT doc_id FROM seeds))"""
)
def import_expand(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 10 == 5, "/index.ts").otherwise("/m.ts"))
    docs = table(spark, sf, "documents")
    ids = docs.select("doc_id", path.alias("path"))
    chunks = written(_chunks(spark, sf), "chunks").select(path.alias("file_path"), "chunk_index")
    seeds = docs.where(F.contains(F.lower("text"), F.lit("license"))).select(path.alias("file_path"), F.lit(0).alias("chunk_index"), (1.0 / (1 + F.col("doc_id"))).alias("score"))
    steps = ids.select(F.col("path").alias("from_path"), F.explode(F.array(F.lit(1), F.lit(2))).alias("position"), "doc_id").withColumn("doc_id", F.col("doc_id") + F.col("position"))
    edges = steps.join(ids.withColumnRenamed("path", "to_path"), "doc_id").drop("doc_id")
    return context.imported(seeds, edges, chunks).select(F.col("file_path").alias("path"), "chunk_index", F.round("score", 9).alias("score"))


FIELDS = {"symbols": 6.0, "breadcrumb": 3.0, "body": 1.5, "comments": 0.3}
_FIELDED = "low AS (SELECT doc_id, lower(lang || ' license') AS symbols, lower(source || ' > ering ' || doc_id) AS breadcrumb, lower(coalesce(text, '')) AS body, lower(CASE WHEN doc_id % 4 = 0 THEN 'thion license' ELSE '' END) AS comments FROM documents)"


@query(f"WITH {_FIELDED}, {_bm25_sql(FIELDS, 'low', 'doc_id')} SELECT doc_id, round(score, 6) AS score, matched_all FROM scored")
def bm25_weighted_fields(spark: SparkSession, sf: str) -> DataFrame:
    return retrieval.bm25(fielded(spark, sf), TERMS, FIELDS).select("doc_id", F.round("score", 6).alias("score"), "matched_all")


def fielded(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id", F.concat("lang", F.lit(" license")).alias("symbols"), F.concat("source", F.lit(" > ering "), F.col("doc_id").cast("string")).alias("breadcrumb"), F.col("text").alias("body"), F.when(F.col("doc_id") % 4 == 0, "thion license").otherwise("").alias("comments")
    )


_OVER = " + ".join(f"CASE WHEN contains(t, '{w}') THEN CASE WHEN regexp_matches(t, '\\b{w}\\b') THEN 1.0 ELSE 0.5 END ELSE 0.0 END" for w in TERMS)


@query(
    f"""{CHUNKS.replace("WITH RECURSIVE", f"WITH RECURSIVE {BM25},")}, f AS (SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 20),
    c AS (SELECT c.doc_id, c.chunk_index, f.score AS s, lower('x ' || substr(d.text, raw_start + 1, raw_end - raw_start)) AS t FROM chunks c JOIN f USING (doc_id) JOIN documents d USING (doc_id)),
    o AS (SELECT doc_id, chunk_index, s, ({_OVER})::DOUBLE AS overlap FROM c), p AS (SELECT * FROM o WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY overlap DESC, chunk_index) <= 2)
    SELECT doc_id, chunk_index, round(s * (1 + 0.5 * overlap), 6) AS score FROM p ORDER BY s DESC, doc_id::VARCHAR, overlap DESC, chunk_index LIMIT 40"""
)
def lexical_fallback_chunks(spark: SparkSession, sf: str) -> DataFrame:
    found = _scored(spark, sf).select(F.col("doc_id").cast("string").alias("path"), "doc_id", "score").orderBy(F.col("score").desc(), "doc_id").limit(20).drop("doc_id")
    found = written(found, "found")
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_path"), F.col("text").alias("content"))
    asked = docs.join(F.broadcast(found.select(F.col("path").alias("file_path"))), "file_path", "left_semi")
    chunks = chunking.line_chunks(asked, keep=("file_path",), code="display_code").select("file_path", "chunk_index", F.lit("x").alias("breadcrumb"), "display_code")
    return retrieval.lexical_fallback(found, chunks, TERMS).select(F.col("file_path").cast("long").alias("doc_id"), "chunk_index", F.round("score", 6).alias("score"))


@query("SELECT doc_id, 'class A' || doc_id % 7 || ' {' || chr(10) || 'x = ' || doc_id || ' ' || chr(10) || chr(10) || chr(10) || chr(10) || 'y = 2' AS body, '/* block ' || doc_id || ' */' || chr(10) || '// note ' || doc_id || chr(10) || '# hash ' || doc_id AS comments FROM documents")
def search_document_fields(spark: SparkSession, sf: str) -> DataFrame:
    code = spelled("class A{d} {\nx = {d} // note {d}\n/* block {d} */\n# hash {d}\ny = 2\n")
    code = F.regexp_replace(code, r"^class A\d+", F.concat(F.lit("class A"), (F.col("doc_id") % 7).cast("string")))
    rows = table(spark, sf, "documents").select("doc_id", code.alias("display_code"), F.lit("src > x").alias("breadcrumb"))
    return chunking.search_document(rows).select("doc_id", "body", "comments")


_CRUMB = "CASE a.doc_id % 3 WHEN 0 THEN 'lib/x > class Box' || a.doc_id % 7 WHEN 1 THEN 'lib/x > function run' || a.doc_id % 5 ELSE 'lib/y' END"


def _crumbed(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    crumb = F.when(d % 3 == 0, F.concat(F.lit("lib/x > class Box"), (d % 7).cast("string"))).when(d % 3 == 1, F.concat(F.lit("lib/x > function run"), (d % 5).cast("string"))).otherwise("lib/y")
    return table(spark, sf, "documents").select("doc_id", F.col("lang").alias("language"), crumb.alias("breadcrumb"), F.concat("source", F.lit("/"), d.cast("string"), F.lit(".ts")).alias("file_path"))


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'class' WHEN 1 THEN 'function' END AS kind, CASE doc_id % 3 WHEN 0 THEN 'Box' || doc_id % 7 WHEN 1 THEN 'run' || doc_id % 5 END AS symbol FROM documents")
def chunk_symbols(spark: SparkSession, sf: str) -> DataFrame:
    return _crumbed(spark, sf).select("doc_id", filters.chunk_kind(F.col("breadcrumb")).alias("kind"), filters.symbol_name(F.col("breadcrumb")).alias("symbol"))


@query("SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id % 7 IN (3, 4)")
def kind_name_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.field_filter(_crumbed(spark, sf), filters.parse_text("kind:CLASS name:box3 name:BOX4 words")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE lang LIKE '%e%' AND (source || '/' || doc_id || '.ts') LIKE '%/%5.ts%'")
def loose_field_filter(spark: SparkSession, sf: str) -> DataFrame:
    return filters.loose_filter(_crumbed(spark, sf), filters.parse_text("lang:E path:*/*5.ts")).select("doc_id")


@query(f"WITH {FILES} SELECT path, CASE WHEN doc_id % 4 = 0 THEN hash WHEN doc_id % 4 = 1 THEN 'stale' END AS vector_index_hash FROM files")
def acknowledged_files(spark: SparkSession, sf: str) -> DataFrame:
    every = files(spark, sf).withColumn("vector_index_hash", F.when(F.col("doc_id") % 4 == 1, "stale"))
    done = every.where("doc_id % 4 = 0").select("path", "hash")
    return indexing.acknowledge(every, done).select("path", "vector_index_hash")


@query(f"{CHUNKS} SELECT doc_id, chunk_index, nws_size::INT AS nws_size FROM chunks WHERE doc_id % 5 <> 0 UNION ALL SELECT doc_id, 0, -1 FROM documents WHERE doc_id % 5 = 0")
def replaced_chunks(spark: SparkSession, sf: str) -> DataFrame:
    new = table(spark, sf, "documents").where("doc_id % 5 = 0").select("doc_id", F.lit(0).alias("chunk_index"), F.lit(-1).alias("nws_size"))
    return indexing.replace_chunks(_chunks(spark, sf).select("doc_id", "chunk_index", "nws_size"), new, "doc_id")


@query("SELECT id, n FROM (SELECT o_custkey AS id, o_orderkey AS n FROM orders) QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC) = 1")
def latest_rows(spark: SparkSession, sf: str) -> DataFrame:
    return indexing.last_wins(table(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("n")), "id", "n")


@query(f"WITH {FILES} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'skipped' WHEN doc_id % 10 = 0 THEN 'error' WHEN doc_id % 5 = 0 THEN 'indexed' ELSE 'pending' END AS status FROM files")
def graph_index_states(spark: SparkSession, sf: str) -> DataFrame:
    path = F.concat(F.col("doc_id").cast("string"), F.when(F.col("doc_id") % 3 == 0, ".py").otherwise(".ts"))
    rows = files(spark, sf).withColumn("path", path)
    states = rows.where("doc_id % 5 = 0 or doc_id % 7 = 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.col("hash")).otherwise("old").alias("hash"), F.when(F.col("doc_id") % 2 == 0, "error").otherwise("indexed").alias("status"))
    return indexing.graph_states(rows, states).select(F.substring_index("path", ".", 1).cast("long").alias("doc_id"), "status")


@query("SELECT doc_id, CASE WHEN n > CASE WHEN doc_id % 4 = 0 THEN 102400 ELSE 512000 END THEN 'skipped:large' WHEN doc_id % 5 = 0 THEN 'skipped:binary' WHEN doc_id % 4 = 1 THEN 'skipped:json' WHEN n > 102400 THEN 'lines' ELSE 'ok' END AS status FROM (SELECT doc_id, doc_id % 601 * 1000 AS n FROM documents)")
def file_scan_status(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    path = F.concat(d.cast("string"), F.when(d % 4 == 0, ".bin").when(d % 4 == 1, "-lock.json").otherwise(".ts"))
    rows = table(spark, sf, "documents").select("doc_id", readers.scan_status(path, d % 601 * 1000, F.when(d % 5 == 0, "a\x00b").otherwise("ab")).alias("status"))
    return rows


@query("SELECT doc_id, (doc_id % 6 = 0) OR (doc_id % 6 = 1 AND doc_id % 7 <> 3) OR doc_id % 6 = 2 AS ignored FROM documents")
def ignored_paths(spark: SparkSession, sf: str) -> DataFrame:
    d = F.col("doc_id")
    name = F.concat(F.lit("f"), (d % 7).cast("string"))
    path = F.when(d % 6 == 0, F.concat(F.lit("a/node_modules/"), name)).when(d % 6 == 1, F.concat(F.lit("logs/"), name, F.lit(".log"))).when(d % 6 == 2, F.concat(F.lit("build/x/"), name)).when(d % 6 == 3, F.concat(F.lit("src/build/"), name)).otherwise(F.concat(F.lit("src/"), name))
    rules = ["# comment", "", "node_modules/", "*.log", "!f3.log", "/build/x"]
    return table(spark, sf, "documents").select("doc_id", readers.ignored(path, rules).alias("ignored"))


@query("SELECT doc_id, md5('äé ' || doc_id) AS text_md5 FROM documents")
def decoded_by_mark(spark: SparkSession, sf: str) -> DataFrame:
    text = F.concat(F.lit("äé "), F.col("doc_id").cast("string"))
    wide = F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), "(....)", "0000$1")
    swapped = F.regexp_replace(F.hex(F.encode(text, "UTF-16BE")), "(..)(..)", "$2$10000")
    raw = F.array(
        F.encode(text, "utf-8"), F.unhex(F.concat(F.lit("EFBBBF"), F.hex(F.encode(text, "utf-8")))), F.unhex(F.concat(F.lit("FFFE"), F.hex(F.encode(text, "UTF-16LE")))), F.unhex(F.concat(F.lit("FEFF"), F.hex(F.encode(text, "UTF-16BE")))),
        F.unhex(F.concat(F.lit("0000FEFF"), wide)), F.unhex(F.concat(F.lit("FFFE0000"), swapped)), F.encode(text, "ISO-8859-1"),
    )
    rows = table(spark, sf, "documents").select("doc_id", raw[(F.col("doc_id") % 7).cast("int")].alias("raw"))
    return rows.select("doc_id", F.md5(F.encode(readers.decoded(F.col("raw")), "utf-8")).alias("text_md5"))


@query("SELECT a.doc_id, CASE a.doc_id % 4 WHEN 0 THEN 'typescript' WHEN 1 THEN 'python' WHEN 2 THEN 'cpp' ELSE 'unknown' END AS language FROM documents a")
def language_of_paths(spark: SparkSession, sf: str) -> DataFrame:
    ends = F.array(*[F.lit(e) for e in (".TSX", ".py", ".hpp", ".xyz")])
    return table(spark, sf, "documents").select("doc_id", fx.language_of(F.concat(F.lit("a/b"), ends[(F.col("doc_id") % 4).cast("int")])).alias("language"))


@query("SELECT conv_id, turn, trim(coalesce(text, '')) AS vector, trim('Token' || role || ' login ' || trim(coalesce(text, ''))) AS lexical, trim(trim(coalesce(text, '')) || ' Token' || role || ' login') AS rerank FROM conversations")
def query_channels(spark: SparkSession, sf: str) -> DataFrame:
    terms = F.array(F.concat(F.lit(" Token"), "role"), F.lit("login"), F.lit(""), F.lit("login "))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", filters.channels(F.coalesce("text", F.lit("")), terms).alias("c"))
    return rows.select("conv_id", "turn", "c.*")


@query("SELECT doc_id, doc_id % 5 NOT IN (0, 1, 2) AS safe, CASE doc_id % 5 WHEN 0 THEN 'path_traversal_blocked' WHEN 1 THEN 'system_path_blocked' WHEN 2 THEN 'dangerous_command_blocked' WHEN 3 THEN 'file_deletion' ELSE '' END AS restriction FROM documents")
def tool_call_safety(spark: SparkSession, sf: str) -> DataFrame:
    k = (F.col("doc_id") % 5).cast("int")
    pick = lambda *v: F.array(*[F.lit(x) for x in v])[k]
    tool, path, command = pick("read", "read", "run", "delete-file", "read"), pick("a/../b", "/etc/passwd", "a", "a/b.txt", "a/b.txt"), pick("", "", "rm -rf / now", "", "ls")
    root = F.when(k == 1, F.lit(None).cast("string")).otherwise("/work")
    found = access.call_safety(tool, path, command, root, ["/etc"], [".ssh"], ["rm -rf /"], ["package.json"])
    return table(spark, sf, "documents").select("doc_id", found.alias("s")).select("doc_id", "s.safe", F.col("s.restriction").alias("restriction"))


@query("SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 0 ELSE floor((doc_id % 50 - doc_id % 7)::DOUBLE / (doc_id % 50) * 100 + 0.5)::BIGINT END AS percent FROM documents")
def savings_percentages(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fx.savings_percent(F.col("doc_id") % 50, F.col("doc_id") % 7).alias("percent"))


@query("SELECT doc_id, substr(md5('/work/' || source || '::' || doc_id * 1000), 1, 10) AS project FROM documents")
def project_ids(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fx.project_id(F.concat(F.lit("/work/"), "source"), F.col("doc_id") * 1000).alias("project"))


@query("SELECT doc_id, CASE WHEN s >= 86400 THEN s // 86400 || 'd ' || s % 86400 // 3600 || 'h ' || s % 3600 // 60 || 'm' WHEN s >= 3600 THEN s // 3600 || 'h ' || s % 3600 // 60 || 'm' ELSE s // 60 || 'm' END AS uptime FROM (SELECT doc_id, doc_id * 977 AS s FROM documents)")
def uptimes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fx.format_uptime(F.col("doc_id") * 977).alias("uptime"))


@query("SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text ELSE substr(text, 1, 200) || chr(10) || chr(10) || '... (truncated ' || (length(text) - 400) || ' characters) ...' || chr(10) || chr(10) || right(text, 200) END) AS shown FROM documents WHERE text IS NOT NULL")
def truncated_diffs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").where("text is not null")
    return rows.select("doc_id", F.md5(F.encode(reports.truncated_diff(F.col("text"), 400), "utf-8")).alias("shown"))


@query("WITH s AS (SELECT page_id AS id, page_id % 3 AS k FROM pages) SELECT (SELECT count(*) FROM s WHERE k = 0) AS anchors, (SELECT count(*) FROM s WHERE k = 1) AS pins, (SELECT count(*) FROM s WHERE k = 2) AS rewrites")
def signal_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(F.lit("anchor"), F.lit("path_pin"), F.lit("no_hit_rewrite"))
    found = analytics.signal_breakdown(table(spark, sf, "pages").select(names[(F.col("page_id") % 3).cast("int")].alias("signal")))
    of = lambda n: F.coalesce(F.try_element_at("breakdown", F.lit(n)), F.lit(0)).cast("long")
    return found.select(of("anchor").alias("anchors"), of("path_pin").alias("pins"), of("no_hit_rewrite").alias("rewrites"))


@query("SELECT doc_id, '{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}' AS evidence FROM documents")
def signal_evidence(spark: SparkSession, sf: str) -> DataFrame:
    return analytics.with_evidence(table(spark, sf, "documents").select("doc_id", "lang", "source"), "lang", "source").select("doc_id", "evidence")


@query(f"WITH {BM25}, best AS (SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 60) SELECT doc_id, (doc_id % 17)::DOUBLE AS score FROM best ORDER BY doc_id % 17 DESC, doc_id LIMIT 10")
def reranked_topn(spark: SparkSession, sf: str) -> DataFrame:
    best = _scored(spark, sf).orderBy(F.col("score").desc(), "doc_id").limit(60)
    return retrieval.rerank(best, (F.col("doc_id") % 17).cast("double"), 10, "doc_id").select("doc_id", "score")
