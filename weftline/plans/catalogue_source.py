"""Queries over source text with nesting: script graphs and structural chunks, and their SQL.

The input tables hold no source code, so each document stands for a file whose lines
differ by its id. The SQL reads the same lines by pattern, which works as they are
regular; names in strings and comments are there to mislead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import chunking, graph
from weftline.plans.catalogue import query
from weftline.sources.tables import table

#: Lines of a script, as expressions of both dialects.
_SCRIPT = [
    """concat("import { run as go", doc_id % 3, " } from './f", doc_id + 1, "';")""", """concat("// function fake", doc_id, "() {")""", """concat("export class Box", doc_id, " {")""",
    """concat("  open() { const s = '}'; ", CASE WHEN doc_id % 2 = 0 THEN "helper" ELSE concat("go", doc_id % 3) END, "(); }")""", '''"  close(helper) { helper(); } // helper();"''', '''"}"''', """"function helper() { return 'function other() {'; }\"""", '''"export function run() {"''',
    '''CASE WHEN doc_id % 3 = 0 THEN "  function helper() { return 1; }" ELSE "  /* } */" END''', '''"  helper();"''', '''"}"''', """concat("test('case ", doc_id, "', () => { run(); });")""",
]


def _for_duckdb(expression: str) -> str:
    """Strings in double quotes, as Spark reads them, in single ones."""
    return "'".join(p.replace("'", "''") if k % 2 else p for k, p in enumerate(expression.split('"')))


_LINES = rf"""d AS (SELECT doc_id, 'src/f' || doc_id || '.ts' AS p, concat_ws(chr(10), {", ".join(map(_for_duckdb, _SCRIPT))}) AS content FROM documents),
    l AS (SELECT doc_id, p, unnest(string_split(content, chr(10))) AS line, unnest(generate_series(1, len(string_split(content, chr(10))))) AS n FROM d),
    c AS (SELECT *, CASE WHEN line LIKE '//%' THEN NULL WHEN regexp_matches(line, '^export class ') THEN 'class' WHEN regexp_matches(line, '^ *(export )?function ') THEN 'function' WHEN regexp_matches(line, '^test') THEN 'test' WHEN regexp_matches(line, '^  [a-z]+\([a-z]*\) ') THEN 'method' END AS kind,
        coalesce(nullif(regexp_extract(line, '(?:class|function) (\w+)', 1), ''), nullif(regexp_extract(line, '^test.''([^'']+)''', 1), ''), regexp_extract(line, '^  (\w+)', 1)) AS name FROM l),
    s AS (SELECT *, CASE kind WHEN 'test' THEN 'test:' || p || ':' || name ELSE 'symbol:' || p || ':' || name || ':' || n END AS id FROM c WHERE kind IS NOT NULL),
    t AS (SELECT s.doc_id, s.p, s.id, max_by(u.id, u.n) FILTER (s.line LIKE '  %') AS parent FROM s LEFT JOIN s u ON u.doc_id = s.doc_id AND u.n < s.n AND u.line NOT LIKE '  %' GROUP BY ALL)"""


def _graph(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    lines = F.concat_ws("\n", *[F.expr(line) for line in _SCRIPT])
    return graph.script_graph(table(spark, sf, "documents").select(F.expr("concat('src/f', doc_id, '.ts')").alias("path"), lines.alias("content")))


@query(f"WITH {_LINES} SELECT 'file:' || p AS id, 'file' AS kind, 1 AS start_line FROM d UNION ALL SELECT id, kind, n FROM s")
def script_graph_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)[0].select("id", "kind", "start_line")


# A call belongs to what its line declares, else to the function that the line is in; parameters hide functions, inner functions outer ones, and what no scope has is imported.
@query(
    rf"""WITH {_LINES}, calls AS (SELECT doc_id, p, n, line, unnest(regexp_extract_all(regexp_replace(line, ' //.*', ''), '(\w+)\(\);', 1)) AS called FROM l WHERE line NOT LIKE '//%'),
    held AS (SELECT k.*, coalesce(any_value(o.id), max_by(u.id, u.n)) AS from_id FROM calls k LEFT JOIN s o ON o.doc_id = k.doc_id AND o.n = k.n LEFT JOIN s u ON u.doc_id = k.doc_id AND u.n < k.n AND u.line NOT LIKE '  %' GROUP BY ALL),
    alias AS (SELECT doc_id, regexp_extract(line, 'as (\w+)', 1) AS called, regexp_extract(line, '\{{ (\w+)', 1) AS there, 'src/' || regexp_extract(line, '\./(\w+)', 1) || '.ts' AS p FROM l WHERE line LIKE 'import%'),
    own AS (SELECT h.*, max_by(u.id, (u.line LIKE '  %')::INT) AS local FROM held h LEFT JOIN s u ON u.doc_id = h.doc_id AND u.kind = 'function' AND u.name = h.called AND (u.line NOT LIKE '  %' OR (h.line LIKE '  %' AND h.from_id LIKE '%:run:%')) WHERE NOT contains(h.line, '(' || h.called || ')') GROUP BY ALL),
    bound AS (SELECT from_id, coalesce(local, x.id) AS to_id FROM own LEFT JOIN alias a ON a.doc_id = own.doc_id AND a.called = own.called LEFT JOIN s x ON x.p = a.p AND x.name = a.there)
    SELECT 'file:' || p AS from_id, 'file:src/' || regexp_extract(line, '\./(\w+)', 1) || '.ts' AS to_id, 'imports' AS kind FROM l WHERE line LIKE 'import%' UNION ALL SELECT coalesce(parent, 'file:' || p), id, 'contains' FROM t UNION ALL SELECT DISTINCT from_id, to_id, 'calls' FROM bound WHERE to_id IS NOT NULL"""
)
def script_graph_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _graph(spark, sf)[1].select("from_id", "to_id", "kind")


#: By language: extension, and as expressions of both dialects the comment before a unit, its head, one of its lines, what a breadcrumb calls it, and the class around every third file's units.
_UNITS = {
    "typescript": ("ts", """concat('// a } " ', u)""", "concat(CASE WHEN doc_id % 3 = 0 THEN '  f' ELSE 'async function f' END, u, '_', doc_id, '(a = ''}'') {')", """concat('  call("}{", `{${ ', j + doc_id % 90, ' }`);')""", "concat(CASE WHEN doc_id % 3 = 0 THEN 'f' ELSE 'fn f' END, u, '_', doc_id)", "export class"),
    "go": ("go", "concat('/* a { */ // ', u)", "concat('func (r *R) f', u, '_', doc_id, '(a int) {')", "concat(chr(9), 'call(`}{`, \"{\", ', j + doc_id % 90, ')')", "concat('func f', u, '_', doc_id)", None),
    "java": ("java", "concat('/* } ; */ // ', u)", "concat('@Two({1, 2}) static int f', u, '_', doc_id, '(int a) throws E {')", """concat('  call("}{", ', chr(39), '{', chr(39), ', ', j + doc_id % 90, ');')""", "concat('f', u, '_', doc_id)", "public class"),
    "rust": ("rs", "concat('/// { ', u)", "concat('pub fn f', u, '_', doc_id, '<', chr(39), 'a>(a: &str) -> X {')", """concat('  call(r#"}"{"#, ', j + doc_id % 90, ');')""", "concat('fn f', u, '_', doc_id)", None),
    "c": ("c", "concat('/* ; { */ // ', u)", "concat('static int f', u, '_', doc_id, '(int a) {')", """concat('  call(', chr(39), '}', chr(39), ', "{", ', j + doc_id % 90, ');')""", "concat('f', u, '_', doc_id)", None),
}


def _by_language(of) -> str:
    return "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN {of(*unit)}" for k, unit in enumerate(_UNITS.values())) + " END"


def _units(spark: bool) -> tuple[str, str, str]:
    """Expressions of a file's units, of the breadcrumbs' ends, and of its path."""
    each = (lambda n, x, e: f"transform(sequence(1, {n}), {x} -> {e})") if spark else (lambda n, x, e: f"list_transform(generate_series(1, {n}), lambda {x}: {e})")
    nl, joined = "chr(10)", "array_join" if spark else "array_to_string"

    def text(ext, comment, head, line, shown, cls):
        body = f"{joined}({each('23 + doc_id % 4', 'j', line)}, {nl})"
        unit = f"concat({comment}, {nl}, {head}, {nl}, {body}, {nl}, '}}')"
        if not cls:
            return unit
        first, last = f"concat(CASE WHEN u = 1 THEN concat('{cls} A', doc_id, ' {{', {nl}) ELSE '' END, ", f", CASE WHEN u = 1 + doc_id % 4 THEN concat({nl}, '}}') ELSE '' END)"
        return f"CASE WHEN {'TRUE' if ext == 'java' else 'doc_id % 3 = 0'} THEN {first}{unit}{last} ELSE {unit} END"

    def crumb(ext, comment, head, line, shown, cls):
        return f"CASE WHEN {'TRUE' if ext == 'java' else 'doc_id % 3 = 0'} THEN concat('class A', doc_id, ' > ', {shown}) ELSE {shown} END" if cls else shown

    n = "1 + doc_id % 4"
    path = f"concat('src/d', doc_id % 7, '/f', doc_id, '.', {_by_language(lambda ext, *_: repr(ext))})"
    return each(n, "u", _by_language(text)), each(n, "u", _by_language(crumb)), path


_TEXTS, _CRUMBS, _PATH = _units(spark=False)


# Every unit nearly fills a chunk, so each makes one, with the comment before it; a file of one unit that fits is one chunk of the file's own name.
@query(
    rf"""WITH f AS (SELECT doc_id, {_PATH} AS path, {_TEXTS} AS units, {_CRUMBS} AS crumbs FROM documents), k AS (SELECT *, generate_subscripts(units, 1) AS k FROM f),
    e AS (SELECT *, length(array_to_string(units, chr(10) || chr(10))) AS total, list_sum(list_transform(units[1 : k], lambda x: length(x) + 2)) - 2 AS stop, list_sum(list_transform(units[1 : k], lambda x: length(x) + 2)) - 2 - length(units[k]) AS start FROM k)
    SELECT path, (k - 1)::INT AS chunk_index, (start - CASE WHEN k = 1 THEN 0 ELSE length(regexp_extract(units[k - 1] || chr(10) || chr(10), '(?:[^ \t\n][ \t\n]*){{32}}$')) END)::INT AS vec_start, (CASE WHEN k = 1 THEN 0 ELSE start - 2 END)::INT AS raw_start, (CASE WHEN k = len(units) THEN total ELSE stop END)::INT AS raw_end,
        CASE WHEN len(units) = 1 AND length(translate(units[1], ' ' || chr(9) || chr(10), '')) <= 700 THEN path ELSE path || ' > ' || crumbs[k] END AS breadcrumb FROM e"""
)
def structural_chunks(spark: SparkSession, sf: str) -> DataFrame:
    units, _, path = _units(spark=True)
    language = F.element_at(F.array(*[F.lit(name) for name in _UNITS]), (F.col("doc_id") % 5 + 1).cast("int"))
    rows = table(spark, sf, "documents").select(F.expr(path).alias("path"), language.alias("language"), F.array_join(F.expr(units), "\n\n").alias("content"))
    return chunking.semantic_chunks(rows).select("path", "chunk_index", "vec_start", "raw_start", "raw_end", "breadcrumb")
