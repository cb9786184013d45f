"""Imports of source files: extraction by pattern, resolution by equal keys.

Each language says how its imports look and which paths an import may mean. Exact
candidates join on the path, those of scripts on the path without extension, whose
order is told afterwards; candidates known by their end join on path suffixes,
which every file offers. The first candidate that exists wins, among files with the
same suffix or run of folders the one whose folder shares most leading parts with
the importing file's folder.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import normalised_import
from weftline.plans.lineage import written

# Extensions of script modules, in order of preference, and what an explicit one may stand for.
SCRIPT = [".ts", ".tsx", ".js", ".jsx", ".mts", ".mjs", ".cts", ".cjs"]
SCRIPT_MAPPED = {".js": [".ts", ".tsx", ".js", ".jsx"], ".jsx": [".tsx", ".jsx"], ".mjs": [".mts", ".mjs"], ".cjs": [".cts", ".cjs"]}


@dataclass(frozen=True)
class Language:
    """Extensions, patterns (each with the group that holds the import, and a tag put before it) and candidates.

    ``candidates(file, import)`` gives array<struct<kind, value>> in order of
    preference; kind is ``path``, ``suffix``, ``folder`` or, for a path that lacks its
    extension, ``script`` with the extension that is written, if any.
    """

    extensions: tuple[str, ...]
    patterns: tuple[tuple[str, int, str], ...]
    candidates: object


def _c(kind: str, value: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), value.alias("value"))


def _list(*items: Column) -> Column:
    return F.filter(F.array(*items), lambda x: x["value"].isNotNull())


def _slashed(name: Column) -> Column:
    return F.translate(name, ".", "/")


def _last(name: Column, sep: str) -> Column:
    return F.substring_index(name, sep, -1)


def _folder(path: Column) -> Column:
    return F.when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def _join(folder: Column, rest: Column) -> Column:
    return F.when(folder == "", rest).otherwise(F.concat(folder, F.lit("/"), rest))


def _script(file: Column, name: Column) -> Column:
    """A script by its path without extension, then the index of the folder of that name."""

    def of(base: Column) -> Column:
        out = _list(_c("script", base), _c("script", F.concat(base, F.lit("/index"))))
        for ext in SCRIPT:  # an explicit extension may stand for some others alone
            out = F.when(base.endswith(ext), _list(_c(f"script{ext}", F.regexp_replace(base, f"\\{ext}$", "")))).otherwise(out)
        return out

    # the path is worked out once, not in each place where it is used
    return F.transform(F.array(normalised_import(file, name)), of)[0]


def _script_rank(kind: Column, ext: Column) -> Column:
    """The place of a file's extension among those that an import may mean; null where it can't mean that one."""
    orders = {"script": SCRIPT} | {f"script{e}": SCRIPT_MAPPED.get(e, [e]) for e in SCRIPT}
    known = F.create_map(*[F.lit(x) for k, order in orders.items() for n, e in enumerate(order) for x in (f"{k} {e}", n)])
    return F.try_element_at(known, F.concat(kind, F.lit(" "), ext))


def _python(file: Column, name: Column) -> Column:
    dots = F.length(F.regexp_extract(name, r"^(\.*)", 1))
    rest = _slashed(F.regexp_replace(name, r"^\.+", ""))
    parts = F.split(_folder(file), "/")
    up = F.array_join(F.slice(parts, 1, F.greatest(F.size(parts) - (F.greatest(dots, F.lit(1)) - 1), F.lit(0))), "/")
    module = F.when(rest == "", up).otherwise(_join(up, rest))
    relative = _list(_c("path", F.when(rest != "", F.concat(module, F.lit(".py")))), _c("path", _join(module, F.lit("__init__.py"))))
    absolute = _list(_c("suffix", F.concat(rest, F.lit(".py"))), _c("suffix", F.concat(rest, F.lit("/__init__.py"))))
    return F.when(dots > 0, relative).otherwise(absolute)


def _dotted(ext: str, last_too: bool = False):
    def of(file: Column, name: Column) -> Column:
        bare = F.regexp_replace(F.regexp_replace(name, r"^@?\w+::", ""), "@", "")
        folder = F.when(bare.endswith(".*"), _slashed(F.regexp_replace(bare, r"\.\*$", "")))
        one = F.when(~bare.endswith(".*"), F.concat(_slashed(bare), F.lit(ext)))
        last = F.when(~bare.endswith(".*"), F.concat(_last(bare, "."), F.lit(ext))) if last_too else F.lit(None).cast("string")
        return _list(_c("folder", folder), _c("suffix", one), _c("suffix", last))

    return of


def _php(file: Column, name: Column) -> Column:
    path = F.translate(F.regexp_replace(name, r"^\\+", ""), "\\", "/")
    last = _last(path, "/")
    return _list(*[_c("suffix", F.concat(p, F.lit(e))) for p in (path, last) for e in (".php", "/index.php")])


def _ruby(file: Column, name: Column) -> Column:
    kind, value = F.substring_index(name, ":", 1), F.regexp_replace(name, "^[a-z_]+:", "")
    here = normalised_import(file, F.concat(F.lit("./"), value))
    exact = F.when(here.endswith(".rb"), _list(_c("path", here))).otherwise(_list(_c("path", F.concat(here, F.lit(".rb"))), _c("path", F.concat(here, F.lit("/index.rb")))))
    logical = F.regexp_replace(F.regexp_replace(value, "^/+", ""), r"\.rb$", "")
    return F.when(kind == "require_relative", exact).otherwise(_list(*[_c("suffix", F.concat(p, F.lit(e))) for p in (logical, _last(logical, "/")) for e in (".rb", "/index.rb")]))


def _swift(file: Column, name: Column) -> Column:
    module = F.substring_index(name, ".", 1)
    return _list(_c("suffix", F.concat(_slashed(name), F.lit(".swift"))), _c("suffix", F.concat(module, F.lit(".swift"))), _c("folder", module))


def _dart(file: Column, name: Column) -> Column:
    base = normalised_import(file, name)
    return _list(_c("path", base), _c("path", F.when(~base.endswith(".dart"), F.concat(base, F.lit(".dart")))))


def _rust(file: Column, name: Column) -> Column:
    kind, value = F.substring_index(name, ":", 1), F.regexp_replace(name, "^(mod|use):", "")
    here = _folder(file)
    root = F.when(file.contains("/src/"), F.regexp_extract(file, "^(.*?/src)/", 1)).otherwise(here)
    head, rest = F.substring_index(value, "::", 1), F.regexp_replace(F.regexp_replace(value, r"^\w+::", ""), "::", "/")
    base = F.when(kind == "mod", _join(here, value)).when(head == "crate", _join(root, rest)).when(head == "super", _join(_folder(here), rest)).otherwise(_join(here, rest))
    return _list(_c("path", F.concat(base, F.lit(".rs"))), _c("path", F.concat(base, F.lit("/mod.rs"))))


def _c_family(file: Column, name: Column) -> Column:
    return _list(_c("path", _join(_folder(file), name)), _c("path", name), _c("suffix", name))


def _go(file: Column, name: Column) -> Column:
    return _list(_c("folder", F.when(name.contains("/") | name.contains("."), name)))


# The shapes of import statements.
REGISTRY = [
    Language(("ts", "tsx", "js", "jsx", "mts", "mjs", "cts", "cjs"), ((r"(?:import|export)\s+(?:[\w\s{},*]+\s+from\s+)?['\"]([^'\"]+)['\"]", 1, ""), (r"(?:import|require)\s*\(\s*['\"]([^'\"]+)['\"]\s*\)", 1, "")), _script),
    Language(("py",), ((r"(?m)^\s*from\s+(\.{0,3}[\w.]*)\s+import", 1, ""), (r"(?m)^\s*import\s+([\w.]+)", 1, "")), _python),
    Language(("go",), ((r'(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"', 1, ""),), _go),
    Language(("java",), ((r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?);", 1, ""),), _dotted(".java")),
    Language(("kt",), ((r"(?m)^\s*import\s+([\w.]+(?:\.\*|\.[A-Z]\w*))(?:\s+as\s+\w+)?\s*$", 1, ""),), _dotted(".kt")),
    Language(("php",), ((r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)(?:\s+as\s+\w+)?\s*;", 1, ""),), _php),
    Language(("rb",), ((r"(?m)^\s*require\s+['\"]([^'\"]+)['\"]", 1, "require:"), (r"(?m)^\s*require_relative\s+['\"]([^'\"]+)['\"]", 1, "require_relative:"), (r"(?m)^\s*autoload\s+:\w+\s*,\s*['\"]([^'\"]+)['\"]", 1, "autoload:")), _ruby),
    Language(("swift",), ((r"(?m)^\s*(?:@testable\s+)?import\s+(?:(?:typealias|struct|class|enum|protocol|let|var|func)\s+)?([\w.]+)\s*;?\s*$", 1, ""),), _swift),
    Language(("dart",), ((r"(?m)^\s*(?:import|export|part(?:\s+of)?)\s+['\"](\.{1,2}/[^'\"]+)['\"]", 1, ""),), _dart),
    Language(("rs",), ((r"(?m)^\s*(?:pub\s+)?mod\s+(\w+)\s*;", 1, "mod:"), (r"(?m)^\s*(?:pub\s+)?use\s+((?:crate|super|self)(?:::\w+)+)", 1, "use:")), _rust),
    Language(("c", "cc", "cpp", "cxx", "h", "hpp", "hh", "hxx"), ((r'(?m)^\s*#\s*include\s+"([^"]+)"', 1, ""),), _c_family),
    Language(("cs", "csx"), ((r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?(?:@?\w+\s*=\s*)?((?:@?\w+::)?@?\w+(?:\.@?\w+)*)\s*;", 1, ""),), _dotted(".cs", True)),
]


def _go_blocks(content: Column) -> Column:
    """Quoted paths inside import blocks in parentheses."""
    blocks = F.regexp_extract_all(content, F.lit(r"(?m)^\s*import\s*\(([^)]*)\)"), 1)
    return F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit('"([^"\n]+)"'), 1)))


def _php_groups(content: Column) -> Column:
    """Members of grouped use statements, each with the group's prefix."""
    groups = F.regexp_extract_all(content, F.lit(r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\]+\\\s*\{[^}]+\})\s*;"), 1)

    def members(g: Column) -> Column:
        prefix = F.regexp_extract(g, r"^([\w\\]+)\\\s*\{", 1)
        names = F.split(F.regexp_extract(g, r"\{([^}]+)\}", 1), ",")
        return F.transform(names, lambda m: F.concat(prefix, F.lit("\\"), F.regexp_extract(m, r"([\w\\]+)", 1)))

    return F.flatten(F.transform(groups, members))


def extracted(files: DataFrame) -> DataFrame:
    """(path, position, import) of each file's distinct imports, in order of first sight by pattern."""
    ext = F.lower(F.substring_index("path", ".", -1))
    none = F.array().cast("array<string>")
    found = none
    for lang in REGISTRY:
        parts = [F.transform(F.regexp_extract_all("content", F.lit(p), g), lambda x, tag=None: x) if not tag else F.transform(F.regexp_extract_all("content", F.lit(p), g), _tagged(tag)) for p, g, tag in lang.patterns]
        if "go" in lang.extensions:
            parts.append(_go_blocks(F.col("content")))
        if "php" in lang.extensions:
            parts.append(_php_groups(F.col("content")))
        found = F.when(ext.isin(*lang.extensions), F.array_distinct(F.concat(*parts))).otherwise(found)
    known = [e for lang in REGISTRY for e in lang.extensions]
    rows = files.where(ext.isin(*known) & F.col("content").isNotNull())
    return rows.select("path", F.posexplode(found).alias("position", "import"))


def _tagged(tag: str):
    return lambda x: F.concat(F.lit(tag), x)


def _prefixes(folder: Column) -> Column:
    """The folder and every folder above it, up to the empty one."""
    parts = F.split(folder, "/")
    inner = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    return F.when(folder == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), inner))


def _runs(folder: Column) -> Column:
    """Every run of a folder's parts."""
    parts = F.split(folder, "/")
    runs = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda b: F.transform(F.sequence(F.lit(1), b), lambda a: F.array_join(F.slice(parts, a, b - a + 1), "/")))
    return F.when(folder == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.flatten(runs)))


def _suffixes(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, n, F.size(parts)), "/"))


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the files, so neither goes whole through the driver.

    Spark takes a written table for as small as its compressed file, and would broadcast it.
    """
    return left.join(right.hint("merge"), on, how)


def nearest(asked: DataFrame, offered: DataFrame) -> DataFrame:
    """(family, kind, value, folder, best) for the asking folders: of the files that offer a key, the one to take.

    ``offered`` has family, kind, value, folder, test and to_path. Files that are no
    tests come first, then those that share most leading folders, then the first by
    path. Each key keeps one file for each folder above its files, each asking folder
    looks that up for each folder above itself, and the longest one found wins: rows
    grow with folders and files, not with their product.
    """
    key = ["family", "kind", "value"]
    wanted = asked.select(*key).distinct()
    known = _met(offered, wanted, key, "left_semi").withColumn("prefix", F.explode(_prefixes(F.col("folder"))))
    known = known.groupBy(*key, "prefix").agg(F.min(F.struct("test", "to_path")).alias("first"))
    asking = asked.select(*key, "folder").distinct().withColumn("prefix", F.explode(_prefixes(F.col("folder"))))
    depth = F.when(F.col("prefix") == "", 0).otherwise(F.size(F.split("prefix", "/")))
    best = F.min(F.struct(F.col("first.test").alias("test"), (-depth).alias("apart"), F.col("first.to_path").alias("to_path")))
    return _met(asking, known, [*key, "prefix"]).groupBy(*key, "folder").agg(best.alias("best"))


def resolved(files: DataFrame) -> DataFrame:
    """(from_path, position, import, to_path) of the imports that mean a file.

    An exact candidate joins on the path, one of a script on the path without
    extension. A candidate by its end, or by a run of folders, is looked up by
    ``nearest``; each folder of a language offers one file. Candidates are written, as
    several joins read them.
    """
    ext = F.lower(F.substring_index("path", ".", -1))
    options = F.array().cast("array<struct<kind:string,value:string>>")
    for lang in REGISTRY:
        options = F.when(ext.isin(*lang.extensions), lang.candidates(F.col("path"), F.col("import"))).otherwise(options)
    rows = extracted(files).select(F.col("path").alias("from_path"), "position", "import", _family(ext).alias("family"), _folder(F.col("path")).alias("folder"), F.posexplode(options).alias("choice", "o"))
    asked = written(rows.select("from_path", "position", "import", "family", "folder", "choice", "o.kind", "o.value"), "asked")
    by_end = F.col("kind").isin("suffix", "folder")
    near = asked.where(by_end)

    test = F.col("to_path").endswith("_test.go")
    offered = files.where(ext.isin(*[e for lang in REGISTRY for e in lang.extensions])).select(F.col("path").alias("to_path"), _family(ext).alias("family"), _folder(F.col("path")).alias("folder")).withColumn("test", test)
    suffixes = offered.select("family", F.lit("suffix").alias("kind"), F.explode(_suffixes(F.col("to_path"))).alias("value"), "folder", "test", "to_path")
    firsts = offered.groupBy("family", "folder").agg(F.min(F.struct("test", "to_path")).alias("f"))
    within = firsts.select("family", F.lit("folder").alias("kind"), F.explode(_runs(F.col("folder"))).alias("value"), "folder", "f.test", "f.to_path")
    # a script is known by its path without extension, any other file by its path
    stem = F.when(F.col("family") == _SCRIPTS, F.regexp_extract("to_path", f"(?s)^(.*)({'|'.join(re.escape(e) for e in SCRIPT)})$", 1)).otherwise(F.col("to_path"))
    end = F.when(F.col("family") == _SCRIPTS, F.concat(F.lit("."), F.substring_index("to_path", ".", -1)))
    exact = _met(asked.where(~by_end), offered.select("family", stem.alias("value"), end.alias("end"), "test", "to_path"), ["family", "value"])
    exact = exact.withColumn("rank", F.when(F.col("kind") == "path", 0).otherwise(_script_rank(F.col("kind"), F.col("end")))).where("rank is not null")
    hits = exact.select("from_path", "position", "import", "choice", F.struct("test", F.col("rank").alias("apart"), "to_path").alias("best")).unionByName(
        _met(near, nearest(near, suffixes.unionByName(within)), ["family", "kind", "value", "folder"]).select("from_path", "position", "import", "choice", "best")
    )
    first = F.min(F.struct("choice", "best", "position")).alias("m")
    return hits.groupBy("from_path", "import").agg(first).select("from_path", "m.position", "import", "m.best.to_path")


#: The number of the scripts' family.
_SCRIPTS = 0


def _family(ext: Column) -> Column:
    out = F.lit(None).cast("int")
    for k, lang in enumerate(REGISTRY):
        out = F.when(ext.isin(*lang.extensions), k).otherwise(out)
    return out
