"""Sources: file trees, decoding, evaluation datasets, task lists, cached embeddings."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.charset import detected
from weftline.functions.text import LANGUAGES, extension, glob_regex, language_of

#: Byte-order marks, in hexadecimal.
MARKS = ("FFFE", "FEFF", "EFBBBF", "0000FEFF")
KNOWN_MOST, UNKNOWN_MOST, LINES_FROM = 500 << 10, 100 << 10, 100 << 10


def rules(patterns: list[str]) -> list[tuple[str, bool]]:
    """(regular expression, whether it ignores) of each rule, patterns as in a .gitignore."""
    out = []
    for line in patterns:
        rule = line.strip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.lstrip("!")
        folder, rule = rule.endswith("/"), rule.rstrip("/")
        body = glob_regex(rule.lstrip("/")).strip("^$").replace(".*/", "(?:.*/)?")
        out.append((("^" if "/" in rule else "(?:^|/)") + body + ("/" if folder else "(?:/|$)"), not keep))
    return out


def ignored(path: Column, patterns: list[str]) -> Column:
    """Whether a relative path is ignored: the last rule that matches decides.

    A leading ``!`` re-includes, a trailing ``/`` means a folder, and a pattern
    without an inner ``/`` matches at any depth.
    """
    return reduce(lambda out, r: F.when(path.rlike(r[0]), F.lit(r[1])).otherwise(out), rules(patterns), F.lit(False))


def listed(spark: SparkSession, root: str, ignore: list[str]) -> list[tuple[str, int]]:
    """(relative path, bytes) of the files below ``root``; a folder that is ignored, and has no rule that may re-include, isn't entered."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    store = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    known = [(re.compile(r), drops) for r, drops in rules(ignore)]
    closed = all(drops for _, drops in known)
    decided = lambda path: next((drops for r, drops in reversed(known) if r.search(path)), False)
    out, todo = [], [(base, "")]
    while todo:
        where, prefix = todo.pop()
        for found in store.listStatus(where):
            name = prefix + found.getPath().getName()
            if found.isDirectory():
                if not (closed and decided(name + "/")):
                    todo.append((found.getPath(), name + "/"))
            elif not decided(name):
                out.append((name, found.getLen()))
    return sorted(out)


def decoded(content: Column) -> Column:
    """Text of bytes by their byte-order mark, else as UTF-8, else by the character set that fits best.

    Only bytes that the first two don't settle leave the JVM.
    """
    head = F.hex(F.substring(content, 1, 4))
    rest = lambda n: F.substr(content, F.lit(n))
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
    marked = reduce(lambda a, m: a | head.startswith(m), MARKS, F.lit(False))
    other = detected(F.when(~marked & ~F.is_valid_utf8(content.cast("string")), content))["text"]
    return (
        F.when(head.startswith("FFFE0000") | head.startswith("0000FEFF"), F.decode(content, "UTF-32"))  # the mark tells the order
        .when(head.startswith("EFBBBF"), F.decode(rest(4), "UTF-8"))
        .when(head.startswith("FFFE"), F.decode(rest(3), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(rest(3), "UTF-16BE"))
        .otherwise(F.coalesce(utf8, other))
    )


def scan_status(path: Column, size: Column, content: Column) -> Column:
    """``skipped:large``, ``skipped:binary``, ``skipped:json``, ``lines`` (split by line only) or ``ok``."""
    known = extension(path).isin(*LANGUAGES)
    json = (extension(path) == "json") & (path.endswith("-lock.json") | path.contains("node_modules/"))
    return (
        F.when(F.when(known, size > KNOWN_MOST).otherwise(size > UNKNOWN_MOST), "skipped:large")
        .when(F.coalesce(F.contains(content, F.lit("\x00")), F.lit(False)), "skipped:binary")
        .when(json, "skipped:json")
        .when(size > LINES_FROM, "lines")
        .otherwise("ok")
    )


def file_tree(spark: SparkSession, root: str, ignore: list[str] | None = None, include: list[str] | None = None) -> DataFrame:
    """path (relative), hash, mtime, size, language, content, status of the files below ``root``.

    Unknown extensions are kept only where an include pattern matches. Names come
    first: ignored folders aren't entered, and only files that are kept and not too
    large are opened. The driver holds the names, as Spark's own listing does.
    """
    base = root.rstrip("/")
    schema = spark.read.format("binaryFile").schema
    globs = [re.compile(glob_regex(g)) for g in include or []]
    suffix = lambda path: path.rsplit(".", 1)[-1].lower()
    allowed = [(p, n) for p, n in listed(spark, base, ignore or []) if suffix(p) in LANGUAGES or any(g.search(p) for g in globs)]
    opened = [f"{base}/{p}" for p, n in allowed if n <= (KNOWN_MOST if suffix(p) in LANGUAGES else UNKNOWN_MOST)]
    large = [(p, n) for p, n in allowed if n > (KNOWN_MOST if suffix(p) in LANGUAGES else UNKNOWN_MOST)]
    relative = F.regexp_replace("path", "^.*?" + glob_regex(base.split(":")[-1]).strip("^$") + "/", "")
    rows = spark.read.format("binaryFile").load(opened).withColumn("path", relative) if opened else spark.createDataFrame([], schema)
    if large:  # told by name and size alone
        names = spark.createDataFrame(large, "path string, length long")
        rows = rows.unionByName(names, allowMissingColumns=True)
    text = decoded(F.col("content"))
    return rows.select("path", F.sha2("content", 256).alias("hash"), F.unix_millis("modificationTime").alias("mtime"), F.col("length").alias("size"), language_of(F.col("path")).alias("language"), text.alias("content")).withColumn("status", scan_status(F.col("path"), F.col("size"), F.col("content")))


CASE = "id string, query string, retrieved array<string>, relevant map<string,double>"
TUNE_CASE = "id string, query string, vectorRetrieved array<string>, lexicalRetrieved array<string>, relevant map<string,double>"


def evaluation_cases(spark: SparkSession, path: str, schema: str = CASE) -> DataFrame:
    """Cases of a .jsonl file, or of a .json file that is an array or an object with ``cases``; bad ones raise."""
    if path.endswith(".jsonl"):
        rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    else:
        reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
        wrapped = "cases" in reader.json(path).columns
        rows = reader.schema(f"cases array<struct<{schema.replace(' ', ':').replace(':array', ':array').replace(',:', ',')}>>").json(path).select(F.inline("cases")) if wrapped else reader.schema(schema).json(path)
    good = (F.trim("id") != "") & (F.trim("query") != "") & F.forall(F.map_values("relevant"), lambda g: (g >= 0) & (g < float("inf")))
    return rows.where(F.assert_true(F.coalesce(good, F.lit(False)), F.concat(F.lit("bad case "), F.coalesce("id", F.lit("without id")))).isNull())


def project_tasks(found: DataFrame) -> DataFrame:
    """(name, command, file, type, description) of the tasks that build files declare; ``found`` has path and content.

    A script's description is what it runs; other tasks have none.
    """
    name = F.substring_index("path", "/", -1)
    scripts = F.from_json(F.get_json_object("content", "$.scripts"), "map<string,string>")
    deno = F.from_json(F.get_json_object("content", "$.tasks"), "map<string,string>")
    keyed = lambda rows, col, kind, run: rows.select("path", F.explode(col).alias("name", "description")).select("name", F.concat(F.lit(run), "name").alias("command"), F.col("path").alias("file"), F.lit(kind).alias("type"), "description")
    listed = lambda rows, regex, kind, run: rows.select("path", F.explode(F.regexp_extract_all("content", F.lit(regex), 1)).alias("name")).select("name", F.concat(F.lit(run), "name").alias("command"), F.col("path").alias("file"), F.lit(kind).alias("type"), F.lit(None).cast("string").alias("description"))
    cargo = found.where(name == "Cargo.toml").select(F.explode(F.array(*[F.lit(t) for t in ("build", "test", "run", "check", "clippy")])).alias("name"), "path")
    return (
        keyed(found.where(name == "package.json"), scripts, "npm", "npm run ")
        .unionByName(keyed(found.where(name.isin("deno.json", "deno.jsonc")), deno, "deno", "deno task "))
        .unionByName(listed(found.where(name == "Makefile"), r"(?m)^([A-Za-z0-9_-]+):(?!=)", "make", "make "))
        .unionByName(listed(found.where(F.lower(name) == "justfile"), r"(?m)^([A-Za-z0-9_-]+)(?: [^:\n]*)?:(?!=)", "just", "just "))
        .unionByName(cargo.select("name", F.concat(F.lit("cargo "), "name").alias("command"), F.col("path").alias("file"), F.lit("cargo").alias("type"), F.lit(None).cast("string").alias("description")))
    )


def whole_entries(cache: DataFrame, width: int | None = None) -> DataFrame:
    """The cache's (key, vector) that can be used: vectors that aren't empty, hold numbers alone and, where it is known, have the width."""
    v = F.col("vector")
    good = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return cache.where(good & (F.size(v) == width) if width else good).select("key", "vector")


def cached_embeddings(texts: DataFrame, cache: DataFrame, text_col: str = "text", width: int | None = None) -> DataFrame:
    """``texts`` with the cached vector of each, null where it has to be made; the key is the text's MD5."""
    return texts.withColumn("key", F.md5(F.encode(text_col, "utf-8"))).join(whole_entries(cache, width).dropDuplicates(["key"]), "key", "left")


def embedding_misses(texts: DataFrame, cache: DataFrame, text_col: str = "text", width: int | None = None) -> DataFrame:
    """Distinct (key, text) without a cached vector; a corrupt entry is none."""
    keyed = texts.select(F.md5(F.encode(text_col, "utf-8")).alias("key"), text_col)
    return keyed.join(whole_entries(cache, width).select("key"), "key", "left_anti").dropDuplicates(["key"])
