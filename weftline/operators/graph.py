"""Dependency graphs: extraction from sources, and impact by reverse breadth-first search."""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions import nesting
from weftline.functions.text import normalised_import
from weftline.plans.lineage import written

# Weights of confidences, decay by hop, bonus of tests, most nodes of an answer.
CONFIDENCE = {"high": 1.0, "medium": 0.65, "low": 0.35}
DECAY, TEST_BONUS, MOST_NODES = 0.75, 0.2, 200


_TEST = re.compile(r"^(describe|it|test|specify)(?: \. \w+)? \(\)")
_FIELD = re.compile(r"^(?:(?:public|private|protected|static|readonly|override|declare) )*#? ?(\w+) (?:: .*?)?= (?:async )?(?:\(\)|\w+) (?:: .*?)?=>")
_LOCAL = re.compile(r"^(?:export )?(?:const|let|var) (\w+)")
_IMPORT = re.compile(r"^(?:import|export)\b")
_NO_CALL = nesting.CONTROL | {"describe", "it", "test", "specify", "super", "require", "import", "typeof", "await", "constructor", "of", "in", "async"}


class _Script:
    """Declarations, calls and imports of one script, each as a row."""

    def __init__(self, path: str, text: str):
        self.path, self.rows = path, []
        self.t = nesting.tokens(text, "typescript")
        self.lines = [k for k, c in enumerate(text) if c == "\n"]
        self.walk(nesting.nodes(self.t), (0, len(text)), None, None, None)

    def line(self, at: int) -> int:
        return bisect.bisect_left(self.lines, at) + 1

    def row(self, fact: str, kind: str | None, name: str, at: int, scope: tuple[int, int], holder: str | None, own: str | None = None, end: int | None = None) -> None:
        self.rows.append((self.path, fact, kind, name, at, self.line(at), None if end is None else self.line(end - 1), *scope, holder, own))

    def walk(self, found: list[nesting.Node], scope: tuple[int, int], holder: str | None, cls: str | None, inside: nesting.Node | None) -> None:
        for n in found:
            if n.comment:
                continue
            kind, name = self.kind_of(n, cls if inside is not None and inside.prefix in ("class ", "abstract class ") else None)
            own = None
            if kind:
                label = re.sub("[:\n]", " ", name[:80])
                own = f"test:{self.path}:{label}" if kind == "test" else f"symbol:{self.path}:{name}:{self.line(n.start)}"
                self.row("declared", kind, name, n.start, scope, holder, own, n.end)
            elif m := _LOCAL.match(n.head):
                self.row("declared", "local", m.group(1), n.start, scope, holder)
            if _IMPORT.match(n.head):
                self.imports(n)
            self.calls(n, scope, own or holder, cls, name if kind in ("function", "method") else None)
            for a, b in n.blocks:
                block = (self.t.start[a - 1], self.t.end[b] if b < len(self.t.end) else scope[1])
                if kind in ("function", "method"):
                    self.parameters(n, block)
                self.walk(nesting.nodes(self.t, a, b, n), block, own or holder, own if kind == "class" else cls, n)

    def kind_of(self, n: nesting.Node, in_class: str | None) -> tuple[str | None, str | None]:
        if m := _TEST.match(n.head):
            label = next((self.t.word(k) for k in range(n.first, n.last) if self.t.kind[k] == "string"), None)
            return ("test", label.strip("'\"`")) if label else (None, None)
        if n.prefix in ("class ", "abstract class "):
            return "class", n.name
        if n.prefix in ("fn ", "fn* "):
            return "function", n.name
        if in_class and n.name and n.prefix == "":
            return ("method", n.name) if n.name != "constructor" else (None, None)
        if in_class and (m := _FIELD.match(n.head)):
            return "method", m.group(1)
        return ("function", n.name) if n.name and "=>" in n.head else (None, None)

    def tokens_of(self, n: nesting.Node) -> list[int]:
        """A statement's tokens outside its blocks."""
        out, k, blocks = [], n.first, dict(n.blocks)
        while k < n.last:
            if k in blocks:
                k = blocks[k]
            if self.t.kind[k] not in ("nl", "comment"):
                out.append(k)
            k += 1
        return out

    def calls(self, n: nesting.Node, scope: tuple[int, int], holder: str | None, cls: str | None, own_name: str | None) -> None:
        ks = self.tokens_of(n)
        for i, k in enumerate(ks[:-1]):
            name = self.t.word(k)
            if self.t.kind[k] != "word" or self.t.word(ks[i + 1]) != "(" or name in _NO_CALL or name[0].isdigit():
                continue
            before = self.t.word(ks[i - 1]) if i else ""
            if name == own_name and before != ".":  # the head of its own declaration
                own_name = None
                continue
            if before == "function":
                continue
            if before == ".":
                if i > 1 and self.t.word(ks[i - 2]) == "this" and cls:
                    self.row("called", "this", name, self.t.start[k], scope, holder, cls)
                continue
            self.row("called", "new" if before == "new" else "bare", name, self.t.start[k], scope, holder)

    def parameters(self, n: nesting.Node, block: tuple[int, int]) -> None:
        ks = self.tokens_of(n)
        for i in range(1, len(ks) - 1):
            if self.t.kind[ks[i]] == "word" and self.t.word(ks[i - 1]) in ("(", ",", ".") and self.t.word(ks[i + 1]) in (",", ")", "=", ":", "?"):
                self.row("declared", "local", self.t.word(ks[i]), self.t.start[ks[i]], block, None)

    def imports(self, n: nesting.Node) -> None:
        ks = [k for k in range(n.first, n.last) if self.t.kind[k] not in ("nl", "comment")]
        said = next((k for k in reversed(ks) if self.t.kind[k] == "string"), None)
        if said is None or not (self.t.word(ks[ks.index(said) - 1]) in ("from", "import")):
            return
        spec, words = self.t.word(said)[1:-1], [self.t.word(k) for k in ks[1 : ks.index(said)]]
        self.row("imported", None, spec, n.start, (0, 0), None)
        names = [w for w in words if w not in ("type", "from")]
        for i, w in enumerate(names):
            if re.fullmatch(r"\w+", w) and w != "as" and not (i + 1 < len(names) and names[i + 1] == "as"):
                first = names[i - 2] if i > 1 and names[i - 1] == "as" else w
                self.row("bound", "default" if i == 0 and first == w else "named", w, n.start, (0, 0), spec, first)


_FACTS = "path string, fact string, kind string, name string, at int, line int, end_line int, scope_start int, scope_end int, holder string, own string"


def script_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of script files: files, functions, classes, methods, tests; contains, imports, calls.

    Each file is read once for its declarations, calls and imports, with the scopes
    that they are in. A declaration is contained by the nearest one around it. A call
    is bound by joins: to the declaration of that name in the innermost scope around
    the call, a parameter or variable among them ends the search without a node;
    where no scope has one, through an import to what the other file declares at its
    top level; on ``this`` to the methods of the class around it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.int32()] * 5 + [pa.string()] * 2
        names = [c.split(" ")[0] for c in _FACTS.split(", ")]
        for batch in batches:
            for path, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = _Script(path, text).rows
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    scripts = files.where(F.lower(F.substring_index("path", ".", -1)).isin("ts", "tsx", "js", "jsx", "mts", "mjs", "cts", "cjs") & F.col("content").isNotNull())
    facts = written(scripts.select("path", "content").mapInArrow(read, _FACTS), "script-facts")
    file_id = F.concat(F.lit("file:"), F.col("path"))
    named = facts.where("fact = 'declared' and own is not null")
    nodes = files.select(F.concat(F.lit("file:"), "path").alias("id"), F.lit("file").alias("kind"), F.col("path").alias("name"), F.col("path").alias("file_path"), F.lit(1).alias("start_line")).unionByName(
        named.select(F.col("own").alias("id"), "kind", "name", F.col("path").alias("file_path"), F.col("line").alias("start_line")).distinct()
    )
    edge = lambda rows, kind, confidence: rows.select("from_id", "to_id", F.lit(kind).alias("kind"), F.col("path").alias("file_path"), F.lit(confidence).alias("confidence")).distinct()
    contains = edge(named.select(F.coalesce("holder", file_id).alias("from_id"), F.col("own").alias("to_id"), "path").where("from_id <> to_id"), "contains", "high")

    def reached(spec: str):
        target = normalised_import(F.col("path"), F.col(spec))
        return F.when(target.rlike(r"\.(ts|tsx|js|jsx)$"), target).otherwise(F.concat(target, F.lit(".ts")))

    imports = edge(facts.where("fact = 'imported'").withColumn("to", reached("name")).where("to is not null").select(file_id.alias("from_id"), F.concat(F.lit("file:"), "to").alias("to_id"), "path"), "imports", "high")

    calls = facts.where("fact = 'called'").select("path", "name", F.col("kind").alias("how"), "at", F.coalesce("holder", file_id).alias("from_id"), F.col("own").alias("cls"))
    known = facts.where("fact = 'declared' and kind <> 'method' and kind <> 'test'").select("path", "name", "scope_start", "scope_end", F.col("own").alias("to_id"))
    inner = calls.where("how <> 'this'").join(known, ["path", "name"], "left")
    within = F.col("scope_start").isNotNull() & (F.col("scope_start") <= F.col("at")) & (F.col("at") < F.col("scope_end"))
    # the innermost scope; of one scope the function or class before a variable of its name
    best = F.max(F.when(within, F.struct("scope_start", F.col("to_id").isNotNull().alias("is_node"), "to_id"))).alias("best")
    bound = inner.groupBy("path", "name", "at", "from_id").agg(best)
    local = bound.where("best.to_id is not null").select("from_id", F.col("best.to_id").alias("to_id"), "path")
    borrowed = facts.where("fact = 'bound'").select("path", "name", reached("holder").alias("other"), F.col("own").alias("there"), "kind")
    tops = facts.where("fact = 'declared' and own is not null and holder is null and scope_start = 0").select(F.col("path").alias("other"), F.col("name").alias("there"), F.col("own").alias("to_id"))
    far = bound.where("best is null").join(borrowed, ["path", "name"]).join(tops, ["other", "there"]).select("from_id", "to_id", "path")
    methods = facts.where("fact = 'declared' and kind = 'method'").select("path", "name", F.col("holder").alias("cls"), F.col("own").alias("to_id"))
    own = calls.where("how = 'this'").join(methods, ["path", "name", "cls"]).select("from_id", "to_id", "path")
    called = edge(local.unionByName(far).unionByName(own).where("from_id <> to_id"), "calls", "medium")
    return nodes, contains.unionByName(imports).unionByName(called)


def resolved_targets(nodes: DataFrame, targets: list[str]) -> tuple[DataFrame, list[str]]:
    """Nodes that the targets mean, and the targets that mean none: a path, else path:symbol, else a name, else a part of one."""
    wanted = nodes.sparkSession.createDataFrame([(t,) for t in targets], "target string")
    tail = F.substring_index("target", ":", -1)
    head = F.expr("substring(target, 1, greatest(length(target) - length(substring_index(target, ':', -1)) - 1, 0))")
    rank = (
        F.when((F.col("kind") == "file") & (F.col("file_path") == F.col("target")), 0)
        .when((F.col("file_path") == head) & (F.col("name") == tail), 1)
        .when(F.col("name") == F.col("target"), 2)
        .when(F.col("name").contains(F.col("target")) & (F.col("kind") != "file"), 3)
    )
    met = nodes.crossJoin(F.broadcast(wanted)).withColumn("_rank", rank).where("_rank is not null")  # the targets of one question, a handful
    best = met.withColumn("_least", F.min("_rank").over(Window.partitionBy("target"))).where("_rank = _least").select("target", "id")
    known = {r[0] for r in best.select("target").distinct().collect()}
    return best, [t for t in targets if t not in known]


def impact(edges: DataFrame, starts: DataFrame, depth: int = 2, most: int | None = MOST_NODES, tests: DataFrame | None = None) -> DataFrame:
    """(id, hop, score): nodes that reach a start against the direction of the edges, at their least hop.

    A node's score is its path's confidence times the decay by hop, and a bonus for
    tests. Each hop is one join with the frontier; ``edges`` has from_id, to_id and
    confidence. Starts are hop 0.
    """
    if not 1 <= depth <= 10:
        raise ValueError("depth lies between 1 and 10")
    weight = reduce(lambda acc, c: acc.when(F.col("confidence") == c, CONFIDENCE[c]), CONFIDENCE, F.when(F.lit(False), 0.0)).otherwise(CONFIDENCE["low"])
    back = written(edges.where("from_id <> to_id").groupBy(F.col("to_id").alias("id"), "from_id").agg(F.max(weight).alias("_w")), "back")
    seen = starts.select("id").distinct().withColumns({"hop": F.lit(0), "conf": F.lit(1.0)})
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(back, "id").groupBy(F.col("from_id").alias("id")).agg(F.lit(hop).alias("hop"), F.max(F.col("conf") * F.col("_w")).alias("conf"))
        # without the cut each hop would compute all earlier ones again, twice
        frontier = written(reached.join(seen.select("id"), "id", "left_anti").select("id", "hop", "conf"), "frontier")
        seen = seen.unionByName(frontier)
    out = seen.withColumn("score", F.col("conf") * F.pow(F.lit(DECAY), F.col("hop")))
    if tests is not None:
        out = out.join(tests.select("id").distinct().withColumn("_test", F.lit(TEST_BONUS)), "id", "left").withColumn("score", F.col("score") + F.coalesce("_test", F.lit(0.0))).drop("_test")
    out = out.drop("conf")
    return out.orderBy(F.col("score").desc(), "id").limit(most) if most else out
