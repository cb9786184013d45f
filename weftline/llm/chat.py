"""Chat formatting of reply trees.

A message replies to another or starts a tree. Iterative self-joins climb the trees:
after round k each message knows its ancestor 2^k replies up, the sum of scores and
the number of messages below that. Leaves rank by the mean score of their path, then
by its length, then by id; the best of each tree are followed back over the same
jumps, which doubles what is known of each path in every round. All of that moves
ids and numbers alone, so a conversation of any length is cut over all tasks.

Texts move once. They meet the marks of the chosen paths in one range partitioning by
conversation and message, and are formatted in order as a stream; what stands in
order is one piece of a path. Most paths are one piece. Where messages stand in
another order, a path is longer than a piece may be, or it crosses a border of the
partitions, pieces go to one more shuffle by path, where they are read in order.

A turn is <|im_start|>role, a line end, the text, <|im_end|>, a line end. In texts
and roles each <| gets a backslash between its characters, further ones where there
are some, so that no text holds a control string, and reading takes one away. Roles
have line ends and backslashes escaped besides. The loss mask is the spans of the
assistant's texts in the output.

Defined cases: a null or empty text is an empty turn; a null role is an empty role;
a null conversation is one of its own; a message without id is one message of its
conversation, together with all others without id; rows that share a message id are
turns one after the other, by role and by a digest of their texts; of unequal parents
or scores of one id the least parent and the least score count; a null score counts 0;
a parent that is unknown or in another conversation makes a message the start of a
tree; of a ring of replies the least id starts a tree; other columns are dropped; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.llm.common import HOT_SHARE, Scratch

# The template's control strings.
START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)
#: Characters from which on a piece is closed; rows from which on a key is looked at as hot.
PIECE, HOT_ROWS = 1 << 20, 10_000


def escaped(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: str) -> str:
    return escaped(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m.group(1) == "n" else m.group(1), unescaped(role))


def formatted(turns: list[tuple[str, str]]) -> tuple[str, list[int]]:
    """The template of turns, and start and end of each assistant text in it."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escaped_role(role)}\n", escaped(text)
        if role == "assistant":
            mask += [at + len(head), at + len(head) + len(body)]
        out += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(out), mask


def turns_of(output: str) -> list[tuple[str, str]]:
    """The turns of an output; what no template made is an error."""
    found, at = [], 0
    for m in TURN.finditer(output):
        if m.start() != at:
            break
        found.append((unescaped_role(m.group(1)), unescaped(m.group(2))))
        at = m.end()
    if at != len(output):
        raise ValueError(f"no turn at {at}")
    return found


class Reading:
    """Counts and digests of a path's pieces, read in order; holds no text."""

    def __init__(self) -> None:
        self.n_turns = self.loss_chars = self.formatted_chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def read(self, output: str, mask: list[int]) -> None:
        for role, text in turns_of(output):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n_turns += 1
        for a, b in zip(mask[::2], mask[1::2], strict=True):
            text = unescaped(output[a:b])
            self.loss.update(text.encode())
            self.loss_chars += len(text)
        self.formatted_chars += len(output)

    def facts(self) -> tuple:
        return self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.formatted_chars


FACTS = [T.StructField("n_turns", T.LongType()), T.StructField("turns_sha256", T.StringType()), T.StructField("loss_chars", T.LongType()), T.StructField("loss_sha256", T.StringType()), T.StructField("formatted_chars", T.LongType())]
_FACT_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def chained(rows: DataFrame, conv_col: str, order_col: str, tables: Scratch) -> DataFrame:
    """The tree, one chain for each conversation, in which each message replies to the one before it: n, up, conv, node, score.

    Messages of one order are one. Numbers follow a range partitioning, so they need
    no window; where a conversation crosses a border, its first message there gets
    its parent from the borders' numbers, a few for each partition.
    """
    ids = rows.select(F.col(conv_col).alias("conv"), F.col(order_col).alias("node")).distinct()
    order = [F.col("conv"), F.col("node").asc_nulls_last()]
    schema = T.StructType([*ids.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n", "up", "part"))])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = range((part << 33) + k, (part << 33) + k + batch.num_rows)
            ups = []
            for at, conv in zip(n, batch.column(0).to_pylist(), strict=True):
                ups.append(at - 1 if last == (conv,) else None)
                last = (conv,)
            k += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64()), pa.array(ups, pa.int64()), pa.array([part] * batch.num_rows, pa.int64())], names=schema.names)

    numbered = tables.written(ids.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, schema), "numbered")
    borders = numbered.groupBy("part").agg(F.min("n").alias("first"), F.max("n").alias("last"), F.min_by(F.struct("conv"), "n").alias("a"), F.max_by(F.struct("conv"), "n").alias("b")).orderBy("part").collect()
    over = [(r["first"], q["last"]) for q, r in zip(borders, borders[1:], strict=False) if q["b"] == r["a"]]
    found = numbered.withColumn("score", F.lit(0.0))
    if over:
        parents = F.broadcast(rows.sparkSession.createDataFrame(over, "n long, parent long"))
        found = found.join(parents, "n", "left").withColumn("up", F.coalesce("up", "parent"))
    return found.select("n", "up", "conv", "node", "score")


def replies(rows: DataFrame, conv_col: str, id_col: str, parent_col: str, score_col: str | None, tables: Scratch) -> DataFrame:
    """The tree that the parents' ids give: n, up, conv, node, score."""
    score = F.coalesce(F.col(score_col).cast("double"), F.lit(0.0)) if score_col else F.lit(0.0)
    ids = rows.select(F.col(conv_col).alias("conv"), F.col(id_col).alias("node"), F.col(parent_col).alias("parent"), score.alias("score"))
    ids = ids.groupBy("conv", "node").agg(F.min("parent").alias("parent"), F.min("score").alias("score"))
    order = [F.col("conv"), F.col("node").asc_nulls_last()]
    # sorted before they are numbered, so that the least number is the least id
    numbered = tables.written(ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("n", F.monotonically_increasing_id()), "numbered")
    joined = _joined(numbered, numbered.select(F.col("conv").alias("_conv"), F.col("node").alias("_node"), F.col("n").alias("up")), ["conv", "parent"], ["_conv", "_node"], numbered.count())
    return joined.select("n", F.when(F.col("up") != F.col("n"), F.col("up")).alias("up"), "conv", "node", "score")


def _joined(left: DataFrame, right: DataFrame, keys: list[str], others: list[str], n: int) -> DataFrame:
    """``left``, of which ``n`` rows have keys, with the columns of ``right``, which has each key once.

    Rows of hot keys, of which there are at most ``HOT_SHARE``, aren't shuffled: the
    rows of ``right`` that they meet are broadcast. A row without its last key has no
    partner; null conversations meet.
    """
    extra = [c for c in right.columns if c not in others]
    alike = lambda xs, ys: F.expr(" AND ".join(f"`{x}` <=> `{y}`" for x, y in zip(xs, ys, strict=True)))
    met = lambda a, b: a.join(b, alike(keys, others), "left").select(*left.columns, *extra)
    has = F.col(keys[-1]).isNotNull()
    absent = left.where(~has).select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in extra])
    left, right = left.where(has), right.where(F.col(others[-1]).isNotNull())
    least = max(n // HOT_SHARE, HOT_ROWS)
    hot = left.groupBy(*keys).agg(F.count("*").alias("_rows")).where(F.col("_rows") > least).select(*keys).collect() if n > least else []
    if not hot:
        return met(left, right).unionByName(absent)
    names = [f"_h{k}" for k in range(len(keys))]
    heads = F.broadcast(left.sparkSession.createDataFrame([tuple(h) for h in hot], left.select(*keys).schema).toDF(*names))
    few = F.broadcast(right.join(heads, alike(others, names), "left_semi"))
    return met(left.join(heads, alike(keys, names), "left_semi"), few).unionByName(met(left.join(heads, alike(keys, names), "left_anti"), right)).unionByName(absent)


def climbed(tree: DataFrame, tables: Scratch) -> tuple[DataFrame, list[tuple[DataFrame, int]]]:
    """(n, top, total, length) of every message; the jumps (_n, up) by 1, 2, 4 and so on, with their numbers."""
    edges = tables.written(tree.select("n", "up", F.col("score").alias("total")), "edges")
    n_nodes = edges.count()
    while True:
        now, jumps = edges.select("n", "up", F.col("n").alias("top"), F.coalesce("up", "n").alias("least"), "total", F.lit(1).cast("long").alias("length")), []
        while (n_up := now.where(F.col("up").isNotNull()).count()) and 1 << len(jumps) <= 2 * n_nodes:
            jumps.append((now.where(F.col("up").isNotNull()).select(F.col("n").alias("_n"), "up"), n_up))
            above = now.toDF(*[f"_{c}" for c in now.columns])
            sums = [(F.col(c) + F.coalesce(F.col(f"_{c}"), F.lit(0))).alias(c) for c in ("total", "length")]
            now = _joined(now, above, ["up"], ["_n"], n_up).select("n", F.col("_up").alias("up"), F.coalesce("_top", "top").alias("top"), F.least("least", F.coalesce("_least", "least")).alias("least"), *sums)
            now = tables.written(now, f"climb-{len(jumps)}")
        if not n_up:
            return now.select("n", "top", "total", "length"), jumps
        # what still climbs after more steps than there are messages is in a ring or above one
        cut = now.where(F.col("n") == F.col("least")).select(F.col("n").alias("_cut"))
        edges = tables.written(edges.join(cut, F.col("n") == F.col("_cut"), "left").select("n", F.when(F.col("_cut").isNull(), F.col("up")).alias("up"), "total"), "edges-cut")


def best_paths(tree: DataFrame, per_tree: int, tables: Scratch) -> DataFrame:
    """(path, rank, length, pos, conv, node) of each message of the best ``per_tree`` paths of each tree; pos is 1 at the root."""
    tree = tables.written(tree, "tree")
    ends, jumps = climbed(tree, tables)
    leaves = ends.join(jumps[0][0].select(F.col("up").alias("n")).distinct(), "n", "left_anti") if jumps else ends
    mean = (F.col("total") / F.col("length")).alias("mean")
    ranked = leaves.select("n", "top", mean, "length")
    if per_tree == 1:  # one row a tree, added up before the shuffle
        best = ranked.groupBy("top").agg(F.max(F.struct("mean", "length", (-F.col("n")).alias("least"))).alias("b")).select((-F.col("b.least")).alias("path"), F.lit(1).alias("rank"), F.col("b.length").alias("length"))
    else:
        by = Window.partitionBy("top").orderBy(F.desc("mean"), F.desc("length"), "n")
        best = ranked.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= per_tree).select(F.col("n").alias("path"), "rank", "length")
    steps = tables.written(best.withColumns({"n": F.col("path"), "back": F.lit(0).cast("long")}), "steps")
    n = steps.count()
    for k in reversed(range(len(jumps))):
        further = _joined(steps, jumps[k][0], ["n"], ["_n"], n)
        n = n if per_tree == 1 else 2 * n  # with one path a tree, no message is in two steps
        both = F.when(F.col("up").isNull(), F.array(F.struct("n", "back"))).otherwise(F.array(F.struct("n", "back"), F.struct(F.col("up").alias("n"), (F.col("back") + (1 << k)).alias("back"))))
        steps = tables.written(further.select("path", "rank", "length", F.explode(both).alias("s")).select("path", "rank", "length", "s.n", "s.back"), f"steps-{k}")
    return steps.select("path", "rank", "length", (F.col("length") - F.col("back")).alias("pos"), "n").join(tree.select("n", "conv", "node"), "n").drop("n")


def pieces(rows: DataFrame, chosen: DataFrame, conv: Column, node: Column, role: Column, text: Column, outputs: bool, piece: int = PIECE) -> DataFrame:
    """What stands in order of the chosen paths, as formatted pieces, or, where a piece is a whole path and no outputs are asked for, its facts alone.

    A row: conv, node (the first one's), path, rank, pos (the first one's), sub (order
    among pieces of a pos), whole, output, mask, and the facts of whole pieces.
    """
    own = rows.select(conv.alias("conv"), node.alias("node"), F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))
    own = own.withColumns({"tag": F.lit(1), "digest": F.unhex(F.md5("text")), "salt": F.monotonically_increasing_id()})
    marks = chosen.select("conv", "node", F.lit(0).alias("tag"), "path", "rank", "length", "pos")
    order = [F.col("conv"), F.col("node").asc_nulls_last(), *map(F.col, ("tag", "role", "digest", "salt"))]
    both = own.unionByName(marks, allowMissingColumns=True).repartitionByRange(*order).sortWithinPartitions(*order)
    number = lambda c: T.StructField(c, T.LongType())
    schema = T.StructType([both.schema["conv"], both.schema["node"], *map(number, ("path", "rank", "pos", "sub")), T.StructField("whole", T.BooleanType()), T.StructField("output", T.StringType()), T.StructField("mask", T.ArrayType(T.IntegerType())), *FACTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, waiting = TaskContext.get().partitionId(), 0, 0
        kinds: list[pa.DataType] = []
        ready: list[tuple] = []
        live: dict = {}  # by path, the piece that is open
        marks: list[_Mark] = []
        here = None

        def close(path, ended: bool) -> None:
            nonlocal made, waiting
            p = live.pop(path)
            m, whole = p.mark, ended and p.from_start and p.last == p.mark.length
            output, mask = formatted(p.turns)
            facts: tuple = (None,) * len(FACTS)
            if whole and not outputs:
                own = Reading()
                own.read(output, mask)
                facts, output, mask = own.facts(), None, None
            ready.append((*p.where, m.path, m.rank, m.pos, (part << 33) + made, whole, output, mask, *facts))
            made, waiting = made + 1, waiting + p.size

        for batch in batches:
            kinds = kinds or [batch.schema.field("conv").type, batch.schema.field("node").type, *[pa.int64()] * 4, pa.bool_(), pa.string(), pa.list_(pa.int32()), *_FACT_KINDS]
            for conv_, node_, tag, role_, text_, *mark in zip(*(batch.column(c).to_pylist() for c in _STREAM), strict=True):
                if here != (conv_, node_):
                    # at a partition's start a message's mark may be in the partition before; elsewhere a message without mark isn't chosen
                    marks, here = [_Mark()] if tag and here is None else [], (conv_, node_)
                if not tag:
                    marks.append(_Mark(*mark))
                    continue
                going_on = {m.path for m in marks}
                for path in [k for k in live if k not in going_on]:
                    close(path, True)
                for m in marks:
                    p = live.get(m.path)
                    if p is not None and m.pos is not None and p.last not in (m.pos, m.pos - 1):
                        close(m.path, True)
                        p = None
                    if p is None:
                        p = live[m.path] = _Piece(here, m, m.fresh and m.pos == 1)
                    m.fresh = False
                    p.add(m.pos, role_, text_)
                    if p.size >= piece:
                        close(m.path, False)
                if ready and (waiting >= piece or len(ready) >= 1000):
                    yield _batch(ready, kinds, schema.names)
                    ready, waiting = [], 0
        for path in list(live):
            close(path, False)
        if ready:
            yield _batch(ready, kinds, schema.names)

    return both.select(*_STREAM).mapInArrow(run, schema)


_STREAM = ("conv", "node", "tag", "role", "text", "path", "rank", "length", "pos")


def _batch(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


@dataclass
class _Mark:
    """A message's place on a path; without a path, one that isn't known here."""

    path: int | None = None
    rank: int | None = None
    length: int | None = None
    pos: int | None = None
    fresh: bool = True


@dataclass
class _Piece:
    where: tuple
    mark: _Mark
    from_start: bool
    last: int | None = None
    size: int = 0
    turns: list[tuple[str, str]] = field(default_factory=list)

    def add(self, pos: int | None, role: str, text: str) -> None:
        self.last = pos
        self.turns.append((role, text))
        self.size += len(text)


def in_order(found: DataFrame, chosen: DataFrame) -> DataFrame:
    """Pieces with the paths of those that a partition's border parted from their mark, as conv, path, rank, pos, sub, output, mask."""
    has = found.where(F.col("path").isNotNull()).select("conv", "path", "rank", "pos", "sub", "output", "mask")
    where = chosen.select(F.col("conv").alias("_conv"), F.col("node").alias("_node"), F.col("path").alias("_path"), F.col("rank").alias("_rank"), F.col("pos").alias("_pos"))
    lost = found.where(F.col("path").isNull()).join(where, F.expr("conv <=> _conv AND node <=> _node"))
    return has.unionByName(lost.select("conv", F.col("_path").alias("path"), F.col("_rank").alias("rank"), F.col("_pos").alias("pos"), "sub", "output", "mask"))


def read_back(parts: DataFrame) -> DataFrame:
    """(conv, path, rank, facts) of paths in pieces: each path's pieces are read in order, one held at a time."""
    schema = T.StructType([*(parts.schema[c] for c in ("conv", "path", "rank")), *FACTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own, ready, kinds = None, Reading(), [], []
        for batch in batches:
            kinds = kinds or [*(batch.schema.field(c).type for c in ("conv", "path", "rank")), *_FACT_KINDS]
            for k in range(batch.num_rows):
                conv, path, rank, output, mask = (batch.column(c)[k].as_py() for c in ("conv", "path", "rank", "output", "mask"))
                if now is not None and path != now[1]:
                    ready.append((*now, *own.facts()))
                    own = Reading()
                now = (conv, path, rank)
                own.read(output, mask)
            if ready:
                yield _batch(ready, kinds, schema.names)
                ready = []
        if now is not None:
            yield _batch([(*now, *own.facts())], kinds, schema.names)

    dealt = parts.repartition("path").sortWithinPartitions("path", "pos", "sub")
    return dealt.select("conv", "path", "rank", "output", "mask").mapInArrow(run, schema)


def _chosen(tree: DataFrame, per_tree: int, tables: Scratch) -> DataFrame:
    return tables.written(best_paths(tree, per_tree, tables), "chosen")


def _formatted(rows: DataFrame, chosen: DataFrame, columns: list[Column], outputs: bool, piece: int, tables: Scratch) -> DataFrame:
    found = pieces(rows, chosen, *columns, outputs=outputs, piece=piece)
    if outputs:
        return in_order(found, chosen)
    found = tables.written(found, "pieces")
    rest = read_back(in_order(found.where("not whole"), chosen))
    return found.where("whole").select(*rest.columns).unionByName(rest)


def format_chains(rows: DataFrame, outputs: bool = True, piece: int = PIECE, conv_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Each conversation's messages in order, every one a reply to the one before it, formatted.

    With ``outputs``: conv, path, rank, pos, sub, output, mask; a conversation is its
    path's outputs by pos and sub. Else conv, path, rank and what reading them back gives.
    """
    tables = Scratch(rows.sparkSession, "chat")
    chosen = _chosen(chained(rows, conv_col, order_col, tables), 1, tables)
    return _formatted(rows, chosen, [F.col(c) for c in (conv_col, order_col, role_col, text_col)], outputs, piece, tables)


def format_trees(
    rows: DataFrame, per_tree: int = 1, outputs: bool = True, piece: int = PIECE, conv_col: str = "conv_id", id_col: str = "message_id", parent_col: str = "parent_id", role_col: str = "role", text_col: str = "text", score_col: str | None = "score"
) -> DataFrame:
    """The best ``per_tree`` paths of each reply tree, formatted, as ``format_chains`` gives them."""
    tables = Scratch(rows.sparkSession, "chat")
    chosen = _chosen(replies(rows, conv_col, id_col, parent_col, score_col, tables), per_tree, tables)
    return _formatted(rows, chosen, [F.col(c) for c in (conv_col, id_col, role_col, text_col)], outputs, piece, tables)
