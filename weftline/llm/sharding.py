"""Resharding by minimum-cost flow.

From the bytes in the old shards and the capacities of the new ones, a flow moves
the fewest bytes: what stays in its shard costs nothing, what moves costs its size.
The flow sees shards alone, a few dozen numbers. Each old shard's rows lie on a byte
axis, block after block; the flow cuts that axis into one interval that stays and
intervals that move, and a row follows the interval that its middle byte lies in.
``rewrite`` then writes the shards that gained or lost rows.

Equal texts stay together. Those of an old shard lie next to each other on the axis
and follow the interval of the middle of all of them. A group with over 1 /
``GROUP_SHARE`` of a new shard's bytes would make shards unequal that way, so such
groups are placed first, each whole: where it lies if there is room, else where most
room is; the flow then has the capacities that are left. Only a group that fits in no
shard has its rows spread one by one.

Defined cases: a null text has no bytes and is the empty text; every row has 8 bytes
besides its text, so empty ones spread too; rows that repeat are equal texts; an
empty table gives no rows; other columns are kept by ``rewrite``, but for
those that bear the names of the operator's own (``OWN``), which are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.common import fresh_path

#: Bytes that a block should have, and blocks that an old shard has at least.
BLOCK_BYTES, LEAST_BLOCKS = 32 << 20, 16
#: A group of equal texts beyond this part of a new shard's bytes is placed by itself, so there are at most so many a shard.
GROUP_SHARE = 64
OWN = ("_group", "_placed", "_pos", "_weight", "_first", "_last", "_size", "_old", "_spread", "_block", "_row", "_upto", "_from", "_shard", "_slot", "_bytes", "_n", "_least", "_base")


def cheapest_moves(old: list[int], capacities: list[int]) -> list[list[int]]:
    """moves[i][j]: bytes of old shard i that go to new shard j, the fewest with i != j.

    Successive shortest paths on the bipartite graph of shards; capacities must
    hold all bytes.
    """
    if sum(old) > sum(capacities):
        raise ValueError("the capacities can't hold the shards")
    a, b = len(old), len(capacities)
    source, sink = a + b, a + b + 1
    graph: list[list[list[int]]] = [[] for _ in range(a + b + 2)]  # to, room, cost, index of the reverse edge

    def edge(u: int, v: int, room: int, cost: int) -> None:
        graph[u].append([v, room, cost, len(graph[v])])
        graph[v].append([u, 0, -cost, len(graph[u]) - 1])

    for i, size in enumerate(old):
        edge(source, i, size, 0)
        for j in range(b):
            edge(i, a + j, size, int(i != j))
    for j, room in enumerate(capacities):
        edge(a + j, sink, room, 0)
    while True:
        cost, via = {source: 0}, {}
        queue = [source]
        for u in queue:  # label-correcting; costs are small integers
            for k, (v, room, c, _) in enumerate(graph[u]):
                if room and cost[u] + c < cost.get(v, 1 << 60):
                    cost[v], via[v] = cost[u] + c, (u, k)
                    queue.append(v)
        if sink not in cost:
            break
        path, v = [], sink
        while v != source:
            path.append(via[v])
            v = via[v][0]
        flow = min(graph[u][k][1] for u, k in path)
        for u, k in path:
            graph[u][k][1] -= flow
            graph[graph[u][k][0]][graph[u][k][3]][1] += flow
    return [[old[i] - e[1] if i != -1 and old[i] else 0 for e in graph[i] if a <= e[0] < a + b] for i in range(a)]


def intervals(moves: list[list[int]]) -> dict[int, list[tuple[int, int]]]:
    """By old shard: (end on its byte axis, new shard), what stays first."""
    out = {}
    for i, row in enumerate(moves):
        at, cuts = 0, []
        for j in sorted(range(len(row)), key=lambda j: (j != i, j)):
            if row[j]:
                at += row[j]
                cuts.append((at, j))
        out[i] = cuts or [(0, i if i < len(row) else 0)]
    return out


def placed_groups(groups: list[tuple[int, dict[int, int]]], capacities: list[int]) -> tuple[dict[int, int], list[int]]:
    """The shard of each group that fits one, and the capacities left; a group is its number and its bytes by old shard."""
    room, out = list(capacities), {}
    for number, held in sorted(groups, key=lambda g: (-sum(g[1].values()), g[0])):
        size = sum(held.values())
        fits = [j for j in range(len(room)) if room[j] >= size]
        if fits:
            out[number] = max(fits, key=lambda j: (held.get(j, 0), room[j], -j))
            room[out[number]] -= size
    return out, room


def _target(cuts: dict[int, list[tuple[int, int]]], shard: Column, middle: Column) -> Column:
    """The new shard by old shard and middle byte: a few hundred literals at most."""
    out = None
    for i, own in cuts.items():
        inner = F.lit(own[-1][1])
        for end, j in reversed(own[:-1]):
            inner = F.when(middle < F.lit(2 * end), F.lit(j)).otherwise(inner)
        out = F.when(shard == i, inner) if out is None else out.when(shard == i, inner)
    return out


def reshard(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, id_col: str = "doc_id", text_col: str = "text", capacities: list[int] | None = None) -> tuple[DataFrame, list[list[int]]]:
    """All columns with _size, _old, _block, _row (within the block) and _shard, and the moves in bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    docs = docs.drop(*OWN).withColumn("_pos", F.monotonically_increasing_id())  # tells rows that are equal apart
    sized = docs.withColumns({"_size": F.octet_length(text).cast("long") + 8, "_old": old_shard.cast("int"), "_group": F.xxhash64(text)})
    totals = {r["_old"]: r["bytes"] for r in sized.groupBy("_old").agg(F.sum("_size").alias("bytes")).collect()}
    old = [totals.get(i, 0) for i in range(n_old)]
    capacities = capacities or [-(-sum(old) // n_new)] * n_new
    # fewer than n_new * GROUP_SHARE groups, each with its bytes in the old shards that hold it
    least = sum(old) / (n_new * GROUP_SHARE)
    counts = sized.groupBy("_group", "_old").agg(F.sum("_size").alias("_n")).groupBy("_group").agg(F.sum("_n").alias("_n"), F.map_from_entries(F.collect_list(F.struct("_old", "_n"))).alias("held"))
    large = [(r["_group"], r["held"]) for r in counts.where(F.col("_n") > least).collect()]
    place, room = placed_groups(large, capacities)
    rest = list(old)
    for number in place:
        for i, n in dict(large)[number].items():
            rest[i] -= n
    moves = cheapest_moves(rest, room)
    cuts = intervals(moves)
    for number, j in place.items():
        for i, n in dict(large)[number].items():
            moves[i][j] += n
    n_blocks = max(LEAST_BLOCKS, -(-max(old, default=0) // BLOCK_BYTES))
    known = docs.sparkSession.createDataFrame([(g, place.get(g, -1)) for g, _ in large], "_group long, _placed int")
    sized = sized.join(F.broadcast(known), "_group", "left")
    alone = F.xxhash64(F.col(id_col), F.col("_group"), F.col("_pos"))
    sized = sized.withColumn("_spread", F.when(F.col("_placed").isNotNull(), alone).otherwise(F.col("_group"))).withColumn("_block", F.pmod("_spread", F.lit(n_blocks)).cast("int"))
    # what is placed has blocks of its own, in which a shard's rows lie together
    sized = sized.withColumn("_block", F.when(F.col("_placed") >= 0, F.col("_block") + n_blocks).otherwise(F.col("_block")))
    sized = sized.withColumn("_weight", F.when(F.col("_placed") >= 0, 0).otherwise(F.col("_size"))).drop("_group")  # what is placed isn't on the axis
    blocks = sized.groupBy("_old", "_block").agg(F.sum("_weight").alias("_bytes"))
    along = Window.partitionBy("_old").orderBy("_block")  # a row for each block
    blocks = blocks.select("_old", "_block", (F.sum("_bytes").over(along) - F.col("_bytes")).alias("_from"))
    inside = Window.partitionBy("_old", "_block").orderBy(F.greatest("_placed", F.lit(-1)), "_spread", "_size", "_pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = sized.withColumns({"_upto": F.sum("_weight").over(inside), "_row": F.row_number().over(inside)})
    together = Window.partitionBy("_old", "_block", "_spread")
    rows = rows.withColumns({"_first": F.min(F.col("_upto") - F.col("_weight")).over(together), "_last": F.max("_upto").over(together)}).join(blocks, ["_old", "_block"])
    twice = 2 * F.col("_from") + F.col("_first") + F.col("_last")
    shard = F.when(F.col("_placed") >= 0, F.col("_placed")).otherwise(_target(cuts, F.col("_old"), twice)).cast("int")
    return rows.withColumn("_shard", shard).drop("_upto", "_from", "_spread", "_first", "_last", "_placed", "_pos", "_weight"), moves


def rewrite(rows: DataFrame, path: str, moves: list[list[int]], all_shards: bool = False) -> DataFrame:
    """Write the rows of the shards that gain or lose bytes to ``path/_shard=N`` and read them back.

    With ``all_shards`` the others are written too, as where the old shards aren't
    folders yet. Each task writes to the shards that its blocks have rows of.
    """
    n_new = len(moves[0]) if moves else 0
    changed = [j for j in range(n_new) if any(row[j] for i, row in enumerate(moves) if i != j) or (j < len(moves) and sum(moves[j]) != moves[j][j])]
    kept = rows if all_shards else rows.where(F.col("_shard").isin(changed))
    kept.write.partitionBy("_shard").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(kept.schema).parquet(path)


def slots(rows: DataFrame) -> DataFrame:
    """Rows with _slot, gapless from 0 in each shard, from counts by block; no shard is sorted as a whole."""
    counts = rows.groupBy("_shard", "_old", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_least"))
    along = Window.partitionBy("_shard").orderBy("_old", "_block")  # a row for each block and shard
    counts = counts.select("_shard", "_old", "_block", "_least", (F.sum("_n").over(along) - F.col("_n")).alias("_base"))
    return rows.join(counts, ["_shard", "_old", "_block"]).withColumn("_slot", (F.col("_base") + F.col("_row") - F.col("_least")).cast("long")).drop("_base", "_least")


def reshard_to_files(docs: DataFrame, old_shard: Column, n_old: int, n_new: int, path: str | None = None, **names: str) -> DataFrame:
    """``reshard``, ``rewrite`` of every shard and ``slots`` over what was written."""
    rows, moves = reshard(docs, old_shard, n_old, n_new, **names)
    return slots(rewrite(rows, path or fresh_path(docs.sparkSession, "shards"), moves, all_shards=True))
