"""Operator 9: resharding by minimum-cost flow.

Old shard sizes and new capacities make a transport problem whose cost is the
bytes that leave their shard.  It is solved exactly; the flows are then met by
blocks: every old shard is cut into ``blocks`` hash blocks of whole groups of
equal texts, and groups too large to count as dust are blocks of their own.  What the driver holds depends
on the numbers of shards and blocks, never on the data.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

OLD, NEW, BLOCKS = 32, 40, 256
OVERHEAD = 16
#: The share of a mean shard up to which a group of equal texts stays whole, and the rows of a file.
WHOLE, PER_FILE = 0.25, 1_000_000


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> dict[tuple[int, int], int]:
    """Flows (i, j) that ship all supply within capacity at the least sum of flow * cost(i, j).

    Successive shortest paths with potentials over a bipartite graph; costs are
    not negative and the capacities hold the supply.
    """
    n, m = len(supply), len(capacity)
    source, sink = n + m, n + m + 1
    graph: list[list[list[int]]] = [[] for _ in range(n + m + 2)]  # to, left, cost, index of the reverse

    def arc(a: int, b: int, most: int, price: int) -> None:
        graph[a].append([b, most, price, len(graph[b])])
        graph[b].append([a, 0, -price, len(graph[a]) - 1])

    for i, s in enumerate(supply):
        arc(source, i, s, 0)
    for j, c in enumerate(capacity):
        arc(n + j, sink, c, 0)
    for i in range(n):
        for j in range(m):
            arc(i, n + j, min(supply[i], capacity[j]), cost(i, j))
    potential, left = [0] * len(graph), sum(supply)
    while left:
        far, back = [float("inf")] * len(graph), [None] * len(graph)
        far[source], heap = 0, [(0, source)]
        while heap:
            d, a = heapq.heappop(heap)
            if d > far[a]:
                continue
            for k, (b, most, price, _) in enumerate(graph[a]):
                if most and (new := d + price + potential[a] - potential[b]) < far[b]:
                    far[b], back[b] = new, (a, k)
                    heapq.heappush(heap, (new, b))
        if far[sink] == float("inf"):
            raise ValueError("the capacities don't hold the supply")
        potential = [p + (f if f < float("inf") else 0) for p, f in zip(potential, far)]
        push, b = left, sink
        while b != source:
            a, k = back[b]
            push, b = min(push, graph[a][k][1]), a
        b = sink
        while b != source:
            a, k = back[b]
            graph[a][k][1] -= push
            graph[b][graph[a][k][3]][1] += push
            b = a
        left -= push
    return {(i, e[0] - n): graph[e[0]][e[3]][1] for i in range(n) for e in graph[i] if n <= e[0] < n + m and graph[e[0]][e[3]][1]}


def plan(units: list[tuple], old: int, new: int) -> dict[tuple, int]:
    """``units`` of (old shard, key, bytes) to their new shard.

    Units first fill the flows of their old shard, the largest first; then, while
    the fullest shard can hand one to the emptiest and that evens them out, it does.
    """
    total = sum(u[2] for u in units)
    supply = [0] * old
    for o, _, b in units:
        supply[o] += b
    capacity = [total // new + (j < total % new) for j in range(new)]
    quota = defaultdict(dict)
    for (i, j), f in min_cost_flow(supply, capacity, lambda i, j: int(i != j)).items():
        quota[i][j] = f
    load, where = [0] * new, {}
    for o, key, b in sorted(units, key=lambda u: (-u[2], u[0], u[1])):
        open_to = quota[o]
        j = max(open_to, key=lambda k: (open_to[k], k == o, -k)) if open_to else min(range(new), key=load.__getitem__)
        if b > open_to.get(j, 0):  # no flow holds it whole: the emptiest shard takes it
            j = min([*open_to, min(range(new), key=load.__getitem__)], key=lambda k: (load[k], k != o, k))
        if j in open_to:
            open_to[j] -= b
        load[j] += b
        where[(o, key)] = j
    held = defaultdict(list)
    for o, key, b in units:
        held[where[(o, key)]].append((b, o, key))
    for x in held.values():
        x.sort()
    for _ in range(20 * new):
        hi, lo = max(range(new), key=load.__getitem__), min(range(new), key=load.__getitem__)
        gap = load[hi] - load[lo]
        fits = [u for u in held[hi] if 0 < u[0] < gap]
        if not fits:
            break
        u = min(fits, key=lambda x: abs(gap / 2 - x[0]))
        held[hi].remove(u)
        held[lo].append(u)
        load[hi] -= u[0]
        load[lo] += u[0]
        where[(u[1], u[2])] = lo
    return where


def group_of(text: Column) -> Column:
    """Equal texts are one group; a null text counts as empty."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def old_shard(group: Column, old: int = OLD) -> Column:
    """The layout before: shards by a hash of the group, so equal texts lie together."""
    return F.pmod(F.xxhash64(F.lit("old"), group), F.lit(old)).cast("int")


def reshard(docs: DataFrame, before: Column, old: int = OLD, new: int = NEW, blocks: int = BLOCKS, whole: float = WHOLE) -> DataFrame:
    """``(doc_id, size, text_crc32, law, old_shard, shard, slot, grown_shard)``, a row for each row of ``docs``.

    The law is ``bytes``: shard sizes near equal.  Equal texts of one old shard
    stay in one shard, unless they hold more than ``whole`` of a mean shard's
    bytes or rows; such a group is split by a hash of the id.  Null ids and
    null texts are placed like any other; repeated rows stay rows of their own.
    No rows give none.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit("")).cast("binary")
    sized = cut(
        docs.select(
            "doc_id",
            (F.octet_length(text) + OVERHEAD).cast("bigint").alias("size"),
            F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.crc32(text)).cast("bigint").alias("text_crc32"),
            before.alias("old_shard"),
            group_of(F.col("text")).alias("group"),
        )
    )
    sums = sized.agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).first()
    total, rows = sums["bytes"] or 0, sums["rows"]
    # groups over a 256th of a shard are units of their own: at most 256 * new by bytes, and as many by rows
    groups = sized.groupBy("old_shard", "group").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).where((F.col("bytes") > total / (new * 256)) | (F.col("rows") > max(rows / (new * 256), 256)))
    over = F.greatest(F.col("bytes") / F.lit(max(1, total) / new), F.col("rows") / F.lit(max(1, rows) / new))
    large = cut(groups.select("old_shard", "group", F.when(over > whole, F.ceil(over * 16)).otherwise(1).cast("int").alias("pieces")))
    marked = sized.join(F.broadcast(large), ["old_shard", "group"], "left")
    keyed = marked.select(
        "doc_id",
        "size",
        "text_crc32",
        "old_shard",
        F.col("pieces").isNotNull().alias("big"),
        F.when(F.col("pieces").isNull(), F.pmod(F.xxhash64(F.lit("block"), "group"), F.lit(blocks))).otherwise(F.col("group")).alias("unit"),
        F.when(F.col("pieces") > 1, F.pmod(F.xxhash64(F.lit("piece"), "doc_id"), F.col("pieces"))).otherwise(0).cast("int").alias("piece"),
    )
    keys = ["old_shard", "big", "unit", "piece"]
    found = keyed.groupBy(*keys).agg(F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()  # at most old * blocks + 528 * new units
    where = plan([(r["old_shard"], (r["big"], r["unit"], r["piece"]), r["bytes"]) for r in found], old, new)
    base, placed = [0] * new, []
    for r in sorted(found, key=lambda r: tuple(r[k] for k in keys)):
        j = where[(r["old_shard"], (r["big"], r["unit"], r["piece"]))]
        placed.append((r["old_shard"], r["big"], r["unit"], r["piece"], j, base[j]))
        base[j] += r["n"]
    table = spark.createDataFrame(placed, "old_shard int, big boolean, unit bigint, piece int, shard int, base bigint")
    in_unit = Window.partitionBy(*keys).orderBy("doc_id", "size", "text_crc32")
    return (
        keyed.withColumn("rank", F.row_number().over(in_unit))
        .join(F.broadcast(table), keys)
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "old_shard", "shard", (F.col("base") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def rewrite_affected(docs: DataFrame, placed: DataFrame, path: str) -> list[int]:
    """Write the shards whose rows change, one folder each (``shard=N``); the others' files stay as they are.

    Needs unique doc_ids, and ``docs`` must not be read from ``path``.  Shards
    that lose all their rows lose their folder.  Returns the shards affected.
    """
    spark = docs.sparkSession
    moved = placed.where("old_shard <> shard")
    touched = sorted({r[0] for r in moved.select(F.explode(F.array("old_shard", "shard")).alias("s")).distinct().collect()})
    into = placed.where(F.col("shard").isin(touched)).select("doc_id", "shard", "slot")
    rows = docs.join(into, "doc_id").repartition("shard", F.floor(F.col("slot") / PER_FILE)).sortWithinPartitions("shard", "slot")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("maxRecordsPerFile", PER_FILE).partitionBy("shard").parquet(path)
    empty = set(touched) - {r[0] for r in into.select("shard").distinct().collect()}
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for s in sorted(empty):
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/shard={s}")
        folder.getFileSystem(conf).delete(folder, True)
    return touched
