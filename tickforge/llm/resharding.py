"""Moving a sharded table to new capacities with the fewest bytes moved.

A sharded table is a folder of Parquet files under shard=k; a file is a block. The sizes of
the old shards and the capacities of the new ones make a flow problem in which a byte that
stays costs 0 and one that moves costs 1. Its solution says how many bytes each old shard
gives to each new one. Whole files are handed over as they are while they fit; the few that
do not are rewritten row by row. A manifest lists the files of every new shard.

The driver sees one number per shard. Files are dealt out per old shard, and rows of split
files per old shard, that is of at most as many files as there are new shards.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from tickforge.llm.common import small_side, stored

Flows = dict[tuple[int, int], int]


def min_cost_flow(supply: dict[int, int], capacity: dict[int, int], cost=lambda old, new: int(old != new)) -> Flows:
    """Bytes from each old to each new shard, at the lowest total cost.

    Successive cheapest augmenting paths with node potentials; costs are not negative and the
    capacities must hold all of the supply.
    """
    if sum(supply.values()) > sum(capacity.values()):
        raise ValueError("the new shards are too small")
    old, new = sorted(supply), sorted(capacity)
    left, room, flow = dict(supply), dict(capacity), {}
    potential = {("old", i): 0 for i in old} | {("new", j): 0 for j in new}
    while any(left.values()):
        distance = {("old", i): 0 - potential["old", i] for i in old if left[i]}
        floor = min(distance.values())
        distance = {node: d - floor for node, d in distance.items()}
        queue, came, done = [(d, node) for node, d in distance.items()], {}, set()
        heapq.heapify(queue)
        while queue:
            d, node = heapq.heappop(queue)
            if node in done:
                continue
            done.add(node)
            kind, k = node
            steps = [(("new", j), cost(k, j)) for j in new] if kind == "old" else [(("old", i), -cost(i, k)) for i in old if flow.get((i, k))]
            for to, price in steps:
                reduced = d + price + potential[node] - potential[to]
                if to not in distance or reduced < distance[to]:
                    distance[to], came[to] = reduced, node
                    heapq.heappush(queue, (reduced, to))
        end = min((n for n in distance if n[0] == "new" and room[n[1]]), key=lambda n: (distance[n] + potential[n], n[1]))
        path, node = [], end
        while node in came:
            path.append((came[node], node))
            node = came[node]
        amount = min([left[node[1]], room[end[1]], *(flow[b[1], a[1]] for a, b in path if a[0] == "new")])
        for a, b in path:
            arc, sign = ((a[1], b[1]), 1) if a[0] == "old" else ((b[1], a[1]), -1)
            flow[arc] = flow.get(arc, 0) + sign * amount
        left[node[1]] -= amount
        room[end[1]] -= amount
        most = max(distance.values())
        for n in potential:
            potential[n] += distance.get(n, most)
    return {arc: n for arc, n in flow.items() if n}


def row_bytes(text: Column) -> Column:
    """UTF-8 bytes of the text, none for null, and one for its end."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def write_shards(docs: DataFrame, shard: Column, path: str) -> None:
    """Write `docs` as a sharded table; each row lies whole in `row`, so that no column can clash."""
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("row"), shard.cast("int").alias("shard"))
    rows.write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_files(spark: SparkSession, path: str, row_schema) -> DataFrame:
    """(row, shard, file, row_index) of a sharded table."""
    files = spark.read.schema(f"row {row_schema.simpleString()}, shard int").parquet(path)
    return files.select("row", "shard", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row_index"))


def near_equal(total: int, shards: int) -> dict[int, int]:
    return {k: total // shards + (k < total % shards) for k in range(shards)}


def reshard(spark: SparkSession, old_path: str, new_path: str, row_schema, shards: int, text: str = "text") -> DataFrame:
    """The manifest (shard, file, rows, before) of `shards` shards of near equal bytes.

    Files of split blocks are rewritten under `new_path`; all others stay where they are.
    `before` is the number of rows in the shard's earlier files. Null texts count one byte;
    repeated rows are rows of their own; an empty table has an empty manifest.
    """
    rows = read_files(spark, old_path, row_schema).withColumn("size", row_bytes(F.col("row")[text]))
    files = stored(rows.groupBy("shard", "file").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")), "shard-files")
    supply = {r.shard: r.bytes for r in files.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()}
    flow = min_cost_flow(supply, near_equal(sum(supply.values()), shards))

    dealt = stored(files.groupBy("shard").applyInPandas(_deal_files(flow), "shard int, file string, target int, bytes long, rows long"), "dealt-files")
    whole = dealt.filter("target is not null and file is not null")
    split = dealt.filter("target is null").select("file")
    spare = dealt.filter("file is null").select("shard", "target", "bytes")
    loose = rows.join(small_side(split), "file").select("shard", "file", "row_index", "size")
    targets = loose.groupBy("shard").cogroup(spare.groupBy("shard")).applyInPandas(_deal_rows, "file string, row_index long, target int")
    targets = stored(targets, "dealt-rows")
    moved = rows.join(small_side(targets), ["file", "row_index"]).select("row", F.col("target").alias("shard"))
    moved.write.partitionBy("shard").option("compression", "zstd").parquet(new_path)

    rewritten = read_files(spark, new_path, row_schema).groupBy("shard", "file").agg(F.count(F.lit(1)).alias("rows"))
    listed = whole.select(F.col("target").alias("shard"), "file", "rows").unionByName(rewritten)
    earlier = W.partitionBy("shard").orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    return stored(listed.withColumn("before", F.coalesce(F.sum("rows").over(earlier), F.lit(0))), "manifest")


def read_resharded(spark: SparkSession, old_path: str, new_path: str, row_schema, manifest: DataFrame, columns: list[Column]) -> DataFrame:
    """`columns` of each row, with its `shard` and its `slot` there, read from the files that the manifest lists."""
    both = read_files(spark, old_path, row_schema).unionByName(read_files(spark, new_path, row_schema))
    listed = small_side(manifest.select(F.col("shard"), "file", "before"))
    found = both.select(*columns, "file", "row_index").join(listed, "file")
    return found.withColumn("slot", F.col("before") + F.col("row_index")).drop("file", "row_index", "before")


def _deal_files(flow: Flows):
    """Largest file first, each to the target with the most bytes left if it fits there, else split.

    The shard itself comes first among its targets. Rows without a file give the bytes left over.
    """

    def deal(files: pd.DataFrame) -> pd.DataFrame:
        shard = int(files["shard"].iloc[0])
        left = {new: n for (old, new), n in flow.items() if old == shard}
        out = []
        for row in files.sort_values(["bytes", "file"], ascending=[False, True]).itertuples():
            fits = [t for t in left if left[t] >= row.bytes]
            target = max(fits, key=lambda t: (t == shard, left[t], -t)) if fits else None
            if fits:
                left[target] -= row.bytes
            out.append((shard, row.file, target, row.bytes, row.rows))
        out += [(shard, None, t, n, 0) for t, n in left.items() if n]
        frame = pd.DataFrame(out, columns=["shard", "file", "target", "bytes", "rows"])
        return frame.astype({"target": "Int32"})

    return deal


def _deal_rows(rows: pd.DataFrame, spare: pd.DataFrame) -> pd.DataFrame:
    """Largest row first, each to the target with the most bytes left."""
    heap = [(-int(n), int(t)) for t, n in zip(spare["target"], spare["bytes"])]
    heapq.heapify(heap)
    ordered = rows.sort_values(["size", "file", "row_index"], ascending=[False, True, True])
    targets = []
    for size in ordered["size"]:
        left, target = heap[0]
        heapq.heapreplace(heap, (left + int(size), target))
        targets.append(target)
    return pd.DataFrame({"file": ordered["file"], "row_index": ordered["row_index"], "target": targets})
