"""Near-duplicate vectors by NN-descent: neighbour lists refined by neighbours of neighbours.

Equal vectors are one node with a size. Lists of LIST nodes start from groups that random
hyperplanes make; each round joins the members of every neighbourhood with one another and
keeps the nearest. A list whose members are all within the threshold is saturated: it may grow,
twice its length at a time, up to LONGEST_LIST. Lists still saturated are not trusted: every
component that holds one is compared in blocks, which gives exact link counts without writing
out pairs. AUDIT vectors with a known link and AUDIT of all vectors are compared with all others;
while fewer than RECALL of their links are known on average, new hyperplanes and more rounds
follow. If that has not helped after ATTEMPTS, all vectors are compared in blocks.

Candidates are ranked in single precision, links decided in double, by the same sum everywhere.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from tickforge.llm.common import connected_components, small_side, stored

THRESHOLD = 0.95
LIST = 10
LONGEST_LIST = 40
TREES = 8
LEAF = 64
ROUNDS = 8
STILL = 0.002
AUDIT = 512
RECALL = 0.99
ATTEMPTS = 4
BLOCK = 512
MARGIN = 1e-5
ROUNDING = 1e-9


def near_duplicates(vectors: DataFrame, id: str = "vec_id", embedding: str = "embedding", threshold: float = THRESHOLD) -> tuple[DataFrame, float]:
    """((id, n_links, component_id), recall of the audit).

    Vectors that are null, empty, zero or hold a null or a number that is not finite have no
    link and are their own component, as are rows with a null id, whose component is null.
    Vectors of different lengths are not linked. Repeated rows are vectors of their own.
    """
    rows = stored(_unit_vectors(vectors, id, embedding), "units")
    classes = rows.filter("unit is not null and id is not null").groupBy("unit").agg(F.min("id").alias("node"), F.count(F.lit(1)).alias("size"))
    nodes = stored(classes.select("node", "size", "unit", (F.length("unit") / 8).cast("int").alias("dim")), "nodes")
    total = nodes.count()
    lists, links, recall = None, None, 1.0
    for attempt in range(ATTEMPTS):
        lists = _descend(nodes, lists, total, attempt, threshold)
        links = stored(_verified(lists, nodes, threshold), "links")
        components = stored(connected_components(links), "components")
        counts = stored(_link_counts(nodes, lists, links, components, threshold), "link-counts")
        recall = _audit(nodes, counts, threshold)
        if recall >= RECALL:
            break
    else:
        found = stored(_by_blocks(nodes.select(F.col("dim").cast("long").alias("root"), "node", "size", "unit"), threshold), "all-blocks")
        counts = found.groupBy("node").agg(F.sum("links").alias("links"))
        components = stored(connected_components(found.select(F.col("node").alias("a"), F.col("lowest").alias("b"))), "components")
        recall = 1.0
    placed = nodes.select("node", "unit", "size").join(counts, "node", "left").join(components, "node", "left")
    linked = placed.select(
        "unit",
        (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"),
        F.coalesce("root", "node").alias("component_id"),
    )
    known = rows.filter("unit is not null and id is not null").join(linked, "unit").select("id", "n_links", "component_id")
    alone = rows.filter("unit is null or id is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return known.unionByName(alone), recall


def _unit_vectors(vectors: DataFrame, id: str, embedding: str) -> DataFrame:
    """(id, unit): vectors of length 1 as bytes of doubles; null where there is none."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for value in batch.column(1):
                v = np.array(value.as_py() or [], np.float64)  # a null inside becomes NaN
                norm = np.linalg.norm(v / np.abs(v).max()) if v.size and np.isfinite(v).all() and v.any() else 0.0
                out.append((v / np.abs(v).max() / norm).tobytes() if norm else None)
            yield pa.record_batch([batch.column(0), pa.array(out, pa.binary())], ["id", "unit"])

    return vectors.select(F.col(id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).mapInArrow(scale, "id long, unit binary")


def _matrix(units) -> np.ndarray:
    units = list(units)
    return np.frombuffer(b"".join(units), np.float64).reshape(len(units), -1) if units else np.zeros((0, 0))


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Row by row; the one sum that decides about links."""
    return np.einsum("id,id->i", x, y)


def _linked(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows of x and y are linked; a fast product decides where it is not near the threshold."""
    sims = x @ y.T
    near = sims >= threshold
    i, j = np.nonzero(np.abs(sims - threshold) < ROUNDING)
    near[i, j] = _cosines(x[i], y[j]) >= threshold
    return near


def _grown(nodes: DataFrame, total: int, attempt: int) -> DataFrame:
    """(u, v, sim): the nearest in groups of nodes on one side of the same hyperplanes; crowded groups are dealt out."""
    bits = max(1, int(np.ceil(np.log2(max(2, total / LEAF)))))

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            frame = batch.to_pandas()
            for dim, part in frame.groupby("dim"):
                if dim not in planes:
                    planes[dim] = np.random.default_rng([attempt, dim]).normal(size=(dim, TREES * bits))
                side = (_matrix(part["unit"]) @ planes[dim] > 0).reshape(len(part), TREES, bits)
                leaf = (side * (1 << np.arange(bits, dtype=np.int64))).sum(axis=2)
                unit = [u for u in part["unit"] for _ in range(TREES)]
                yield pa.record_batch(
                    [pa.array(np.repeat(part["node"].to_numpy(), TREES)), pa.array(np.repeat(part["dim"].to_numpy(), TREES)), pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(part))), pa.array(leaf.ravel()), pa.array(unit, pa.binary())],
                    ["node", "dim", "tree", "leaf", "unit"],
                )

    leaves = nodes.select("node", "dim", "unit").mapInArrow(sides, "node long, dim int, tree int, leaf long, unit binary")
    key = ["dim", "tree", "leaf"]
    sizes = leaves.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / (2 * LEAF)).cast("int").alias("parts"))
    dealt = leaves.join(small_side(sizes), key).withColumn("part", F.pmod(F.xxhash64("node", "tree", F.lit(attempt)), F.col("parts")))

    def nearest(group: pd.DataFrame) -> pd.DataFrame:
        x, ids = _matrix(group["unit"]), group["node"].to_numpy()
        sims = x @ x.T
        np.fill_diagonal(sims, -2)
        k = min(LIST, len(ids) - 1)
        if k < 1:
            return pd.DataFrame({"u": ids[:0], "v": ids[:0], "sim": sims[0, :0]})
        best = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        return pd.DataFrame({"u": np.repeat(ids, k), "v": ids[best.ravel()], "sim": np.take_along_axis(sims, best, axis=1).ravel()})

    return dealt.groupBy(*key, "part").applyInPandas(nearest, "u long, v long, sim double")


def _descend(nodes: DataFrame, lists: DataFrame | None, total: int, attempt: int, threshold: float) -> DataFrame:
    """(u, v, sim, fresh, room): each node's nearest known nodes, `room` at most."""
    found = _grown(nodes, total, attempt)
    lists = stored(_merged(lists, found, threshold), "lists")
    single = stored(nodes.select("node", "unit", "dim"), "vectors")
    for _ in range(ROUNDS):
        changed = lists.agg(F.count_if("fresh").alias("n")).first().n or 0
        if changed <= STILL * LIST * total:
            break
        lists = stored(_merged(lists, _joined(lists, single), threshold), "lists")
    return lists


def _merged(lists: DataFrame | None, found: DataFrame, threshold: float) -> DataFrame:
    """The lists with what was found; a saturated list gets twice the room."""
    both = found.select("u", "v", "sim", F.lit(True).alias("fresh"), F.lit(LIST).alias("room"))
    if lists is not None:
        full = (F.count(F.lit(1)).over(W.partitionBy("u")) >= F.col("room")) & (F.min("sim").over(W.partitionBy("u")) >= threshold - MARGIN)
        grown = F.when(full, F.least(F.col("room") * 2, F.lit(LONGEST_LIST))).otherwise(F.col("room"))
        both = both.unionByName(lists.select("u", "v", "sim", F.lit(False).alias("fresh"), grown.alias("room")))
    once = both.groupBy("u", "v").agg(F.max("sim").alias("sim"), F.bool_and("fresh").alias("fresh"), F.max("room").alias("room"))
    order = W.partitionBy("u").orderBy(F.desc("sim"), "v")
    roomy = once.withColumn("room", F.max("room").over(W.partitionBy("u"))).withColumn("place", F.row_number().over(order))
    return roomy.filter(F.col("place") <= F.col("room")).drop("place")


def _joined(lists: DataFrame, vectors: DataFrame) -> DataFrame:
    """(u, v, sim): pairs of members of one neighbourhood, of which one is new there, that enter u's list."""
    worst = lists.groupBy("u").agg(
        F.when(F.count(F.lit(1)) >= F.max("room"), F.min("sim")).otherwise(F.lit(-2.0)).alias("worst")
    )
    ahead = lists.select(F.col("u").alias("hub"), F.col("v").alias("node"), "fresh")
    turned = lists.select(F.col("v").alias("hub"), F.col("u").alias("node"), "fresh")
    shuffled = W.partitionBy("hub").orderBy(F.desc("fresh"), F.xxhash64("hub", "node"))
    back = turned.withColumn("n", F.row_number().over(shuffled)).filter(F.col("n") <= LIST).drop("n")
    members = ahead.unionByName(back).groupBy("hub", "node").agg(F.max("fresh").alias("fresh"))
    known = vectors.join(worst.withColumnRenamed("u", "node"), "node", "left").select("node", "unit", "dim", F.coalesce("worst", F.lit(-2.0)).alias("worst"))
    listed = F.collect_list(F.struct("node", "fresh", "worst", "unit")).alias("m")
    hubs = members.join(known, "node").groupBy("hub").agg(listed, F.max("fresh").alias("any"), F.max("dim").alias("dim"))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            for dim in np.unique(dims):
                lists = batch.column(0).filter(pa.array(dims == dim))
                for lo in range(0, len(lists), 500):
                    yield _nearer(lists.slice(lo, 500))

    return hubs.filter("any").select("m", "dim").mapInArrow(pairs, "u long, v long, sim double")


def _nearer(lists: pa.ListArray) -> pa.RecordBatch:
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten()
    node, fresh, worst = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
    x = _matrix(flat.field(3).to_pylist()).astype(np.float32)
    place = np.full((len(sizes), sizes.max(initial=0)), -1)
    place[np.arange(place.shape[1]) < sizes[:, None]] = np.arange(len(node))
    out = []
    for lo in range(0, len(place), 64):
        p = place[lo : lo + 64]
        block = x[p]
        sims = block @ block.transpose(0, 2, 1)
        there, new = p >= 0, fresh[p] & (p >= 0)
        wanted = there[:, :, None] & there[:, None, :] & (new[:, :, None] | new[:, None, :]) & (sims > worst[p][:, :, None])
        wanted[:, np.arange(p.shape[1]), np.arange(p.shape[1])] = False
        g, i, j = np.nonzero(wanted)
        out.append((node[p[g, i]], node[p[g, j]], sims[g, i, j].astype(np.float64)))
    columns = [np.concatenate(c) for c in zip(*out)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.record_batch([pa.array(c) for c in columns], ["u", "v", "sim"])


def _verified(lists: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(a, b), a < b: pairs of the lists whose cosine in double precision reaches the threshold."""
    near = lists.filter(F.col("sim") >= threshold - MARGIN).select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    left = nodes.select(F.col("node").alias("a"), F.col("unit").alias("x"))
    right = nodes.select(F.col("node").alias("b"), F.col("unit").alias("y"))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            lengths = pc.binary_length(batch.column(2)).to_numpy()
            for length in np.unique(lengths):
                own = pa.array(lengths == length)
                keep[lengths == length] = _cosines(*(_matrix(batch.column(i).filter(own).to_pylist()) for i in (2, 3))) >= threshold
            yield batch.select([0, 1]).filter(pa.array(keep))

    return near.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long")


def _link_counts(nodes: DataFrame, lists: DataFrame, links: DataFrame, components: DataFrame, threshold: float) -> DataFrame:
    """(node, links): linked rows of other nodes; in components with a saturated list by blocks, else from the links."""
    sizes = nodes.select("node", "size")
    full = lists.groupBy("u").agg(F.count(F.lit(1)).alias("n"), F.max("room").alias("room"), F.min("sim").alias("sim"))
    saturated = full.filter((F.col("n") >= F.col("room")) & (F.col("sim") >= threshold - MARGIN)).select(F.col("u").alias("node"))
    dense = small_side(stored(saturated.join(components, "node").select("root").distinct(), "dense"))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    sparse = both.join(components.join(dense, "root", "left_anti"), "node").join(sizes.withColumnRenamed("node", "other"), "other")
    counted = sparse.groupBy("node").agg(F.sum("size").alias("links"))
    members = components.join(dense, "root").join(nodes.select("node", "size", "unit"), "node")
    blocks = _by_blocks(members, threshold)
    return counted.unionByName(blocks.groupBy("node").agg(F.sum("links").alias("links")))


def _by_blocks(members: DataFrame, threshold: float) -> DataFrame:
    """(node, links, lowest): from rows (root, node, size, unit) the linked rows of each node with the same root.

    Members are dealt into blocks of about BLOCK, each pair of blocks is compared in a task, and a
    node comes out once per pair; `lowest` is the smallest node that its links reach in there.
    """
    parts = small_side(stored(members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts")), "parts"))
    dealt = members.join(parts, "root").withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, parts - 1)")))
    keyed = dealt.select("root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "size", "unit")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        first = (group["own"] == group["lo"].iloc[0]).to_numpy()
        one, two = (group, group) if group["lo"].iloc[0] == group["hi"].iloc[0] else (group[first], group[~first])
        near = _linked(_matrix(one["unit"]), _matrix(two["unit"]), threshold) if len(one) and len(two) else np.zeros((len(one), len(two)), bool)
        a, b = one["node"].to_numpy(), two["node"].to_numpy()
        near &= a[:, None] != b[None, :]
        low_a, low_b, before = a, b, None
        while before is None or (low_a != before).any():  # the smallest node that links reach
            before, far = low_a, np.iinfo(np.int64).max
            low_b = np.minimum(low_b, np.where(near, low_a[:, None], far).min(axis=0, initial=far))
            low_a = np.minimum(low_a, np.where(near, low_b[None, :], far).min(axis=1, initial=far))
        found = pd.DataFrame({"node": a, "links": near @ two["size"].to_numpy(), "lowest": low_a})
        if one is two:
            return found
        return pd.concat([found, pd.DataFrame({"node": b, "links": near.T @ one["size"].to_numpy(), "lowest": low_b})])

    return keyed.groupBy("root", "lo", "hi").applyInPandas(compare, "node long, links long, lowest long")


def _audit(nodes: DataFrame, counts: DataFrame, threshold: float) -> float:
    """The mean share of a sampled node's links that are known, over sampled nodes that have any.

    Half of the sample has known links, so that it says something where links are rare; the other
    half is drawn from all nodes, so that nodes whose links are all unknown are seen too. Without
    any link in the sample it is 1.
    """
    def drawn(df: DataFrame) -> DataFrame:
        return df.orderBy(F.xxhash64("node"), "node").limit(AUDIT).select("node", "unit", "dim")

    linked = nodes.join(counts.filter("links > 0").select("node"), "node", "left_semi")
    sample = drawn(nodes).unionByName(drawn(linked)).dropDuplicates(["node"]).toPandas()
    by_dim = {dim: (part["node"].to_numpy(), _matrix(part["unit"])) for dim, part in sample.groupby("dim")}

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part in batch.to_pandas().groupby("dim"):
                if dim in by_dim:
                    ids, x = by_dim[dim]
                    near = _linked(x, _matrix(part["unit"]), threshold) & (ids[:, None] != part["node"].to_numpy())
                    links = near @ part["size"].to_numpy()
                    yield pa.record_batch([pa.array(ids[links > 0]), pa.array(links[links > 0])], ["node", "exact"])

    exact = nodes.select("node", "size", "unit", "dim").mapInArrow(compare, "node long, exact long").groupBy("node").agg(F.sum("exact").alias("exact"))
    row = exact.join(counts, "node", "left").agg(F.avg(F.least(F.coalesce("links", F.lit(0)) / F.col("exact"), F.lit(1.0))).alias("recall")).first()
    return 1.0 if row.recall is None else row.recall
