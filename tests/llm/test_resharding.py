"""op2: cheapest flows, equal bytes, gapless slots."""

import itertools
import random
import zlib

from pyspark.sql import functions as F

from tests.llm.helpers import documents, long_text, words
from tickforge.llm import resharding
from tickforge.llm.common import fresh_path
from tickforge.llm.queries import queries


def test_whole_table(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = queries()["op2_reshard"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(texts)
    assert all(r["size"] == len(texts[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in found)
    loads = [sum(r["size"] for r in found if r["shard"] == k) for k in range(16)]
    assert max(loads) - min(loads) < 0.05 * sum(loads) / 16
    for k in range(16):
        slots = sorted(r.slot for r in found if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_flow_moves_the_fewest_bytes():
    """Against all ways of small cases, and with prices other than one."""
    draw = random.Random(3)
    for _ in range(40):
        old, new = 3, 3
        supply = {i: draw.randrange(4) for i in range(old)}
        capacity = {j: draw.randrange(5) for j in range(new)}
        prices = {(i, j): draw.randrange(4) for i in range(old) for j in range(new)}
        if sum(supply.values()) > sum(capacity.values()):
            continue
        flow = resharding.min_cost_flow(supply, capacity, lambda i, j: prices[i, j])
        assert all(sum(n for (i, _), n in flow.items() if i == k) == supply[k] for k in supply)
        assert all(sum(n for (_, j), n in flow.items() if j == k) <= capacity[k] for k in capacity)
        units = [i for i, n in supply.items() for _ in range(n)]
        best = min(
            sum(prices[i, j] for i, j in zip(units, to))
            for to in itertools.product(range(new), repeat=len(units))
            if all(to.count(j) <= capacity[j] for j in capacity)
        )
        assert sum(prices[arc] * n for arc, n in flow.items()) == best


def test_what_fits_stays():
    flow = resharding.min_cost_flow({0: 100, 1: 20}, resharding.near_equal(120, 3))
    assert {(0, 0): 40, (1, 1): 20}.items() <= flow.items() and sum(n for (i, j), n in flow.items() if i != j) == 60


def _resharded(spark, docs, shards):
    old, new = fresh_path(spark, "old"), fresh_path(spark, "new")
    resharding.write_shards(docs, F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)), old)
    manifest = resharding.reshard(spark, old, new, docs.schema, shards)
    return resharding.read_resharded(spark, old, new, docs.schema, manifest, [F.col("row")])


def test_odd_rows(spark):
    rows = [(i, " ".join(words(i, 5 + i % 40))) for i in range(200)] + [(5, "same"), (5, "same"), (None, "x"), (6, None), (7, ""), (9, long_text())]
    docs = documents(spark, rows)
    found = _resharded(spark, docs, 4).collect()
    assert sorted((str(r.row.doc_id), r.row.text or "", r.row["shard"]) for r in found) == sorted((str(a), b or "", 7) for a, b in rows)
    for k in {r["shard"] for r in found}:
        slots = sorted(r.slot for r in found if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_empty_table(spark):
    assert _resharded(spark, documents(spark, []), 4).count() == 0
