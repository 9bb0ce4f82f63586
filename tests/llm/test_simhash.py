"""op1 against a brute-force version, with crowded blocks and odd rows."""

import random
import re

import xxhash

from tests.llm.helpers import documents, long_text, words
from tickforge.llm import simhash
from tickforge.llm.queries import queries


def plain_fingerprint(text):
    found = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([b" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(fingerprints):
    """{id: smallest id reachable}, ids without null."""
    left, out = sorted(fingerprints.items()), {}
    while left:
        root, group, rest = left[0][0], [left[0][1]], left[1:]
        members = [left[0][0]]
        while group:
            fp = group.pop()
            near = [x for x in rest if (x[1] ^ fp).bit_count() <= 2]
            group += [x[1] for x in near]
            members += [x[0] for x in near]
            rest = [x for x in rest if x not in near]
        out |= dict.fromkeys(members, root)
        left = rest
    return out


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    expected = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    roots = plain_components(expected)
    found = queries()["op1_simhash"](spark, sf_dir).collect()
    assert len(found) == len(rows)
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in found} == {k: (fp, roots[k]) for k, fp in expected.items()}


def test_crowded_blocks_give_the_same_components(spark):
    """A chain of many fingerprints that share blocks: by pairs and by meeting points."""
    draw, values = random.Random(5), {12345}
    while len(values) < 120:
        values.add(draw.choice(sorted(values)) ^ (1 << draw.randrange(24)) ^ (1 << draw.randrange(24)))
    values |= {draw.getrandbits(63) for _ in range(40)}
    expected = plain_components({v: v for v in values})
    classes = spark.createDataFrame([(v,) for v in values], "fp long")
    for limit in (2, 1000):
        roots = dict.fromkeys(values) | {r.node: r.root for r in simhash.connected_components(simhash.close_links(classes, limit)).collect()}
        assert {v: v if r is None else r for v, r in roots.items()} == expected


def test_odd_rows(spark):
    body = " ".join(words(1, 60))
    rows = [(7, body), (3, body), (3, body), (None, body), (9, None), (8, ""), (11, " \t\n"), (12, "one two"), (13, long_text()), (14, long_text())]
    found = simhash.near_duplicates(documents(spark, rows)).collect()
    assert len(found) == len(rows)
    component = {r.id: r.component for r in found}
    assert component == {7: 3, 3: 3, None: 3, 9: 8, 8: 8, 11: 8, 12: 12, 13: 13, 14: 13}
    assert {r.id: r.fp for r in found}[9] == 0
    assert plain_fingerprint(rows[-1][1]) == {r.id: r.fp for r in found}[14] % (1 << 64)
    kept = simhash.keep_one(documents(spark, rows))
    assert kept.columns == documents(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 8, 12, 13]


def test_empty_table(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.keep_one(documents(spark, [])).count() == 0
