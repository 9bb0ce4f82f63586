"""Chunks, vectors and search against plain loops."""

import hashlib
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tickforge.operators import text, vectors


def words_cut(body, most, overlap):
    words, step, out, at = body.split(), max(1, most - overlap), [], 0
    while words:
        out.append(" ".join(words[at : at + most]))
        if at + most >= len(words):
            return out
        at += step
    return out


SPACES = [" ", "\n", "\t", "  ", " ", " ", "　", "\x1c", "\x0b", "\x85", " "]


def body_of(rng, n):
    parts = [rng.choice(SPACES)] if rng.random() < 0.5 else []
    for i in range(n):
        parts += [rng.choice(["été", "a", "x.y", "日本", "z" * 9]) + str(i), rng.choice(SPACES)]
    return "".join(parts)


@pytest.mark.parametrize("most,overlap", [(220, 30), (7, 2), (5, 0), (4, 3), (3, 5), (1, 0)])
def test_chunks_equal_the_loop(spark, most, overlap):
    rng = random.Random(most)
    sizes = [0, 1, 2, most - 1, most, most + 1, 2 * most - overlap, 2 * most - overlap + 1, 431, 700]
    bodies = [(str(i), body_of(rng, max(0, n))) for i, n in enumerate(sizes)] + [("none", None), ("blank", " \n ")]
    df = spark.createDataFrame(bodies, "source_uri string, body string")
    found = {}
    for row in text.chunk_documents(df, max_words=most, overlap=overlap).orderBy("source_uri", "chunk_index").collect():
        found.setdefault(row["source_uri"], []).append(row["content"])
    expected = {uri: words_cut(body, most, overlap) for uri, body in bodies if body and body.split()}
    assert found == expected


def plain_vector(body):
    out = [0.0] * 384
    for token in re.findall(r"[A-Za-z0-9_.$:/-]+", body):
        digest = hashlib.sha256(token.lower().encode()).digest()
        out[int.from_bytes(digest[:4], "big") % 384] += 1.0 if digest[4] % 2 == 0 else -1.0
    norm = math.sqrt(sum(v * v for v in out))
    return [v / norm for v in out] if norm else out


BODIES = ["Stale symbol runbook", "", "été", "AAPL aapl MSFT a.b/c:d-e_f$ 12", "K kelvin K k İ I", "one two three " * 50]


def test_vectors_equal_the_loop(spark):
    df = spark.createDataFrame([(i, b) for i, b in enumerate(BODIES)] + [(9, None)], "id int, content string")
    rows = vectors.with_embedding(df).select("id", vectors.dense("embedding").alias("v")).orderBy("id").collect()
    for row, body in zip(rows, [*BODIES, ""]):
        assert row["v"] == pytest.approx(plain_vector(body), abs=1e-12)


def test_dot(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0]), ([1.0], [1.0, 2.0]), ([], [])], "a array<double>, b array<double>")
    assert [row[0] for row in df.select(vectors.dot("a", "b")).collect()] == [11.0, 0.0, 0.0]


@pytest.fixture
def evidence(spark):
    rows = [
        ("docs:a.md", 0, "A", "sequence gap runbook for AAPL"),
        ("docs:b.md", 0, "B", "sequence gap"),
        ("docs:b.md", 1, "B", "completely different words"),
        ("docs:c.md", 0, "C", "sequence gap"),
    ]
    return vectors.with_embedding(spark.createDataFrame(rows, "source_uri string, chunk_index int, title string, content string"))


def test_search_equals_the_loop(spark, evidence):
    query = "sequence gap"
    asked = spark.createDataFrame([("q", query)], "query_id string, query string")
    found = vectors.vector_topk(evidence, asked, limit=2).orderBy("result_rank").collect()
    assert [(row["source_uri"], row["score"]) for row in found] == [("docs:b.md", 1.0), ("docs:c.md", 1.0)]
    everything = vectors.vector_topk(evidence, asked, limit=10, min_score=None)
    expected = {
        (row["source_uri"], row["chunk_index"]): round(sum(a * b for a, b in zip(plain_vector(query), plain_vector(row["content"]))), 6)
        for row in evidence.collect()
    }
    assert {(r["source_uri"], r["chunk_index"]): r["score"] for r in everything.collect()} == {k: v for k, v in expected.items() if v}


def test_incident_summary(spark, evidence):
    rows = {row["incident_id"]: row for row in vectors.incident_summary(evidence, ["sequence gap", "zzz"]).collect()}
    assert rows["sequence gap"]["summary"].startswith("Most relevant evidence is from ")
    assert len(rows["sequence gap"]["timeline"]) == 3
    none = vectors.incident_summary(evidence.where("false"), ["x"]).first()
    assert none["summary"] == "No indexed evidence found for this incident." and none["sources"] == []


def test_upsert_replaces_by_uri_and_number(spark):
    schema = "source_uri string, chunk_index int, content string, indexed_at int"
    old = spark.createDataFrame([("a", 0, "x", 1), ("a", 1, "y", 1)], schema)
    new = spark.createDataFrame([("a", 1, "z", 1), ("b", 0, "w", 1)], schema)
    once = text.chunk_upsert(old, new)
    again = text.chunk_upsert(once, new)
    expected = [("a", 0, "x"), ("a", 1, "z"), ("b", 0, "w")]
    for df in (once, again):
        assert [tuple(row) for row in df.orderBy("source_uri", "chunk_index").select("source_uri", "chunk_index", "content").collect()] == expected


def test_front_matter_edges(spark):
    rows = [
        ("x/a.b.md", "---\ntitle: One\ntitle: Two: more\nother: 1\n---\nbody\n---\nrest"),
        ("t.md", "---\ntags: []\n---\nbody"),
        ("u.md", "text\n---\ntitle: no\n---\n"),
        ("v.md", '---\ntags: ["a b", c ,, "d"]\n---\n'),
    ]
    found = {row["source_uri"]: row for row in text.frontmatter(spark.createDataFrame(rows, "path string, content string"), "docs").collect()}
    assert (found["docs:x/a.b.md"]["title"], found["docs:x/a.b.md"]["body"]) == ("Two: more", "body\n---\nrest")
    assert (found["docs:t.md"]["title"], found["docs:t.md"]["tags"]) == ("t", [])
    assert found["docs:u.md"]["title"] == "u"
    assert found["docs:v.md"]["tags"] == ["a b", "c", "d"]


def test_tokens_are_lower_case(spark):
    df = spark.createDataFrame([("Ab-C été $X",)], "t string")
    assert df.select(vectors.tokens("t")).first()[0] == ["ab-c", "t", "$x"]
    assert df.select(F.size(vectors.tokens("t"))).first()[0] == 3


def test_postings_find_what_the_full_scan_finds(spark):
    """Short and long queries over texts with common and rare words; whole blocks are skipped."""
    from tickforge.plans import documents as given
    from tickforge.session import scratch_path
    from tickforge.sources.postings import PostingIndex
    from tests.helpers import rows_of

    chunks = vectors.with_embedding(given.note_chunks(spark, "/root/testdata/sf0.001")).persist()
    index = PostingIndex.save(chunks, scratch_path(spark, "postings"))
    body = chunks.orderBy("source_uri").first().content
    asked = [("rare", "runbook"), ("two", "the lineage"), ("part", " ".join(body.split()[:6])), ("whole", body), ("none", "zzzz qqqq"), ("empty", "")]
    queries = spark.createDataFrame(asked, "query_id string, query string")
    for limit in (1, 5, 40):
        assert rows_of(index.search(queries, limit)) == rows_of(vectors.vector_topk(chunks, queries, limit))
    slots = vectors.with_embedding(queries.where("query_id = 'part'"), "query").select("query_id", F.inline("embedding").alias("idx", "asked")).persist()
    needed, all_blocks = index.needed(slots, 1, 0.0).count(), index.blocks().join(slots, "idx").count()
    assert 0 < needed < all_blocks / 2
