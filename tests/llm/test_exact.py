"""op11 against a plain version, with ties, repeated rows and nulls."""

import hashlib
import re

import pytest

from tests.llm.helpers import documents, long_text
from tickforge.llm import exact
from tickforge.llm.queries import queries


def plain(rows):
    """Per text without white space: size, id of the row that stays."""
    groups = {}
    for key, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), key is None, key or 0, key))
    return {text: (len(found), min(found)[3]) for text, found in groups.items()}


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    expected = plain(rows)
    found = {r.doc_id: r for r in queries()["op11_exact"](spark, sf_dir).collect()}
    assert len(found) == len(rows)
    for key, text in rows:
        bare = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        size, keep = expected[bare]
        assert tuple(found[key])[1:] == (keep, size, key == keep, hashlib.sha256(bare.encode()).hexdigest())


ROWS = [(5, "a b"), (4, "ab"), (3, "a  b"), (9, "a\tb "), (7, "a  b"), (1, None), (2, ""), (6, " \n\x0b\x0c\r"), (None, "x"), (None, "x"), (8, " y"), (8, " y"), (8, "y"), (10, "a\xa0b"), (11, long_text()), (12, long_text() + " ")]


@pytest.mark.parametrize("shuffled", [False, True])
def test_odd_rows(spark, monkeypatch, shuffled):
    if shuffled:  # a filter too large to broadcast, and generators that write one row a call
        monkeypatch.setattr(exact, "BROADCAST_WORDS", 0)
        monkeypatch.setattr(exact, "RUN", 1)
    docs = documents(spark, ROWS)
    expected = plain(ROWS)
    found = exact.exact_duplicates(docs).collect()
    by_id = {}
    for r in found:
        by_id.setdefault(r.id, []).append((r.keep_id, r.size, r.kept))
    assert len(found) == len(ROWS) and sum(r.kept for r in found) == len(expected)
    for key, text in ROWS:
        size, keep = expected[re.sub(r"[\x20\x09-\x0D]", "", text or "")]
        assert all(k == keep and n == size for k, n, _ in by_id[key])
    assert sorted(kept for _, _, kept in by_id[8]) == [False, False, True]
    assert sorted(kept for _, _, kept in by_id[None]) == [False, True]

    rows = exact.keep_one(docs)
    assert rows.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text) for r in rows.collect()) == sorted(
        [(0, "x"), (3, "a  b"), (6, " \n\x0b\x0c\r"), (8, " y"), (10, "a\xa0b"), (12, long_text() + " ")]
    )


def test_empty_table(spark):
    docs = documents(spark, [])
    assert exact.exact_duplicates(docs).count() == 0 and exact.keep_one(docs).count() == 0


def test_only_possible_repeats_shuffle(spark, sf_dir):
    """Rows that are alone come from the scan and a broadcast join, without Python and without an exchange."""
    alone, *_ = exact._candidates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    plan = alone._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hashpartitioning" not in plan
