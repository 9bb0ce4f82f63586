"""op13: the byte machine and the audit against plain versions."""

import random
import re
from itertools import permutations

import numpy as np
import pytest

from tests.llm.helpers import documents, long_text
from tickforge.llm import filter_audit, transducer
from tickforge.llm.queries import queries

SAMPLES = ["", " ", "a", "A b A", "é É x\x0b\x0cß \U0001f600", "x" * 30 + " " + "x" * 30 + "y", "$ # | %%", "\n\na\tb\r\n", "\x00 \x00a", "word " * 50]


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    return {
        "code_points": len(text), "capitals": len(re.findall("[A-Z]", text)), "symbols": len(re.findall(r"[#$%&*|]", text)),
        "words": len(words), "distinct_words": len(set(words)),
    }


def test_counts_of_samples():
    draw = random.Random(3)
    texts = SAMPLES + ["".join(draw.choice("aAb é　 \n#\U0001f600") for _ in range(draw.randrange(80))) for _ in range(300)]
    found = transducer.counts_of([t.encode() for t in texts])
    for i, text in enumerate(texts):
        assert {n: found[n][i] for n in transducer.NAMES} == plain_counts(text)


@pytest.mark.parametrize("size", [7, 64])
def test_long_texts_in_parts(monkeypatch, size):
    monkeypatch.setattr(transducer, "SLICE_BYTES", size)
    for text in [*SAMPLES, long_text(n=500), "a" * 300, "b" * 200 + " c " + "b" * 200]:
        assert transducer.counts_of_long(text.encode()) == plain_counts(text)


def test_equal_hashes_are_told_apart_by_their_bytes():
    texts = [b"one two one three two", b"two two one"]
    data, starts = transducer._joined(texts)
    _, begins, ends = transducer.run(data[:-8], starts)
    owners = np.searchsorted(starts, begins, "right") - 1
    first = transducer.first_of_their_kind(data, begins, ends - begins, owners, np.zeros(len(begins), np.uint64))
    assert np.bincount(owners[first]).tolist() == [3, 2]


def plain_audit(rows, labels):
    """{(part, order, step): counts} by applying each order to each document."""
    least = {}
    for key, text, part in rows:
        if key is not None:
            least[text or ""] = min(least.get(text or "", key), key)
    parts = {}
    for key, text, part in rows:
        c = plain_counts(text or "")
        fails = {
            "A": c["words"] < 200, "B": 100 * c["distinct_words"] < 50 * c["words"], "C": 100 * c["capitals"] > 2 * c["code_points"],
            "D": c["symbols"] > 0, "E": key is not None and key > least[text or ""],
        }
        parts.setdefault(part or "", []).append((fails, labels.get(key, (0, 0))))
    out = {}
    for part, docs in parts.items():
        removals = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = list(docs)
            for step, x in enumerate(order, 1):
                removed = [d for d in left if d[0][x]]
                left = [d for d in left if not d[0][x]]
                removals[x] += len(removed)
                failing = [d for d in docs if d[0][x]]
                out[part, order, step] = [
                    len(left), len(removed), len(failing) - len(removed), sum(sum(d[0].values()) == 1 for d in failing),
                    sum(d[1][0] == 1 for d in removed), sum(d[1][1] == 1 for d in removed), x,
                ]
        for key, value in out.items():
            if key[0] == part:
                value[-1] = removals[value[-1]]
    return {k: tuple(v) for k, v in out.items()}


NUMBERS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def found_audit(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[n] for n in NUMBERS) for r in rows}
    assert len(found) == len(rows)
    return found


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = {r.doc_id: (r.quality, r.toxic) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert found_audit(queries()["op13_filter_audit"](spark, sf_dir)) == plain_audit(rows, labels)


def test_odd_rows(spark):
    copies = "Same text # again"
    rows = [(3, copies, "s"), (2, copies, "t"), (2, copies, "s"), (None, copies, None), (5, None, ""), (6, "", None), (7, long_text(), "s"), (8, "A" * 9, "t"), (9, "x " * 300, "t")]
    docs = documents(spark, [(key, text, None, part) for key, text, part in rows])
    labels = spark.createDataFrame([(3, 1, 0), (3, None, 1), (8, 0, 1), (None, 1, 1), (6, 1, None)], "doc_id long, quality int, toxic int")
    failed = filter_audit.failures(docs)
    found = found_audit(filter_audit.audit(filter_audit.labelled(failed, labels)))
    assert found == plain_audit(rows, {3: (1, 1), 8: (0, 1), 6: (1, 0)})


def test_empty_table(spark):
    failed = filter_audit.failures(documents(spark, []))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.labelled(failed, labels)).count() == 0
