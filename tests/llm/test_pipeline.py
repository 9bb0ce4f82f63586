"""The pipeline: each stage on what the one before kept, the whole against plain versions."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import documents, long_text
from tickforge.llm import decontaminate, simhash
from tickforge.llm.common import stored, table


def test_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    steps = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        steps[name] = docs = stored(stage(spark, docs, sf_dir), name)
        assert docs.columns == steps["documents"].columns and docs.count() > 0
    kept = {name: {r.doc_id: r for r in df.collect()} for name, df in steps.items()}
    names = list(kept)
    assert all(kept[b].keys() <= kept[a].keys() for a, b in zip(names, names[1:]))

    labels = {r.doc_id: r for r in table(spark, sf_dir, "labels").collect()}
    good = [k for k, r in labels.items() if r.quality and not r.toxic]
    assert np.mean([k in kept["quality_classifier"] for k in good]) > 0.95
    assert np.mean([k in kept["quality_classifier"] for k in labels if k not in good]) < 0.3

    assert kept["line_dedup"].keys() == kept["quality_classifier"].keys()
    assert all(r.n_chars == len(r.text) <= len(kept["documents"][k].text) for k, r in kept["line_dedup"].items())

    found = simhash.near_duplicates(steps["line_dedup"]).collect()
    assert {r.component for r in found} == kept["simhash_near_dedup"].keys()

    leaky = {r.id for r in decontaminate.contaminated(steps["simhash_near_dedup"], table(spark, sf_dir, "benchmark")).collect()}
    assert kept["benchmark_decontamination"].keys() == kept["simhash_near_dedup"].keys() - leaky

    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    packed = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    parts = sorted((p.doc_id, p.start, np.frombuffer(r.ids, "<u4")[p.offset : p.offset + p.length]) for r in packed for p in r.pieces)
    for doc_id, row in kept["benchmark_decontamination"].items():
        ids = np.concatenate([x for k, _, x in parts if k == doc_id])
        assert ids.tolist() == tokenizer.encode(row.text, add_special_tokens=False).ids + [2]
    assert {k for r in packed for k in r.doc_ids} == kept["benchmark_decontamination"].keys()


GOOD = "The council met on Tuesday to discuss the new library. It will open in spring, and the mayor thanked everyone who helped."


def odd_documents(spark):
    """Nulls in every column, empty and very long texts, repeated rows and ties, columns with names that stages use."""
    rows = [
        (1, GOOD, "en", "src0"), (2, GOOD, "en", "src0"), (2, GOOD, "en", "src0"), (3, None, "en", "src1"), (4, "", None, None), (4, None, "en", "src1"),
        (None, GOOD + " Again.", None, "src0"), (None, None, None, None), (5, " \n\t", "en", "src0"), (6, "\n".join([GOOD] * 3), "en", "src2"),
        (7, long_text(n=60_000), "en", "src0"), (8, "a\x00b <|endoftext|>", "xx", "src0"),
    ]
    return documents(spark, rows)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_each_stage_on_odd_rows(spark, sf_dir, name, stage):
    docs = odd_documents(spark)
    found = stage(spark, docs, sf_dir)
    assert found.columns == docs.columns
    given, kept = Counter(r.doc_id for r in docs.collect()), found.collect()
    assert not Counter(r.doc_id for r in kept) - given
    if name == "line_dedup":
        assert Counter(r.doc_id for r in kept) == given
        texts = Counter(r.text for r in kept)
        assert texts[GOOD] == 3 and texts[None] == 3 and texts["\n".join([GOOD] * 3)] == 1  # one line, or one chunk, is no repeat
    elif name == "simhash_near_dedup":
        # Equal texts, and those that hold no word, one each; of the rows with id 2 and 4 none is the first of its kind.
        assert sorted(r.doc_id for r in kept if r.doc_id is not None) == [1, 3, 6, 7, 8]
    else:
        assert name == "quality_classifier" or Counter(r.doc_id for r in kept) == given
    assert all(r.fp == docs.first().fp and r._key == docs.first()._key for r in kept)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_each_stage_on_an_empty_table(spark, sf_dir, name, stage):
    docs = documents(spark, [])
    found = stage(spark, docs, sf_dir)
    assert found.count() == 0 and (name == "packing" or found.columns == docs.columns)


def test_packing_on_odd_rows(spark, sf_dir):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    docs = odd_documents(spark)
    packed = corpus_pipeline.pack(spark, docs, sf_dir).collect()
    pieces = Counter()
    for r in packed:
        for p in r.pieces:
            pieces[p.doc_id] += p.length
    expected = Counter()
    for r in docs.collect():
        expected[r.doc_id] += len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1
    assert pieces == expected and all(len(r.ids) == 4 * 4096 for r in packed)
