"""op6: held-out accuracy, the backoff, odd rows."""

import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tests.llm.helpers import documents, long_text
from tickforge.llm import langid
from tickforge.llm.queries import queries


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    found = queries()["op6_language"](spark, folder).collect()
    assert sorted(r.doc_id for r in found) == sorted(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in found)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in found if r.held_out]) > 0.98


def test_counts_against_plain_counting(spark):
    rows = [(1, "Der Hund der", "de"), (2, "the dog the the", "en"), (3, "das", None), (4, None, "de"), (5, "12 %", "en")]
    model = langid.learn(documents(spark, rows))
    assert model.languages == ["de", "en"]
    assert model.words.keys() == {"der", "hund", "the", "dog"}
    total = {"de": 3, "en": 4}
    count = {("der", "de"): 2, ("hund", "de"): 1, ("the", "en"): 3, ("dog", "en"): 1}
    for word, place in model.words.items():
        expected = [np.log((count.get((word, k), 0) + 0.5) / (total[k] + 0.5 * 5)) for k in model.languages]
        assert np.allclose(model.word_logs[place], expected, atol=1e-5)
    expected = {g for w in ("der", "hund", "the", "dog") for n in range(1, 5) for g in langid.grams(w, n)}
    assert model.grams.keys() == expected
    assert model.predict("Hunde", {})[0] == "de" and model.predict("dogs", {})[0] == "en"
    longest = [g for g in langid.grams("dogs", 4) if g in model.grams]
    assert np.allclose(model.unseen("dogs"), np.mean([model.gram_logs[model.grams[g]] for g in longest], axis=0))


def test_odd_rows(spark):
    docs = documents(spark, [(1, "eins zwei", "de"), (2, "one two", "en"), (3, None, "de"), (4, "", "en"), (5, "1 2 3 ! ² ½ Ⅻ", None), (None, "zwei", None), (1, "eins zwei", "de"), (8, long_text(), None), (9, "qqq", None)])
    found = langid.identify(docs, langid.learn(docs)).collect()
    assert len(found) == 9
    assert {r.id: r.lang_pred for r in found if r.id not in (8, 9)} == {1: "de", 2: "en", 3: "und", 4: "und", 5: "und", None: "de"}
    assert {r.lang_pred for r in found} == {"de", "en", "und"} and all(0 <= r.score <= 1 for r in found)
    untaught = langid.learn(docs.filter("lang = 'xx'"))
    assert {(r.lang_pred, r.score) for r in langid.identify(docs, untaught).collect()} == {("und", 0.0)}
    assert langid.identify(docs.filter(F.lit(False)), untaught).count() == 0


def plain_model(rows, min_share):
    """(languages, log frequencies of known words, of known n-grams) by counting in Python."""
    words, grams = {}, {}
    for _, text, lang in rows:
        if lang is not None:
            for word in regex.findall(r"\p{L}+", (text or "").lower()):
                words.setdefault(lang, Counter())[word] += 1
    for lang, counts in words.items():
        for word, n in counts.items():
            for size in range(1, 5):
                for gram in langid.grams(word, size):
                    grams.setdefault(lang, Counter())[gram] += n
    languages = sorted(words)

    def logs(counts):
        total = {k: sum(counts[k].values()) for k in languages}
        known = {w for k in languages for w, n in counts[k].items() if n >= min_share * total[k]}
        return {w: np.log([(counts[k][w] + 0.5) / (total[k] + 0.5 * (len(known) + 1)) for k in languages]) for w in known}

    return languages, logs(words), logs(grams)


@pytest.mark.parametrize("min_share", [langid.MIN_SHARE, 1e-3])
def test_whole_table_against_plain_prediction(spark, sf_dir, min_share):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    rows = [tuple(r) for r in docs.collect()]
    languages, words, grams = plain_model(rows, min_share)
    found = {r.id: r for r in langid.identify(docs, langid.learn(docs, min_share=min_share)).collect()}
    for key, text, _ in rows:
        total = np.zeros(len(languages))
        for word in regex.findall(r"\p{L}+", (text or "").lower()):
            logs = words.get(word)
            for size in (4, 3, 2, 1):
                if logs is None and (known := [grams[g] for g in langid.grams(word, size) if g in grams]):
                    logs = np.mean(known, axis=0)
            total += 0 if logs is None else logs
        best = np.sort(total)[::-1]
        if best[0] - best[1] > 0.5:  # single precision in the model
            assert found[key].lang_pred == languages[int(total.argmax())]
            assert np.isclose(found[key].score, 1 / np.exp(total - total.max()).sum(), atol=1e-3)
