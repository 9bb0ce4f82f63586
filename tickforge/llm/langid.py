"""Language identification that looks words up first and backs off to shorter character n-grams.

Learning counts the words of all training texts per language with grouped aggregations. A word is
known if it makes up MIN_SHARE of the words of some language, and an n-gram (LONGEST down to 1
characters of a word, its ends marked) likewise; both keep their log frequency in each language. A
word that is not known is scored by its n-grams of the greatest length of which any is known. So
each language chooses for itself, whatever its size, the rule is the same at every size, and the
model has at most languages / MIN_SHARE words.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tickforge.llm.common import stored

MIN_SHARE = 2e-6
LONGEST = 4
SMOOTHING = 0.5
UNDETERMINED = "und"
UNSEEN_KEPT = 200_000
"""Unseen words whose scores a task remembers at a time."""

_LETTERS = regex.compile(r"\p{L}+")


def words_of(text: str | None) -> list[str]:
    """Runs of letters in lower case."""
    return _LETTERS.findall(text.lower()) if text else []


def grams(word: str, n: int) -> list[str]:
    marked = f"^{word}$" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies of words and n-grams in each language, in the order of `languages`."""

    def __init__(self, languages: list[str], words: dict[str, int], word_logs: np.ndarray, grams: dict[str, int], gram_logs: np.ndarray):
        self.languages, self.words, self.word_logs, self.grams, self.gram_logs = languages, words, word_logs, grams, gram_logs

    def unseen(self, word: str) -> np.ndarray:
        for n in range(LONGEST, 0, -1):
            known = [i for g in grams(word, n) if (i := self.grams.get(g)) is not None]
            if known:
                return self.gram_logs[known].mean(axis=0)
        return np.zeros(len(self.languages))  # nothing known of it: no language is preferred

    def predict(self, text: str | None, seen: dict[str, np.ndarray]) -> tuple[str, float]:
        """(language, its share of the likelihood); a text without letters is undetermined.

        A tie goes to the language first in order. `seen` remembers scores of unseen words.
        """
        found = words_of(text)
        if not found or not self.languages:
            return UNDETERMINED, 0.0
        places = [self.words.get(w) for w in found]
        total = self.word_logs[[p for p in places if p is not None]].sum(axis=0, dtype=np.float64)
        for word, place in zip(found, places):
            if place is None:
                if (logs := seen.get(word)) is None:
                    if len(seen) >= UNSEEN_KEPT:
                        seen.clear()
                    logs = seen[word] = self.unseen(word)
                total = total + logs
        best = int(total.argmax())
        return self.languages[best], float(1 / np.exp(total - total[best]).sum())


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", min_share: float = MIN_SHARE) -> Model:
    """A model from the rows of `docs` whose language is not null. No such row: no language."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                counts: dict[str, Counter] = {}
                part = batch.slice(lo, 1000)
                for body, language in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    counts.setdefault(language, Counter()).update(words_of(body))
                rows = [(w, k, n) for k, c in counts.items() for w, n in c.items()]
                columns = list(zip(*rows)) or [(), (), ()]
                yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()))], ["word", "lang", "n"])

    labelled = docs.filter(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"))
    words = stored(
        labelled.mapInArrow(count, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n")), "word-counts"
    )
    cut = F.flatten(F.array(*(_grams_of("word", n) for n in range(1, LONGEST + 1))))
    gram_counts = words.select(F.explode(cut).alias("word"), "lang", "n").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    languages = sorted(r.lang for r in words.select("lang").distinct().collect())
    return Model(languages, *_logs(words, languages, min_share), *_logs(gram_counts, languages, min_share))


def _grams_of(word: str, n: int):
    """The array that grams() gives, as a column."""
    marked = f"concat('^', {word}, '$')" if n > 1 else word
    return F.expr(
        f"IF(length({marked}) < {n}, cast(array() as array<string>), transform(sequence(1, length({marked}) - {n} + 1), i -> substring({marked}, i, {n})))"
    )


def _logs(counts: DataFrame, languages: list[str], min_share: float) -> tuple[dict[str, int], np.ndarray]:
    """The words that make up `min_share` of a language, with their smoothed log frequency in each language.

    The driver gets these words alone.
    """
    if not languages:
        return {}, np.zeros((0, 0))
    per_language = [F.sum(F.when(F.col("lang") == k, F.col("n")).otherwise(0)).alias(f"n{i}") for i, k in enumerate(languages)]
    wide = stored(counts.groupBy("word").agg(*per_language), "word-totals")
    names = [f"n{i}" for i in range(len(languages))]
    totals = np.array(wide.agg(*map(F.sum, names)).first(), np.float64)
    known = [F.col(n) >= max(1.0, min_share * t) for n, t in zip(names, totals)]
    top = wide.filter(reduce(lambda a, b: a | b, known)).toPandas()
    found = top[names].to_numpy(np.float64)
    logs = np.log((found + SMOOTHING) / (totals + SMOOTHING * (len(found) + 1)))
    return {w: i for i, w in enumerate(top["word"])}, logs.astype(np.float32)


def identify(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                found = [shared.value.predict(body, seen) for body in part.column(1).to_pylist()]
                languages, scores = zip(*found) if found else ((), ())
                yield pa.record_batch(
                    [part.column(0), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], ["id", "lang_pred", "score"]
                )

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(predict, "id long, lang_pred string, score double")
