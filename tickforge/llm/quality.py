"""Quality by hierarchical empirical Bayes: a document's own evidence and that of its site.

A document classifier, fitted on a bounded sample of labelled rows, gives each text the
probability of being wanted: of good quality and not toxic. Grouped sums of these give every
host and every path below it a Beta posterior. The strength of each prior comes from the
spread between its groups (moments), so sparse sites stay near the mean of all and sparse
paths near their host. A document's odds are then its own times those of its path, itself
left out, against the odds of the whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from tickforge.llm.common import small_side, stored

SAMPLE_ROWS = 20_000
"""Most labelled rows that the classifier is fitted on: those with the lowest hash of their id."""
WORD_LIMIT = 2_000
MIN_WORD_DOCS = 5
MIN_WORD_ODDS = 1.5
RIDGE = 1.0
THRESHOLD = 0.5
EDGE = 1e-6

_LETTERS = re.compile(r"[^\W\d_]+")
_CLASSES = np.zeros(256, np.int64)
for _k, _signs in enumerate(("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r\n", ".,;:'\"()-", "!?", "|<>{}[]\\/=_+", "#$%&*@^~`"), 1):
    for _sign in _signs:
        _CLASSES[ord(_sign)] = _k
_CLASSES[128:] = 8


def features(text: str | None) -> np.ndarray:
    """Shape of a text: shares of kinds of bytes, of repeated words and lines, lengths."""
    raw = np.frombuffer((text or "").encode(), np.uint8)
    shares = np.bincount(_CLASSES[raw], minlength=9)[1:] / max(1, len(raw))
    words, lines = (text or "").split(), (text or "").split("\n")
    counts = Counter(words)
    n = max(1, len(words))
    often = counts.most_common(1)[0][1] if counts else 0
    return np.array([
        *shares, *np.sqrt(shares), np.log1p(len(words)), len(raw) / n / 10, len(counts) / n, len(counts) / n**0.7, often / n,
        1 - len(set(lines)) / len(lines), np.log1p(len(lines)), float(not words),
    ])


def _logit(p):
    p = np.clip(p, EDGE, 1 - EDGE)
    return np.log(p / (1 - p))


@dataclass
class Logistic:
    """Ridge-penalized logistic regression on standardized features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE, rounds: int = 30) -> Logistic:
        mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
        z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
        penalty = np.diag([ridge] * x.shape[1] + [1e-3])
        weights = np.zeros(z.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ weights)
            weights += step
            if np.abs(step).max() < 1e-6:
                break
        return cls(mean, scale, weights)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -10, 10)
        return 1 / (1 + np.exp(-np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)))


@dataclass
class Classifier:
    """Probability that a text is wanted."""

    quality: Logistic | None
    toxic: Logistic | None
    toxic_words: dict[str, float]
    base: float

    def toxic_features(self, text: str | None) -> np.ndarray:
        found = [self.toxic_words[w] for w in _LETTERS.findall((text or "").lower()) if w in self.toxic_words]
        return np.array([min(len(found), 3.0), max(found, default=0.0), min(sum(found), 20.0)])

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        wanted = np.full(len(texts), self.base)
        if texts and self.quality:
            wanted = self.quality(np.array([features(t) for t in texts]))
        if texts and self.toxic:
            wanted = wanted * (1 - self.toxic(np.array([self.toxic_features(t) for t in texts])))
        return wanted


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Classifier:
    """A classifier from labelled rows. `labels` has `id`, quality and toxic (0, 1 or null: no evidence).

    Without labels of both kinds a part is left out; with none at all every text is wanted.
    """
    known = labels.filter(F.col(id).isNotNull()).dropDuplicates([id])
    sample = F.broadcast(known.orderBy(F.xxhash64(id), id).limit(sample_rows).select(F.col(id).alias("_key"), "quality", "toxic"))
    texts = docs.select(F.col(id).alias("_id"), F.col(text).alias("text"))
    rows = texts.join(sample, F.col("_id") == F.col("_key")).select("text", "quality", "toxic")

    def shape(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = part.column(0).to_pylist()
                words = [sorted(set(_LETTERS.findall((t or "").lower()))) for t in texts]
                yield pa.record_batch(
                    [pa.array([features(t).tolist() for t in texts], pa.list_(pa.float64())), pa.array(words, pa.list_(pa.string())), part.column(1), part.column(2)],
                    ["features", "words", "quality", "toxic"],
                )

    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    shaped = stored(rows.mapInArrow(shape, f"features array<double>, words array<string>, quality {kind['quality']}, toxic {kind['toxic']}"), "labelled")
    judged = shaped.filter("quality is not null").select("features", "quality").toPandas()
    quality, base = None, 1.0
    if judged["quality"].nunique() == 2:
        quality = Logistic.fit(np.array(judged["features"].tolist()), judged["quality"].to_numpy(np.float64))
    elif len(judged):
        base = float(np.clip(judged["quality"].iloc[0], EDGE, 1 - EDGE))
    marked = shaped.filter("toxic is not null")
    sizes = {r.toxic: r["count"] for r in marked.groupBy("toxic").count().collect()}
    found = Classifier(quality, None, {}, base)
    if len(sizes) == 2:
        found.toxic_words = _toxic_words(marked, sizes)
        evidence = marked.select("words", "toxic").mapInArrow(_evidence(found), "x array<double>, toxic int").toPandas()
        found.toxic = Logistic.fit(np.array(evidence["x"].tolist()), evidence["toxic"].to_numpy(np.float64))
    return found


def _toxic_words(marked: DataFrame, sizes: dict[int, int]) -> dict[str, float]:
    """Words whose share of toxic documents is far above that of others, with their log odds."""
    odds = F.log(((F.col("bad") + 0.5) / (sizes[1] + 1)) / ((F.col("docs") - F.col("bad") + 0.5) / (sizes[0] + 1)))
    words = marked.select(F.explode("words").alias("word"), "toxic").groupBy("word").agg(F.sum("toxic").alias("bad"), F.count(F.lit(1)).alias("docs"))
    strong = words.filter(F.col("bad") >= MIN_WORD_DOCS).withColumn("odds", odds).filter(F.col("odds") >= MIN_WORD_ODDS)
    return {r.word: r.odds for r in strong.orderBy(F.desc("odds"), "word").limit(WORD_LIMIT).collect()}


def _evidence(found: Classifier):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [found.toxic_features(" ".join(words)).tolist() for words in batch.column(0).to_pylist()]
            yield pa.record_batch([pa.array(x, pa.list_(pa.float64())), batch.column(1).cast(pa.int32())], ["x", "toxic"])

    return run


def with_evidence(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """The columns of `docs` without `text`, and the classifier's probability as the last one, `evidence`."""
    shared, body = docs.sparkSession.sparkContext.broadcast(classifier), docs.columns.index(text)
    kept = [i for i in range(len(docs.columns)) if i != body]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                wanted = shared.value(part.column(body).to_pylist())
                columns, names = [part.column(i) for i in kept], [part.schema.names[i] for i in kept]
                yield pa.record_batch([*columns, pa.array(wanted, pa.float64())], [*names, "evidence"])

    return docs.mapInArrow(score, T.StructType([*(docs.schema.fields[i] for i in kept), T.StructField("evidence", T.DoubleType())]))


def _strength(groups: DataFrame, mean: str) -> float:
    """Strength of the Beta prior over groups (n, s) around `mean`, by the method of moments."""
    rate = F.col("s") / F.col("n")
    row = groups.agg(
        F.avg((rate - F.col(mean)) ** 2).alias("spread"),
        F.avg(F.col(mean) * (1 - F.col(mean)) / F.col("n")).alias("noise"),
        F.avg(F.col(mean) * (1 - F.col(mean))).alias("unit"),
    ).first()
    if row.spread is None:
        return 1.0
    between = max(row.spread - row.noise, row.unit * 1e-4, 1e-12)
    return float(np.clip(row.unit / between - 1, 1.0, 1e4))


def site_posteriors(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, float, float]:
    """((host, path, host_mean, s, n), global mean, strength of a path's prior) of documents with `evidence`."""
    paths = stored(scored.groupBy(host, path).agg(F.sum("evidence").alias("s"), F.count(F.lit(1)).cast("double").alias("n")), "paths")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mean = total.s / total.n if total.n else 0.5
    hosts = paths.groupBy(host).agg(F.sum("s").alias("s"), F.sum("n").alias("n")).withColumn("mean", F.lit(mean))
    weight = _strength(hosts, "mean")
    posts = hosts.select(F.col(host).alias("site"), ((F.lit(weight * mean) + F.col("s")) / (weight + F.col("n"))).alias("host_mean"))
    placed = stored(paths.join(small_side(posts), F.col(host).eqNullSafe(F.col("site"))).drop("site"), "posteriors")
    return placed, mean, _strength(placed, "host_mean")


def judged(docs: DataFrame, classifier: Classifier, host: Column, path: Column, text: str = "text", keep_text: bool = True) -> DataFrame:
    """(row, evidence, host_mean, path_mean, wanted): `row` holds the columns of `docs`, if asked
    without the text; `wanted` is a probability.

    `host` and `path` tell where a document is from; null is a site of its own. Rows repeated
    count each. The texts are scored in one pass and carried on; only sums are shuffled as long
    as the table of paths may be broadcast.
    """
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if keep_text or c != text)).alias("row")
    placed = docs.select(F.col(text).alias("text"), row, host.alias("host"), path.alias("path"))
    scored = stored(with_evidence(placed, classifier), "scored")
    posteriors, mean, strength = site_posteriors(scored, "host", "path")
    sites = small_side(posteriors.withColumnsRenamed({"host": "own_host", "path": "own_path"}))
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("own_host")) & F.col("path").eqNullSafe(F.col("own_path")), "left")
    held = lambda p: F.greatest(F.least(p, F.lit(1 - EDGE)), F.lit(EDGE))
    logit = lambda p: F.log(held(p) / (1 - held(p)))
    others = (F.lit(strength) * F.col("host_mean") + F.col("s") - F.col("evidence")) / (strength + F.col("n") - 1)
    odds = logit(F.col("evidence")) + logit(F.col("path_mean")) - logit(F.lit(mean))
    return joined.withColumn("path_mean", others).select("row", "evidence", "host_mean", "path_mean", (1 / (1 + F.exp(-odds))).alias("wanted"))
