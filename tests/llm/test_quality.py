"""op5: held-out accuracy, shrinking, odd rows."""

import numpy as np
from pyspark.sql import functions as F

from tests.llm.helpers import documents, long_text
from tickforge.llm import quality
from tickforge.llm.queries import queries

LABELS = "doc_id long, quality int, toxic int, text string"


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "source", "lang")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = quality.judged(docs, quality.fit(docs, labels.filter(~held)), F.col("source"), F.col("lang"), keep_text=False)
    rows = found.select("row.doc_id", "wanted").join(labels.filter(held), "doc_id").select((F.col("wanted") >= 0.5).alias("kept"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")).collect()
    assert len(rows) > 100 and np.mean([r.kept == r.good for r in rows]) > 0.93
    assert np.mean([r.kept for r in rows if r.good]) > 0.97


def test_query_gives_every_document(spark, sf_dir):
    found = queries()["op5_quality"](spark, sf_dir)
    assert found.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert found.filter("wanted is null or wanted < 0 or wanted > 1").count() == 0


def test_posteriors_against_plain_sums(spark):
    """Many documents move a site's mean, few do not; and the document itself is left out."""
    rows = [(f"good{i % 5}", "a", 0.9) for i in range(400)] + [("bad", "a", 0.1)] * 200 + [("rare", "a", 0.1)]
    scored = spark.createDataFrame(rows, "host string, path string, evidence double")
    found, mean, strength = quality.site_posteriors(scored, "host", "path")
    hosts = {r.host: r.host_mean for r in found.collect()}
    rates, n = {h: np.mean([e for k, _, e in rows if k == h]) for h in hosts}, {h: sum(k == h for k, _, _ in rows) for h in hosts}
    assert np.isclose(mean, np.mean([e for _, _, e in rows])) and strength >= 1
    unit = mean * (1 - mean)
    between = np.mean([(r - mean) ** 2 for r in rates.values()]) - np.mean([unit / x for x in n.values()])
    weight = max(1.0, unit / between - 1)
    assert all(np.isclose(hosts[h], (weight * mean + rates[h] * n[h]) / (weight + n[h])) for h in hosts)
    assert abs(hosts["rare"] - mean) < abs(hosts["bad"] - mean)


def test_wanted_against_plain_sums(spark):
    """The whole hierarchy by hand: host around the mean, path around the host without the document, both with its evidence."""
    rows = [(i, f"{'fine words here. ' * (i % 7)}", f"h{i % 3}", f"p{i % 2}") for i in range(60)] + [(60, "x", "h9", None), (61, "!!", None, "p0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, host string, path string")
    classifier = quality.fit(docs, spark.createDataFrame([(i, int(i % 7 > 2), 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int"))
    found = {r.row.doc_id: r for r in quality.judged(docs, classifier, F.col("host"), F.col("path")).collect()}
    e = dict(zip((r[0] for r in rows), classifier([r[1] for r in rows])))
    site = {k: (host, path) for k, _, host, path in rows}
    groups = {}
    for k, (host, path) in site.items():
        for key in ((host,), (host, path)):
            groups.setdefault(key, []).append(e[k])
    mean = np.mean(list(e.values()))

    def strength(keys, prior):
        unit = [prior(k) * (1 - prior(k)) for k in keys]
        spread = np.mean([(np.mean(groups[k]) - prior(k)) ** 2 for k in keys])
        between = max(spread - np.mean([u / len(groups[k]) for u, k in zip(unit, keys)]), np.mean(unit) * 1e-4, 1e-12)
        return np.clip(np.mean(unit) / between - 1, 1.0, 1e4)

    by_host = strength([k for k in groups if len(k) == 1], lambda k: mean)
    host_mean = {k[0]: (by_host * mean + sum(v)) / (by_host + len(v)) for k, v in groups.items() if len(k) == 1}
    by_path = strength([k for k in groups if len(k) == 2], lambda k: host_mean[k[0]])
    logit = lambda p: np.log(np.clip(p, quality.EDGE, 1 - quality.EDGE) / (1 - np.clip(p, quality.EDGE, 1 - quality.EDGE)))
    for k, key in site.items():
        others = (by_path * host_mean[key[0]] + sum(groups[key]) - e[k]) / (by_path + len(groups[key]) - 1)
        wanted = 1 / (1 + np.exp(-(logit(e[k]) + logit(others) - logit(mean))))
        assert np.allclose([found[k].evidence, found[k].host_mean, found[k].path_mean, found[k].wanted], [e[k], host_mean[key[0]], others, wanted])


def test_odd_rows(spark):
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "One two three.", "en", "a"), (3, "One two three.", "en", "a"), (None, "x", "en", "b"), (5, long_text(), "en", "b")]
    docs = documents(spark, rows)
    labels = spark.createDataFrame([(3, 1, 0, "t"), (3, 1, 0, "t"), (1, 0, None, "t"), (None, 1, 1, "t"), (5, None, 1, "t"), (99, 1, 0, "t")], LABELS)
    for given in (labels, labels.limit(0)):
        found = quality.judged(docs, quality.fit(docs, given), F.col("source"), F.col("lang"))
        assert found.select("row.*").columns == docs.columns
        assert found.count() == len(rows) and found.filter("wanted is null").count() == 0
    none = documents(spark, [])
    assert quality.judged(none, quality.fit(none, labels), F.col("source"), F.col("lang")).count() == 0
