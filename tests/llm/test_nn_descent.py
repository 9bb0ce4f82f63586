"""op7 against brute force: pairs, clusters larger than any list, odd vectors."""

import numpy as np

from tickforge.llm import nn_descent
from tickforge.llm.queries import queries

SCHEMA = "vec_id long, embedding array<double>, node long, unit int, size int, links long"


def brute(rows, threshold):
    """{id: (links, component)} of rows of one length with distinct ids."""
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = x @ x.T >= threshold
    np.fill_diagonal(near, False)
    root = list(ids)
    for _ in ids:
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(ids))]
    return {i: (int(near[k].sum()), root[k]) for k, i in enumerate(ids)}


def found(spark, rows, **options):
    df, recall = nn_descent.near_duplicates(spark.createDataFrame([(*r, 1, 1, 1, 1) for r in rows], SCHEMA), **options)
    return df.collect(), recall


def test_clusters_and_pairs(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    draw = np.random.default_rng(1)
    centers = draw.normal(size=(330, 16))
    rows = [(i, c.tolist()) for i, c in enumerate(centers)]
    rows += [(1000 + i, (centers[0] + draw.normal(size=16) * 0.1).tolist()) for i in range(90)]
    rows += [(2000 + i, (centers[i] + draw.normal(size=16) * 0.2).tolist()) for i in range(1, 40)]
    rows += [(3000 + i, centers[5].tolist()) for i in range(30)]
    result, recall = found(spark, rows)
    expected = brute(rows, 0.95)
    assert recall >= 0.99
    assert all(r.n_links <= expected[r.id][0] for r in result)
    assert np.mean([(r.n_links, r.component_id) == expected[r.id] for r in result]) > 0.98


def test_whole_table_against_brute_force(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    result = {r.vec_id: (r.n_links, r.component_id) for r in queries()["op7_nn_descent"](spark, sf_dir).collect()}
    assert result == brute(rows, 0.95)


def mixed_lengths():
    """Clusters of vectors of two lengths, which meet in the same tasks."""
    draw, rows = np.random.default_rng(4), []
    for first, dim in ((0, 16), (10_000, 24)):
        for k in range(30):
            center = draw.normal(size=dim)
            rows += [(first + 10 * k + i, (center + draw.normal(size=dim) * 0.15).tolist()) for i in range(5)]
    return rows


def expected_mixed(rows):
    return brute([r for r in rows if r[0] < 10_000], 0.95) | brute([r for r in rows if r[0] >= 10_000], 0.95)


def test_vectors_of_two_lengths(spark):
    rows = mixed_lengths()
    result, recall = found(spark, rows)
    assert {r.id: (r.n_links, r.component_id) for r in result} == expected_mixed(rows) and recall >= 0.99


def test_a_failed_audit_leads_to_more_trees(spark, monkeypatch):
    audits = []
    real = nn_descent._audit
    monkeypatch.setattr(nn_descent, "_audit", lambda *a: audits.append(real(*a)) or (0.5 if len(audits) == 1 else audits[-1]))
    rows = mixed_lengths()
    result, recall = found(spark, rows)
    assert len(audits) == 2 and recall >= 0.99
    assert {r.id: (r.n_links, r.component_id) for r in result} == expected_mixed(rows)


def test_all_is_compared_if_no_attempt_is_good_enough(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "_audit", lambda *a: 0.5)
    monkeypatch.setattr(nn_descent, "ATTEMPTS", 1)
    monkeypatch.setattr(nn_descent, "BLOCK", 16)
    rows = mixed_lengths()
    result, recall = found(spark, rows)
    assert {r.id: (r.n_links, r.component_id) for r in result} == expected_mixed(rows) and recall == 1.0


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (None, [1.0, 0.0]), (2, [2.0, 0.0]), (11, [1e-200, 0.0])]
    result, _ = found(spark, rows)
    assert len(result) == len(rows)
    got = {r.id: (r.n_links, r.component_id) for r in result}
    assert got == {1: (3, 1), 2: (3, 1), 11: (3, 1), None: (0, None)} | {k: (0, k) for k in (3, 4, 5, 6, 7, 8, 9)}


def test_empty_table(spark):
    assert found(spark, []) == ([], 1.0)
