"""op4: whole passages by brute force, changed passages, odd rows, both ways of joining."""

import re

from tests.llm.helpers import documents, long_text, words
from tickforge.llm import decontaminate
from tickforge.llm.queries import queries

ITEM = words(77, 30, 5000)


def benchmark(spark, rows):
    return spark.createDataFrame([(*row, 1) for row in rows], "item_id long, text string, seed int")


def test_whole_table_against_brute_force(spark, sf_dir):
    cut = lambda text: " " + " ".join(re.findall(r"[^\W_]+", text.lower())) + " "
    items = {r.item_id: cut(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()}
    expected = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        if found := [k for k, item in items.items() if item in cut(r.text)]:
            expected[r.doc_id] = sorted(found)
    found = {r.doc_id: r.item_ids for r in queries()["op4_spaced_seeds"](spark, sf_dir).collect()}
    assert found == expected


def test_changed_and_partial_passages(spark):
    changed = ITEM.copy()
    for place in range(3, 30, 7):
        changed[place] = "other"
    rewritten = [w if i % 3 else "other" for i, w in enumerate(ITEM)]
    around = lambda part, seed: " ".join([*words(seed, 50), *part, *words(seed + 1, 50)])
    rows = [(1, around(ITEM, 1)), (2, around(changed, 2)), (3, around(rewritten, 3)), (4, around(ITEM[:14], 4)), (5, around(ITEM[:9], 5)), (6, " ".join(ITEM).upper().replace(" ", " - "))]
    for limit in (0, decontaminate.SEED_ROWS):
        found = decontaminate.leaks(documents(spark, rows), benchmark(spark, [(9, " ".join(ITEM))]), seed_rows=limit).collect()
        assert {r.id: (r.item, r.words, r.same) for r in found} == {1: (9, 30, 30), 2: (9, 26, 23), 4: (9, 14, 14), 6: (9, 30, 30)}
        assert {r.id: r["first"] for r in found}[1] == 50


def test_odd_rows(spark):
    item = " ".join(ITEM)
    rows = [(1, None), (2, ""), (3, item), (3, item), (None, item), (5, "short"), (6, f"{long_text()} {item} {long_text(2)}"), (7, long_text(3))]
    items = benchmark(spark, [(9, item), (9, item), (10, None), (11, "too short"), (None, item)])
    found = decontaminate.contaminated(documents(spark, rows), items).collect()
    assert {r.id for r in found} == {3, None, 6}
    kept = decontaminate.clean(documents(spark, rows), items)
    assert kept.columns == documents(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 5, 7]


def test_empty_tables(spark):
    some = documents(spark, [(1, " ".join(ITEM))])
    assert decontaminate.leaks(documents(spark, []), benchmark(spark, [(9, " ".join(ITEM))])).count() == 0
    assert decontaminate.leaks(some, benchmark(spark, [])).count() == 0
    assert decontaminate.clean(some, benchmark(spark, [])).count() == 1


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries()["op4_spaced_seeds"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
