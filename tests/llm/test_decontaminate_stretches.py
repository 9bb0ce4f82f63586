"""op4: copies whose changed tokens stand side by side or are spread out, against the documented rule."""

import math
import random

from tests.llm.helpers import documents, words
from tickforge.llm import decontaminate


def plain_longest(same):
    """The longest stretch between equal tokens with at most a fifth changed."""
    spans = [(j - i + 1) for i in range(len(same)) for j in range(i, len(same)) if same[i] and same[j] and 5 * same[i : j + 1].count(0) <= j - i + 1]
    return max(spans, default=0)


def test_changed_tokens_side_by_side(spark):
    item = words(5, 20, 5000)
    block = [*item[:9], "x1", "x2", "x3", *item[12:]]
    rows = [(1, " ".join([*words(1, 40), *block, *words(2, 40)])), (2, " ".join([*words(3, 40), *item[:9], *words(4, 40)]))]
    items = spark.createDataFrame([(9, " ".join(item), 1)], "item_id long, text string, seed int")
    for limit in (0, decontaminate.SEED_ROWS):
        found = decontaminate.leaks(documents(spark, rows), items, seed_rows=limit).collect()
        assert [(r.id, r["first"], r.words, r.same) for r in found] == [(1, 40, 20, 17)]


def test_lines_against_the_documented_rule(spark):
    draw, rows, expected = random.Random(2), [], {}
    for k in range(400):
        n, share = draw.choice([9, 15, 20, 30, 60]), draw.choice([0.1, 0.15, 0.2, 0.3, 0.5])
        same = [int(draw.random() >= share) for _ in range(n)]
        rows.append((k, 7, 0, n, same))
        longest = plain_longest(same)
        expected[k] = longest >= 8 and (longest >= 13 or longest >= math.ceil(0.6 * n))
    lines = spark.createDataFrame(rows, "id long, item long, begin int, item_words int, same array<int>")
    found = {r.id: r for r in decontaminate._runs(lines).collect()}
    assert found.keys() == {k for k, leak in expected.items() if leak}
    for k, r in found.items():
        part = rows[k][4][r["first"] : r["last"] + 1]
        assert (len(part), sum(part)) == (r.words, r.same) and 5 * (r.words - r.same) <= r.words
    longest = {r.id: r.last - r["first"] + 1 for r in decontaminate._longest(lines, 4).select("id", "first", "last").collect()}
    assert longest == {k: plain_longest(row[4]) for k, row in enumerate(rows)}
