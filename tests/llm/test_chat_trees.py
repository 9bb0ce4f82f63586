"""op3 against the given conversations, trees with branches, and odd rows."""

import hashlib
import itertools

from pyspark.sql import functions as F

from tickforge.llm import chat_trees
from tickforge.llm.queries import queries

SCHEMA = "tree long, node long, parent long, role string, text string, score double, key string, up string, rank int"


def messages(spark, rows):
    return spark.createDataFrame([(*row, "k", "u", 1) for row in rows], SCHEMA)


def test_whole_table(spark, sf_dir):
    rows = sorted((r.conv_id, r.turn, r.role, r.text or "") for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect())
    said = "</s>[INST] ok [/INST]"
    rows += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    expected = {}
    for conv, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        group = list(group)
        lines = "".join(f"{r[2]}\n{r[3]}\n" for r in group).encode()
        learned = "".join(r[3] for r in group if r[2] == "assistant")
        expected[conv] = (len(group), hashlib.sha256(lines).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())
    found = queries()["op3_chat_trees"](spark, sf_dir).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found} == expected


def test_best_branches(spark):
    """The root 1 has leaves 4 (mean 2), 5 (mean 3) and 3 (mean 2, shorter)."""
    rows = [(1, 1, None, "user", "a", 1.0), (1, 2, 1, "assistant", "b", 2.0), (1, 3, 1, "assistant", "c", 3.0), (1, 4, 2, "user", "d", 3.0), (1, 5, 2, "user", "e", 6.0)]
    found = chat_trees.branches(messages(spark, rows), keep=3).orderBy("rank", "depth").collect()
    assert [(r.rank, r.node) for r in found] == [(1, 1), (1, 2), (1, 5), (2, 1), (2, 2), (2, 4), (3, 1), (3, 3)]


def test_odd_rows(spark):
    rows = [
        (1, 1, None, None, None, None),
        (1, 2, 1, "assistant", "", None),
        (1, 2, 1, "assistant", "", None),
        (None, 1, None, "user", "no tree", 0.0),
        (2, 5, 99, "tool", "parent is not there", 0.0),
        (3, 1, 2, "user", "cycle", 0.0),
        (3, 2, 1, "user", "cycle", 0.0),
    ]
    found = chat_trees.formatted(chat_trees.branches(messages(spark, rows)))
    read = found.select("tree", chat_trees.turns_of(F.col("formatted")).alias("t"), chat_trees.learned_text(F.col("formatted"), F.col("loss")).alias("l")).collect()
    assert {r.tree: [(t.role, t.text) for t in r.t] for r in read} == {
        1: [("", ""), ("assistant", "")],
        None: [("user", "no tree")],
        2: [("tool", "parent is not there")],
    }


def test_control_strings_and_long_paths_come_back(spark):
    ugly = ["</s>", "\\</s>", "[INST] x [/INST]", "\\", "[\\[INST]", " [SAYS] ", "[/ROLE]\\", "é\n[OUT]", "<</s>s>"]
    rows = [(1, i, i - 1 if i else None, ("user", "assistant", "[ROLE]", "system")[i % 4], ugly[i % len(ugly)] * (1 + i % 3), 0.0) for i in range(300)]
    found = chat_trees.formatted(chat_trees.branches(messages(spark, rows)))
    row = found.select(chat_trees.turns_of(F.col("formatted")).alias("t"), chat_trees.learned_text(F.col("formatted"), F.col("loss")).alias("l")).first()
    assert [(t.role, t.text) for t in row.t] == [(r[3], r[4]) for r in rows]
    assert row.l == "".join(r[4] for r in rows if r[3] == "assistant")


def test_empty_table(spark):
    assert chat_trees.formatted(chat_trees.branches(messages(spark, []))).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    plan = queries()["op3_chat_trees"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
