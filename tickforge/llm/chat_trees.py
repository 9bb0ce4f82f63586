"""Conversations from reply trees, in DataFrame expressions alone.

Self-joins that double the distance to an ancestor number every message's depth and add up
its branch's score in log2(depth) rounds. Branches, that is leaves, are ranked by the mean
score of their messages; the ancestors of the chosen leaves are listed by the same jumps, each
message once per chosen branch, and formatted as one conversation.

The template marks turns as below. A control string inside a text gets a backslash before it,
and markers of the template follow a space or another marker, so nothing in a text is read as
a marker and taking one backslash away gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from tickforge.llm.common import stored

BEGIN = "<s>"
MARKERS = {"user": ("[INST] ", " [/INST]"), "system": ("[SYS] ", " [/SYS]"), "assistant": ("[OUT] ", " </s>")}
OTHER_ROLE = ("[ROLE] ", " [SAYS] ", " [/ROLE]")
CONTROL = r"</?s>|\[/?(?:INST|SYS|OUT|ROLE|SAYS)\]"
TURN = r"(?s)\[INST\] .*? \[/INST\]|\[SYS\] .*? \[/SYS\]|\[OUT\] .*? </s>|\[ROLE\] .*? \[SAYS\] .*? \[/ROLE\]"
LEARNED_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def branches(messages: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, leaf, rank, score, depth, role, text): the messages of the `keep` best branches under each root.

    `messages` has tree, node, parent, role, text, score. A null parent, or one that is not in
    the tree, makes a root; a null score counts 0. Equal scores go to the longer branch, then to
    the smaller leaf. Of rows that repeat a node the least by (parent, role, text, score) stays.
    Messages on a cycle have no root and are in no branch. No message, no branch.
    """
    key = lambda node: F.concat_ws("\x1f", F.coalesce(F.col("tree").cast("string"), F.lit("\x00")), F.coalesce(F.col(node).cast("string"), F.lit("\x00")))
    first = W.partitionBy("key").orderBy("parent", "role", "text", "score")
    nodes = stored(
        messages.select("tree", "node", "parent", "role", "text", F.coalesce("score", F.lit(0.0)).alias("score"), key("node").alias("key"))
        .withColumn("up", F.when(F.col("parent").isNotNull(), key("parent")))
        .withColumn("n", F.row_number().over(first))
        .filter("n = 1")
        .drop("n"),
        "messages",
    )
    present = nodes.select(F.col("key").alias("up"), F.lit(True).alias("present"))
    state = nodes.select("key", "up", "score").join(present, "up", "left").select(
        "key", F.when(F.col("present"), F.col("up")).alias("up"), F.col("key").alias("root"), "score", F.lit(0).alias("depth")
    )
    jumps, level, total = [], 0, nodes.count()
    state = stored(state.withColumn("depth", F.col("up").isNotNull().cast("int")), "jumps")
    parents = state.filter("up is not null").select(F.col("up").alias("key")).distinct()
    while (1 << level) <= total and state.filter("up is not null").limit(1).count():
        jumps.append(state.filter("up is not null").select("key", "up"))
        over = state.select(F.col("key").alias("up"), F.col("up").alias("far"), F.col("root").alias("far_root"), F.col("score").alias("more"), F.col("depth").alias("deeper"))
        state = stored(
            state.filter("up is not null").join(over, "up", "left").select(
                "key", F.col("far").alias("up"), F.coalesce("far_root", "root").alias("root"),
                (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"), (F.col("depth") + F.coalesce("deeper", F.lit(0))).alias("depth"),
            ).unionByName(state.filter("up is null").select("key", "up", "root", "score", "depth")),
            "jumps",
        )
        level += 1
    ends = state.filter("up is null").join(parents, "key", "left_anti").withColumn("score", F.col("score") / (F.col("depth") + 1))
    best = W.partitionBy("root").orderBy(F.desc("score"), F.desc("depth"), "key")
    chosen = stored(
        ends.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= keep).select(F.col("key").alias("leaf"), "key", "rank", "score", "depth"),
        "branches",
    )
    for k in range(len(jumps) - 1, -1, -1):
        above = chosen.join(jumps[k], "key").select("leaf", F.col("up").alias("key"), "rank", "score", (F.col("depth") - (1 << k)).alias("depth"))
        chosen = stored(chosen.unionByName(above), "branches")
    return chosen.join(nodes.select("key", "tree", "node", "role", "text"), "key").drop("key")


def formatted(turns: DataFrame) -> DataFrame:
    """(tree, leaf, rank, score, formatted, loss): each branch as one text with the spans to learn from.

    `loss` lists (begin, end) in code points of the assistant's texts, escaped as they stand.
    Null roles and texts are empty. A branch is one row, so its text must fit a task.
    """
    role, text = F.coalesce("role", F.lit("")), escaped(F.coalesce("text", F.lit("")))
    head = F.concat(F.lit(OTHER_ROLE[0]), escaped(role), F.lit(OTHER_ROLE[1]))
    tail = F.lit(OTHER_ROLE[2])
    for name, (begin, end) in MARKERS.items():
        head, tail = F.when(role == name, F.lit(begin)).otherwise(head), F.when(role == name, F.lit(end)).otherwise(tail)
    marked = turns.select("tree", "leaf", "rank", "score", "depth", (role == LEARNED_ROLE).alias("learned"), head.alias("head"), text.alias("body"), tail.alias("tail"))
    length = F.length("head") + F.length("body") + F.length("tail")
    earlier = W.partitionBy("leaf").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    begin = F.lit(len(BEGIN)) + F.coalesce(F.sum(length).over(earlier), F.lit(0)) + F.length("head")
    placed = marked.withColumn("begin", begin).select(
        "tree", "leaf", "rank", "score",
        F.struct("depth", F.concat("head", "body", "tail").alias("turn"), "learned", "begin", (F.col("begin") + F.length("body")).alias("end")).alias("t"),
    )
    whole = placed.groupBy("leaf", "tree", "rank", "score").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    learned = F.filter("turns", lambda t: t["learned"])
    return whole.select(
        "tree", "leaf", "rank", "score",
        F.concat(F.lit(BEGIN), F.array_join(F.transform("turns", lambda t: t["turn"]), "")).alias("formatted"),
        F.transform(learned, lambda t: F.struct(t["begin"].alias("begin"), t["end"].alias("end"))).alias("loss"),
    )


def turns_of(text: Column) -> Column:
    """The (role, text) of each turn of a formatted conversation."""

    def body(turn: Column, begin: Column, end: Column) -> Column:
        return unescaped(turn.substr(begin + 1, F.length(turn) - begin - end))

    def read(turn: Column) -> Column:
        says = F.instr(turn, OTHER_ROLE[1])
        role = unescaped(turn.substr(F.lit(len(OTHER_ROLE[0]) + 1), says - len(OTHER_ROLE[0]) - 1))
        said = body(turn, says + len(OTHER_ROLE[1]) - 1, F.lit(len(OTHER_ROLE[2])))
        for name, (begin, end) in MARKERS.items():
            mine = turn.startswith(begin)
            role, said = F.when(mine, F.lit(name)).otherwise(role), F.when(mine, body(turn, F.lit(len(begin)), F.lit(len(end)))).otherwise(said)
        return F.struct(role.alias("role"), said.alias("text"))

    return F.transform(F.regexp_extract_all(text, F.lit(TURN), F.lit(0)), read)


def learned_text(text: Column, loss: Column) -> Column:
    """All text under the loss spans of a formatted conversation, unescaped, nothing between."""
    return F.array_join(F.transform(loss, lambda s: unescaped(F.substring(text, s["begin"] + 1, s["end"] - s["begin"]))), "")
