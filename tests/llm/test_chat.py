import random

import pytest
from pyspark.sql import functions as F

from pitwall.llm import chat


def brute(turns):
    best = None

    def go(i, state, cost):
        nonlocal best
        if i == len(turns):
            cost += chat.ending(state)
            best = cost if best is None else min(best, cost)
            return
        for move in chat.moves(state, *turns[i]):
            go(i + 1, move[1], cost + move[0])

    go(0, chat.START, 0)
    return best


def test_paths_are_cheapest_and_legal():
    r = random.Random(1)
    for _ in range(200):
        turns = [(r.choice(["system", "user", "assistant", None, "tool"]), r.choice([0, 5, 2000]), i) for i in range(r.randint(1, 6))]
        made, cost = chat.path(turns)
        assert cost == brute(turns)
        roles = []
        for _, out, merged, inserted in made:
            roles += [] if merged else [*inserted, out]
        roles += chat.CLOSE[roles[-1]]
        body = roles[1:] if roles[0] == chat.SYSTEM else roles
        assert body == [chat.USER, chat.ASSISTANT] * (len(body) // 2)


def test_legal_conversations_cost_nothing():
    turns = [("system", 3, 0), ("user", 4, 1), ("assistant", 5, 2), ("user", 4, 3), ("assistant", 5, 4)]
    made, cost = chat.path(turns)
    assert cost >> chat.REAL == 0 and not any(m[2] or m[3] for m in made)


def rows(seed=2):
    r = random.Random(seed)
    role = lambda: r.choice(["system", "user", "user", "assistant", "assistant", None, "tool"])
    out = [(1, i, role(), "x" * r.choice([0, 3, 2000])) for i in range(500)]  # far more than the others
    for c in range(2, 40):
        out += [(c, i, role(), r.choice(["", None, f"turn {c} {i}"])) for i in range(r.randint(1, 8))]
    return out + [(None, 0, "user", "no id"), (50, None, "user", "no number"), (51, 0, "user", "same"), (51, 0, "user", "same")]


@pytest.mark.parametrize("parts", [1, 7, 60])
def test_any_partitioning_gives_the_path_of_the_whole_conversation(spark, parts):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = chat.format_chats(spark.createDataFrame(rows(), "conv_id long, turn long, role string, text string")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(got) == len(rows())
    for c in {r[0] for r in rows()}:
        turns = sorted((r for r in rows() if r[0] == c), key=lambda r: -1 if r[1] is None else r[1])
        made, cost = chat.path([(role, len(t or ""), i) for _, i, role, t in turns])
        mine = sorted((r for r in got if r["conv_id"] == c), key=lambda r: -1 if r["turn"] is None else r["turn"])
        assert sum(r["cost"] for r in mine) == cost >> chat.REAL
        assert [r["new_role"] for r in mine] == [chat.ROLES[m[1] - 1] for m in made]
        if c != 51:
            text, first = "", True
            for (_, state, merged, inserted), (_, _, _, t) in zip(made, turns):
                text += ("\n\n" if merged else ("" if first else chat.END) + "".join(f"<|{chat.ROLES[x - 1]}|>\n{chat.END}" for x in inserted) + f"<|{chat.ROLES[state - 1]}|>\n") + (t or "")
                first = False
            text += chat.END + "".join(f"<|{chat.ROLES[x - 1]}|>\n{chat.END}" for x in chat.CLOSE[state])
            assert "".join(r["rendered"] for r in mine) == text


def test_extra_columns_and_empty_table(spark):
    df = spark.createDataFrame(rows()[:3], "conv_id long, turn long, role string, text string").withColumn("merged", F.lit(1)).withColumn("cost", F.lit("c"))
    assert chat.format_chats(df).count() == 3 and chat.format_chats(df.limit(0)).collect() == []
