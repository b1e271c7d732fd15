"""Quotation linking on small conversations, against expected threads."""

import random

from tests.compare import check
from wakeline.llm import queries, quotes

SCHEMA = "conv_id long, turn long, role string, text string, reply string"


def rows(spark, data):
    df = spark.createDataFrame([(*x, "clash") for x in data], SCHEMA)
    return {(r.conv_id, r.turn): r for r in quotes.reply_order(df).collect()}


def test_threads(spark):
    got = rows(spark, [
        (1, 0, "user", "How do I sort?\nAnd how do I filter?"),
        (1, 1, "assistant", ">  how do I   SORT?\nUse sort."),
        (1, 2, "assistant", "> And how do I filter?\nUse where."),
        (1, 3, "user", "> > How do I sort?\n> Use sort.\n\nThanks!"),
        (1, 4, "user", "> never said\nWhat?"),
        (2, 0, "user", "Use sort."),
        (2, 1, "user", "> How do I sort?\nother conversation"),
    ])
    assert {k: (r.parent, r.root, r.depth, r.n_unlinked) for k, r in got.items()} == {
        (1, 0): (None, 0, 0, 0), (1, 1): (0, 0, 1, 0), (1, 2): (0, 0, 1, 0), (1, 3): (1, 0, 2, 0), (1, 4): (None, 4, 0, 1), (2, 0): (None, 0, 0, 0), (2, 1): (None, 1, 0, 1),
    }
    assert got[1, 1].reply == "Use sort." and got[1, 3].reply == "Thanks!" and got[1, 0].reply.startswith("How do I sort?\n")


def test_latest_earlier_message_is_the_parent(spark):
    got = rows(spark, [(1, t, "user", "ok") for t in range(5)] + [(1, 5, "user", "> ok\nyes"), (1, 6, "user", ">ok\nagain"), (1, 7, "user", "ok")])
    assert got[1, 5].parent == 4 and got[1, 6].parent == 4


def test_long_chain(spark):
    got = rows(spark, [(1, 0, "user", "m0")] + [(1, t, "user", f"> m{t - 1}\nm{t}") for t in range(1, 20)])
    assert all(got[1, t].depth == t and got[1, t].root == 0 for t in range(20))


def test_nulls_repeats_and_empty_tables(spark):
    got = rows(spark, [(None, None, None, None), (None, 1, "user", "a"), (None, 2, "user", "> a\nb"), (1, 1, "user", "")])
    assert got[None, 2].parent == 1 and got[None, None].reply == "" and got[1, 1].depth == 0
    twice = spark.createDataFrame([(1, 0, "user", "a", ""), (1, 1, "user", "> a", ""), (1, 1, "user", "> a", "")], SCHEMA)
    assert [(r.turn, r.parent) for r in quotes.reply_order(twice).orderBy("turn").collect()] == [(0, None), (1, 0), (1, 0)]
    assert quotes.reply_order(spark.createDataFrame([], SCHEMA)).count() == 0


def test_very_long_text(spark):
    text = "\n".join(f"> line {k}" for k in range(300)) + "\n" + "word " * 50_000
    got = rows(spark, [(1, 0, "user", "line 7"), (1, 1, "user", text)])
    assert got[1, 1].parent == 0 and got[1, 1].reply == text.rpartition("\n")[2].strip()


def test_common_line_across_stretches(spark):
    """Turns far apart, so that parents stand in other stretches at every level."""
    turns = [0, 1, 5, 70_000, 70_001, 2**33, 2**33 + 1, 2**50, 2**50 + 9, -3]
    data = [(c, t, "user", "ok") for c in (1, None) for t in turns[::2]] + [(c, t, "user", f"> ok\nreply {t}") for c in (1, None) for t in turns[1::2]]
    got = rows(spark, data)
    said = turns[::2]
    for c in (1, None):
        for t in turns[1::2]:
            assert got[c, t].parent == max((x for x in said if x < t), default=None), t


def test_random_conversations_match_sql(spark, tmp_path):
    """Nested, broken and repeated quotes of earlier messages, against the query's SQL."""
    r = random.Random(3)
    data = []
    for c in [*range(40), None]:
        said = []
        for turn in range(r.randint(1, 14)):
            lines = []
            for _ in range(r.randint(0, 3)):
                source = r.choice(said) if said and r.random() < 0.8 else "never said"
                depth = r.choice([1, 1, 2, 3])
                lines += [r.choice(["> ", ">", " > ", ">> "]) * depth + x.swapcase() for x in source.split("\n")] + [""] * r.randint(0, 2)
            own = "\n".join(r.choice(["ok", "Thanks  a lot", "what is \t this?", "a > b", f"point {r.randint(0, 9)}", "", "  "]) for _ in range(r.randint(1, 4)))
            lines.insert(r.randint(0, len(lines)), own)
            text = r.choice(["\n", "\n", "\r\n"]).join(lines)
            said.append(own)
            data.append((c, turn * r.choice([1, 1, 70_000]) if r.random() < 0.97 else None, "user", r.choice([text] * 30 + [None])))
    data = list({(c, t): (c, t, role, x) for c, t, role, x in data}.values())
    spark.createDataFrame(data, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "raw"))
    next((tmp_path / "raw").glob("part-*.parquet")).rename(tmp_path / "conversations.parquet")
    assert check(spark, str(tmp_path), queries.op9_quotation_linking, queries.OP9_SQL) == len(data)
    linked = [x for x in queries.op9_quotation_linking(spark, str(tmp_path)).collect() if x.parent is not None]
    assert len(linked) > 60 and max(x.depth for x in linked) > 2


def test_a_common_line_of_one_turn_without_conversations(spark):
    """Very many equal messages of one turn and of no conversation: each quote finds the latest turn before it."""
    data = [(None, 0, "user", "ok")] * 400 + [(None, 1, "user", "> ok\nfine")] * 400 + [(None, None, "user", "> ok")] * 5 + [(3, 1, "user", "> ok")]
    df = spark.createDataFrame([(*x, "clash") for x in data], SCHEMA)
    got = quotes.reply_order(df).groupBy("conv_id", "turn", "parent", "root", "depth").count().collect()
    assert {(r.conv_id, r.turn, r.parent, r.root, r.depth): r["count"] for r in got} == {(None, 0, None, 0, 0): 400, (None, 1, 0, 0, 1): 400, (None, None, None, None, 0): 5, (3, 1, None, 1, 0): 1}


def test_positions_are_a_walk_depth_first(spark):
    """A thread with branches, hot parents and a long chain, against a recursive walk."""
    r = random.Random(8)
    data, parents = [(c, 0, "user", "m0") for c in (1, None)], {}
    for c in (1, None):
        for t in range(1, 60):
            p = r.choice([0, t - 1, r.randrange(t)])
            parents[c, t] = p
            data.append((c, t, "user", f"> m{p}\nm{t}"))
    data += [(2, 0, "user", "m0")] + [(2, t, "user", f"> m{t - 1}\nm{t}") for t in range(1, 40)]
    parents |= {(2, t): t - 1 for t in range(1, 40)}

    def walk(c, t):
        return [t] + [x for s in range(60) if parents.get((c, s)) == t for x in walk(c, s)]

    got = rows(spark, data)
    for c in (1, None, 2):
        assert [got[c, t].position for t in walk(c, 0)] == list(range(60 if c != 2 else 40))


def test_in_order(spark):
    data = [(1, 0, "user", "a"), (1, 1, "user", "> a\nb"), (1, 2, "user", "> a\nc"), (1, 3, "user", "> b\nd"), (1, 4, "user", "z"), (1, 5, "user", "> z\ny"), (None, None, "user", "> a")]
    got = quotes.in_order(quotes.reply_order(spark.createDataFrame([(*x, "clash") for x in data], SCHEMA))).collect()
    assert [(x.turn, x.position) for x in got] == [(None, 0), (0, 0), (1, 1), (3, 2), (2, 3), (4, 0), (5, 1)]
    assert [x.reply for x in got if x.root == 0] == ["a", "b", "d", "c"]
