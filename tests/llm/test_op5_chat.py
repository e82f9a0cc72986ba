import hashlib
import random
from collections import defaultdict

from ridgeline.llm import chat

CONTROLS = chat.Template().controls()


def brute(rows):
    """(n_turns, turns digest, loss length, loss digest) of each conversation."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn if turn is not None else -1, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        all_ = "".join(f"{r}\n{t}\n" for _, r, t in turns)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out[conv] = (len(turns), sha(all_), len(loss), sha(loss))
    return out


def digests(spark, rows, template=None):
    df = spark.createDataFrame([(*r, "x", True) for r in rows], "conv_id long, turn long, role string, text string, formatted string, valid boolean")
    return {r.conv_id: r for r in chat.digest(df, template).collect()}


def check(spark, rows, template=None):
    got = digests(spark, rows, template)
    want = brute(rows)
    assert set(got) == set(want)
    for c, w in want.items():
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256) == w, c
    return got


def test_round_trip_of_hostile_texts(spark):
    rnd = random.Random(1)
    bits = [*CONTROLS, *[c[1:] for c in CONTROLS], *[c[:-1] for c in CONTROLS], "\\", "\\\\", " ", "\n", "a", "é", "😀", "<", "[", "$1", "\\E", " </s>\n"]
    rows = []
    for conv in range(400):
        for turn in range(rnd.randint(1, 5)):
            role = rnd.choice(["system", "user", "assistant", "tool", "", None, "[ROLE] <s>", "user\n"])
            rows.append((conv, turn, role, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))))
    check(spark, rows)


def test_no_control_string_survives_in_a_text(spark):
    rows = [(k, 0, "user", c + c[1:] + "\\" + c) for k, c in enumerate(CONTROLS)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in chat.format_conversations(df).collect():
        body = r.segments[1].text
        assert not any(c in body for c in CONTROLS)
        assert r.formatted == "".join(s.text for s in r.segments)


def test_turn_order(spark):
    said = {
        0: "system user assistant", 1: "user assistant user", 2: "assistant user", 3: "user user", 4: "system system user", 5: "system", 6: "user tool assistant",
        7: "user assistant user assistant", 8: "user system",
    }
    rows = [(c, t, r, "x") for c, s in said.items() for t, r in enumerate(s.split())]
    got = check(spark, rows)
    assert {c: (g.valid, g.bad_turn) for c, g in got.items()} == {
        0: (True, -1), 1: (True, -1), 2: (False, 0), 3: (False, 1), 4: (False, 1), 5: (False, -1), 6: (False, 1), 7: (True, -1), 8: (False, 1),
    }


def test_edges(spark):
    rows = [
        (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", None), (1, 0, "user", None), (1, None, "assistant", "first"),
        (None, 3, None, None), (2, 5, "assistant", "y" * 300000 + "\\" * 1000), (2, 5, "assistant", "a"),
    ]
    check(spark, rows)
    assert digests(spark, rows[:0]) == {}


def test_other_template(spark):
    template = chat.Template(
        roles={"human": chat.Turn("<human> ", " </human>\n"), "bot": chat.Turn("<bot> ", " </bot>\n", True)},
        order={"start": {"human": "human"}, "human": {"bot": "bot"}, "bot": {"human": "human"}}, accepting=("bot",),
    )
    df = spark.createDataFrame([(1, 0, "human", "<bot> hi </bot>"), (1, 1, "bot", "yo")], "conv_id long, turn long, role string, text string")
    r = chat.format_conversations(df, template).first()
    assert r.formatted == "<human> <\\bot> hi <\\/bot> </human>\n<bot> yo </bot>\n" and r.valid
    back = chat.format_conversations(df, template).select(chat.read_turns(chat.F.col("formatted"), template).alias("t")).first().t
    assert [(t.role, t.text) for t in back] == [("human", "<bot> hi </bot>"), ("bot", "yo")]


def test_plan_has_no_python(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")
    plan = chat.digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
