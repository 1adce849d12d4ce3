"""Conversations against a plain state machine, with parts so short that they need several levels."""

import random

import pytest

from heronq.operators.dialogue import conversation_report, transcripts

DUE = {None: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}}


def plainly(rows):
    report, said = [], {}
    for conv in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == conv]
        real = [r for r in mine if r[1] is not None and r[1] >= 0]
        first = {}
        for _, turn, role, text in sorted(real, key=lambda r: (r[1], r[2] is None, r[2] or "", r[3] is None, r[3] or "")):
            first.setdefault(turn, (role, text))
        state, out = None, 0
        for turn in sorted(first):
            role, text = first[turn]
            part = said.setdefault((conv, turn), None)
            if role in DUE[state]:
                state, part = role, f"<|{role}|>{text or ''}"
            else:
                out += 1
            said[conv, turn] = part
        missing = max(first, default=-1) + 1 - len(first)
        repeated, stray = len(real) - len(first), len(mine) - len(real)
        report.append((conv, len(mine), len(first), missing, repeated, stray, out, state, missing + repeated + stray + out == 0 and state == "assistant"))
    return sorted(report, key=str), said


def in_parts(said, part):
    out = {}
    for (conv, turn), text in sorted(said.items(), key=lambda x: x[0][1]):
        out.setdefault((conv, turn // part), []).append((turn, text))
    return sorted(((c, p, v[0][0], sum(t is not None for _, t in v), sum(t is None for _, t in v), "\n".join(t for _, t in v if t is not None)) for (c, p), v in out.items()), key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    roles = ["user", "assistant", "user", "assistant", "system", None, "User", "tool"]
    out = []
    for conv in [*range(12), None]:
        turns = rng.sample(range(60), rng.randrange(1, 40)) + [rng.choice([0, 3, 5, None, -1]) for _ in range(4)]
        out += [(conv, t, rng.choice(roles), rng.choice(["", None, "yes", "no\n"])) for t in turns]
    out += [(50, t, ["user", "assistant"][t % 2], f"t{t}") for t in range(1200)]  # one very long conversation
    out += [(51, t, r, "x") for t, r in enumerate(["system", "user", "assistant"])] + [(52, None, "user", "x"), (53, 10**12, "user", "far")]
    return out + [(50, 7, "assistant", "t7")] * 3 + [(54, 0, "user", "same")] * 300


@pytest.mark.parametrize("part", [4, 512])
def test_against_a_plain_machine(spark, rows, part):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, state string, n int")
    report, said = plainly(rows)
    assert sorted((tuple(r) for r in conversation_report(df, part).collect()), key=str) == report
    assert sorted((tuple(r) for r in transcripts(df, part).collect()), key=str) == in_parts(said, part)


def test_empty_table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").limit(0)
    assert conversation_report(df).count() == 0 and transcripts(df).count() == 0
