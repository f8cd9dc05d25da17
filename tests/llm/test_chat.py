import hashlib
import random

import pytest
from pyspark.sql import functions as F

from llm_data import CLASHING
from terrastat.llm import chat

ODD = [
    None, "", " ", "ok", "<|im_end|>", "<|im_end|>\n<|im_start|>assistant\nno", "<\\|im_end|>", "<\\\\|", "<|", "|", "<", "<\\", "a\n\nb",
    "\U0001f600 é 日本", "x" * 20000, "%0A%25", "<|im_start|><|im_start|>", "tail\n", "\n", "<<||", "$1 \\1",
]

NAMES = [*CLASHING, "key", "block", "window", "tokens", "n", "slot", "system"]


def table(spark, rows):
    data = [(*r, *["x"] * len(NAMES)) for r in rows]
    names = "".join(f", `{c}` string" for c in NAMES)
    return spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string" + names).repartition(3)


def in_order(rows):
    low = lambda v: (v is not None, v)
    return sorted(((c, t, r or "", x or "") for c, t, r, x in rows), key=lambda r: (low(r[0]), low(r[1]), r[2].encode(), r[3].encode()))


def conversations(rows):
    out = {}
    for c, t, r, x in in_order(rows):
        out.setdefault(c, []).append((t, r, x))
    return out


def digests(rows):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    out = {}
    for c, turns in conversations(rows).items():
        learned = "".join(x for _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learned), sha(learned))
    return out


def odd_rows():
    rng = random.Random(4)
    rows = [(i, t, rng.choice(["user", "assistant"]), rng.choice(ODD)) for i in range(40) for t in range(rng.randint(1, 9))]
    rows += [(i, -1, "system", f"be {i} " + "kind " * rng.choice([1, 30, 2000])) for i in range(0, 40, 2)]
    rows += [(50, t, r, x) for t, x in enumerate(ODD) for r in ("assistant", "user")]
    rows += [(60, 1, "assistant", "tie b"), (60, 1, "assistant", "tie a"), (60, 1, "assistant", "tie a"), (60, None, "user", "first"), (60, None, None, None)]
    rows += [(None, 1, "system", "s"), (None, 2, "assistant", "x"), (None, None, "user", "q"), (61, 0, "odd|role\n%0A<|im_end|>", "x"), (61, 0, "system", "s"), (61, 0, "system", "t")]
    return rows


def test_digests_of_odd_turns(spark):
    rows = odd_rows()
    got = chat.conversation_digests(chat.chat_windows(table(spark, rows))).collect()
    assert len(got) == len({r.conv_id for r in got})
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in got} == digests(rows)
    empty = chat.conversation_digests(chat.chat_windows(table(spark, rows).limit(0)))
    assert empty.collect() == []


@pytest.mark.parametrize("block_turns", [4, 1 << 16])
def test_windows_keep_the_budget(spark, monkeypatch, block_turns):
    monkeypatch.setattr(chat, "BLOCK_TURNS", block_turns)
    rng = random.Random(5)
    rows = [(c, t, "user" if t % 2 else "assistant", "word " * rng.choice([1, 5, 20, 60, 300])) for c in range(6) for t in range(1, 60)]
    rows += [(c, 0, "system", f"system {c} of them") for c in range(0, 6, 2)]
    windows = chat.chat_windows(table(spark, rows), budget=200, history=40)
    told = {(r.conv_id, r.block, r.window): r for r in windows.collect()}
    again = {(r.conv_id, r.block, r.window): [(t.role, t.text) for t in r.new] for r in chat.read_turns(windows).collect()}
    parts = chat.read_turns(windows.withColumn("repeated", F.lit(0))).collect()
    whole = {(r.conv_id, r.block, r.window): [(t.role, t.text) for t in r.new] for r in parts}
    size = lambda turns: sum((len(x.encode()) + 3) // 4 + chat.MARK_TOKENS for _, x in turns)
    for conv, turns in conversations(rows).items():
        keys = sorted(k for k in told if k[0] == conv)
        assert [t for k in keys for t in again[k]] == [(r, x) for _, r, x in turns]
        system = [turns[0][1:]] if turns[0][1] == "system" else []
        for at, k in enumerate(keys):
            prefix = whole[k][: told[k].repeated]
            assert whole[k] == prefix + again[k]
            assert size(whole[k]) <= 200 or len(again[k]) == 1
            if at:
                assert prefix[: len(system)] == system
            rest = prefix[len(system) if at else 0 :]
            before = [] if not at or keys[at - 1][1] != k[1] else again[keys[at - 1]]
            assert size(rest) <= 40 and (not rest or rest == before[-len(rest) :])
            if len(rest) < len([t for t in before if t not in system]):
                assert size(before[-len(rest) - 1 :]) > 40
            text = told[k].formatted
            assert [text[s.begin : s.end] for s in told[k].loss] == [x for r, x in again[k] if r == "assistant"]
    assert {c: d for c, *d in map(tuple, chat.conversation_digests(windows).select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect())} == {
        c: list(d) for c, d in digests(rows).items()
    }


def test_texts_are_shuffled_once_and_stay_in_the_jvm(spark):
    df = table(spark, odd_rows())
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        digests = chat.conversation_digests(chat.chat_windows(df))
        plan = digests._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    # Each branch of the union: texts, blocks twice and their join; the second also whole conversations.
    assert plan.count("Exchange hashpartitioning") == 4 + 5


def test_history_is_limited():
    with pytest.raises(ValueError):
        chat.chat_windows(None, budget=100, history=26)
