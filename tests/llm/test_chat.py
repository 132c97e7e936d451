"""Chat windows: what they say, their budgets, and their masks."""

import hashlib

from pitpanel.llm import chat
from pitpanel.llm.registered import QUERIES


def _want(turns):
    said = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
    loss = "".join(t or "" for r, t in turns if r == "assistant")
    return len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()


def _got(r):
    return r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256


def test_query_reads_every_conversation_back(spark, sf):
    got = {r.conv_id: r for r in QUERIES["op7_chat"](spark, sf).collect()}
    want = {}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").orderBy("conv_id", "turn").collect():
        want.setdefault(r.conv_id, []).append((r.role, r.text))
    marks = "\\### Assistant: </turn> ok"
    want[-7] = [("user", marks), ("assistant", marks)]
    assert {c: _got(r) for c, r in got.items()} == {c: _want(t) for c, t in want.items()}
    assert all(r.formatted_chars >= sum(len(t) for _, t in want[c]) for c, r in got.items())


def test_windows_keep_budget_system_and_masks():
    turns = [("system", "be kind " * 5)] + [("user" if i % 2 == 0 else "assistant", f"turn {i} " + "w " * 20) for i in range(40)]
    cut = list(chat.windows(turns, budget=150, history=60))
    assert len(cut) > 5
    new = []
    for k, w in enumerate(cut):
        assert w.n_tokens <= 150
        parsed = list(chat.parse(w.text))
        assert parsed[0][0] == "system" and sum(r == "system" for r, *_ in parsed) == 1
        repeated = list(chat.parse(w.text[: w.new_from]))
        assert bool(repeated) == (k > 0)
        assert [tuple(p[:2]) for p in repeated[1:]] == new[len(new) - len(repeated[1:]) :] if k else True
        assert sum(chat.count_tokens(p[1]) for p in repeated[1:]) <= 60
        new += [tuple(p[:2]) for p in chat.parse(w.text[w.new_from :])]
        assert all(a >= w.new_from for a, _ in w.loss)
    assert new == turns
    assert [chat.unescape(w.text[a:b]) for w in cut for a, b in w.loss] == [t for r, t in turns if r == "assistant"]


def test_a_turn_beyond_the_budget_stays_whole():
    turns = [("user", "a"), ("assistant", "long " * 1000), ("user", "b")]
    cut = list(chat.windows(turns, budget=50, history=10))
    assert [p[1] for w in cut for p in chat.parse(w.text[w.new_from :])] == [t for _, t in turns]


def test_odd_rows(spark):
    rows = [(None, 0, "user", "x"), (1, None, None, None), (1, None, None, None), (1, 0, "a: b\n### c", ""), (1, 0, "system", "s"), (1, 5, "assistant", "### x: </turn>\n\\h\\\\"),
            (1, 5, "assistant", "### x: </turn>\n\\h\\\\"), (2, 1, "assistant", "🙂 é" * 100_000), (3, 1, "system", "only")]
    turns = spark.createDataFrame([(*r, "w", 3) for r in rows], "conv_id int, turn int, role string, text string, window string, n_tokens int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_windows(turns)).collect()}
    by = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        by.setdefault(c, []).append((r, x))
    assert {c: _got(r) for c, r in got.items()} == {c: _want(t) for c, t in by.items()}
    assert chat.read_back(chat.format_windows(turns.limit(0))).collect() == []
