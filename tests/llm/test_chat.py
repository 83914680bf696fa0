from collections import defaultdict

import pytest

from bitext.llm import chat

TURNS = "conv_id long, turn long, role string, text string, piece string"


def talks(spark, rows):
    return spark.createDataFrame([(*r, "extra") for r in rows], TURNS)


def brute(rows):
    """Maximal conversations by comparing every pair, least identifier first."""
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t, r, x))
    lists = {c: [(r, x) for _, r, x in sorted(v, key=lambda y: (y[0] is not None, y[0] or 0))] for c, v in by.items()}
    kept = {}
    for c, v in lists.items():
        if not any(len(w) > len(v) and w[: len(v)] == v for w in lists.values()):
            same = [d for d, w in lists.items() if w == v]
            kept[min((d for d in same if d is not None), default=None)] = v
    return {c: "".join(f"<|im_start|>{r or ''}\n{x or ''}<|im_end|>\n" for r, x in v) for c, v in kept.items()}


def test_against_all_pairs(spark):
    rows = []
    for c in range(40):
        for t in range(1 + c % 5):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", f"say {t if c % 3 else t * (c % 7)}"))
    rows += [(None, 0, "user", "alone"), (None, 1, None, None), (90, 0, None, ""), (91, 0, "", None), (92, 0, None, None), (92, 1, "user", "x"), (93, 0, None, None)]
    got = chat.format_chats(talks(spark, rows)).collect()
    assert {r.conv_id: r.text for r in got} == brute(rows)
    assert all(r.piece == 0 for r in got)


def test_null_turns_come_first_and_ties_are_stable(spark):
    rows = [(1, None, "system", "s"), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (2, None, "system", "s")]
    one, = chat.format_chats(talks(spark, rows)).collect()
    again, = chat.format_chats(talks(spark, rows[::-1])).collect()
    assert one == again and one.n_turns == 4 and one.text.startswith("<|im_start|>system\ns") and one.text.count("\na<") == 2


def test_long_conversation_in_pieces(spark):
    rows = [(1, t, "user", f"t{t}") for t in range(25)] + [(2, t, "user", f"t{t}") for t in range(24)]
    got = sorted(chat.format_chats(talks(spark, rows), piece_turns=10).collect(), key=lambda r: r.piece)
    assert [r.piece for r in got] == [0, 1, 2] and {r.n_turns for r in got} == {25}
    assert "".join(r.text for r in got) == brute(rows)[1]


def test_snapshots_of_equal_conversations(spark):
    rows = [(c, t, "user", f"t{t}") for c in (5, 3, 9) for t in range(3)]
    one, = chat.format_chats(talks(spark, rows)).collect()
    assert (one.conv_id, one.snapshots) == (3, 3)


def test_empty_table(spark):
    assert chat.format_chats(talks(spark, [])).collect() == []


@pytest.mark.parametrize("name", ["Python", "Pandas", "Arrow"])
def test_plan_is_native(spark, name):
    df = chat.format_chats(talks(spark, [(1, 0, "user", "x")]))
    assert name not in df._jdf.queryExecution().executedPlan().toString()
