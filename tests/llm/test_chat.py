"""op4_chat_formatting against plain Python: a row for each conversation, and all its turns in prompt or completion."""

import random

import pandas as pd
import pytest

from leafmill.llm.queries import QUERIES

SPARSE = [
    (2, [("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "c"), ("user", "d")]),
    (4, [("user", "a")]),
    (5, []),
    (400, [("assistant", "x"), ("user", "é\U0001f600"), ("assistant", "yy")]),
    (7_000_000_000, [("user", "a"), ("assistant", "yy"), ("user", "z")]),
    (7_000_000_002, [(None, "a"), ("assistant", None)]),
    (7_000_000_004, [("user", "only")]),
]


def dealt(seed):
    """Many conversations with keys far apart, for ranges that end between any two of them."""
    rng = random.Random(seed)
    keys = sorted(rng.sample(range(10**6), 400))
    return [(k, [(rng.choice(["user", "assistant", "system"]), f"t{k}.{i}") for i in range(rng.randint(1, 5))]) for k in keys]


def render(turns):
    out, spans = "", []
    for role, text in turns:
        out += f"<|{role}|>\n"
        start = len(out)
        out += f"{text}<|end|>\n"
        if role == "assistant":
            spans.append(f"{start}-{len(out)}")
    return out, ",".join(spans)


def brute_force(table):
    rows = table[table.conv_id.notna()].astype({"role": object, "text": object})
    rows = rows.where(rows.notna(), None)
    held = {}
    for k, turn, role, text in zip(rows.conv_id, rows.turn, rows.role, rows.text):
        held.setdefault(int(k), []).append((turn, role if role is not None else "unknown", text if text is not None else ""))
    held = {k: [t[1:] for t in sorted(turns)] for k, turns in held.items()}
    last = {k: max((i for i, t in enumerate(turns) if t[0] == "assistant"), default=None) for k, turns in held.items()}
    out, reply = {}, None
    for k in sorted(held, reverse=True):
        a, n = held[k], last[k]
        b = a if n is None else a[:n] if reply is None else [*a[:n], reply, *a[n + 1 :]]
        same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        chosen, rejected = render(a[same:]), render(b[same:])
        out[k] = (same, render(a[:same])[0], chosen[0], rejected[0], chosen[1], rejected[1])
        reply = reply if n is None else a[n]
    return out


@pytest.mark.parametrize("name", ["table", "sparse", "dealt", "alone", "empty"])
def test_every_conversation_and_turn_is_there(spark, tmp_path, name):
    table = pd.read_parquet("/root/testdata/sf0.001/conversations.parquet")
    if name != "table":
        held = {"sparse": SPARSE, "dealt": dealt(1), "alone": SPARSE[:1], "empty": []}[name]
        rows = [(k, i, role, text) for k, turns in held for i, (role, text) in enumerate(turns)]
        table = pd.DataFrame(rows, columns=table.columns).astype({"conv_id": "int64", "turn": "int64", "role": "string", "text": "string"})
    table.to_parquet(tmp_path / "conversations.parquet")
    rows = QUERIES["op4_chat_formatting"](spark, str(tmp_path)).collect()
    found = {r["conv_id"]: tuple(r)[1:] for r in rows}
    assert len(rows) == len(found) == table.conv_id.nunique()
    assert found == brute_force(table)
