"""Conversation repair against a plain cheapest-path search over every pair of (edits, cost)."""
import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from trailweave.llm import catalog, turns


def plain_repair(rows):
    """(cost, audit, repaired) by dynamic programming from the end: rows are (role, text, fault)."""
    states = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    n, inf = len(rows), (10**9, "")
    best = [[inf] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        options = defaultdict(list)
        for q, to in states.items():
            if i == n and q in (0, 3):
                options[q].append((0, ""))
            if i < n:
                role, _, fault = rows[i]
                options[q].append((best[i + 1][q][0] + 4, "D" + best[i + 1][q][1]))
                if fault not in ("blank", "duplicate"):
                    extra = 3 if fault else 0
                    if role[:1] in to:
                        after = best[i + 1][to[role[:1]]]
                        options[q].append((after[0] + extra, "K" + after[1]))
                    for letter in "ua":
                        if letter in to:
                            after = best[i + 1][to[letter]]
                            options[q].append((after[0] + extra + 3, "R" + after[1]))
        now = {q: min(options[q], default=inf) for q in states}
        for _ in range(4):  # inserts stay at the same turn
            for q, to in states.items():
                for letter in "ua":
                    if letter in to:
                        after = now[to[letter]]
                        now[q] = min(now[q], (after[0] + 3, "I" + after[1]))
        best[i] = [now[q] for q in range(4)]
    return best[0][0]


def applied(rows, audit):
    out, rest = [], iter(rows)
    size = sum(e != "D" for e in audit)
    for e in audit:
        role, text, _ = next(rest) if e != "I" else ("", "", None)
        if e == "D":
            continue
        if e in "IR":  # the last is the assistant, and roles go in turn
            role = "assistant" if (size - len(out)) % 2 else "user"
        out.append((role, text))
    assert next(rest, None) is None
    return out


def plain_audit(rows):
    """rows: (turn, role, text) of a conversation, sorted."""
    seen, marked, found = set(), [], defaultdict(int)
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else None
        seen.add((role, text))
        marked.append((role, text, fault))
        found[fault] += 1
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    cost, audit = plain_repair(marked)
    repaired = applied(marked, audit)
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in repaired))
    return gaps, found["blank"], found["duplicate"], found["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest()


def plain_damage(table):
    out = defaultdict(list)
    for conv_id, turn, role, text in table:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv_id is None else conv_id}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        rows = [] if kind == 0 else [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
        out[conv_id] += rows
    order = lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())
    return {k: sorted(v, key=order) for k, v in out.items()}


def compare(spark_rows, table):
    want = {k: plain_audit(v) for k, v in plain_damage(table).items()}
    got = {r[0]: (*r[1:6], r.cost, r.audit, r.repaired_sha256) for r in spark_rows}
    assert len(spark_rows) == len(got)
    assert got == want


@pytest.mark.parametrize("seed", range(4))
def test_letters(seed):
    rng = random.Random(seed)
    kinds = "suaSUAxX-"
    for _ in range(300):
        letters = "".join(rng.choice(kinds if rng.random() < 0.3 else "ua") for _ in range(rng.randrange(0, 14)))
        rows = [("" if c in "-xX" else {"s": "system", "u": "user", "a": "assistant"}[c.lower()], "", "blank" if c == "-" else "truncated" if c.isupper() else None) for c in letters]
        assert turns.cheapest(letters) == plain_repair(rows), letters


@pytest.mark.parametrize("size", [65, 700, 3000])
def test_long_conversations(size):
    rng = random.Random(size)
    letters = "".join(rng.choice("suaUAx-") if rng.random() < 0.2 else "ua"[k % 2] for k in range(size))
    rows = [("" if c in "-xX" else {"s": "system", "u": "user", "a": "assistant"}[c.lower()], "", "blank" if c == "-" else "truncated" if c.isupper() else None) for c in letters]
    assert turns.cheapest(letters) == plain_repair(rows)


def test_work_grows_with_the_number_of_turns(monkeypatch):
    """States that are opened per turn stay about the same at ten times the turns."""
    opened = []
    plain = turns.Search.edits
    monkeypatch.setattr(turns.Search, "edits", lambda self, state: opened.append(state) or plain(self, state))
    each = []
    for size in (1500, 15_000):
        opened.clear()
        rng = random.Random(size)
        turns.cheapest("".join(rng.choice("suaUAx-") if rng.random() < 0.2 else "ua"[k % 2] for k in range(size)))
        each.append(len(opened) / size)
    assert each[1] < 1.3 * each[0]


HAND = [
    (1, 0, "user", "Hello."), (1, 1, "assistant", "Hi."), (2, 0, "user", None), (2, 1, None, "x."), (2, None, "assistant", "ok!"), (None, 3, "user", "a."), (None, None, "tool", "b?"),
    (3, 5, "system", "s."), (3, 6, "system", "s."), (3, 9, "user", "no end"), (4, 0, "", "no role."), (4, 0, "assistant", "same turn."), (4, 0, "assistant", "same turn."),
    (5, 1, "user", " \t\n"), (6, 2, "assistant", "Ü😀."), (6, 1, "user", "Ü😀"), (7, 0, "user", "q" * 300_000), (7, 1, "assistant", "r" * 9_000_000 + "."), (8, 0, "user", " "),
] + [(100 + k, t, r, f"{t}.") for k in range(60) for t, r in enumerate(["system", "user", "assistant", "user", "assistant"])] + [(9, t, "ua"[t % 2] + "x", f"{t % 7} and so on.") for t in range(900)]


def test_hand_made(rows):
    data = [(c, t, r, x, "clash", 1) for c, t, r, x in HAND]
    df = rows(data, "conv_id long, turn long, role string, text string, audit string, gone int")
    compare(turns.audit(turns.damage(df.drop("gone"))).collect(), HAND)
    assert turns.audit(turns.damage(df.drop("gone").where("false"))).count() == 0


def test_repaired_rows(rows):
    data = [(1, 0, "user", "a."), (1, 1, "user", "b."), (2, 0, "assistant", "c."), (3, 0, "user", " ")]
    df = rows(data, "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in turns.repair(df).collect())
    assert got == [(1, 0, "K", "user", "a."), (1, 1, "R", "assistant", "b."), (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "c.")]


def test_whole_table(spark):
    table = catalog.table(spark, "/root/testdata/sf0.01", "conversations").collect()
    compare(catalog.QUERIES["op11_ida_repair"](spark, "/root/testdata/sf0.01").collect(), [tuple(r) for r in table])
