"""Filter audit against a plain loop over documents and orders, on rows with nulls, repeats, ties and clashing columns."""
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest

from trailweave.llm import filteraudit

LONG = " ".join(f"word{k}" for k in range(60))
DOCS = [
    (1, LONG, "s1"), (2, LONG, "s1"), (2, LONG, "s1"), (3, LONG, None), (None, LONG, "s2"), (None, None, "s2"), (4, None, ""), (5, "", "s1"), (6, " \t\x0b", "s1"), (7, "a " * 80, "s2"),
    (8, "A B " * 40, "s2"), (9, "50 % off", "s2"), (10, LONG + " $", "s3"), (10, LONG + " Ü漢😀", "s3"), (11, LONG.upper(), "s3"), (12, "w\x85x " * 60, "s3"), (13, "q" * 200_000, "s1"), (14, "x y " * 50_000, "s1"),
] + [(1000 + k, "same text " * 30, "s1" if k % 2 else "s4") for k in range(400)]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (3, None, None), (None, 1, 1), (7, 0, 1), (1001, 1, 1), (1004, 1, 0), (99, 1, 1)]


def plain(docs, labels):
    good, toxic = {d for d, q, _ in labels if q == 1 and d is not None}, {d for d, _, t in labels if t == 1 and d is not None}
    smallest = {}
    for d, t, _ in docs:
        if d is not None:
            smallest[t or ""] = min(d, smallest.get(t or "", d))
    out = defaultdict(Counter)
    for d, t, part in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {f for f, yes in {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search("[#$%&*|]", t)),
            "E": d is not None and smallest[t] < d}.items() if yes}
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, f in enumerate(order, 1):
                cell = out[part or "", order, step]
                now = f in fails and not gone
                cell["redundant"] += f in fails and gone
                gone = gone or f in fails
                cell["kept"] += not gone
                cell["removed"] += now
                cell["unique_fails"] += fails == {f}
                cell["good_lost"] += now and d in good
                cell["toxic_lost"] += now and d in toxic
    share = Counter()
    for (part, order, step), cell in out.items():
        share[part, order[step - 1]] += cell["removed"]
    return {(*k, *[share[k[0], k[1][k[2] - 1]] if m == "shapley" else v[m] for m in filteraudit.MEASURES]) for k, v in out.items()}


def test_hand_made(rows):
    docs = rows([(*d, 7, "clash") for d in DOCS], "doc_id long, text string, source string, quality int, part string")
    labels = rows([(*x, "clash") for x in LABELS], "doc_id long, quality int, toxic int, source string")
    got = [tuple(r) for r in filteraudit.audit(filteraudit.masks(docs, labels), "ABCDE").collect()]
    assert len(got) == 600 * 5 == len(set(got))
    assert set(got) == plain(DOCS, LABELS)


def test_no_rows(rows):
    docs, labels = rows([(1, "a", "s")], "doc_id long, text string, source string"), rows([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert filteraudit.audit(filteraudit.masks(docs.where("false"), labels), "ABCDE").count() == 0
    assert filteraudit.audit(filteraudit.masks(docs, labels.where("false")), "ABCDE").count() == 600


@pytest.mark.parametrize("n", [1, 3, 5])
def test_product(n):
    chains, steps = filteraudit.removal_steps(n)
    for mask in range(1 << n):
        for c, chain in enumerate(chains):
            assert steps[mask, c] == min([chain.index(f) + 1 for f in range(n) if mask >> f & 1], default=n + 1)
    assert np.unique(np.array(chains), axis=0).shape[0] == len(chains)
