"""Personal data against Python's own regular expressions, fingerprints and shards against plain loops."""
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from trailweave.llm import catalog, pii, shards, winnow

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TEXTS = ["a@b.c_d@e.f x@y.zz 300.1.1.1 1.2.3.4.5.6.7.8 +1 (017) 555-7713, 4111 1111 1111 1111 and 378282246310005 é😀 x@y.com", None, "", "no data",
         "+1 +22 33 44 55 66 ", "0000.1.2.3 000000255.1.1.1 11.22.33", "4111-1111-1111-1112 4111111111111111 +1 (826) 555-4081 190.1.2.3", "x@y", "a" * 50000 + "@",
         "1" * 50000, "a@" + "b." * 20000 + "c", "+" * 20000 + "1", "u@v.w " * 300, "a@b.c", "a@b.c",
         "4111 1111 1111 1111@x.com +1 555 123 4567@x.com!", "é😀" * 4090 + "ab@c.de" + "x" * 5000 + " 😀é@ " + "1.2.3.4 " * 900]


def luhn(number):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(number))) % 10 == 0


def base(text):
    found = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            n = re.sub(r"\D", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in m[0].split(".")), "card": 16 <= len(n) <= 19 and luhn(n), "phone": 8 <= len(n) <= 15}[kind]
            if good:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


@pytest.fixture(scope="module")
def docs(rows):
    return rows([(k, t, "clash", 1) for k, t in enumerate(TEXTS)], "doc_id long, text string, kind string, start int")


def test_base_spans(docs):
    got = {r.doc_id: r for r in pii.report(pii.find(docs)[0]).collect()}
    assert len(got) == len(TEXTS)
    for k, text in enumerate(TEXTS):
        want = base(text or "")
        assert got[k].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert set(want) <= set(filter(None, got[k].spans.split(",")))
        assert [got[k][f"n_{kind}"] for kind in PATTERNS] == [sum(w.startswith(kind) for w in want) for kind in PATTERNS]
    assert got[3].spans == ""


def test_redaction_leaves_no_base_span(docs):
    _, model = pii.fit(docs)
    got = {r.doc_id: r for r in pii.redact(docs, model).collect()}
    assert got[1].text is None and got[2].text == "" and got[3].text == "no data" and got[0].kind == "clash"
    assert got[12].text == "[EMAIL] " * 300
    found = {r.doc_id: r.spans for r in pii.report(pii.find(docs, model=model)[0]).collect()}
    for k, text in enumerate(TEXTS):
        spans = sorted([tuple(map(int, x.split(":")[1:])) + (x.split(":")[0],) for x in filter(None, found[k].split(","))], key=lambda x: (x[0], -x[1]))
        parts, end = [], 0
        for a, b, kind in spans:
            if a >= end:
                parts += [(text or "")[end:a], f"[{kind.upper()}]"]
            end = max(end, b)
        assert (got[k].text or "") == "".join(parts) + (text or "")[end:]
    assert "[CARD].com" not in got[15].text and got[15].text == "[CARD] [PHONE]!"


def test_no_rows_and_no_ids(docs, rows):
    assert pii.report(pii.find(docs.where("false"))[0]).count() == 0
    assert [r.n_email for r in pii.report(pii.find(rows([(None, "a@b.c"), (None, "a@b.c")], "doc_id long, text string"))[0]).collect()] == [1, 1]


def plain_choice(hashes, window):
    if not hashes:
        return []
    out = []
    for i in range(max(1, len(hashes) - window + 1)):
        part = hashes[i:i + window]
        j = max(x for x in range(len(part)) if part[x] == min(part))
        if not out or out[-1] != i + j:
            out.append(i + j)
    return out


WORDS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
LONG_TEXTS = [(3, WORDS), (1, WORDS + " " + WORDS), (2, "a b a b a b a b a b a b a b a b a b"), (None, None), (9, ""), (7, "only three words"), (8, "漢字かな" * 10), (10, WORDS.upper() + "!"),
              (4, " \n "), (5, WORDS), (6, WORDS)]


def test_winnowing(rows):
    df = rows([(k, t, "x") for k, t in LONG_TEXTS], "doc_id long, text string, hashes string")
    got = winnow.edited_pairs(df).collect()
    assert len(got) == len(LONG_TEXTS)
    order = sorted(LONG_TEXTS, key=lambda x: (x[0] is not None, x[0] or 0))
    by_id = {r.doc_id: r for r in got}
    for n, (k, t) in enumerate(order):
        t, after = t or "", order[(n + 1) % len(order)][1] or ""
        half = len(t) // 2
        assert by_id[k].edited == t[:len(t) - half] + after[:half]
        assert by_id[k].next_hashes == by_id[order[(n + 1) % len(order)][0]].hashes
    assert by_id[3].hashes == by_id[5].hashes and by_id[9].hashes == [] and len(by_id[7].hashes) == 1 and len(by_id[8].hashes) > 2
    assert set(by_id[3].hashes) <= set(by_id[1].hashes)  # a passage of twenty words keeps its inner choices
    near = {r.doc_id: r for r in winnow.edited_pairs(df).select("doc_id", winnow.likeness(F.col("hashes"), F.col("next_hashes")).alias("x")).collect()}
    assert near[5].x == 1.0 and near[6].x == 0.0 and near[9].x == 0.0
    assert winnow.edited_pairs(df.where("false")).count() == 0
    alone = winnow.edited_pairs(rows([(1, "ab cd")], "doc_id long, text string")).collect()
    assert [r.edited for r in alone] == ["ab ab"]


def test_choice_of_windows(rows):
    lists = [[5, 1, 1, 4, 7, 7, 0, 3, 3, 0, 9, 9, 9, 9, 9, 9], [1], [2, 2], list(range(30)), list(range(30, 0, -1)), [4] * 20, []]
    df = rows(list(enumerate(lists)), "id int, h array<bigint>")
    for window in (1, 4, 8):
        got = {r.id: r.p for r in winnow.chosen(df, "h", "p", window).collect()}
        assert got == {k: plain_choice(h, window) for k, h in enumerate(lists)}


@pytest.mark.parametrize("limit, spare", [(10**9, 4), (5000, 0), (700, 2)])
def test_shards(rows, limit, spare):
    data = [(k, (k * 37) % 400 + 1, "clash") for k in range(300)] + [(1000, 100, "c")] * 30 + [(None, 5, "c"), (2000, None, "c"), (2001, 10_000, "c")]
    df = rows(data, "doc_id long, n_bytes long, shard string")
    got = shards.assign(df, limit, F.col("doc_id"), F.col("n_bytes"), spare, 3).select("doc_id", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes"), "shard", "depth", "shard_bytes", "shard_docs")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, repeat('x', ?))", [(d, n or 0) for d, n, _ in data])
    want = con.sql(catalog.ORACLES["op9_extendible_hashing"].replace(str(catalog.SHARD_BYTES), str(limit))).fetchall()
    assert sorted(map(str, map(tuple, got.distinct().collect()))) == sorted(map(str, set(want)))
    assert all(r.shard_bytes <= limit or r.shard_docs == 1 or r.depth == shards.BITS for r in got.collect())
    entries = shards.directory(got).orderBy("first_entry").collect()
    assert all(a.last_entry < b.first_entry for a, b in zip(entries, entries[1:]))
    assert shards.assign(df.where("false"), limit, F.col("doc_id"), F.col("n_bytes")).count() == 0
