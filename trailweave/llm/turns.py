"""Repair of conversation structure by iterative-deepening A*.

A conversation is valid if the first letters of its roles read ``(s?(ua)+)?``: perhaps a system turn, then user
and assistant in turn. The search walks the turns from the first, trying the edits Delete, Insert, Keep, Rerole
in this order (their ASCII order) depth-first below a cost bound that rises from one feasible value to the next,
so the first path that ends in a valid conversation is cheapest and, of the cheapest, has the least audit. A
transposition table over (turn, what the pattern expects) holds for every state that failed a lower bound of the
cost still to come, which later visits and later bounds use.

Turns leave Spark sorted by conversation; a conversation's letters (a byte a turn) and the digests of its turns
are held while its texts wait in a spooled file, so no text needs to fit in memory. A conversation is one task's
work, because its digest is one chain of SHA-256 steps.
"""
from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Prices of the edits, white space that doesn't count as text, and marks that end a sentence.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
BLANKS = " \t\n\x0b\f\r"
ENDS = ".!?"
LEGAL_PAIRS = {"su", "ua", "au"}

#: What the pattern expects: 0 anything or the end, 1 a user after system, 2 an assistant, 3 a user or the end.
FOLLOWS = [{"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2}]
#: The only role of user and assistant that each state allows.
OPEN = ["u", "u", "a", "u"]
ENDING = {0, 3}

#: A turn as the search sees it: its role's letter, in capitals if truncated; "-" if it must go; "x" and "X" for other roles.
MUST_GO, OTHER = "-", "x"

#: Stands for the end of a path.
END = -1

#: Turns that are added to the solved end at a time.
STRIDE = 48


def least(letter: str) -> int:
    """The least any edit of a turn costs, wherever it stands."""
    if letter == MUST_GO:
        return DELETE
    fixed = TRUNCATED if letter.isupper() else 0
    return min(DELETE, fixed + (REROLE if letter.lower() == OTHER else 0))


class Search:
    """The search over one conversation's letters."""

    def __init__(self, letters: str) -> None:
        self.letters, self.n = letters, len(letters)
        self.bound = [0] * (4 * (self.n + 1))
        self.solved: dict[int, tuple[str, int]] = {}  # the least path to the end or to the next solved state, and that state
        self.owed = [0] * (self.n + 1)  # by the turns from each on, whatever their neighbours
        for i in range(self.n - 1, -1, -1):
            self.owed[i] = self.owed[i + 1] + least(letters[i])
            self.bound[4 * i:4 * i + 4] = [self.owed[i]] * 4
        for q in {0, 1, 2, 3} - ENDING:  # what is owed at the end has to be inserted
            self.bound[4 * self.n + q] = INSERT * (2 if q == 1 else 1)

    def edits(self, state: int) -> list[tuple[str, int, int]]:
        """(edit, cost, next state) in ASCII order."""
        i, q = divmod(state, 4)
        role = OPEN[q]
        insert = ("I", INSERT, 4 * i + FOLLOWS[q][role])
        if i == self.n:
            return [insert]
        letter, after = self.letters[i], 4 * (i + 1)
        out = [("D", DELETE, after + q), insert]
        if letter != MUST_GO:
            fixed, kept = TRUNCATED if letter.isupper() else 0, FOLLOWS[q].get(letter.lower())
            if kept is not None:
                out.append(("K", fixed, after + kept))
            out.append(("R", fixed + REROLE, after + FOLLOWS[q][role]))
        return out

    def descend(self, start: int, limit: int) -> tuple[str, int] | None:
        """The first accepting path from ``start`` that costs at most ``limit``, up to the end or a solved state; without one, the
        bounds of the failed states rise. No path from a solved state is below its bound, so what may be spent there is just that."""
        bound = self.bound
        path, stack = [], [[start, limit, None, 0]]  # state, what may be spent, its edits, how many were tried
        while stack:
            frame = stack[-1]
            state, left, tries, k = frame
            if tries is None:
                if state // 4 == self.n and state % 4 in ENDING:
                    return "".join(path), END
                if state in self.solved:
                    return "".join(path), state
                tries = frame[2] = self.edits(state)
            while k < len(tries) and bound[tries[k][2]] > left - tries[k][1]:
                k += 1
            if k == len(tries):
                bound[state] = max(bound[state], min(cost + bound[to] for _, cost, to in tries))
                stack.pop()
                if path:
                    path.pop()
                continue
            frame[3] = k + 1
            edit, cost, to = tries[k]
            path.append(edit)
            stack.append([to, left - cost, None, 0])
        return None

    def settle(self, start: int) -> None:
        """Solve a state: its bound rises from one feasible cost to the next until a path is found."""
        while start not in self.solved:
            found = self.descend(start, self.bound[start])
            if found:
                self.solved[start] = found

    def lift(self, i: int) -> None:
        """Every path passes turn ``i`` in one of its solved states: raise the bounds of the ``STRIDE`` turns before it by what even the cheapest costs more."""
        more = min(self.bound[4 * i:4 * i + 4]) - self.owed[i]
        for state in range(4 * max(0, i - STRIDE), 4 * i):
            self.bound[state] = max(self.bound[state], self.owed[state // 4] + more)

    def solve(self, start: int) -> tuple[int, str]:
        """Cost and audit of the cheapest path from a state, ties to the ASCII-least audit."""
        self.settle(start)
        parts, state = [], start
        while state in self.solved:
            part, state = self.solved[state]
            parts.append(part)
        return self.bound[start], "".join(parts)


@lru_cache(1 << 14)
def _short(letters: str) -> tuple[int, str]:
    return cheapest(letters)


def cheapest(letters: str) -> tuple[int, str]:
    """(cost, audit) for a conversation given by its letters.

    The end is searched first, ``STRIDE`` turns more at a time, with one table for all: when the whole is searched, the
    bounds of later states are true or close, so work grows with the number of turns and not with its square.
    """
    search = Search(letters)
    for i in range((search.n - 1) // STRIDE * STRIDE, 0, -STRIDE):
        for q in range(4):
            search.settle(4 * i + q)
        search.lift(i)
    return search.solve(0)


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) damaged by crc32 of ``conv_id:turn`` mod 20; nulls in that key, in role and in text are one space.

    0 drops a row, 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it, 4 makes its role user. A dropped row
    stays as a mark of its conversation: null role, ``gone`` true. Other columns are left out.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    read = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    gone = F.col("kind") == 0
    rows = read.select("conv_id", *[F.when(~gone, c).alias(n) for n, c in (("turn", F.col("turn")), ("role", role), ("text", text))], gone.alias("gone"), "kind")
    return rows.withColumn("_copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy", "kind")


def dealt(turns: DataFrame) -> DataFrame:
    """Turns of a conversation together and in order: by turn, nulls first, equal turns by role and text."""
    gone = F.col("gone") if "gone" in turns.columns else F.lit(False)
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                        *[F.when(~gone, text(c)).alias(c) for c in ("role", "text")], gone.alias("gone"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


class Conversation:
    """One conversation as it passes by: its letters and counts are kept, its texts wait in a file that lies on disk when large."""

    def __init__(self, conv_id: int | None) -> None:
        self.row = {"conv_id": conv_id, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
        self.letters, self.seen, self.last = [], set(), None
        self.first, self.latest, self.turns = None, None, 0
        self.spool = tempfile.SpooledTemporaryFile(8 << 20)
        self.sizes: list[tuple[int, int]] = []

    def add(self, turn: int | None, role: str, text: str) -> None:
        role_bytes, text_bytes = role.encode(), text.encode()
        key = hashlib.blake2b(b"%d:" % len(role_bytes) + role_bytes + text_bytes, digest_size=16).digest()
        shown = text.rstrip(BLANKS)
        fault = "blank" if not shown else "duplicate" if key in self.seen else "truncated" if shown[-1] not in ENDS else None
        self.seen.add(key)
        if fault:
            self.row[fault] += 1
        if self.last is not None and self.last + role[:1] not in LEGAL_PAIRS:
            self.row["illegal"] += 1
        self.last = role[:1]
        letter = role[:1] if role[:1] in ("s", "u", "a") else OTHER
        self.letters.append(MUST_GO if fault in ("blank", "duplicate") else letter.upper() if fault else letter)
        if turn is not None:
            self.turns += turn != self.latest
            self.first, self.latest = turn if self.first is None else self.first, turn
            self.row["gaps"] = self.latest - self.first + 1 - self.turns
        self.sizes.append((len(role_bytes), len(text_bytes)))
        self.spool.write(role_bytes + text_bytes)

    def close(self) -> None:
        letters = "".join(self.letters)
        self.row["cost"], self.row["audit"] = _short(letters) if len(letters) <= 64 else cheapest(letters)

    def repaired(self) -> Iterator[tuple[str, str, str]]:
        """(edit, role, text) of the conversation's turns after the edits; deleted ones are left out."""
        self.spool.seek(0)
        rows, state = iter(self.sizes), 0
        for edit in self.row["audit"]:
            role = text = ""
            if edit != "I":
                n_role, n_text = next(rows)
                role, text = self.spool.read(n_role).decode(), self.spool.read(n_text).decode()
            if edit == "D":
                continue
            letter = OPEN[state] if edit in "IR" else role[0]
            if edit in "IR":
                role = {"u": "user", "a": "assistant"}[letter]
            state = FOLLOWS[state][letter]
            yield edit, role, text


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[Conversation]:
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for conv_id, turns in groupby(rows, key=lambda r: r[0]):
        conversation = Conversation(conv_id)
        for _, turn, role, text, gone in turns:
            if not gone:
                conversation.add(turn, role, text)
        conversation.close()
        yield conversation
        conversation.spool.close()


def _batched(batches: Iterator[pa.RecordBatch], made: Callable[[Conversation], Iterator[dict]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Records of all conversations, in batches of about 8 MB of text or 4,000 rows."""
    waiting, size = [], 0
    for conversation in _conversations(batches):
        for row in made(conversation):
            waiting.append(row)
            size += len(row.get("text") or "") + len(row.get("audit") or "")
            if len(waiting) >= 4000 or size > 8 << 20:
                yield pa.RecordBatch.from_pylist(waiting, schema)
                waiting, size = [], 0
    if waiting:
        yield pa.RecordBatch.from_pylist(waiting, schema)


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def audit(turns: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256), a row per conversation.

    ``turns`` is (conv_id, turn, role, text) and perhaps ``gone``, true on rows that only name their conversation. Null roles
    and texts count as one space, null conv_ids are one conversation, null turns come first; turns of one number go
    by role and text; repeated rows are duplicates; a role without a letter is like any other that the pattern
    doesn't know. ``gaps`` are the numbers missing between first and last turn, ``illegal`` the neighbours that
    the pattern never allows. A conversation without turns has zeros and the digest of the empty text.
    """
    schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in COUNTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def made(conversation: Conversation) -> Iterator[dict]:
        digest, between = hashlib.sha256(), ""
        for _, role, text in conversation.repaired():
            digest.update(f"{between}{role}:{text}".encode())
            between = "\n"
        yield conversation.row | {"repaired_sha256": digest.hexdigest()}

    return dealt(turns).mapInArrow(lambda batches: _batched(batches, made, schema), ", ".join(
        ["conv_id long", *[f"{c} long" for c in COUNTS], "audit string", "repaired_sha256 string"]))


def repair(turns: DataFrame) -> DataFrame:
    """(conv_id, position, edit, role, text): the repaired conversations, a row per turn that stays or is inserted, in order from 0.

    Takes what ``audit`` takes; conversations that end up empty have no rows.
    """
    schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])

    def made(conversation: Conversation) -> Iterator[dict]:
        for position, (edit, role, text) in enumerate(conversation.repaired()):
            yield {"conv_id": conversation.row["conv_id"], "position": position, "edit": edit, "role": role, "text": text}

    return dealt(turns).mapInArrow(lambda batches: _batched(batches, made, schema), "conv_id long, position long, edit string, role string, text string")
