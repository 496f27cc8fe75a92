"""Harmonic packing of token sequences.

A piece of length l belongs to class k = capacity // l, that is capacity/(k+1) < l <= capacity/k, and a bin of
class k holds exactly k pieces. Each partition fills its own bins while its rows stream by, so nothing is
shuffled and the open bins (one a class) bound the memory. Documents are cut so that nearly all pieces have a
length of capacity/2^j, whose bins are filled without a rest.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailweave.llm.vocab import UnitEncoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
FIELDS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64())])


def cuts(length: int, capacity: int, grain: int) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then the rest's binary digits down to ``grain``, then what is left below it."""
    pieces = [capacity] * (length // capacity)
    rest, digit = length % capacity, capacity // 2
    while digit >= grain:
        if rest & digit:
            pieces.append(digit)
        digit //= 2
    if rest % grain:
        pieces.append(rest % grain)
    return pieces


class Packer:
    """Fills the bins of one partition; finished sequences are lists of (doc_id, start, ids, doc_tokens)."""

    def __init__(self, capacity: int, grain: int) -> None:
        self.capacity, self.grain = capacity, grain
        self.open: dict[int, list[tuple]] = {}

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[list[tuple]]:
        start = 0
        for length in cuts(len(ids), self.capacity, self.grain):
            kind = self.capacity // length
            held = self.open.setdefault(kind, [])
            held.append((doc_id, start, ids[start:start + length].copy(), len(ids)))
            start += length
            if len(held) == kind:
                yield self.open.pop(kind)

    def finish(self) -> Iterator[list[tuple]]:
        """What is left in open bins: exact classes give 2^i pieces at a time; the tails are cut into sequences of power-of-two length."""
        tails: list[tuple] = []
        for kind in sorted(self.open):
            held = self.open[kind]
            if kind & (kind - 1) or len(held[0][2]) * kind != self.capacity:
                tails += held
                continue
            while held:
                take = 1 << (len(held).bit_length() - 1)
                yield held[:take]
                held = held[take:]
        self.open = {}
        left = sum(len(x[2]) for x in tails)
        tails.reverse()
        while left:
            room = min(self.capacity, 1 << (left.bit_length() - 1))
            left -= room
            sequence = []
            while room:
                doc_id, start, ids, total = tails.pop()
                if len(ids) > room:
                    tails.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                sequence.append((doc_id, start, ids, total))
                room -= len(ids)
            yield sequence


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, grain: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``capacity`` tokens; one row per piece with its ids (little-endian uint32).

    ``tokenizer`` is a tokenizers file whose splitter drops white space; each document's ids are followed by
    ``end_id``. ``capacity`` and ``grain`` are powers of two. A null or empty text is the end id alone; a
    document longer than the capacity is cut; null and repeated doc_ids are packed row by row. Other columns
    are left out. Sequence ids are unique, numbered within the partition. An empty table gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, end = UnitEncoder(tokenizer, keeps_gaps=False), Packer(capacity, grain), np.array([end_id], "<u4").tobytes()
        sequence_id = TaskContext.get().partitionId() << 40
        rows: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal rows, size
            out = pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), FIELDS)], schema=FIELDS)
            rows, size = [], 0
            return out

        def emit(sequence: list[tuple]) -> None:
            nonlocal sequence_id, size
            offset = 0
            for doc_id, start, ids, total in sequence:
                rows.append((doc_id, start, len(ids), ids.tobytes(), total, sequence_id, offset))
                offset += len(ids)
            sequence_id += 1
            size += offset

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                for sequence in packer.add(doc_id, np.frombuffer(encoder.encode(text.as_py()) + end, "<u4")):
                    emit(sequence)
                if size > 1 << 20:
                    yield flush()
        for sequence in packer.finish():
            emit(sequence)
        if rows:
            yield flush()

    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, SCHEMA)
