"""Byte-level BPE encoding and decoding with the tiktoken library and a local rank file.

Both directions are maps over Arrow batches: no shuffle, one document at a time, memory bounded by
the batch (Spark bounds batches in rows and bytes) plus one text.
"""
from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LONG_TEXT = 1 << 16
#: After one of these letters or digits and before one of these other characters every match of the pattern ends.
SAFE = re.compile(r"(?<=[0-9A-Za-zÀ-ÖØ-öø-ÿЀ-ҁ一-鿿])(?=[\t-\r .,;:!?()\"\[\]{}<>=*#&%$|/\\-])")
#: Runs of white space too long for the library's look-ahead.
WIDE_GAP = re.compile("[\t-\r \x85\xa0  -     　]{10000,}")


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, size: int = LONG_TEXT) -> Iterator[str]:
    """Cut a long text at safe boundaries; the matches in the chunks are those in the text."""
    at = 0
    while len(text) - at > size:
        cut = SAFE.search(text, at + size)
        if not cut:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = LONG_TEXT) -> list[int]:
    """Ids of one text. A very wide gap is one match up to its last character, or to the text's end."""
    if len(text) <= size:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    at = 0
    for gap in WIDE_GAP.finditer(text):
        for part in chunks(text[at:gap.start()], size):
            ids += enc.encode_ordinary(part)
        at = gap.end() if gap.end() == len(text) else gap.end() - 1
        ids += enc._encode_single_piece(text[gap.start():at])
    for part in chunks(text[at:], size):
        ids += enc.encode_ordinary(part)
    return ids


def encode(docs: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens long, ids binary): ids as little-endian unsigned 32-bit integers, without special tokens.

    A null text counts as empty: no ids, empty binary. Null or repeated doc_ids stay as they are, one row per
    input row. Other columns are left out, so their names can't clash. Each task reads the rank file, which must
    lie at the same path on every worker.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            ids = [np.array(encode_text(enc, text.as_py() or ""), "<u4") for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())],
                                             ["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, rank_file: str, pattern: str = public_tokenizers.PATTERN, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, n_tokens long, ids binary, decoded binary): the raw bytes of the ids, also where they are no valid UTF-8.

    Null ids count as none. An id without a token is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(rank_file, pattern)
        for batch in batches:
            raw = [value.as_py() or b"" for value in batch.column(1)]
            texts = [enc.decode_bytes(np.frombuffer(x, "<u4").tolist()) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(x) // 4 for x in raw], pa.int64()), pa.array(raw, pa.binary()), pa.array(texts, pa.binary())],
                                             ["doc_id", "n_tokens", "ids", "decoded"])

    return encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
