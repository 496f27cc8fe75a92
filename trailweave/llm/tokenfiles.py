"""Flat files of token ids with 64-bit document offsets.

A part is two files. ``.bin`` holds the ids of its documents one after another as unsigned 16-bit (vocabularies
of at most 65,536) or 32-bit little-endian integers. ``.idx`` holds n + 1 signed 64-bit token offsets within
the part, then the n doc_ids. Parts are in ascending doc_id order; the manifest, one row a part, gives each
part's first token in the whole by a prefix sum, so ids need not pass through one place to be numbered.
"""
from __future__ import annotations

import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailweave.llm.vocab import shared_encoder
from trailweave.session import materialize

#: Documents read at once from a part.
READ_AT_ONCE = 64
MANIFEST = "part long, name string, n_docs long, n_null long, n_tokens long, width int"


def place(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder given as path or URI."""
    if "://" in folder or folder.startswith("file:"):
        return pafs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return pafs.LocalFileSystem(), folder


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, write the parts to ``folder`` (shared by all executors) and return the manifest with ``base``.

    Each document's ids end with ``end_id``; a null text counts as empty. Order: doc_id, nulls first, equal ids by
    text; repeated rows are all kept. An empty table gives no parts. A task writes under a name of its own
    attempt and only the names of finished attempts reach the manifest, so a lost executor leaves at most
    unused files.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = place(folder)
        files.create_dir(path)
        part, name = TaskContext.get().partitionId(), f"{path}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        encoder = shared_encoder(tokenizer, keeps_gaps=True, typecode=None)
        end = array(encoder.typecode, [end_id]).tobytes()
        ids, lengths, stream = [], [], None
        for batch in batches:
            if batch.num_rows and stream is None:
                stream = files.open_output_stream(f"{name}.bin")
            ids += batch.column(0).to_pylist()
            for text in batch.column(1).to_pylist():
                packed = encoder.encode(text)
                stream.write(packed + end)
                lengths.append((len(packed) + len(end)) // len(end))
        if stream is None:
            return
        stream.close()
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i8")
        with files.open_output_stream(f"{name}.idx") as out:
            out.write(offsets.tobytes() + np.array([x or 0 for x in ids], "<i8").tobytes())
        row = {"part": part, "name": name.rsplit("/", 1)[1], "n_docs": len(ids), "n_null": sum(x is None for x in ids), "n_tokens": int(offsets[-1]), "width": len(end)}
        yield pa.RecordBatch.from_pylist([row], pa.schema([("part", pa.int64()), ("name", pa.string()), ("n_docs", pa.int64()), ("n_null", pa.int64()),
                                                           ("n_tokens", pa.int64()), ("width", pa.int32())]))

    ordered = (docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    manifest = materialize(ordered.mapInArrow(run, MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a part, not a row a document
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


class Part:
    """One part opened for reading: memory-mapped where the folder is a local path, by ranges elsewhere."""

    def __init__(self, folder: str, name: str, n_docs: int, width: int) -> None:
        files, path = place(folder)
        with files.open_input_file(f"{path}/{name}.idx") as index:
            both = np.frombuffer(index.read(), "<i8")
        self.offsets, self.doc_ids, self.width = both[:n_docs + 1], both[n_docs + 1:], width
        self.file = pa.memory_map(f"{path}/{name}.bin") if isinstance(files, pafs.LocalFileSystem) else files.open_input_file(f"{path}/{name}.bin")

    def ids(self, k: int, end: int | None = None) -> np.ndarray:
        """The ids of document ``k``, or of the documents from there up to ``end``."""
        first, last = int(self.offsets[k]), int(self.offsets[k + 1 if end is None else end])
        self.file.seek(first * self.width)
        return np.frombuffer(self.file.read_buffer((last - first) * self.width), f"<u{self.width}")

    def packed(self, k: int, end: int) -> list[bytes]:
        """The ids of each document from ``k`` up to ``end`` as little-endian uint32."""
        whole, cuts = memoryview(self.ids(k, end).astype("<u4")).cast("B"), ((self.offsets[k:end + 1] - self.offsets[k]) * 4).tolist()
        return [bytes(whole[a:b]) for a, b in zip(cuts, cuts[1:])]


def read(spark: SparkSession, manifest: DataFrame, folder: str, rows_per_batch: int = 2000) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary as little-endian uint32, ids_crc32), a row a document, a task for a part."""
    names = ["doc_id", "start", "n_tokens", "ids", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                part = Part(folder, row["name"], row["n_docs"], row["width"])
                for at in range(0, row["n_docs"], rows_per_batch):
                    span = range(at, min(at + rows_per_batch, row["n_docs"]))
                    ids = [x for k in span[::READ_AT_ONCE] for x in part.packed(k, min(k + READ_AT_ONCE, span.stop))]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None if k < row["n_null"] else int(part.doc_ids[k]) for k in span], pa.int64()),
                        pa.array([row["base"] + int(part.offsets[k]) for k in span], pa.int64()),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array(ids, pa.binary()),
                        pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    ], names)

    parts = max(1, manifest.count())
    return manifest.repartitionByRange(parts, "part").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary, ids_crc32 long")
