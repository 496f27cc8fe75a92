"""Encoding, token files and packing against the libraries used plainly."""
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from trailweave.llm import bpe, catalog, packing, tokenfiles
from trailweave.llm.vocab import UnitEncoder
from trailweave.session import scratch_dir

TEXTS = [None, "", " ", "The cat's hat, 12 3.", "The cat's hat, 12 3.", "  two  spaces \n\n and\tmore\r\n", "naïve ﬁ ÀÉ 漢字かな 😀", "<|endoftext|>x", "a b\x1cc\x85d",
         "x" * 3000, " " * 15000 + "end", "word, " * 5000, "Zeile\nNoch eine\nE", "'s 'll'", "\n lead", "ends \n"]
SCHEMA = "doc_id long, text string, ids string, start int, n_tokens string"
DATA = [(k if k else None, t, "clash", 7, "x") for k, t in enumerate(TEXTS)]


@pytest.fixture(scope="module")
def docs(rows):
    return rows(DATA, SCHEMA)


def test_long_texts_are_cut_where_matches_end():
    enc = bpe.encoding(catalog.RANKS, catalog.public_tokenizers.PATTERN)
    text = "".join(t or "" for t in TEXTS) * 3
    assert bpe.encode_text(enc, text, 200) == enc.encode_ordinary(text)
    wide = "a" + " " * 1_300_000 + "b"  # beyond the library's own limit
    assert enc.decode_bytes(bpe.encode_text(enc, wide)) == wide.encode()


def test_encode_and_decode(docs):
    enc = bpe.encoding(catalog.RANKS, catalog.public_tokenizers.PATTERN)
    both = bpe.decode(bpe.encode(docs, catalog.RANKS), catalog.RANKS).collect()
    assert len(both) == len(TEXTS)
    want = sorted((k or -1, np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for k, t, *_ in DATA)
    assert sorted((r.doc_id or -1, bytes(r.ids), bytes(r.decoded)) for r in both) == want


@pytest.mark.parametrize("path, keeps_gaps", [(catalog.BYTE_FILE, True), (catalog.WORD_FILE, False)])
def test_units_give_the_ids_of_whole_texts(path, keeps_gaps):
    encoder, whole = UnitEncoder(path, keeps_gaps, table_size=5), Tokenizer.from_file(path)
    whole.encode_special_tokens = True
    for text in TEXTS:
        ids = whole.encode(text or "", add_special_tokens=False).ids
        for _ in range(2):
            assert np.frombuffer(encoder.encode(text or ""), "<u4").tolist() == ids


def test_one_word_units_are_kept_once():
    encoder = UnitEncoder(catalog.BYTE_FILE, keeps_gaps=True)
    encoder.encode("plain\nnaïve Straße 12 ªº 漢字")
    assert not {"plain", " naïve", " Straße"} & {*encoder.table.pieces}


def test_documents_read_at_once_are_those_read_singly(spark, docs):
    folder = scratch_dir(spark)
    row = tokenfiles.write(docs.coalesce(1), catalog.BYTE_FILE, folder).first()
    part = tokenfiles.Part(folder, row["name"], row["n_docs"], row["width"])
    assert part.packed(0, row["n_docs"]) == [part.ids(k).astype("<u4").tobytes() for k in range(row["n_docs"])]


def test_token_files(spark, docs):
    folder = scratch_dir(spark)
    manifest = tokenfiles.write(docs, catalog.BYTE_FILE, folder)
    got = sorted(tokenfiles.read(spark, manifest, folder, 3).collect(), key=lambda r: r.start)
    whole, at = Tokenizer.from_file(catalog.BYTE_FILE), 0
    whole.encode_special_tokens = True
    for row, (doc_id, text, *_) in zip(got, DATA, strict=True):
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4").tobytes()
        assert (row.doc_id, row.start, row.n_tokens, bytes(row.ids), row.ids_crc32) == (doc_id, at, len(ids) // 4, ids, zlib.crc32(ids))
        at += row.n_tokens


def test_token_files_of_an_empty_table(spark, docs):
    folder = scratch_dir(spark)
    manifest = tokenfiles.write(docs.where("false"), catalog.BYTE_FILE, folder)
    assert tokenfiles.read(spark, manifest, folder).count() == 0


def check_packing(pieces, want, capacity):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert sorted(by_doc) == sorted(want)
    for doc_id, ids in want.items():
        whole = b""
        for p in sorted(by_doc[doc_id], key=lambda p: p.start):
            assert (p.start, p.length, p.doc_tokens) == (len(whole) // 4, len(p.ids) // 4, len(ids))
            whole += bytes(p.ids)
        assert whole == np.array(ids, "<u4").tobytes()
    padding = 0
    for sequence in by_sequence.values():
        at = 0
        for p in sorted(sequence, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / sum(map(len, want.values()))


def test_packing(docs):
    whole = Tokenizer.from_file(catalog.WORD_FILE)
    whole.encode_special_tokens = True
    want = {(k or -1): [*whole.encode(t or "", add_special_tokens=False).ids, 2] for k, t, *_ in DATA}
    pieces = packing.pack(docs.na.fill({"doc_id": -1}), catalog.WORD_FILE).collect()
    assert check_packing(pieces, want, 4096) < 0.02
    assert packing.pack(docs.where("false"), catalog.WORD_FILE).count() == 0


@pytest.mark.parametrize("grain", [1, 4, 16])
def test_bins_hold_a_fixed_number(grain):
    packer, rng = packing.Packer(64, grain), np.random.default_rng(3)
    lengths, done = rng.integers(1, 200, 500), []
    for k, n in enumerate(lengths):
        for sequence in packer.add(k, np.arange(n)):
            assert len(sequence) == 64 // len(sequence[0][2])
            done.append(sequence)
    done += packer.finish()
    assert sum(len(p[2]) for s in done for p in s) == lengths.sum()
    assert all(sum(len(p[2]) for p in s) <= 64 for s in done)
    padding = sum(64 - t for s in done if (t := sum(len(p[2]) for p in s)) & (t - 1))
    assert padding <= 0.05 * lengths.sum()
