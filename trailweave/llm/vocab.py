"""Whole-text encoding with the tokenizers library, through a bounded table of units already encoded.

A unit is a stretch of text that the library's own splitting never joins with its neighbours, so encoding
units apart gives the ids of the whole text. Words repeat, so most units are looked up.
"""
from __future__ import annotations

import os
import re
from array import array
from functools import lru_cache
from itertools import islice

from tokenizers import Tokenizer

GAP = " \t\n\r\f\v"
#: A word with the white space before it: a byte-level splitter ends a match before any white space that follows another character.
WITH_GAP = re.compile(f"[{GAP}]*[^{GAP}]+|[{GAP}]+")
#: For splitters that drop white space.
WITHOUT_GAP = re.compile(f"[^{GAP}]+")
#: Other white space, which could be one run with ASCII white space: such texts are encoded whole.
ODD_GAP = re.compile("[\x1c-\x1f\x85\xa0  -     　]")

RARE_GAP = re.compile("[\t\r\f\v\x1c-\x1f]")
#: The same as strings: looking for each of a few characters is several times faster than a character class.
ODD_GAPS, RARE_GAPS = (tuple(c for c in map(chr, range(0x3001)) if p.fullmatch(c)) for p in (ODD_GAP, RARE_GAP))
#: Control characters that str.split takes for white space and the tokenizers don't.
FILE_MARKS = re.compile("[\x1c-\x1f]")

#: Plain units fall into pieces that the splitters take apart in any case: runs of letters, of digits, of marks other than
#: the apostrophe. Latin letters only, which no version of Unicode classes otherwise.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ÿ", "!-&(-/:-@\\[-`{-~"
PLAIN = re.compile(f"(?:\n(?=[^{GAP}]))? ?[0-9{LETTERS}{MARKS}]+")
WORD = re.compile(f"[{LETTERS}]+")
PIECES = re.compile(f"\n| ?(?:[{LETTERS}]+|[0-9]+|[{MARKS}]+)")
#: The word file takes each digit by itself.
WORD_PIECES = re.compile(f"[{LETTERS}]+|[0-9]|[{MARKS}]+")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level files write each byte: itself if printable in Latin-1, else one from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in printable else next(others)) for b in range(256)}


class Pieces(dict):
    """Ids of pieces, by the library's model alone, as nothing is left to split or normalise in them."""

    def __init__(self, tokenizer: Tokenizer, typecode: str) -> None:
        super().__init__()
        self.model, self.typecode, self.letters = tokenizer.model, typecode, byte_letters()

    def encode(self, piece: str) -> bytes:
        if piece.isascii():  # only the space before it and a line end are written otherwise
            written = piece.replace(" ", self.letters[32]).replace("\n", self.letters[10])
        else:
            written = piece.encode().decode("latin-1").translate(self.letters)
        return array(self.typecode, [token.id for token in self.model.tokenize(written)]).tobytes()

    def __missing__(self, piece: str) -> bytes:
        ids = self[piece] = self.encode(piece)
        return ids


class Units(dict):
    """Ids of units: from the ids of their pieces where a unit is plain, else by the whole library."""

    def __init__(self, tokenizer: Tokenizer, typecode: str, keeps_gaps: bool, before: str = "") -> None:
        super().__init__()
        self.tokenizer, self.typecode, self.keeps_gaps, self.before = tokenizer, typecode, keeps_gaps, before
        self.pieces = Pieces(tokenizer, typecode)

    def __missing__(self, unit: str) -> bytes:
        text = unit if unit.startswith("\n") else self.before + unit
        if unit.isalpha() and (unit.isascii() or WORD.fullmatch(unit)):  # one piece, kept as a unit only
            ids = self.pieces.encode(text if self.keeps_gaps else text.lower())
        elif PLAIN.fullmatch(text):
            ids = b"".join(map(self.pieces.__getitem__, PIECES.findall(text) if self.keeps_gaps else WORD_PIECES.findall(text.lower())))
        else:
            ids = array(self.typecode, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(unit) < 1000:  # longer ones are not worth remembering
            self[unit] = ids
        return ids


class UnitEncoder:
    """``keeps_gaps`` says whether white space and case have ids of their own (byte-level files) or are dropped (word files).

    Both kinds are BPE files over byte letters. ``typecode`` is that of the packed ids; None means 16 bits if the
    vocabulary allows it, else 32. A table that has ``table_size`` entries loses the older half.
    """

    def __init__(self, path: str, keeps_gaps: bool, typecode: str | None = "I", table_size: int = 500_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one task, one core
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        typecode = typecode or ("I" if self.tokenizer.get_vocab_size() > 1 << 16 else "H")
        self.keeps_gaps, self.typecode, self.table_size = keeps_gaps, typecode, table_size
        self.table = Units(self.tokenizer, typecode, keeps_gaps)
        self.spaced = Units(self.tokenizer, typecode, keeps_gaps, " ")  # units without the space before them
        self.spaced.pieces = self.table.pieces

    def encode(self, text: str) -> bytes:
        """The ids of one text as packed integers (little-endian as on all platforms Spark runs on)."""
        for known in (self.table, self.spaced, self.table.pieces):
            if len(known) > self.table_size:
                for unit in list(islice(known, len(known) // 2)):
                    del known[unit]
        known = self.table.__getitem__
        if not self.keeps_gaps:
            split = WITHOUT_GAP.findall(text) if FILE_MARKS.search(text) else text.split()
            return b"".join(map(known, split))
        if not text.isascii() and any(map(text.__contains__, ODD_GAPS)):
            return array(self.typecode, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        lines = text.replace("\n", " \n")
        if lines and "  " not in lines and "\n " not in lines and lines[0] != " " and lines[-1] not in " \n" and not any(map(lines.__contains__, RARE_GAPS)):
            split = lines.split(" ")  # each word but the first has one space or one line end before it
            return known(split[0]) + b"".join(map(self.spaced.__getitem__, split[1:]))
        return b"".join(map(known, WITH_GAP.findall(text)))


@lru_cache(4)
def shared_encoder(path: str, keeps_gaps: bool, typecode: str | None = "I") -> UnitEncoder:
    """One encoder for all tasks of a worker process, so that what one task has looked up serves the next."""
    return UnitEncoder(path, keeps_gaps, typecode)
