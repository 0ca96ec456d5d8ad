"""A unigram vocabulary: pieces, scores and ids read from a model file, and the segments that pieces never cross."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: A vocabulary goes to every executor; larger ones are refused.
MAX_PIECES = 2_000_000
#: Characters that are cut into segments at a time.
BLOCK = 1 << 16


def _fields(data: bytes):
    """(number, value) of each field of a protocol buffer message."""
    i, n = 0, len(data)

    def varint():
        nonlocal i
        shift = value = 0
        while True:
            b = data[i]
            i += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while i < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[i : i + size]
            i += size


@dataclass
class Vocabulary:
    """pieces: those that stand in texts, with id and score; byte_ids: of the 256 pieces for single bytes, if there are any."""

    pieces: dict[str, tuple[int, float]]
    by_id: dict[int, str]
    byte_ids: list[int]
    unknown_id: int = 0
    unknown_score: float = 0.0
    longest: int = 1
    segment: re.Pattern = field(default=None, repr=False)
    cuts: bool = True  # whether segments end at marks

    @staticmethod
    def load(path: str) -> Vocabulary:
        """Reads a SentencePiece model file. Types: 1 normal, 2 unknown, 3 control, 4 user-defined, 5 unused, 6 byte."""
        pieces, by_id, byte_ids, unknown = {}, {}, {}, 0
        with open(path, "rb") as f:
            rows = [dict(_fields(x)) for n, x in _fields(f.read()) if n == 1]
        if len(rows) > MAX_PIECES:
            raise ValueError(f"{len(rows)} pieces; {MAX_PIECES} at most")
        for i, row in enumerate(rows):
            text, score, kind = row[1].decode(), struct.unpack("<f", row[2])[0] if 2 in row else 0.0, row.get(3, 1)
            by_id[i] = text
            if kind in (1, 4):
                pieces[text] = (i, score)
            elif kind == 6:
                byte_ids[int(text[3:5], 16)] = i
            elif kind == 2:
                unknown = i
        return Vocabulary.of(pieces, by_id, [byte_ids[b] for b in range(256)] if len(byte_ids) == 256 else [], unknown)

    @staticmethod
    def of(pieces: dict[str, tuple[int, float]], by_id: dict[int, str] | None = None, byte_ids: list[int] | None = None, unknown_id: int = 0) -> Vocabulary:
        by_id = by_id or {i: p for p, (i, _) in pieces.items()}
        v = Vocabulary(pieces, by_id, byte_ids or [], unknown_id, min((s for _, s in pieces.values()), default=0.0) - UNKNOWN_PENALTY, max(map(len, pieces), default=1))
        if any(MARK in p.lstrip(MARK) for p in pieces):
            v.cuts, v.segment = False, re.compile(r"(?s).+")  # some piece crosses words: a text is one segment
        else:
            alone = "".join(c for c in "\n\t\r" if not any(c in p and len(p) > 1 for p in pieces))
            v.segment = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + (f"|[{alone}]" if alone else ""))
        return v

    def segments(self, text: str) -> list[str]:
        """The marked text cut where no piece can cross, so that the best path of each part is part of the best path of all."""
        return list(self.each_segment(text))

    def each_segment(self, text: str | None) -> Iterator[str]:
        return chain.from_iterable(self.segment_lists(text))

    def segment_lists(self, text: str | None) -> Iterator[list[str]]:
        """The segments in lists, one for each BLOCK characters or so of the text; blocks end before a mark that follows another character, where a segment ends in any case."""
        marked, at = MARK + text.replace(" ", MARK) if text else "", 0
        while at < len(marked):
            end = at + BLOCK if self.cuts else len(marked)
            while (end := marked.find(MARK, end)) > 0 and marked[end - 1] == MARK:
                end += 1
            end = end if end > 0 else len(marked)
            yield self.segment.findall(marked, at, end)
            at = end

    def unknown_ids(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte_ids else [self.unknown_id]
