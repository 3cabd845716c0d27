"""SentencePiece models: the file's parts, normalisation with source alignment, and piece widths.

A model file is a protocol buffer; its wire format is read here directly, as the installed library shows neither the
compiled character map nor a piece's kind in bulk.
"""

from __future__ import annotations

import functools
import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the model format: kinds of piece, and the mark that stands for a space.
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6
SPACE_MARK = "▁"
BPE = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        shift += 7
        if byte < 128:
            return value, at


def wire(data: bytes):
    """(field number, value) of a message: integers, or bytes for anything of given length or fixed width."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            if kind == 2:
                size, at = _varint(data, at)
            else:
                size = {1: 8, 5: 4}[kind]
            value, at = data[at : at + size], at + size
        yield key >> 3, value


@dataclass
class CharacterMap:
    """The compiled map: a double-array trie over UTF-8 keys, whose values point into a pool of replacements.

    Layout (fixed by the format): a 4-byte size, so many bytes of 32-bit trie units, then the pool of strings that end
    with a zero byte.
    """

    units: np.ndarray
    pool: bytes
    first: frozenset[int] = field(default_factory=frozenset)

    @classmethod
    def of(cls, blob: bytes) -> CharacterMap:
        if not blob:
            return cls(np.zeros(0, np.uint32), b"")
        (size,) = struct.unpack_from("<I", blob)
        out = cls(np.frombuffer(blob, "<u4", size // 4, 4), blob[4 + size :])
        root = int(out.units[0])
        out.first = frozenset(b for b in range(1, 256) if (int(out.units[cls._base(root) ^ b]) & 0x800000FF) == b)
        return out

    @staticmethod
    def _base(unit: int) -> int:
        return (unit >> 10) << ((unit & (1 << 9)) >> 6)

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest key that text holds at this place, and its replacement."""
        node, found = self._base(int(self.units[0])), None
        for i in range(at, len(text)):
            node ^= text[i]
            unit = int(self.units[node])
            if (unit & 0x800000FF) != text[i]:
                break
            node ^= self._base(unit)
            if unit >> 8 & 1:
                value = int(self.units[node]) & 0x7FFFFFFF
                found = i + 1 - at, self.pool[value : self.pool.index(b"\0", value)]
        return found


@dataclass
class Pieces:
    """What a model file says, without the library's own search for merges."""

    model: bytes
    pieces: list[str]
    kinds: np.ndarray
    widths: np.ndarray
    chars: np.ndarray
    joins: frozenset[str]
    map: CharacterMap
    dummy_prefix: bool
    squeeze: bool
    bpe: bool
    byte_fallback: bool
    unknown: int
    user: tuple[bytes, ...] = ()

    @property
    def splits_safely(self) -> bool:
        """Whether cutting a text where no piece joins the two characters leaves its encoding as it is."""
        return self.bpe and self.byte_fallback and not len(self.map.units) and not self.squeeze and USER_DEFINED not in self.kinds

    def normalise(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The normalised UTF-8 bytes, without the prefix mark, and for each the start of what it came from (and one end more).

        At each character the longest user-defined piece is kept, else the longest key of the compiled map is replaced;
        any other character is kept. Runs of plain bytes are copied whole: only bytes that can begin a key are walked
        through the trie.
        """
        data = np.frombuffer(text, np.uint8)
        firsts = self.map.first | {x[0] for x in self.user}
        if firsts:
            out, source, at = [], [], 0
            begins = np.isin(data, np.fromiter(firsts, np.uint8, len(firsts))).nonzero()[0]
            for start in begins.tolist():
                if start < at or data[start] & 0xC0 == 0x80:
                    continue
                if (own := next((x for x in self.user if text.startswith(x, start)), None)) is not None:
                    out.append(data[at : start + len(own)])
                    source.append(np.arange(at, start + len(own)))
                    at = start + len(own)
                    continue
                if not self.map.first or (hit := self.map.longest(text, start)) is None:
                    continue
                out += [data[at:start], np.frombuffer(hit[1], np.uint8)]
                source += [np.arange(at, start), np.full(len(hit[1]), start)]
                at = start + hit[0]
            data = np.concatenate([*out, data[at:]])
            source = np.concatenate([*source, np.arange(at, len(text))])
        else:
            source = np.arange(len(data))
        mark = np.frombuffer(SPACE_MARK.encode(), np.uint8)
        if self.squeeze:
            space = data == 32
            keep = ~(space & np.concatenate([[True], space[:-1]])) if len(data) else space
            data, source = data[keep], source[keep]
            if len(data) and data[-1] == 32:
                data, source = data[:-1], source[:-1]
        space = data == 32
        width = np.where(space, len(mark), 1)
        wide = np.repeat(data, width)
        starts = np.cumsum(width) - width
        for k, b in enumerate(mark.tolist()):
            wide[starts[space] + k] = b
        return wide, np.concatenate([np.repeat(source, width), [len(text)]])

    def spans(self, ids: np.ndarray, text: bytes, shown: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Begin and end byte of every id in the original text, which is valid UTF-8.

        shown: the library's pieces as strings, which only texts with unknown pieces need, as those have no width of their
        own; it shows the characters that such a piece stands for. Piece widths run along the normalised bytes, whose alignment gives the place in the source. The prefix mark has
        no source: it has a span of no width. The bytes of one character that falls back to bytes, and pieces of one
        replacement, each span what they came from.
        """
        if not len(ids):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        wide, source = self.normalise(text)
        widths = self.widths[ids]
        if shown is not None:
            widths = np.where(ids == self.unknown, [len(x.encode()) for x in shown], widths)
        ends = np.cumsum(widths)
        lead = len(SPACE_MARK.encode()) if self.dummy_prefix else 0
        if int(ends[-1]) != len(wide) + lead:
            raise ValueError(f"pieces cover {int(ends[-1])} of {len(wide) + lead} normalised bytes")
        at = np.maximum(np.concatenate([[0], ends]) - lead, 0)
        begin = source[at[:-1]]
        end = source[at[1:]]
        return np.minimum(begin, end), end

    def stable(self, left: str, right: str) -> bool:
        """No piece joins these two characters, so no merge ever crosses the place between them."""
        mark = lambda c: SPACE_MARK if c == " " else c
        return mark(left) + mark(right) not in self.joins


@functools.lru_cache(4)
def read(path: str) -> Pieces:
    with open(path, "rb") as f:
        model = f.read()
    pieces, kinds, trainer, normaliser = [], [], {}, {}
    for number, value in wire(model):
        if number == 1:
            piece = dict(wire(value))
            pieces.append(piece[1].decode())
            kinds.append(piece.get(3, 1))
        elif number == 2:
            trainer = dict(wire(value))
        elif number == 3:
            normaliser = dict(wire(value))
    kinds_ = np.array(kinds)
    widths, chars, joins = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64), set()
    for i, (piece, kind) in enumerate(zip(pieces, kinds, strict=True)):
        if kind == BYTE:
            byte = int(piece[3:5], 16)
            widths[i], chars[i] = 1, not 0x80 <= byte < 0xC0
        elif kind not in (CONTROL, UNKNOWN):
            widths[i], chars[i] = len(piece.encode()), len(piece)
            joins.update(piece[k : k + 2] for k in range(len(piece) - 1))
    return Pieces(
        model, pieces, kinds_, widths, chars, frozenset(joins), CharacterMap.of(normaliser.get(2, b"")),
        bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), trainer.get(3, 1) == BPE, bool(trainer.get(35, 0)), kinds.index(UNKNOWN),
        tuple(sorted((x.encode() for x, k in zip(pieces, kinds, strict=True) if k == USER_DEFINED), key=len, reverse=True)),
    )


@functools.lru_cache(4)
def processor(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
