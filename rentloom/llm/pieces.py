"""Reading a compiled piece model and normalising text by its character map, with source alignment."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np


NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6   # piece types of the model format
SPACE_MARK = "▁"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes, bytes]]:
    """(number, value, whole field) of a protocol buffer message."""
    at = 0
    while at < len(data):
        start = at
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        else:
            size = {1: 8, 5: 4}.get(kind)
            if size is None:
                size, at = _varint(data, at)
            value, at = data[at:at + size], at + size
        yield tag >> 3, value, data[start:at]


@dataclass
class PieceModel:
    """The parts of a model file that normalising and counting need."""

    pieces: list[tuple[str, float, int]]
    charsmap: bytes
    dummy_prefix: bool
    strip_spaces: bool
    byte_fallback: bool
    plain: bytes      # the same model without a normaliser of its own

    @classmethod
    def parse(cls, data: bytes) -> PieceModel:
        pieces, rest, norm, byte_fallback = [], [], {}, False
        for number, value, whole in _fields(data):
            if number == 1:
                got = {n: v for n, v, _ in _fields(value)}
                pieces.append((got[1].decode(), struct.unpack("<f", got.get(2, b"\0" * 4))[0], got.get(3, NORMAL)))
            elif number == 2:
                spec = {n: v for n, v, _ in _fields(value)}
                if spec.get(24, 0):
                    raise ValueError("models that put white space behind words are not supported")
                byte_fallback = bool(spec.get(35, 0))
            elif number == 3:
                norm = {n: v for n, v, _ in _fields(value)}
            if number != 3:
                rest.append(whole)
        plain_spec = b"\x0a\x08identity\x18\x00\x20\x00\x28\x01"    # no prefix, spaces kept, spaces written as marks
        if not norm.get(5, 1):
            raise ValueError("models that do not mark spaces are not supported")
        return cls(pieces, norm.get(2, b""), bool(norm.get(3, 1)), bool(norm.get(4, 1)), byte_fallback,
                   b"".join(rest) + b"\x1a" + bytes([len(plain_spec)]) + plain_spec)


class CharacterMap:
    """Longest-prefix replacement by a compiled map: a double-array trie over UTF-8 bytes, then the replacements."""

    def __init__(self, blob: bytes) -> None:
        self.units: list[int] = []
        self.starts = frozenset()
        if blob:
            size = struct.unpack_from("<I", blob)[0]
            self.units = list(struct.unpack_from(f"<{size // 4}I", blob, 4))
            self.strings = blob[4 + size:]
            root = self._offset(self.units[0])
            self.starts = frozenset(c for c in range(1, 256) if self.units[root ^ c] & 0x800000FF == c)

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 0x200) >> 6)

    def longest(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """(replacement, bytes consumed) of the longest key that starts at ``at``."""
        node, found = self._offset(self.units[0]), None
        for end in range(at, len(raw)):
            node ^= raw[end]
            unit = self.units[node]
            if unit & 0x800000FF != raw[end]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = self.units[node] & 0x7FFFFFFF, end + 1 - at
        if found is None:
            return None
        return self.strings[found[0]:self.strings.index(b"\0", found[0])], found[1]

    def steps(self, raw: bytes) -> Iterator[tuple[bytes, int]]:
        """(output, bytes consumed) of each step through a text; unmapped characters stay as they are."""
        at = 0
        while at < len(raw):
            lead = raw[at]
            step = self.longest(raw, at) if lead in self.starts else None
            if step is None:
                width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                step = raw[at:at + width], width
            yield step
            at += step[1]


class Normalizer:
    """Normalised text and, per normalised byte, where in the original it comes from.

    ``aligned`` returns the text as bytes (spaces as spaces) and an array with
    one entry per byte and one for the end; None in its place says that byte i
    comes from byte i - prefix.
    """

    def __init__(self, model: PieceModel) -> None:
        self.model, self.map = model, CharacterMap(model.charsmap)
        self.identity = not self.map.starts and not model.strip_spaces
        self.prefix = b" " if model.dummy_prefix else b""

    def aligned(self, raw: bytes) -> tuple[bytes, np.ndarray | None]:
        if not raw:
            return b"", None
        if self.identity:
            return self.prefix + raw, None
        out, source, at = bytearray(), [], 0
        after_space = strip = self.model.strip_spaces
        for text, used in self.map.steps(raw):
            if after_space and strip:
                text = text.lstrip(b" ")
            if text:
                if not out and self.prefix:
                    out += self.prefix
                    source.append(at)
                out += text
                source += [at] * len(text)
                after_space = text.endswith(b" ")
            at += used
        end = at
        while strip and (tail := next((t for t in (b" ", SPACE_MARK.encode()) if out.endswith(t)), b"")):
            end = source[-len(tail)]
            del out[-len(tail):], source[-len(tail):]
        return bytes(out), np.array([*source, end], np.int64)


class SafeCuts:
    """Cuts of a normalised text that no merge can cross: characters that never stand side by side in a piece."""

    def __init__(self, model: PieceModel) -> None:
        self.inside = {pair for piece, _, kind in model.pieces if kind not in (CONTROL, BYTE, UNKNOWN)
                       for pair in zip(piece, piece[1:], strict=False)}
        special = any(kind in (USER_DEFINED, UNUSED) for _, _, kind in model.pieces)
        self.at_spaces = not special and not any(b == SPACE_MARK and a != SPACE_MARK for a, b in self.inside)

    def words(self, text: str) -> list[str]:
        """Parts that start at a run of spaces; the whole text if such cuts are not safe."""
        if not self.at_spaces or not text:
            return [text] if text else []
        parts = text.split(" ")
        if "" not in parts[1:] and SPACE_MARK not in text:
            return ([parts[0]] if parts[0] else []) + [" " + p for p in parts[1:]]
        out, start = [], 0
        marks = (" ", SPACE_MARK)
        for i in range(1, len(text)):
            if text[i] in marks and text[i - 1] not in marks:
                out.append(text[start:i])
                start = i
        return [*out, text[start:]]

    def parts(self, word: str) -> list[str]:
        """A word cut wherever two neighbours never meet inside a piece."""
        marked = word.replace(" ", SPACE_MARK)
        out, start = [], 0
        for i in range(1, len(marked)):
            if (marked[i - 1], marked[i]) not in self.inside:
                out.append(marked[start:i])
                start = i
        return [*out, marked[start:]]
