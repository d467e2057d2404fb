"""Token ids from the tokenizers library, at the speed a whole corpus needs.

A byte-level vocabulary splits a text into pieces and merges bytes within each. The pieces come back again and again, so the
ids that the library's model gives a piece are remembered. Only texts whose characters belong to the same class in every
pattern library are split here; any other text is encoded whole by the library. The ids are the library's either way.
"""

from __future__ import annotations

import os
import re
import struct
from collections.abc import Callable

import numpy as np

REMEMBERED = 400_000
UNITS = 2_000_000  # some 50 MB
SHORT = 7  # pieces up to this length are the ones that come back most, and stay when the memory is full
PLAIN = re.compile(r"[\t-\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧]*")
#: Contractions, words, digits, other signs, blanks: the split of the vocabulary, for plain texts.
PIECE = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-zªµºÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷‐-‧]+|\s+(?!\S)|\s+")
#: Byte-level vocabularies write each byte as a character: printable ones as themselves, the others from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: b if b in PRINTABLE else 256 + sum(x not in PRINTABLE for x in range(b)) for b in range(256)}

BLANK = chr(BYTES[32])


class Ids(dict):
    """Little-endian unsigned 32-bit ids of pieces, as bytes. One lives in each Python worker for each vocabulary."""

    _open: dict[str, Ids] = {}

    def __init__(self, path: str) -> None:
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings in a text are ordinary text
        self.model = self.library.model
        self.units = Units(self)

    @classmethod
    def of(cls, path: str) -> Ids:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def __missing__(self, piece: str) -> bytes:
        plain = piece[0] == " " and piece.isascii() and piece[1:].isalnum()
        found = self.model.tokenize(BLANK + piece[1:] if plain else piece.encode().decode("latin-1").translate(BYTES))
        if len(self) >= REMEMBERED:
            self._forget()
        self[piece] = ids = struct.pack(f"<{len(found)}I", *[x.id for x in found])
        return ids

    def _forget(self) -> None:
        short = {k: v for k, v in self.items() if len(k) <= SHORT}
        self.clear()
        if len(short) < REMEMBERED // 2:
            self.update(short)

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not PLAIN.fullmatch(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, PIECE.findall(text)))


class Units:
    """Ids of plain units by their hash. A unit is a word with the blanks before it, or the blanks that end a text: no piece crosses its
    borders, so its ids do not depend on what stands around it. Sorted layers, each less than half as long as the one before, are looked
    through whole for the sorted hashes of a block, and take a fraction of the memory of a dictionary."""

    def __init__(self, ids: Ids) -> None:
        self.ids, self.layers, self.known = ids, [], bytearray()

    def find(self, value: np.ndarray, text: Callable[[np.ndarray], list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """16-bit ids, and where those of each unit begin among them and how many they are. ``value``: different hashes, sorted;
        ``text`` gives the units at some places of it."""
        place, missing = np.zeros(len(value), np.int64), np.arange(len(value))
        for keys, places in self.layers:
            spot = np.minimum(np.searchsorted(keys, value[missing]), len(keys) - 1)
            hit = keys[spot] == value[missing]
            place[missing[hit]], missing = places[spot[hit]], missing[~hit]
        if len(missing):
            if sum(len(keys) for keys, _ in self.layers) + len(missing) > UNITS and self.layers:
                self.layers, self.known = [], bytearray()
                return self.find(value, text)
            units = text(missing)
            # units that begin with a blank and end with none are split in one go; the few others have no border of pieces beside them for certain
            alone = np.array([not x[0].isspace() or x[-1].isspace() for x in units])
            missing = np.concatenate([missing[~alone], missing[alone]])
            ids, size = self._split([x for x, y in zip(units, alone.tolist(), strict=True) if not y])
            others = [self.ids.encode(x) for x, y in zip(units, alone.tolist(), strict=True) if y]
            size = np.concatenate([size, [len(x) // 4 for x in others]]).astype(np.int64)
            place[missing] = (len(self.known) // 2 + np.cumsum(size) - size) << 32 | size
            self.known += np.frombuffer(b"".join([*ids, *others]), "<u4").astype("<u2").tobytes()
            missing.sort()
            layer = value[missing], place[missing]
            while self.layers and len(self.layers[-1][0]) < 2 * len(layer[0]):
                both = [np.concatenate(x) for x in zip(self.layers.pop(), layer, strict=True)]
                order = np.argsort(both[0])
                layer = both[0][order], both[1][order]
            self.layers.append(layer)
        return np.frombuffer(self.known, "<u2"), place >> 32, place & 0xFFFFFFFF

    def _split(self, units: list[str]) -> tuple[list[bytes], np.ndarray]:
        """Ids of all pieces, and how many ids each unit has."""
        pieces = PIECE.findall("".join(units))
        found = list(map(self.ids.__getitem__, pieces))
        length = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        total = np.cumsum(np.fromiter(map(len, found), np.int64, len(found))) // 4
        ends = np.searchsorted(length, np.cumsum(np.fromiter(map(len, units), np.int64, len(units))))
        return found, np.diff(total[ends], prepend=0)
