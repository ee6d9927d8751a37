"""Merge-type SentencePiece vocabularies: ids by a score-ordered agenda.

A text's symbols start as its characters.  The agenda holds every adjacent pair of
symbols whose concatenation is a piece, best score first, then leftmost; the first
pair is merged, the pairs with the new symbol's neighbours join the agenda, until no
pair is left.  A symbol that is no piece becomes its UTF-8 bytes.

Where no piece of the vocabulary has a word mark after another character, a line
feed, or another character after a letter, no pair reaches over such a place, and the
agendas of the chunks between them are independent: equal chunks have equal ids.  A
vocabulary with such pieces has each text as one chunk.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable
from heapq import heapify, heappop, heappush

import numpy as np

#: what a space is written as in pieces
MARK = "▁"
#: piece types of the model file (fixed values of the format)
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: model types of the format that are merged pair by pair
MERGE_TYPE = 2
#: symbols up to which an agenda is a plain list; longer chunks have a heap
SHORT = 24
#: characters of a section of a text
SECTION = 1 << 20
#: letters of the Latin script's first blocks
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]")


def _fields(raw: bytes):
    """(number, value) of a protocol-buffer message: integers and byte strings."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, raw[at: at + size]
            at += size


def read_vocabulary(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id.  Raises unless the model is of merge type and made
    of normal, byte and control pieces."""
    pieces = []
    with open(path, "rb") as file:
        for number, value in _fields(file.read()):
            if number == 1:
                piece, score, kind = "", 0.0, NORMAL
                for n, v in _fields(value):
                    if n == 1:
                        piece = v.decode()
                    elif n == 2:
                        score = struct.unpack("<f", v)[0]
                    elif n == 3:
                        kind = v
                pieces.append((piece, score, kind))
            elif number == 2 and dict(_fields(value)).get(3, 1) != MERGE_TYPE:
                raise ValueError(f"{path}: not a merge-type vocabulary")
    if any(kind in (USER_DEFINED, UNUSED) for _, _, kind in pieces):
        raise ValueError(f"{path}: user-defined and unused pieces aren't supported")
    return pieces


class ChunkEncoder(dict):
    """Cache: chunk of a normalised text -> its ids as little-endian bytes.

    ``limit`` bounds the entries; a full cache becomes the old one, whose chunks come
    back when asked for.  Long chunks aren't kept.  ``fresh`` holds the chunks that
    :meth:`compare` hasn't looked at yet, ``given`` the ids of those that it mended."""

    def __init__(self, vocabulary: list[tuple[str, float, int]], limit: int = 200_000):
        super().__init__()
        self.limit, self.old = limit, {}
        self.fresh: list[str] = []
        self.given: dict[str, bytes] = {}
        self.dtype = np.dtype("<u2" if len(vocabulary) <= 1 << 16 else "<u4")
        self.ids = {p: self._raw([i]) for i, (p, _, kind) in enumerate(vocabulary) if kind == NORMAL}
        # equal scores have equal ranks: then the leftmost pair comes first
        ranks = {s: r for r, s in enumerate(sorted({s for _, s, kind in vocabulary if kind == NORMAL}, reverse=True))}
        self.rank = {p: ranks[s] for p, s, kind in vocabulary if kind == NORMAL}
        self.never = len(ranks)
        unknown = next((i for i, (_, _, kind) in enumerate(vocabulary) if kind == UNKNOWN), 0)
        self.unknown = self._raw([unknown])
        by_byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocabulary) if kind == BYTE}
        self.bytes_of = [self._raw([by_byte[b]]) for b in range(256)] if len(by_byte) == 256 else None
        self.chunks, self.cuts = self._cuts()

    def _cuts(self) -> tuple[re.Pattern, re.Pattern | None]:
        """Pattern of chunks, and of the marks at which a text may be cut in sections:
        read off the pieces, so that no pair can reach from one chunk into the next."""
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in self.rank):
            return re.compile("(?s:.+)"), None
        word = "" if any(LETTERS.match(a) and not LETTERS.match(b) for p in self.rank for a, b in zip(p, p[1:])) else (
            f"{MARK}*{LETTERS.pattern}+(?!{LETTERS.pattern})|")
        return re.compile(f"{word}{MARK}*[^{MARK}\n]+|{MARK}+|\n"), re.compile(f"(?<=[^{MARK}]){MARK}(?=[^{MARK}])")

    def _raw(self, ids: list[int]) -> bytes:
        return np.array(ids, self.dtype).tobytes()

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk) or self.given.get(chunk)
        if got is None:
            merged = self.by_list(chunk) if len(chunk) <= SHORT else self.by_heap(chunk)
            got = b"".join([self.ids.get(s) or self.fallback(s) for s in merged])
            self.fresh.append(chunk)
        if len(chunk) <= 2 * SHORT:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[chunk] = got
        return got

    def fallback(self, symbol: str) -> bytes:
        if self.bytes_of is None:
            return self.unknown
        return b"".join([self.bytes_of[b] for b in symbol.encode()])

    def by_list(self, chunk: str) -> list[str]:
        """Symbols of a short chunk: the agenda is a list by place."""
        symbols, rank, never = list(chunk), self.rank.get, self.never
        agenda = [rank(a + b, never) for a, b in zip(symbols, symbols[1:])]
        while agenda:
            best = min(agenda)
            if best == never:
                break
            i = agenda.index(best)
            symbols[i: i + 2] = [symbols[i] + symbols[i + 1]]
            del agenda[i]
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + symbols[i], never)
            if i < len(agenda):
                agenda[i] = rank(symbols[i] + symbols[i + 1], never)
        return symbols

    def by_heap(self, chunk: str) -> list[str]:
        """Symbols of a chunk of any length: the agenda is a heap of (rank, left place,
        the pair's length); entries whose symbols have changed meanwhile are passed over."""
        symbols: list[str] = list(chunk)
        n, rank = len(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(r, i, 2) for i in range(n - 1) if (r := rank(chunk[i: i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, i, size = heappop(agenda)
            j = after[i]
            if not symbols[i] or j >= n or len(symbols[i]) + len(symbols[j]) != size:
                continue
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(symbols[i] + symbols[k])) is not None:
                    heappush(agenda, (r, i, size + len(symbols[k])))
            if (h := before[i]) >= 0 and (r := rank(symbols[h] + symbols[i])) is not None:
                heappush(agenda, (r, h, len(symbols[h]) + size))
        return [s for s in symbols if s]

    def encode(self, normalised: str) -> np.ndarray:
        """Ids of a normalised text."""
        raw = b"".join(map(self.__getitem__, self.chunks.findall(normalised)))
        ids = np.frombuffer(raw, self.dtype)
        if self.bytes_of is None and len(ids) > 1:  # neighbouring unknown symbols are one
            unknown = ids == np.frombuffer(self.unknown, self.dtype)[0]
            ids = ids[~(unknown & np.concatenate([[False], unknown[:-1]]))]
        return ids

    def compare(self, library: Callable[[list[str]], list[list[int]]]) -> bool:
        """Encodes the fresh chunks with the library; where its ids differ, they are kept.

        A chunk that begins with a mark is a text of its own, to which the library
        puts that mark back; any other is put after a line feed, which is in no piece."""
        fresh, self.fresh = list(dict.fromkeys(self.fresh)), []
        if not fresh:
            return True
        # marks alone would be an empty text
        alone = [self.cuts is None or (c[0] == MARK and c.strip(MARK)) for c in fresh]
        texts = [c.replace(MARK, " ")[c[0] == MARK:] if a else "\n" + c.replace(MARK, " ") for c, a in zip(fresh, alone)]
        lead = len(library(["\n"])[0])
        same = True
        for chunk, single, ids in zip(fresh, alone, library(texts)):
            ids = ids if single else ids[lead:]
            theirs = self._raw(ids)
            if self[chunk] != theirs:
                same, self.given[chunk] = False, theirs
                self.old.pop(chunk, None)
                self.pop(chunk, None)
        self.fresh = []
        return same

    def mended(self, normalised: str) -> bool:
        """Whether a text has a chunk whose ids are the library's."""
        return bool(self.given) and any(c in self.given for c in self.chunks.findall(normalised))

    def sections(self, normalised: str) -> list[str]:
        """A normalised text cut at single word marks, after ``SECTION`` characters at
        the earliest; every section but the first begins with its mark."""
        out, start = [], 0
        while self.cuts and len(normalised) - start > SECTION and (cut := self.cuts.search(normalised, start + SECTION)):
            out.append(normalised[start: cut.start()])
            start = cut.start()
        return out + [normalised[start:]]
