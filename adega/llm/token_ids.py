"""Exact token ids of whole texts with a public tokenizer, at cache speed.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)`` of the
``tokenizers`` library.  Both vocabularies used here split a text into pre-tokens
before any merge is applied, and no pre-token reaches across a space or a line
feed that stands between two non-blank characters, so the ids of a text are the
ids of its pieces in a row.  Pieces repeat; :class:`PieceEncoder` keeps the bytes
of each piece's ids and calls the library once for a new piece.  A text that has
runs of blanks, other white space at a piece's edge, or the text of a special
token is handed to the library whole: same ids, only slower.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from adega.llm.common import kept_by_process

#: characters with the Unicode property White_Space (what ``\\s`` means in the tokenizer files)
WHITE = "\t-\r \x85\xa0  -     　"
_EDGE = re.compile(f"^[{WHITE}]|[{WHITE}]$|^$")
_WHITE = re.compile(f"[{WHITE}]")
#: Latin letters followed by punctuation without an apostrophe: two pre-tokens in both vocabularies
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+")
_CASED = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_WORD_MARKS = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([-.,;:!?*#$%&|/()]+)")

#: bytes of an entry besides its characters and ids: two objects and their place in the table
ENTRY_BYTES = 190
#: bytes of a cache, if the caller doesn't say
CACHE_BYTES = 32 << 20


def _byte_symbols() -> list[str]:
    """Byte -> symbol of byte-level vocabularies: printable Latin-1 characters stand
    for themselves, the other bytes for the code points from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class _Blank(Exception):
    """A piece whose neighbours decide its ids: the whole text goes to the library."""


class PieceEncoder(dict):
    """Cache: piece after a space (or at the start, see ``first``) -> id bytes.

    ``width`` is the bytes of one id (little-endian unsigned).  ``bound`` is the memory of
    the entries: a full cache becomes the old one, whose pieces come back when asked for,
    so twice that is held at most."""

    def __init__(self, path: str, width: int = 4, bound: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype(f"<u{width}")
        self.bound, self.held, self.held_first = bound, 0, 0
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # does a space belong to the word after it (byte-level) or is it dropped?
        self.space = " " if self.tokenizer.encode("a a", add_special_tokens=False).ids != 2 * self.tokenizer.encode("a", add_special_tokens=False).ids else ""
        self.line = self.library("\n")
        self.first: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.symbols = str.maketrans(dict(enumerate(_byte_symbols())))
        self.lead = self.space.translate(self.symbols)
        self.model = self.tokenizer.model
        self.code = {2: "H", 4: "I"}[width]

    def letters(self, word: str, lead: str) -> bytes:
        """Ids of a word of Latin letters, which is one pre-token: the library's
        model is asked directly, with the bytes spelled as byte-level symbols."""
        # ASCII letters are their own symbols
        marks = word if word.isascii() else word.encode().decode("latin-1").translate(self.symbols)
        return array(self.code, [t.id for t in self.model.tokenize(lead + marks)]).tobytes()

    def library(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def at_start(self, piece: str) -> bytes:
        """Ids of a piece with no space before it."""
        if not self.space:
            return self[piece]
        got = self.first.get(piece)
        if got is None:
            if self.held_first >= self.bound // 4:
                self.first.clear()
                self.held_first = 0
            if _LETTERS.fullmatch(piece):
                got = self.letters(piece, "")
            elif m := _WORD_MARKS.fullmatch(piece):
                got = self.at_start(m[1]) + self.at_start(m[2])
            elif _EDGE.search(piece):
                raise _Blank
            else:
                got = self.library(piece)
            self.first[piece] = got
            self.held_first += ENTRY_BYTES + len(piece) + len(got)
        return got

    def __missing__(self, piece: str) -> bytes:
        if "\n" in piece:  # two words and a line's end: seldom met again
            head, *rest = piece.split("\n")
            return b"".join([self[head], *[x for part in rest for x in (self.line, self.at_start(part))]])
        got = self.old.get(piece)
        if got is None:
            got = self.fresh(piece)
        if self.held >= self.bound:
            self.old, self.held = dict(self), 0
            self.clear()
        self[piece] = got
        self.held += ENTRY_BYTES + len(piece) + len(got)
        return got

    def parted(self, piece: str) -> bytes:
        """Ids of a piece; of a word with marks after it only the word is kept, so that more
        words are (for pieces that are looked up once in many texts)."""
        word = piece.rstrip("-.,;:!?*#$%&|/()")
        if word and len(word) < len(piece) and (word.isalpha() if word.isascii() else _LETTERS.fullmatch(word)):
            return self[word] + self.at_start(piece[len(word):])
        return self[piece]

    def fresh(self, piece: str) -> bytes:
        """Ids of a piece that isn't known."""
        if self.space and piece.isascii() and piece.isalpha():
            return array(self.code, [t.id for t in self.model.tokenize(self.lead + piece)]).tobytes()
        if _LETTERS.fullmatch(piece):
            if not self.space and (low := piece.lower()) != piece:
                return self[low]
            return self.letters(piece, self.lead)
        if m := _WORD_MARKS.fullmatch(piece):
            return self[m[1]] + self.at_start(m[2])
        if _EDGE.search(piece):
            raise _Blank
        if not self.space and _CASED.fullmatch(piece) and (low := piece.lower()) != piece:
            return self[low]
        return self.library(self.space + piece)

    def from_start(self, head: str) -> bytes:
        """Ids of what stands before a text's first space."""
        if "\n" in head:
            lead, *more = head.split("\n")
            return self.at_start(lead) + b"".join(self.line + self.at_start(x) for x in more)
        return self.at_start(head)

    def encode(self, text: str | None) -> bytes:
        """Id bytes of a whole text (null or empty: none)."""
        if not text:
            return b""
        if not any(s in text for s in self.special):
            head, *rest = text.split(" ")
            try:
                return self.from_start(head) + b"".join(map(self.__getitem__, rest))
            except _Blank:
                pass
        return self.library(text)

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's followed by ``end``, and how many each has.
        A piece is looked up once, however often the texts repeat it.  What this holds follows
        the texts, so give a few megabytes at a time."""
        texts = pc.fill_null(texts, "")
        split = pc.split_pattern(texts, " ")
        pieces = split.flatten().dictionary_encode()
        codes, n = pieces.indices.to_numpy(zero_copy_only=False).astype(np.int32), len(texts)
        n_pieces = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        text_of, first = np.repeat(np.arange(n, dtype=np.int32), n_pieces), n_pieces.cumsum() - n_pieces
        heads = pieces.dictionary.take(pieces.indices.take(pa.array(first))).to_pylist()
        later = np.ones(len(codes), bool)
        later[first] = False

        # entries: the pieces after a space, then each text's start
        used = np.flatnonzero(np.bincount(codes[later], minlength=len(pieces.dictionary)))
        entries, blank = [b""] * len(pieces.dictionary), np.zeros(len(pieces.dictionary), bool)
        for code, piece in zip(used.tolist(), pieces.dictionary.take(pa.array(used)).to_numpy(zero_copy_only=False)):
            try:
                entries[code] = self.parted(piece)
            except _Blank:
                blank[code] = True
        whole = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(bool)
        whole[text_of[later & blank[codes]]] = True
        for mark in self.special:
            whole |= pc.match_substring(texts, mark).to_numpy(zero_copy_only=False)
        for k, head in enumerate(heads):
            if not whole[k]:
                try:
                    entries.append(self.from_start(head))
                    continue
                except _Blank:
                    whole[k] = True
            entries.append(self.encode(texts[k].as_py()))  # all of it stands for its start
        codes[first] = np.arange(n) + len(blank)
        kept = ~(whole[text_of] & later)
        n_pieces = np.bincount(text_of[kept], minlength=n)
        codes = np.insert(codes[kept], n_pieces.cumsum(), len(entries))
        entries.append(end)

        size = np.fromiter(map(len, entries), np.int32, len(entries)) // self.dtype.itemsize
        n_ids = size[codes]
        ends = n_ids.cumsum(dtype=np.int64)
        # place of each id among the entries' ids
        place = np.repeat((size.cumsum(dtype=np.int64) - size)[codes] - (ends - n_ids), n_ids)
        place += np.arange(len(place))
        ids = np.frombuffer(b"".join(entries), self.dtype)[place]
        return ids, np.diff(ends[(n_pieces + 1).cumsum() - 1], prepend=0)


def encoder(path: str, width: int = 4, bound: int = CACHE_BYTES) -> PieceEncoder:
    """This process's encoder of a vocabulary file (Python workers are reused, so
    a cache outlives a task)."""
    return kept_by_process(("encoder", path, width, bound), lambda: PieceEncoder(path, width, bound))


def vocabulary_size(path: str) -> int:
    """The largest id of a vocabulary file, special ones included, and one more."""
    from tokenizers import Tokenizer

    return max(Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values()) + 1


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
