"""Exact tokenizing by cached chunks.

A BPE tokenizer cuts a text into pre-tokens and merges inside each of them only, so the ids of a text are those of its
chunks, wherever chunks end at pre-token borders. Words repeat far more often than texts, so chunks are looked up and
only new ones go through the tokenizers library. The chunk borders used here are borders under the tokenizer's own
pattern; the tests hold the ids against the library on whole texts. The strings of the tokenizer's special tokens are
matched in texts, as the library does unless told otherwise; a text that may have one goes through the library whole.
"""

from __future__ import annotations

import os
import re
import sys
from array import array

from tasklens.llm.common import kept

#: Entries after which a cache turns over (chunks, single pre-tokens: with and without white space; rarer chunks); it holds twice as many at most.
CACHE_ROWS, MERGED_ROWS, RARE_ROWS = {True: 320_000, False: 400_000}, {True: 220_000, False: 300_000}, 60_000
#: The tokenizer's white space (Unicode White_Space), fixed values.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUNS = re.compile(f"[{SPACE}][{SPACE}]")
ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
#: Marks that follow a word; a word of letters and such a mark are two pre-tokens under either pattern.
MARKS = ".,!?;:*$%&#"


def _load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def _packed(ids: list[int]) -> bytes:
    out = array("H", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


class _Cache(dict):
    """chunk -> its ids as little-endian bytes; with `most` entries it becomes the older half, so memory is bounded and frequent chunks stay."""

    def __init__(self, make, most: int):
        self.make, self.most, self.older = make, most, {}

    def __missing__(self, chunk: str) -> bytes:
        out = self.older.get(chunk)
        if out is None:
            out = self.make(chunk)
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()
        self[chunk] = out
        return out


def _byte_letters() -> list[str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 stands for itself, the rest follow from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


BYTE_LETTERS = _byte_letters()


class Encoder:
    """Ids of whole texts as little-endian unsigned 16-bit bytes (both vocabularies have fewer than 65,536 ids)."""

    def __init__(self, path: str, keeps_space: bool):
        self.tokenizer = _load(path)
        self.model = self.tokenizer.model
        self.direct, self.merged = _Cache(self._direct, RARE_ROWS), _Cache(self._merged, MERGED_ROWS[keeps_space])
        added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        # what all strings of special tokens begin with, up to the first letter, whose case may be changed
        self.special = re.match(r"[^A-Za-z]*", os.path.commonprefix(added))[0] if added else None
        if keeps_space:
            self.bare, self.spaced = _Cache(self._bare, RARE_ROWS), _Cache(self._spaced, CACHE_ROWS[True])
            self.chunks = self._with_space
        else:
            self.word = _Cache(self._word, CACHE_ROWS[False])
            self.chunks = self._without_space

    def encode(self, text: str) -> bytes:
        return self._direct(text) if self.special is not None and self.special in text else self.chunks(text)

    def _direct(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _merged(self, piece: str) -> bytes:
        """Ids of one pre-token: only its merges are left to do."""
        letters = piece.replace(" ", "Ġ") if piece.isascii() else "".join(map(BYTE_LETTERS.__getitem__, piece.encode()))
        return _packed([x.id for x in self.model.tokenize(letters)])

    def _marked(self, chunk: str, first: str) -> bytes | None:
        """A plain word, perhaps with marks behind it: the word's ids, then those of the marks."""
        word = chunk.rstrip(MARKS)
        if word.isalpha() and (word.isascii() or max(word) < "ɐ" and "İ" not in word):
            ids = self.merged[first + word]
            return ids + self.merged[chunk[len(word) :]] if len(word) < len(chunk) else ids
        return None

    # Words apart from white space: it is dropped, and letters are lowered one by one.
    def _word(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        if chunk.isascii() or max(chunk) < "ɐ" and "İ" not in chunk:
            chunk = chunk.lower()
        out = self._marked(chunk, "")
        return self.tokenized(chunk) if out is None else out

    def tokenized(self, chunk: str) -> bytes:
        return self.direct[chunk] if len(chunk) <= 64 else self._direct(chunk)

    def _without_space(self, text: str) -> bytes:
        return b"".join(map(self.word.__getitem__, text.replace("\n", " ").split(" ")))

    # White space belongs to the next pre-token or is one itself.
    def _bare(self, chunk: str) -> bytes:
        if not chunk:
            return b""
        out = self._marked(chunk, "")
        return self.tokenized(chunk) if out is None else out

    def _spaced(self, chunk: str) -> bytes:
        out = self._marked(chunk, " ")
        return self.tokenized(" " + chunk) if out is None else out

    def _with_space(self, text: str) -> bytes:
        # ASCII texts without odd white space are told apart by plain searches, which are faster than the pattern
        plain = text.isascii() and not any(map(text.__contains__, ODD))
        if (not plain and RUNS.search(text)) or (text and (text[0] in " \n" or text[-1] in " \n")):
            return b"".join(map(self.tokenized, PIECES.findall(text)))
        out, bare, spaced, line_feed = [], self.bare, self.spaced.__getitem__, self.direct["\n"]
        for line in text.split("\n"):
            head, *rest = line.split(" ")
            out.append(bare[head])
            out.extend(map(spaced, rest))
            out.append(line_feed)
        return b"".join(out[:-1])


def encoder(owner: str, path: str, keeps_space: bool) -> Encoder:
    """One for each Python worker, kept from task to task of owner, the module whose tasks call."""
    return kept(owner, f"{path} {keeps_space}", lambda: Encoder(path, keeps_space))
