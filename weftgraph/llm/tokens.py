"""Token ids of whole texts with the tokenizers library, through a cache of pieces.

A text is cut where the tokenizer's own pre-tokenizer always cuts, each distinct piece is encoded once by the library,
and a document is the concatenation of its pieces' ids. Texts where the cuts would not be safe are encoded whole.
Ids are kept as little-endian unsigned 32-bit bytes.
"""

from __future__ import annotations

import os
import re
import sys
from array import array
from functools import lru_cache
from itertools import compress, count, repeat
from operator import is_

CACHE_PIECES = 700_000
WHOLE_BATCH_CHARS = 200_000


def tokenizer_path(name: str, folder: str = "/opt/tokenizers") -> str:
    """Place of a public vocabulary file; folder holds the public_tokenizers module."""
    if folder not in sys.path:
        sys.path.append(folder)
    try:
        import public_tokenizers
    except ModuleNotFoundError:
        return os.path.join(folder, name)
    return public_tokenizers.path(name)


#: White space other than blank and line feed.
_OTHER_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
#: Single blanks and line feeds between other characters always open a new piece of byte-level BPE; texts with any of
#: these are encoded whole.
_BYTE_UNSAFE = ("  ", "\n\n", " \n", "\n ", "<|", "\x00", *_OTHER_SPACES)
#: The library does not take these four controls as white space, str.split() does.
_WORD_UNSAFE = re.compile("<\\||[\x1c-\x1f]")


def _visible_bytes() -> dict[int, str]:
    """Byte-level BPE's characters for bytes: printable ones for themselves, the rest from 256 on."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b if b in kept else next(spare)) for b in range(256)}


class PieceEncoder:
    """encode(texts) -> ids of each text as bytes. kind: "byte" keeps spaces in the pieces, "word" drops them.

    Pieces seen first stay in the cache until it is full; later ones are encoded when they come.
    """

    def __init__(self, path: str, kind: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.kind = kind
        self.known: dict[str, bytes] = {}
        self.visible = _visible_bytes()

    def _whole(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        part: list[str] = []
        size = 0
        for i, t in enumerate(texts):
            part.append(t)
            size += len(t)
            if size >= WHOLE_BATCH_CHARS or i == len(texts) - 1:
                done = self.library.encode_batch_fast(part, add_special_tokens=False)
                out += [array("I", e.ids).tobytes() for e in done]
                part, size = [], 0
        return out

    def _pieces(self, text: str) -> list[str] | None:
        if self.kind == "word":
            return None if _WORD_UNSAFE.search(text) else text.split()
        if not text or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in _BYTE_UNSAFE):
            return None
        # "a b" and line ends: the space goes with the word after it, a line end stands alone.
        return text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00").split("\x00")

    def _new(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of pieces. One run of letters is one pre-token, which the library's model takes as it is."""
        out: dict[str, bytes] = {}
        rest: list[str] = []
        tokenize, visible, word = self.model.tokenize, self.visible, self.kind == "word"
        for p in pieces:
            letters = p[1:] if p[:1] == " " else p
            if letters.isalpha() and (letters.isascii() or not word or max(letters) < "\u0130"):
                core = (p.lower() if word else p).encode().decode("latin-1").translate(visible)
                out[p] = array("I", [t.id for t in tokenize(core)]).tobytes()
            else:
                rest.append(p)
        out.update(zip(rest, self._whole(rest), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self._pieces(t) for t in texts]
        known = self.known
        got = [None if pieces is None else list(map(known.get, pieces)) for pieces in cut]
        # One look-up a piece; what was not found is encoded and put in its places.
        gaps = [() if g is None else list(compress(count(), map(is_, g, repeat(None)))) for g in got]
        new = {pieces[i] for pieces, at in zip(cut, gaps, strict=True) for i in at}
        if new:
            # A full stop or comma after a letter is a pre-token of its own, so only the rest is encoded again.
            ended = {p: p[:-1] for p in new if len(p) > 2 and p[-1] in ".," and p[-2].isalpha() and p[-2] < "\u0130"}
            ask = {*ended.values(), ".", ",", *(p for p in new if p not in ended)}
            added = self._new([p for p in ask if p not in known])
            find = lambda p: added.get(p) or known[p]
            for p, core in ended.items():
                added[p] = find(core) + find(p[-1])
            for pieces, g, at in zip(cut, got, gaps, strict=True):
                for i in at:
                    g[i] = added[pieces[i]]
            if len(known) < CACHE_PIECES:
                known.update(added)
        whole = iter(self._whole([t for t, pieces in zip(texts, cut, strict=True) if pieces is None]))
        return [next(whole) if g is None else b"".join(g) for g in got]


@lru_cache(4)
def piece_encoder(path: str, kind: str) -> PieceEncoder:
    """One encoder a Python worker."""
    return PieceEncoder(path, kind)
