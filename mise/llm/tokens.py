"""Whole-text encoding with the ``tokenizers`` library, piece by piece.

Both vocabularies split a text at white space before any merge, so the ids of a text
are the ids of its pieces one after the other, provided that it is cut only where the
library cuts as well:

* ``spaced``: byte-level pre-tokenisation takes one leading space into a piece and ends a
  piece before a space that follows a non-space character. The text is cut there. Python's
  white space includes all of Unicode's, so that a character which is no white space for
  Python is none for the library.
  A piece that is not known yet is cut further: where a letter meets a punctuation mark or a newline,
  and after a newline alone between two characters that are no white space. Pre-tokenisation has
  no match over such a place and never looks back, so a word is encoded once, whatever follows it.
* ``dropped``: the vocabulary drops white space, so any space or newline is a cut.

Pieces repeat; their ids are remembered per worker in two generations of half of ``cache_bytes`` each:
when the young one is full it becomes the old one, whose pieces come back when they are met
again. Pieces of over ``LONGEST_KEPT`` characters are not remembered. Texts are split and encoded
``SLICE`` pieces at a time. That bounds memory and never changes a result.

New pieces are encoded many at a time, joined by a special token, whose text no such piece holds:
the library cuts there before anything else, and so does the result.
"""

from __future__ import annotations

import gc
import os
import re

import numpy as np

CACHE_BYTES = 384 << 20
ENTRY_BYTES = 200       # of a remembered piece besides its characters and ids
LONGEST_KEPT = 64
SLICE = 200_000
CALL_PIECES = 32
CUT = re.compile(r"(?<=\S)(?= )")
RUNS = re.compile(r"\s ")
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]"
INSIDE = re.compile(rf"(?<={LETTER})(?=[.,;:!?#$%&*\n])|(?<=\S\n)(?={LETTER})")

_encoders: dict = {}


class Encoder:
    def __init__(self, path: str, style: str, cache_bytes: int = CACHE_BYTES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        size = self.tok.get_vocab_size(with_added_tokens=True)
        self.width = "<u2" if size <= 1 << 16 else "<u4"
        self.style, self.cache_bytes = style, cache_bytes
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.held, self.long = 0, []
        ends = [(t.content, i) for i, t in self.tok.get_added_tokens_decoder().items() if t.special and not (t.lstrip or t.rstrip)]
        self.stop = ends[-1] if ends else None

    def pieces(self, text: str) -> list[str]:
        if self.style == "dropped":
            return text.replace("\n", " ").split(" ")
        if RUNS.search(text):
            return CUT.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + w for w in rest]] if rest else [first]

    def know(self, pieces: set[str]) -> None:
        """All of the pieces are remembered in the young generation until ``forget``."""
        missing = self.recalled(pieces.difference(self.young))
        if self.style != "spaced":
            return self.learn(missing)
        inside = {w: INSIDE.split(w) for w in missing if not w[1:].isalpha() and "<" not in w and INSIDE.search(w)}
        self.learn(self.recalled(set(missing).difference(inside).union(*inside.values()).difference(self.young)))
        get = self.young.__getitem__
        self.remember(list(inside), [b"".join(map(get, parts)) for parts in inside.values()])

    def recalled(self, pieces: set[str]) -> list[str]:
        """Old pieces become young again; those that are not remembered at all are returned."""
        found = [w for w in pieces if w in self.old]
        self.remember(found, [self.old[w] for w in found])
        return list(pieces.difference(found))

    def remember(self, pieces: list[str], ids: list[bytes]) -> None:
        self.young.update(zip(pieces, ids, strict=True))
        self.held += ENTRY_BYTES * len(pieces) + sum(map(len, pieces)) + sum(map(len, ids))
        self.long += [w for w in pieces if len(w) > LONGEST_KEPT]

    def learn(self, pieces: list[str]) -> None:
        for part, ids in self.fresh(pieces):
            self.remember(part, ids)

    def forget(self) -> None:
        for w in self.long:
            self.held -= ENTRY_BYTES + len(w) + len(self.young.pop(w))
        self.long.clear()
        if self.held > self.cache_bytes // 2:
            self.old, self.young, self.held = self.young, {}, 0

    def fresh(self, pieces: list[str]):
        """(some pieces, ids of each) by the library."""
        plain = [w for w in pieces if "<" not in w and self.stop is not None]
        for k in range(0, len(plain), CALL_PIECES):
            part = plain[k:k + CALL_PIECES]
            text, stop = self.stop
            ids = np.array(self.tok.encode_batch_fast([text.join(part)], add_special_tokens=False)[0].ids, dtype=self.width)
            data, size = ids.tobytes(), ids.itemsize
            ends = [*(np.flatnonzero(ids == stop) * size).tolist(), len(data)]
            yield part, [data[at:end] for at, end in zip([0, *(x + size for x in ends[:-1])], ends)]
        rest = pieces if self.stop is None else [w for w in pieces if "<" in w]
        for k in range(0, len(rest), CALL_PIECES):
            part = rest[k:k + CALL_PIECES]
            yield part, [np.array(e.ids, dtype=self.width).tobytes()
                         for e in self.tok.encode_batch_fast(part, add_special_tokens=False)]

    def encode(self, texts: list[str], end: int | None = None) -> list[np.ndarray]:
        """Ids of each text, in the narrowest little-endian width, ``end`` put after each."""
        tail = b"" if end is None else np.array([end], dtype=self.width).tobytes()
        out, split, size = [], [], 0

        def flush():
            nonlocal size
            self.know(set().union(*split))
            get = self.young.__getitem__
            out.extend(np.frombuffer(b"".join(map(get, p)) + tail, dtype=self.width) for p in split)
            self.forget()
            split.clear()
            size = 0

        # millions of strings in no cycles: the collector would only walk over them
        collects = gc.isenabled()
        gc.disable()
        try:
            for text in texts:
                p = self.pieces(text)
                split.append(p)
                size += len(p)
                if size > SLICE:
                    flush()
            flush()
        finally:
            if collects:
                gc.enable()
        return out


def encoder(path: str, style: str, cache_bytes: int = CACHE_BYTES) -> Encoder:
    """The worker's encoder for a vocabulary, kept over tasks."""
    if (path, style) not in _encoders:
        _encoders[path, style] = Encoder(path, style, cache_bytes)
    _encoders[path, style].cache_bytes = cache_bytes
    return _encoders[path, style]
