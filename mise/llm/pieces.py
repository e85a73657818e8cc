"""Encoding and decoding with a SentencePiece vocabulary by a streaming search.

A unigram vocabulary encodes a text as the split into pieces with the greatest sum of scores,
the earlier and shorter split winning ties (``Pieces``). A BPE vocabulary (``Merges``) joins
neighbours again and again, the pair whose piece has the best score first, the leftmost of
equals. A split is the outcome of that exactly if every two pieces in a row are the outcome
for their own text: the first join across a border would be the first one in that pair, too.
So each boundary has one last piece, that which may follow the last piece where it begins,
and the search is the same with this rule in place of the sum. White space is escaped as in SentencePiece (a space becomes U+2581, one is put in front);
characters that no piece covers, and U+2581 itself, become their UTF-8 byte pieces, so that
decoding gives every text back exactly.

The search reads the text once. It keeps the best score or the last piece, and that piece's
length, for the ``longest piece`` last boundaries only. Whenever all their backpointer paths run through one
boundary, everything up to it is settled: its ids are committed and forgotten. Memory of a
search is that window plus the stretch since the last commit.

No piece but runs of U+2581 has that character after its first place, so paths always meet in
front of a word. Such vocabularies encode a text word by word: it is split as a whole, and only
a new word is searched. Committed words are remembered (up to ``CACHE_WORDS`` per worker, then
forgotten all at once), and a word seen before skips the search. So are up to ``CACHE_PAIRS``
answers whether a piece may follow another.

Cases: a null or empty text has no ids and decodes to the empty text; repeated rows are
encoded alike; null ids are kept; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mise.llm.common import id_text, ship

MARK = "▁"
CACHE_WORDS = 1_500_000
CACHE_PAIRS = 500_000
UNKNOWN_SCORE = -1e6        # of each byte piece: worse than any split into other pieces
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
NORMAL, BYTE = 1, 6         # fixed values: piece types of the model format
BPE = 2                     # and a model type
COLUMNS = "doc_id long, n_tokens long, n_byte_tokens long, ids_crc32 long, decoded_sha256 string, exact boolean"

_models: dict = {}


def model_type(path: str) -> int:
    from sentencepiece import sentencepiece_model_pb2 as format_
    with open(path, "rb") as f:
        return format_.ModelProto.FromString(f.read()).trainer_spec.model_type


class Pieces:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as format_
        with open(path, "rb") as f:
            proto = format_.ModelProto.FromString(f.read())
        self.pieces = [p.piece for p in proto.pieces]
        # the mark in front of a text, then pieces of text; runs of marks are such pieces, too
        self.scores = {p.piece: (p.score, k) for k, p in enumerate(proto.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): k for k, p in enumerate(proto.pieces) if p.type == BYTE}
        self.value = {k: b for b, k in self.bytes.items()}
        self.longest = max(map(len, self.scores))
        # may a search begin afresh in front of every word?
        self.by_words = not any(MARK in p[1:] and p.strip(MARK) for p in self.scores)
        self.cache: dict[str, tuple[int, ...]] = {}

    def byte_ids(self, c: str) -> list[int]:
        return [self.bytes[b] for b in c.encode()]

    def stream(self, text: str):
        """Commits of an escaped text: lists of ids, in order. ``literal`` marks are not in it."""
        longest, scores = self.longest, self.scores
        best = [0.0]            # of the boundaries base, base + 1, ...
        back: list[tuple[int, list[int]]] = [(0, [])]       # (length of the last piece, its ids)
        base = 0
        for end in range(1, len(text) + 1):
            top, how = None, None
            for size in range(1, min(longest, end - base) + 1):
                found = scores.get(text[end - size:end])
                if found is not None:
                    s = best[end - size - base] + found[0]
                    if top is None or s > top:
                        top, how = s, (size, [found[1]])
            if top is None or text[end - 1] not in scores:
                # byte pieces for a character that is no piece itself
                ids = self.byte_ids(text[end - 1])
                s = best[end - 1 - base] + UNKNOWN_SCORE * len(ids)
                if top is None or s > top:
                    top, how = s, (1, ids)
            best.append(top)
            back.append(how)
            if end - base >= 2 * longest:
                meet = self.meeting(back, base, end)
                if meet > base:
                    yield self.path(back, base, meet)
                    shift = meet - base
                    best, back, base = best[shift:], back[shift:], meet
        if len(text) > base:
            yield self.path(back, base, len(text))

    def meeting(self, back, base: int, end: int) -> int:
        """The last boundary that the paths of the window's boundaries all run through."""
        alive = set(range(max(base, end - self.longest + 1), end + 1))
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(last - back[last - base][0])
        return alive.pop()

    @staticmethod
    def path(back, base: int, end: int) -> list[int]:
        steps = []
        while end > base:
            size, ids = back[end - base]
            steps.append(ids)
            end -= size
        return [k for ids in reversed(steps) for k in ids]

    def search(self, text: str) -> tuple[int, ...]:
        return tuple(k for ids in self.stream(text) for k in ids)

    def encode(self, text: str) -> list[int]:
        if not text:
            return []
        out: list[int] = []
        # U+2581 in a text would decode as a space: it is written as bytes
        for k, part in enumerate(text.split(MARK)):
            if k:
                out += self.byte_ids(MARK)
            escaped = part.replace(" ", MARK)
            if not k:
                escaped = MARK + escaped
            if not escaped:
                continue
            if not self.by_words:
                out += self.search(escaped)
                continue
            cache = self.cache
            for word in WORD.findall(escaped):
                ids = cache.get(word)
                if ids is None:
                    if len(cache) >= CACHE_WORDS:
                        cache.clear()
                    ids = cache[word] = self.search(word)
                out += ids
        return out

    def decode(self, ids) -> str:
        out, pending = [], bytearray()
        for k in ids:
            b = self.value.get(k)
            if b is not None:
                pending.append(b)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.pieces[k].replace(MARK, " "))
        if pending:
            out.append(pending.decode("utf-8", "replace"))
        return "".join(out)[1:]         # without the space put in front


class Merges(Pieces):
    """A BPE vocabulary."""

    def __init__(self, path: str):
        super().__init__(path)
        self.pairs: dict[tuple, bool] = {}
        self.tails: dict = {}       # the pieces read backwards, letter by letter; "" holds a piece's id
        for p, (_, k) in self.scores.items():
            node = self.tails
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = k

    def merged(self, text: str) -> list[str]:
        parts, scores = list(text), self.scores
        while True:
            top, at = None, 0
            for k in range(len(parts) - 1):
                found = scores.get(parts[k] + parts[k + 1])
                if found is not None and (top is None or found[0] > top):
                    top, at = found[0], k
            if top is None:
                return parts
            parts[at:at + 2] = [parts[at] + parts[at + 1]]

    def follows(self, before: int | str, piece: int | str) -> bool:
        """May the piece come after another (or none, at the beginning)? Pieces go by id, characters
        that are no piece by themselves."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        x, y = (p if isinstance(p, str) else self.pieces[p] for p in (before, piece))
        known = self.pairs[before, piece] = self.merged(x + y) == ([x, y] if x else [y])
        return known

    def stream(self, text: str):
        longest, tails, pairs = self.longest, self.tails, self.pairs
        last: list = [""]           # the last piece of the boundaries base, base + 1, ...
        back: list[tuple[int, list[int]]] = [(0, [])]       # (its length, its ids)
        base = 0
        for end in range(1, len(text) + 1):
            # the pieces that end here: one step back at a time through those read backwards
            at, node, fits = end - 1, tails.get(text[end - 1]), []
            while node is not None:
                k = node.get("")
                if k is not None:
                    fits.append((end - at, k))
                at -= 1
                if at < base:
                    break
                node = node.get(text[at])
            if not fits or fits[0][0] > 1:
                fits.insert(0, (1, text[end - 1]))      # no piece: it stays alone, as its byte pieces
            while True:
                size, piece = fits.pop()
                before = last[end - size - base]
                known = pairs.get((before, piece))
                if not fits or (self.follows(before, piece) if known is None else known):
                    break
            last.append(piece)
            back.append((size, self.byte_ids(piece) if isinstance(piece, str) else [piece]))
            if end - base >= 2 * longest:
                meet = self.meeting(back, base, end)
                if meet > base:
                    yield self.path(back, base, meet)
                    shift = meet - base
                    last, back, base = last[shift:], back[shift:], meet
        if len(text) > base:
            yield self.path(back, base, len(text))


def pieces_of(path: str) -> Pieces:
    """The worker's vocabulary, kept over tasks."""
    if path not in _models:
        _models[path] = Merges(path) if model_type(path) == BPE else Pieces(path)
    return _models[path]


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids) of every document."""
    ship(docs.sparkSession)

    def run(batches):
        model = pieces_of(path)
        for b in batches:
            ids = [model.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))],
                                             names=["doc_id", "ids"])

    return id_text(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""
    ship(encoded.sparkSession)

    def run(batches):
        model = pieces_of(path)
        for b in batches:
            texts = [model.decode(x or ()) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())],
                                             names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Per document: numbers of ids and of byte ids, crc32 of the ids, sha256 of the decoded text
    and whether that is the text."""
    ship(docs.sparkSession)

    def run(batches):
        model = pieces_of(path)
        is_byte = np.zeros(len(model.pieces), bool)
        is_byte[list(model.value)] = True
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = model.encode(text)
                got = model.decode(ids)
                flat = np.array(ids, "<u4")
                rows.append((doc_id, len(ids), int(is_byte[flat].sum()), zlib.crc32(flat.tobytes()),
                             hashlib.sha256(got.encode()).hexdigest(), got == text))
            cols = list(zip(*rows)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                             names=[f.split()[0] for f in COLUMNS.split(", ")])

    return id_text(docs).mapInArrow(run, COLUMNS)
