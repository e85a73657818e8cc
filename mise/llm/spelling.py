"""Spelling variant grouping: words one edit apart, found by PartEnum signatures.

A word's letters form a multiset; its k-th copy of a letter is one dimension of a binary
vector. One replaced letter changes two dimensions, an inserted or deleted one changes one.
The dimensions are dealt over parts by a fixed rule, and each way to leave out as many parts
as dimensions may differ gives a signature: the length and the letters in the parts that
stay. Two words within the distance share at least one of them, whichever parts differ
(``REPLACE`` parts, two left out, for words of one length; ``INSERT`` parts, one left out,
for lengths one apart). As an edit is either before or after the middle, each signature is
refined by the half that stays as it is, which loses nothing and splits the signatures that
very many words share. Words with equal signatures are joined and verified by edit distance. The
joins are by shuffle at every size: a table of words looks small before its signatures are made.

Cases: null and empty texts have no words; a null id counts as an empty one; repeated rows
count again; a text is read in stretches of ``STRETCH`` characters or more that end between
words, and a task hands its counts on when they hold ``HELD`` characters, so very long texts
and words take bounded memory; of equally frequent near words the first in code-point order is
the form; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.llm.common import apart, id_text, ship, stored

#: Fixed values of the contract: letters of a word, and the share of runs that lose a letter.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
GAP = re.compile("[^A-Za-zÀ-ÿ]")
EVERY = 97

REPLACE, INSERT = 3, 2
STRETCH, HELD = 1 << 20, 8 << 20


def stretches(text: str):
    """The text in pieces that end between words."""
    at = 0
    while len(text) - at > STRETCH:
        cut = GAP.search(text, at + STRETCH)
        if cut is None:
            break
        yield text[at:cut.start()]
        at = cut.start()
    yield text[at:] if at else text


def spelled(doc_id, run: str) -> str:
    """The word that a run counts as in a document: some runs lose a letter."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % EVERY else run[:h % len(run)] + run[h % len(run) + 1:]


def count_words(batches, least_chars: int):
    """Batches of (doc_id, text) -> (word, n): counts of a stretch of the task's documents."""
    held, size = {}, 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                          ["word", "n"])

    for batch in batches:
        for i, whole in zip(batch.column(0).to_pylist(), batch.column(1)):
            begin = zlib.crc32(f"{'' if i is None else i}:".encode())
            for text in stretches(whole.as_py()):
                for run in RUN.findall(text.encode().lower().decode()):   # bytes: A-Z only
                    if len(run) < least_chars:
                        continue
                    h = zlib.crc32(run.encode(), begin)
                    if not h % EVERY:
                        run = run[:h % len(run)] + run[h % len(run) + 1:]
                        if len(run) < least_chars:
                            continue
                    if run in held:
                        held[run] += 1
                    else:
                        held[run] = 1
                        size += len(run) + 32
                if size > HELD:
                    yield out()
                    held, size = {}, 0
    if held:
        yield out()


def mixed(*columns) -> np.ndarray:
    """64 well-mixed bits of columns of 64-bit numbers, or of columns and single numbers."""
    x = np.uint64(0x9E3779B97F4A7C15)
    for c in columns:
        x = (x ^ np.asarray(c, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ x >> np.uint64(29)
    return x


def text_bits(text: str) -> int:
    data = text.encode()
    return zlib.crc32(data) | zlib.crc32(data, 0x5BD1E995) << 32


class Dimensions:
    """The bits and the part of each copy of a letter, kept once met, for one number of parts."""

    def __init__(self, parts: int):
        self.parts, self.known = parts, {}

    def sets(self, words: list[str]) -> np.ndarray:
        """A row a word: one set hash for the letters in each part."""
        known, parts, out = self.known, self.parts, []
        for word in words:
            copies, sums = {}, [0] * parts
            for c in word:
                k = copies[c] = copies.get(c, 0) + 1
                hit = known.get((c, k))
                if hit is None:
                    x = int(mixed([ord(c)], [k])[0])
                    hit = known[c, k] = (x, (x >> 20) % parts)
                sums[hit[1]] ^= hit[0]
            out.append(sums)
        return np.array(out, dtype=np.uint64).reshape(len(words), parts)


def signatures(words: list[str], kind: int, dimensions: Dimensions) -> np.ndarray:
    """A row of keys for each word. Kind 0: words of one length; 1 and 2: the shorter and the
    longer of two words whose lengths differ by one."""
    out_of = 2 if kind == 0 else 1
    sets = dimensions.sets(words)
    size = np.array([len(w) - (kind == 2) for w in words], dtype=np.uint64)
    begin = np.array([text_bits(w[:(len(w) - (kind == 2)) // 2]) for w in words], dtype=np.uint64)
    end = np.array([text_bits(w[(len(w) + (kind == 2)) // 2:]) for w in words], dtype=np.uint64)
    keys = []
    for left_out in combinations(range(dimensions.parts), out_of):
        kept = [p for p in range(dimensions.parts) if p not in left_out]
        rest = np.bitwise_xor.reduce(sets[:, kept], axis=1)
        keys += [mixed(size, rest, *left_out, begin, 0), mixed(size, rest, *left_out, end, 1)]
    return np.stack(keys, axis=1)


def sign(batches, kind: int):
    """Batches of (word, n) -> a row for each signature."""
    dimensions = Dimensions(REPLACE if kind == 0 else INSERT)
    for batch in batches:
        for at in range(0, len(batch), 4096):
            part = batch.slice(at, 4096)
            keys = signatures(part.column(0).to_pylist(), kind, dimensions)
            take = pa.array(np.repeat(np.arange(len(part), dtype=np.int32), keys.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), part.column(0).take(take), part.column(1).take(take)],
                ["key", "word", "n"])


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every ordered pair of words one edit apart, once or more often."""
    ship(words.sparkSession)

    def side(kind: int, name: str) -> DataFrame:
        return words.select("word", "n").mapInArrow(lambda b: sign(b, kind), f"key long, {name} string, {name}_n long")

    verified = F.levenshtein(F.col("x"), F.col("y"), 1) == 1
    equal = side(0, "x").join(apart(side(0, "y")), "key").filter((F.col("x") < F.col("y")) & verified)
    longer = side(1, "x").join(apart(side(2, "y")), "key").filter(verified)
    both = F.array(F.struct(F.col("x").alias("word"), F.col("y").alias("near"), F.col("y_n").alias("near_n")),
                   F.struct(F.col("y").alias("word"), F.col("x").alias("near"), F.col("x_n").alias("near_n")))
    return equal.unionByName(longer).select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for words with a form: the last word of the chain of forms.

    A form occurs twice as often as its word, so that chains are short; each round doubles the
    steps taken."""
    up = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        further = up.join(apart(over), "root", "left").select(
            "word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved"))
        up = stored(further, "roots")
        if up.filter("moved").isEmpty():
            return up.select("word", "root")


def variants(docs: DataFrame, least_chars: int = 5, least_n: int = 3, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of ``least_chars`` code points or more
    that occur ``least_n`` times or more: the form is the most frequent near word if it
    occurs at least ``times`` (2 or more) as often."""
    ship(docs.sparkSession)
    counted = id_text(docs).mapInArrow(lambda b: count_words(b, least_chars), "word string, n long")
    words = stored(counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_n), "words")
    near = near_pairs(words).repartition("word").groupBy("word", "near").agg(F.max("near_n").alias("near_n"))
    best = near.groupBy("word").agg(F.count("*").alias("n_near"),
                                    F.min(F.struct((-F.col("near_n")).alias("least"), "near")).alias("x"))
    takes = -F.col("x.least") >= times * F.col("n")
    found = stored(words.join(apart(best), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(takes, F.col("x.near")).alias("form"),
        F.when(takes, -F.col("x.least")).alias("form_n")), "variants")
    ends = roots(found.filter("form IS NOT NULL"))
    return found.join(apart(ends), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
