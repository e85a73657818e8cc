"""Best-fit-decreasing packing of documents into sequences of a fixed token budget.

Documents are encoded where they lie; only documents longer than a sequence are cut, into
full pieces and a shorter last one. The packing is global and exact best-fit decreasing,
although no task or driver ever sees all pieces: pieces of equal length are interchangeable,
so the plan needs only how many pieces there are of each length, at most ``capacity``
numbers. The driver walks the lengths downwards. A segment tree over the remaining
capacities 0..``capacity`` (leaf r: open sequences with r tokens left) gives the tightest
sequence that a length fits in logarithmic time, and one step places a whole run of equal
pieces into a whole range of equal sequences. The resulting runs (length, first rank, pieces
per sequence, first sequence, offset) are joined to the pieces by their rank among the
pieces of their length.

Cases: a null or empty text is a document of one token (the end id); null doc_ids and
repeated rows are separate documents that each get their place; an empty table gives no
rows; other columns are ignored. Ranks among pieces of one length follow the stored
partitions, so sequence numbers may differ between runs, the number of sequences not.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mise.llm.common import id_text, ship, stored
from mise.llm.tokens import CACHE_BYTES, encoder

CAPACITY = 4096
END = 1
PIECES = ("doc_id long, piece int, start long, length long, ids_crc32 long, "
          "part int, nth long")


class Capacities:
    """Segment tree over remaining capacities: which is the least one >= a length with an
    open sequence. Each leaf holds its sequences as ranges [first, last)."""

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.size)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def add(self, r: int, first: int, last: int) -> None:
        self.ranges[r].append((first, last))
        self._change(r, last - first)

    def take(self, r: int, most: int) -> tuple[int, int]:
        """Up to ``most`` sequences of the range that leaf r got last."""
        first, last = self.ranges[r].pop()
        if last - first > most:
            self.ranges[r].append((first + most, last))
            last = first + most
        self._change(r, first - last)
        return first, last

    def _change(self, r: int, by: int) -> None:
        k = r + self.size
        while k:
            self.count[k] += by
            k //= 2

    def tightest(self, length: int) -> int | None:
        k = length + self.size
        while not self.count[k]:            # up until a right neighbour has some
            while k & 1:
                k //= 2
            if not k:
                return None
            k += 1
        while k < self.size:                # down to its leftmost leaf with some
            k = 2 * k if self.count[2 * k] else 2 * k + 1
        return k - self.size


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple]:
    """Best-fit decreasing over (length -> pieces): runs of (length, first rank, last rank,
    pieces per sequence, first sequence, offset of the first piece in it)."""
    tree, opened, runs = Capacities(capacity), 0, []
    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while rank < n:
            r = tree.tightest(length)
            if r is None:
                r, per = capacity, capacity // length
                first, last = opened, opened + -(-(n - rank) // per)
                opened = last
            else:
                per = r // length
                first, last = tree.take(r, -(-(n - rank) // per))
            here = min(n - rank, (last - first) * per)
            runs.append((length, rank, rank + here, per, first, capacity - r))
            whole, over = divmod(here, per)
            if whole:
                tree.add(r - per * length, first, first + whole)
            if over:
                tree.add(r - over * length, first + whole, first + whole + 1)
            rank += here
    return runs


def pieces(docs: DataFrame, path: str, capacity: int, end: int, cache_bytes: int) -> DataFrame:
    """One row per piece, with its task and its number among the task's pieces of that length."""

    def cut(batches):
        from pyspark import TaskContext
        enc, part, seen = encoder(path, "dropped", cache_bytes), TaskContext.get().partitionId(), {}
        for batch in batches:
            rows = []
            texts = batch.column(1).to_pylist()
            for doc, ids in zip(batch.column(0).to_pylist(), enc.encode(texts, end)):
                ids = ids.astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    own = ids[at:at + capacity]
                    nth = seen.get(len(own), 0)
                    seen[len(own)] = nth + 1
                    rows.append((doc, k, at, len(own), zlib.crc32(own.tobytes()), part, nth))
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(),
                                                       pa.int64(), pa.int32(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return id_text(docs).mapInArrow(cut, PIECES)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = END,
         cache_bytes: int = CACHE_BYTES) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece. ``cache_bytes``:
    what a worker may remember of encoded words."""
    spark = docs.sparkSession
    ship(spark)
    cut = stored(pieces(docs, path, capacity, end, cache_bytes), "pieces")
    by_part = cut.groupBy("part", "length").agg(F.max("nth").alias("last"))
    # at most (tasks x capacity) rows: where each task's pieces of a length begin
    w = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = by_part.select("part", "length",
                          F.coalesce(F.sum(F.col("last") + 1).over(w), F.lit(0)).alias("base"))
    # at most `capacity` rows reach the driver
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs: dict[int, list] = {}
    for length, rank, _last, per, first, offset in plan(histogram, capacity):
        runs.setdefault(length, []).append((rank, per, first, offset))
    steps = {k: (tuple(x[0] for x in v), v) for k, v in runs.items()}
    sent = spark.sparkContext.broadcast(steps)   # bounded by the lengths, not by the documents

    def place(batches):
        steps = sent.value
        for b in batches:
            length, rank = b.column("length").to_pylist(), b.column("rank").to_pylist()
            seq, off = [], []
            for n, k in zip(length, rank):
                starts, own = steps[n]
                at, per, first, offset = own[bisect_right(starts, k) - 1]
                more, nth = divmod(k - at, per)
                seq.append(first + more)
                off.append(offset + nth * n)
            cols = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(seq, pa.int64()), pa.array(off, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    ranked = cut.join(base, ["part", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("nth")).alias("rank"))
    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, "
                                    "ids_crc32 long, sequence_id long, offset long")
