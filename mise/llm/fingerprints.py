"""Document fingerprints: improbable byte windows in chained Bloom filters.

* Windows of ``WINDOW`` bytes begin at every byte. Short texts have windows of ``SHORT`` bytes:
  below ``4 * WINDOW`` bytes only these, below ``8 * WINDOW`` both, so that an edit that moves a
  text over one of the bounds leaves it one kind.
* A window's feature value is the Shannon entropy of its bytes, in ``LEVELS`` steps, kept up from
  byte to byte in whole numbers. How rare each step is in all windows of all documents ranks the
  windows, equals by a hash of their first bytes; the rarest of any ``SPACING`` in a row are
  selected, about one in 16 bytes, which drops the commonplace ones.
* Selected windows are hashed into Bloom filters of ``BITS`` bits, ``PROBES`` bits a window; a
  filter that holds ``FILL`` windows is closed and the next one begins.
* Two fingerprints are compared filter by filter: the bits in common, less those expected in
  two unrelated filters of that fill, divided by the most there could be less the same; for
  each filter of the shorter chain the best filter of the longer one counts.

``neighbours`` gives every document its next one in descending order of doc_id without
sorting the table in one place: doc_ids are cut into ranges at quantiles that are ids of the
table, and the document that begins a range is sent to the range before as well.

Cases: a null or empty text has no windows and an empty fingerprint; two empty fingerprints
are alike (1), an empty and another are not (0); texts shorter than any window are one window;
null ids come last, documents with the same id follow each other by text; the last document's
next one is the first; a single document is its own next one; extra columns are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.llm.common import id_text, partitions, ship

WINDOW = 64
SHORT = 16
SPACING = 32
LEVELS = 1000
BITS = 2048
PROBES = 5
FILL = 160
COMPARED = 1024         # filters of a chain compared at a time
GRAM = np.uint32(2654435761)
MULTIPLIERS = np.random.default_rng(64).integers(0, 1 << 63, WINDOW, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def run_minima(x: np.ndarray, width: int) -> np.ndarray:
    """Whether a place holds the least value of any ``width`` (a power of two) places in a row."""
    while width > len(x):
        width //= 2
    low, step = x, 1
    while step < width:                             # minima of runs, by doubling
        low, step = np.minimum(low[:-step], low[step:]), 2 * step
    edge = np.zeros(width - 1, x.dtype)             # ranks are not negative
    high, step = np.concatenate([edge, low, edge]), 1
    while step < width:                             # of the runs that hold a place, the greatest
        high, step = np.maximum(high[:-step], high[step:]), 2 * step
    return x == high


def grams(raw: np.ndarray, n: int) -> np.ndarray:
    """A hash of four bytes at each of the first ``n`` places."""
    x = raw.astype(np.uint32)
    gram = (x[:n] | (x[1:n + 1] << np.uint32(8)) | (x[2:n + 2] << np.uint32(16)) | (x[3:n + 3] << np.uint32(24))) * GRAM
    gram ^= gram >> np.uint32(15)
    gram *= np.uint32(2246822519)
    return gram


def hashes(view: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(view).view("<u8")
    h = (words * MULTIPLIERS[:words.shape[1]]).sum(axis=1, dtype=np.uint64)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


#: c * log2(c) in whole numbers, so that sums do not hang on their order.
CLOGC_WHOLE = np.rint(np.concatenate([[0.0], np.arange(1, WINDOW + 1) * np.log2(np.arange(1, WINDOW + 1))]) * (1 << 20)).astype(np.int64)


def levels(raw: np.ndarray, width: int) -> np.ndarray:
    """Entropy level of the window at every byte. From one to the next a byte leaves and one joins."""
    n = len(raw)
    order = np.argsort(raw, kind="stable")
    of = raw[order].astype(np.int64) * n
    key, spot = of + order, np.arange(n)
    ahead, behind = np.empty(n, np.int64), np.empty(n, np.int64)
    # equal bytes among the ``width`` from each byte on, and among the ``width - 1`` before it
    ahead[order] = np.searchsorted(key, np.minimum(key + width, of + n)) - spot
    behind[order] = spot - np.searchsorted(key, np.maximum(key - width + 1, of))
    f = CLOGC_WHOLE
    step = np.diff(f)
    total = np.empty(n - width + 1, np.int64)
    total[0] = f[np.bincount(raw[:width])].sum()
    total[1:] = step[behind[width:]] - step[ahead[:n - width] - 1]
    whole = int(f[width])
    return np.minimum((whole - np.cumsum(total)) * LEVELS // whole, LEVELS - 1)


def kinds(raw: np.ndarray) -> list[tuple[int, int]]:
    """(length, first level) of a text's windows."""
    return [(SHORT, LEVELS)] * (len(raw) < 8 * WINDOW) + [(WINDOW, 0)] * (len(raw) >= 4 * WINDOW)


def all_levels(raw: np.ndarray, known: dict[int, np.ndarray] | None = None, same: int = 0) -> dict[int, np.ndarray]:
    """Window length -> ``levels`` of a text. ``known``: those of a text with the same first
    ``same`` bytes, whose windows inside them are not computed again."""
    out = {}
    for width, _ in kinds(raw) if len(raw) >= SHORT else ():
        old = (known or {}).get(width)
        kept = 0 if old is None else min(max(same - width + 1, 0), len(old), len(raw) - width + 1)
        rest = levels(raw[kept:], width) if len(raw) - kept >= width else np.zeros(0, np.int64)
        out[width] = np.concatenate([old[:kept], rest]) if kept else rest
    return out


def selected(raw: np.ndarray, rank: np.ndarray, known: dict[int, np.ndarray]) -> np.ndarray:
    """Hashes of the windows that are the rarest of ``SPACING`` in a row, in order. ``rank``: of
    each level, the rarest first; ``known``: the text's levels."""
    if not len(raw):
        return np.zeros(0, np.uint64)
    if len(raw) < SHORT:
        return hashes(np.concatenate([raw, np.zeros(SHORT - len(raw), np.uint8)])[None])
    out = []
    for width, first in kinds(raw):
        level = known[width]
        # equally rare ones by gram, so that equal neighbours decide alike anywhere
        order = rank[first + level] << np.uint64(32) | grams(raw, len(level))
        wins = np.flatnonzero(run_minima(order, SPACING))
        out.append(hashes(np.lib.stride_tricks.sliding_window_view(raw, width)[wins]))
    own = np.concatenate(out)
    _, first = np.unique(own, return_index=True)
    return own[np.sort(first)]


def filters(features: np.ndarray) -> np.ndarray:
    """(filters, BITS / 8) bytes."""
    n = -(-len(features) // FILL)
    bits = np.zeros((n, BITS), bool)
    owner = np.arange(len(features)) // FILL
    for k in range(PROBES):
        bits[owner, (features >> np.uint64(11 * k)).astype(np.int64) & (BITS - 1)] = True
    return np.packbits(bits, axis=1)


def ranks(rarity: np.ndarray) -> np.ndarray:
    """The levels' places by their counts, equal counts in one place: whole numbers below
    2 * LEVELS, whatever the table's size."""
    return np.searchsorted(np.unique(rarity), rarity).astype(np.uint64)


def fingerprint(raw: np.ndarray, rank: np.ndarray) -> np.ndarray:
    return filters(selected(raw, rank, all_levels(raw)))


def likeness(x: np.ndarray, y: np.ndarray) -> float:
    """0 to 1: normalised bit overlap of two chains of filters."""
    if not len(x) or not len(y):
        return 1.0 if len(x) == len(y) else 0.0
    if len(x) > len(y):
        x, y = y, x
    a, p = np.unpackbits(x, axis=1).astype(np.float32), np.bitwise_count(x).sum(axis=1, dtype=np.int64)[:, None]
    best = np.zeros(len(x), np.float32)
    for at in range(0, len(x), COMPARED):           # bounded memory for the chains of very long texts
        for to in range(0, len(y), COMPARED):
            part = y[to:to + COMPARED]
            b, q = np.unpackbits(part, axis=1).astype(np.float32), np.bitwise_count(part).sum(axis=1, dtype=np.int64)[None, :]
            rows = slice(at, at + COMPARED)
            common, chance, most = a[rows] @ b.T, p[rows] * q / BITS, np.minimum(p[rows], q)
            score = (common - chance) / np.maximum(most - chance, 1e-9)
            score = np.where(most - chance < 1e-6, (common >= most).astype(np.float32), score)
            best[rows] = np.maximum(best[rows], np.clip(score.max(axis=1), 0, 1))
    return float(best.mean(dtype=np.float64))


def text_of(chain: np.ndarray) -> str:
    return base64.b64encode(chain.tobytes()).decode()


def level_counts(raw: np.ndarray) -> np.ndarray:
    out = np.zeros(2 * LEVELS, np.int64)
    first = dict(kinds(raw))
    for width, level in all_levels(raw).items():
        out[first[width]:first[width] + LEVELS] += np.bincount(level, minlength=LEVELS)
    return out


def rarities(docs: DataFrame) -> np.ndarray:
    """How many of all windows of the table have each entropy level: LEVELS numbers for each length."""
    def count(batches):
        total = np.zeros(2 * LEVELS, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                total += level_counts(np.frombuffer(t.encode(), np.uint8))
        spot = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(total[spot])], names=["level", "n"])

    out = np.zeros(2 * LEVELS, np.int64)
    for r in id_text(docs).select("text").mapInArrow(count, "level long, n long").groupBy("level").agg(
            F.sum("n").alias("n")).collect():
        out[r["level"]] = r["n"]
    return out


def part_of(heads: list[int], of: F.Column) -> F.Column:
    """How many of the descending heads are at least as great, less one, by nested comparisons."""
    def among(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(of <= heads[mid], among(mid + 1, hi)).otherwise(among(lo, mid))
    return F.greatest(among(0, len(heads)) - 1, F.lit(0))


def neighbours(docs: DataFrame, ranges: int) -> DataFrame:
    """(part, guest, doc_id, text), sorted: the documents of a part in descending order of id,
    then as guests those that head the next part (after the last part: the first)."""
    rows = id_text(docs).withColumn("key", F.coalesce("doc_id", F.lit(-(1 << 63))))
    # quantiles are ids of the table: each heads the part that it begins. One number per part.
    cuts = rows.agg(F.percentile_approx("key", [k / ranges for k in range(1, ranges + 1)], 50 * ranges).alias("cuts"))
    heads = sorted(set(cuts.first()["cuts"] or []), reverse=True)
    part = part_of(heads, F.col("key"))
    rows = rows.withColumn("own", part)
    if heads:
        is_head = F.element_at(F.lit(heads), F.col("own") + 1) == F.col("key")
        before = F.pmod(F.col("own") - 1, F.lit(len(heads)))
        places = F.when(is_head, F.array(
            F.struct(F.col("own").alias("part"), F.lit(False).alias("guest")),
            F.struct(before.alias("part"), F.lit(True).alias("guest")))).otherwise(F.array(
                F.struct(F.col("own").alias("part"), F.lit(False).alias("guest"))))
    else:
        places = F.array(F.struct(F.col("own").alias("part"), F.lit(False).alias("guest")))
    return rows.select(F.explode(places).alias("at"), "key", "doc_id", "text").select(
        "at.part", "at.guest", "key", "doc_id", "text").repartitionById(ranges, F.col("part").cast("int")).sortWithinPartitions(
        "part", "guest", F.desc("key"), "text")


def edited(text: str, following: str) -> str:
    """The last third of the characters replaced by as many (or all) from the next text's beginning."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(ranks(rarities(docs)))      # 2 * LEVELS numbers

    def run(batches):
        rank = sent.value
        rows: list[tuple] = []
        last = None         # doc_id, text, levels and fingerprint of the document that waits for its next one

        def pair(doc_id, text, known, own, following, other):
            changed = edited(text, following).encode()
            new = np.frombuffer(changed, np.uint8)
            stays = len(text[:len(text) - len(text) // 3].encode())
            print_ = filters(selected(new, rank, all_levels(new, known, stays)))
            rows.append((doc_id, len(text), hashlib.sha256(changed).hexdigest(), text_of(own), text_of(print_),
                         likeness(own, print_), likeness(own, other)))

        for b in batches:
            for part, guest, doc_id, text in zip(*(b.column(c).to_pylist() for c in ("part", "guest", "doc_id", "text"))):
                if guest and last is None:
                    continue                        # only the first guest follows
                raw = np.frombuffer(text.encode(), np.uint8)
                known = all_levels(raw)
                print_ = filters(selected(raw, rank, known))
                if last is not None:
                    pair(*last, text, print_)
                last = None if guest else (doc_id, text, known, print_)
            yield batch_of(rows)
            rows.clear()
        if last is not None:
            raise ValueError("a part ended without the document that heads the next one")

    return neighbours(docs, partitions(spark)).select("part", "guest", "doc_id", "text").mapInArrow(run, PRINTS)


PRINTS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)],
                                      names=[f.split()[0] for f in PRINTS.split(", ")])
