r"""Near-duplicate documents by HyperMinHash sketches.

A text's words are its runs of other bytes than ``[\x20\x09-\x0D]`` with A-Z lower-cased, its
set the distinct shingles of ``width`` words (with fewer words the whole sequence), each as a
64-bit hash. Texts with equal sets form one class, so exact copies cost one counting step
however many they are.

* Sketch of a class: every shingle hash picks one of ``BUCKETS`` buckets; the least rest in a
  bucket is stored as its leading-zero count and the ``MANTISSA`` bits behind it, 16 bits in
  all. Empty buckets take the register of another one in a fixed random order for banding only.
* Banding: ``ROWS`` registers make a band key; classes that share a key in any of the
  ``BUCKETS / ROWS`` bands are candidates. At a similarity of 0.8 a band fails with
  probability 0.59, all 32 with less than 1e-7.
* Candidates are first compared with one centre of their band key, links verified and classes
  merged, so that a group of m near copies costs about m comparisons.
* Keys that still hold several components are compared across components: those of at most
  ``SMALL`` members sketch by sketch where a key's members lie, so that only pairs that the
  estimate leaves possible become rows; larger ones are joined into clusters by the keys they share,
  and clusters are compared in blocks of ``BLOCK`` texts: a pair of blocks is one small group
  that returns only the links that join components, so that thousands of texts that are alike
  but not near copies never become rows of pairs. Every two members of a key thus either are
  compared or already in one component: no link between components is missed.
* Estimate: equal registers, less those expected to be equal by chance, over the buckets used
  by either; pairs that are ``SIGMAS`` standard errors below the threshold are dropped.
* Verification: intersection and union of the full sets, in integers.

Cases: a null or empty text and one without words has no shingles and is linked with
nothing; repeated rows are copies; rows with a null id belong to the component of their set,
whose id is the least that is not null; extra columns are ignored, or kept by ``keep_one``;
an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.llm.common import apart, id_text, partitions, ship, stored
from mise.llm.components import components, labelled, star_pairs

BUCKETS = 128
SMALL = 32
BLOCK = 512
ROWS = 4
MANTISSA = 10
SIGMAS = 5.0
SEED = 20240229
MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_random = np.random.default_rng(SEED)
LETTERS = _random.integers(0, 1 << 64, 256, dtype=np.uint64)
STEP, JOIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Where an empty bucket looks for a register, try after try.
TRIES = np.stack([_random.permutation(BUCKETS) for _ in range(64)])


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words(data: bytes) -> np.ndarray:
    """Hashes of the words of a lower-cased text in order: a polynomial over random letter values."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~SPACE[raw]
    edge = np.flatnonzero(np.diff(inside, prepend=False, append=False))
    size = edge[1::2] - edge[0::2]
    if not len(size):
        return np.zeros(0, np.uint64)
    first = np.cumsum(size) - size
    place = np.arange(int(size.sum())) - np.repeat(first, size)
    total = np.add.reduceat(LETTERS[raw[inside]] * powers(int(size.max()))[place], first)
    return mix(total + size.astype(np.uint64) * JOIN)


_powers = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(2 * n, STEP, np.uint64)]), dtype=np.uint64)
    return _powers


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text."""
    w = words((text or "").encode().lower())
    if not len(w):
        return w
    n = min(width, len(w))
    h = np.zeros(len(w) - n + 1, np.uint64)
    for k in range(n):
        h = mix(h * JOIN + w[k:len(w) - n + 1 + k] + STEP)
    return np.unique(mix(h + np.uint64(n)))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """HyperMinHash registers of each set, 0 for an empty bucket."""
    out = np.zeros((len(sets), BUCKETS), np.uint16)
    bits = BUCKETS.bit_length() - 1
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if not len(owner):
        return out
    x = np.concatenate(sets)
    place = owner * BUCKETS + (x >> np.uint64(64 - bits)).astype(np.int64)
    rest = (x << np.uint64(bits)) | np.uint64((1 << bits) - 1)      # the low bits never all zero
    # within a set hashes ascend, so the first of each place is the least
    spot, first = np.unique(place, return_index=True)
    least = rest[first]
    zeros = 63 - np.floor(np.log2(least.astype(np.float64))).astype(np.int64)
    zeros = np.clip(zeros, 0, 56)
    zeros += (least << zeros.astype(np.uint64)) >> np.uint64(63) == 0    # rounding of the logarithm
    tail = (least << (zeros + 1).astype(np.uint64)) >> np.uint64(64 - MANTISSA)
    out.reshape(-1)[spot] = ((zeros + 1) << MANTISSA).astype(np.uint16) | tail.astype(np.uint16)
    return out


def densified(sketch: np.ndarray) -> np.ndarray:
    """Empty buckets filled from others, for banding."""
    full, used = sketch.copy(), sketch > 0
    for order in TRIES:
        todo = (full == 0) & used[:, order]
        if not (full == 0).any():
            return full
        full = np.where(todo, sketch[:, order], full)
    for shift in range(1, BUCKETS):                 # very small sets: the next bucket in use
        if not (full == 0).any():
            break
        full = np.where(full == 0, np.roll(sketch, shift, axis=1), full)
    return full


def band_keys(sketch: np.ndarray) -> np.ndarray:
    """(sets, bands) of 64-bit band keys."""
    full = densified(sketch).astype(np.uint64).reshape(len(sketch), -1, ROWS)
    h = np.broadcast_to(np.arange(full.shape[1], dtype=np.uint64) + np.uint64(1), full.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h * JOIN + full[:, :, k] + STEP)
    return h.astype(np.int64)


def chance(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Share of buckets whose registers agree though the least hashes differ.

    With a and b hashes in a bucket the minima are about exponential with these rates, so both
    fall into the cell [x, x + d) with probability a b d^2 exp(-(a + b) x); summed over the
    cells, whose width is x / 2^MANTISSA, that is at most a b / (a + b)^2 / 2^MANTISSA.
    """
    a, b = np.maximum(n, 1.0), np.maximum(m, 1.0)
    return a * b / (a + b) ** 2 / (1 << MANTISSA)


def estimate(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(collision-corrected similarity, standard error) of pairs of sketches."""
    used = ((x > 0) | (y > 0)).sum(axis=1)
    same = ((x == y) & (x > 0)).sum(axis=1)
    j = np.clip((same - chance(n, m) * used) / np.maximum(used, 1), 0, 1)
    return j, np.sqrt(np.maximum(j * (1 - j), 0.16) / np.maximum(used, 1))


def sketched(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, d1, d2 (hash of the row's id and text), n_shingles, c1, c2 (hash of the
    set), registers."""
    ship(docs.sparkSession)

    def sketch(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                sets = [shingles(t, width) for t in part.column("text").to_pylist()]
                same = np.array([np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), np.int64)
                                 for s in sets])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("d1"), part.column("d2"),
                     pa.array([len(s) for s in sets], pa.int64()), pa.array(same[:, 0]), pa.array(same[:, 1]),
                     pa.array([r.tobytes() for r in registers(sets)], pa.binary())],
                    names=["doc_id", "d1", "d2", "n_shingles", "c1", "c2", "registers"])

    return identified(docs).mapInArrow(
        sketch, "doc_id long, d1 long, d2 long, n_shingles long, c1 long, c2 long, registers binary")


def identified(docs: DataFrame) -> DataFrame:
    """doc_id, text and a 128-bit hash of both."""
    row = [F.col("doc_id").isNull(), "doc_id", "text"]
    return id_text(docs).select("doc_id", "text", *(F.xxhash64(F.lit(k), *row).alias(f"d{k}") for k in (1, 2)))


def banded(sets: DataFrame) -> DataFrame:
    """(key, node) for every class and band."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            regs = np.frombuffer(b"".join(b.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
            keys = band_keys(regs)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1)), pa.array(np.repeat(b.column("node").to_numpy(), keys.shape[1]))],
                names=["key", "node"])

    return sets.select("node", "registers").mapInArrow(run, "key long, node long")


def likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that their sizes and the estimate from their sketches leave possible."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint16).reshape(-1, BUCKETS)
                    for c in ("registers_a", "registers_b"))
            j, error = estimate(x, y, b.column("n_a").to_numpy(), b.column("n_b").to_numpy())
            yield b.select(["a", "b"]).filter(pa.array(j + SIGMAS * error >= percent / 100))

    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"),
                                 F.col("registers").alias(f"registers_{c}"))
    sized = pairs.join(apart(side("a")), "a").join(apart(side("b")), "b").filter(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    return sized.mapInArrow(run, "a long, b long")


def likely_of_keys(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different components among the members of each key (at most ``SMALL``)
    that their sizes and the estimate leave possible. The sketches come to the members first,
    so that a pair that is no candidate never becomes a row."""
    rows = members.join(apart(sets.select("node", "n", "registers")), "node").select("key", "node", "component", "n", "registers")

    def compared(t: pa.Table) -> pa.RecordBatch:
        key, node, own, n = (t.column(c).to_numpy() for c in ("key", "node", "component", "n"))
        sketch = np.frombuffer(b"".join(t.column("registers").to_pylist()), np.uint16).reshape(-1, BUCKETS)
        found = []
        for step in range(1, SMALL):        # each member with the one ``step`` places on in its key
            x = np.flatnonzero((key[:-step] == key[step:]) & (own[:-step] != own[step:]))
            if not (key[:-step] == key[step:]).any():
                break
            y = x + step
            fit = np.minimum(n[x], n[y]) * 100 >= np.maximum(n[x], n[y]) * percent
            x, y = x[fit], y[fit]
            j, error = estimate(sketch[x], sketch[y], n[x], n[y])
            fit = j + SIGMAS * error >= percent / 100
            found.append((np.minimum(node[x], node[y])[fit], np.maximum(node[x], node[y])[fit]))
        a, b = (np.concatenate([f[k] for f in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    def run(batches):
        rest = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if rest is None else pa.concat_tables([rest, t])
            if not len(t):
                continue
            key = t.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1]))        # the last key may go on
            if cut:
                yield compared(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None and len(rest):
            yield compared(rest)

    dealt = rows.repartition(partitions(rows.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def texts_of(docs: DataFrame, sets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of one document of each class."""
    reps = nodes.join(apart(sets.select("node", "rep.d1", "rep.d2")), "node")
    return identified(docs).select("d1", "d2", "text").join(apart(reps), ["d1", "d2"]).select(
        "node", "text").dropDuplicates(["node"])


def verified(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity."""
    def run(batches):
        for b in batches:
            good, last, own = [], None, None
            for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist()):
                if x != last:
                    last, own = x, shingles(x, width)
                other = shingles(y, width)
                both = len(np.intersect1d(own, other, assume_unique=True))
                good.append(100 * both >= percent * (len(own) + len(other) - both))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    side = lambda c: texts.select(F.col("node").alias(c), F.col("text").alias(f"text_{c}"))
    return pairs.join(apart(side("a")), "a").join(apart(side("b")), "b").select("a", "b", "text_a", "text_b").mapInArrow(
        run, "a long, b long")


def block_links(members: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) that join components among the members of large keys, by blocks of clusters."""
    centres = stored(members.groupBy("key").agg(F.min("node").alias("centre")), "cluster-centres")
    edges = members.join(apart(centres), "key").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    nodes = stored(components(edges).withColumnRenamed("component", "cluster").join(
        apart(members.select("node", "component").distinct()), "node"), "clusters")
    sizes = stored(nodes.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "cluster-sizes")
    rows = stored(nodes.join(apart(sizes), "cluster").select(
        "node", "component", "cluster", "blocks", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("mine")),
        "block-members")
    # a row for each block it meets only after the text has come, once, to its node
    rows = texts.join(apart(rows), "node").select(
        "cluster", "component", "node", "text", "mine", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select("cluster", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine",
                       "node", "component", "text")

    def link(key, frame):
        i, j = key[1].as_py(), key[2].as_py()
        mine, node = frame.column("mine").to_numpy(), frame.column("node").to_numpy()
        own = frame.column("component").to_numpy().copy()
        sets = [shingles(t, width) for t in frame.column("text").to_pylist()]
        sketch, n = registers(sets), np.array([len(x) for x in sets])
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        found = []
        for x in left:
            others = right if i != j else right[right > x]
            others = others[(own[others] != own[x]) & (np.minimum(n[others], n[x]) * 100
                                                       >= np.maximum(n[others], n[x]) * percent)]
            if not len(others):
                continue
            similar, error = estimate(sketch[others], sketch[x], n[others], n[x])
            for y in others[similar + SIGMAS * error >= percent / 100]:
                if own[y] == own[x]:
                    continue                        # joined meanwhile
                both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * both >= percent * (n[x] + n[y] - both):
                    found.append((int(min(node[x], node[y])), int(max(node[x], node[y]))))
                    own[own == own[y]] = own[x]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.groupBy("cluster", "i", "j").applyInArrow(link, "a long, b long")


def near_classes(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(rows: doc_id, d1, d2, n_shingles, c1, c2; classes: c1, c2, node, component, first_id, rep)."""
    rows = stored(sketched(docs, width), "sketches")
    sets = stored(rows.filter("n_shingles > 0").groupBy("c1", "c2").agg(
        F.min("doc_id").alias("first_id"), F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "d1", "d2")).alias("rep"),
        F.max("n_shingles").alias("n"), F.max("registers").alias("registers")).withColumn(
        "node", F.monotonically_increasing_id()), "classes")
    bands = stored(banded(sets), "bands")
    common = stored(bands.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "common-keys")
    members = stored(bands.join(apart(common), "key").select("key", "node", F.col("node").alias("component")), "members")
    texts = stored(texts_of(docs, sets, members.select("node").distinct()), "member-texts")
    check = lambda pairs: stored(verified(stored(pairs, "likely"), texts, width, percent), "links")
    links = check(likely(star_pairs(members), sets, percent))
    mixed = labelled(members, links)
    large = stored(mixed.groupBy("key").agg(F.count("*").alias("m")).filter(F.col("m") > SMALL).select("key"), "large-keys")
    small = stored(mixed.join(apart(large), "key", "left_anti"), "small-members")
    links = links.unionByName(check(likely_of_keys(small, sets, percent)))
    links = links.unionByName(stored(block_links(
        stored(mixed.join(apart(large), "key", "left_semi"), "large-members"), texts, width, percent), "links"))
    own = sets.join(apart(components(links)), "node", "left").withColumn("component", F.coalesce("component", "node"))
    return rows.drop("registers"), own.select("c1", "c2", "node", "component", "first_id", "rep")


def near_duplicates(docs: DataFrame, width: int = 2, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row."""
    rows, own = near_classes(docs, width, percent)
    own = stored(own, "class-components")
    least = stored(own.groupBy("component").agg(F.min("first_id").alias("least")), "component-ids")
    named = stored(own.join(apart(least), "component").select("c1", "c2", F.col("least").alias("least")), "class-ids")
    return rows.join(apart(named), ["c1", "c2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def keep_one(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs, all columns untouched, with one row of each group of near duplicates:
    the least id (a null one only where there is no other). Rows without words all stay."""
    from mise.llm.lines import STRIPPED
    _, own = near_classes(docs, width, percent)
    keep = stored(own.groupBy("component").agg(F.min("rep").alias("rep")).select("rep.d1", "rep.d2"), "kept-rows")
    text = F.coalesce(F.col("row.text").cast("string"), F.lit(""))
    doc = F.col("row.doc_id").cast("long")
    key = [F.xxhash64(F.lit(k), doc.isNull(), doc, text).alias(f"d{k}") for k in (1, 2)]
    whole = docs.select(F.struct("*").alias("row"))
    blank = F.btrim(text, F.lit(STRIPPED)) == ""
    one = whole.filter(~blank).select("row", *key).join(apart(keep), ["d1", "d2"]).dropDuplicates(["d1", "d2"]).select("row")
    return one.unionByName(whole.filter(blank)).select("row.*")
