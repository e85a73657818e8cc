"""Near-duplicate embeddings by randomised-rotation binary codes.

A vector is normalised and rotated by fixed random rotations. Stored per distinct vector:
the signs of ``CODE_BITS`` rotated coordinates (the code) and, per rotation, the inner
product of the vector with its own sign vector (the correction factor). For another vector q,
<sign vector, q> / factor estimates the inner product without bias, with an error of about
sqrt(1 - factor^2) / factor / sqrt(dimension - 1); a pair whose estimate plus ``SIGMAS`` such
errors stays below the threshold is settled by that bound, all others are recomputed in
double precision, so that no pair below the threshold is ever linked.

Candidates: signs of further rotations form ``bands`` keys of as many bits as the number of
vectors has, so that a key holds about one unrelated vector at any scale; the number of bands
follows from the chance ``MISS`` of sharing no key at exactly the threshold. Within a key
vectors meet one centre first (if their codes are near enough), links are confirmed and
vectors merged, and then only members of different components meet.

Links are counted component by component in blocks of ``BLOCK`` vectors: every pair of
blocks is one small group that returns a count for each vector, never its pairs. Identical
vectors are one vector with a weight.

Cases: vectors that are null, empty, zero or hold null or non-finite components, and vectors
of another dimension, link with nothing; repeated rows are identical vectors of equal id; a
null id never names a component unless it has no other; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.llm.common import ship, stored
from mise.llm.components import components, cross_pairs, labelled, star_pairs

THRESHOLD = 0.9
CODE_BITS = 128
MISS = 1e-4
SIGMAS = 5.0
BLOCK = 512
SEED = 7919
MIN_BITS = 8

_rotations: dict = {}


def rotations(dim: int, n: int) -> np.ndarray:
    """The first n fixed random rotations of a dimension, (n, dim, dim)."""
    have = _rotations.get(dim)
    if have is None or len(have) < n:
        rng = np.random.default_rng([SEED, dim])
        have = np.stack([np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)])
        _rotations[dim] = have
    return have[:n]


def rotated(unit: np.ndarray, n: int) -> np.ndarray:
    """(vectors, n, dim) coordinates under the first n rotations."""
    return np.einsum("vd,nde->vne", unit, rotations(unit.shape[1], n), optimize=True)


def banding(n_vectors: int, threshold: float, miss: float) -> tuple[int, int]:
    """(bits per key, keys): bits as log2 of the vectors, keys for the chance of a miss."""
    bits = max(MIN_BITS, math.ceil(math.log2(max(n_vectors, 2))))
    agree = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(miss) / math.log(1 - agree))


def code_rotations(dim: int) -> int:
    return -(-CODE_BITS // dim)


def factors(turned: np.ndarray) -> np.ndarray:
    """Inner product of a unit vector and its normalised sign vector, per rotation."""
    return np.abs(turned).sum(axis=2) / math.sqrt(turned.shape[2])


def distinct_vectors(embeddings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows: vec_id, vector or null), (nodes: node, vector, weight, first_id)."""
    raw = F.col("embedding").cast("array<double>")
    good = (F.size(raw) > 0) & ~F.exists(raw, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) \
        & F.exists(raw, lambda x: x != 0)
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"),
                             F.when(good, raw).alias("vector"))
    # a sum of squares outside the range of doubles has no direction
    rows = rows.withColumn("power", F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).withColumn(
        "vector", F.when((F.col("power") > 0) & (F.col("power") < float("inf")), F.col("vector"))).drop("power")
    rows = stored(rows.withColumn("v1", F.xxhash64(F.lit(1), "vector")).withColumn(
        "v2", F.xxhash64(F.lit(2), "vector")), "vectors")
    nodes = stored(rows.filter("vector IS NOT NULL").groupBy("v1", "v2").agg(
        F.max("vector").alias("vector"), F.count("*").alias("weight"), F.min("vec_id").alias("first_id")).withColumn(
        "node", F.monotonically_increasing_id()), "vector-nodes")
    return rows.drop("vector"), nodes


def matrix(column) -> np.ndarray:
    """An Arrow list column of equally long vectors as unit row vectors."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy().reshape(len(flat), -1)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def coded(nodes: DataFrame, bits: int, bands: int) -> DataFrame:
    """(node, code, code1, code2, factors, keys): signs and correction factors of the first
    rotations, their first 128 bits as two numbers, and the band keys from further rotations."""
    def run(batches):
        for b in batches:
            dims = np.array([len(v) for v in b.column("vector")])
            for dim in np.unique(dims):
                part = b.filter(pa.array(dims == dim))
                unit, own = matrix(part.column("vector")), code_rotations(dim)
                for at in range(0, len(unit), 256):
                    turned = rotated(unit[at:at + 256], own + -(-bits * bands // dim))
                    signs, n = turned > 0, len(turned)
                    code = np.packbits(signs[:, :own].reshape(n, -1), axis=1)
                    two = np.ascontiguousarray(code[:, :CODE_BITS // 8]).view(np.int64)
                    parts = signs[:, own:].reshape(n, -1)[:, :bits * bands].reshape(n, bands, bits)
                    key = np.zeros((n, bands), np.uint64)
                    for k in range(bits):
                        key = (key << np.uint64(1)) | parts[:, :, k]
                    key += np.arange(bands, dtype=np.uint64) << np.uint64(bits)
                    key = key * np.uint64(4096) + np.uint64(dim % 4096)
                    lists = lambda v: pa.ListArray.from_arrays(
                        pa.array(np.arange(n + 1) * v.shape[1], pa.int32()), pa.array(v.reshape(-1)))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("node").slice(at, n), pa.array([c.tobytes() for c in code], pa.binary()),
                         pa.array(two[:, 0]), pa.array(two[:, 1]), lists(factors(turned[:, :own])),
                         lists(key.view(np.int64))],
                        names=["node", "code", "code1", "code2", "factors", "keys"])

    return nodes.select("node", "vector").mapInArrow(
        run, "node long, code binary, code1 long, code2 long, factors array<double>, keys array<long>")


def near_codes(threshold: float):
    """Condition that two codes differ in no more bits than a pair at the threshold does, but for
    ``SIGMAS`` + 1.5 standard errors."""
    p = math.acos(threshold) / math.pi
    most = math.ceil(CODE_BITS * p + (SIGMAS + 1.5) * math.sqrt(CODE_BITS * p * (1 - p)))
    return lambda x, y: (F.bit_count(x("code1").bitwiseXOR(y("code1")))
                         + F.bit_count(x("code2").bitwiseXOR(y("code2")))) <= most


def signs_of(codes: list[bytes], dim: int) -> np.ndarray:
    """(vectors, rotations, dim) of +-1 / sqrt(dim)."""
    bits = np.unpackbits(np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1), axis=1)
    own = code_rotations(dim)
    return (2.0 * bits[:, :own * dim].reshape(len(codes), own, dim) - 1) / math.sqrt(dim)


def error(factor: np.ndarray, dim: int) -> np.ndarray:
    return np.sqrt(np.maximum(1 - factor ** 2, 0)) / factor / math.sqrt(max(dim - 1, 1))


def confirmed(pairs: DataFrame, coded_nodes: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) at or above the threshold: by the code's bound, then in doubles."""
    def run(batches):
        for b in batches:
            dims = np.array([len(v) for v in b.column("vector_a")])
            for dim in np.unique(dims):
                part = b.filter(pa.array((dims == dim) & (np.array([len(v) for v in b.column("vector_b")]) == dim)))
                if not part.num_rows:
                    continue
                x, y = matrix(part.column("vector_a")), matrix(part.column("vector_b"))
                f = np.array(part.column("factors").to_pylist())
                signs = signs_of(part.column("code").to_pylist(), dim)
                estimate = (signs * rotated(y, signs.shape[1])).sum(axis=2) / f
                open_ = (estimate + SIGMAS * error(f, dim) >= threshold).all(axis=1)
                open_[open_] = (x[open_] * y[open_]).sum(axis=1) >= threshold
                yield part.select(["a", "b"]).filter(pa.array(open_))

    left = coded_nodes.select(F.col("node").alias("a"), "code", "factors").join(
        nodes.select(F.col("node").alias("a"), F.col("vector").alias("vector_a")), "a")
    right = nodes.select(F.col("node").alias("b"), F.col("vector").alias("vector_b"))
    return pairs.join(stored(left, "coded-vectors"), "a").join(right, "b").mapInArrow(run, "a long, b long")


def block_counts(members: DataFrame, threshold: float, block: int) -> DataFrame:
    """(node, n): linked weight that each vector meets in a pair of blocks of its component.

    ``members`` has component, node, weight, vector, code, factors, blocks (of its component).
    """
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = members.withColumn("mine", mine).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks").cast("int") - 1))).select(
        "component", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"),
        "mine", "node", "weight", "vector", "code", "factors")

    def count(key, frame):
        import pandas as pd
        i, j = key[1].as_py(), key[2].as_py()
        mine = frame.column("mine").to_numpy()
        dims = np.array([len(v) for v in frame.column("vector").combine_chunks()])
        out = []
        for dim in np.unique(dims):
            part = frame.filter(pa.array(dims == dim))
            side = mine[dims == dim]
            unit, weight, node = matrix(part.column("vector")), part.column("weight").to_numpy(), part.column("node").to_numpy()
            f, signs = np.array(part.column("factors").to_pylist()), signs_of(part.column("code").to_pylist(), dim)
            left, right = np.flatnonzero(side == i), np.flatnonzero(side == j)
            turned = rotated(unit[right], signs.shape[1])
            open_ = np.ones((len(left), len(right)), bool)
            for k in range(signs.shape[1]):
                own = f[left, k:k + 1]
                open_ &= signs[left, k] @ turned[:, k].T / own + SIGMAS * error(own, dim) >= threshold
            p, q = np.nonzero(open_)
            for at in range(0, len(p), 1 << 16):
                r, c = p[at:at + (1 << 16)], q[at:at + (1 << 16)]
                open_[r, c] = (unit[left[r]] * unit[right[c]]).sum(axis=1) >= threshold
            if i == j:
                np.fill_diagonal(open_, False)
            out.append((node[left], open_ @ weight[right]))
            if i != j:
                out.append((node[right], open_.T @ weight[left]))
        frame = pd.DataFrame({"node": np.concatenate([x for x, _ in out]), "n": np.concatenate([x for _, x in out])})
        return pa.Table.from_pandas(frame[frame.n > 0].astype("int64"), preserve_index=False)

    return rows.groupBy("component", "i", "j").applyInArrow(count, "node long, n long").groupBy("node").agg(
        F.sum("n").alias("n"))


def near_duplicates(embeddings: DataFrame, threshold: float = THRESHOLD, miss: float = MISS,
                    block: int = BLOCK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row."""
    ship(embeddings.sparkSession)
    rows, nodes = distinct_vectors(embeddings)
    bits, bands = banding(nodes.count(), threshold, miss)
    codes = stored(coded(nodes, bits, bands), "codes")
    # most keys hold one vector: they are counted from the codes, and only rows of shared ones are stored
    keys = codes.select(F.explode("keys").alias("key"), "node", "code1", "code2")
    shared = stored(keys.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1").select("key"), "shared-keys")
    members = stored(keys.join(shared, "key").withColumn("component", F.col("node")), "vector-members")
    near = near_codes(threshold)
    first = stored(confirmed(star_pairs(members, 0, near), codes, nodes, threshold), "links")
    rest = stored(confirmed(cross_pairs(labelled(members, first), near), codes, nodes, threshold), "links")
    groups = stored(components(first.unionByName(rest)), "groups")
    sizes = stored(groups.groupBy("component").agg(F.count("*").alias("m")).select(
        "component", F.ceil(F.col("m") / block).alias("blocks")), "group-sizes")
    grouped = groups.join(nodes.select("node", "vector", "weight"), "node").join(
        codes.select("node", "code", "factors"), "node").join(sizes, "component")
    counts = block_counts(grouped, threshold, block)
    named = nodes.select("v1", "v2", "node", "weight", "first_id").join(groups, "node", "left").join(
        counts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = stored(named, "named-vectors")
    least = stored(named.groupBy("component").agg(F.min("first_id").alias("least")), "least-ids")
    ends = stored(named.join(least, "component").select(
        "v1", "v2", "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n")), "vector-ends")
    return rows.join(ends, ["v1", "v2"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"),
        F.when(F.col("n").isNotNull(), F.col("least")).otherwise(F.col("vec_id")).alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()))
