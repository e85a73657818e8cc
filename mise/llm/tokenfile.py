"""Token ids of a table as Arrow IPC files of equal-length sequences.

Documents are range-partitioned and sorted by doc_id, so that file after file holds the
documents in ascending order. Each task writes two Arrow IPC files (the random-access file
format, uncompressed buffers):

* ``ids-*.arrow``: record batches of ``ids`` fixed_size_list<uint16|uint32>[length] and
  ``mask`` fixed_size_list<bool>[length] (false: padding after the file's last id). Every
  sequence has the same length, so sequence k of a memory-mapped file is found by
  arithmetic and read without copying.
* ``docs-*.arrow``: doc_id, first id in the file, number of ids.

A row per file is reported and stored; files of failed attempts are in no report. Where a
file's first id stands in the whole table is a running sum over these reports.

Cases: a null or empty text is one id, the end id; null doc_ids come first; documents with
the same doc_id follow each other by text; an empty table gives no files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mise.llm.common import filesystem, id_text, partitions, shared_dir, ship, stored
from mise.llm.tokens import encoder

LENGTH = 2048
END = 2
BATCH_SEQUENCES = 256
FILES = "part int, ids_uri string, docs_uri string, n_ids long, n_docs long"


def sequences(ids: np.ndarray, length: int, pad: int) -> pa.RecordBatch:
    """Ids as fixed-size lists; ``pad`` of the last are padding."""
    if pad:
        ids = np.concatenate([ids, np.zeros(pad, ids.dtype)])
    mask = np.ones(len(ids), bool)
    if pad:
        mask[-pad:] = False
    return pa.RecordBatch.from_arrays(
        [pa.FixedSizeListArray.from_arrays(pa.array(ids), length),
         pa.FixedSizeListArray.from_arrays(pa.array(mask), length)], names=["ids", "mask"])


def write_ids(docs: DataFrame, folder: str, path: str, end: int = END, length: int = LENGTH) -> DataFrame:
    """Encode and write all documents; returns the committed files in order of ``part``."""
    spark = docs.sparkSession
    ship(spark)

    def write(batches):
        from pyspark import TaskContext
        enc, part = encoder(path, "spaced"), TaskContext.get().partitionId()
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        names = [f"{k}-{part:06d}-{uuid.uuid4().hex}.arrow" for k in ("ids", "docs")]
        writer = index = None
        whole, left, n_ids, n_docs = BATCH_SEQUENCES * length, [], 0, 0
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            coded = enc.encode(batch.column(1).to_pylist(), end)
            counts = np.array([len(x) for x in coded], np.int64)
            firsts = n_ids + np.concatenate([[0], np.cumsum(counts)[:-1]])
            row = pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(firsts), pa.array(counts)], names=["doc_id", "first", "n_ids"])
            if index is None:
                sink = [fs.open_output_stream(f"{root}/{x}", compression=None) for x in names]
                empty = sequences(np.zeros(0, enc.width), length, 0)
                writer, index = pa.ipc.new_file(sink[0], empty.schema), pa.ipc.new_file(sink[1], row.schema)
            index.write_batch(row)
            n_ids, n_docs = n_ids + int(counts.sum()), n_docs + len(coded)
            left += coded
            held += int(counts.sum())
            if held >= whole:
                flat = np.concatenate(left)
                cut = len(flat) - len(flat) % whole
                for at in range(0, cut, whole):
                    writer.write_batch(sequences(flat[at:at + whole], length, 0))
                left, held = [flat[cut:]], len(flat) - cut
        if index is None:
            return
        if held:
            flat = np.concatenate(left)
            writer.write_batch(sequences(flat, length, -len(flat) % length))
        for x in (writer, index, *sink):
            x.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array([v], t) for v, t in ((part, pa.int32()), (f"{folder}/{names[0]}", pa.string()),
                                           (f"{folder}/{names[1]}", pa.string()), (n_ids, pa.int64()),
                                           (n_docs, pa.int64()))],
            names=["part", "ids_uri", "docs_uri", "n_ids", "n_docs"])

    ordered = id_text(docs).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ordered.mapInArrow(write, FILES), "id-files")


def open_sequences(uri: str):
    """Arrow file reader over an ids file, memory-mapped where the file system allows it."""
    fs, path = filesystem(uri)
    source = pa.memory_map(path) if uri.startswith("file:") else fs.open_input_file(path)
    return pa.ipc.open_file(source)


class Ids:
    """Random access to the ids of one file: a slice touches only the batches it lies in."""

    def __init__(self, uri: str):
        self.file = open_sequences(uri)
        self.length = self.file.schema.field("ids").type.list_size
        self.per = None
        self.at, self.flat = -1, None

    def batch(self, k: int) -> np.ndarray:
        if k != self.at:
            self.at, self.flat = k, self.file.get_batch(k).column("ids").flatten().to_numpy()
        return self.flat

    def slice(self, first: int, n: int) -> np.ndarray:
        if self.per is None:
            self.per = len(self.batch(0))           # all batches but the last are this long
        out = []
        while n:
            k, at = divmod(first, self.per)
            own = self.batch(k)[at:at + n]
            out.append(own)
            first, n = first + len(own), n - len(own)
        return out[0] if len(out) == 1 else np.concatenate(out)


def read_ids(files: DataFrame) -> DataFrame:
    """Per document, from the files: doc_id, start, n_tokens, ids_crc32."""
    spark = files.sparkSession
    ship(spark)
    # one row per written file: as many rows as tasks wrote
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(w), F.lit(0)))

    def read(batches):
        for job in (r for b in batches for r in b.to_pylist()):
            ids = Ids(job["ids_uri"])
            fs, path = filesystem(job["docs_uri"])
            with fs.open_input_file(path) as source:
                index = pa.ipc.open_file(source)
                for k in range(index.num_record_batches):
                    b = index.get_batch(k)
                    crc = [zlib.crc32(ids.slice(f, n).astype("<u4").tobytes())
                           for f, n in zip(b.column("first").to_pylist(), b.column("n_ids").to_pylist())]
                    first = b.column("first").to_numpy() + job["base"]
                    yield pa.RecordBatch.from_arrays(
                        [b.column("doc_id"), pa.array(first), b.column("n_ids"), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.repartition(partitions(spark)).mapInArrow(
        read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write the ids of all documents and read the files back."""
    folder = shared_dir(docs.sparkSession, "ids")
    return read_ids(write_ids(docs, folder, path))
