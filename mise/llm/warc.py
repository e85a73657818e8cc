"""WARC archives: gzip-per-record writer and splittable reader.

Writer: every row becomes one WARC/1.1 record in a gzip member of its own. Rows with equal
payloads (by SHA-1 and length) are stored once: the row with the largest id is written as
``response``, the others as ``revisit`` records that name it. Each task writes files of its
own under the shared folder and reports them; only the files of the committed report count,
so that a repeated task leaves at most an unread file behind.

Reader: archives are cut into byte ranges without looking at them. A task scans its range
for the gzip magic and accepts a candidate member only when it inflates in full (checksum
included) and starts with a WARC version line; from each it follows the members that come next,
to the first that begins past the end of the range. Such chains (first byte, next byte) are a
few numbers a range; joined end to first from byte 0 on they are the archive's records, and chains in
archives inside payloads, wherever a range begins, are not met. Then every chain is read by the task that owns its
first record. A chain that ends before its range does, or a place where none begins, is a broken
member: reading fails and names its byte, which is the same for every size of the ranges; no
sound record is passed over. Memory: one range plus two records.

Cases: a null html is an empty payload; empty payloads are equal payloads; a null id never
becomes the largest while another is there, and where all ids of equal payloads are null all
of them are responses, as are repeated rows that share the largest id; a null url gets an
``urn:page:`` target; an empty table gives no archive and no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mise.llm.common import filesystem, partitions, shared_dir, ship, stored

MAGIC = b"\x1f\x8b\x08"
SPLIT_BYTES = 32 << 20
FILE_BYTES = 1 << 30
FEED = 1 << 14
READ_AHEAD = 1 << 18
RECORDS = ("target_uri string, record_id string, record_type string, page_id long, refers_to long, "
           "payload_bytes long, payload_digest string, payload binary")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def record(page_id, url, payload: bytes, refers_to, date: str) -> bytes:
    """The bytes of one WARC record, ``refers_to`` being None for a response."""
    uri = (url or f"urn:page:{page_id}").replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"),
              ("WARC-Record-ID", record_urn(page_id)), ("WARC-Date", date),
              ("WARC-Target-URI", uri), ("WARC-Payload-Digest", "sha1:" + digest(payload))]
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                   ("WARC-Refers-To", record_urn(refers_to)), ("X-Refers-To-Page", str(refers_to))]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = head.encode() + (payload if refers_to is None else b"")
    fields += [("X-Payload-Length", str(len(payload))),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    top = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return top.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """(header fields, payload) of a record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    block = rest[:int(fields["content-length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


class Range:
    """The records of an open file that start in [begin, end)."""

    def __init__(self, source, size: int, begin: int, end: int):
        self.source, self.size, self.begin, self.end = source, size, begin, end
        source.seek(begin)
        self.data = bytearray(source.read(end - begin))

    def slice(self, at: int, n: int) -> bytes:
        """Bytes at a place of the range, read on from the file where need be."""
        while at + n > len(self.data) and self.begin + len(self.data) < self.size:
            more = self.source.read(READ_AHEAD)
            if not more:
                break
            self.data += more
        return bytes(self.data[at:at + n])

    def inflate(self, at: int, most: int | None = None, keep: bool = True) -> tuple[bytes, int] | None:
        """(content, place after the member), or None if there is no whole member here. ``keep``:
        the content is wanted."""
        out, size, inflater = [], 0, zlib.decompressobj(31)
        while not inflater.eof:
            chunk = self.slice(at, FEED)
            if not chunk:
                return None
            try:
                data = inflater.decompress(chunk)
            except zlib.error:
                return None
            size += len(data)
            if keep:
                out.append(data)
            at += len(chunk) - len(inflater.unused_data)
            if most is not None and size >= most:
                break
        return b"".join(out), at

    def is_record(self, at: int) -> bool:
        if self.slice(at, 3) != MAGIC:
            return False
        got = self.inflate(at, 16)
        return got is not None and got[0].startswith(b"WARC/1.")

    def follow(self, at: int) -> tuple[int, bool, set]:
        """(place after the last whole record from here, whether that is past the range, their places)."""
        places = set()
        while True:
            got = self.inflate(at, keep=False) if self.is_record(at) else None
            if got is None:
                return at, False, places
            places.add(at)
            at = got[1]
            if self.begin + at >= min(self.end, self.size):
                return at, True, places

    def chains(self):
        """(first byte, next byte, whether it passes the end) of the chains that begin in the range."""
        at, passed = 0, set()
        while True:
            self.slice(self.end - self.begin, 2)     # a magic may begin on the last byte
            at = self.data.find(MAGIC, at)
            if at < 0 or self.begin + at >= self.end:
                return
            if at not in passed and self.is_record(at):
                stop, whole, places = self.follow(at)
                passed |= places
                yield self.begin + at, self.begin + stop, whole
                if whole:
                    return      # what begins later in the range lies in one of these records
            at += 1

    def records(self, stop: int):
        """The records of the chain from the range's first byte to ``stop``."""
        at = 0
        while self.begin + at < stop:
            got = self.inflate(at)
            if got is None:
                raise ValueError(f"broken gzip member at byte {self.begin + at}")
            yield got[0]
            at = got[1]


def joined(size: int, found: list[tuple[int, int, bool]], uri: str) -> list[tuple[int, int]]:
    """The chains (first, next) that cover an archive, from all that its ranges found."""
    by_first = {first: (stop, whole) for first, stop, whole in found}
    at, out = 0, []
    while at < size:
        stop, whole = by_first.get(at, (at, False))
        if not whole:
            raise ValueError(f"broken gzip member at byte {stop} of {uri}")
        out.append((at, stop))
        at = stop
    return out


def with_first_copy(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, refers_to): the id of the largest equal page, null for itself.

    Copies are counted per digest before the join; the join has one more key than that
    grouping, so both sides are exchanged for it and a hot digest is split by AQE.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"),
                        F.col("url").cast("string").alias("url"),
                        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    largest = rows.groupBy("sha").agg(F.max("page_id").alias("largest"), F.max("size").alias("size"))
    return rows.join(largest, ["sha", "size"]).select(
        "page_id", "url", "payload",
        F.when(F.col("page_id").eqNullSafe(F.col("largest")), None).otherwise(F.col("largest")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, date: str = "1970-01-01T00:00:00Z",
               file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every row of (page_id, url, html) and return the committed files: uri, size, records."""
    ship(pages.sparkSession)

    def write(batches):
        fs, root = filesystem(folder)
        fs.create_dir(root, recursive=True)
        made, out = [], None
        for batch in batches:
            for row in batch.to_pylist():
                if out is None or made[-1][1] >= file_bytes:
                    if out is not None:
                        out.close()
                    name = f"records-{uuid.uuid4().hex}.warc.gz"
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    made.append([f"{folder}/{name}", 0, 0])
                packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = packer.compress(record(row["page_id"], row["url"], row["payload"], row["refers_to"], date))
                data += packer.flush()
                out.write(data)
                made[-1][1] += len(data)
                made[-1][2] += 1
        if out is not None:
            out.close()
        uris, sizes, counts = zip(*made) if made else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(uris, pa.string()), pa.array(sizes, pa.int64()),
                                          pa.array(counts, pa.int64())], names=["uri", "size", "records"])

    return stored(with_first_copy(pages).mapInArrow(write, "uri string, size long, records long"), "warc-files")


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """The records of the archives named in ``files`` (uri, size), one byte range per row. The
    ranges are scanned when this is called, and read when the result is."""
    spark = files.sparkSession
    ship(spark)
    ranges = files.filter(F.col("size") > 0).select(
        "uri", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1,
                                            F.lit(split_bytes).cast("long"))).alias("begin"))

    def scan(batches):
        for batch in batches:
            rows = []
            for job in batch.to_pylist():
                fs, path = filesystem(job["uri"])
                with fs.open_input_file(path) as source:
                    end = min(job["size"], job["begin"] + split_bytes)
                    rows += [(job["uri"], job["size"], *c) for c in Range(source, job["size"], job["begin"], end).chains()]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()))],
                names=["uri", "size", "first", "next", "whole"])

    def cover(key, table):
        """One archive's chains: a row for each of its ranges."""
        uri, size = key[0].as_py(), key[1].as_py()
        found = zip(*(table.column(c).to_pylist() for c in ("first", "next", "whole")))
        out = joined(size, [f for f in found if f[0] is not None], uri)
        return pa.table({"uri": [uri] * len(out), "size": [size] * len(out), "first": [f for f, _ in out], "next": [n for _, n in out]},
                        pa.schema([("uri", pa.string()), ("size", pa.int64()), ("first", pa.int64()), ("next", pa.int64())]))

    def read(batches):
        for batch in batches:
            for job in batch.to_pylist():
                fs, path = filesystem(job["uri"])
                with fs.open_input_file(path) as source:
                    rows, held = [], 0
                    for data in Range(source, job["size"], job["first"], job["next"]).records(job["next"]):
                        f, payload = parse(data)
                        sha = f["warc-payload-digest"].removeprefix("sha1:")
                        if f["warc-type"] == "response" and digest(payload) != sha:
                            raise ValueError(f"payload of {f['warc-record-id']} does not match its digest")
                        page, first = f.get("x-page-id"), f.get("x-refers-to-page")
                        rows.append((f["warc-target-uri"], f["warc-record-id"], f["warc-type"],
                                     page and int(page), first and int(first),
                                     int(f["x-payload-length"]), sha, payload if payloads else None))
                        held += len(payload)
                        if held >= 16 << 20 or len(rows) >= 4096:
                            yield to_batch(rows)
                            rows, held = [], 0
                    yield to_batch(rows)

    chains = ranges.repartition(partitions(spark)).mapInArrow(scan, "uri string, size long, first long, next long, whole boolean")
    # an archive without any chain is broken, too: its file is a row of its own
    every = chains.unionByName(files.filter(F.col("size") > 0).select(
        "uri", "size", F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("next"), F.lit(None).cast("boolean").alias("whole")))
    parts = stored(every.groupBy("uri", "size").applyInArrow(cover, "uri string, size long, first long, next long"), "warc-ranges")
    return parts.repartition(partitions(spark)).mapInArrow(read, RECORDS)


def to_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    names = ("target_uri", "record_id", "record_type", "page_id", "refers_to", "payload_bytes",
             "payload_digest", "payload")
    cols = list(zip(*rows)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=list(names))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages and read the archives back: one row per page."""
    folder = shared_dir(pages.sparkSession, "warc")
    return read_warc(write_warc(pages, folder), payloads=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
