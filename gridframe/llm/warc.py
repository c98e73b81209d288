"""WARC archives with an index first, and coalesced range reads.

Writing: each task writes one archive of gzip members, one per record, under a
name of its own, and passes on an index row per record: page, file, offset,
length, url, digest.  Only index rows of finished tasks reach the index table,
so archives of lost or repeated tasks are never read.  Equal payloads of at
least ``REVISIT_BYTES`` bytes are stored once, with the largest id; the others
are revisit records that refer to it.

Reading: selected index rows are sorted by file and offset, neighbouring ranges
are joined up to ``GAP`` bytes apart and ``READ`` bytes long, and each joined
range is read once.

Archives go to a folder that all executors share, through the file system that
its address names.  Null payloads count as empty; rows without an id are
written too and never referred to."""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridframe.llm.common import arrow_rows, materialise
from gridframe.session import scratch_dir

REVISIT_BYTES = 1000
GAP, READ = 64 << 10, 4 << 20
SEGMENT = 32 << 20
BATCH = 200
_INDEX = "page_id long, file string, offset long, length long, url string, digest string, record_type string, refers_to long"


def _open(address: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(address if "://" in address or address.startswith("file:") else f"file://{address}")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit holds no payload."""
    kind, body = ("response", payload) if refers_to is None else ("revisit", b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", "2020-01-01T00:00:00Z"),
              ("WARC-Target-URI", "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url or "")),
              ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Page-ID", "" if page_id is None else str(page_id)),
              ("X-Payload-Length", str(len(payload)))]
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>"), ("X-Refers-To-Page", str(refers_to)),
                   ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields.append(("Content-Length", str(len(body))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Fields and body of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
    body = rest[: int(fields["Content-Length"])]
    if not version.startswith("WARC/") or rest[len(body):] != b"\r\n\r\n":
        raise ValueError(f"not a WARC record: {raw[:60]!r}")
    return fields, body


def write(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write the archives to ``folder``; returns the index as a written table."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.encode("payload", "UTF-8")))
    long = F.octet_length("payload") >= REVISIT_BYTES
    repeated = (rows.where(long).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
                .where("n > 1").select("digest", "first"))
    refers = F.when(long & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first"))), F.col("first"))
    rows = rows.join(repeated, "digest", "left").select("page_id", "url", "payload", "digest", refers.alias("refers_to"))
    _open(folder)[0].create_dir(_open(folder)[1], recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        # a name of its own for each attempt of a task
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        offset, out = 0, None
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                if out is None:
                    out = system.open_output_stream(f"{path}/{name}", compression=None)
                member = gzip.compress(record(r["page_id"], r["url"], r["payload"].encode(), r["digest"], r["refers_to"]), 3, mtime=0)
                out.write(member)
                found.append((r["page_id"], name, offset, len(member), r["url"], r["digest"],
                              "response" if r["refers_to"] is None else "revisit", r["refers_to"]))
                offset += len(member)
            names = ["page_id", "file", "offset", "length", "url", "digest", "record_type", "refers_to"]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
            columns = list(zip(*found)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)
        if out is not None:
            out.close()

    with arrow_rows(spark, BATCH):
        return materialise(rows.mapInArrow(run, _INDEX), "index")


def read(index: DataFrame, folder: str) -> DataFrame:
    """The records of the given index rows: page_id, record_type, payload (null
    for a revisit), payload_bytes, payload_digest, refers_to."""
    spark = index.sparkSession
    # ranges are joined inside segments of an archive, so no archive is one task's work
    order = Window.partitionBy("file", "segment").orderBy("offset")
    rows = index.select("file", "offset", "length").withColumn("segment", F.floor(F.col("offset") / SEGMENT))
    end = F.lag(F.col("offset") + F.col("length")).over(order)
    new = end.isNull() | (F.col("offset") - end > GAP) | (F.floor(F.col("offset") / READ) != F.floor(F.lag("offset").over(order) / READ))
    ranges = (rows.withColumn("range", F.sum(new.cast("int")).over(order))
              .groupBy("file", "segment", "range")
              .agg(F.min("offset").alias("offset"), F.max(F.col("offset") + F.col("length")).alias("end"),
                   F.collect_list(F.struct("offset", "length")).alias("members")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _open(folder)
        names = ["page_id", "record_type", "payload", "payload_bytes", "payload_digest", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_file(f"{path}/{r['file']}") as source:
                    raw = source.read_at(r["end"] - r["offset"], r["offset"])
                found = []
                for m in sorted(r["members"], key=lambda m: m["offset"]):
                    at = m["offset"] - r["offset"]
                    fields, body = parse(zlib.decompress(raw[at: at + m["length"]], 31))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = fields["WARC-Type"] == "response"
                    if response and hashlib.sha1(body).hexdigest() != digest:
                        raise ValueError(f"payload of page {fields['X-Page-ID']} does not match its digest")
                    page, refers = (int(fields[k]) if fields.get(k) else None for k in ("X-Page-ID", "X-Refers-To-Page"))
                    found.append((page, fields["WARC-Type"], body.decode() if response else None, int(fields["X-Payload-Length"]), digest, refers))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names)

    return ranges.select("file", "offset", "end", "members").mapInArrow(
        run, "page_id long, record_type string, payload string, payload_bytes long, payload_digest string, refers_to long")


def new_folder(spark) -> str:
    return scratch_dir(spark, "warc")
