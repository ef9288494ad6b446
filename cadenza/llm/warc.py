"""Web archives: pages written as WARC files and read back, damage and all.

Each task writes its records, one gzip member each, to archive files of
bounded size in a shared folder; a file's name holds the attempt, and only
files that the manifest (a Parquet table, committed by Spark for successful
tasks alone) lists belong to the archive, so tasks may run twice or be lost.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cadenza.llm.common import bounded_batches, lookup_join, sha256_hex, written
from cadenza.llm.warc_core import Gap, member, page_of, page_record, payload_of, salvage

#: Bytes after which an archive file is closed and the next one begins.
ROLL_BYTES = 64 << 20
#: Payloads below this many bytes are always responses.
REVISIT_BYTES = 100
_MANIFEST = "file string, records long, bytes long"
_RECORD = ("page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, "
           "payload binary, file string, start long, end long")


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder named by a URI or an absolute path."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def payload_owners(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with digest, n_bytes and refers_to: the
    smallest page_id of those with an equal payload, null for that page itself
    and for payloads under REVISIT_BYTES.  Null html is an empty payload."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select(
        "page_id", "url", "html", sha256_hex(F.col("html")).alias("digest"), F.octet_length("html").cast("long").alias("n_bytes"))
    firsts = written(rows.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")), "payloads")
    joined = lookup_join(rows, firsts, ["digest"], "n")
    return joined.withColumn("refers_to", F.when(
        (F.col("n_bytes") >= REVISIT_BYTES) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first", "n")


def write_archives(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record per row of ``pages`` (page_id, url, html) to archive
    files in ``folder`` and return their manifest (file, records, bytes).

    Of equal payloads the page with the smallest id is the response, the
    others are revisits of it; rows that share an id are all responses if it
    is the smallest."""
    bounded_batches(pages.sparkSession)
    fs, base = _open(folder)
    fs.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        task = TaskContext.get()
        name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}"
        files, out, size, n = 0, None, 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"file": [f"{name}-{files:04d}.warc.gz"], "records": pa.array([n], pa.int64()),
                                               "bytes": pa.array([size], pa.int64())})

        for b in batches:
            for page_id, url, text, digest, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                if out is None:
                    out, size, n = fs.open_output_stream(f"{base}/{name}-{files:04d}.warc.gz", compression=None), 0, 0
                data = member(page_record(page_id, url, text.encode(), digest, refers_to))
                out.write(data)
                size, n = size + len(data), n + 1
                if size >= roll_bytes:
                    yield close()
                    files, out = files + 1, None
        if out is not None:
            yield close()

    rows = payload_owners(pages).select("page_id", "url", "html", "digest", "refers_to")
    return written(rows.mapInArrow(run, _MANIFEST), "warc-manifest")


def _scan(spark: SparkSession, manifest: DataFrame, folder: str, gaps: bool, with_payload: bool, schema: str) -> DataFrame:
    from hashlib import sha256

    def row(name: str, r) -> dict:
        h = r.headers
        response = h.get("warc-type") == "response"
        data = payload_of(r) if response else None
        length = re.search(rb"content-length:\s*(\d+)", r.block.partition(b"\r\n\r\n")[0], re.I)
        uri = h.get("warc-target-uri")
        return {"page_id": page_of(h.get("warc-record-id", "")),
                "url": None if uri is None else re.sub("((?:%[0-9A-F]{2})+)", lambda m: bytes.fromhex(m[0].replace("%", "")).decode("utf-8", "replace"), uri),
                "record_type": h.get("warc-type"), "refers_to": page_of(h.get("warc-refers-to", "")),
                "payload_digest": sha256(data).hexdigest() if response else h.get("warc-payload-digest", "").partition(":")[2],
                "payload_bytes": len(data) if response else int(length[1]) if length else None,
                "payload": data if with_payload else None, "file": name, "start": r.start, "end": r.end}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        to = pa.schema([(f.name, {"long": pa.int64(), "bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.dataType.simpleString()])
                        for f in fields])
        for b in batches:
            for name in b.column("file").to_pylist():
                with fs.open_input_file(f"{base}/{name}") as f:
                    data = f.read()
                rows, held = [], 0
                for r in salvage(data):
                    if isinstance(r, Gap) == gaps:
                        rows.append({"file": name, "start": r.start, "end": r.end, "reason": r.reason} if gaps else row(name, r))
                        held += 0 if gaps or not with_payload else len(r.block)
                    if held > (8 << 20) or len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, to)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, to)

    fields = spark.createDataFrame([], schema).schema.fields
    n = max(1, min(manifest.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return manifest.select("file").repartition(n, "file").mapInArrow(run, schema)


def read_archives(spark: SparkSession, manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Every record that can be read from the listed files: page_id, url,
    record_type, refers_to, payload_digest (of a response computed from its
    payload, of a revisit from its header), payload_bytes (of the full
    payload), payload (null for revisits and without ``with_payload``), file,
    start, end (bytes in the file)."""
    return _scan(spark, manifest, folder, False, with_payload, _RECORD)


def quarantined(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """(file, start, end, reason): the byte ranges of the listed files that
    belong to no valid record, with the check that failed there first."""
    return _scan(spark, manifest, folder, True, False, "file string, start long, end long, reason string")
