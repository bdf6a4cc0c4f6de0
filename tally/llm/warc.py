"""WARC archives: a writer of one gzip member per record, and a splittable reader.

The reader cuts files into byte ranges. A task looks for the gzip magic inside its range, takes a candidate for a record
only if the member decodes to a WARC header, and reads each record that starts inside, to its end beyond the range if need
be. From one record to the next it follows the members, so magic bytes inside compressed data can't start a record.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tally.llm.common import materialize, new_path

MAGIC = b"\x1f\x8b\x08"
#: Payloads below this are never worth a revisit record.
LEAST_REVISIT = 1000
READ = 1 << 20
URN = "urn:x-page:"


def plan_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, html, digest, n_bytes, refers_to): of equal payloads of LEAST_REVISIT bytes or more, the largest id is
    the response and the others refer to it. Rows that repeat the largest id are all responses."""
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.sha1(F.encode("html", "UTF-8"))).withColumn("n_bytes", F.octet_length("html").cast("long"))
    narrow = rows.filter((F.col("n_bytes") >= LEAST_REVISIT) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = narrow.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("c")).filter("c > 1").select("digest", "first")
    # settled on ids and digests; the payloads then move by page, so that a common one is no task's alone
    revisits = narrow.join(first, "digest").filter("page_id < first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    return rows.join(revisits, ["page_id", "digest"], "left")


def record(page_id, url, html: bytes, digest: str, n_bytes: int, refers_to) -> bytes:
    """One record, not yet compressed."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html if refers_to is None else b"")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {n_bytes}",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{URN}{refers_to}>"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(raw: bytes, level: int = 4) -> bytes:
    squeeze = zlib.compressobj(level, zlib.DEFLATED, 31)
    return squeeze.compress(raw) + squeeze.flush()


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` with the scheme that Spark would take it for: without one it lies on the default file system, not on a task's disk."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a qualified folder, and the path there; a local one is the shared folder that is mounted everywhere."""
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """(path, n_bytes) of the archives written, one per task, into ``folder`` (any address that pyarrow.fs opens).

    A task writes under a name of its attempt and renames at the end, so attempts that die or run twice leave no half or
    doubled archive: the table of names is what counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}.warc.gz"
        size = 0
        with store.open_output_stream(f"{name}.open", compression=None) as out:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "n_bytes", "refers_to")]
                for page_id, url, html, digest, n_bytes, refers_to in zip(*columns, strict=True):
                    size += out.write(packed := member(record(page_id, url, html.encode(), digest, n_bytes, refers_to))) or len(packed)
        store.move(f"{name}.open", name)
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([name[len(root) + 1 :]]), pa.array([size], pa.int64())], ["path", "n_bytes"])

    picked = records.select("page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise("").alias("html"), "digest", "n_bytes", "refers_to")
    return picked.mapInArrow(run, "path string, n_bytes long")


class Source:
    """A file read forward in pieces, with random starts."""

    def __init__(self, handle):
        self.handle, self.at, self.held = handle, 0, b""

    def peek(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes from ``at`` on."""
        if not (self.at <= at and at + n <= self.at + len(self.held)):
            self.handle.seek(at)
            self.at, self.held = at, self.handle.read(max(n, READ))
        return self.held[at - self.at : at - self.at + n]


def read_member(source: Source, at: int) -> tuple[bytes, int] | None:
    """The content of the gzip member at ``at`` and where the next begins; None if there is no whole WARC record."""
    inflate, out, checked, pos = zlib.decompressobj(31), [], False, at
    while True:
        piece = source.peek(pos, 65536)
        if not piece:
            return None
        try:
            out.append(inflate.decompress(piece))
        except zlib.error:
            return None
        pos += len(piece)
        if not checked and sum(map(len, out)) >= 5:
            if not b"".join(out).startswith(b"WARC/"):
                return None
            checked = True
        if inflate.eof:
            return (b"".join(out), pos - len(inflate.unused_data)) if checked else None


def records_in(source: Source, start: int, end: int) -> Iterator[bytes]:
    """Records whose member starts in [start, end)."""
    at, in_step = start, start == 0
    while at < end:
        if not in_step:
            piece = source.peek(at, min(65536, end - at + 2))
            if not piece:  # the file ends before the range
                return
            hit = piece.find(MAGIC)
            if hit < 0:
                at += max(1, len(piece) - 2)
                continue
            if at + hit >= end:
                return
            at += hit
        found = read_member(source, at)
        if found is None:
            at, in_step = at + 1, False
        else:
            yield found[0]
            at, in_step = found[1], True


def parse(raw: bytes) -> tuple[int | None, int, str, str, int | None, str, bytes]:
    """(page_id, payload bytes, digest, type, refers_to, url, payload) of a record; a response's digest is made from its bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    field = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    block = rest[: int(field["content-length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    number = lambda x: int(x) if (x := x.strip("<>").removeprefix(URN)) else None
    kind = field["warc-type"]
    declared = field["warc-payload-digest"].removeprefix("sha1:")
    if kind != "response":
        return number(field["warc-record-id"]), int(field["x-payload-length"]), declared, kind, number(field["warc-refers-to"]), field["warc-target-uri"], b""
    digest = hashlib.sha1(payload).hexdigest()
    if digest != declared:
        raise ValueError(f"payload of {field['warc-record-id']} doesn't match its digest")
    return number(field["warc-record-id"]), len(payload), digest, kind, None, field["warc-target-uri"], payload


def read_archives(archives: DataFrame, folder: str, split: int = 16 << 20, payloads: bool = False) -> DataFrame:
    """Records of ``archives`` (path in ``folder``, n_bytes), read in ranges of ``split`` bytes.

    (page_id, payload_bytes, payload_digest, record_type, refers_to, url), with ``payloads`` also payload (binary, empty for
    revisits).
    """
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_bytes") - 1, F.lit(split).cast("long"))).alias("start"))
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"][: 7 if payloads else 6]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(folder)
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{path}") as handle:
                    rows: list = []
                    for raw in records_in(Source(handle), start, start + split):
                        rows.append(parse(raw)[: len(names)])
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names)

    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", payload binary" * payloads
    n = max(1, min(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), 10_000))
    return ranges.repartition(n, "path", "start").mapInArrow(run, schema)


def round_trip(spark: SparkSession, pages: DataFrame, split: int = 16 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write ``pages`` as archives into the shared folder and read them back, one row per page.

    Null html is an empty payload, a null url an empty one, a null id stays null (such rows are always responses and no
    others refer to them); a long payload is one record, held whole by the task that writes or reads it; an empty table gives
    no rows; other columns are ignored.
    """
    folder = qualified(spark, new_path(spark, "warc"))
    archives = materialize(write_archives(plan_records(pages, id_col, url_col, html_col), folder), "archives")
    return read_archives(archives, folder, split)
