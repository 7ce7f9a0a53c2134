"""WARC archives: a writer, and a sequential reader.

The reader takes a stream of any length in blocks: one gzip member per record,
incremental zlib decompression, headers up to the empty line, a content block
framed by Content-Length, and a running SHA-1 against the payload digest.

The writer puts each page in a record.  Of pages with equal payloads of at
least `least` bytes, that with the largest id is the response and the others
revisit it.  Archives go to the shared folder under names of their own for each
attempt, and only those that a finished task reports are read; a lost executor
leaves at most a file that nobody names.

Defined results: null html is an empty payload; null url gives the record's own
URN as target; repeated rows of the largest id are responses each; pages with a
null id are revisits where a page with an id has their payload, else responses;
an empty table gives no record; a wrong digest or a broken frame raises;
columns besides page_id, url and html are not carried."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .shared import bound_batches, materialise, n_partitions, new_folder

BLOCK = 1 << 20
DATE = "2000-01-01T00:00:00Z"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target string"


def urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str):
    m = re.fullmatch(r"<urn:page:(-?\d+)>", name)
    return int(m[1]) if m else None


def record(page_id, url, payload: bytes, refers_to=None, revisit: bool = False) -> bytes:
    """One record as a gzip member."""
    sha = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = urn(page_id) if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{sha}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n") + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def _headers(raw: bytes) -> dict:
    out = {}
    for line in raw.decode("utf-8", "surrogateescape").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class _Record:
    """State of the record that is being read."""

    def __init__(self, keep: bool):
        self.raw, self.head, self.http, self.left, self.tail = b"", None, None, 0, b""
        self.sha, self.size, self.keep, self.payload = hashlib.sha1(), 0, keep, []

    def feed(self, data: bytes) -> None:
        if self.head is None:
            self.raw += data
            end = self.raw.find(b"\r\n\r\n")
            if end < 0:
                return
            if not self.raw.startswith(b"WARC/"):
                raise ValueError("not a WARC record")
            self.head, data, self.raw = _headers(self.raw[:end]), self.raw[end + 4 :], b""
            self.left = int(self.head["content-length"])
        block, self.tail = data[: self.left], self.tail + data[self.left :]
        self.left -= len(block)
        if self.http is None:
            self.raw += block
            end = self.raw.find(b"\r\n\r\n")
            if end < 0:
                return
            self.http, block, self.raw = _headers(self.raw[:end]), self.raw[end + 4 :], b""
        self.sha.update(block)
        self.size += len(block)
        if self.keep:
            self.payload.append(block)

    def done(self) -> dict:
        if self.head is None or self.left or self.tail != b"\r\n\r\n" or self.http is None:
            raise ValueError("a record ends before its content does")
        revisit = self.head["warc-type"] == "revisit"
        claimed = base64.b32decode(self.head["warc-payload-digest"].removeprefix("sha1:")).hex()
        if not revisit and (claimed != self.sha.hexdigest() or self.size != int(self.http["content-length"])):
            raise ValueError(f"payload digest of {self.head['warc-record-id']} is wrong")
        out = {
            "page_id": page_of(self.head["warc-record-id"]), "payload_bytes": int(self.http["content-length"]), "payload_digest": claimed,
            "record_type": self.head["warc-type"], "refers_to": page_of(self.head.get("warc-refers-to", "")), "target": self.head["warc-target-uri"],
        }
        return out | ({"payload": b"".join(self.payload)} if self.keep else {})


def read_records(stream, keep: bool = False) -> Iterator[dict]:
    """Records of a binary stream in order; memory holds a block of it (and,
    with `keep`, one payload)."""
    member, current, data = None, None, b""
    while True:
        if not data:
            data = stream.read(BLOCK)
            if not data:
                break
        if member is None:
            member, current = zlib.decompressobj(31), _Record(keep)
        while data and not member.eof:
            current.feed(member.decompress(data, BLOCK))
            data = member.unconsumed_tail
        while not member.eof and (more := member.decompress(b"", BLOCK)):
            current.feed(more)
        if member.eof:
            data = member.unused_data
            yield current.done()
            member = None
    if member is not None:
        raise ValueError("the archive ends inside a record")


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


SALTS = 16  # shares of the pages of one payload
LIMIT = 200_000  # payloads of several pages that may be broadcast (28 bytes each)
FRAME = 8 << 20  # bytes of html that a writer turns into Python strings at once


def decide(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Add refers_to (page that has the payload) and revisit.

    Digests and ids alone find the payloads of several pages; up to `LIMIT` of
    these travel to the pages by broadcast, and html stays where it is.  Beyond,
    pages meet them under salts, as a payload may be that of a third of all
    pages, and are shuffled once with their html; pages below `least` bytes
    meet nothing."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    sha = F.when(F.octet_length(raw) >= least, F.unhex(F.sha1(raw)))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"), sha.alias("_sha"))
    several = rows.where("_sha is not null").groupBy("_sha").agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_sha").alias("_key"), "_last")
    bound_batches(pages.sparkSession)
    several = materialise(several, "payloads")
    if several.count() <= LIMIT:
        joined = rows.join(F.broadcast(several), F.col("_sha") == F.col("_key"), "left")
    else:
        salts = n_partitions(pages.sparkSession)
        rows = rows.withColumn("_salt", F.when(F.col("_sha").isNotNull(), F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).otherwise(F.pmod(F.xxhash64("page_id", "url"), F.lit(salts * SALTS))))
        # a page without a digest has a key of its own kind, so such pages are dealt evenly
        key = F.coalesce(F.col("_sha"), F.col("_salt").cast("string").cast("binary"))
        salted = several.withColumn("_turn", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = rows.withColumn("_meet", key).join(salted, (F.col("_meet") == F.col("_key")) & (F.col("_salt") == F.col("_turn")), "left")
    revisit = F.col("_last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("_last")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least: int = 1000, roll: int = 64 << 20) -> DataFrame:
    """Write the pages; rows (path, records, bytes) of the finished archives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, records, size = None, None, 0, 0
        done = lambda: pa.record_batch([pa.array([path]), pa.array([records], pa.int64()), pa.array([size], pa.int64())], ["path", "records", "bytes"])
        for batch in flat.released(batches):
            step = max(1, min(2000, FRAME * batch.num_rows // max(batch.nbytes, 1)))
            for i in range(0, batch.num_rows, step):
                for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in batch.slice(i, step).columns)):
                    if out is None:
                        path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        system, at = _open(path)
                        out = system.open_output_stream(at, compression=None)
                    data = record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, revisit)
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= roll:
                        out.close()
                        yield done()
                        out = None
        if out is not None:
            out.close()
            yield done()

    return materialise(decide(pages, least).mapInArrow(run, "path string, records long, bytes long"), "archives")


def read_archives(archives: DataFrame, keep: bool = False) -> DataFrame:
    """The records of archives listed by `path`, each read in sequence."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target"] + ["payload"] * keep
        for frame in frames:
            for path in frame["path"]:
                system, at = _open(path)
                rows = []
                with system.open_input_stream(at, compression=None) as stream:
                    for r in read_records(stream, keep):
                        rows.append(r)
                        if len(rows) >= (100 if keep else 5000):
                            yield _frame(rows, columns)
                            rows = []
                if rows:
                    yield _frame(rows, columns)

    dealt = archives.select("path").repartition(n_partitions(archives.sparkSession), "path")
    return dealt.mapInPandas(run, RECORD + ", payload binary" * keep)


def _frame(rows: list, columns: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    for c in ("page_id", "refers_to"):
        out[c] = pd.array([None if v is None or v != v else int(v) for v in out[c].astype(object)], "Int64")
    return out


def make_folder(spark) -> str:
    """A new folder for archives in the shared one."""
    path = new_folder(spark, "warc")
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
    return path
