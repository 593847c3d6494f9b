"""WARC archives: written as whole-file gzip streams, normalised to one gzip member a record, read back by index.

1. Every scan task writes its rows as response records into one gzip stream (a monolithic file).
2. The keys (payload digest, page) of those records meet in one join that names for each record the page
   whose record it revisits, if any, in which a page that stands very often stays where it is; payloads are never shuffled.
3. The normaliser inflates each file once, one gzip member or several, a piece at a time, rewrites every record as a gzip member of its own (revisits without
   payload) and writes a sidecar index of offsets.
4. Reading goes through the index, member by member.

Files lie in the shared folder. A task writes under a name of its own, and only names that successful tasks
report are read, so repeated and lost attempts leave no trace in the result.

Defined cases: null html is an empty payload; a null url is written as `about:blank`; of records with equal
payloads of at least MIN_REVISIT bytes those with the largest page_id are responses (several only where that
page_id itself repeats), the others revisit it; a null page_id is smaller than any number; an empty table gives an empty result; extra columns are
ignored; payloads of any size pass, one record at a time.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

MIN_REVISIT = 1000
#: Compression levels of the monolithic stream and of the members; bytes that are read at once.
LEVEL_WHOLE, LEVEL_MEMBER, CHUNK = 1, 4, 1 << 20
DATE = "2024-01-01T00:00:00Z"


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None = None) -> bytes:
    """A WARC/1.1 record. digest and size are those of the full payload; revisits carry no payload."""
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest}")
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + payload
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {DATE}",
            f"WARC-Target-URI: {re.sub(r'[\x00-\x20]', '%20', url or 'about:blank')}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {size}", f"WARC-Page-Id: {'-' if page_id is None else page_id}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-Id: {'-' if refers_to is None else refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class Records:
    """Splits inflated bytes, fed in pieces, into (headers, block)."""

    def __init__(self):
        self.rest = bytearray()

    def feed(self, data: bytes):
        self.rest += data
        while (end := self.rest.find(b"\r\n\r\n")) >= 0:
            lines = self.rest[:end].decode().split("\r\n")
            if lines[0] != "WARC/1.1":
                raise ValueError("not a WARC record")
            head = dict(x.split(": ", 1) for x in lines[1:])
            stop = end + 4 + int(head["Content-Length"])
            if len(self.rest) < stop + 4:
                return
            block = bytes(self.rest[end + 4 : stop])
            del self.rest[: stop + 4]
            yield head, block

    def close(self) -> None:
        if self.rest:
            raise ValueError("the archive ends inside a record")


def inflated(src):
    """The bytes of a gzip file of one or more members, in pieces of at most CHUNK; zeros may follow a member."""
    inflate, begun = zlib.decompressobj(31), False
    while data := src.read(CHUNK):
        while data:
            if not begun and not (data := data.lstrip(b"\0")):
                break
            begun = True
            if piece := inflate.decompress(data, CHUNK):
                yield piece
            data = inflate.unconsumed_tail
            if inflate.eof:
                data, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
    if begun:
        if piece := inflate.flush():
            yield piece
        if not inflate.eof:
            raise ValueError("the gzip stream is cut short")


def payload_of(block: bytes) -> bytes:
    return block[block.index(b"\r\n\r\n") + 4 :]


def _number(value: str) -> int | None:
    return None if value == "-" else int(value)


def write_whole(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of pages (page_id, url, html) as response records, a gzip stream for each task; (file, page_id, digest, size)."""

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        name, out, seen = f"whole-{uuid.uuid4().hex}.warc.gz", None, []
        packer = zlib.compressobj(LEVEL_WHOLE, zlib.DEFLATED, 31)
        for b in batches:
            for page, url, html in zip(*(b[c].to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if out is None:
                    out = fs.open_output_stream(f"{base}/whole/{name}", compression=None)
                payload = (html or "").encode("utf-8", "replace")
                digest = hashlib.sha1(payload).hexdigest()
                out.write(packer.compress(record("response", page, url, payload, digest, len(payload))))
                seen.append((page, digest, len(payload)))
        if out is not None:
            out.write(packer.flush())
            out.close()
            ids, digests, sizes = zip(*seen, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(seen)), pa.array(range(len(seen)), pa.int64()), pa.array(ids, pa.int64()), pa.array(digests), pa.array(sizes, pa.int64())], ["file", "seq", "page_id", "digest", "size"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, "file string, seq long, page_id long, digest string, size long")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites each (file, revisits) with one gzip member a record and writes its index; (file, records, bytes).

    revisits: array of (seq, refers_to) of the records that become revisits.
    """

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for source, revisits in zip(b["file"].to_pylist(), b["revisits"].to_pylist(), strict=True):
                refers, n, at = {r["seq"]: r["refers_to"] for r in revisits}, 0, 0
                name = source.replace("whole-", "records-").removesuffix(".warc.gz") + f"-{uuid.uuid4().hex[:8]}.warc.gz"
                records = Records()
                with (
                    fs.open_input_stream(f"{base}/whole/{source}", compression=None) as src,
                    fs.open_output_stream(f"{base}/{name}", compression=None) as out,
                    fs.open_output_stream(f"{base}/{name}.idx", compression=None) as index,
                ):
                    for piece in inflated(src):
                        for head, block in records.feed(piece):
                            page, digest, size = _number(head["WARC-Page-Id"]), head["WARC-Payload-Digest"][5:], int(head["WARC-Payload-Length"])
                            kind, payload = ("revisit", b"") if n in refers else ("response", payload_of(block))
                            packer = zlib.compressobj(LEVEL_MEMBER, zlib.DEFLATED, 31)
                            member = packer.compress(record(kind, page, head["WARC-Target-URI"], payload, digest, size, refers.get(n))) + packer.flush()
                            out.write(member)
                            index.write(json.dumps({"offset": at, "length": len(member), "uri": head["WARC-Target-URI"], "type": kind}).encode() + b"\n")
                            n, at = n + 1, at + len(member)
                    records.close()
                yield pa.RecordBatch.from_pydict({"file": [name], "records": [n], "bytes": [at]})

    return files.mapInArrow(run, "file string, records long, bytes long")


def read_back(files: DataFrame, folder: str) -> DataFrame:
    """Every record of the normalised files, found by the index: digests are recomputed where the payload is there."""
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "file", "offset", "length"]

    def run(batches):
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        for b in batches:
            for file in b["file"].to_pylist():
                with fs.open_input_file(f"{base}/{file}") as src, fs.open_input_stream(f"{base}/{file}.idx") as index:
                    rows = []
                    for line in index.read().decode().splitlines():
                        entry = json.loads(line)
                        src.seek(entry["offset"])
                        records = Records()
                        ((head, block),) = records.feed(zlib.decompress(src.read(entry["length"]), 31))
                        records.close()
                        size, digest, kind = int(head["WARC-Payload-Length"]), head["WARC-Payload-Digest"][5:], head["WARC-Type"]
                        if kind == "response":
                            payload = payload_of(block)
                            if len(payload) != size or hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError("a payload does not match its header")
                        rows.append((_number(head["WARC-Page-Id"]), size, digest, kind, _number(head.get("WARC-Refers-To-Page-Id", "-")), file, entry["offset"], entry["length"]))
                if rows:
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long, length long")


def archived(pages: DataFrame) -> DataFrame:
    """Archives pages in the shared folder and returns what is read back from there."""
    spark = pages.sparkSession
    folder = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/whole")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(path)
    keys = common.stored(write_whole(pages, folder), "warc-keys")
    big = keys.filter(F.col("size") >= MIN_REVISIT)
    keepers = common.stored(big.groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count("*").alias("times")).filter("times > 1"), "warc-keepers")
    revisits = common.join_repeated(big, keepers, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("keeper")))
    by_file = revisits.groupBy("file").agg(F.collect_list(F.struct("seq", F.col("keeper").alias("refers_to"))).alias("revisits"))
    files = keys.groupBy("file").agg(F.count("*").alias("n")).join(by_file, "file", "left")
    none = F.expr("CAST(array() AS ARRAY<STRUCT<seq: BIGINT, refers_to: BIGINT>>)")
    work = common.stored(files.select("file", F.coalesce("revisits", none).alias("revisits")), "warc-work")
    n = max(1, work.count())
    done = common.stored(normalise(work.repartition(n, "file"), folder), "warc-files")
    common.remove_path(spark, f"{folder}/whole")  # the monolithic streams are not needed any more
    return read_back(done.repartition(n, "file"), folder)


def op5(spark, sf_dir: str) -> DataFrame:
    found = archived(common.table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), k AS (
    SELECT *, max(page_id) OVER (PARTITION BY html) AS keeper, count(*) OVER (PARTITION BY html) AS n FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to
FROM k
"""
