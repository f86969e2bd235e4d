"""Operator 1, dictionary-compressed WARC archives (.warc.zst).

Layout of a file: a skippable frame (magic 0x184D2A5D) with a Zstandard
dictionary, itself compressed, then one frame for each record.  The
dictionary is trained by the writing task on the first records of its file
(at most ``SAMPLE`` bytes, the bound of the memory for it); a file with too
few records takes those records themselves as a raw dictionary.

Deduplication: payload digests are grouped in the JVM with map-side
aggregation; pages meet their group in a join on the digest, which Spark
splits where a digest is hot.  The writer runs once; every task attempt
writes files under names of its own and reports them, and only files of
successful attempts are read, so a lost executor leaves no half record.
The driver holds one path for each file.

Defined cases: a null html is an empty payload.  A null page_id never is the
response of others; if all ids of a payload are null, all are responses, else
they revisit.  Rows that share the largest page_id are all responses.  A null
url leaves the target header out.  Extra columns are ignored.  An empty table
writes no file and gives an empty result.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from yearlink.llm import common as C
from yearlink.session import ensure_checkpoint_dir

MAGIC = 0x184D2A5D
SAMPLE = 2 << 20  # bytes of records the dictionary of a file is trained on
DICTIONARY = 64 << 10
FILE = 32 << 20  # compressed bytes after which a task begins another file
LEAST = 1000  # payloads below are never revisits
LEVEL = 3
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def record(
    page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: int | None, date: str
) -> bytes:
    """One WARC/1.1 record.  A revisit keeps the HTTP head, with the length of
    the full payload, and no payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    if not revisit:
        block += payload
    name = page_id if page_id is not None else f"none-{uuid.uuid5(uuid.NAMESPACE_URL, f'{url} {digest}')}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:x-page:{name}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head += [f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY, samples)
    except zstandard.ZstdError:  # too few records to train on
        raw = b"".join(samples)[-DICTIONARY:]
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def leading_frame(d: zstandard.ZstdCompressionDict) -> bytes:
    body = zstandard.ZstdCompressor(level=9).compress(d.as_bytes())
    return struct.pack("<II", MAGIC, len(body)) + body


def archives(records: Iterator[bytes]) -> Iterator[tuple[bytes, int]]:
    """Whole files (bytes, number of records) of the records in turn."""
    waiting: list[bytes] = []
    size, out, n, zc = 0, None, 0, None

    def start():
        d = dictionary(waiting)
        return io.BytesIO(leading_frame(d)), zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_checksum=True)

    for r in records:
        if out is None:
            waiting.append(r)
            size += len(r)
            if size < SAMPLE:
                continue
            (out, zc), due = start(), waiting
            out.seek(0, io.SEEK_END)
        else:
            due = [r]
        for x in due:
            out.write(zc.compress(x))
            n += 1
        waiting, size = [], 0
        if out.tell() >= FILE:
            yield out.getvalue(), n
            out, n = None, 0
    if out is None and waiting:
        out, zc = start()
        out.seek(0, io.SEEK_END)
        for x in waiting:
            out.write(zc.compress(x))
            n += 1
    if out is not None:
        yield out.getvalue(), n


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a file: header fields and block."""
    magic, size = struct.unpack_from("<II", data)
    if magic != MAGIC:
        raise ValueError("the file does not begin with a dictionary frame")
    raw = zstandard.ZstdDecompressor().decompress(data[8 : 8 + size])
    zd = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    body = io.BytesIO(data)
    body.seek(8 + size)
    stream = io.BufferedReader(zd.stream_reader(body, read_across_frames=True), 1 << 17)
    while first := stream.readline():
        if first != b"WARC/1.1\r\n":
            raise ValueError("not a WARC record")
        fields = {}
        while (line := stream.readline()) != b"\r\n":
            key, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[key] = value
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield fields, block


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def _write(folder: str, date: str):
    def run(batches):
        files, base = _file_system(folder)

        def records():
            for b in C.slices(batches, "html", rows=512):
                payloads = b.column(2).cast(pa.binary()).to_pylist()
                rest = [b.column(i).to_pylist() for i in (0, 1, 3, 4, 5)]
                for payload, page_id, url, length, digest, to in zip(payloads, *rest, strict=True):
                    yield record(page_id, url, payload, length, digest, to, date)

        for data, n in archives(records()):
            name = f"{uuid.uuid4().hex}.warc.zst"
            with files.open_output_stream(f"{base}/{name}", compression=None) as f:
                f.write(data)
            cols = [pa.array([f"{folder}/{name}"]), pa.array([n], pa.int64()), pa.array([len(data)], pa.int64())]
            yield pa.record_batch(cols, names=["path", "records", "bytes"])

    return run


def write_archives(
    pages: DataFrame,
    folder: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    date: str = "2024-01-01T00:00:00Z",
    least: int = LEAST,
) -> DataFrame:
    """Write the pages as .warc.zst files into ``folder``, a path that driver
    and executors share.  Returns (path, records, bytes) of each file."""
    C.prepare(pages.sparkSession)
    payload = F.coalesce(F.col(html_col), F.lit(""))
    plain = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).alias("url"),
        payload.alias("html"),
        F.octet_length(payload).cast("long").alias("length"),
        F.sha1(payload.cast("binary")).alias("digest"),
    )
    groups = (
        plain.where(F.col("length") >= least)
        .groupBy("digest", "length")
        .agg(F.max("page_id").alias("response"), F.count("*").alias("copies"))
        .where("copies > 1 and response is not null")
        .select("digest", "length", "response")
    )
    to = F.when(F.col("page_id").eqNullSafe(F.col("response")), F.lit(None)).otherwise(F.col("response"))
    rows = plain.join(groups, ["digest", "length"], "left").select("page_id", "url", "html", "length", "digest", to.alias("refers_to"))
    files, base = _file_system(folder)
    files.create_dir(base, recursive=True)
    return C.shared_table(rows.mapInArrow(_write(folder, date), "path string, records long, bytes long"), "warc-files")


_URN = re.compile(r"<urn:x-page:(-?\d+)>")


def _page(field: str | None) -> int | None:
    m = _URN.fullmatch(field or "")
    return int(m[1]) if m else None


def _read(batches):
    for b in batches:
        for data in b.column(0):
            out = {"page_id": [], "url": [], "payload_bytes": [], "payload_digest": [], "record_type": [], "refers_to": []}

            def made(out=out):
                types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
                return pa.record_batch([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

            for fields, block in parse(data.as_py()):
                head, _, payload = block.partition(b"\r\n\r\n")
                kind = fields["WARC-Type"]
                length = int(re.search(rb"Content-Length: (\d+)", head)[1])
                digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != length or hashlib.sha1(payload).hexdigest() != digest):
                    raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                row = (_page(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), length, digest, kind)
                for k, v in zip(out, (*row, _page(fields.get("WARC-Refers-To"))), strict=True):
                    out[k].append(v)
                if len(out["page_id"]) == 4096:
                    yield made()
                    for v in out.values():
                        v.clear()
            yield made()


def read_archives(spark: SparkSession, files: DataFrame) -> DataFrame:
    """Per record of the files (a ``path`` column): page_id, url,
    payload_bytes, payload_digest, record_type, refers_to.  Lengths and
    digests of responses are checked against the payload."""
    C.prepare(spark)
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    paths = [r["path"] for r in files.select("path").collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load(paths).select("content").mapInArrow(_read, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write all pages, read them back, and list the records."""
    spark = pages.sparkSession
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    read = read_archives(spark, write_archives(pages, folder))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
q AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS payload_digest,
             max(page_id) OVER (PARTITION BY body) AS response FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= {LEAST} AND page_id IS DISTINCT FROM response THEN response END AS refers_to FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN refers_to IS NULL THEN 'response' ELSE 'revisit' END AS record_type, refers_to
FROM r
"""
