"""WARC archives, written and read as a chunked record table.

Writing: every task writes gzip-per-record WARC/1.1 files to the shared folder, payloads in pieces of CHUNK bytes, and returns
a manifest row for each file. Names are new for each attempt and only the manifest of successful tasks is read, so a
lost or repeated task leaves nothing that counts. Reading: files are streamed; each record gives rows of
record and chunk number with the payload's running length and SHA-1 up to there, and its bytes if asked for, so no record is ever held whole; the
last chunk's running digest is the payload's, and is checked against the header. The query reads all chunk rows and takes each
record's columns from its last one.

Equal payloads are found by their SHA-1. Of equal payloads of LEAST_BYTES or more, the record with the largest
page_id is a response and the others revisit it, stored without their payload but with its length and digest.

The shared folder may lie on a local or mounted disk, or in a store that Arrow's file systems reach (SCHEMES); for any
other, ``write`` says so before it starts.

Defined cases: a null html is an empty payload; long payloads go piece by piece; rows with a null page_id are written, never revisited and get no
page_id back, but revisit others with an equal payload; rows that repeat the largest page_id are all responses; an
empty table gives no archive and no rows; columns besides page_id, url and html don't matter.
"""

import base64
import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.llm.common import cut, remove, shared_dir, small_side

LEAST_BYTES = 0
CHUNK = 1 << 20
FILE_BYTES = 256 << 20
#: Rows of the table of repeated payloads that may be broadcast, beside its bytes; parts of a payload's pages where it isn't.
MOST_ROWS, SALTS = 1_000_000, 32
#: Bytes of payload that a batch of chunk rows holds, about.
BATCH_BYTES = 8 << 20
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

MANIFEST = "file string, records bigint"
CHUNKS = "file string, record bigint, chunk bigint, page_id bigint, record_type string, refers_to bigint, upto bigint, sha1_upto string, last boolean, payload_bytes bigint, payload_digest string"


#: Schemes of Spark's paths, and Arrow's names for them.
SCHEMES = {"file": "file", "hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "abfs": "abfs", "abfss": "abfss"}


def _arrow_uri(uri: str) -> str:
    """A folder's address as Arrow knows it. file:/x, as Hadoop writes it, is file:///x."""
    scheme, colon, rest = uri.partition(":")
    if not colon:
        return uri if uri.startswith("/") else f"/{uri}"
    if scheme not in SCHEMES:
        raise ValueError(f"archives can't be written to {scheme}: folders; one of {', '.join(SCHEMES)} is needed")
    return f"{SCHEMES[scheme]}:{rest if rest.startswith('//') else '//' + rest}"


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(_arrow_uri(uri))


def _b32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def roles(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages (page_id, url, html) with sha1, payload_bytes and refers_to (null: a response)."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("bigint").alias("payload_bytes"))
    groups = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("sha1").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1 and first is not null").select("sha1", "first"))
    side = small_side(groups, MOST_ROWS)
    if side is not groups:
        out = rows.join(side, "sha1", "left")
    else:  # by shuffle: the commonest payload goes to many tasks
        out = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS))).join(groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["sha1", "salt"], "left")
    return out.select("page_id", "url", "html", "sha1", "payload_bytes", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def _header(page_id: int | None, url: str | None, sha1: str, size: int, refers_to: int | None, name: str) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c for c in url if c >= " "))
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if refers_to is not None:
        lines += [f"X-Refers-To-Page-Id: {refers_to}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{_b32(sha1)}", f"X-Payload-Length: {size}", "Content-Type: application/http; msgtype=response"]
    lines.append(f"Content-Length: {len(HTTP_HEAD) + (size if refers_to is None else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def _pieces(text: pa.StringScalar) -> Iterator[memoryview]:
    """UTF-8 of a text, piece by piece, without a copy of it."""
    data = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
    for at in range(0, len(data), CHUNK):
        yield data[at : at + CHUNK]


def write(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows (as of roles()) to WARC files in folder; the manifest."""
    _arrow_uri(folder)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _place(folder)
        out, name, written, records = None, "", 0, 0
        for b in batches:
            ids, urls, htmls, shas, sizes, refs = (b.column(i) for i in range(6))
            for i in range(b.num_rows):
                if out is None:
                    name, written, records = f"{path}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(name, compression=None)
                z = zlib.compressobj(1, zlib.DEFLATED, 31)
                ref = refs[i].as_py()
                parts = [_header(ids[i].as_py(), urls[i].as_py(), shas[i].as_py(), sizes[i].as_py(), ref, f"{name}#{records}"), HTTP_HEAD]
                for p in parts:
                    written += out.write(z.compress(p)) or len(p)
                if ref is None:
                    for p in _pieces(htmls[i]):
                        out.write(z.compress(p))
                        written += len(p)
                out.write(z.compress(b"\r\n\r\n"))
                out.write(z.flush())
                records += 1
                if written >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"file": [name], "records": [records]}, pa.schema([("file", pa.string()), ("records", pa.int64())]))
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [name], "records": [records]}, pa.schema([("file", pa.string()), ("records", pa.int64())]))

    return cut(rows.select("page_id", "url", "html", "sha1", "payload_bytes", "refers_to").mapInArrow(run, MANIFEST))


def _records(stream, name: str) -> Iterator[dict]:
    """Chunk rows of one archive."""
    record = 0
    while first := stream.readline():
        if first.rstrip() != b"WARC/1.1":
            raise ValueError(f"{name}: no record at {record}")
        head = {}
        while line := stream.readline().rstrip(b"\r\n"):
            k, _, v = line.partition(b":")
            head[k.strip().lower()] = v.strip().decode()
        left = int(head[b"content-length"])
        got = stream.read(len(HTTP_HEAD))
        while not got.endswith(b"\r\n\r\n"):
            got += stream.readline()
        left -= len(got)
        number = lambda k: int(head[k]) if k in head else None
        row = {"file": name, "record": record, "page_id": number(b"x-page-id"), "record_type": head[b"warc-type"], "refers_to": number(b"x-refers-to-page-id")}
        size, digest = int(head[b"x-payload-length"]), head[b"warc-payload-digest"].removeprefix("sha1:")
        sha, upto, chunk = hashlib.sha1(), 0, 0
        revisit = row["record_type"] == "revisit"
        while True:
            data = stream.read(min(CHUNK, left)) if left else b""
            if left and not data:
                raise ValueError(f"{name}: record {record} ends early")
            left -= len(data)
            upto += len(data)
            sha.update(data)
            last = not left
            now = base64.b32encode(sha.digest()).decode()
            if last and not revisit and (upto, now) != (size, digest):
                raise ValueError(f"{name}: record {record} has another payload than its header says")
            yield row | {"chunk": chunk, "upto": upto, "sha1_upto": now, "last": last, "payload_bytes": size, "payload_digest": digest if revisit else now, "data": data}
            chunk += 1
            if last:
                break
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"{name}: record {record} isn't closed")
        record += 1


def read(manifest: DataFrame, folder: str, payload: bool = False) -> DataFrame:
    """The chunk rows (CHUNKS) of all archives of a manifest, by (file, record, chunk); with ``payload`` also data, the chunk's bytes."""
    columns = CHUNKS + (", data binary" if payload else "")
    schema = pa.schema([(f.split()[0], {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[f.split()[1]]) for f in columns.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _place(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(name, compression=None, buffer_size=1 << 20) as raw:
                    for r in _records(io.BufferedReader(gzip.GzipFile(fileobj=raw, mode="rb"), 1 << 20), name):
                        if payload:
                            held += len(r["data"])
                        else:
                            del r["data"]
                        rows.append(r)
                        if len(rows) >= 5000 or held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = max(1, manifest.count())
    return manifest.select("file").repartition(min(files, 4096)).mapInArrow(run, columns)


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    try:
        chunks = read(write(roles(pages), folder), folder)
        return cut(chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    finally:
        remove(spark, folder)


_GROUPS = ", ".join(f"('0x' || substr(h, {i}, 5))::INT" for i in range(1, 41, 5))
OP5_SQL = f"""
with p as (select page_id, coalesce(html, '') as t, strlen(coalesce(html, '')) as payload_bytes, sha1(coalesce(html, '')) as h from pages),
r as (select *, max(page_id) over (partition by t) as m from p)
select page_id, payload_bytes,
  list_aggregate(list_transform([{_GROUPS}], lambda g: list_aggregate(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') as payload_digest,
  case when page_id = m then 'response' else 'revisit' end as record_type,
  case when page_id = m then null else m end as refers_to
from r
"""
