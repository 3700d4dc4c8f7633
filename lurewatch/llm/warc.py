"""WARC archives: writing, normalising monolithic gzip files, and reading through an offset index.

Many tools gzip a whole WARC file as one stream, which cannot be entered in the middle. The normaliser inflates
such a stream once, from front to back and in bounded pieces, and rewrites every record as a gzip member of its
own. It writes a sidecar index (one JSON line a record: offset, length, type, record id, digest) beside the new
archive and returns the same rows as a DataFrame, so that any record can be read alone.

Files go to a folder all executors share, which a file system of pyarrow opens (local, hdfs, viewfs, s3, gs, abfs), under
names that no other attempt uses; only files that a finished task
reported are read, so a retried or lost task leaves nothing that counts.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import looked_up, shared_dir, slices, table, written

_PIECE = 1 << 18
INDEX = "archive string, offset long, length long, record_id string, record_type string, payload_digest string"
RECORD = "record_id string, page_id long, record_type string, refers_to long, url string, payload binary, payload_bytes long, payload_digest string"


def base32_sha1(data: F.Column) -> F.Column:
    """Upper-case base-32 SHA-1 of a binary column, from built-in functions."""
    digest = F.sha1(data)
    part = [F.lpad(F.conv(F.substring(digest, 10 * k + 1, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.upper(F.concat(*part)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def classified(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_digest, record_type, refers_to) for every row of pages (page_id, url, html).

    A null html is an empty payload. Of rows with equal payloads of at least `least_bytes` bytes, the largest page_id
    is the response and the others revisit it; rows that repeat this page_id are responses too, and a row without a
    page_id revisits unless no row of its class has one. A payload that a third of all pages share is no single task:
    digests are counted before the shuffle, and the rows look their class up (`looked_up`).
    """
    rows = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    large = rows.filter(F.octet_length("payload") >= least_bytes)
    several = large.groupBy("payload_digest").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null")
    several = written(several.select(F.col("payload_digest").alias("d"), "first"), "several")
    joined = looked_up(rows, several, several.count(), F.when(F.octet_length("payload") >= least_bytes, F.col("payload_digest")), "d", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def _urn(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page_id is None else f"<urn:page:{page_id}>"


def _page(urn: str | None) -> int | None:
    return int(urn[10:-1]) if urn and urn.startswith("<urn:page:") else None


def record_bytes(row: dict) -> bytes:
    """One WARC/1.1 record. A revisit holds the HTTP head alone; its Content-Length is that of the payload."""
    payload = row["payload"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = row["record_type"] == "revisit"
    block = head if revisit else head + payload
    fields = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", _urn(row["page_id"])), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if row["url"] is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in row["url"])))
    fields += [("WARC-Payload-Digest", f"sha1:{row['payload_digest']}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if revisit:
        fields += [("WARC-Refers-To", _urn(row["refers_to"])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def write_monolithic(rows: DataFrame, folder: str, roll_bytes: int = 64 << 20, level: int = 3) -> DataFrame:
    """Write classified rows as whole-file gzip streams of about roll_bytes of records; (archive) for each file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        fs.create_dir(root, recursive=True)
        made, out, packer, size, name = [], None, None, 0, ""
        for part in slices(batches, "payload"):
            for row in part.to_pylist():
                if out is None:
                    name = f"mono-{uuid.uuid4().hex}.warc.gz"
                    out, packer, size = fs.open_output_stream(f"{root}/{name}", compression=None), zlib.compressobj(level, wbits=31), 0
                data = record_bytes(row)
                out.write(packer.compress(data))
                size += len(data)
                if size >= roll_bytes:
                    out.write(packer.flush())
                    out.close()
                    made, out = [*made, f"{folder}/{name}"], None
        if out is not None:
            out.write(packer.flush())
            out.close()
            made.append(f"{folder}/{name}")
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string())], names=["archive"])

    return written(rows.mapInArrow(run, "archive string"), "archives")


class _Inflated:
    """The records' bytes of a gzip file (one member or many), inflated piece by piece."""

    def __init__(self, source):
        self.source, self.held, self.unpack = source, bytearray(), zlib.decompressobj(wbits=31)

    def more(self) -> bool:
        rest = self.unpack.unconsumed_tail
        if self.unpack.eof:
            rest, self.unpack = self.unpack.unused_data, zlib.decompressobj(wbits=31)
        rest = rest or self.source.read(_PIECE)
        if not rest:
            return False
        self.held += self.unpack.decompress(rest, 4 * _PIECE)
        return True

    def head(self) -> bytes | None:
        while (at := self.held.find(b"\r\n\r\n")) < 0:
            if not self.more():
                if self.held.strip():
                    raise ValueError("archive ends inside a record head")
                return None
        out = bytes(self.held[: at + 4])
        del self.held[: at + 4]
        return out

    def pieces(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("archive ends inside a record")
            out = bytes(self.held[:n])
            del self.held[: len(out)]
            n -= len(out)
            if out:
                yield out


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:] if line)}


def normalise(archives: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """(archive) of gzip files -> index rows of new archives with one member a record, and a sidecar `.idx` of each.

    Each file is one task's work and is streamed: memory does not depend on its size. An archive without records
    gives no rows; one that breaks off raises.
    """

    def one(path: str) -> list[dict]:
        fs, at = pafs.FileSystem.from_uri(path)
        to_fs, root = pafs.FileSystem.from_uri(folder)
        to_fs.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        rows, offset = [], 0
        with fs.open_input_stream(at, compression=None) as source, to_fs.open_output_stream(f"{root}/{name}", compression=None) as out:
            stream = _Inflated(source)
            while (head := stream.head()) is not None:
                fields, packer = _fields(head), zlib.compressobj(level, wbits=31)
                length = out.write(member) if (member := packer.compress(head)) else 0
                for piece in stream.pieces(int(fields["content-length"]) + 4):
                    if member := packer.compress(piece):
                        length += out.write(member)
                length += out.write(packer.flush())
                rows.append({"archive": f"{folder}/{name}", "offset": offset, "length": length, "record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"), "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None})
                offset += length
        with to_fs.open_output_stream(f"{root}/{name}.idx", compression=None) as out:
            out.write("".join(json.dumps(r) + "\n" for r in rows).encode())
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = one(path)
                for k in range(0, len(rows), 5000):
                    yield pa.RecordBatch.from_pylist(rows[k : k + 5000], schema=_INDEX)

    spread = archives.select("archive").repartition(max(1, min(archives.count(), 10_000)), "archive")
    return written(spread.mapInArrow(run, INDEX), "warc-index")


_INDEX = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string())])
_RECORD = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def parse_member(member: bytes) -> dict:
    """A record from its gzip member. Digest and size of a response come from the payload itself."""
    data = zlib.decompress(member, wbits=31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head + b"\r\n")
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    stated = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    digest = stated if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest != stated:
        raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
    size = int(_fields(http + b"\r\n")["content-length"]) if revisit else len(payload)
    return {"record_id": fields["warc-record-id"], "page_id": _page(fields["warc-record-id"]), "record_type": fields["warc-type"], "refers_to": _page(fields.get("warc-refers-to")), "url": fields.get("warc-target-uri"), "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": digest}


def read_indexed(index: DataFrame, payload: bool = True) -> DataFrame:
    """Records of index rows, each by one ranged read of its member; without payload the bytes are checked, not kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if archive != name:
                    fs, at = pafs.FileSystem.from_uri(archive)
                    name, source = archive, fs.open_input_file(at)
                row = parse_member(source.read_at(length, offset))
                if not payload:
                    row["payload"] = None
                rows.append(row)
                held += len(row["payload"] or b"")
                if held > 8 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                    rows, held = [], 0
            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return index.select("archive", "offset", "length").mapInArrow(run, RECORD)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_monolithic(classified(table(spark, sf_dir, "pages")), folder)
    index = normalise(archives, f"{folder}/normal")
    return read_indexed(index, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
