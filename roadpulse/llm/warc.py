"""WARC archives as a Spark data source.

Write: one gzip member per record, whose header names its own compressed length, so that a
reader can leap over a record. Read: a partition plan over the archive files; filters on
record type, target URI and record id are pushed into the reader, which inflates a record's
headers first and leaves the payloads of unwanted records alone. Archives of others are read too:
plain ones and gzip members of one or many records. Cut or damaged archives raise ValueError.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, WriterCommitMessage

from roadpulse.llm.common import new_path, stored

SCHEMA = "record_id string, record_type string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
WRITTEN = "page_id long, url string, payload binary, digest string, revisits long"
MANIFEST = "_manifest"
#: An archive file is closed beyond this many bytes.
FILE_BYTES = 256 << 20
#: Digests that several pages have are sent to every executor up to this number.
FEW_DIGESTS = 200_000
#: Bytes of a block that are read where its payload isn't wanted.
HEAD_BYTES = 1 << 16
#: Rows in a batch that a reader yields, and payload bytes after which it yields a smaller one.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20
PUSHED = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id"}


def _place(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(record: bytes) -> bytes:
    """``record`` as a gzip member whose extra field ``sl`` has its whole and its inflated length."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = deflate.compress(record) + deflate.flush()
    whole = 12 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + struct.pack("<IBB", 0, 0, 255) + struct.pack("<H", 12)
    return head + b"sl" + struct.pack("<HII", 8, whole, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def page_record(page_id, url, payload: bytes, digest: str, revisits, date: str) -> bytes:
    """The record of a page: a response, or a revisit without payload whose HTTP headers keep its length."""
    clean = "".join((url or "").split())  # a header holds no line breaks
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", date), ("WARC-Target-URI", clean), ("Content-Type", "application/http;msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if revisits is None:
        return record("response", headers, http + payload)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{revisits}>")]
    return record("revisit", headers, http)


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files of its own; only those that a commit's manifest lists count."""

    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.date, self.overwrite = options["path"], options.get("date", "1970-01-01T00:00:00Z"), overwrite

    def write(self, iterator) -> Written:
        files, out, size = [], None, 0
        where, base = _place(self.path)
        where.create_dir(base, recursive=True)
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None or size > FILE_BYTES:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = where.open_output_stream(f"{base}/{files[-1]}", compression=None), 0
                data = member(page_record(row["page_id"], row["url"], row["payload"] or b"", row["digest"], row["revisits"], self.date))
                out.write(data)
                size += len(data)
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages) -> None:
        where, base = _place(self.path)
        where.create_dir(base, recursive=True)
        old = manifests(where, base) if self.overwrite else []
        with where.open_output_stream(f"{base}/{MANIFEST}-{uuid.uuid4().hex}.json", compression=None) as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())
        for name in old:
            where.delete_file(name)

    def abort(self, messages) -> None:
        where, base = _place(self.path)
        for name in (x for m in messages if m for x in m.files):
            where.delete_file(f"{base}/{name}")


@dataclass
class Archive(InputPartition):
    file: str


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payloads = options.get("payloads", "true") == "true"
        self.verify = options.get("verify", "false") == "true"
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters):
        for f in filters:
            name = PUSHED.get(f.attribute[0]) if isinstance(f, (EqualTo, In)) and len(f.attribute) == 1 else None
            if name is None:
                yield f
            else:
                values = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.wanted[name] = self.wanted.get(name, values) & values

    def partitions(self):
        from pyarrow import fs

        where, base = _place(self.path)
        told = manifests(where, base)
        if told:
            names = []
            for name in told:
                with where.open_input_file(name) as f:
                    names += [f"{base}/{x}" for x in json.loads(f.read())]
        else:
            names = sorted(x.path for x in where.get_file_info(fs.FileSelector(base)) if x.path.endswith((".warc", ".warc.gz")))
        return [Archive(x) for x in names] or [Archive("")]

    def read(self, partition: Archive):
        rows, size = [], 0
        schema = pa.schema([(c.split()[0], {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in SCHEMA.split(", ")])
        batch = lambda: pa.RecordBatch.from_pylist(rows, schema)
        if partition.file:
            where, _ = _place(self.path)
            with where.open_input_file(partition.file) as f:
                for head, block in scan(f, self.wanted, self.payloads or self.verify):
                    rows.append(self.row(head, block))
                    size += len(rows[-1]["payload"] or b"")
                    if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
                        yield batch()
                        rows, size = [], 0
        yield batch()

    def row(self, head: dict, block: bytes) -> dict:
        http, _, payload = block.partition(b"\r\n\r\n") if "http" in head.get("content-type", "") else (b"", b"", block)
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
        if head["warc-type"] == "revisit":
            length = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
            payload = None
        else:
            length = _length(head) - (len(http) + 4 if http else 0)
            if self.verify and digest != base32_sha1(payload):
                raise ValueError(f"payload of {head.get('warc-record-id')} doesn't have the digest in its header")
        return {
            "record_id": head.get("warc-record-id"), "record_type": head["warc-type"], "target_uri": head.get("warc-target-uri"), "date": head.get("warc-date"),
            "refers_to": head.get("warc-refers-to"), "payload_digest": digest, "payload_bytes": length, "payload": payload if self.payloads else None,
        }


def manifests(where, base: str) -> list[str]:
    """The manifests of all commits to a folder; a folder of archives by others has none."""
    from pyarrow import fs

    found = where.get_file_info(fs.FileSelector(base, allow_not_found=True))
    return sorted(x.path for x in found if x.base_name.startswith(MANIFEST) and x.base_name.endswith(".json"))


def _headers(text: bytes) -> dict:
    lines = text.decode(errors="replace").strip().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"a record begins with {lines[0][:40]!r}")
    pairs = (x.partition(":") for x in lines[1:])
    return {"warc-type": "", **{k.strip().lower(): v.strip() for k, _, v in pairs}}


def _length(head: dict) -> int:
    said = head.get("content-length", "")
    if not said.isdigit():
        raise ValueError(f"record {head.get('warc-record-id')} has no length")
    return int(said)


def _wanted(head: dict, wanted: dict) -> bool:
    return all(head.get(k) in v for k, v in wanted.items())


class Inflated:
    """The inflated bytes of the gzip member at ``at`` of an open file, in pieces."""

    def __init__(self, f, at: int):
        f.seek(at)
        self.file, self.at, self.fed, self.inflate, self.ready = f, at, 0, zlib.decompressobj(31), b""

    def more(self) -> bool:
        if self.inflate.eof:
            return False
        data = self.inflate.unconsumed_tail
        if not data:
            data = self.file.read(1 << 16)
            self.fed += len(data)
            if not data:
                raise ValueError(f"the archive ends inside the member at {self.at}")
        try:
            self.ready += self.inflate.decompress(data, 1 << 18)
        except zlib.error as error:
            raise ValueError(f"the member at {self.at} is damaged: {error}") from error
        return True

    def head(self) -> bytes | None:
        """All up to the next blank line, which is passed; None at the member's end."""
        while (end := self.ready.find(b"\r\n\r\n", len(self.ready) - len(self.ready.lstrip()))) < 0:
            if not self.more():
                if self.ready.strip():
                    raise ValueError(f"a record's header is cut in the member at {self.at}")
                return None
        out, self.ready = self.ready[:end], self.ready[end + 4 :]
        return out

    def take(self, n: int, keep: int) -> bytes:
        """Passes ``n`` bytes and gives the first ``keep`` of them."""
        parts, left, room = [], n, keep
        while left:
            if not self.ready and not self.more():
                raise ValueError(f"a record is cut in the member at {self.at}")
            part, self.ready = self.ready[:left], self.ready[left:]
            left -= len(part)
            if room:
                parts.append(part[:room])
                room -= len(parts[-1])
        return b"".join(parts)

    def end(self) -> int:
        """Where the next member begins."""
        while self.more():
            self.ready = b""
        return self.at + self.fed - len(self.inflate.unused_data)


def scan(f, wanted: dict, payloads: bool = True):
    """(headers, block) of each wanted record of an open archive file, compressed or not.

    Without ``payloads`` a block's first HEAD_BYTES are enough, and a record whose member tells
    its length is left there.
    """
    size, at = f.size(), 0
    while at < size:
        f.seek(at)
        lead = f.read(20)
        if lead[:2] != b"\x1f\x8b":
            at = yield from _plain(f, at, size, wanted, payloads)
            continue
        whole = struct.unpack("<I", lead[16:20])[0] if len(lead) == 20 and lead[3] & 4 and lead[12:14] == b"sl" else 0
        if at + whole > size:
            raise ValueError(f"the archive ends inside the member at {at}")
        stream = Inflated(f, at)
        while (text := stream.head()) is not None:
            head = _headers(text)
            good = _wanted(head, wanted)
            leap = whole and not (good and payloads)  # a member that tells its length has one record
            keep = 0 if not good else _length(head) if payloads else HEAD_BYTES
            n = _length(head) if not leap else min(keep, _length(head))
            block = stream.take(n, keep)
            if good:
                yield head, block
            if leap:
                break
        at = at + whole if whole else stream.end()


def _plain(f, at: int, size: int, wanted: dict, payloads: bool):
    """Yields the uncompressed record at ``at`` if it is wanted; returns where the next begins."""
    f.seek(at)
    text = b""
    while (end := text.find(b"\r\n\r\n", len(text) - len(text.lstrip()))) < 0:
        more = f.read(4096)
        if not more:
            if text.strip():
                raise ValueError(f"the archive ends inside the header at {at}")
            return size
        text += more
    head = _headers(text[:end])
    start, n = at + end + 4, _length(head)
    if start + n > size:
        raise ValueError(f"the archive ends inside the record at {at}")
    if _wanted(head, wanted):
        f.seek(start)
        yield head, f.read(n if payloads else min(n, HEAD_BYTES))
    return start + n


class WarcDataSource(DataSource):
    """``spark.read.format("warc").load(folder)`` and ``df.write.format("warc").save(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def read_warc(spark: SparkSession, path: str, **options) -> DataFrame:
    """The records of all archives in ``path``; filters on type, URI and id reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)
    return spark.read.format("warc").options(**options).load(path)


def base32(sha1_hex):
    """The base32 form of a SHA-1 in hexadecimal: 20 bits, five digits, at a time."""
    quads = (F.lpad(F.conv(F.substring(sha1_hex, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8))
    return F.translate(F.concat(*quads), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write_pages(pages: DataFrame, path: str, least_bytes: int = 0, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a record per page to archives in ``path``, beside what is there.

    Of pages with equal payloads of ``least_bytes`` or more, the one with the smallest id is a
    response and the others revisit it. A null html is an empty payload; a page without id is
    a response unless another has its payload; rows that repeat an id each get a record of that
    id, and those with the smallest id of their payload are all responses; other columns are
    ignored. Only ids and digests are grouped: payloads stay where they are read, or, beside a
    long list of revisits, are dealt by page.
    """
    spark = pages.sparkSession
    spark.dataSource.register(WarcDataSource)
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.encode(F.coalesce(F.col(html), F.lit("")), "utf-8").alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    same = rows.where(F.octet_length("payload") >= least_bytes).groupBy("sha1").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    same = stored(same, "same-payloads")
    if same.count() <= FEW_DIGESTS:
        told = rows.join(F.broadcast(same), "sha1", "left")
    else:
        rows = rows.withColumn("at", F.coalesce("page_id", F.xxhash64("url", "sha1")))
        told = rows.join(rows.select("at", "sha1").distinct().join(same, "sha1"), ["at", "sha1"], "left")
    told.select("page_id", "url", "payload", base32(F.col("sha1")).alias("digest"), F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("revisits")).write.format("warc").mode("append").save(path)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads what they say of each page."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_pages(pages, path)
    back = read_warc(spark, path, payloads="false", verify="true").where(F.col("record_type").isin("response", "revisit"))
    number = lambda c: F.regexp_extract(F.col(c), "urn:page:(-?\\d+)", 1).try_cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
