"""WARC archives as a Spark data source, in both directions, and revisit records for repeated payloads.

Each record is a gzip member of its own. Members written here name their length in the gzip extra field (subfield ``WL``), so a
reader can step over records it does not want without inflating them; foreign members and plain records are read as well.
"""

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, WriterCommitMessage)

from railtempo.session import checkpoint_root

SCHEMA = ("record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, "
          "payload binary")
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "refers_to": "warc-refers-to",
           "payload_digest": "warc-payload-digest"}
DATE = "2000-01-01T00:00:00Z"  # the tables have no crawl time, and equal input should give equal archives
CHUNK = 65_536
PRINTABLE = "".join(map(chr, range(33, 127)))


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_type: str, record_id: str | None, target_uri: str | None, refers_to: str | None, payload: bytes) -> bytes:
    """One WARC record. A revisit keeps the HTTP header and digest of its payload, but not the payload."""
    revisit = record_type == "revisit"
    block = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)) + (b"" if revisit else payload)
    lines = [("WARC-Type", record_type), ("WARC-Date", DATE)]
    if record_id is not None:
        lines.append(("WARC-Record-ID", f"<{record_id}>"))
    if target_uri is not None:
        lines.append(("WARC-Target-URI", quote(target_uri, safe=PRINTABLE)))
    if refers_to is not None:
        lines.append(("WARC-Refers-To", f"<{refers_to}>"))
    if revisit:
        lines.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    lines += [("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("Content-Type", "application/http; msgtype=response"),
              ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def gzip_member(data: bytes) -> bytes:
    deflate = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    length = 24 + len(body) + 8
    head = b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHQ", 12, b"WL", 8, length)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


class _Stream:
    """Bytes of one record from a place in a file: inflated for a gzip member, as they are for a plain record."""

    def __init__(self, file, at: int):
        self.file, self.at, self.length = file, at, None
        file.seek(at)
        first = file.read(CHUNK)
        self.gzip = first[:2] == b"\x1f\x8b"
        if self.gzip and first[3:4] == b"\x04" and first[12:14] == b"WL":
            self.length = struct.unpack("<Q", first[16:24])[0]
        self.inflate = zlib.decompressobj(31) if self.gzip else None
        self.consumed, self.data, self.ended = 0, bytearray(), not first
        self._take(first)

    def _take(self, raw: bytes) -> None:
        self.consumed += len(raw)
        if not raw:
            self.ended = True
        elif self.gzip:
            self.data += self.inflate.decompress(raw)
            if self.inflate.eof:
                self.ended, self.length = True, self.consumed - len(self.inflate.unused_data)
        else:
            self.data += raw

    def until(self, size: int) -> bytes:
        while len(self.data) < size and not self.ended:
            self._take(self.file.read(CHUNK))
        return bytes(self.data[:size])

    def find(self, mark: bytes) -> int:
        while (at := self.data.find(mark)) < 0 and not self.ended:
            self._take(self.file.read(CHUNK))
        return at

    def next(self, size: int) -> int:
        """Where the next record begins, given this one's size; a member of unknown length is inflated and dropped piece by piece."""
        if not self.gzip:
            return self.at + size
        while self.length is None and not self.ended:
            self.data.clear()
            self._take(self.file.read(CHUNK))
        return self.at + (self.length or self.consumed)


def read_records(file, size: int, wanted: dict[str, set] | None = None, payload: bool = True) -> Iterator[tuple]:
    """Rows of SCHEMA of one open archive. Headers first: records whose headers are not ``wanted`` are stepped over, and without
    ``payload`` no more than the HTTP header of a block is looked at."""
    at = 0
    while at < size:
        stream = _Stream(file, at)
        end = stream.find(b"\r\n\r\n")
        if end < 0:
            if stream.until(4).strip(b"\r\n\0"):
                raise ValueError(f"no record header at byte {at}")
            at = stream.next(max(1, len(stream.data)))
            continue
        version, *lines = bytes(stream.data[:end]).decode("utf-8", "replace").lstrip("\r\n").split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
        values = {c: headers.get(h) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            values[c] = values[c] and values[c].strip("<>")
        values["payload_digest"] = values["payload_digest"] and values["payload_digest"].rpartition(":")[2]
        length, begin = int(headers["content-length"]), end + 4
        if all(values[c] in allowed for c, allowed in (wanted or {}).items()):
            http, body = {}, 0
            if headers.get("content-type", "").startswith("application/http"):
                block = stream.until(begin + min(length, CHUNK))[begin:]
                cut = block.find(b"\r\n\r\n")
                if cut >= 0:
                    body = cut + 4
                    http = {k.strip().lower(): v.strip() for k, _, v in (
                        line.partition(":") for line in block[:cut].decode("latin-1").split("\r\n")[1:])}
            full = int(http["content-length"]) if values["record_type"] == "revisit" and "content-length" in http else length - body
            content = stream.until(begin + length)[begin + body:] if payload and values["record_type"] != "revisit" else None
            yield (*values.values(), full, content)
        at = stream.next(begin + length + 4)


@dataclass
class Archives(InputPartition):
    files: list


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcReader(DataSourceReader):
    """Plans files, packed to ``partition_bytes``; equality and membership on header columns are decided on the headers."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() != "false"
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.wanted: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            name = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if name in HEADERS and isinstance(f, (EqualTo, EqualNullSafe, In)):
                values = set(f.value) if isinstance(f, In) else {f.value}
                self.wanted[name] = self.wanted.get(name, values) & values
            elif not (name in HEADERS and isinstance(f, IsNotNull) and name in self.wanted and None not in self.wanted[name]):
                yield f

    def partitions(self) -> list[InputPartition]:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        found = sorted((i.path, i.size) for i in fs.get_file_info(pyarrow.fs.FileSelector(root, recursive=True)) if i.is_file and i.base_name[0] not in "._")
        packs, held = [], 0
        for path, size in found:
            if not packs or held + size > self.most:
                packs.append([])
                held = 0
            packs[-1].append((path, size))
            held += size
        return [Archives(p) for p in packs] or [Archives([])]

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        names = [*HEADERS, "payload_bytes", "payload"]
        types = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]
        rows, held = [], 0

        def batch():
            return pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

        for path, size in partition.files:
            with fs.open_input_file(path) as file:
                for row in read_records(file, size, self.wanted, self.payload):
                    rows.append(row)
                    held += len(row[-1] or b"") + 200
                    if held > 8 << 20:
                        yield batch()
                        rows, held = [], 0
        if rows:
            yield batch()


class WarcWriter(DataSourceArrowWriter):
    """Each task writes files under hidden names, of about ``roll_bytes``; the commit makes those of the tasks that succeeded visible."""

    def __init__(self, options: dict, names: list[str]):
        self.path, self.names, self.roll = options["path"], names, int(options.get("roll_bytes", 64 << 20))

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        files, out = [], None
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(self.names)}
            for i in range(batch.num_rows):
                if out is None:
                    files.append(f"{root}/_{uuid.uuid4().hex}.warc.gz")
                    out = fs.open_output_stream(files[-1], compression=None)
                out.write(gzip_member(record(*(columns[c][i].as_py() for c in ("record_type", "record_id", "target_uri", "refers_to")),
                                             columns["payload"][i].as_py() or b"")))
                if out.tell() > self.roll:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        fs, root = pyarrow.fs.FileSystem.from_uri(self.path)
        fs.create_dir(root, recursive=True)
        for number, file in enumerate(f for m in messages if m for f in m.files):
            fs.move(file, f"{root}/part-{number:05d}.warc.gz")

    def abort(self, messages: list) -> None:
        fs, _ = pyarrow.fs.FileSystem.from_uri(self.path)
        for file in (f for m in messages if m for f in m.files):
            fs.delete_file(file)


class Warc(DataSource):
    """``format("warc")``: options path, payload (false: leave payloads undecoded), partition_bytes, roll_bytes."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(dict(self.options), schema.names)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)


def with_revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, payload, record_type, refers_to): of pages with equal payloads of at least ``least`` bytes that with the largest
    page_id is the response and the others revisit it. Null html is an empty payload. Pages without id are responses, and
    so are rows that repeat the largest id. Only digests are grouped; a hot payload is split by adaptive execution."""
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("_sha1", F.sha1("payload"))
    # payloads seen once need no partner, so only repeated ones are looked up
    first = rows.filter(F.octet_length("payload") >= least).groupBy("_sha1").agg(
        F.max("page_id").alias("_first"), F.count("page_id").alias("_n")).filter("_n > 1").drop("_n")
    revisits = F.coalesce((F.col("page_id") < F.col("_first")) & (F.octet_length("payload") >= least), F.lit(False))
    return rows.join(first, "_sha1", "left").select(
        "page_id", "url", "payload", F.when(revisits, "revisit").otherwise("response").alias("record_type"),
        F.when(revisits, F.col("_first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, least: int = 0) -> None:
    """A record per row of ``pages`` into archives under ``path``; record ids are ``urn:page:`` and the page_id."""
    register(pages.sparkSession)
    urn = F.lit("urn:page:")
    with_revisits(pages, least).select(
        "record_type", F.concat(urn, F.col("page_id").cast("string")).alias("record_id"), F.col("url").alias("target_uri"),
        F.concat(urn, F.col("refers_to").cast("string")).alias("refers_to"), "payload",
    ).write.format("warc").mode("append").option("path", path).save()


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Rows of SCHEMA; filters on header columns reach the reader."""
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def base32_sha1(data: str) -> Column:
    """Bare upper-case base32 of a binary column's SHA-1: five hex digits are four letters."""
    part = f"cast(conv(substring(sha1({data}), 5 * (i div 4) + 1, 5), 16, 10) as int)"
    letter = f"substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (shiftright({part}, 15 - 5 * (i % 4)) & 31) + 1, 1)"
    return F.expr(f"if({data} is null, null, array_join(transform(sequence(0, 31), i -> {letter}), ''))")


def with_payload_facts(records: DataFrame) -> DataFrame:
    """``payload_bytes`` and ``payload_digest`` of the decoded payload in place of the headers'; revisits carry no payload and keep what their
    headers say. ``intact`` says whether the payload matches its header's digest (null without either)."""
    own = records.withColumn("_own", base32_sha1("payload"))
    return own.withColumns({
        "intact": F.col("_own") == F.col("payload_digest"), "payload_bytes": F.coalesce(F.octet_length("payload").cast("bigint"), "payload_bytes"),
        "payload_digest": F.coalesce("_own", "payload_digest")}).drop("_own")


def round_trip(pages: DataFrame, least: int = 0, folder: str | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, intact), read back with the payloads of responses from archives
    written to the shared folder."""
    spark = pages.sparkSession
    path = f"{folder or checkpoint_root(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, least)
    number = "cast(substring({0}, length('urn:page:') + 1) as bigint) as {1}"
    return with_payload_facts(read_archives(spark, path)).selectExpr(
        number.format("record_id", "page_id"), "payload_bytes", "payload_digest", "record_type", number.format("refers_to", "refers_to"), "intact")
