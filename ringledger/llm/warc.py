"""Operator 1, WARC records in ZIP packages: writing, and reading by ranges without unpacking.

A package is a ZIP file with stored (uncompressed) members, as web archive packages are: archive/data.warc.gz with one
gzip member a record, indexes/index.cdxj with a JSON line a record (offset and length within the archive member), and
datapackage.json. The reader parses the end record, the ZIP64 locator and end record and the central directory, finds
the index and the archive, and reads each record by its range.

Of records with equal payloads of at least `revisit_from` bytes, that with the smallest page id is a response and the
others are revisits of it, without payload.

Decisions need digests only. A payload that a thousandth of all rows hold (a thousand payloads at most) is decided by
broadcast, so that its copies are dropped before anything is shuffled by digest; its rows are spread.

The manifest says where each block of the index begins, so that a reader takes its own lines only.

Packages are written by the executors straight into shared storage (a file: folder that all share, or any store that
pyarrow.fs opens); a failed attempt leaves a file that no manifest row names.

Defined cases: a null html is an empty payload; a null url is named after the page; rows that share the smallest id of
their payload are all responses; a row without an id is a revisit if any row with an id has its payload, else a
response; other columns are ignored; no rows give no packages and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import io
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote, unquote, urlparse

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringledger.llm.common import shared_dir, stored

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
WARC, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string, offset long, length long"
#: Records that one task reads at a time.
BLOCK = 2000


# ---------------------------------------------------------------- storage


def local_path(path: str) -> str | None:
    parsed = urlparse(path)
    return unquote(parsed.path) if parsed.scheme in ("", "file") else None


def open_out(path: str):
    local = local_path(path)
    if local is not None:
        Path(local).parent.mkdir(parents=True, exist_ok=True)
        return open(local, "wb")
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(path)
    store.create_dir(name.rpartition("/")[0], recursive=True)
    return store.open_output_stream(name)


class Ranges:
    """Reads ranges of a stored file."""

    def __init__(self, path: str) -> None:
        local = local_path(path)
        if local is not None:
            self.file = open(local, "rb")
            self.size = self.file.seek(0, io.SEEK_END)
        else:
            from pyarrow import fs

            store, name = fs.FileSystem.from_uri(path)
            self.file = store.open_input_file(name)
            self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        out = self.file.read(length)
        if len(out) != length:
            raise ValueError(f"{length} bytes at {offset}: got {len(out)}")
        return out

    def __enter__(self) -> Ranges:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()


# ---------------------------------------------------------------- ZIP directories


def end_of_directory(source: Ranges) -> tuple[int, int, int]:
    """Offset, size and number of entries of the central directory, ZIP64 or not."""
    tail_size = min(source.size, 22 + 65_535)
    tail = source.read(source.size - tail_size, tail_size)
    at = tail.rfind(b"PK\x05\x06")
    while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    count, size, offset = struct.unpack_from("<HII", tail, at + 10)
    place = source.size - tail_size + at
    if 0xFFFF == count or 0xFFFFFFFF in (size, offset):
        locator = source.read(place - 20, 20)
        if locator[:4] != b"PK\x06\x07":
            raise ValueError("no ZIP64 locator")
        record = source.read(struct.unpack_from("<Q", locator, 8)[0], 56)
        if record[:4] != b"PK\x06\x06":
            raise ValueError("no ZIP64 end of central directory")
        count, size, offset = struct.unpack_from("<QQQ", record, 32)
    return offset, size, count


def directory(source: Ranges) -> dict[str, tuple[int, int]]:
    """Where each stored member's header is, and its size. Compressed members can't be read by ranges and are left out."""
    offset, size, count = end_of_directory(source)
    data, at, out = source.read(offset, size), 0, {}
    for _ in range(count):
        if data[at : at + 4] != b"PK\x01\x02":
            raise ValueError("broken central directory")
        flags, method = struct.unpack_from("<HH", data, at + 8)
        packed, plain, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", data, at + 20)
        header = struct.unpack_from("<I", data, at + 42)[0]
        raw = data[at + 46 : at + 46 + n_name]
        extra, end = at + 46 + n_name, at + 46 + n_name + n_extra
        while extra + 4 <= end:
            kind, length = struct.unpack_from("<HH", data, extra)
            if kind == 1:  # ZIP64: only those of the four fields that are full, in this order
                field = extra + 4
                if plain == 0xFFFFFFFF:
                    plain, field = struct.unpack_from("<Q", data, field)[0], field + 8
                if packed == 0xFFFFFFFF:
                    packed, field = struct.unpack_from("<Q", data, field)[0], field + 8
                if header == 0xFFFFFFFF:
                    header = struct.unpack_from("<Q", data, field)[0]
            extra += 4 + length
        if method == 0 and not flags & 1:
            out[raw.decode("utf-8" if flags & 0x800 else "cp437")] = (header, packed)
        at = end + n_comment
    return out


def member_start(source: Ranges, header: int) -> int:
    head = source.read(header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("broken local header")
    n_name, n_extra = struct.unpack_from("<HH", head, 26)
    return header + 30 + n_name + n_extra


# ---------------------------------------------------------------- records


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(name: str) -> int | None:
    value = name[len("<urn:x-page:") : -1]
    return None if value == "none" else int(value)


def b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + (payload or b"")
    uri = quote(url, safe="%/:=&?~#+!$,;'@()*[]") if url is not None else f"urn:x-page:{'none' if page_id is None else page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a gzip member."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not re.fullmatch(r"WARC/1\.\d", lines[0]):
        raise ValueError("no WARC record")
    warc = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(warc["content-length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("record of another length than it says")
    http_head, _, payload = block.partition(b"\r\n\r\n")
    http = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http_head.decode().split("\r\n")[1:])}
    return warc, http, payload


def gzip_member(data: bytes, level: int) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


# ---------------------------------------------------------------- writing


class Package:
    """One ZIP package under construction."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        self.out = open_out(self.path)
        self.zip = zipfile.ZipFile(self.out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.member = self.zip.open(zipfile.ZipInfo(WARC), "w", force_zip64=True)
        self.index: list[bytes] = []
        self.marks, self.size = [0], 0
        self.at = 0

    def add(self, record: bytes, entry: dict) -> None:
        self.member.write(record)
        self.index.append(json.dumps(entry | {"offset": self.at, "length": len(record)}).encode() + b"\n")
        self.size += len(self.index[-1])
        self.at += len(record)
        if len(self.index) % BLOCK == 0:
            self.marks.append(self.size)

    def close(self) -> tuple[str, int, list[int]]:
        self.member.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), b"".join(self.index))
        about = {"profile": "data-package", "resources": [{"path": WARC, "bytes": self.at}, {"path": INDEX, "records": len(self.index)}]}
        self.zip.writestr(zipfile.ZipInfo("datapackage.json"), json.dumps(about))
        self.zip.close()
        self.out.close()
        return self.path, len(self.index), self.marks if self.marks[-1] == self.size else [*self.marks, self.size]


def write(pages: DataFrame, folder: str, revisit_from: int = 0, package_mb: float = 64.0, level: int = 6, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes packages below `folder`; gives their manifest: path, records, marks (offsets of the index's blocks and its size)."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"), F.octet_length(payload).cast("long").alias("size"))
    firsts = rows.filter(F.col("size") >= revisit_from).groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null")
    firsts = stored(firsts.select(F.col("digest").alias("_digest"), F.col("size").alias("_size"), "first", "n"))
    most = F.col("n") * 1000 >= pages.count()
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    slim = ("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "digest", "size")
    rows = rows.join(F.broadcast(firsts.filter(most).drop("n")), (F.col("digest") == F.col("_digest")) & (F.col("size") == F.col("_size")), "left")
    rows = rows.select(*slim, F.col("first").alias("hot"))
    key = F.when(F.col("hot").isNotNull(), F.xxhash64("page_id", "url").cast("string")).otherwise(F.col("digest"))
    rows = rows.join(firsts.filter(~most).drop("n"), (key == F.col("_digest")) & (F.col("size") == F.col("_size")), "left").withColumn("first", F.coalesce("hot", "first"))
    rows = rows.select(*slim, F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        package, made = None, []
        for batch in batches:
            for row in batch.to_pylist():
                package = package or Package(folder)
                digest = b32(row["digest"])
                record = make_record(row["page_id"], row["url"], row["payload"], row["size"], digest, row["refers_to"], row["revisit"])
                package.add(gzip_member(record, level), {"url": row["url"], "digest": f"sha1:{digest}", "type": "revisit" if row["revisit"] else "response"})
                if package.at >= package_mb * 1e6:
                    made.append(package.close())
                    package = None
        if package:
            made.append(package.close())
        yield pa.record_batch([pa.array([x[i] for x in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.list_(pa.int64())))], names=["path", "records", "marks"])

    return stored(rows.mapInArrow(run, "path string, records long, marks array<long>"))


# ---------------------------------------------------------------- reading


def read_block(source: Ranges, first: int, last: int) -> Iterator[dict]:
    """The records that the bytes first to last - 1 of a package's index name, each read by its range."""
    members = directory(source)
    (index_header, index_size), (warc_header, warc_size) = members[INDEX], members[WARC]
    if last > index_size:
        raise ValueError("block outside of the index")
    index = source.read(member_start(source, index_header) + first, last - first).split(b"\n")
    begin = member_start(source, warc_header)
    for line in index:
        if not line:
            continue
        entry = json.loads(line)
        if entry["offset"] + entry["length"] > warc_size:
            raise ValueError("index entry outside of the archive")
        warc, http, payload = parse_record(source.read(begin + entry["offset"], entry["length"]))
        digest = warc["warc-payload-digest"].removeprefix("sha1:")
        is_response = warc["warc-type"] == "response"
        if is_response and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError(f"payload of {warc['warc-record-id']} doesn't have its digest")
        yield {
            "page_id": page_of(warc["warc-record-id"]), "url": entry["url"], "record_type": warc["warc-type"],
            "refers_to": None if is_response else page_of(warc["warc-refers-to"]), "payload": payload if is_response else None,
            "payload_bytes": len(payload) if is_response else int(http["content-length"]), "payload_digest": digest,
            "offset": entry["offset"], "length": entry["length"],
        }


SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def read(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the packages in a manifest (path, records, marks), a block of records a row of work."""
    ends = F.arrays_zip(F.col("marks").alias("first"), F.slice("marks", F.lit(2), F.size("marks")).alias("last"))
    blocks = manifest.filter("records > 0").select("path", F.explode(F.filter(ends, lambda x: x["last"].isNotNull())).alias("block")).select("path", "block.first", "block.last")
    spread = max(1, int(manifest.agg(F.sum(F.ceil(F.col("records") / BLOCK))).first()[0] or 1))
    blocks = blocks.repartition(min(spread, 100_000))
    keep = [f.name for f in SCHEMA if payloads or f.name != "payload"]
    ddl = ", ".join(x for x in RECORDS.split(", ") if x.split()[0] in keep)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                with Ranges(row["path"]) as source:
                    held, size = [], 0
                    for record in read_block(source, row["first"], row["last"]):
                        held.append(record)
                        size += len(record["payload"] or b"")
                        if size > 16e6:
                            yield pa.RecordBatch.from_pylist(held, SCHEMA).select(keep)
                            held, size = [], 0
                    yield pa.RecordBatch.from_pylist(held, SCHEMA).select(keep)

    return blocks.mapInArrow(run, ddl)


def package_folder(pages: DataFrame) -> str:
    return f"{shared_dir(pages.sparkSession)}-warc"
