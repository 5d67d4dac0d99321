"""WARC records in ZIP-packaged archives: written stream-wise, read by ranges without extraction.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` (a gzip
member per record) and ``indexes/index.cdxj`` (a JSON line per record with its
offset and length). The reader finds the end record, the ZIP64 locator and
record where sizes need them, parses the central directory, takes each stored
member's place from its local header, and reads records by ranges of the file.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files
from .common import fresh_path, stored

ARCHIVE_BYTES = 256 << 20  # a writer starts another archive beyond this
MIN_REVISIT = 1000  # payloads below this many bytes are never revisits
WARC_NAME, INDEX_NAME = "archive/data.warc.gz", "indexes/index.cdxj"
U32 = 0xFFFFFFFF


class ZipStored:
    """Writes members one after the other without compression; sizes follow in the central directory and in data descriptors."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        self.entry = [raw, self.at, 0, 0]
        # bit 3: sizes follow the data; version 4.5 as descriptors are of 64 bits
        self._write(struct.pack("<4s5H3L2H", b"PK\3\4", 45, 8 | 0x800, 0, 0, 0x21, 0, U32, U32, len(raw), 20) + raw + struct.pack("<2H2Q", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self._write(data)
        self.entry[2] = zlib.crc32(data, self.entry[2])
        self.entry[3] += len(data)

    def end(self) -> None:
        _, _, crc, size = self.entry
        self._write(struct.pack("<4sL2Q", b"PK\7\10", crc, size, size))
        self.entries.append(self.entry)

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.entries:
            extra = b""
            big = self.zip64 or size >= U32 or at >= U32
            if big:
                extra = struct.pack("<2H3Q", 1, 24, size, size, at)
            shown = (U32, U32, U32) if big else (size, size, at)
            self._write(struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45, 8 | 0x800, 0, 0, 0x21, crc, shown[0], shown[1], len(raw), len(extra), 0, 0, 0, 0, shown[2]) + raw + extra)
        size, n = self.at - start, len(self.entries)
        if self.zip64 or start >= U32 or n >= 0xFFFF:
            where = self.at
            self._write(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start))
            self._write(struct.pack("<4sLQL", b"PK\6\7", 0, where, 1))
            n, size, start = 0xFFFF, U32, U32
        self._write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, n, n, size, start, 0))
        self.out.close()


class ZipReader:
    """Central directory of a ZIP or ZIP64 file, and ranges of its stored members."""

    def __init__(self, file):
        self.file, size = file, file.size()
        tail = files.read_range(file, max(0, size - 65557), min(size, 65557))
        at = tail.rfind(b"PK\5\6")
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(b"PK\5\6", 0, at)
        if at < 0:
            raise ValueError("no end of central directory")
        n, length, start = struct.unpack_from("<H2L", tail, at + 10)
        if (n == 0xFFFF or length == U32 or start == U32) and at >= 20 and tail[at - 20 : at - 16] == b"PK\6\7":
            where = struct.unpack_from("<Q", tail, at - 12)[0]
            end = files.read_range(file, where, 56)
            if end[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack_from("<3Q", end, 32)
        self.members: dict[str, tuple[int, int, int]] = {}
        raw, at = files.read_range(file, start, length), 0
        for _ in range(n):
            if raw[at : at + 4] != b"PK\1\2":
                raise ValueError("broken central directory")
            method = struct.unpack_from("<H", raw, at + 10)[0]
            packed, plain, name_n, extra_n, note_n = struct.unpack_from("<2L3H", raw, at + 20)
            offset = struct.unpack_from("<L", raw, at + 42)[0]
            name = raw[at + 46 : at + 46 + name_n].decode()
            x, stop = at + 46 + name_n, at + 46 + name_n + extra_n
            while x + 4 <= stop:
                kind, k = struct.unpack_from("<2H", raw, x)
                if kind == 1:  # 64-bit values, only of the fields that overflow, in this order
                    y = x + 4
                    if plain == U32:
                        plain, y = struct.unpack_from("<Q", raw, y)[0], y + 8
                    if packed == U32:
                        packed, y = struct.unpack_from("<Q", raw, y)[0], y + 8
                    if offset == U32:
                        offset = struct.unpack_from("<Q", raw, y)[0]
                x += 4 + k
            self.members[name] = (method, offset, packed)
            at = stop + note_n

    def locate(self, name: str) -> tuple[int, int]:
        """Place and size of a stored member's data in the file."""
        method, offset, size = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
        head = files.read_range(self.file, offset, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"{name} has no local header")
        name_n, extra_n = struct.unpack_from("<2H", head, 26)
        return offset + 30 + name_n + extra_n, size


def _text(value) -> str:
    """A header's value: without line ends."""
    return "" if value is None else " ".join(str(value).split())


def record(kind: str, name: str, uri, digest: str, body: bytes, refers: str | None) -> bytes:
    """One gzip member with one WARC record; ``body`` is the HTTP message."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{name}>", f"WARC-Target-URI: {_text(uri)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    if refers is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + pack.flush()


def parse_record(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers (lower-case names) and payload of one gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    warc = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    body = rest[: int(warc["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return warc, {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode().split("\r\n")[1:])}, payload


def plan_records(pages: DataFrame, key: str = "page_id", payload: str = "html") -> DataFrame:
    """(key, url, payload, size, digest, refers_to) of every row; refers_to is null for a response, payload for a revisit. Other columns are not read, whatever their names.

    Of equal payloads of MIN_REVISIT bytes or more the largest key is the
    response. Rows that repeat that key too are responses as well; rows of a null
    key revisit it, and are responses where every key of the group is null.
    """
    url = F.col("url") if "url" in pages.columns else F.lit(None).cast("string")
    data = pages.select(F.col(key).alias("key"), url.alias("url"), F.coalesce(F.encode(F.col(payload), "UTF-8"), F.lit(b"")).alias("payload"))
    data = data.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("long"))
    # counts and maxima of digests alone, partially aggregated before the shuffle: a hot payload is one row per task
    groups = data.filter(F.col("size") >= MIN_REVISIT).groupBy(F.col("digest").alias("twin")).agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("response"))
    repeated = groups.filter("n > 1 and response is not null").select("twin", "response")
    # a small payload has no twin, and rows of one (the empty one, say) are dealt by their keys
    twin = F.when(F.col("size") >= MIN_REVISIT, F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("key", "url").cast("string")))
    out = data.withColumn("twin", twin).join(repeated, "twin", "left")
    revisit = F.col("response").isNotNull() & (F.col("key").isNull() | (F.col("key") < F.col("response")))
    return out.select("key", "url", F.when(~revisit | F.col("response").isNull(), F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("response")).alias("refers_to"))


def write_archives(pages: DataFrame, key: str = "page_id", payload: str = "html", zip64: bool = False) -> DataFrame:
    """Write every row as a WARC record; returns the manifest (archive, records). A null ``url`` is empty, a null payload too; other columns are not read.

    Archives of a lost or repeated task stay unread: the manifest is a table, and names those of committed tasks.
    """
    folder = fresh_path(pages.sparkSession, "warc")

    def write(batches: Iterator[pa.RecordBatch]):
        state: dict = {}

        def close():
            z, lines, name = state.pop("zip"), state.pop("lines"), state.pop("name")
            z.end()
            z.begin(INDEX_NAME)
            for k in range(0, len(lines), 4096):
                z.write("".join(lines[k : k + 4096]).encode())
            z.end()
            z.close()
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(lines)], pa.int64())], names=["archive", "records"])

        for b in batches:
            for row_key, url, body, size, digest, refers in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if "zip" not in state:
                    state |= {"name": f"{folder}/{uuid.uuid4().hex}.wacz", "lines": [], "data": 0}
                    state["zip"] = ZipStored(files.create(state["name"]), zip64)
                    state["zip"].begin(WARC_NAME)
                kind = "response" if refers is None else "revisit"
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
                member = record(kind, "null" if row_key is None else str(row_key), url, digest, http + (body or b""), None if refers is None else str(refers))
                place = state["data"]
                state["lines"].append(json.dumps({"id": row_key, "type": kind, "digest": digest, "offset": place, "length": len(member)}) + "\n")
                state["zip"].write(member)
                state["data"] += len(member)
                if state["data"] >= ARCHIVE_BYTES:
                    yield close()
        if "zip" in state:
            yield close()

    return stored(plan_records(pages, key, payload).mapInArrow(write, "archive string, records long"), "warc-manifest")


def read_archive(path: str, step: int = 4 << 20) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Every indexed record of an archive, in order; neighbouring records share a range read of about ``step`` bytes."""
    with files.open_random(path) as f:
        z = ZipReader(f)
        start, size = z.locate(INDEX_NAME)
        data, _ = z.locate(WARC_NAME)
        rest, group = b"", []

        def fetch():
            first, last = group[0][0], group[-1][0] + group[-1][1]
            raw = files.read_range(f, data + first, last - first)
            return [parse_record(raw[a - first : a - first + n]) for a, n in group]

        for at in range(0, size, 1 << 20):
            lines = (rest + files.read_range(f, start + at, min(1 << 20, size - at))).split(b"\n")
            rest = lines.pop()
            for line in lines:
                x = json.loads(line)
                group.append((x["offset"], x["length"]))
                if group[-1][0] + group[-1][1] - group[0][0] >= step:
                    yield from fetch()
                    group = []
        if group:
            yield from fetch()


def read_archives(manifest: DataFrame, key: str = "page_id") -> DataFrame:
    """A row per record of the archives that ``manifest`` names: key, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Size and digest of a response are those of the payload that was read; a
    revisit has them from its headers, as no payload is stored with it.
    """
    import hashlib

    names = [key, "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]

    def name_of(value: str | None) -> int | None:
        value = value[len("<urn:x-page:") : -1] if value else "null"
        return None if value == "null" else int(value)

    def read(batches):
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0

                def out(rows):
                    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
                    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

                for warc, http, payload in read_archive(path):
                    revisit = warc["warc-type"] == "revisit"
                    size = int(http["content-length"]) if revisit else len(payload)
                    digest = warc["warc-payload-digest"].removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest()
                    rows.append((name_of(warc["warc-record-id"]), warc["warc-target-uri"], size, digest, warc["warc-type"], name_of(warc.get("warc-refers-to")) if revisit else None, None if revisit else payload))
                    held += len(payload)
                    if held >= 4 << 20 or len(rows) >= 4096:
                        yield out(rows)
                        rows, held = [], 0
                if rows:
                    yield out(rows)

    n = manifest.count()
    schema = f"{key} long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    return manifest.select("archive").repartition(max(1, n)).mapInArrow(read, schema)
