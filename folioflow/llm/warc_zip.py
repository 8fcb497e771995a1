"""WARC records in ZIP archives, written and range-read without extraction (operator 2).

An archive is a ZIP file of stored members: ``archive/data.warc`` (the records)
and ``indexes/index.tsv`` (offset and length of each record). Sizes and offsets
use ZIP64 fields. Reading parses the end record, the ZIP64 end record if the
first one says so, the central directory and the local headers; the index then
gives the byte range of each record in the archive file, and only those ranges
are read. Archives of others are read alike: any stored members with the endings
``.warc`` or ``.warc.gz`` (a gzip member for each record), located by this index or
by CDXJ lines, and walked from record to record where no index names them.

Tasks write archives under names of their own attempt and report them; only
reported archives count, so a lost or repeated task leaves no record twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zlib
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioflow.llm.common import in_worker, open_for_read, open_for_write, partitions, quoted, scratch, staged, task_id

#: Equal payloads from this size on are stored once.
LEAST_SHARED = 1_000
#: Bytes of records after which a task begins another archive.
ARCHIVE = 32 << 20

#: Bytes that are read at once where records are walked.
STEP = 1 << 18
#: Groups of copies up to this number (some 60 bytes each) are broadcast.
BROADCAST_ROWS = 500_000

# Signatures and layouts of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
LOCAL_F, CENTRAL_F, END_F, END64_F, LOCATOR64_F = "<4s5H3I2H", "<4s6H3I5H2I", "<4s4H2IH", "<4sQ2H2I4Q", "<4sIQI"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
GZIP = b"\x1f\x8b"


# ---------------------------------------------------------------- ZIP


def write_zip(out, members: list[tuple[str, bytes]]) -> list[int]:
    """Stored members with ZIP64 fields; gives the offsets of their data."""
    at, starts, central = 0, [], b""
    for name, data in members:
        label, crc = name.encode(), zlib.crc32(data)
        extra = struct.pack("<2H2Q", 1, 16, len(data), len(data))
        head = struct.pack(LOCAL_F, LOCAL, 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32, len(label), len(extra)) + label + extra
        out.write(head)
        out.write(data)
        extra = struct.pack("<2H3Q", 1, 24, len(data), len(data), at)
        central += struct.pack(CENTRAL_F, CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc, FULL32, FULL32, len(label), len(extra), 0, 0, 0, 0, FULL32) + label + extra
        starts.append(at + len(head))
        at += len(head) + len(data)
    n = len(members)
    out.write(central + struct.pack(END64_F, END64, 44, 45, 45, 0, 0, n, n, len(central), at) + struct.pack(LOCATOR64_F, LOCATOR64, 0, at + len(central), 1) + struct.pack(END_F, END, 0, 0, FULL16, FULL16, FULL32, FULL32, 0))
    return starts


def central_directory(f, size: int) -> dict[str, tuple[int, int, int, int]]:
    """name -> (method, compressed size, size, offset of the local header) of an archive of ``size`` bytes."""
    tail = min(size, 22 + FULL16)
    f.seek(size - tail)
    data = f.read(tail)
    at = data.rfind(END)
    while at >= 0 and (at + 22 > len(data) or at + 22 + struct.unpack_from("<H", data, at + 20)[0] != len(data)):  # the signature may stand in the comment
        at = data.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    _, _, _, _, n, length, start, _ = struct.unpack_from(END_F, data, at)
    if FULL16 == n or FULL32 in (length, start):
        f.seek(size - tail + at - 20)
        mark, _, where, _ = struct.unpack(LOCATOR64_F, f.read(20))
        if mark == LOCATOR64:
            f.seek(where)
            mark, *_, n, length, start = struct.unpack(END64_F, f.read(56))
            if mark != END64:
                raise ValueError("no ZIP64 end of central directory")
    f.seek(start)
    data, at, out = f.read(length), 0, {}
    for _ in range(n):
        mark, _, _, flags, method, _, _, _, packed, plain, k, extra, comment, _, _, _, where = struct.unpack_from(CENTRAL_F, data, at)
        if mark != CENTRAL:
            raise ValueError("bad central directory")
        name = data[at + 46 : at + 46 + k].decode("utf-8" if flags & 0x800 else "cp437")
        i, end = at + 46 + k, at + 46 + k + extra
        while i + 4 <= end:
            tag, span = struct.unpack_from("<2H", data, i)
            if tag == 1:  # the fields that are full above, in this order
                long = list(struct.unpack_from(f"<{span // 8}Q", data, i + 4))
                plain = long.pop(0) if plain == FULL32 else plain
                packed = long.pop(0) if packed == FULL32 else packed
                where = long.pop(0) if where == FULL32 else where
            i += 4 + span
        out[name] = (method, packed, plain, where)
        at = end + comment
    return out


def member_start(f, where: int) -> int:
    """Offset of a member's data behind its local header."""
    f.seek(where)
    head = struct.unpack(LOCAL_F, f.read(30))
    if head[0] != LOCAL:
        raise ValueError("bad local header")
    return where + 30 + head[-2] + head[-1]


# ---------------------------------------------------------------- WARC


def _urn(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, sha1: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit (payload None) of the response of page ``refers_to``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = {"WARC-Type": "revisit" if payload is None else "response", "WARC-Record-ID": _urn(page_id), "WARC-Date": "2024-01-01T00:00:00Z"}
    if page_id is not None:
        fields["X-Page-Id"] = str(page_id)
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe="!#$&'()*+,/:;=?@[]~")
    fields |= {"WARC-Payload-Digest": "sha1:" + base64.b32encode(bytes.fromhex(sha1)).decode(), "X-Payload-Length": str(size)}
    if payload is None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": _urn(refers_to), "X-Refers-To-Page": str(refers_to)}
    fields |= {"Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    return "\r\n".join(["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items())]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_fields(head: bytes) -> dict[str, str]:
    """The header of a record: names in lower case, white space around values and folded lines taken away."""
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    out, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
            continue
        name, _, value = line.partition(":")
        last = name.strip().lower()
        out[last] = value.strip()
    return out


def parse_record(data: bytes) -> dict:
    """Fields of one record (gzipped or not), its payload checked against its digest where that is a SHA-1. What a record does not say is null, its payload's size and digest come from the payload."""
    if data[:2] == GZIP:
        data = zlib.decompress(data, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = record_fields(head)
    block, kind = rest[: int(fields["content-length"])], fields["warc-type"]
    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
    name, _, stated = fields.get("warc-payload-digest", "").partition(":")
    sha1 = None
    if name.lower() == "sha1":
        sha1 = stated.lower() if len(stated) == 40 else base64.b32decode(stated.upper()).hex()
    whole = lambda k: int(fields[k]) if k in fields else None
    size = whole("x-payload-length")
    if payload is not None:
        own = hashlib.sha1(payload).hexdigest()
        if sha1 not in (None, own) or size not in (None, len(payload)):
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not match its digest")
        sha1, size = own, len(payload)
    return {"page_id": whole("x-page-id"), "url": unquote(fields["warc-target-uri"].strip("<>")) if "warc-target-uri" in fields else None, "payload_bytes": size, "payload_digest": sha1, "record_type": kind, "refers_to": whole("x-refers-to-page"), "payload": payload}


def walk_records(f, start: int, size: int, gzipped: bool):
    """Offset and length of each record of a member that no index names: headers are read, blocks are passed over; gzip members are read to their ends."""
    at, end = start, start + size
    while at < end:
        f.seek(at)
        if gzipped:
            unpress, length = zlib.decompressobj(31), 0
            while not unpress.eof:
                chunk = f.read(min(STEP, end - at - length))
                if not chunk:
                    raise ValueError("a record ends with its member")
                unpress.decompress(chunk)
                length += len(chunk) - len(unpress.unused_data)
        else:
            head = b""
            while (cut := head.find(b"\r\n\r\n")) < 0:
                chunk = f.read(min(4096, end - at - len(head)))
                if not chunk:
                    raise ValueError("a record ends with its member")
                head += chunk
            length = cut + 4 + int(record_fields(head[:cut])["content-length"]) + 4
        yield at, length
        at += length


def record_ranges(f, size: int):
    """Offset and length in the archive of every record, by the archive's directory and indexes."""
    members = central_directory(f, size)
    data = {n: m for n, m in members.items() if n.lower().endswith((".warc", ".warc.gz"))}
    if packed := [n for n, m in data.items() if m[0] != 0]:
        raise ValueError(f"members that are not stored cannot be read by range: {packed[:3]}")
    starts = {n: member_start(f, m[3]) for n, m in data.items()}
    by_base = {n.rpartition("/")[2]: n for n in data}
    found: dict[str, dict[int, int]] = {n: {} for n in data}
    for name, (method, stored, _, where) in members.items():
        if method or not name.lower().endswith((".tsv", ".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
            continue
        f.seek(member_start(f, where))
        text = f.read(stored)
        text = gzip.decompress(text) if text[:2] == GZIP else text
        for line in text.decode("utf-8", "replace").splitlines():
            if name.lower().endswith(".tsv"):
                offset, length = line.split("\t")
                (found[next(iter(data))])[int(offset)] = int(length)
            elif (brace := line.find("{")) >= 0:
                entry = json.loads(line[brace:])
                owner = by_base.get(str(entry.get("filename", "")).rpartition("/")[2])
                if owner and "offset" in entry and "length" in entry:
                    found[owner][int(entry["offset"])] = int(entry["length"])
    for name, m in data.items():
        if found[name]:
            yield from ((starts[name] + at, length) for at, length in sorted(found[name].items()))
        else:
            yield from walk_records(f, starts[name], m[2], name.lower().endswith(".gz"))


# ---------------------------------------------------------------- tables


def write_archives(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", shared: int = LEAST_SHARED) -> DataFrame:
    """Write a record for every row (null html: empty) and give the archives: ``uri, size, records``.

    Of equal payloads of at least ``shared`` bytes the one with the largest id is
    the response (each of them, if ids are repeated or all null), the others
    revisit it. Null urls have no target; an empty table makes no archive; pages of
    any length are one record each. Other columns are not read, whatever their
    names.
    """
    rows = pages.select(F.col(quoted(page_id)).cast("long").alias("page_id"), F.col(quoted(url)).alias("url"), F.coalesce(F.col(quoted(html)), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"size": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")})
    copies = rows.where(F.col("size") >= shared).groupBy("sha1", "size").agg(F.max("page_id").alias("target"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    copies = staged(copies, "copies")
    # Few groups of copies are looked up where the payloads lie. Many are joined by a shuffle of the payloads, whose
    # large partitions Spark splits: the other side has one row for each group.
    small = copies.count() <= BROADCAST_ROWS
    placed = rows.join(F.broadcast(copies) if small else copies, ["sha1", "size"], "left")
    revisit = F.col("target").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("target"))
    placed = placed.select("page_id", "url", F.when(~revisit, F.col("payload")).alias("payload"), "size", "sha1", F.when(revisit, F.col("target")).alias("refers_to"))

    def write(batches):
        part, attempt = task_id()
        warc, index, done, n = io.BytesIO(), [], 0, 0

        def flush():
            nonlocal warc, index, done, n
            uri = f"{folder}/part-{part:05d}-{attempt}-{done}.zip"
            with open_for_write(uri) as f:
                out = io.BytesIO()
                write_zip(out, [("archive/data.warc", warc.getvalue()), ("indexes/index.tsv", "".join(index).encode())])
                f.write(out.getbuffer())
                size = out.tell()
            row = pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([size]), pa.array([n])], names=["uri", "size", "records"])
            warc, index, done, n = io.BytesIO(), [], done + 1, 0
            return row

        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                data = warc_record(*row)
                index.append(f"{warc.tell()}\t{len(data)}\n")
                warc.write(data)
                n += 1
                if warc.tell() >= ARCHIVE:
                    yield flush()
        if n:
            yield flush()

    return staged(placed.mapInArrow(in_worker("warc", write), "uri string, size long, records long"), "archives")


def read_archives(archives: DataFrame, payload: bool = False) -> DataFrame:
    """Every response and revisit of the archives (``uri, size``): ``page_id, payload_bytes, payload_digest, record_type, refers_to, url`` (and ``payload``). Records of other kinds are passed over."""

    def ranges(batches):
        for b in batches:
            for uri, size in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with open_for_read(uri) as f:
                    pairs = [*record_ranges(f, size)]
                yield pa.RecordBatch.from_arrays([pa.array([uri] * len(pairs)), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["uri", "at", "length"])

    kinds = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string()} | ({"payload": pa.binary()} if payload else {})

    def records(batches):
        held, f = None, None
        for b in batches:
            rows = []
            for uri, at, length in zip(*[c.to_pylist() for c in b.columns]):
                if uri != held:
                    if f:
                        f.close()
                    held, f = uri, open_for_read(uri)
                f.seek(at)
                row = parse_record(f.read(length))
                if row["record_type"] in ("response", "revisit"):
                    rows.append(row)
                if len(rows) == 512:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in kinds.items()], names=list(kinds))
        if f:
            f.close()

    n = partitions(archives.sparkSession)
    found = archives.repartition(n, "uri").select("uri", "size").mapInArrow(in_worker("warc", ranges), "uri string, at long, length long")
    spread = found.repartitionByRange(n, "uri", "at").sortWithinPartitions("uri", "at")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + (", payload binary" if payload else "")
    return spread.mapInArrow(in_worker("warc", records), schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages' archives into the shared folder and read them back."""
    return read_archives(write_archives(pages, scratch(pages.sparkSession, "warc")))
