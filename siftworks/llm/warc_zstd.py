"""WARC archives in Zstandard: one frame for each record behind a dictionary in a leading skippable frame.

The writer makes a record of each page: a response with the payload, or a revisit of the record that has the same payload. Which it is
comes from digests alone; payloads are shuffled only where a copy stands for a group. An archive is what one task writes, through
Spark's own text sink, so that its commit protocol covers lost tasks: rows are frames, and the line separator is an empty skippable
frame, which every reader passes over.

The reader takes archives of any writer as binary files: it walks the frames by their block headers, loads the dictionary, decodes one
frame per record, and validates versions, header fields, lengths and digests. What fails is a row with an error, not a lost record.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, cut, marked, marks, remove_folder

# Fixed values of the formats.
FRAME, DICTIONARY, RAW_DICTIONARY = 0xFD2FB528, 0x184D2A5D, 0xEC30A437
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
PADDING = "P*M\x18\0\0\0\0"  # a skippable frame of no bytes
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
VERSIONS = ("WARC/1.0", "WARC/1.1")
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")

LEVEL = 3
DATE = "1970-01-01T00:00:00Z"  # pages have no time of their own
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 32_768, 65_536  # the dictionary is made of so many pages of so many bytes at most
MAX_RECORD = 1 << 30  # bytes of a decoded record
BATCH_BYTES, BATCH_RECORDS = 8_000_000, 4_000

READ = "archive string, record_id string, record_type string, page_id bigint, url string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary, error string"


def base32_sha1(data) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def dictionary_of(samples: list[bytes]) -> bytes:
    """A dictionary trained on the samples; b"" where they are too few for one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _named(page_id, digest: str, row=None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}{'' if row is None else f':{row}'}>"


def record(page_id, url, payload, size: int, digest: str, row=None, refers_to=None, date: str = DATE) -> bytes:
    """A response, or where payload is None a revisit, which has the HTTP head alone. Control characters and blanks of the url are escaped."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload or b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if payload is not None else 'revisit'}", f"WARC-Record-ID: {_named(page_id, digest, row)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if payload is None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_named(refers_to, digest)}"]
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def frames(data: memoryview):
    """(magic, start, end) of each frame, found by its headers alone. ValueError where the data end within one or are none."""
    at, n = 0, len(data)

    def ends(x: int) -> int:
        if x > n:
            raise ValueError("frame cut off")
        return x

    while at < n:
        ends(at + 8)
        magic, size = struct.unpack_from("<II", data, at)
        if magic in SKIPPABLE:
            end = ends(at + 8 + size)
        elif magic == FRAME:
            flags = data[at + 4]
            single = flags >> 5 & 1
            end = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
            last = False
            while not last:
                ends(end + 3)
                block = int.from_bytes(data[end : end + 3], "little")
                last, kind = block & 1, block >> 1 & 3
                if kind == 3:
                    raise ValueError("reserved block")
                end = ends(end + 3 + (1 if kind == 1 else block >> 3))
            end = ends(end + 4 * (flags >> 2 & 1))
        else:
            raise ValueError("no frame")
        yield magic, at, end
        at = end


def _dictionary(body: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary that the leading skippable frame holds, as it is or compressed."""
    magic = struct.unpack_from("<I", body)[0] if len(body) >= 4 else 0
    if magic == FRAME:
        body = zstandard.ZstdDecompressor().decompressobj().decompress(body)
        magic = struct.unpack_from("<I", body)[0] if len(body) >= 4 else 0
    if magic != RAW_DICTIONARY:
        raise ValueError("no dictionary in the leading frame")
    return zstandard.ZstdCompressionDict(body)


def parse(raw: bytes) -> tuple[dict, bytes]:
    """(header fields by lower-case name, block) of the one record in raw. ValueError says what is wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("no end of the header")
    try:
        version, *lines = head.decode().split("\r\n")
    except UnicodeDecodeError:
        raise ValueError("header is no UTF-8") from None
    if version not in VERSIONS:
        raise ValueError("version")
    fields: dict = {}
    for line in lines:
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise ValueError("header line")
        if name.lower() in fields and name.lower() in REQUIRED:
            raise ValueError(f"repeated {name.lower()}")
        fields[name.lower()] = value.strip()
    for name in REQUIRED:
        if name not in fields:
            raise ValueError(f"no {name}")
    if not re.fullmatch(r"[0-9]+", fields["content-length"]):
        raise ValueError("content-length")
    if not re.fullmatch(r"<[^<>\s]+>", fields["warc-record-id"]):
        raise ValueError("warc-record-id")
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z", fields["warc-date"]):
        raise ValueError("warc-date")
    size = int(fields["content-length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("length differs from content-length")
    block = rest[:size]
    if fields.get("warc-block-digest", "").startswith("sha1:") and fields["warc-block-digest"][5:] != base32_sha1(block):
        raise ValueError("block digest")
    return fields, block


def _http(block: bytes) -> tuple[int, bytes]:
    """(Content-Length, body) of an HTTP response."""
    head, found, body = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)[ \t]*\r?$", head)
    if not found or not head.startswith(b"HTTP/") or not length:
        raise ValueError("HTTP head")
    return int(length[1]), body


def _page(named: str):
    m = re.fullmatch(r"<urn:page:(-?\d+):[A-Z2-7]{32}(:\d+)?>", named or "")
    return int(m[1]) if m else None


def described(raw: bytes, with_payload: bool) -> dict:
    """A record's row; error is null or says why it does not count. Types other than response and revisit have no payload columns."""
    row: dict = dict.fromkeys(c.split()[0] for c in READ.split(", "))
    try:
        fields, block = parse(raw)
        kind = fields["warc-type"]
        row |= {"record_id": fields["warc-record-id"], "record_type": kind, "page_id": _page(fields["warc-record-id"]), "url": fields.get("warc-target-uri")}
        if kind not in ("response", "revisit"):
            return row
        size, body = _http(block)
        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
        if kind == "response" and (size != len(body) or digest != base32_sha1(body)):
            raise ValueError("payload length" if size != len(body) else "payload digest")
        if kind == "revisit" and (body or fields.get("warc-profile") != PROFILE or "warc-refers-to" not in fields):
            raise ValueError("revisit")
        row |= {"payload_bytes": size, "payload_digest": digest, "refers_to": _page(fields.get("warc-refers-to", "")), "payload": body if with_payload and kind == "response" else None}
    except ValueError as e:
        row["error"] = str(e)
    return row


def read_records(data, with_payload: bool = True):
    """Rows of one archive's bytes, in order. Behind a place where no frame can be told nothing more can be read: that is the last row."""
    view, decoder, first = memoryview(data), zstandard.ZstdDecompressor(), True
    try:
        for magic, start, end in frames(view):
            if magic == DICTIONARY and first:
                decoder = zstandard.ZstdDecompressor(dict_data=_dictionary(bytes(view[start + 8 : end])))
            if magic == FRAME:
                try:
                    size = zstandard.frame_content_size(view[start:end])
                    if size > MAX_RECORD:
                        raise ValueError("record too long")
                    raw = decoder.decompress(view[start:end]) if size > 0 else decoder.decompressobj().decompress(view[start:end])
                except (zstandard.ZstdError, ValueError) as e:
                    yield described(b"", False) | {"error": str(e) if isinstance(e, ValueError) else "frame does not decode"}
                else:
                    yield described(raw, with_payload)
            first = False
    except (ValueError, zstandard.ZstdError, struct.error) as e:
        yield described(b"", False) | {"error": str(e)}


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """(archive, record_id, record_type, page_id, url, payload_bytes, payload_digest, refers_to, payload, error) of every record in the archives below path.

    Records come in no order; equal ones stay as they are. page_id and refers_to are null where identifiers are not of this module's writer;
    payload is that of responses. An empty file has no records. A file is read whole by one task (2 GB at most); writers bound them.
    """
    schema = pa.schema([(c.split()[0], {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[c.split()[1]]) for c in READ.split(", ")])

    def run(batches):
        rows, held = [], 0
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                for row in read_records(content.as_buffer(), payload):
                    rows.append(row | {"archive": name.as_py()})
                    held += len(row["payload"] or b"")
                    if held > BATCH_BYTES or len(rows) >= BATCH_RECORDS:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, READ)


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = DATE) -> int:
    """Writes one record for each row of pages (page_id, url, html) below path and returns how many.

    Of rows whose payloads of least_bytes or more are equal, the one of the smallest page_id is the response (null ids come last; of repeated
    ids the first row), all others revisit it. Null html is an empty payload. A null url has no target field. An archive is what one task
    scans. An empty table gives archives without records.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    meta = cut(rows.select("page_id", "url", "digest", "size", F.monotonically_increasing_id().alias("row")))
    total = meta.count()

    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    first = meta.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = cut(first.select(F.col("digest").alias("_digest"), F.col("first.page_id").alias("refers_to"), F.col("first.row").alias("_row")))
    groups = marks(first, F.xxhash64("_digest"))
    # Rows in which the bit of a group is set are told apart by their digests; payloads come into it only for the first of each group.
    near = marked(meta, F.xxhash64("digest"), groups).join(first, F.col("digest") == F.col("_digest"), "left")
    revisits = near.where("_digest is not null and row <> _row").select("page_id", "url", F.lit(None).cast("binary").alias("payload"), "digest", "size", "row", "refers_to")
    stands = cut(near.where("_digest is null or row = _row").select(F.col("digest").alias("_digest"), F.col("page_id").alias("_page"), F.col("_digest").isNotNull().alias("once")))
    key = F.xxhash64("digest", "page_id")
    alike = (F.col("digest") == F.col("_digest")) & F.col("page_id").eqNullSafe(F.col("_page"))
    held = marked(marked(rows, F.xxhash64("digest"), groups), key, marks(stands, F.xxhash64("_digest", "_page"))).join(stands, alike)
    # Of rows that repeat id and payload one holds the response.
    once = held.where("once").groupBy("digest", "page_id").agg(F.first("url").alias("url"), F.first("payload").alias("payload"), F.first("size").alias("size"))
    none = {"row": F.lit(None).cast("bigint"), "refers_to": F.lit(None).cast("bigint")}
    columns = ["page_id", "url", "payload", "digest", "size", "row", "refers_to"]
    parts = [marked(rows, F.xxhash64("digest"), groups, "left_anti"), held.where("not once"), once]
    records = revisits
    for part in parts:
        records = records.unionByName(part.withColumns(none).select(columns))

    share = F.pmod(F.xxhash64("digest"), F.lit(1 << 31)) < int(min(1.0, 4 * SAMPLE_PAGES / max(1, total)) * (1 << 31))
    sample = rows.where(F.col("size").between(64, SAMPLE_BYTES) & share).select("digest", "payload").dropDuplicates(["digest"]).orderBy("digest").limit(SAMPLE_PAGES).collect()
    dictionary = dictionary_of([bytes(r.payload) for r in sample])

    def run(batches):
        packer, out, held = None, [], 0
        for batch in batches:
            for page_id, url, payload, digest, size, row, refers_to in zip(*(batch.column(c) for c in columns)):
                if packer is None:
                    packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)
                    if dictionary:
                        body = zstandard.ZstdCompressor(level=19).compress(dictionary)
                        out.append(struct.pack("<II", DICTIONARY, len(body)) + body)
                    out.append(packer.compress(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: 18\r\n\r\nformat: WARC/1.1\r\n\r\n\r\n".encode()))
                name = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                out.append(packer.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), size.as_py(), name, row.as_py(), refers_to.as_py(), date)))
                held += len(out[-1])
                if held > BATCH_BYTES or len(out) >= BATCH_RECORDS:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
                    out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    packed = records.mapInArrow(run, "frame binary")
    packed.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", PADDING).text(path)
    return total


def archive_report(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, as read back from archives written of them.

    Nulls, repeated rows and ids, ties, empty and very long pages and empty tables are treated as write_archives says; columns of other
    names are not looked at. A record that fails validation, or is missing, is an error. The archives go once they are read.
    """
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    total = write_archives(pages, path)
    found = read_archives(spark, path, payload=False).where("error is not null or record_type <> 'warcinfo'")
    fault = F.raise_error(F.concat(F.lit("record of "), "archive", F.lit(": "), "error")).cast("bigint")
    out = cut(found.select(F.when(F.col("error").isNotNull(), fault).otherwise(F.col("page_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"))
    if (n := out.count()) != total:
        raise RuntimeError(f"{total} records were written, {n} read")
    remove_folder(spark, path)
    return out
