"""WARC archives: round trips, revisits against brute force, and a reader that refuses what is damaged."""

import base64
import hashlib
import struct
from collections import defaultdict

import pytest
import zstandard

from siftworks.llm import warc_zstd as w

SCHEMA = "page_id bigint, url string, html string, digest string, Row string, payload int"


def page_rows():
    rows = [(i, f"http://h{i % 7}.example/{i}", f"<p>page {i % 23} {'x' * (i % 5)}</p>") for i in range(120)]
    rows += [(500 + i, "http://copies.example/ a\r\nb", "<p>copy</p>") for i in range(60)]
    rows += [(700, None, None), (701, "", ""), (702, "http://é.example/ü", "é" * 70_000), (3, "u", "<p>copy</p>"), (3, "u", "<p>copy</p>"), (3, "v", "other"), (3, "v", "other"), (None, "n", "<p>copy</p>"), (None, None, "only null"), (None, None, "only null")]
    rows += [(900, "z", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\n" + w.PADDING)]
    return [(*r, "d", "r", 1) for r in rows]


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, (page_id, _, html, *_) in enumerate(rows):
        groups[(html or "").encode()].append(((page_id is None, page_id or 0, i), page_id))
    out = []
    for payload, members in groups.items():
        first = min(members)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for m in members:
            revisit = m != first and len(payload) >= least
            out.append((m[1], len(payload), digest, "revisit" if revisit else "response", first[1] if revisit else None))
    return sorted(out, key=repr)


def test_report_equals_brute_force(spark):
    rows = page_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).cache()
    df.count()
    assert sorted((tuple(r) for r in w.archive_report(df).collect()), key=repr) == brute(rows)


def test_least_bytes_and_payloads_round_trip(spark, tmp_path):
    rows = page_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert w.write_archives(df, f"{tmp_path}/a", least_bytes=12) == len(rows)
    got = [r for r in w.read_archives(spark, f"{tmp_path}/a").collect() if r.record_type != "warcinfo"]
    assert not [r for r in got if r.error]
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == brute(rows, 12)
    texts = {(r[0], r[2] or "") for r in rows}
    assert {(r.page_id, bytes(r.payload).decode()) for r in got if r.record_type == "response"} <= texts
    assert len({bytes(r.payload) for r in got if r.record_type == "response"}) == len({t for _, t in texts})


def test_empty_table(spark):
    assert w.archive_report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_any_decoder_reads_the_archive(spark, tmp_path):
    """The stream decodes with the library alone, given the dictionary of the leading frame: padding is passed over."""
    html = [(i, "http://a.example/", f"<html><p>some longer text of page {i} {i * 37 % 101}</p></html>" * 5, "", "", 0) for i in range(400)]
    w.write_archives(spark.createDataFrame(html, SCHEMA).coalesce(1), f"{tmp_path}/a")
    files = [bytes(r.content) for r in spark.read.format("binaryFile").load(f"{tmp_path}/a").collect() if r.length]
    data = max(files, key=len)
    magic, size = struct.unpack_from("<II", data)
    assert magic == w.DICTIONARY
    known = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(data[8 : 8 + size]))
    at, seen = 8 + size, 0
    for kind, start, end in list(w.frames(memoryview(data)))[1:]:
        assert start == at
        at = end
        if kind == w.FRAME:
            assert zstandard.get_frame_parameters(data[start:end]).dict_id == known.dict_id()
            assert zstandard.ZstdDecompressor(dict_data=known).decompress(data[start:end]).startswith(b"WARC/1.1\r\n")
            seen += 1
    assert at == len(data) and seen == 401


GOOD = w.record(7, "http://a.example/", b"<p>hi</p>", 9, w.base32_sha1(b"<p>hi</p>"))
REVISIT = w.record(8, None, None, 9, w.base32_sha1(b"<p>hi</p>"), 4, 7)


def frame(raw, **how):
    return zstandard.ZstdCompressor(**how).compress(raw)


@pytest.mark.parametrize(
    "raw, error",
    [
        (GOOD, None),
        (REVISIT, None),
        (GOOD[:-1], "length differs from content-length"),
        (GOOD + b"x", "length differs from content-length"),
        (GOOD + GOOD, "length differs from content-length"),
        (GOOD.replace(b"WARC/1.1", b"WARC/9.9", 1), "version"),
        (GOOD.replace(b"WARC-Date: ", b"WARC-Day: "), "no warc-date"),
        (GOOD.replace(b"WARC-Type: response", b"WARC-Type: response\r\nWARC-Type: revisit"), "repeated warc-type"),
        (GOOD.replace(b"WARC-Target-URI:", b"WARC Target"), "header line"),
        (GOOD.replace(b"<p>hi", b"<p>ho"), "block digest"),
        (GOOD.replace(b"WARC-Block-Digest: sha1:", b"X-Digest: ").replace(b"<p>hi", b"<p>ho"), "payload digest"),
        (GOOD.replace(b"1970-01-01T00:00:00Z", b"yesterday"), "warc-date"),
        (REVISIT.replace(b"WARC-Refers-To", b"X-Refers-To"), "revisit"),
        (b"", "no end of the header"),
        (b"\xff\r\n\r\n", "header is no UTF-8"),
    ],
)
def test_records_are_validated(raw, error):
    """A damaged record is a row with an error, and the records around it are read."""
    rows = list(w.read_records(frame(GOOD) + frame(raw) + w.PADDING.encode() + frame(REVISIT)))
    assert [r["error"] for r in rows] == [None, error, None]
    assert rows[0]["payload"] == b"<p>hi</p>" and rows[2]["refers_to"] == 7 and rows[2]["payload_bytes"] == 9


def test_frames_cut_anywhere_are_refused():
    data = frame(GOOD, write_checksum=True) + w.PADDING.encode() + frame(REVISIT * 40_000, write_checksum=True)
    whole = len(list(w.frames(memoryview(data))))
    assert whole == 3
    ends = {e for _, _, e in w.frames(memoryview(data))} | {0}
    for n in range(len(data)):
        if n in ends:
            list(w.frames(memoryview(data[:n])))
        else:
            with pytest.raises(ValueError, match="frame cut off|no frame"):
                list(w.frames(memoryview(data[:n])))


def test_lost_or_damaged_dictionary_and_checksum():
    samples = [GOOD.replace(b"hi", b"text of %d" % i) for i in range(2000)]
    known = w.dictionary_of(samples)
    assert known
    packed = frame(GOOD, dict_data=zstandard.ZstdCompressionDict(known), write_checksum=True)
    lead = lambda body, magic=w.DICTIONARY: struct.pack("<II", magic, len(body)) + body
    for body in (known, frame(known)):
        assert [r["error"] for r in w.read_records(lead(body) + packed)] == [None]
    assert [r["error"] for r in w.read_records(packed)] == ["frame does not decode"]
    assert [r["error"] for r in w.read_records(lead(b"nothing like it") + packed)] == ["no dictionary in the leading frame"]
    # Only the leading frame may hold it.
    assert [r["error"] for r in w.read_records(w.PADDING.encode() + lead(known) + packed)] == ["frame does not decode"]
    assert [r["error"] for r in w.read_records(lead(known) + packed[:-1] + bytes([packed[-1] ^ 1]))] == ["frame does not decode"]
    assert [r["error"] for r in w.read_records(lead(known) + b"junkjunk" + packed)] == ["no frame"]


def test_frames_without_content_size():
    packer = zstandard.ZstdCompressor(write_content_size=False).compressobj()
    data = packer.compress(GOOD * 1) + packer.flush()
    assert [r["error"] for r in w.read_records(data + frame(GOOD))] == [None, None]
