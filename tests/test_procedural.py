"""The bootstrap's draws and the manifest of a whole folder."""

import gzip
import hashlib
import random
from pathlib import Path

from siftworks.operators import bootstrap
from siftworks.plans import catalogue
from siftworks.sources import digests

SF = "/root/testdata/sf0.001"


def test_paired_bootstrap_has_all_draws(spark, monkeypatch):
    seen, own = {}, bootstrap.paired_interval

    def spy(rows, *args, **more):
        seen.update(rows=rows, args=args)
        return own(rows, *args, **more)

    monkeypatch.setattr(bootstrap, "paired_interval", spy)
    got = catalogue.queries()["paired_bootstrap"](spark, SF).collect()
    assert sorted(got) == sorted(own(seen["rows"], *seen["args"], draws=10_000).collect()) and got


def test_manifest_of_a_folder(spark, tmp_path):
    (tmp_path / "t" / "part.parquet").mkdir(parents=True)
    for name, content in (("b.parquet", b"1"), ("a.parquet", b"22"), ("part.parquet/x.parquet", b"333")):
        (tmp_path / "t" / name).write_bytes(content)
    for folder in (str(tmp_path / "t"), SF):
        files = {p.relative_to(folder).as_posix(): p.read_bytes() for p in Path(folder).rglob("*") if p.is_file()}
        want = {n: (hashlib.sha256(c).hexdigest(), len(c)) for n, c in files.items()}
        whole = hashlib.sha256("".join(n + want[n][0] for n in sorted(want)).encode()).hexdigest()
        got = {r.file: (r.sha256, r.size) for r in catalogue.queries()["file_manifest"](spark, folder).collect()}
        assert got == want | {".": (whole, sum(map(len, files.values())))}


def test_large_files_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    """No task reads more than a piece of a file, whatever its bytes: line ends of all kinds or none at the end, a byte order mark, bytes that are no text."""
    rng = random.Random(3)
    own = {"a.parquet": rng.randbytes(300_000), "b [1].bin": b"\xef\xbb\xbf" + b"\r\n\n\r\xff" * 30_000, "c.txt": b"\n" * 100_000, "d/e": b"x" * 90_000, "f.gz": gzip.compress(rng.randbytes(50_000)), "small": b"1\n"}
    (tmp_path / "t" / "d").mkdir(parents=True)
    for name, content in own.items():
        (tmp_path / "t" / name).write_bytes(content)
    monkeypatch.setattr(digests, "LARGE", 40_000)
    pieces, split = {}, digests.split
    monkeypatch.setattr(digests, "split", lambda s, path, out: pieces.setdefault(path.rsplit("/", 1)[-1], split(s, path, out)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40000")
    try:
        got = {r.file: (r.sha256, r.size) for r in catalogue.queries()["file_manifest"](spark, str(tmp_path / "t")).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got.pop(".")
    assert got == {n: (hashlib.sha256(c).hexdigest(), len(c)) for n, c in own.items()}
    assert {k: len(v) for k, v in pieces.items()} == {"a.parquet": 8, "b [1].bin": 4, "c.txt": 3, "e": 1}
