"""The listing source over written folders."""

import os
import time

from catalogkit.sources import listing
from catalogkit.streaming import jobs


def made(folder, size, seed=1):
    folder.parent.mkdir(parents=True, exist_ok=True)
    folder.write_bytes(bytes((i * seed * 31 + i // 256) % 256 for i in range(size)))
    return str(folder)


def plain(path):
    with open(path, "rb") as f:
        data = f.read()
    total = len(data)
    for part in (data[:65536], data[-65536:] if len(data) > 65536 else data):
        part = part[: len(part) // 8 * 8]
        total += sum(int.from_bytes(part[i : i + 8], "little") for i in range(0, len(part), 8))
    return f"{total % 2**64:016x}"


def test_listing_and_fingerprints(spark, tmp_path):
    want = [made(tmp_path / "a.mkv", 10), made(tmp_path / "x" / "b.MP4", 200_000, 3), made(tmp_path / "x" / "deep" / "c.avi", 65_536), made(tmp_path / "y" / "d.mkv", 0)]
    for other in (tmp_path / ".hidden" / "e.mkv", tmp_path / "x" / ".h" / "f.mkv", tmp_path / "x" / ".g.mkv", tmp_path / "x" / "h.mkv.part", tmp_path / "x" / "i.txt"):
        made(other, 5)
    rows = listing.list_folders(spark, [f"file://{tmp_path}"])
    got = {r.path: (r["size"], r.mtime) for r in rows.collect()}
    assert got == {p: (os.path.getsize(p), os.path.getmtime(p)) for p in want} and rows.rdd.getNumPartitions() == 3
    assert {r.path: r.fingerprint for r in listing.fingerprints(spark, [str(tmp_path)]).collect()} == {p: plain(p) for p in want}
    assert listing.list_folders(spark, [str(tmp_path / "y"), str(tmp_path / "x" / "deep")]).count() == 2


def test_polls_feed_arrivals(spark, tmp_path):
    path = made(tmp_path / "in" / "a.mkv", 100)
    os.utime(path, (time.time() - 600, time.time() - 600))
    arrivals = jobs.stable_arrivals(listing.polls(spark, [str(tmp_path / "in")], 1.0), 30.0)
    q = arrivals.writeStream.format("memory").queryName("polled").outputMode("append").start()
    try:
        until = time.time() + 90
        while not (told := spark.table("polled").collect()) and time.time() < until:
            time.sleep(1)
        assert [(r.path, r["size"]) for r in told] == [(path, 100)]
    finally:
        q.stop()
