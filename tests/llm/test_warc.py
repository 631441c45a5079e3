import hashlib
import re
import struct
import uuid

import pytest
import zstandard

from catalogkit.llm import warc

SCHEMA = "page_id long, url string, html string, digest string"


def test_round_trip(spark, tmp_path):
    long = "<html>" + "é😀x" * 60 + "</html>"
    rows = [(i, f"http://h/{i}", f"<p>page {i} " + "text " * (i % 40) + "</p>", "clash") for i in range(1, 300)]
    rows += [(500, None, long, "d"), (400, "http://h/ a", long, "d"), (450, "x", long, "d"), (600, "x", None, "d"), (601, "x", "", "d"), (602, "x", "short", "d"), (603, "x", "short", "d")]
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    warc.write(spark.createDataFrame(rows, SCHEMA), path)
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(rows) and not any(r.error for r in got.values())
    for i, _, html, _ in rows:
        body = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(body), hashlib.sha256(body).hexdigest())
        if got[i].record_type == "response":
            assert bytes(got[i].payload) == body
    assert [got[i].record_type for i in (400, 450, 500, 602, 603)] == ["response", "revisit", "revisit", "response", "response"]
    assert got[450].refers_to == got[500].refers_to == 400 and got[400].refers_to is None


def test_frames_and_damage():
    payload = b"<p>hi</p>"
    data = warc.record(1, "http://x", payload, hashlib.sha256(payload).hexdigest(), None, False)
    assert warc.parse(data)["payload"] == payload
    for bad in (data[:-1], data.replace(b"hi", b"ho"), b"nothing", data.replace(b"WARC-Date", b"X-Date")):
        with pytest.raises(warc.BadRecord):
            warc.parse(bad)
    for bad in (data.replace(b"Content-Length: 9\r\n\r\n<p>", b"Content-Length: x\r\n\r\n<p>"), re.sub(rb"Content-Length: \d+\r\n\r\nHTTP", b"Content-Length: " + "²".encode() + b"\r\n\r\nHTTP", data)):
        assert bad != data
        with pytest.raises(warc.BadRecord):
            warc.parse(bad)
    with pytest.raises(warc.BadRecord):
        list(warc.frames(memoryview(b"\x28\xb5\x2f\xfd")))


def test_empty(spark, tmp_path):
    path = f"file://{tmp_path}/{uuid.uuid4().hex}"
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.read(spark, path).count() == 0


def test_damage_stays_local_and_compressed_dictionary(spark, tmp_path):
    """Bad records are rows with an error; the others of the archive are read, with a compressed dictionary too."""
    samples = [f"<p>page {i} of the archive with words {i * 7}</p>".encode() * 20 for i in range(400)]
    raw = zstandard.train_dictionary(4096, samples).as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    records = [warc.record(i, "u", b, hashlib.sha256(b).hexdigest(), None, False) for i, b in enumerate(samples[:6])]
    records[2] = records[2].replace(b"Content-Length: ", b"Content-Length: x", 2)
    records[4] = b"nothing"
    for kind, dictionary in (("plain", raw), ("packed", zstandard.ZstdCompressor().compress(raw))):
        (tmp_path / kind).mkdir()
        lead = struct.pack("<II", warc.DICTIONARY_MAGIC, len(dictionary)) + dictionary
        (tmp_path / kind / "part-0").write_bytes(lead + b"".join(map(packer.compress, records)))
        rows = warc.read(spark, f"file://{tmp_path}/{kind}").collect()
        assert sorted(r.page_id for r in rows if not r.error) == [0, 1, 3, 5] and sum(bool(r.error) for r in rows) == 2


def test_archives_of_another_writer(spark, tmp_path):
    """Frames without a content size, other record types, chunked bodies, other digests and repeated columns."""

    def record(kind, block, *more):
        fields = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1>", "WARC-Date: 2020-01-01T00:00:00Z", *more, f"Content-Length: {len(block)}"]
        return ("WARC/1.0\r\n" + "\r\n".join(fields) + "\r\n\r\n").encode() + block + b"\r\n\r\n"

    ok = b"HTTP/1.1 200 OK\r\n"
    chunked = ok + b"Transfer-Encoding: chunked\r\n\r\n4\r\nWiki\r\n6;x=1\r\npedia \r\n0\r\n\r\n"
    records = [
        record("warcinfo", b"software: x\r\n"), record("request", b"GET / HTTP/1.1\r\n\r\n"), record("metadata", b"a: b"), record("resource", b"\x00raw"), record("response", chunked, "WARC-Payload-Digest: sha1:ABC", "WARC-Target-URI: http://x"),
        record("response", ok + b"\r\nplain"), record("response", ok + b"Content-Length: 9\r\n\r\ncut", "WARC-Truncated: length"), record("revisit", b"", "WARC-Refers-To-Target-URI: http://x"),
        record("response", ok + b"Content-Length: 9\r\n\r\ncut"), record("response", ok + b"Transfer-Encoding: chunked\r\n\r\nzz"), record("response", b"nothing"),
    ]

    def streamed(data):
        packer = zstandard.ZstdCompressor(write_content_size=False).compressobj()
        return packer.compress(data) + packer.flush()

    (tmp_path / "part-0").write_bytes(b"".join(map(streamed, records)))
    rows = warc.read(spark, f"file://{tmp_path}").collect()
    good = sorted((r.record_type, bytes(r.payload) if r.payload is not None else None) for r in rows if not r.error)
    assert good == sorted([("warcinfo", b"software: x\r\n"), ("request", b"GET / HTTP/1.1\r\n\r\n"), ("metadata", b"a: b"), ("resource", b"\x00raw"), ("response", b"Wikipedia "), ("response", b"plain"), ("response", b"cut"), ("revisit", None)])
    assert len([r for r in rows if r.error]) == 3
    assert {r.payload_digest for r in rows if r.payload is not None} == {hashlib.sha256(bytes(r.payload)).hexdigest() for r in rows if r.payload is not None}


def test_archives_are_bounded_and_ids_may_repeat(spark, tmp_path):
    """Null and repeated ids, one long payload, and archives that all start with the dictionary."""
    body = lambda i: hashlib.sha256(str(i).encode()).hexdigest() * 40
    rows = [(i, f"http://h/{i}", body(i), "d") for i in range(300)] + [(None, "n", body(1), "d"), (7, "again", body(7), "d"), (900, "long", "".join(body(i) for i in range(2000)), "d"), (None, "m", body("m"), "d"), (None, "k", body("m"), "d")]
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    warc.write(spark.createDataFrame(rows, SCHEMA).coalesce(1), f"file://{path}", archive_bytes=30_000)
    files = [p.read_bytes() for p in __import__("pathlib").Path(path).glob("part-*")]
    sizes = sorted(map(len, files))
    assert len(files) > 4 and sizes[-2] < 3 * 30_000 and all(f[:4] == struct.pack("<I", warc.DICTIONARY_MAGIC) for f in files)
    got = warc.read(spark, f"file://{path}").collect()
    assert len(got) == len(rows) and not any(r.error for r in got)
    kinds = sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in got if r.page_id in (None, 1, 7))
    assert kinds == sorted([("1", "response", "None"), ("7", "response", "None"), ("7", "response", "None"), ("None", "revisit", "1"), ("None", "response", "None"), ("None", "response", "None")])
