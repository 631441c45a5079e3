"""WARC archives compressed record by record with Zstandard.

An archive is a leading skippable frame that holds the dictionary, then one
Zstandard frame per record. Archives are written by Spark's text writer, to any
file system it reaches: each row is some whole frames, and the line separator is
an empty skippable frame, which a Zstandard stream may hold anywhere.

The reader loads the dictionary from the leading frame, walks the frames by
their block headers, decodes one record per frame and checks headers, lengths
and digests. A record that fails is returned with ``error`` set, and the others
of its archive are read; only where a frame's own length is damaged the rest of
that archive is one row with ``error``.

Defined results: a null payload is empty; a payload of under ``least`` bytes is
always a response; among equal payloads the smallest page_id is the response
(rows that repeat it are responses too) and a null page_id is never the
smallest unless all are null; an archive without frames gives no records; an
empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .arrowtext import slices

DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
#: An empty skippable frame; all its bytes are ASCII, so it can be a line separator.
SEPARATOR = struct.pack("<II", 0x184D2A50, 0).decode("ascii")

#: Bytes of one archive at most, but for its last record, and lines that it is written in.
ARCHIVE_BYTES, ROWS = 32 << 20, 64
#: The dictionary is trained on at most so many payloads (chosen by hash), so many bytes of each.
SAMPLE_ROWS, SAMPLE_BYTES, DICTIONARY_BYTES = 256, 8192, 16384
#: Payloads shorter than this are never revisits.
LEAST = 100

_DATE = "2000-01-01T00:00:00Z"


def train(pages: DataFrame) -> bytes:
    """A dictionary for the payloads; empty if there are too few to train on.

    The pages are chosen by a hash of their id and address, so that only numbers
    are compared; the driver then fetches the start of SAMPLE_ROWS payloads.
    """
    place = F.xxhash64("page_id", "url", F.lit(3))
    lowest = pages.select(place.alias("place")).distinct().orderBy("place").limit(SAMPLE_ROWS)
    places = [r["place"] for r in lowest.collect()]
    start = F.substring(F.col("html").cast("binary"), 1, SAMPLE_BYTES)
    chosen = pages.where(place.isin(places)).select(place.alias("place"), start.alias("b")).where("b is not null")
    samples = [bytes(r["b"]) for r in chosen.groupBy("place").agg(F.min("b").alias("b")).orderBy("place").collect()]
    if sum(map(len, samples)) < 8 * DICTIONARY_BYTES or len(samples) < 16:
        return b""
    return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, is_revisit: bool) -> bytes:
    """One WARC record: a response with its HTTP header, or a revisit with headers only."""
    name = lambda i: f"<urn:page:{'null' if i is None else i}>"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if is_revisit:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    fields.append(("Content-Length", str(len(block))))
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


class BadRecord(ValueError):
    pass


def _length(text: str) -> int | None:
    return int(text) if re.fullmatch(r"[0-9]{1,18}", text) else None


def _unchunked(body: bytes) -> bytes:
    """The body of a chunked transfer; raises BadRecord."""
    out, at = [], 0
    while True:
        line, gap, _ = body[at : at + 64].partition(b"\r\n")
        size = line.partition(b";")[0].strip()
        if not gap or not re.fullmatch(rb"[0-9A-Fa-f]{1,12}", size):
            raise BadRecord("a chunk without its size")
        start, n = at + len(line) + 2, int(size, 16)
        if n == 0:
            return b"".join(out)
        if body[start + n : start + n + 2] != b"\r\n":
            raise BadRecord("a chunk is cut off")
        out.append(body[start : start + n])
        at = start + n + 2


def _http(block: bytes, truncated: bool) -> tuple[int | None, bytes]:
    """(stated length, payload) of an HTTP block. A chunked body is put together; one without a length is taken as it is."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"HTTP/"):
        raise BadRecord("no HTTP header")
    values = lambda name: [x.partition(b":")[2].strip() for x in head.split(b"\r\n") if x.lower().startswith(name)]
    lengths = values(b"content-length:")
    if b"chunked" in b",".join(values(b"transfer-encoding:")).lower() and payload:
        return None, payload if truncated else _unchunked(payload)
    if len(set(lengths)) > 1:
        raise BadRecord("several HTTP lengths")
    if not lengths:
        return None, payload
    stated = _length(lengths[0].decode("latin-1"))
    if stated is None:
        raise BadRecord("the HTTP length is not a number")
    if payload and stated != len(payload) and not truncated:
        raise BadRecord("payload length does not match the HTTP header")
    return stated, payload


def parse(data: bytes) -> dict:
    """The fields of one record, checked; raises BadRecord.

    Responses and revisits are read as HTTP; the payload of any other type
    (warcinfo, request, metadata, resource, conversion) is its block. A SHA-256
    digest is checked, one of another kind is not; the digest given back is
    always the payload's SHA-256, or that of its response for a revisit.
    """
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not lines[0].startswith("WARC/1."):
        raise BadRecord("no WARC header")
    fields = {}
    for line in lines[1:]:
        key, colon, value = line.partition(":")
        if not colon:
            raise BadRecord(f"bad header line {line[:40]!r}")
        fields[key.strip().lower()] = value.strip()
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in fields:
            raise BadRecord(f"no {key}")
    length = _length(fields["content-length"])
    if length is None or len(rest) != length + 4 or not rest.endswith(b"\r\n\r\n"):
        raise BadRecord("content-length does not match the block")
    block, kind = rest[:-4], fields["warc-type"]
    stated, payload = None, block
    if kind in ("response", "revisit") and (block or kind == "response"):
        stated, payload = _http(block, "warc-truncated" in fields)
    digest = hashlib.sha256(payload).hexdigest()
    told = fields.get("warc-payload-digest", "").lower().partition("sha256:")[2]
    if kind == "revisit":
        if payload or not fields.keys() & {"warc-refers-to", "warc-refers-to-target-uri"}:
            raise BadRecord("a revisit with a payload or without its response")
        digest = told or None
    elif told and told != digest and "warc-truncated" not in fields:
        raise BadRecord("payload digest does not match")

    def page(key: str) -> int | None:
        value = fields.get(key, "").removeprefix("<urn:page:").removesuffix(">")
        return int(value) if re.fullmatch(r"-?[0-9]{1,18}", value) else None

    return {
        "page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"], "refers_to": page("warc-refers-to"),
        "payload_bytes": stated if kind == "revisit" else len(payload), "payload_digest": digest, "payload": None if kind == "revisit" else payload,
    }


def frames(data: memoryview) -> Iterator[tuple[int, memoryview]]:
    """(magic, frame) for each frame of a Zstandard stream, found by its headers alone."""
    at = 0
    while at < len(data):
        if at + 8 > len(data):
            raise BadRecord("a frame is cut off")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + size
        elif magic == FRAME_MAGIC:
            end = at + zstandard.frame_header_size(data[at : at + 18])
            last = False
            while not last:
                if end + 3 > len(data):
                    raise BadRecord("a frame is cut off")
                word = int.from_bytes(data[end : end + 3], "little")
                last, kind = bool(word & 1), word >> 1 & 3
                end += 3 + (1 if kind == 1 else word >> 3)
            end += 4 * (data[at + 4] >> 2 & 1)
        else:
            raise BadRecord("not a Zstandard frame")
        if end > len(data):
            raise BadRecord("a frame is cut off")
        yield magic, data[at:end]
        at = end


def opened(dictionary: bytes) -> bytes:
    """The dictionary of a leading frame, which may itself be compressed."""
    if dictionary[:4] == struct.pack("<I", FRAME_MAGIC):
        return zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    return dictionary


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, digest, is_revisit and refers_to of each page.

    Only digests that repeat are joined back; payloads stay where they are when
    those are few.
    """
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    repeated = rows.where(F.octet_length("payload") >= least).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    repeated = common.cut(repeated.where("n > 1 and first_id is not null").select("digest", "first_id"))
    out = rows.join(common.small_or_not(repeated), "digest", "left")
    is_revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select("page_id", "url", "payload", "digest", is_revisit.alias("is_revisit"), F.when(is_revisit, F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, path: str, least: int = LEAST, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> None:
    """Writes the pages as archives under ``path``, each with the dictionary in front.

    Frames are joined to lines of about a ROWS-th of ``archive_bytes``, and the
    writer starts a new file after ROWS lines, the first of which is the
    dictionary. An archive that is full early is filled up with empty lines, so
    none exceeds ``archive_bytes`` by more than one line, or one record.
    """
    dictionary = train(pages)
    line_bytes = max(1, archive_bytes // ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        packer = zstandard.ZstdCompressor(level=level, dict_data=shared, write_checksum=True)
        # raw bytes in a string column: the text writer copies them as they are
        text = lambda rows: pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()).view(pa.string())], ["value"])
        lead = struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
        yield text([lead])
        lines, size, held, held_size = 1, 0, [], 0
        for batch in slices(batches, "payload"):
            for r in batch.to_pylist():
                frame = packer.compress(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"], r["is_revisit"]))
                if lines == ROWS or (size and size + held_size + len(frame) > archive_bytes):
                    yield text([b"".join(held)] * (1 if held else 0) + [b""] * (ROWS - lines - (1 if held else 0)) + [lead])
                    lines, size, held, held_size = 1, 0, [], 0
                held.append(frame)
                held_size += len(frame)
                if held_size >= line_bytes:
                    yield text([b"".join(held)])
                    lines, size, held, held_size = lines + 1, size + held_size, [], 0
        if held:
            yield text([b"".join(held)])

    rows = with_revisits(pages, least)
    rows.mapInArrow(run, "value string").write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", ROWS).text(path)


_RECORD = "archive string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string"


def read(spark, path: str) -> DataFrame:
    """One row per record of the archives under ``path``."""
    names = [x.split()[0] for x in _RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    schema = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in _RECORD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                held, size, opener = [], 0, zstandard.ZstdDecompressor()
                try:
                    for i, (magic, frame) in enumerate(frames(memoryview(content.as_buffer()))):
                        if magic == DICTIONARY_MAGIC and i == 0:
                            if len(frame) > 8:
                                opener = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(opened(bytes(frame[8:]))))
                        if magic != FRAME_MAGIC:
                            continue
                        try:
                            row = parse(opener.decompressobj().decompress(frame))
                        except (ValueError, zstandard.ZstdError) as e:
                            row = {"error": str(e)}
                        held.append({"archive": archive, **row})
                        size += len(row.get("payload") or b"")
                        if size >= 8 << 20:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                except (ValueError, zstandard.ZstdError) as e:  # what follows in this archive cannot be found
                    held.append({"archive": archive, "error": str(e)})
                if held:
                    yield pa.RecordBatch.from_pylist([dict.fromkeys(names) | r for r in held], schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, _RECORD)


def op7_warc(spark, sf_dir: str) -> DataFrame:
    path = f"{common.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(common.table(spark, sf_dir, "pages"), path)
    rows = read(spark, path)
    # an unreadable record must not vanish from the result
    rows = rows.where(F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad record: "), "error")).cast("boolean")).otherwise(True))
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h)) AS n, sha256(h) AS d FROM p),
f AS (SELECT d, min(page_id) AS f FROM q WHERE n >= 100 GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, q.d AS payload_digest,
  CASE WHEN f IS NULL OR f = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN f <> page_id THEN f END AS refers_to
FROM q LEFT JOIN f ON q.d = f.d
"""
