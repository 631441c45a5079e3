"""Exact removal of repeated byte strings by distributed prefix doubling.

A byte is removed if it is covered by a string of ``length`` bytes that also
starts in a document with a smaller doc_id. Suffixes are ranked by their first
1, 2, 4, ... bytes: the rank of 2k bytes at a position is the pair of the ranks
of k bytes there and k bytes on. Ranks are names (64-bit mixes of the pair), so
that the steps up to ``ANCHOR`` bytes need no exchange. Then Spark deals the
names out and sorts them, positions whose name no other document shares drop
out as unique, and the rest are paired with the rank ANCHOR bytes further on,
past the threshold, dealt and sorted again.

Ranking every position would shuffle some 30 bytes for each byte of text. So
the first exchange carries one position per window: in each string of
``length`` bytes the anchor is the one with the smallest ANCHOR-byte name, which
equal strings share wherever they are. Windows with the same anchor name that
follow each other form a segment. Segments equal to one in a smaller document
are settled at once; segments that share an anchor with a different segment are
ranked again window by window.

Texts are packed into slices and kept in a table bucketed by slice, so that no
exchange ever moves text. What is dealt out are packed arrays of names, one row
per slice and bucket, each name once per slice.

Defined results: a null text is empty; a text shorter than ``length`` is kept;
rows with the same doc_id never remove each other's bytes; a null doc_id counts
as larger than all others; repeated strings within a document stay; an empty
table gives an empty result; other columns are ignored. Names are compared with
over 100 bits for segments and 64 bits and the bucket for windows.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .arrowtext import slices

LENGTH = 50
#: Bytes that the first exchange ranks.
ANCHOR = 24
#: Text of a slice, and of the slices that one task reads.
SLICE, TASK = 2 << 20, 16 << 20
#: Positions ranked at a time.
CHUNK = 1 << 19
#: Names of one bucket, about.
NAMES = 1_000_000
#: Segments with one anchor in a slice from which the slice sends their windows without comparing segments.
HOT = 64

_NULL_ID = np.iinfo(np.int64).max
_A, _B, _C = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0x9E3779B97F4A7C15)
_BYTES = np.random.default_rng(20).integers(1, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_HOT_NAME = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x *= _C
    x ^= x >> np.uint64(29)
    return x


def names(data: np.ndarray, length: int) -> np.ndarray:
    """The name of the ``length`` bytes at each position, by doubling."""
    n, h, out, done, rest = 1, _BYTES[data], None, 0, length
    while True:
        if rest & 1:
            if out is None:
                out, done = h, n
            else:
                m = len(data) - (done + n) + 1
                out, done = _mixed(out[:m] * _A + h[done : done + m]), done + n
        rest >>= 1
        if not rest:
            return out
        h = _mixed(h[:-n] * _A + h[n:])
        n *= 2


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    n = 1
    while 2 * n <= width:
        h = np.minimum(h[:-n], h[n:])
        n *= 2
    return h if n == width else np.minimum(h[: len(h) - (width - n)], h[width - n :])


class Slice:
    """The windows of a run of documents: segments, and the names of their windows."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, length: int, anchor: int):
        self.data, self.length, self.anchor = data, length, anchor
        self.edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(lengths)))
        starts, runs, anchors, segments, chunks = [], [], [], [], []
        self.held: dict[int, np.ndarray] = {}
        for c, at in enumerate(range(0, max(0, len(data) - length + 1), CHUNK)):
            ranks, low = self._ranks(at)
            n = len(low)
            inside = np.flatnonzero(self._inside(at, n))
            if not len(inside):
                continue
            low = low[inside]
            new = np.concatenate(([True], (low[1:] != low[:-1]) | (np.diff(inside) > 1)))
            first = np.flatnonzero(new)
            run = np.diff(np.append(first, len(inside)))
            place = np.arange(len(inside)) - np.repeat(first, run)
            name = _mixed(np.add.reduceat(_mixed(ranks[inside]) * (2 * place + 1).astype(np.uint64), first) + run.astype(np.uint64))
            starts.append(inside[first] + at)
            runs.append(run)
            anchors.append(_mixed(low[first] + _C))
            segments.append(name)
            chunks.append(np.full(len(first), c))
        join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        self.start, self.run, self.chunk = join(starts, np.int64), join(runs, np.int64), join(chunks, np.int64)
        self.name, self.segment = join(anchors, np.uint64), join(segments, np.uint64)
        self.doc = np.searchsorted(self.edges, self.start, side="right") - 1

    def _inside(self, at: int, n: int) -> np.ndarray:
        """Windows from ``at`` that lie within one document."""
        bad = np.zeros(n + 1, np.int64)
        ends = self.edges[1:]
        ends = ends[(ends > at) & (ends < at + n + self.length)]
        np.add.at(bad, np.clip(ends - self.length + 1 - at, 0, n), 1)
        np.add.at(bad, np.clip(ends - at, 0, n), -1)
        return np.cumsum(bad[:n]) == 0

    def _ranks(self, at: int) -> tuple[np.ndarray, np.ndarray]:
        """Window names, and their anchors' names, of the windows from ``at``."""
        part = self.data[at : at + CHUNK + self.length - 1]
        h = names(part, self.anchor)
        n = len(part) - self.length + 1
        off = self.length - self.anchor
        if self.anchor * 2 >= self.length:
            ranks = _mixed(h[:n] * _B + h[off : off + n])
        else:
            ranks = names(part, self.length)
        if len(self.data) <= 4 * SLICE:
            self.held[at // CHUNK] = ranks
        return ranks, _lowest(h, off + 1)

    def window_names(self, c: int) -> np.ndarray:
        return self.held[c] if c in self.held else self._ranks(c * CHUNK)[0]


def _packed(values: np.ndarray, width: int) -> np.ndarray:
    """The low ``width`` bytes of each 64-bit value, as rows of bytes."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width])


def _unpacked(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, : raw.shape[1]] = raw
    return out.view("<u8").ravel()


def _groups(keys: np.ndarray, n: int) -> np.ndarray:
    return (keys % np.uint64(n)).astype(np.int64)


def _distinct(anchor: np.ndarray, segment: np.ndarray, doc_id: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows with the smallest doc_id of each (anchor, segment), and for each row the place of its group's row."""
    order = np.lexsort((doc_id, segment, anchor))
    a, s = anchor[order], segment[order]
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (s[1:] != s[:-1])
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return order[new], group


class Entries:
    """What a slice sends in the first exchange: distinct (anchor, segment) with the smallest doc_id.

    Segments of a hot anchor are not sent; the anchor is, once, under a name of its own.
    """

    def __init__(self, cut: Slice, doc_ids: np.ndarray, buckets: int):
        self.cut, self.ids = cut, doc_ids[cut.doc] if len(cut.doc) else np.zeros(0, np.int64)
        first, self.group = _distinct(cut.name, cut.segment, self.ids)
        anchors, of, count = np.unique(cut.name[first], return_inverse=True, return_counts=True)
        self.hot = (count >= HOT)[of] if len(first) else np.zeros(0, bool)
        cold = np.flatnonzero(~self.hot)
        hot_anchor = anchors[count >= HOT]
        hot_id = np.full(len(anchors), _NULL_ID)
        np.minimum.at(hot_id, of, self.ids[first])
        self.anchor = np.concatenate((cut.name[first][cold], hot_anchor))
        self.segment = np.concatenate((cut.segment[first][cold], np.full(len(hot_anchor), _HOT_NAME)))
        self.doc_id = np.concatenate((self.ids[first][cold], hot_id[count >= HOT]))
        self.of_group = np.full(len(first), -1)
        self.of_group[cold] = np.arange(len(cold))
        self.low = self.ids[first]
        bucket = _groups(self.anchor, buckets)
        # by bucket, and within it by anchor
        self.order = np.lexsort((self.segment, self.anchor, bucket))
        self.bucket = bucket[self.order]

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        cuts = np.flatnonzero(np.concatenate(([True], self.bucket[1:] != self.bucket[:-1]))) if len(self.bucket) else []
        for i, at in enumerate(cuts):
            yield int(self.bucket[at]), self.order[at : cuts[i + 1] if i + 1 < len(cuts) else len(self.order)]

    def replied(self, replies) -> tuple[np.ndarray, np.ndarray]:
        """For each segment of the slice: settled as repeated, to be ranked window by window."""
        repeated, opened = (np.zeros(len(self.anchor), bool) for _ in range(2))
        by_bucket = dict(self.parts())
        for r in replies or ():
            own = by_bucket[r["bucket"]]
            repeated[own[np.frombuffer(r["repeated"], "<u4")]] = True
            opened[own[np.frombuffer(r["opened"], "<u4")]] = True
        entry = self.of_group
        of_repeated = np.where(entry >= 0, repeated[entry], False) if len(repeated) else np.zeros(len(entry), bool)
        of_opened = np.where(entry >= 0, opened[entry], self.hot) if len(opened) else self.hot.copy()
        later = self.ids > self.low[self.group] if len(self.group) else np.zeros(0, bool)
        settled = of_repeated[self.group] | later if len(self.group) else later
        return settled, ~settled & of_opened[self.group] if len(self.group) else later


class Windows:
    """The windows of opened segments: distinct names with the smallest doc_id of the slice."""

    def __init__(self, entries: Entries, opened: np.ndarray, buckets: int):
        cut = entries.cut
        which = np.flatnonzero(opened)
        run = cut.run[which]
        total = int(run.sum())
        self.place = np.repeat(cut.start[which], run) + np.arange(total) - np.repeat(np.cumsum(run) - run, run)
        self.id = np.repeat(entries.ids[which], run)
        name = np.empty(total, np.uint64)
        chunk = np.repeat(cut.chunk[which], run)
        for c in np.unique(chunk):
            mine = chunk == c
            name[mine] = cut.window_names(int(c))[self.place[mine] - c * CHUNK]
        order = np.lexsort((self.id, name))
        new = np.ones(total, bool)
        new[1:] = name[order][1:] != name[order][:-1]
        self.group = np.empty(total, np.int64)
        self.group[order] = np.cumsum(new) - 1
        first = order[new]
        self.name, self.doc_id = name[first], self.id[first]
        bucket = _groups(self.name, buckets)
        self.order = np.argsort(bucket, kind="stable")
        self.bucket = bucket[self.order]

    parts = Entries.parts

    def repeated(self, replies) -> np.ndarray:
        """Starts of the windows that occur in a smaller document."""
        found = np.zeros(len(self.name), bool)
        by_bucket = dict(self.parts())
        for r in replies or ():
            found[by_bucket[r["bucket"]][np.frombuffer(r["repeated"], "<u4")]] = True
        if not len(self.group):
            return self.place
        return self.place[found[self.group] | (self.id > self.doc_id[self.group])]


_PACKED = "bucket int, slice long, names binary, ids binary, width int"


def _pack(slice_id: int, bucket: int, columns: list[np.ndarray], doc_id: np.ndarray) -> dict:
    """Names end to end and doc_ids as small offsets from the least."""
    low = int(doc_id.min())
    span = int(np.uint64(doc_id.max()) - np.uint64(low)) if low >= 0 else _NULL_ID
    width = 2 if span < 1 << 16 else 4 if span < 1 << 32 else 8
    ids = (doc_id.astype(np.uint64) - np.uint64(low % (1 << 64))).astype(f"<u{width}") if width < 8 else doc_id.astype("<i8")
    head = np.array([low], "<i8").tobytes() if width < 8 else b""
    return {"bucket": bucket, "slice": slice_id, "names": b"".join(c.tobytes() for c in columns), "ids": head + ids.tobytes(), "width": width}


def _ids(raw: bytes, width: int) -> np.ndarray:
    if width == 8:
        return np.frombuffer(raw, "<i8")
    return np.frombuffer(raw, f"<u{width}", offset=8).astype(np.int64) + np.frombuffer(raw, "<i8", 1)[0]


_PACKED_ARROW = pa.schema([("bucket", pa.int32()), ("slice", pa.int64()), ("names", pa.binary()), ("ids", pa.binary()), ("width", pa.int32())])
_REPLY = "slice long, bucket int, repeated binary, opened binary"
_REPLY_ARROW = pa.schema([("slice", pa.int64()), ("bucket", pa.int32()), ("repeated", pa.binary()), ("opened", pa.binary())])


def _gathered(table: pa.Table) -> tuple[list[dict], np.ndarray, np.ndarray]:
    """The packed rows of a bucket, their doc_ids and the row of each."""
    rows = sorted(table.to_pylist(), key=lambda r: r["slice"])
    ids = [_ids(r["ids"], r["width"]) for r in rows]
    return rows, np.concatenate(ids), np.repeat(np.arange(len(rows)), [len(i) for i in ids])


def _answers(rows: list[dict], of: np.ndarray, marks: list[np.ndarray]) -> pa.Table:
    edges = np.searchsorted(of, np.arange(len(rows) + 1))
    out = []
    for i, r in enumerate(rows):
        found = [np.flatnonzero(m[edges[i] : edges[i + 1]]).astype("<u4").tobytes() for m in marks]
        if any(found):
            out.append({"slice": r["slice"], "bucket": r["bucket"], "repeated": found[0], "opened": found[1] if len(found) > 1 else b""})
    return pa.Table.from_pylist(out, _REPLY_ARROW)


def rank_anchors(table: pa.Table) -> pa.Table:
    """Sorts the segments of a bucket of anchors; unique anchors drop out."""
    rows, ids, of = _gathered(table)
    n = [len(_ids(r["ids"], r["width"])) for r in rows]
    anchor = np.concatenate([_unpacked(np.frombuffer(r["names"], np.uint8, 5 * k).reshape(k, 5)) for r, k in zip(rows, n)])
    segment = np.concatenate([np.frombuffer(r["names"], "<u8", k, 5 * k) for r, k in zip(rows, n)])
    order = np.lexsort((ids, segment, anchor))
    a, s, i = anchor[order], segment[order], ids[order]
    new_a = np.concatenate(([True], a[1:] != a[:-1]))
    new_s = new_a | np.concatenate(([True], s[1:] != s[:-1]))
    first = np.flatnonzero(new_s)
    low = np.repeat(i[first], np.diff(np.append(first, len(i))))
    hot = s == _HOT_NAME
    at = np.flatnonzero(new_a)
    width = np.diff(np.append(at, len(a)))
    kinds = np.add.reduceat(new_s.astype(np.int64), at)
    differ = np.minimum.reduceat(low, at) < np.maximum.reduceat(low, at)
    opened = np.repeat((kinds > 1) & (differ | np.logical_or.reduceat(hot, at)), width)
    repeated = (i > low) & ~hot
    back = np.empty(len(order), np.int64)
    back[order] = np.arange(len(order))
    return _answers(rows, of, [repeated[back], (opened & ~repeated & ~hot)[back]])


def rank_windows(table: pa.Table) -> pa.Table:
    """Sorts the windows of a bucket; those with a smaller document's name are repeated."""
    rows, ids, of = _gathered(table)
    name = np.concatenate([np.frombuffer(r["names"], "<u8") for r in rows])
    order = np.lexsort((ids, name))
    first = np.flatnonzero(np.concatenate(([True], name[order][1:] != name[order][:-1])))
    low = np.repeat(ids[order][first], np.diff(np.append(first, len(ids))))
    found = np.empty(len(order), bool)
    found[order] = ids[order] > low
    return _answers(rows, of, [found])


def pack_slices(docs: DataFrame, size: int) -> DataFrame:
    """slice, ids, lengths and data: documents packed to about SLICE bytes, in a table bucketed by slice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ids, lengths, data, held = [], [], [], 0

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"slice": (part << 32) + seq, "ids": ids, "lengths": lengths, "data": b"".join(data)}], schema)

        schema = pa.schema([("slice", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary())])
        for batch in slices(batches, "data"):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                ids.append(doc_id)
                lengths.append(len(raw))
                data.append(raw)
                held += len(raw)
                if held >= SLICE:
                    yield row()
                    ids, lengths, data, held, seq = [], [], [], 0, seq + 1
        if ids:
            yield row()

    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("data"))
    packed = rows.mapInArrow(run, "slice long, ids array<long>, lengths array<long>, data binary")
    name = f"slices_{uuid.uuid4().hex}"
    writer = packed.write.format("parquet").option("compression", "zstd").option("path", f"{common.shared_dir(spark)}/{name}")
    writer.bucketBy(max(1, math.ceil(size / TASK)), "slice").saveAsTable(name)
    return spark.table(name)


def repeats(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR) -> DataFrame:
    """Per row of ``docs``: doc_id, n_bytes, spans (removed byte ranges, end exclusive) and kept (the other bytes)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    table = pack_slices(docs, size)
    buckets = max(1, math.ceil(size / 14 / NAMES))

    def opened(r: dict) -> tuple[Entries, np.ndarray]:
        ids = np.array([_NULL_ID if i is None else i for i in r["ids"]], np.int64)
        cut = Slice(np.frombuffer(r["data"], np.uint8), np.array(r["lengths"], np.int64), length, anchor)
        return Entries(cut, ids, buckets), ids

    def one_by_one(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.slice(i, 1).to_pylist()[0]

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in one_by_one(batches):
            e, _ = opened(r)
            rows = [_pack(r["slice"], b, [_packed(e.anchor[own] >> np.uint64(24), 5), e.segment[own].astype("<u8")], e.doc_id[own]) for b, own in e.parts()]
            yield pa.RecordBatch.from_pylist(rows, _PACKED_ARROW)

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in one_by_one(batches):
            e, _ = opened(r)
            w = Windows(e, e.replied(r["anchors"])[1], buckets)
            rows = [_pack(r["slice"], b, [w.name[own].astype("<u8")], w.doc_id[own]) for b, own in w.parts()]
            yield pa.RecordBatch.from_pylist(rows, _PACKED_ARROW)

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
        for r in one_by_one(batches):
            e, _ = opened(r)
            settled, more = e.replied(r["anchors"])
            cover = np.zeros(len(r["data"]) + 1, np.int32)
            np.add.at(cover, e.cut.start[settled], 1)
            np.add.at(cover, e.cut.start[settled] + e.cut.run[settled] + length - 1, -1)
            starts = Windows(e, more, buckets).repeated(r["windows"])
            np.add.at(cover, starts, 1)
            np.add.at(cover, starts + length, -1)
            gone = np.cumsum(cover[:-1]) > 0
            data, edges, out = np.frombuffer(r["data"], np.uint8), e.cut.edges, []
            for i, doc_id in enumerate(r["ids"]):
                a, b = int(edges[i]), int(edges[i + 1])
                mask = gone[a:b]
                if mask.any():
                    turns = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
                    spans = [{"start": s, "end": t} for s, t in zip(turns[::2].tolist(), turns[1::2].tolist())]
                    out.append({"doc_id": doc_id, "n_bytes": b - a, "spans": spans, "kept": data[a:b][~mask].tobytes()})
                else:
                    out.append({"doc_id": doc_id, "n_bytes": b - a, "spans": [], "kept": r["data"][a:b]})
            yield pa.RecordBatch.from_pylist(out, schema)

    def replies(sent: DataFrame, rank, column: str) -> DataFrame:
        answers = sent.groupBy("bucket").applyInArrow(rank, _REPLY)
        by_slice = answers.groupBy("slice").agg(F.collect_list(F.struct("bucket", "repeated", "opened")).alias(column))
        return common.cut(by_slice).hint("shuffle_hash")

    anchors = replies(table.mapInArrow(send_anchors, _PACKED), rank_anchors, "anchors")
    with_anchors = table.join(anchors, "slice", "left")
    windows = replies(with_anchors.mapInArrow(send_windows, _PACKED), rank_windows, "windows")
    return with_anchors.join(windows, "slice", "left").mapInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op10_suffixes(spark, sf_dir: str) -> DataFrame:
    found = repeats(common.table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
