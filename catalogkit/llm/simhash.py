"""Near-duplicate documents by SimHash, compared in bit-sliced form.

Fingerprints are 64-bit majorities over the hashes of word shingles. Two
fingerprints within ``radius`` bits agree on at least ``m - radius`` of ``m``
bit ranges, so each choice of that many ranges is a table in which linked
fingerprints share a key (an exact filter). Rows that share a key are compared
in blocks: each bit of the fingerprints is a vertical plane over the rows,
planes are combined with their shifted selves, and carry-save counters hold 64
distances at a time. Words of the block whose distances all exceed the radius
are abandoned early.

A block returns only a star per local component, never all of its pairs, and a
key with many fingerprints is dealt out to cells of bounded size; one with very
many first goes under finer keys, which is exact too.

Defined results: null and blank texts have fingerprint zero and are linked to
each other; exact copies share one fingerprint and so one component;
``component_id`` is the smallest non-null doc_id reachable (null if there is
none); repeated rows stay; an empty table gives an empty result; other columns
are ignored. ``keep_one`` judges rows and not ids: one id may stand on several
texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .components import components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Shingles whose bits are counted at a time.
_CHUNK = 1 << 16
#: Rows of one cell of a frequent key, and rows compared in one block.
CELL = 1 << 15
BLOCK = 1 << 17
#: Mean rows of a key from which the tables take more bit ranges.
PER_KEY = 4096


def fingerprint(text: bytes, size: int = 4, seed: int = 42) -> int:
    """The SimHash of one text: a bit is 1 if set in over half the shingle hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(size, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), _CHUNK):
        a, b = starts[at : at + _CHUNK].tolist(), ends[at : at + _CHUNK].tolist()
        h = np.array([digest(line[i:j], seed) for i, j in zip(a, b)], np.dtype("<u8"))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, mark, fp): the fingerprint as a signed long; ``mark``, a hash of the text, tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", size, seed) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "mark", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark(F.col("text")).alias("mark"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, mark long, fp long")


def _mark(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _planes(fp: np.ndarray) -> np.ndarray:
    """64 vertical bit planes, each packed to words, with a spare zero word at the end."""
    words = (len(fp) + 63) // 64
    out = np.zeros((64, words + 1), np.uint64)
    bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")
    out.view(np.uint8)[:, : packed.shape[1]] = packed
    return out


def _packed(mask: np.ndarray) -> np.ndarray:
    out = np.zeros((len(mask) + 63) // 64, np.uint64)
    packed = np.packbits(mask, bitorder="little")
    out.view(np.uint8)[: len(packed)] = packed
    return out


def _near(planes: np.ndarray, alive: np.ndarray, shift: int, radius: int) -> np.ndarray:
    """Rows i (packed in ``alive``) whose distance to row i + shift is at most ``radius`` (< 8)."""
    far, bit = np.uint64(shift % 64), shift // 64
    back = np.uint64(64) - far
    words = np.flatnonzero(alive)
    live = alive[words]
    one, two, four, more = (np.zeros(len(words), np.uint64) for _ in range(4))
    last = planes.shape[1] - 1

    def differ(p: np.ndarray) -> np.ndarray:
        own = p[words]
        next_ = p[np.minimum(words + bit, last)]
        if far:
            next_ = (next_ >> far) | (p[np.minimum(words + bit + 1, last)] << back)
        return own ^ next_

    for at in range(0, 64, 2):
        x, y = differ(planes[at]), differ(planes[at + 1])
        # carry-save: one + x + y leaves a sum and a carry
        half = one ^ x
        carry = (one & x) | (half & y)
        one = half ^ y
        next_carry = two & carry
        two = two ^ carry
        more |= four & next_carry
        four = four ^ next_carry
        if at % 8 == 6:
            over, equal = more.copy(), ~more
            for plane, wanted in ((four, radius & 4), (two, radius & 2), (one, radius & 1)):
                if wanted:
                    equal &= plane
                else:
                    over |= equal & plane
                    equal &= ~plane
            live = live & ~over
            keep = np.flatnonzero(live)
            if not len(keep):
                return keep
            if len(keep) < 0.7 * len(words):
                words, live, one, two, four, more = (a[keep] for a in (words, live, one, two, four, more))
    lanes = np.flatnonzero(np.unpackbits(live.view(np.uint8), bitorder="little"))
    return words[lanes // 64] * 64 + lanes % 64


def local_links(group: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, smallest member) of the components that links within a group form.

    ``group`` is ascending; ``fp`` is uint64. Rows are compared with those
    ``shift`` places on, for every shift up to the largest group.
    """
    n = len(fp)
    ends = np.searchsorted(group, group, side="right")
    after = ends - np.arange(n) - 1
    root = np.arange(n)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    sizes = ends - np.searchsorted(group, group, side="left")
    rows, shift = np.arange(n), 1
    packed_for = -1
    planes = np.zeros((64, 1), np.uint64)
    while True:
        kept = rows[sizes[rows] > shift]
        if not len(kept):
            break
        if packed_for < 0 or len(kept) < 0.7 * packed_for:
            rows, packed_for = kept, len(kept)
            planes = _planes(np.ascontiguousarray(fp[rows]))
        i = _near(planes, _packed(after[rows] >= shift), shift, radius)
        if len(i):
            a, b = rows[i], rows[i] + shift
            while not np.array_equal(flat := root[root], root):
                root = flat
            new = root[a] != root[b]
            for x, y in zip(a[new].tolist(), b[new].tolist()):
                x, y = find(x), find(y)
                if x != y:
                    root[max(x, y)] = min(x, y)
        shift += 1
    while not np.array_equal(flat := root[root], root):
        root = flat
    order = np.lexsort((fp.view(np.int64), root))
    first = np.concatenate(([True], root[order][1:] != root[order][:-1]))
    low = np.empty(n, np.int64)
    low[order] = fp.view(np.int64)[order][np.maximum.accumulate(np.where(first, np.arange(n), 0))]
    linked = low != fp.view(np.int64)
    return fp.view(np.int64)[linked], low[linked]


def _compare(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compare(rows: np.ndarray) -> pa.RecordBatch:
            change = np.any(rows[1:, :4] != rows[:-1, :4], axis=1)
            group = np.concatenate(([0], np.cumsum(change)))
            u, v = local_links(group, np.ascontiguousarray(rows[:, 4]).view(np.uint64), radius)
            return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

        count = 0
        for batch in batches:
            rows = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)], axis=1)
            if not len(rows):
                continue
            held.append(rows)
            count += len(rows)
            if count >= BLOCK:
                rows = np.concatenate(held)
                change = np.flatnonzero(np.any(rows[1:, :4] != rows[:-1, :4], axis=1))
                end = change[-1] + 1 if len(change) else 0
                if end:
                    yield compare(rows[:end])
                held, count = [rows[end:]], len(rows) - end
        if count:
            yield compare(np.concatenate(held))

    return run


def _mask(ranges: tuple[tuple[int, int], ...]) -> int:
    return sum(((1 << width) - 1) << at for at, width in ranges)


def tables_for(n: int, radius: int) -> list[tuple[int, list[int]]]:
    """For each table the bits of its key, enough for ``n`` fingerprints, and the bits of its finer keys.

    Of m bit ranges a table takes m - radius. The ranges it leaves are halved,
    and a finer key adds as many halves as there are ranges left: fingerprints
    that are linked and share the key also share one of those.
    """
    m = radius + 1
    while m < radius + 4 and n > PER_KEY * 2 ** (64 * (m - radius) // m):
        m += 1
    edges = [64 * i // m for i in range(m + 1)]
    ranges = [(a, b - a) for a, b in zip(edges, edges[1:])]
    out = []
    for chosen in combinations(ranges, m - radius):
        halves = [h for at, width in ranges if (at, width) not in chosen for h in ((at, width // 2), (at + width // 2, width - width // 2))]
        own = _mask(chosen)
        out.append((own, [own | _mask(c) for c in combinations(halves, radius)]))
    return out


def _signed(bits: int):
    return F.lit(bits - (1 << 64) if bits >> 63 else bits).cast("long")


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """Links (u, v) that connect all fingerprints ``fp`` within ``radius`` bits (at most 7); not all pairs."""
    if not 0 <= radius <= 7:
        raise ValueError("the counters hold distances up to 7")
    tables = tables_for(distinct.count(), radius)
    masked = F.posexplode(F.array(*[F.col("fp").bitwiseAND(_signed(own)) for own, _ in tables])).alias("t", "key")
    rows = distinct.select("fp", masked)
    finer = len(tables[0][1])
    hot = common.cut(rows.groupBy("t", "key").count().where(F.col("count") > CELL))
    if hot.isEmpty():
        rows = rows.select("t", "key", F.lit(0).alias("a"), F.lit(0).alias("b"), "fp")
    else:
        rows = rows.join(common.small_or_not(hot), ["t", "key"], "left")
        very = F.coalesce(F.col("count") * 2 > finer * CELL, F.lit(False))
        if not hot.where(very).isEmpty():
            # where cells would repeat a row more often than finer keys do, those are taken
            more = rows.where(very).select(F.col("t").alias("table"), "fp").mapInArrow(_finer(tables), "t int, key long, fp long")
            counts = common.cut(more.groupBy("t", "key").count().where(F.col("count") > CELL))
            rows = rows.where(~very).unionByName(more.join(common.small_or_not(counts), ["t", "key"], "left"))
        # two chunks of half a cell meet in each cell
        rows = rows.withColumn("k", F.coalesce(F.ceil(F.col("count") * 2 / CELL), F.lit(1)))
        own = F.pmod(F.xxhash64("fp"), F.col("k"))
        rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        rows = rows.select("t", "key", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), "fp")
    dealt = rows.repartition("t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b")
    return dealt.mapInArrow(_compare(radius), "u long, v long")


def _finer(tables: list[tuple[int, list[int]]]):
    """Each row of (table, fp) under all finer keys of its table."""
    bits = np.array([finer for _, finer in tables], np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table, fp = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            keys = fp.view(np.uint64)[:, None] & bits[table]
            t = len(bits) + table[:, None].astype(np.int32) * bits.shape[1] + np.arange(bits.shape[1], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(t.ravel().astype(np.int32)), pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, bits.shape[1]))], ["t", "key", "fp"])

    return run


def _grouped(docs: DataFrame, size: int, radius: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows' fingerprints, and (fp, component_id, first) of each: ``first`` is the component's first (id, mark), nulls last."""
    fps = common.cut(fingerprints(docs, size, seed))
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")
    distinct = common.cut(fps.groupBy("fp").agg(F.min(place).alias("first")))
    roots = components(links(distinct.select("fp"), radius))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    rooted = common.cut(rooted.select("fp", "first", "root"))
    lowest = rooted.where("root is not null").groupBy("root").agg(F.min("first").alias("lowest"))
    first = F.coalesce("lowest", "first")
    return fps, rooted.join(lowest, "root", "left").select("fp", first["doc_id"].alias("component_id"), first.alias("first"))


def near_duplicates(docs: DataFrame, size: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp, component_id) of every row of ``docs``."""
    fps, of_fp = _grouped(docs, size, radius, seed)
    return fps.join(of_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, size: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row of each component, with all its columns: that with the smallest doc_id, rows without one last.

    Of rows with that doc_id in the component the first by a hash of the text
    stays. Rows that repeat a kept doc_id and text are one; which of them stays
    follows a hash of their other columns.
    """
    fps, of_fp = _grouped(docs, size, radius, seed)
    keys = fps.groupBy("doc_id", "mark", "fp").agg(F.count("*").alias("n")).join(of_fp, "fp")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("mark") == F.col("first.mark"))
    keys = common.cut(keys.select("doc_id", "mark", "n", stays.alias("stays")))
    # what goes is the smaller side: while it is small the texts stay where they are
    gone = keys.where(~F.col("stays") | (F.col("n") > 1)).select(F.col("doc_id").alias("gone_id"), F.col("mark").alias("gone_mark"), "stays")
    rows = docs.select(F.struct("*").alias("row"))
    own = F.col("row.doc_id").cast("long").eqNullSafe(F.col("gone_id")) & (_mark(F.col("row.text")) == F.col("gone_mark"))
    out = rows.join(common.small_or_not(gone), own, "left").select("row", "stays")
    once = out.where("stays is null").select("row.*")
    if keys.where("stays and n > 1").isEmpty():
        return once
    plain = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    repeated = out.where("stays").withColumns({"id": F.col("row.doc_id"), "mark": _mark(F.col("row.text"))})
    one = repeated.groupBy("id", "mark").agg(F.min_by("row", F.xxhash64(*[F.col("row")[c] for c in plain])).alias("row"))
    return once.unionByName(one.select("row.*"))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
