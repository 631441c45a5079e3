"""Benchmark decontamination with one Aho-Corasick automaton.

Texts are normalised to lower-case words. Every window of ``window`` words of
an item is a pattern. Each benchmark word is given a short code of few letters,
so the automaton of all patterns needs two or three nodes a word and reads each
document once. Matches are word ranges, and word ranges map back to code
points of the original text.

A Python worker builds the automaton once, from a broadcast of the benchmark's
words. A benchmark over a counted bound (of nodes and bytes) is dealt into
parts that keep to it. Each part has its own scan of the documents as a Spark
job, one automaton at a time; only rows with hits leave it, keyed by a digest
of their text, and the hits of a text are united. The results are the same.

Defined results: null and blank texts have no words and are never
contaminated; an item without words has no window; a shorter item is one
window; several rows of one item_id count as one item; a null item_id is named
``null``; repeated documents are judged alike; empty tables give empty results
or no hits; other columns are carried along or ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .arrowtext import code_points, map_rows, texts

WINDOW = 13
#: Nodes of one automaton at most (some 50 bytes each), counted as four for each word of a window, and bytes of benchmark words that it is built from.
MAX_NODES = 6_000_000
MAX_BYTES = 32 << 20
#: Words of an item that are dealt to a part together; neighbours overlap by a window less one word.
PIECE = 4096

_DELIMITERS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_NORMAL = bytes(32 if c in _DELIMITERS else c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_NORMAL).split()


#: Letters of a word's code: few, as the automaton looks a letter up among all that follow a node.
BASE = 16


def _code(n: int, length: int) -> str:
    """The n-th code: its first letter is from one alphabet and the others from another, so that codes only match where words begin."""
    out = ""
    for place in range(length):
        n, digit = divmod(n, BASE)
        out += chr(1 + digit if place == 0 else 1 + BASE + digit)
    return out


class Matcher:
    """The automaton over words: each benchmark word is a code of equal length, any other word a code of zeros."""

    def __init__(self, pieces: list[tuple[str, bytes]], size: int):
        vocabulary = sorted({w for _, line in pieces for w in line.split()})
        self.length = length = next(k for k in range(1, 8) if BASE**k >= max(len(vocabulary), 1))
        self.codes = {w: _code(n, length) for n, w in enumerate(vocabulary)}
        self.other = "\0" * length
        found: dict[tuple[bytes, ...], set[str]] = {}
        for item, line in pieces:
            words = line.split()
            for i in range(max(1, len(words) - size + 1) if words else 0):
                found.setdefault(tuple(words[i : i + size]), set()).add(item)
        self.automaton = ahocorasick.Automaton()
        for words, ids in found.items():
            self.automaton.add_word("".join(map(self.codes.get, words)), (len(words), tuple(sorted(ids))))
        if found:
            self.automaton.make_automaton()

    def hits(self, words: list[bytes]) -> list[tuple[int, int, tuple[str, ...]]]:
        """(first word, end, item ids) of each occurrence of a window."""
        if not words or not len(self.automaton):
            return []
        line = "".join(map(self.codes.get, words, repeat(self.other)))
        ends = [((at + 1) // self.length, n, ids) for at, (n, ids) in self.automaton.iter(line)]
        return [(end - n, end, ids) for end, n, ids in ends]


#: The matcher that this Python worker built last, by the token of its benchmark; ``BUILDS`` counts how often it built one.
_HELD: dict[str, Matcher] = {}
BUILDS = 0


def matcher(token: str, shared: Broadcast, size: int) -> Matcher:
    """This worker's matcher: built once and kept for its next tasks."""
    global BUILDS
    if token not in _HELD:
        _HELD.clear()
        _HELD[token] = Matcher(shared.value, size)
        BUILDS += 1
    return _HELD[token]


def _runs(hits: list[tuple[int, int, tuple[str, ...]]], n: int) -> np.ndarray:
    """The maximal runs of hit words, as rows (first, end)."""
    edge = np.zeros(n + 1, np.int64)
    ends = np.array([h[:2] for h in hits], np.int64)
    np.add.at(edge, ends[:, 0], 1)
    np.add.at(edge, ends[:, 1], -1)
    mask = np.concatenate(([0], (np.cumsum(edge) > 0).astype(np.int8)))
    return np.flatnonzero(np.diff(mask)).reshape(-1, 2)


def judged(text: bytes, m: Matcher) -> tuple[int, int, list[str], list[dict]]:
    """Words, hit words, item ids and spans (words and code points, ends exclusive) of one text."""
    line = text.translate(_NORMAL)
    words = line.split()
    hits = m.hits(words)
    if not hits:
        return len(words), 0, [], []
    runs = _runs(hits, len(words))
    places = [(w.start(), w.end()) for w in re.finditer(rb"[^ ]+", line)]
    before = code_points(text)
    spans = [{"first": a, "last": b, "start": int(before[places[a][0]]), "end": int(before[places[b - 1][1]])} for a, b in runs.tolist()]
    return len(words), int((runs[:, 1] - runs[:, 0]).sum()), sorted({i for h in hits for i in h[2]}), spans


def benchmark_pieces(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item, line, n): normalised words of each item, at most PIECE of them and together all of its windows."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for item, text in zip(batch.column(0).to_pylist(), texts(batch, "text")):
            words = words_of(text)
            for at in range(0, max(len(words) - size, 0) + 1, PIECE):
                part = words[at : at + PIECE + size - 1]
                if part:
                    out.append((item, b" ".join(part), len(part)))
        item, line, n = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(line, pa.binary()), pa.array(n, pa.int64())], ["item", "line", "n"])

    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text")
    return map_rows(rows, "text", run, "item string, line binary, n long").distinct()


def parts_of(pieces: DataFrame, size: int, most: int) -> int:
    """Into how many parts the pieces must be dealt so that each keeps to the bounds."""
    words, size_bytes = pieces.agg(F.sum("n"), F.sum(F.octet_length("line"))).first()
    return max(1, math.ceil((words or 0) * size * 4 / most), math.ceil((size_bytes or 0) / MAX_BYTES))


_SPANS = "array<struct<first:long,last:long,start:long,end:long>>"
_SPAN_TYPE = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "last", "start", "end")]))


def _broadcast(pieces: DataFrame, parts: int, part: int) -> tuple[str, Broadcast]:
    rows = pieces if parts == 1 else pieces.where(F.pmod(F.xxhash64("item", "line"), F.lit(parts)) == part)
    value = sorted((r["item"], bytes(r["line"])) for r in rows.select("item", "line").collect())  # bounded by parts_of
    return common.token(), pieces.sparkSession.sparkContext.broadcast(value)


def _text_key(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)


def _hits_by_part(rows: DataFrame, pieces: DataFrame, size: int, parts: int) -> DataFrame:
    """(key, items, spans, n_hit) of the texts with hits, each part of the benchmark scanned in a job of its own."""
    out = None
    rows = rows.select("text", _text_key(F.col("text")).alias("key"))
    for part in range(parts):
        token, shared = _broadcast(pieces, parts, part)

        def scan(batch: pa.RecordBatch, token=token, shared=shared) -> pa.RecordBatch:
            m = matcher(token, shared, size)
            found = [(key, *judged(text, m)[2:]) for key, text in zip(batch.column(1).to_pylist(), texts(batch, "text"))]
            found = [f for f in found if f[1]]
            key, items, spans = zip(*found) if found else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPAN_TYPE)], ["key", "items", "spans"])

        hits = map_rows(rows, "text", scan, f"key string, items array<string>, spans {_SPANS}")
        # equal texts have equal hits
        hits = common.written(hits.groupBy("key").agg(F.first("items").alias("items"), F.first("spans").alias("spans")))
        shared.unpersist()
        out = hits if out is None else out.unionByName(hits)
    united = out.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    return common.cut(united.mapInArrow(_merge, f"key string, items array<string>, spans {_SPANS}, n_hit long"))


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the sorted spans of each text where they meet, and counts their words."""
    for batch in batches:
        spans, counts = [], []
        for found in batch.column(2).to_pylist():
            out: list[dict] = []
            for x in found:
                if out and x["first"] <= out[-1]["last"]:
                    out[-1].update(last=max(out[-1]["last"], x["last"]), end=max(out[-1]["end"], x["end"]))
                else:
                    out.append(x)
            spans.append(out)
            counts.append(sum(x["last"] - x["first"] for x in out))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, _SPAN_TYPE), pa.array(counts, pa.int64())], ["key", "items", "spans", "n_hit"])


def find(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, most: int = MAX_NODES) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, items (ids of items with occurring windows), spans.

    ``spans`` are runs of hit words: word numbers (first, last) and code points
    of the original text (start, end), ends exclusive.
    """
    pieces = common.cut(benchmark_pieces(benchmark, size))
    parts = parts_of(pieces, size, most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if parts > 1:
        count = F.regexp_count(common.lower_ascii(F.col("text")), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"))
        own = rows.select("doc_id", F.coalesce(count, F.lit(0)).cast("long").alias("n_words"), _text_key(F.col("text")).alias("key"))
        hits = common.small_or_not(_hits_by_part(rows, pieces, size, parts))
        none = [F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("spans", F.array().cast(_SPANS)).alias("spans")]
        return own.join(hits, "key", "left").select("doc_id", "n_words", *none)
    token, shared = _broadcast(pieces, 1, 0)

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = matcher(token, shared, size)
        out = [judged(text, m) for text in texts(batch, "text")]
        n_words, n_hit, ids, spans = zip(*out) if out else ((), (), (), ())
        columns = [batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array(spans, _SPAN_TYPE)]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_hit", "items", "spans"])

    return map_rows(rows, "text", scan, f"doc_id long, n_words long, n_hit long, items array<string>, spans {_SPANS}")


def clean(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, share: int = 20, most: int = MAX_NODES) -> DataFrame:
    """``docs`` without the contaminated rows: those with hits on at least 1/share of their words.

    Every column stays. With one automaton, rows are filtered where they are; a
    benchmark in parts drops the texts that their united hits condemn.
    """
    pieces = common.cut(benchmark_pieces(benchmark, size))
    parts = parts_of(pieces, size, most)
    if parts > 1:
        hits = _hits_by_part(docs.select("text"), pieces, size, parts).select("key", "n_hit")
        wrapped = docs.select(F.struct("*").alias("row"))
        text = F.col("row.text")
        count = F.coalesce(F.regexp_count(common.lower_ascii(text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")), F.lit(0))
        judged_rows = wrapped.join(common.small_or_not(hits), _text_key(text) == F.col("key"), "left")
        return judged_rows.where(F.col("n_hit").isNull() | (share * F.col("n_hit") < count)).select("row.*")
    token, shared = _broadcast(pieces, 1, 0)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = matcher(token, shared, size)
        kept = []
        for text in texts(batch, "text"):
            words = words_of(text)
            hits = m.hits(words)
            runs = _runs(hits, len(words)) if hits else np.zeros((0, 2), np.int64)
            n_hit = int((runs[:, 1] - runs[:, 0]).sum())
            kept.append(not (n_hit > 0 and share * n_hit >= len(words)))
        return batch.filter(pa.array(kept, pa.bool_()))

    return map_rows(docs, "text", keep, docs.schema)


def op2_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bi AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS g FROM bi),
ks AS (SELECT DISTINCT k FROM win),
di AS (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k),
dg AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM di),
hit AS (SELECT dg.doc_id, dg.k, dg.i, win.item_id FROM dg JOIN win ON dg.g = win.g AND dg.k = win.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
