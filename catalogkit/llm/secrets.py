"""Secret scans with a trigram index.

Each rule is a regular expression. Its syntax tree gives a Boolean query over
trigrams that every match must contain. Documents are indexed in blocks: for
each trigram that some rule asks for, a posting list of the block's documents
that hold it (letters of A-Z lower-cased). Posting lists are united and
intersected by the query, and only the candidates are verified with the
expression. A rule without mandatory trigrams scans every document.

Blocks stay where Spark reads them: a text is read once and never shuffled.

Defined results: a null text counts as empty and has no spans; matches are
leftmost and non-overlapping per kind; offsets are code points, end exclusive;
repeated rows are scanned alike; empty tables give empty results; other columns
are carried along or ignored.
"""

from __future__ import annotations

import re
import re._parser as regex_tree
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .arrowtext import code_points, joined, map_rows, texts

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Literal strings that a query follows at once; beyond it the strings so far are turned into trigrams.
_MOST_STRINGS = 64
#: A class of more characters than this gives no trigrams.
_MOST_CHARS = 8


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` whose ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


BASE_RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
)
RULES = (
    *BASE_RULES,
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)

#: A query is a set of alternatives, each a set of trigrams that must all occur; None: no condition.
Query = frozenset[frozenset[bytes]] | None


def _simplest(alternatives: set[frozenset[bytes]]) -> Query:
    if frozenset() in alternatives:
        return None
    return frozenset(a for a in alternatives if not any(b < a for b in alternatives))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    if len(a) * len(b) > 256:  # either is a valid condition; keep the shorter
        return min(a, b, key=len)
    return _simplest({x | y for x in a for y in b})


def _of_strings(strings: set[bytes]) -> Query:
    return _simplest({frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings})


def _crossed(a: set[bytes], b: set[bytes]) -> set[bytes] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= _MOST_STRINGS else None


def _walk(nodes) -> tuple[set[bytes] | None, Query]:
    """The exact (lower-case) strings of a sequence if they are few, and the query of its matches."""
    strings: set[bytes] | None = {b""}
    whole, query = True, None

    def flush(new: set[bytes]) -> None:
        nonlocal strings, query
        query = _both(query, _of_strings(strings))
        strings = new

    for op, arg in nodes:
        name, exact, inner = str(op), None, None
        if name == "LITERAL":
            exact = {chr(arg).encode().translate(_LOWER)}
        elif name == "IN":
            chars = [range(a[0], a[1] + 1) if str(o) == "RANGE" else [a] for o, a in arg if str(o) in ("RANGE", "LITERAL")]
            flat = {chr(c).encode().translate(_LOWER) for r in chars for c in r} if len(chars) == len(arg) else set()
            exact = flat if 0 < len(flat) <= _MOST_CHARS else None
        elif name == "SUBPATTERN":
            exact, inner = _walk(arg[-1])
        elif name == "BRANCH":
            parts = [_walk(p) for p in arg[1]]
            exact = set().union(*(p[0] for p in parts)) if all(p[0] is not None for p in parts) else None
            queries = [p[1] if p[0] is None else _of_strings(p[0]) for p in parts]
            inner = None if any(q is None for q in queries) else _simplest(set().union(*queries))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, sub = arg
            sub_exact, sub_query = _walk(sub)
            if (low, high) == (0, 1) and sub_exact is not None:
                exact = sub_exact | {b""}
            elif low and sub_exact is not None and len(sub_exact) ** low <= _MOST_STRINGS:
                flush_to = sub_exact
                for _ in range(low - 1):
                    flush_to = _crossed(flush_to, sub_exact)
                if low == high:
                    exact = flush_to
                else:
                    inner = _of_strings(flush_to)
            elif low:
                inner = sub_query
        elif name == "AT":
            continue
        if exact is not None and (new := _crossed(strings, exact)) is not None:
            strings = new
            continue
        whole = False
        flush({b""} if exact is None else exact)
        query = _both(query, inner)
    if whole:
        return strings, _of_strings(strings)
    return None, _both(query, _of_strings(strings))


def trigram_query(pattern: str) -> Query:
    """The alternatives of trigrams that a match of ``pattern`` contains; None if it has no mandatory ones."""
    return _walk(regex_tree.parse(pattern))[1]


class Index:
    """Posting lists of one block of texts, for the trigrams that ``queries`` ask for."""

    def __init__(self, queries: list[Query]):
        self.grams = sorted({g for q in queries if q is not None for a in q for g in a})
        self.ids = np.full(1 << 24, -1, np.int16)
        for i, g in enumerate(self.grams):
            self.ids[int.from_bytes(g, "big")] = i

    def postings(self, buffer: bytes, edges: np.ndarray) -> dict[bytes, np.ndarray]:
        """Rows (ascending) that hold each trigram; text i is buffer[edges[i]:edges[i + 1]]."""
        found: list[np.ndarray] = []
        low = np.frombuffer(buffer.translate(_LOWER), np.uint8)
        rows, step = len(edges) - 1, 1 << 20
        for at in range(0, max(0, len(low) - 2), step):
            part = low[at : at + step + 2].astype(np.int32)
            gram = self.ids[(part[:-2] << 16) | (part[1:-1] << 8) | part[2:]]
            hit = np.flatnonzero(gram >= 0)
            place = hit + at
            row = np.searchsorted(edges, place, side="right") - 1
            inside = place + 2 < edges[row + 1]
            found.append(np.unique(gram[hit[inside]].astype(np.int64) * rows + row[inside]))
        keys = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        cuts = np.searchsorted(keys, np.arange(len(self.grams) + 1) * max(rows, 1))
        return {g: keys[cuts[i] : cuts[i + 1]] - i * rows for i, g in enumerate(self.grams)}


def candidates(query: Query, postings: dict[bytes, np.ndarray], rows: int) -> np.ndarray:
    """Rows of a block that satisfy a query."""
    if query is None:
        return np.arange(rows)
    out = np.zeros(0, np.int64)
    for grams in query:
        lists = sorted((postings[g] for g in grams), key=len)
        hit = lists[0]
        for other in lists[1:]:
            if not len(hit):
                break
            hit = np.intersect1d(hit, other, assume_unique=True)
        out = np.union1d(out, hit)
    return out.astype(np.int64)


class Scanner:
    """All rules over one block of texts."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern.encode())) for r in rules]
        self.queries = [trigram_query(r.pattern) for r in rules]
        self.index = Index(self.queries)

    def spans(self, batch: pa.RecordBatch, column: str) -> list[list[tuple[int, int, str]]]:
        """Per row, (start, end, kind) in bytes, by start and then in the order of the rules."""
        buffer, edges = joined(batch, column)
        rows = len(edges) - 1
        postings = self.index.postings(buffer, edges)
        found: list[list[tuple[int, int, int]]] = [[] for _ in range(rows)]
        for k, ((rule, regex), query) in enumerate(zip(self.rules, self.queries)):
            for i in candidates(query, postings, rows).tolist():
                for m in regex.finditer(buffer, edges[i], edges[i + 1]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        found[i].append((m.start() - int(edges[i]), k, m.end() - int(edges[i])))
        return [[(s, e, self.rules[k][0].kind) for s, k, e in sorted(f)] for f in found]


_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document: doc_id and spans, an array of (kind, start, end) in code points."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scanners: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not scanners:
            scanners.append(Scanner(rules))
        out = []
        for text, spans in zip(texts(batch, "text"), scanners[0].spans(batch, "text")):
            before = code_points(text) if spans else None
            out.append([{"kind": k, "start": int(before[s]), "end": int(before[e])} for s, e, k in spans])
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, _SPAN)], ["doc_id", "spans"])

    return map_rows(rows, "text", run, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[REDACTED]") -> DataFrame:
    """``docs`` with every found span of ``text`` replaced by ``mark``; overlapping spans are one.

    Every column and row stays; null texts stay null.
    """
    at = docs.columns.index("text")
    scanners: list[Scanner] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not scanners:
            scanners.append(Scanner(rules))
        col = batch.column(at)
        found = scanners[0].spans(batch, "text")
        if not any(found):
            return batch
        out = []
        for text, valid, spans in zip(texts(batch, "text"), col.is_valid().to_pylist(), found):
            parts, done = [], 0
            for s, e, _ in spans:
                if s >= done:
                    parts += [text[done:s], mark.encode()]
                done = max(done, e)
            out.append(b"".join([*parts, text[done:]]) if valid else None)
        new = pa.array(out, pa.binary()).cast(col.type)
        return pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], schema=batch.schema)

    return map_rows(docs, "text", run, docs.schema)


def op3_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES], F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans")
    )


def _op3_sql() -> str:
    """Matches and the pieces between them give the places of all matches."""
    letters = {"i": "password|passwd|secret|token|api_?key"}
    keyword = re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", letters["i"])
    patterns = {
        "assign": rf"""(?:{keyword})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
        "access": r"AKIA[A-Z0-9]+", "hex": r"[0-9a-f]{32,}",
        "github": r"gh[oprsu]_[A-Za-z0-9]{36,}", "slack": r"xox[abprs]-[A-Za-z0-9-]{10,}", "private_key": r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----",
    }
    least = {"assign": (1, 8), "access": (0, 16), "hex": (0, 32)}
    parts = []
    for k, (kind, p) in enumerate(patterns.items()):
        group, n = least.get(kind, (0, 1))
        parts.append(f"""
  SELECT doc_id, '{kind}' AS kind, {k} AS k, s, s + length(m) AS e FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(gs) AS g,
      unnest(list_transform(range(1, len(ms) + 1), lambda i: CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT))) AS s
    FROM (SELECT doc_id, regexp_extract_all(t, '{p}') AS ms, regexp_extract_all(t, '{p}', {group}) AS gs, regexp_split_to_array(t, '{p}') AS ps FROM d))
  WHERE length(g) >= {n}""")
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
a AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex,
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE k < 3) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans
  FROM f GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (doc_id)
"""


OP3_SQL = _op3_sql()
