"""Language identification by fusing evidence about one row.

The posterior of a language is proportional to

* the likelihood of the text: a multinomial over hashed byte trigrams, learnt
  from a bounded sample of rows per declared language, tempered because
  neighbouring trigrams are not independent;
* the likelihood of the declared language (markup or metadata), from a
  confusion table of declared against text languages;
* the prior of the row's host: soft counts of text posteriors, smoothed by its
  address suffix, which is smoothed by the whole table. A row's own count is
  taken out of its host's, so no text counts twice.

Beside the languages there is a background, ``und``: trigrams of all languages
flattened towards a uniform spread. It wins texts in no modelled language and
jumbled letters. A declared value has a model from LANGUAGE_ROWS rows on, for
the LANGUAGES most frequent ones; rows declared in a rarer one that the
background wins keep what they declare.

The three tables are grouped aggregates over all rows. A text is read once for
its scores; what follows joins narrow rows, or, where the table of hosts was
counted and is small, is done beside the text by a broadcast of that table.

Defined results: a null or blank text has no text evidence and is judged by
the rest; a row without text, declared language and host neighbours gets the
global prior; null hosts are a host of their own; ties go to the language first
by name; a table without any declared language gives ``und`` with probability
0; repeated rows are judged alike; other columns are carried along by
``keep_identified``.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common
from .arrowtext import joined, map_rows

#: Hash buckets of trigrams.
BUCKETS = 1 << 15
#: Rows per declared language that the text model is fitted on (in expectation).
SAMPLE_ROWS = 2000
#: Rows that a declared value needs for a model of its own, and models at most.
LANGUAGE_ROWS, LANGUAGES = 20, 256
#: The background's name, and the share of a uniform spread in it.
UNKNOWN, UNIFORM = "und", 0.9
#: Trigrams that a text counts for at most: in its posterior, and in the model of what it declares.
EVIDENCE, SHARE_OF_MODEL = 24.0, 2000.0
#: Pseudo-counts of a parent's prior in its child's.
SUFFIX_WEIGHT, HOST_WEIGHT = 20.0, 10.0
#: Posterior below which a row is rejected.
LEAST = 0.5

_LETTERS = bytes(
    32 if c < 128 and not (65 <= c <= 90 or 97 <= c <= 122) else c + 32 if 65 <= c <= 90 else c for c in range(256)
)
_HIDDEN = [(end, re.compile(rb"(?is)" + start + rb".*?" + end)) for start, end in ((rb"<!--", rb"-->"), (rb"<script\b", rb"</script"), (rb"<style\b", rb"</style"))]
_TAG = re.compile(rb"<[^<>]*>|&[A-Za-z]+;")


def visible(html: bytes) -> bytes:
    """A page's text: markup, scripts, styles and comments replaced by blanks; enough for trigram counts.

    An opening is only sought before the last closing of its kind, so unclosed
    ones cost no second look at the rest.
    """
    for end, rule in _HIDDEN:
        last = html.lower().rfind(end) + len(end)
        if last >= len(end):
            html = rule.sub(b" ", html[:last]) + html[last:]
    return _TAG.sub(b" ", html)


def _trigrams(batch: pa.RecordBatch, column: str, markup: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of the column's texts and the row of each; runs of non-letters are skipped."""
    buffer, edges = joined(batch, column)
    if markup:
        parts = [visible(buffer[a:b]) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
        edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))))
        buffer = b"".join(parts)
    low = np.frombuffer(buffer.translate(_LETTERS), np.uint8)
    if len(low) < 3:
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    a, b, c = low[:-2], low[1:-1], low[2:]
    code = (a.astype(np.int32) * 2039 + b.astype(np.int32) * 127 + c) * 40503 >> 3 & (BUCKETS - 1)
    row = np.repeat(np.arange(len(edges) - 1, dtype=np.int32), np.diff(edges))
    inside = (row[2:] == row[:-2]) & ((a != 32) | (b != 32)) & ((b != 32) | (c != 32))
    return code[inside], row[:-2][inside]


def fit_text(rows: DataFrame, markup: bool = False, per_language: int = SAMPLE_ROWS, least: int = LANGUAGE_ROWS) -> tuple[list[str], np.ndarray]:
    """Languages (sorted, the background last) and their log-probabilities of trigram buckets.

    ``rows`` has text and declared. The sample of a language is the rows whose
    text hash falls under a threshold, about ``per_language`` of them.
    """
    counts = rows.where(F.col("declared") != UNKNOWN).groupBy("declared").count().where(F.col("count") >= least)
    modelled = counts.orderBy(F.desc("count"), "declared").limit(LANGUAGES).collect()
    languages = sorted(r["declared"] for r in modelled)
    if not languages:
        return [], np.zeros((0, BUCKETS), np.float32)
    place = {d: i for i, d in enumerate(languages)}
    rates = {r["declared"]: min(1.0, per_language / r["count"]) for r in modelled}
    rate = F.element_at(F.create_map(*[F.lit(x) for kv in rates.items() for x in kv]), F.col("declared"))
    chance = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(F.col("declared").isin(languages)).where(chance < rate).select("text", "declared")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        code, row = _trigrams(batch, "text", markup)
        which = np.array([place[d] for d in batch.column(1).to_pylist()], np.int64)
        size = np.bincount(row, minlength=batch.num_rows)
        weight = np.minimum(size, SHARE_OF_MODEL) / np.maximum(size, 1)
        keys, at = np.unique(which[row] * BUCKETS + code, return_inverse=True)
        n = np.bincount(at, weights=weight[row], minlength=len(keys))
        return pa.RecordBatch.from_arrays([pa.array(keys // BUCKETS), pa.array(keys % BUCKETS), pa.array(n)], ["language", "bucket", "n"])

    counted = map_rows(sample, "text", count, "language long, bucket long, n double")
    # one model a row: its size is that of the model, whatever the rows
    found = counted.groupBy("language", "bucket").agg(F.sum("n").alias("n")).groupBy("language").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    table = np.full((len(languages) + 1, BUCKETS), 1.0 / BUCKETS)
    for r in found.toLocalIterator():
        n = np.array(r["n"], float)
        # new trigrams get the share that trigrams new to the sample had in it
        seen, new = n.sum(), float(len(n))
        table[r["language"]] *= new / (seen + new)
        table[r["language"], r["bucket"]] += n / (seen + new)
    table[-1] = (1 - UNIFORM) * table[:-1].mean(axis=0) + UNIFORM / BUCKETS
    return [*languages, UNKNOWN], np.log(table).astype(np.float32)


def _text_scores(batch: pa.RecordBatch, table: np.ndarray, markup: bool) -> np.ndarray:
    """Rows x languages: the tempered log-likelihoods of the batch's texts."""
    code, row = _trigrams(batch, "text", markup)
    n = np.bincount(row, minlength=batch.num_rows)
    weight = np.minimum(n, EVIDENCE) / np.maximum(n, 1)
    return np.stack([np.bincount(row, weights=t[code], minlength=batch.num_rows) * weight for t in table], axis=1)


def _softmax(logs: np.ndarray) -> np.ndarray:
    p = np.exp(logs - logs.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _lists(values: np.ndarray) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64()))


def _counts(batch: pa.RecordBatch, column: str, k: int) -> np.ndarray:
    """Rows x languages of an array column; zeros where it is null."""
    col = batch.column(batch.schema.get_field_index(column))
    out = np.zeros((batch.num_rows, k))
    out[np.asarray(col.is_valid())] = np.asarray(col.drop_null().flatten()).reshape(-1, k)
    return out


def _schema(rows: DataFrame, *fields: tuple[str, str], without: tuple[str, ...] = ()) -> T.StructType:
    more = [T.StructField(n, T._parse_datatype_string(t)) for n, t in fields]
    return T.StructType([f for f in rows.schema.fields if f.name not in without] + more)


def _posteriors(p: Column) -> Column:
    """The softmax of an array of logarithms."""
    return F.element_at(F.transform(F.array(F.transform(p, lambda x: F.exp(x - F.array_max(p)))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))), 1)


class Evidence:
    """The fitted tables of rows of (text, declared, host, suffix) and key columns.

    ``scored`` holds the rows' keys and text scores without the texts.
    """

    def __init__(self, rows: DataFrame, markup: bool = False, per_language: int = SAMPLE_ROWS, least: int = LANGUAGE_ROWS):
        self.markup = markup
        self.languages, self.table = fit_text(rows, markup, per_language, least)
        self.k = k = len(self.languages)
        if not k:
            return
        shared = rows.sparkSession.sparkContext.broadcast(self.table)
        narrow = [n for n in rows.columns if n != "text"]

        def score(batch: pa.RecordBatch) -> pa.RecordBatch:
            scores = _lists(_text_scores(batch, shared.value, markup))
            return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in narrow), scores], [*narrow, "scores"])

        schema = _schema(rows, ("scores", "array<double>"), without=("text",))
        self.scored = common.written(map_rows(rows, "text", score, schema))
        soft = self.scored.select("declared", "host", "suffix", _posteriors(F.col("scores")).alias("p"))
        # one narrow table; the others are sums of it
        grouped = common.cut(soft.groupBy("declared", "host", "suffix").agg(*[F.sum(F.col("p")[i]).alias(f"n{i}") for i in range(k)]))
        add = [F.sum(f"n{i}").alias(f"n{i}") for i in range(k)]
        self.total = np.array([x or 0.0 for x in grouped.agg(*add).first()]) + 1.0
        numbers = lambda p: F.array(*[F.col(f"n{i}") for i in range(k)]).alias(p)
        hosts = grouped.groupBy("host", "suffix").agg(*add).select("host", "suffix", numbers("h_n"))
        suffixes = grouped.groupBy("suffix").agg(*add).select(F.col("suffix").alias("s_suffix"), numbers("s_n"))
        # a host's row carries its suffix's counts: rows meet one table
        self.hosts = common.cut(hosts.join(suffixes, F.col("suffix").eqNullSafe(F.col("s_suffix"))).select(F.col("host").alias("h_host"), F.col("suffix").alias("h_suffix"), "h_n", "s_n"))
        self.few_hosts = self.hosts.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS
        confusion = np.full((k - 1, k), 1.0)
        for r in grouped.where(F.col("declared").isin(self.languages[:-1])).groupBy("declared").agg(*add).collect():
            confusion[self.languages.index(r["declared"])] += [r[f"n{i}"] for i in range(k)]
        self.declared = np.log(confusion / confusion.sum(axis=0, keepdims=True))

    def apply(self, rows: DataFrame) -> DataFrame:
        """Adds id_lang, id_confidence and id_posterior (in the order of ``languages``).

        ``rows`` are ``scored``, or rows with a text, which stays where it is
        only if ``few_hosts``.
        """
        k, markup, languages = self.k, self.markup, self.languages
        added = (("id_lang", "string"), ("id_confidence", "double"), ("id_posterior", "array<double>"))
        if not k:
            return rows.withColumns({"id_lang": F.lit(UNKNOWN), "id_confidence": F.lit(0.0), "id_posterior": F.array().cast("array<double>")})
        hosts = F.broadcast(self.hosts) if self.few_hosts else self.hosts
        own = F.col("host").eqNullSafe(F.col("h_host")) & F.col("suffix").eqNullSafe(F.col("h_suffix"))
        out = rows.join(hosts, own, "left").select(*rows.columns, "h_n", "s_n")
        shared = rows.sparkSession.sparkContext.broadcast((self.table, self.declared, self.total / self.total.sum()))
        has_scores = "scores" in rows.columns
        place = {d: i for i, d in enumerate(languages[:-1])}

        def fuse(batch: pa.RecordBatch) -> pa.RecordBatch:
            table, declared, prior = shared.value
            scores = _counts(batch, "scores", k) if has_scores else _text_scores(batch, table, markup)
            own = _softmax(scores)
            said = batch.column(batch.schema.get_field_index("declared")).to_pylist()
            given = np.stack([declared[place[d]] if d in place else np.zeros(k) for d in said]) if said else np.zeros((0, k))
            s_n, h_n = (np.maximum(_counts(batch, c, k) - own, 0) for c in ("s_n", "h_n"))
            suffix = (s_n + SUFFIX_WEIGHT * prior) / (s_n.sum(axis=1, keepdims=True) + SUFFIX_WEIGHT)
            host = (h_n + HOST_WEIGHT * suffix) / (h_n.sum(axis=1, keepdims=True) + HOST_WEIGHT)
            post = _softmax(scores + given + np.log(host))
            best = post.argmax(axis=1)
            more = [pa.array([languages[i] for i in best], pa.string()), pa.array(post.max(axis=1)), _lists(post)]
            kept = [n for n in batch.schema.names if n not in ("s_n", "h_n")]
            return pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in kept), *more], [*kept, *(n for n, _ in added)])

        if has_scores:
            return out.mapInArrow(lambda batches: map(fuse, batches), _schema(rows, *added))
        return map_rows(out, "text", fuse, _schema(rows, *added))


def host_of(url: Column) -> Column:
    """The lower-case host of an address; null if it has none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def page_rows(pages: DataFrame) -> DataFrame:
    """page_id, text (the html), declared (the html element's lang), host and suffix of ``pages``."""
    lang = F.lower(F.regexp_extract("html", r"""(?i)<html\b[^>]*?\slang\s*=\s*["']?([A-Za-z]{2,3})""", 1))
    host = host_of(F.col("url"))
    return pages.select(
        "page_id", F.col("html").alias("text"), F.nullif(lang, F.lit("")).alias("declared"), host.alias("host"), F.element_at(F.split(host, r"\."), -1).alias("suffix")
    )


def identify_pages(pages: DataFrame, per_language: int = SAMPLE_ROWS, least: int = LANGUAGE_ROWS) -> DataFrame:
    """page_id, host, declared, lang, confidence, accepted and posterior of each page."""
    rows = page_rows(pages)
    evidence = Evidence(rows, True, per_language, least)
    out = evidence.apply(evidence.scored if evidence.k else rows.drop("text"))
    return out.select(
        "page_id", "host", "declared", F.col("id_lang").alias("lang"), F.col("id_confidence").alias("confidence"),
        ((F.col("id_confidence") >= LEAST) & (F.col("id_lang") != UNKNOWN)).alias("accepted"), F.col("id_posterior").alias("posterior"),
    )


def keep_identified(docs: DataFrame, least: float = LEAST, per_language: int = SAMPLE_ROWS, rows_of_language: int = LANGUAGE_ROWS) -> DataFrame:
    """``docs`` whose language is known with at least ``least``; ``lang`` becomes that language.

    The declared language is ``lang``, the host is ``source``. Texts without a
    letter are rejected, and those that the background wins, unless they declare
    a language too rare for a model: they keep it. Every column stays, in its
    order.
    """
    evidence_of = lambda text, row: [text.alias("text"), row["lang"].alias("declared"), row["source"].alias("host"), F.lit(None).cast("string").alias("suffix")]
    wrapped = docs.select(F.struct("*").alias("row"))
    mark = F.xxhash64(F.col("row.text"), F.lit(1)).alias("mark"), F.xxhash64(F.col("row.text"), F.lit(2)).alias("mark2")
    evidence = Evidence(wrapped.select(*evidence_of(F.col("row.text"), F.col("row")), *mark), False, per_language, rows_of_language)
    if not evidence.k or evidence.few_hosts:
        # texts stay where they are; the struct of the other columns goes along
        others = F.struct(*[F.col("row")[c].alias(c) for c in docs.columns if c != "text"]).alias("row")
        out = evidence.apply(wrapped.select(others, *evidence_of(F.col("row.text"), F.col("row"))))
        text = F.col("text")
    else:
        judged = evidence.apply(evidence.scored).select(F.col("declared").alias("d"), F.col("host").alias("h"), F.col("mark").alias("m"), F.col("mark2").alias("m2"), "id_lang", "id_confidence").distinct()
        own = F.col("row.lang").eqNullSafe(F.col("d")) & F.col("row.source").eqNullSafe(F.col("h")) & (F.col("mark") == F.col("m")) & (F.col("mark2") == F.col("m2"))
        out = wrapped.select("row", *mark).join(judged, own)
        text = F.col("row.text")
    rare = F.col("row.lang").isNotNull() & ~F.col("row.lang").isin(UNKNOWN, *evidence.languages)
    known = F.col("id_lang") != UNKNOWN
    stays = (known & (F.col("id_confidence") >= least)) | (~known & rare)
    own = {"lang": F.when(known, F.col("id_lang")).otherwise(F.col("row.lang")), "text": text}
    return out.where(stays & text.rlike(r"\p{L}")).select(*[own.get(c, F.col("row")[c]).alias(c) for c in docs.columns])


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    out = identify_pages(common.table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "declared", "lang", F.round("confidence", 6).alias("confidence"), "accepted")
