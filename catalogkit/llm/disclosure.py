"""Personal data, and terms that give it away, with DataFrame functions only.

Protected entities are the e-mail addresses, IP addresses, card and phone
numbers in the texts. Words that stand near an entity may reveal it as well: by
how many rows hold a word, an entity, or the word near the entity, the corpus
estimates their pointwise mutual information, and with it which share of the
entity's own information the word discloses. Words at or above ``disclosed``
are generalised to their first letters where those disclose less, and removed
where they do not. Their spans are added to those of the entities wherever the
words stand, in any text.

Texts are read where Spark reads them: once for the entities, once for the
counts of words that stand near some, once for the rows that hold a revealing
word. Only narrow rows are shuffled. The texts of rows with revealing words meet
those words by a broadcast of counted rows and bytes, beyond which texts are
shuffled once.

Offsets come from the lengths of matches and of the texts between them, summed
in blocks of about the square root of their number, in the row itself.
Expressions are written so that a match cannot start again inside a run, which
keeps them linear in long runs; what they find is unchanged.

Defined results: a null text counts as empty and has no spans (and stays null
when sanitised); matches are leftmost and non-overlapping per kind, offsets are
code points, end exclusive; words inside an entity's span get none of their own;
rows that repeat an id and text are counted apart and get the same spans; rows
are told apart by id and a hash of the text; an empty table gives an empty
result; other columns are ignored, and kept when sanitising.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

_LOCAL, _DOMAIN = "A-Za-z0-9._%+-", "A-Za-z0-9-"
#: Kinds in order, with their expressions.
KINDS = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_DOMAIN}]++(?:\.[{_DOMAIN}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text of a kind must hold; the others are searched.
HINTS = {"email": "@", "phone": "+"}
GENERAL, REMOVE = "general", "remove"
#: Code points around an entity that are read for words.
NEAR = 128
SPAN = "array<struct<kind:string,start:long,end:long,entity:string,near:array<string>>>"


@dataclass(frozen=True)
class Policy:
    """Words of at least ``least`` letters, ``around`` on each side of an entity, are judged once ``support`` rows hold
    both. A word of ``long`` letters may be generalised to its first ``kept``."""

    disclosed: float = 0.9
    support: int = 2
    around: int = 6
    least: int = 3
    long: int = 6
    kept: int = 4


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def sums_before(lengths: Column) -> Column:
    """For each element the sum of those before it."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)

    def blocked(x: Column) -> Column:
        size, step = F.size(x["n"]), x["step"]
        blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(size / step).cast("int") - 1, F.lit(0))), lambda b: total(F.slice(x["n"], b * step + 1, step)))
        tops = lambda blocks: F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
        inside = lambda before: F.transform(x["n"], lambda _, i: F.get(before, F.floor(i / step).cast("int")) + total(F.slice(x["n"], F.floor(i / step).cast("int") * step + 1, i % step)))
        return let(let(blocks, tops), inside)

    step = F.greatest(F.ceil(F.sqrt(F.size(lengths))).cast("int"), F.lit(1))
    return let(F.struct(lengths.alias("n"), step.alias("step")), blocked)


def matches(text: Column, pattern: Column) -> Column:
    """All matches of ``pattern``: value, start, end, and the texts before and after (to the neighbouring matches)."""

    def placed(x: Column) -> Column:
        lengths = F.transform(x["found"], lambda v, i: (F.length(v) + F.length(F.get(x["gaps"], i))).cast("long"))

        def at(before: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                start = F.get(before, i) + F.length(F.get(x["gaps"], i))
                return F.struct(v.alias("value"), start.cast("long").alias("start"), (start + F.length(v)).cast("long").alias("end"), F.get(x["gaps"], i).alias("before"), F.get(x["gaps"], i + 1).alias("after"))

            return F.transform(x["found"], one)

        return let(sums_before(lengths), at)

    none = F.array().cast("array<struct<value:string,start:long,end:long,before:string,after:string>>")
    parts = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps"))
    return let(parts, lambda x: F.when(F.size(x["found"]) > 0, placed(x)).otherwise(none))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the check of its last digit."""

    def weighed(i: Column) -> Column:
        d = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(number), F.lit(1))), F.lit(0), lambda a, i: a + F.coalesce(weighed(i), F.lit(0))) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    """Whether a match of the kind is one."""
    size = F.length(digits(value))
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{part}\.{part}\.{part}\.{part}$"),
        "card": F.when(size.between(13, 19), luhn(digits(value))).otherwise(False),
        "phone": size.between(9, 15),
    }[kind]


def word_list(text: Column, policy: Policy) -> Column:
    """The words of a lower-cased text in order."""
    return F.regexp_extract_all(text, F.lit(rf"\p{{L}}{{{policy.least},}}"), F.lit(0))


def terms_of(words: Column, policy: Policy) -> Column:
    """Distinct words and, of long ones, what they would be generalised to."""
    stems = F.transform(F.filter(words, lambda w: F.length(w) >= policy.long), lambda w: stem(w, policy))
    return F.array_distinct(F.concat(words, stems))


def stem(word: Column, policy: Policy) -> Column:
    return F.concat(F.left(word, F.lit(policy.kept)), F.lit("*"))


def _near(found: Column, policy: Policy) -> Column:
    """Words on both sides; one cut by the edge of what is read is left out."""
    before = F.when(F.length(found["before"]) > NEAR, F.regexp_replace(F.right(found["before"], F.lit(NEAR)), r"^\p{L}+", "")).otherwise(found["before"])
    after = F.when(F.length(found["after"]) > NEAR, F.regexp_replace(F.left(found["after"], F.lit(NEAR)), r"\p{L}+$", "")).otherwise(found["after"])
    last = let(word_list(common.lower_ascii(before), policy), lambda w: F.slice(w, F.greatest(F.size(w) - policy.around, F.lit(0)) + 1, F.lit(policy.around)))
    return terms_of(F.concat(last, F.slice(word_list(common.lower_ascii(after), policy), 1, policy.around)), policy)


def entities(text: Column, policy: Policy = Policy()) -> Column:
    """All entities of a text, by kind and start: kind, start, end, entity (its name) and the terms near it."""

    def of_kind(kind: str) -> Column:
        kept = F.filter(matches(text, F.lit(KINDS[kind])), lambda m: holds(kind, m["value"]))
        name = {"email": common.lower_ascii, "ip": lambda v: v}.get(kind, digits)
        rows = F.transform(kept, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.concat(F.lit(f"{kind}:"), name(m["value"])).alias("entity"), _near(m, policy).alias("near")))
        return F.when(F.contains(text, F.lit(HINTS[kind])), rows).otherwise(F.array().cast(SPAN)) if kind in HINTS else rows

    return F.concat(*map(of_kind, KINDS))


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("mark", F.xxhash64("text"))


def _same() -> Column:
    """A row and what was found for its id and text."""
    return F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("mark") == F.col("own_mark"))


def revealing(docs: DataFrame, found: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """(word, how): the words that disclose an entity, to be generalised or removed.

    ``found``: a row for each row of ``docs`` with its entities as ``base``.
    """
    rows = found.count()
    pairs = F.array_distinct(F.flatten(F.transform("base", lambda s: F.transform(s["near"], lambda t: F.concat_ws("\x01", s["entity"], t)))))
    joint = found.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count("*").alias("joint")).where(F.col("joint") >= policy.support)
    joint = common.cut(joint.select(F.split_part("pair", F.lit("\x01"), F.lit(1)).alias("entity"), F.split_part("pair", F.lit("\x01"), F.lit(2)).alias("term"), "joint"))
    held = found.select(F.explode(F.array_distinct(F.transform("base", lambda s: s["entity"]))).alias("entity")).groupBy("entity").agg(F.count("*").alias("held"))
    listed = common.cut(joint.select("term").distinct())
    said = _keyed(docs).select(F.explode(terms_of(word_list(common.lower_ascii(F.col("text")), policy), policy)).alias("term"))
    if common.is_small(listed):
        said = said.join(F.broadcast(listed), "term", "left_semi").groupBy("term").agg(F.count("*").alias("said"))
    else:  # counts are far fewer than words, so they meet the list
        said = said.groupBy("term").agg(F.count("*").alias("said")).join(listed, "term", "left_semi")
    known = joint.join(held, "entity").join(said, "term")
    shared, own = F.log(F.lit(float(rows)) * F.col("joint") / (F.col("held") * F.col("said"))), F.log(F.lit(float(rows)) / F.col("held"))
    told = common.cut(known.where((F.col("held") < rows) & (shared >= policy.disclosed * own)).select("term").distinct())
    words = told.where(~F.endswith("term", F.lit("*"))).withColumn("stem", F.when(F.length("term") >= policy.long, stem(F.col("term"), policy)))
    stems = told.where(F.endswith("term", F.lit("*"))).select(F.col("term").alias("stem"), F.lit(True).alias("tells"))
    how = F.when(F.col("stem").isNull() | F.col("tells"), REMOVE).otherwise(GENERAL)
    return common.cut(words.join(stems, "stem", "left").select(F.col("term").alias("word"), how.alias("how")))


def scan(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """Per row: doc_id, mark (of its text) and spans (kind, start, end), entities by kind and then words, each by start."""
    keyed = _keyed(docs)
    found = common.written(keyed.select("doc_id", "mark", entities(F.col("text"), policy).alias("base")))
    words = common.bounded(revealing(docs, found, policy))
    here = keyed.select("doc_id", "mark", F.explode(F.array_distinct(word_list(common.lower_ascii(F.col("text")), policy))).alias("word")).join(words, "word")
    lists = [F.array_sort(F.collect_set(F.when(F.col("how") == how, F.col("word")))).alias(how) for how in (GENERAL, REMOVE)]
    hits = here.groupBy("doc_id", "mark").agg(*lists).select(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), GENERAL, REMOVE)
    base = found.select("doc_id", "mark", F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("base"))
    hits = common.cut(hits)
    of_hit = base.join(common.bounded(hits), _same()).groupBy("own_id", "own_mark").agg(F.first("base").alias("taken"), F.first(GENERAL).alias(GENERAL), F.first(REMOVE).alias(REMOVE))
    with_text = keyed.join(common.bounded(common.cut(of_hit)), _same())

    def spans(how: str) -> Column:
        pattern = F.concat(F.lit(r"(?<!\p{L})(?:"), F.array_join(how, "|"), F.lit(r")(?!\p{L})"))
        free = F.filter(matches(common.lower_ascii(F.col("text")), pattern), lambda m: ~F.exists("taken", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
        rows = F.transform(free, lambda m: F.struct(F.lit(how).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))
        return F.when(F.size(how) > 0, rows).otherwise(F.array().cast("array<struct<kind:string,start:long,end:long>>"))

    more = with_text.select("own_id", "own_mark", F.concat(spans(GENERAL), spans(REMOVE)).alias("more")).groupBy("own_id", "own_mark").agg(F.first("more").alias("more"))
    out = base.join(common.bounded(common.cut(more)), _same(), "left")
    return out.select("doc_id", "mark", F.concat("base", F.coalesce("more", F.array().cast("array<struct<kind:string,start:long,end:long>>"))).alias("spans"))


def sanitise(docs: DataFrame, policy: Policy = Policy()) -> DataFrame:
    """``docs`` with entities replaced by their kind, revealing words by their first letters or by nothing.

    Every column and row stays. Spans that overlap count as one, under the
    name of the first.
    """
    found = scan(docs, policy).where(F.size("spans") > 0).select(F.col("doc_id").alias("own_id"), F.col("mark").alias("own_mark"), "spans")
    once = common.cut(found.groupBy("own_id", "own_mark").agg(F.first("spans").alias("spans")))
    rows = docs.select(F.struct("*").alias("row"))
    own = F.col("row.doc_id").cast("long").eqNullSafe(F.col("own_id")) & (F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))) == F.col("own_mark"))

    def replaced(text: Column, spans: Column) -> Column:
        def step(a: Column, s: Column) -> Column:
            piece = F.substring(text, (a["done"] + 1).cast("int"), (s["start"] - a["done"]).cast("int"))
            word = F.substring(text, (s["start"] + 1).cast("int"), F.lit(policy.kept))
            put = F.when(s["kind"] == GENERAL, F.concat(word, F.lit("*"))).when(s["kind"] == REMOVE, "").otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
            new = s["start"] >= a["done"]
            return F.struct(F.greatest(a["done"], s["end"]).alias("done"), F.when(new, F.concat(a["out"], F.array(piece, put))).otherwise(a["out"]).alias("out"))

        ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["end"].alias("end"), s["kind"].alias("kind"))))
        begun = F.struct(F.lit(0).cast("long").alias("done"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(ordered, begun, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["done"] + 1).cast("int"), F.length(text))))

    out = rows.join(common.bounded(once), own, "left")
    text = F.when(F.col("spans").isNull(), F.col("row.text")).otherwise(replaced(F.col("row.text"), F.col("spans")))
    return out.select(*[text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def op13_disclosure(spark, sf_dir: str) -> DataFrame:
    found = scan(common.table(spark, sf_dir, "documents"))

    def line(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return found.select("doc_id", *map(count, KINDS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def _op13_sql(p: Policy = Policy()) -> str:
    upper, lower = common.UPPER, common.UPPER.lower()
    patterns = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
        "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    }
    parts = " UNION ALL ".join(
        f"""SELECT rid, '{kind}' AS kind, {k} AS k, unnest(ms) AS v, unnest(range(1, len(ms) + 1)) AS i, ms, ps FROM (SELECT rid, regexp_extract_all(t, '{x}') AS ms, regexp_split_to_array(t, '{x}') AS ps FROM d)"""
        for k, (kind, x) in enumerate(patterns.items())
    )
    words = lambda t: f"regexp_extract_all(translate({t}, '{upper}', '{lower}'), '\\p{{L}}{{{p.least},}}')"
    terms = lambda w: f"list_distinct(list_concat({w}, list_transform(list_filter({w}, lambda x: length(x) >= {p.long}), lambda x: x[1:{p.kept}] || '*')))"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
m AS (SELECT rid, kind, k, v, regexp_replace(v, '[^0-9]', '', 'g') AS g, ps[i] AS b, ps[i + 1] AS a,
  CAST(list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS s FROM ({parts})),
f AS (SELECT rid, kind, k, s, s + length(v) AS e, kind || ':' || CASE kind WHEN 'email' THEN translate(v, '{upper}', '{lower}') WHEN 'ip' THEN v ELSE g END AS entity,
  {words(f"CASE WHEN length(b) > {NEAR} THEN regexp_replace(right(b, {NEAR}), '^\\p{{L}}+', '') ELSE b END")} AS bw,
  {words(f"CASE WHEN length(a) > {NEAR} THEN regexp_replace(left(a, {NEAR}), '\\p{{L}}+$', '') ELSE a END")} AS aw
  FROM m WHERE CASE kind WHEN 'email' THEN true WHEN 'ip' THEN len(list_filter(string_split(v, '.'), lambda x: CAST(x AS HUGEINT) > 255)) = 0 WHEN 'phone' THEN length(g) BETWEEN 9 AND 15
    ELSE length(g) BETWEEN 13 AND 19 AND CAST(list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 0 THEN CAST(g[i] AS INTEGER) WHEN g[i] > '4' THEN 2 * CAST(g[i] AS INTEGER) - 9 ELSE 2 * CAST(g[i] AS INTEGER) END)) AS BIGINT) % 10 = 0 END),
c AS (SELECT rid, entity, list_concat(bw[greatest(len(bw) - {p.around - 1}, 1):], aw[1:{p.around}]) AS w FROM f),
j AS (SELECT entity, term, count(DISTINCT rid) AS joint FROM (SELECT rid, entity, unnest({terms("w")}) AS term FROM c) GROUP BY ALL HAVING joint >= {p.support}),
h AS (SELECT entity, count(DISTINCT rid) AS held FROM f GROUP BY entity),
y AS (SELECT term, count(*) AS said FROM (SELECT unnest({terms("w")}) AS term FROM (SELECT {words("t")} AS w FROM d)) GROUP BY term),
told AS (SELECT DISTINCT term FROM j JOIN h USING (entity) JOIN y USING (term), (SELECT CAST(count(*) AS DOUBLE) AS n FROM d) WHERE held < n AND ln(n * joint / (held * said)) >= {p.disclosed} * ln(n / held)),
r AS (SELECT term, CASE WHEN length(term) >= {p.long} AND term[1:{p.kept}] || '*' NOT IN (SELECT term FROM told) THEN 'general' ELSE 'remove' END AS how FROM told WHERE NOT ends_with(term, '*')),
w AS (SELECT rid, w, sum(length(b) + length(w)) OVER (PARTITION BY rid ORDER BY i) AS e FROM (
  SELECT rid, unnest(ws) AS w, unnest(ps[1:len(ws)]) AS b, unnest(range(len(ws))) AS i FROM (SELECT rid, regexp_extract_all(translate(t, '{upper}', '{lower}'), '\\p{{L}}+') AS ws, regexp_split_to_array(translate(t, '{upper}', '{lower}'), '\\p{{L}}+') AS ps FROM d))),
x AS (SELECT rid, how AS kind, CASE how WHEN 'general' THEN 4 ELSE 5 END AS k, CAST(e - length(term) AS BIGINT) AS s, CAST(e AS BIGINT) AS e FROM w JOIN r ON w.w = r.term),
z AS (SELECT rid, kind, k, s, e FROM f UNION ALL SELECT * FROM x WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.rid = x.rid AND f.s < x.e AND x.s < f.e)),
a AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in patterns)},
  string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) FILTER (WHERE k < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY k, s) AS spans FROM z GROUP BY rid)
SELECT doc_id, {", ".join(f"CAST(coalesce(n_{k}, 0) AS BIGINT) AS n_{k}" for k in patterns)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""


OP13_SQL = _op13_sql()
