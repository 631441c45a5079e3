"""Fill-in-the-middle texts by repeated captures.

One ``fullmatch`` of ``(unit)*`` keeps every repetition of the group: its ends
give the number of units and, by plain indexing, both cut offsets, so no loop
walks a text. A unit is any pattern (code points by default; words or lines
serve as well). Cuts and forms follow a hash of the seed and the id, so reruns
agree whatever the partitioning.

Texts stay where Spark reads them and nothing is shuffled. A text of over
``STRETCH`` units is matched in stretches, each going on where the last one
ended, so that the captures held at once stay bounded; units are matched
greedily from the left, so the ends are the same.

Defined results: a null text is empty; an empty text, one that holds a
sentinel and one whose units do not cover it stay as they are (``plain``, the
last with n = 0); a null id hashes like an empty one; repeated rows come out
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .arrowtext import map_rows, texts

#: Units matched at once.
STRETCH = 1 << 20
#: One code point.
CODE_POINT = r"(?s:.)"
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@dataclass(frozen=True)
class Plan:
    """How texts are cut: the unit, sentinels for prefix, suffix and middle, shares in percent, and the seed."""

    unit: str = CODE_POINT
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    transformed: int = 90
    suffix_first: int = 20
    seed: str = "1:"


def unit_ends(text: str, unit: str = CODE_POINT, stretch: int = STRETCH) -> list[int] | None:
    """Where each unit of ``text`` ends; None if units do not cover it."""
    if len(text) <= stretch:
        whole = regex.compile(f"(?:({unit}))*+").fullmatch(text)
        return None if whole is None else whole.ends(1)
    part, ends, at = regex.compile(f"(?:({unit})){{1,{stretch}}}+"), [], 0
    while at < len(text):
        found = part.match(text, at)
        if found is None or found.end() == at:
            return None
        ends += found.ends(1)
        at = found.end()
    return ends


def draws(seed: str, doc_id: int | None) -> list[int]:
    """Four numbers of 32 bits from the seed and the id."""
    digits = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digits[i : i + 8], 16) for i in (0, 8, 16, 24)]


def transformed(text: str, doc_id: int | None, plan: Plan) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output) of one text."""
    ends = unit_ends(text, plan.unit)
    n = 0 if ends is None else len(ends)
    h1, h2, h3, h4 = draws(plan.seed, doc_id)
    if n == 0 or any(mark in text for mark in (plan.prefix, plan.suffix, plan.middle)) or h3 % 100 >= plan.transformed:
        return n, "plain", None, None, text
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (low, high))
    head, body, tail = plan.prefix + text[:a], plan.middle + text[a:b], plan.suffix + text[b:]
    form = "spm" if h4 % 100 < plan.suffix_first else "psm"
    return n, form, a, b - a, (tail + head if form == "spm" else head + tail) + body


def restored(output: str, form: str, plan: Plan = Plan()) -> str:
    """The text that ``output`` was made of, read from the output and its form alone.

    No part holds a sentinel, and no sentinel ends as another begins, so the
    first place of each is the one that was put in.
    """
    if form == "plain":
        return output
    first, second = (plan.prefix, plan.suffix) if form == "psm" else (plan.suffix, plan.prefix)
    opening, _, middle = output.removeprefix(first).partition(plan.middle)
    one, _, two = opening.partition(second)
    return one + middle + two if form == "psm" else two + middle + one


def fill_in_middle(docs: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """Per row of ``docs``: doc_id, n (units), form, prefix_chars, middle_chars (null if plain) and output."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    marks = (plan.prefix, plan.suffix, plan.middle)
    if any(a is not b and any(a.endswith(b[:k]) for k in range(1, len(b) + 1)) for a in marks for b in marks) or not all(marks):
        raise ValueError("no sentinel may be empty or end as another begins")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = [(i, *transformed(t.decode(errors="surrogateescape"), i, plan)) for i, t in zip(batch.column(0).to_pylist(), texts(batch, "text"))]
        ids, n, form, prefix, middle, output = map(list, zip(*out))
        raw = pa.array([o.encode(errors="surrogateescape") for o in output], pa.binary()).cast(pa.string(), safe=False)
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(form), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), raw], ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return map_rows(rows, "text", run, SCHEMA)


def restore(made: DataFrame, plan: Plan = Plan()) -> DataFrame:
    """``made`` (form, output and other columns) with ``restored``, the exact text."""
    at_form = made.columns.index("form")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        back = [restored(o.decode(errors="surrogateescape"), f, plan).encode(errors="surrogateescape") for o, f in zip(texts(batch, "output"), batch.column(at_form).to_pylist())]
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.binary()).cast(pa.string(), safe=False)], [*batch.schema.names, "restored"])

    return map_rows(made, "output", run, made.withColumn("restored", F.lit("")).schema)


def op11_infill(spark, sf_dir: str) -> DataFrame:
    made = restore(fill_in_middle(common.table(spark, sf_dir, "documents")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
x AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM x),
p AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
