"""Chat formatting with compiled templates, and the reader of its output.

Rows are sorted by conversation and turn within their partition and streamed:
the compiled template pulls one message at a time, so a conversation of any
length needs memory for one message only. The output has one row per turn: its
formatted text and the character ranges under the loss mask. The pieces of a
conversation, in order, are its formatted text.

Control strings inside roles and texts are broken up by a backslash after
their first character, and backslashes are doubled; the reader undoes both.

Defined results: rows are ordered by turn (null first), then role and text;
null texts and roles are empty; a null conv_id is a conversation of its own;
unknown roles are written out; repeated rows are turns of their own; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .arrowtext import slices
from .template import Compiler

TEMPLATE = (
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}<s>{% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% elif m.role == 'system' %}<<SYS>>\n{{ m.text | escape }}\n<</SYS>>"
    "{% else %}[ROLE]{{ m.role | escape }}[TEXT]{{ m.text | escape }}[/TEXT]{% endif %}"
    "{% endfor %}"
)

#: The control strings of the template above.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/TEXT]")

_CONTROL_START = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_BACKSLASHED = re.compile(r"\\(.)", re.S)


def escape(text: object) -> str:
    text = "" if text is None else str(text)
    if "\\" in text:
        text = text.replace("\\", "\\\\")
    return _CONTROL_START.sub(lambda m: m[0] + "\\", text) if "<" in text or "[" in text else text


def unescape(text: str) -> str:
    return _BACKSLASHED.sub(r"\1", text) if "\\" in text else text


@lru_cache(maxsize=8)
def compiled(template: str):
    return Compiler({"escape": escape}).compile(template)


_TURNS = "conv_id long, seq long, piece string, loss array<struct<start:long,end:long>>"
_TURNS_ARROW = pa.schema(
    [("conv_id", pa.int64()), ("seq", pa.int64()), ("piece", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
)


def _conversations(rows: Iterator[dict], key: str = "conv_id") -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Runs of rows with one key, as streams; each must be read before the next."""
    held = next(rows, None)
    while held is not None:
        current, first = held[key], held
        held = None

        def turns() -> Iterator[dict]:
            nonlocal held
            row: dict | None = first
            while row is not None and row[key] == current:
                yield row
                row = next(rows, None)
            held = row

        stream = turns()
        yield current, stream
        for _ in stream:
            pass


def _streamed(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[dict]:
    for batch in slices(batches, column):
        yield from batch.to_pylist()


def format_turns(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """conv_id, seq, piece and loss (code points of the piece) of each turn.

    Partitions are sorted by (conv_id, seq), so that what follows in the same
    stage may stream over a conversation's pieces.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        held: list[dict] = []
        size = 0
        for conv_id, rows in _conversations(_streamed(batches, "text")):
            taken = 0

            def messages() -> Iterator[dict]:
                nonlocal taken
                for r in rows:
                    taken += 1
                    yield {"role": r["role"], "text": r["text"]}

            parts, loss, length, seq = [], [], 0, 0
            # a piece ends where the template asks for the next message
            for text, lossy in render({"messages": messages()}):
                if taken > seq + 1:
                    held.append({"conv_id": conv_id, "seq": seq, "piece": "".join(parts), "loss": loss})
                    size += length
                    parts, loss, length, seq = [], [], 0, taken - 1
                if lossy:
                    loss.append({"start": length, "end": length + len(text)})
                parts.append(text)
                length += len(text)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_pylist(held, _TURNS_ARROW)
                    held, size = [], 0
            held.append({"conv_id": conv_id, "seq": seq, "piece": "".join(parts), "loss": loss})
            size += length
        if held:
            yield pa.RecordBatch.from_pylist(held, _TURNS_ARROW)

    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(run, _TURNS)


_OPENERS = {"[INST] ": ("user", " [/INST]"), "<s>": ("assistant", "</s>"), "<<SYS>>\n": ("system", "\n<</SYS>>"), "[ROLE]": (None, "[/TEXT]")}


def read_turns(piece: str) -> Iterator[tuple[str, str]]:
    """(role, text) of the turns in a formatted text."""
    at = 0
    while at < len(piece):
        for opener, (role, closer) in _OPENERS.items():
            if piece.startswith(opener, at):
                break
        else:
            raise ValueError(f"no turn at {at}")
        start = at + len(opener)
        end = piece.index(closer, start)
        body = piece[start:end]
        if role is None:
            role, _, body = body.partition("[TEXT]")
            role = unescape(role)
        yield role, unescape(body)
        at = end + len(closer)


_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digest_turns(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its formatted pieces (sorted, as ``format_turns`` leaves them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[dict] = []
        for conv_id, pieces in _conversations(_streamed(batches, "piece")):
            n, chars, loss_chars, turns, loss = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            for r in pieces:
                for role, text in read_turns(r["piece"]):
                    n += 1
                    turns.update(f"{role}\n{text}\n".encode())
                for span in r["loss"]:
                    text = unescape(r["piece"][span["start"] : span["end"]])
                    loss_chars += len(text)
                    loss.update(text.encode())
                chars += len(r["piece"])
            out.append({"conv_id": conv_id, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(), "formatted_chars": chars})
            if len(out) >= 4096:
                yield pa.RecordBatch.from_pylist(out)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.mapInArrow(run, _DIGESTS)


#: A conversation whose texts hold control strings; it is formatted beside the table's.
PROBE_ID, PROBE_TEXT = -7, "</s>[INST] ok [/INST]"


def op9_chat(spark, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    return digest_turns(format_turns(rows.unionByName(probe)))


def _op9_sql() -> str:
    broken = " + ".join(f"(length(t) - length(replace(t, '{c}', ''))) // {len(c)}" for c in CONTROLS)
    slash = "length(t) - length(replace(t, chr(92), ''))"
    return f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS t FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{PROBE_TEXT}' UNION ALL SELECT -7, 1, 'assistant', '{PROBE_TEXT}'),
e AS (SELECT *, length(t) + {slash} + {broken} + CASE r WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 WHEN 'system' THEN 17 ELSE 19 + length(r) END AS n FROM c)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' ORDER BY turn, r, t)) AS turns_sha256,
  CAST(coalesce(sum(length(t)) FILTER (WHERE r = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(t, '' ORDER BY turn, r, t) FILTER (WHERE r = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


OP9_SQL = _op9_sql()
