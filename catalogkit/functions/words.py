"""Names as lists of words, and the numbers, years and markers read from them.

A word is a run of ASCII letters or of digits; each knows the gap before it,
the gap after it and where it stands. Rules look at words and gaps by place, so
a name is split once and never searched again.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import SEASON_WORDS, WORD_NUMBERS
from .vocabulary import DEFAULT, Vocabulary

#: A word and the gap before it.
_WORD = r"(?i)([^a-z0-9]*)([a-z]+|[0-9]+)"
#: Gaps that only separate, and those with blanks only.
SOFT, BLANK = r"^[\s._-]*$", r"^\s*$"


def let(value: Column, f) -> Column:
    """``f(value)`` with ``value`` worked out once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def words(text: Column) -> Column:
    """The words of a text: gap, word (lower case), at, end (places from 0, end exclusive) and next, the gap after."""

    def listed(t: Column) -> Column:
        parts = F.struct(F.regexp_extract_all(t, F.lit(_WORD), F.lit(1)).alias("gaps"), F.regexp_extract_all(t, F.lit(_WORD), F.lit(2)).alias("runs"), F.regexp_extract(t, "([^A-Za-z0-9]*)$", 1).alias("tail"))
        return let(parts, placed)

    def placed(p: Column) -> Column:
        def word(run: Column, i: Column) -> Column:
            before = F.length(F.array_join(F.slice(p["runs"], F.lit(1), i), "")) + F.length(F.array_join(F.slice(p["gaps"], F.lit(1), i + 1), ""))
            return F.struct(
                F.get(p["gaps"], i).alias("gap"), F.lower(run).alias("word"), before.alias("at"), (before + F.length(run)).alias("end"), F.coalesce(F.get(p["gaps"], i + 1), p["tail"]).alias("next")
            )

        return F.transform(p["runs"], word)

    return let(text, listed)


def first_of(rows: Column) -> Column:
    return F.try_element_at(rows, F.lit(1))


def last_of(rows: Column, back: int = 1) -> Column:
    return F.try_element_at(rows, F.lit(-back))


def _is(word: Column, *values: str) -> Column:
    return word["word"].isin(*values)


def _digits(word: Column, most: int | None = None) -> Column:
    return word["word"].rlike(f"^[0-9]{{1,{most}}}$" if most else "^[0-9]+$")


def _glued(word: Column) -> Column:
    return word["gap"] == ""


def _apart(word: Column) -> Column:
    """Nothing but a gap or the start stands before the word."""
    return (word["gap"] != "") | (word["at"] == 0)


def _after(word: Column, gap: str) -> Column:
    return word["gap"].rlike(gap)


def number(word: Column) -> Column:
    """The value of a word of digits or a number word; null for others."""
    spelled = F.create_map(*[F.lit(x) for kv in WORD_NUMBERS.items() for x in kv])
    return F.coalesce(spelled[word["word"]], word["word"].try_cast("int"))


def _episode(word: Column) -> Column:
    """An episode has three digits at most; what follows them is something else."""
    return F.left(word["word"], F.lit(3)).cast("int")


def years(ws: Column) -> Column:
    """The words that are years: four digits from 1900 to 2099 between separators or in brackets."""
    return F.filter(ws, lambda w: w["word"].rlike("^(?:19|20)[0-9][0-9]$") & ((w["at"] == 0) | w["gap"].rlike(r"[\s._(\[-]$")) & w["next"].rlike(r"^$|^[\s._)\]-]"))


#: How episodes are marked, ranges before singles: the order in which marks count.
CHAINED, JOINED, CROSSED_RANGE, CODED, CROSSED, SPELLED = range(6)


def markers(ws: Column) -> Column:
    """Every episode mark: kind, at, end (places in the name), season, first, last and ranged.

    Kinds: ``s1e2e3`` (chained), ``s1e2-e3`` (joined), ``1x2-3``, ``s1e2``,
    ``1x2``, ``season 1 episode 2``. A range that runs backward counts as its
    first number, but is ``ranged``.
    """
    tie, blank_tie, joins = r"^[-~+&]$", r"^\s*[-~+&]\s*$", ("to", "and")

    def at(w: Column, i: Column) -> Column:
        n = [w] + [F.get(ws, i + k) for k in range(1, 7)]

        def mark(test: Column, kinds: tuple[Column, int], season: Column, number: Column, until: Column) -> Column:
            """A mark whose range, if any, ends at the word ``until`` places on."""
            first, other = _episode(number), F.get(ws, i + until)
            last = _episode(other)
            good = F.coalesce(last >= first, F.lit(False))
            fields = {
                "kind": F.when(good, kinds[0]).otherwise(kinds[1]), "at": w["at"], "end": F.when(good, other["end"]).otherwise(number["at"] + F.least(F.length(number["word"]), F.lit(3))),
                "season": season["word"].cast("int"), "first": first, "last": F.when(good, last).otherwise(first), "ranged": until.isNotNull(),
            }
            return F.when(F.coalesce(test, F.lit(False)), F.struct(*[v.alias(k) for k, v in fields.items()]))

        none = F.lit(None).cast("int")
        code = _is(w, "s") & _apart(w) & _digits(n[1], 2) & _glued(n[1]) & _is(n[2], "e") & _after(n[2], SOFT) & _digits(n[3]) & _glued(n[3])
        chained = _after(n[4], SOFT)
        to_five = (_is(n[4], "e") & (chained | _after(n[4], blank_tie)) | _is(n[4], *(f"{j}e" for j in joins)) & _after(n[4], BLANK)) & _digits(n[5]) & _glued(n[5])
        spaced = _is(n[4], *joins) & _after(n[4], BLANK) & _after(n[5], BLANK)
        until = F.when(to_five | (spaced & _digits(n[5])), 5).when(_digits(n[4]) & _after(n[4], tie), 4).when(spaced & _is(n[5], "e") & _digits(n[6]) & _glued(n[6]), 6)
        coded = mark(code, (F.when(_is(n[4], "e") & chained, CHAINED).otherwise(JOINED), CODED), n[1], n[3], F.when(_digits(n[3], 3), until))

        cross = _digits(w, 2) & _apart(w) & _is(n[1], "x") & _glued(n[1]) & _digits(n[2]) & _glued(n[2])
        again = lambda k: _digits(n[k], 2) & _is(n[k + 1], "x") & _glued(n[k + 1]) & _digits(n[k + 2] if k + 2 < 7 else F.get(ws, i + k + 2))
        tied, joined = _after(n[3], blank_tie), _is(n[3], *joins) & _after(n[3], BLANK) & _after(n[4], BLANK)
        until = F.when(tied & again(3), 5).when(tied & _digits(n[3]), 3).when(joined & again(4), 6).when(joined & _digits(n[4]), 4)
        crossed = mark(cross, (F.lit(CROSSED_RANGE), CROSSED), w, n[2], F.when(_digits(n[2], 3), until))

        spelled = _is(w, "season") & _apart(w) & _digits(n[1], 2) & _after(n[1], SOFT) & _is(n[2], "episode") & _after(n[2], SOFT) & _digits(n[3]) & _after(n[3], SOFT)
        return F.array_compact(F.array(coded, crossed, mark(spelled, (F.lit(SPELLED), SPELLED), n[1], n[3], none)))

    return F.flatten(F.transform(ws, at))


def markers_of(text: Column) -> Column:
    """``markers`` of a text."""
    return let(words(text), markers)


def best_marker(found: Column) -> Column:
    """The mark that counts: by kind, then by place; null if none."""
    return F.array_min(found)


def season_of_folder(ws: Column) -> Column:
    """The number of a folder named by a season word and a number alone; null for others."""
    name, n = first_of(ws), last_of(ws)
    alone = (F.size(ws) == 2) & _is(name, *SEASON_WORDS) & _after(name, BLANK) & _digits(n, 2) & _after(n, SOFT) & n["next"].rlike(BLANK)
    return F.when(F.coalesce(alone, F.lit(False)), n["word"].cast("int"))


def part_marker(ws: Column) -> Column:
    """(number, at): a closing part marker and where it starts, brackets aside; null without one."""
    last, before = last_of(ws), last_of(ws, 2)
    closed, open_, opened = last["next"].rlike(r"^\s*\)\s*$"), last["next"].rlike(BLANK), r"\(\s*$"
    here = lambda test, w: F.when(F.coalesce(test & number(last).isNotNull(), F.lit(False)), F.struct(number(last).alias("number"), w["at"].alias("at")))
    in_brackets = closed & _is(before, "part") & _after(last, r"^\s+$") & _after(before, opened)
    plain = open_ & _is(before, "part", "pt") & _after(last, r"^[\s._]+$") & _apart(before)
    return F.coalesce(here(in_brackets, before), here(closed & _digits(last) & _after(last, opened), last), here(plain, before))


def parts_range(ws: Column) -> Column:
    """(low, high) of a closing ``parts N-M`` (also ``N and M``); null without one."""
    last = last_of(ws)
    loose = r"^[\s._]*$"

    def span(word: Column, low: Column, tied: Column) -> Column:
        test = _is(word, "parts") & _apart(word) & _after(low, r"^[\s._]+$") & tied & last["next"].rlike(SOFT) & number(low).isNotNull() & number(last).isNotNull()
        return F.when(F.coalesce(test, F.lit(False)), F.struct(number(low).alias("low"), number(last).alias("high")))

    tied = _after(last, r"^[\s._]*[-&][\s._]*$")
    spelled = _is(last_of(ws, 2), "and", "to") & _after(last_of(ws, 2), loose) & _after(last, loose)
    return F.coalesce(span(last_of(ws, 3), last_of(ws, 2), tied), span(last_of(ws, 4), last_of(ws, 3), spelled))


def phrases(ws: Column, table: list[tuple[str, ...]]) -> Column:
    """Where words spell a phrase of ``table``: rank (place of the phrase's entry), at, back (length, negative) and end.

    Separators stand between the words, and before and after the phrase or a
    bracket; an apostrophe may stand before its last letters or be missing.
    """
    spelled = {p.replace("'", ""): rank for rank, entry in enumerate(table) for p in entry}
    longest = max(len(p.replace("'", " ").split()) for entry in table for p in entry)
    names, ranks = F.lit(list(spelled)), F.lit(list(spelled.values()))
    before, after = r"[\s._(\[-]$", r"^[\s._)\]-]"

    def from_word(w: Column, i: Column) -> Column:
        def of_length(n: Column) -> Column:
            glue = lambda gap: F.when(gap.rlike(r"^[\s._-]+$"), " ").when(gap == "'", "").otherwise("|")
            run = F.slice(ws, i + 1, n)
            text = F.array_join(F.transform(run, lambda x, k: F.concat(F.when(k == 0, "").otherwise(glue(x["gap"])), x["word"])), "")
            last = F.get(ws, i + n - 1)
            free = last["next"].rlike(after) | ((i + n == F.size(ws)) & (last["next"] == ""))
            rank = F.when(free, F.try_element_at(ranks, F.nullif(F.array_position(names, text).cast("int"), F.lit(0))))
            return F.struct(rank.alias("rank"), w["at"].alias("at"), (w["at"] - last["end"]).alias("back"), last["end"].alias("end"))

        lengths = F.sequence(F.lit(1), F.least(F.lit(longest), F.size(ws) - i))
        found = F.filter(F.transform(lengths, of_length), lambda x: x["rank"].isNotNull())
        return F.when((w["at"] == 0) | w["gap"].rlike(before), found).otherwise(F.filter(found, lambda x: F.lit(False)))

    return F.flatten(F.transform(ws, from_word))


def weak_number(text: Column, vocab: Vocabulary = DEFAULT) -> Column:
    """season, first, start and end of a bare SEE or SSEE number that can be an episode; null without one.

    It is a word of its own, not the first thing in the name, before any release
    word, no codec's number and not shaped like a year. One that stands between
    dashes, or after one at the end, is taken first; any other only if no
    year follows such a number.
    """

    def read(x: Column) -> Column:
        ws, dated = x["ws"], years(x["ws"])

        def candidate(w: Column, i: Column) -> Column:
            digits, before = w["word"], F.get(ws, i - 1)
            codec = F.coalesce(_is(before, "h", "x") & (F.length(w["gap"]) == 1) & ((before["at"] == 0) | before["gap"].rlike(r"[\s._-]$")), F.lit(False))
            opened, closed = F.endswith(w["gap"], F.lit(" - ")), F.startswith(w["next"], F.lit(" - "))
            segment = opened & (closed | (w["end"] == x["size"]))
            season, first = F.left(digits, F.length(digits) - 2).try_cast("int"), F.right(digits, F.lit(2)).try_cast("int")
            stands = digits.rlike("^[0-9]{3,4}$") & (w["at"] > 0) & w["gap"].rlike(r"[\s._-]$") & w["next"].rlike(r"^$|^[\s._-]") & (w["at"] < x["limit"]) & ~codec
            sound = (season > 0) & (first > 0) & (~digits.rlike("^(?:19|20)[0-9][0-9]$") | (opened & closed))
            followed = ~segment & F.exists(dated, lambda y: y["at"] > w["end"])
            return F.struct(stands.alias("stands"), segment.alias("segment"), followed.alias("followed"), sound.alias("sound"), F.struct(season.alias("season"), first.alias("first"), w["at"].alias("start"), w["end"].alias("end")).alias("found"))

        def chosen(rows: Column) -> Column:
            good = F.filter(rows, lambda c: c["sound"] & ~c["followed"])
            plain = F.when(~F.exists(rows, lambda c: c["followed"]), first_of(good)["found"])
            return F.coalesce(first_of(F.filter(good, lambda c: c["segment"]))["found"], plain)

        return let(F.filter(F.transform(ws, candidate), lambda c: c["stands"]), chosen)

    place = F.regexp_instr(text, F.lit(vocab.word))
    return let(F.struct(words(text).alias("ws"), F.length(text).alias("size"), F.when(place > 0, place - 1).otherwise(F.length(text)).alias("limit")), read)
