"""Registered queries of names, episodes and identities, and SQL for those registered elsewhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import figures as G
from ..functions import names as N
from ..functions import words as W
from ..functions.vocabulary import Vocabulary
from ..operators import episodes, resolve
from .adapters import view
from .base import files, oracle, query

C, L = F.col, F.lit
#: A vocabulary with one group, beside the built-in words and media sources.
SPARKS = Vocabulary(groups=frozenset({"sparks"}))


def _none() -> F.Column:
    return F.lit(None).cast("string")

def _key(x: str) -> str:
    """SQL of the match key of an ASCII text."""
    return rf"regexp_replace(trim(regexp_replace(lower(regexp_replace({x}, '[^0-9A-Za-z ]+', ' ', 'g')), '\s+', ' ', 'g')), '^the (.)', '\1')"


def _base(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({x}, '\s*\([0-9]+\)\s*$', ''), '(?i)\s*,?\s*\bpart two\s*$', ''))"


def _part(x: str) -> str:
    return rf"CASE WHEN regexp_matches({x}, '\([0-9]+\)\s*$') THEN CAST(regexp_extract({x}, '\(([0-9]+)\)\s*$', 1) AS BIGINT) WHEN regexp_matches({x}, '(?i)\bpart two\s*$') THEN 2 END"


def _by(spark, d, kinds: int, *values) -> F.Column:
    """The value of each file by its number modulo ``kinds``."""
    out = F.when(L(False), "")
    for k, v in enumerate(values):
        out = out.when(C("file_id") % kinds == k, v)
    return out


# Names

oracle("f19_parse_episode", r"SELECT name_id, try_cast(regexp_extract(name, 'S(\d\d)E(\d\d)', 1) AS BIGINT) AS season, try_cast(regexp_extract(name, 'S(\d\d)E(\d\d)', 2) AS BIGINT) AS first, try_cast(CASE WHEN name_id % 6 = 3 THEN regexp_extract(name, '-E(\d\d)', 1) ELSE regexp_extract(name, 'S\d\dE(\d\d)', 1) END AS BIGINT) AS last FROM v_name")
oracle("f22_classify", r"SELECT name_id, CASE WHEN regexp_matches(name, 'S\d\dE\d\d') THEN 'tv' ELSE 'movie' END AS kind FROM v_name")
oracle("f14_edition", "SELECT name_id, CASE WHEN name LIKE '% Extended' THEN 'Extended' END AS edition, CASE WHEN name LIKE '% Extended' THEN regexp_replace(name, ' Extended$', ' ') ELSE name END AS without FROM v_name")
# an id from 1900 to 2099 reads as the last year of its folder
_READ = """r AS (SELECT p_partkey AS name_id, CASE WHEN p_partkey % 6 = 1 AND p_partkey BETWEEN 1900 AND 2099 THEN p_partkey ELSE 1950 + p_size END AS y, CASE p_partkey % 6
  WHEN 0 THEN [{'n': p_name, 'd': true, 'l': 'release year'}, {'n': p_name || ' ' || (1950 + p_size), 'd': false, 'l': 'title word'}]
  WHEN 1 THEN [{'n': p_name || CASE WHEN p_partkey BETWEEN 1900 AND 2099 THEN ' (' || (1950 + p_size) || ') [tmdbid' ELSE '' END, 'd': true, 'l': 'release year'}]
  WHEN 2 THEN [{'n': p_name || ' S0' || (1 + p_partkey % 4) || 'E0' || (1 + p_partkey % 8) || ' ' || p_type || ' Part ' || (1 + p_partkey % 3), 'd': false, 'l': NULL}]
  WHEN 3 THEN [{'n': p_name || ' S02E0' || (1 + p_partkey % 8) || '-E0' || (2 + p_partkey % 8), 'd': false, 'l': NULL}]
  WHEN 4 THEN [{'n': 'The ' || p_name || ': ' || p_type || '/' || p_brand || '?', 'd': false, 'l': NULL}]
  ELSE EXTENDED END AS l FROM part)
SELECT name_id, s.n AS name, CAST(CASE WHEN s.d THEN y END AS INT) AS year, s.l AS label FROM (SELECT name_id, y, unnest(l) AS s FROM r)"""
oracle("f27_movie_readings", "WITH " + _READ.replace("EXTENDED", "[{'n': p_name || ' Directors Cut', 'd': true, 'l': 'release year'}, {'n': p_name || ' Directors Cut ' || (1950 + p_size), 'd': false, 'l': 'title word'}, {'n': p_name, 'd': true, 'l': 'edition words removed'}]"))


@query("f26_name_readings", "WITH " + _READ.replace("EXTENDED", "[{'n': p_name || ' Directors Cut', 'd': true, 'l': 'release year'}, {'n': p_name || ' Directors Cut ' || (1950 + p_size) || ' Extended', 'd': false, 'l': 'title word'}]"))
def f26(spark, d):
    return view(spark, d, "v_name").select("name_id", F.inline_outer(N.name_readings(C("name"))))


@query("f1_collapse", r"SELECT name_id, trim(regexp_replace(replace(name, '.', '   '), '\s+', ' ', 'g')) AS text FROM v_name")
def f1(spark, d):
    return view(spark, d, "v_name").select("name_id", N.collapse(F.replace("name", L("."), L(" \t "))).alias("text"))


@query("f3_title_matches_name", "SELECT file_id, file_id % 3 <> 2 AS matches FROM v_file")
def f3(spark, d):
    tag = _by(spark, d, 3, F.concat("title", L(": x?")), F.concat("title", L("/x")), F.concat("title", L(" x")))
    name = _by(spark, d, 3, F.concat("title", L("  x")), F.concat("title", L("-x ")), F.concat("title", L("-x")))
    return files(spark, d).select("file_id", N.title_matches_name(tag, name).alias("matches"))


@query("f4_normalise", r"SELECT name_id, trim(regexp_replace(lower(regexp_replace(replace(name || ' & Co', '&', ' and '), '[^0-9A-Za-z ]+', ' ', 'g')), '\s+', ' ', 'g')) AS text FROM v_name")
def f4(spark, d):
    return view(spark, d, "v_name").select("name_id", N.normalise_for_match(F.concat("name", L(" ＆ Co"))).alias("text"))


@query("f9_folder_agreement", "SELECT name_id, CASE WHEN name_id % 6 <> 1 THEN 'unknown' WHEN name_id % 5 = 0 THEN 'conflict' WHEN name_id % 5 = 1 THEN 'agree' WHEN name_id % 5 = 2 THEN 'agree' WHEN name_id % 5 = 3 THEN 'conflict' ELSE 'unknown' END AS agreement FROM v_name")
def f9(spark, d):
    i = C("name_id")
    tmdb = F.when(i % 5 == 0, "0").when(i % 5 == 1, i.cast("string"))
    imdb = F.when(i % 5 == 2, F.concat(L("TT"), (i + 1000000).cast("string"))).when(i % 5 == 3, "tt1")
    return view(spark, d, "v_name").select("name_id", N.folder_agreement({"tmdb": tmdb, "imdb": imdb}, C("name"), ("tmdb", "imdb")).alias("agreement"))


@query("f10_strip_release_group", r"SELECT name_id, CASE WHEN name_id % 6 = 0 AND name_id % 2 = 0 THEN regexp_replace(name, '-GRP\d$', '') ELSE trim(name) END AS name FROM v_name")
def f10(spark, d):
    return view(spark, d, "v_name").select("name_id", N.strip_release_group(C("name"), (C("name_id") % 2 == 0) & (C("name_id") % 6 == 0)).alias("name"))


@query("f11_name_prefix_keys", r"SELECT name_id, regexp_extract(name, '^(.*\(\d{4}\))', 1) AS key FROM v_name WHERE name_id % 6 = 1 UNION ALL SELECT name_id, regexp_extract(name, '^(.*\(\d{4}\))', 1) || ' and (1999)' FROM v_name WHERE name_id % 6 = 1")
def f11(spark, d):
    text = F.concat(F.regexp_replace("name", r"\) \[.*$", ") and (1999)"), L(" x"))
    return view(spark, d, "v_name").select("name_id", F.explode(N.name_prefix_keys(text)).alias("key"))


@query("f12_strip_release_tag", "SELECT file_id, title || CASE file_id % 5 WHEN 1 THEN ' (Extras)' WHEN 2 THEN ' (Extras) [x264' WHEN 4 THEN ' (PDTV) [kept]' ELSE '' END AS name FROM v_file")
def f12(spark, d):
    tail = _by(spark, d, 5, " (2160p)(x265) [dts] (atmos)(7.1)[1080p]", " (Extras) (1080p) [WEB-DL]", " (Extras) [x264", " [BDMV] (SPARKS foo)", " (PDTV) [kept]")
    return files(spark, d).select("file_id", N.strip_release_tag(F.concat("title", tail), SPARKS).alias("name"))


@query("f13_cut_release_fields", "SELECT file_id, CASE file_id % 6 WHEN 1 THEN '' WHEN 2 THEN 'Proper ' || title WHEN 3 THEN title || ' one two' ELSE title END AS name FROM v_file")
def f13(spark, d):
    dotted = F.replace("title", L(" "), L("."))
    leads = [F.concat(dotted, L(".1080p.BluRay")), F.concat(L("2160p."), dotted), F.concat(L("Proper."), dotted, L(".720p.x264")), F.concat("title", L(" - one ( ) - two-")), F.concat(dotted, L(".DVDRip.x")), F.concat(dotted, L("_AMZN.WEB-DL"))]
    return files(spark, d).select("file_id", N.cut_release_fields(_by(spark, d, 6, *leads)).alias("name"))


@query("f15_strip_edition", "SELECT file_id, CASE file_id % 3 WHEN 0 THEN title || ' 1999' WHEN 1 THEN title || ' 1999 x' ELSE title END AS name, CASE file_id % 3 WHEN 0 THEN NULL WHEN 1 THEN NULL ELSE 'Uncut' END AS label FROM v_file")
def f15(spark, d):
    text = _by(spark, d, 3, F.concat("title", L(" 1999 Extended Cut")), F.concat("title", L(" 1999 (Limited Edition) x")), F.concat("title", L(" Uncut 1999")))
    phrases = N.strip_edition_phrases(text)
    name = F.when(C("file_id") % 3 == 2, F.regexp_replace(phrases["text"], " 1999$", "")).otherwise(N.collapse(N.strip_edition(text)))
    return files(spark, d).select("file_id", name.alias("name"), phrases["label"].alias("label"))


@query("f16_strip_leading_fields", "SELECT file_id, CASE file_id % 4 WHEN 2 THEN '(1999) ' || title ELSE title END AS name FROM v_file")
def f16(spark, d):
    head = _by(spark, d, 4, "[a] (b)[c] [d] www.site.org - 1080p ", "site.tv - [x] 720p.x264.", "(1999) ", "[a] R5 - DVD9.")
    return files(spark, d).select("file_id", N.strip_leading_fields(F.concat(head, "title")).alias("name"))


@query("f20_weak_number", "SELECT file_id, CAST(CASE WHEN ok THEN n // 100 END AS BIGINT) AS season, CAST(CASE WHEN ok THEN n % 100 END AS BIGINT) AS first, CAST(CASE WHEN ok THEN length(title) + CASE file_id % 5 WHEN 0 THEN 3 ELSE 1 END END AS BIGINT) AS start FROM (SELECT *, 101 + file_id % 799 AS n, file_id % 5 IN (0, 1) AND (101 + file_id % 799) % 100 <> 0 AS ok FROM v_file)")
def f20(spark, d):
    n = (101 + C("file_id") % 799).cast("string")
    join = lambda *parts: F.concat("title", *[p if isinstance(p, F.Column) else L(p) for p in parts])
    text = _by(spark, d, 5, join(" - ", n, " - Title"), join(" ", n, " x"), join(" x264 ", n), join(" ", n, " 1999"), join(" h ", n))
    return files(spark, d).select("file_id", W.weak_number(text).alias("w")).select("file_id", *[C(f"w.{c}").cast("long").alias(c) for c in ("season", "first", "start")])


@query("f21_parts_span", "SELECT file_id, CAST(episode AS BIGINT) AS first, CAST(episode + CASE file_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS BIGINT) AS last, CAST(episode AS BIGINT) AS told FROM v_file")
def f21(spark, d):
    tail = _by(spark, d, 4, " - Parts 1-2", " Parts One and Three", " Parts 1-9", " Part 2")
    name = F.concat("show", L(" - "), N.episode_code(C("season"), C("episode")), L(" - x"), tail)
    p = files(spark, d).select("file_id", "episode", N.parse_episode(name).alias("p"))
    # a title that counts the parts itself leaves the first number
    told = F.when(C("p.parts"), N.last_episode(C("p"), L("All of it, Parts 1-2"))).otherwise(C("episode"))
    return p.select("file_id", C("p.first").cast("long").alias("first"), C("p.last").cast("long").alias("last"), told.cast("long").alias("told"))


@query("f24_title_from_filename", "SELECT file_id, title || CASE WHEN file_id % 5 = 3 THEN ' 1080p' ELSE '' END AS title FROM v_file")
def f24(spark, d):
    code = N.episode_code(C("season"), C("episode"))
    named = [F.concat("show", L(" - "), code, L(" - "), "title"), F.concat("show", L(" "), code, L(" "), "title", L(" (1080p)")), F.concat("show", L(" 105 "), "title"), F.concat("show", L(" - "), code, L(" - "), "title", L(" 1080p-SPARKS")), F.concat("show", L("."), code, L("."), "title", L(" [TVRip] (foo SPARKS)"))]
    path = F.concat(L("lib/x/Season 0"), C("season").cast("string"), L("/"), _by(spark, d, 5, *named), L(".mkv"))
    return files(spark, d).select("file_id", N.title_from_filename(path, vocab=SPARKS).alias("title"))


@query("f25_without_show", "SELECT file_id, CASE WHEN file_id % 3 < 2 THEN title END AS rest FROM v_file")
def f25(spark, d):
    text = _by(spark, d, 3, F.concat("show", L(" - "), "title"), F.concat(L("The "), F.lower("show"), L(": "), "title"), C("title"))
    return files(spark, d).select("file_id", N.without_show(text, C("show")).alias("rest"))


@query("f28_name_score", "SELECT file_id, CASE file_id % 4 WHEN 0 THEN 1.0 WHEN 1 THEN 0.9 WHEN 2 THEN 0.0 ELSE 1.0 END::DOUBLE AS score FROM v_file")
def f28(spark, d):
    other = _by(spark, d, 4, F.upper("title"), F.concat(L("big "), "title", L(" here")), L("?!"), F.concat(L("The "), "title"))
    return files(spark, d).select("file_id", resolve.name_score(C("title"), C("title"), other).alias("score"))


@query("f30_expand_initials", "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN lower(title) || ' story' END AS expanded, file_id % 2 = 0 AS spells FROM v_file")
def f30(spark, d):
    words = F.split("title", " ")
    short = F.when(C("file_id") % 2 == 0, F.array_join(F.transform(words, lambda w: F.substring(w, 1, 1)), "")).otherwise("zz")
    named = F.concat("title", L(" story"))
    return files(spark, d).select("file_id", resolve.expand_initials(F.concat(short, L(" story")), named).alias("expanded"), resolve.spells_initials(F.array(short), F.array(named)).alias("spells"))


@query("f31_drop_abbreviations", "SELECT file_id, CASE WHEN file_id % 3 > 0 THEN title END AS rest, CASE file_id % 3 WHEN 1 THEN 'xx' WHEN 2 THEN 'xx yy' END AS removed FROM v_file")
def f31(spark, d):
    head = _by(spark, d, 3, "", "xx ", "xx yy ")
    known = F.concat(F.slice(F.array(L(False), L(False)), L(1), (C("file_id") % 3).cast("int")), F.array(L(True), L(False)))
    return files(spark, d).select("file_id", resolve.drop_abbreviations(F.concat(head, "title"), known).alias("d")).select("file_id", "d.rest", "d.removed")


@query("f33_edition_of", "SELECT file_id, CASE file_id % 4 WHEN 0 THEN 'Extended' WHEN 1 THEN 'Uncut' WHEN 2 THEN 'Festival' END AS edition FROM v_file")
def f33(spark, d):
    source = _by(spark, d, 4, F.concat("title", L(" 1999 Extended/x.mkv")), F.concat(L("a 1999 Extended/"), "title", L(" 1999 Uncut.mkv")), F.concat("title", L("/x.mkv")), F.concat("title", L("/x.mkv")))
    origin = F.when(C("file_id") % 4 == 2, F.concat(L("o/"), "title", L(" 1999 Festival Cut.mkv"))).otherwise("o/x.mkv")
    return files(spark, d).select("file_id", N.edition_of(source, origin).alias("edition"))


@query("f34_year_accepted", "SELECT file_id, file_id % 5 = 0 OR file_id % 7 = 0 OR abs(file_id % 4 - 1) <= 1 AS accepted FROM v_file")
def f34(spark, d):
    i = C("file_id")
    return files(spark, d).select("file_id", G.year_accepted(F.when(i % 7 != 0, C("year")), C("year") + i % 4 - 1, i % 5 == 0).alias("accepted"))


@query("f35_missing_fields", "SELECT file_id, CASE WHEN kind = 'movie' THEN concat_ws(',', CASE WHEN file_id % 2 = 0 THEN 'title' END, CASE WHEN file_id % 5 = 0 AND file_id % 7 <> 0 THEN 'imdb' END) ELSE concat_ws(',', 'show_year', CASE WHEN file_id % 7 <> 0 THEN 'tvdb' END, CASE WHEN file_id % 7 = 0 THEN 'episode_title' END) END AS missing FROM v_file")
def f35(spark, d):
    i = C("file_id")
    fields = {
        "title": F.when(i % 2 != 0, C("title")).otherwise(""), "year": C("year"), "tmdb": C("tmdb"), "imdb": F.when(i % 5 != 0, "tt1"), "show": C("show"), "show_year": F.lit(None).cast("int"), "tvdb": _none(),
        "season": L(0), "episode": L(0), "episode_title": L(""),
    }
    return files(spark, d).select("file_id", F.array_join(G.missing_fields(C("kind"), fields, i % 7 == 0), ",").alias("missing"))


@query("p20_extras_reason", "SELECT file_id, CASE file_id % 5 WHEN 0 THEN 'file name carries ''trailer''' WHEN 1 THEN 'file name ends in the segment ''proof''' WHEN 2 THEN 'sits in a ''Deleted Scenes'' folder' END AS reason FROM v_file")
def p20(spark, d):
    path = _by(spark, d, 5, F.concat(L("x/"), "title", L(" - Trailer.mkv")), F.concat(L("x/"), "title", L(" - proof.mkv")), F.concat(L("Deleted Scenes/"), "title", L(".mkv")), F.concat(L("x/"), "show", L(" S01E02 - Proof.mkv")), F.concat(L("x/"), "title", L(".mkv")))
    return files(spark, d).select("file_id", N.extras_reason(path).alias("reason"))


# Episodes

_EP = f"c AS (SELECT *, {_key('title')} AS key, {_key(_base('title'))} AS base, {_part('title')} AS part FROM v_episode), ex AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY show, key ORDER BY ordinal) = 1), bi AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY show, base ORDER BY season, episode, ordinal) = 1), pi AS (SELECT * FROM c WHERE part IS NOT NULL QUALIFY row_number() OVER (PARTITION BY show, base, part ORDER BY ordinal) = 1)"
_PROBE = "p0 AS (SELECT ordinal AS probe_id, show, CASE ordinal % 4 WHEN 0 THEN upper(title) WHEN 1 THEN title || ' extra words here' WHEN 2 THEN replace(title, 'e', 'a') ELSE title END AS text, season, episode AS first FROM v_episode)"
oracle("w4_base_index", f"WITH {_EP} SELECT show, base, season, episode, ordinal FROM bi")
oracle(
    "j9_match_exact",
    f"""WITH {_EP}, {_PROBE}, p AS (SELECT *, {_key('text')} AS k, {_key(_base('text'))} AS b, {_part('text')} AS n FROM p0)
SELECT p.probe_id, CAST(CASE WHEN h1.show IS NOT NULL THEN 1 WHEN h2.show IS NOT NULL THEN 2 WHEN h3.show IS NOT NULL THEN 3 WHEN h4.show IS NOT NULL THEN 4 WHEN h5.show IS NOT NULL AND p.n IS NULL THEN 5 END AS INT) AS rung,
  coalesce(h1.season, h2.season, h3.season, h4.season, CASE WHEN p.n IS NULL THEN h5.season END) AS season, coalesce(h1.episode, h2.episode, h3.episode, h4.episode, CASE WHEN p.n IS NULL THEN h5.episode END) AS episode,
  coalesce(h1.title, h2.title, h3.title, h4.title, CASE WHEN p.n IS NULL THEN h5.title END) AS title
FROM p LEFT JOIN ex h1 ON h1.show = p.show AND h1.key = p.k LEFT JOIN pi h2 ON h2.show = p.show AND h2.base = p.b AND h2.part = p.n LEFT JOIN bi h3 ON h3.show = p.show AND h3.base = p.k LEFT JOIN ex h4 ON h4.show = p.show AND h4.key = p.b LEFT JOIN bi h5 ON h5.show = p.show AND h5.base = p.b""",
)
oracle(
    "j10_match_contained",
    f"""WITH {_EP}, {_PROBE}, p AS (SELECT probe_id, show, season, first, {_part('text')} AS n, CASE WHEN {_part('text')} IS NULL THEN {_key('text')} ELSE {_key(_base('text'))} END AS k FROM p0),
h AS (SELECT p.*, bi.base, bi.season AS bs, bi.episode AS be, array_length(string_split(bi.base, ' ')) / CAST(array_length(string_split(p.k, ' ')) AS DOUBLE) AS share FROM p JOIN bi ON bi.show = p.show AND bi.base <> '' AND (p.k = bi.base OR starts_with(p.k, bi.base || ' ')) QUALIFY row_number() OVER (PARTITION BY p.probe_id ORDER BY length(bi.base) DESC, bi.base DESC) = 1),
j AS (SELECT h.*, CASE WHEN n IS NULL THEN bs ELSE pi.season END AS s, CASE WHEN n IS NULL THEN be ELSE pi.episode END AS e FROM h LEFT JOIN pi ON pi.show = h.show AND pi.base = h.base AND pi.part = h.n)
SELECT probe_id, s AS season, e AS episode, round(share, 6) AS share, share >= 0.5 OR (s = season AND e = first) AS accepted FROM j WHERE s IS NOT NULL""",
)
_CASCADE = f"""{_EP}, li AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY show, season, episode ORDER BY title) = 1),
q AS (SELECT file_id, show, season, episode, file_id % 12 AS k, {_key('title')} AS t, length({_key('title')}) AS n FROM v_file),
x AS (SELECT q.*, li.title AS lt, len(list_intersect(string_split(li.key, ' '), string_split(q.t, ' '))) = 0 AS apart, bi.season = q.season AND bi.episode = q.episode AS own,
  CASE WHEN k = 9 THEN coalesce(e2.title, pi.title, ex.title) WHEN k = 10 THEN coalesce(e3.title, pi.title, ex.title) WHEN k IN (3, 6, 7) THEN bi.title WHEN k = 5 THEN coalesce(ex.title, e0.title, e9.title, CASE WHEN 2 * n / (2 * n + 3) >= 0.82 THEN coalesce(e2.title, e1.title) END) ELSE coalesce(ex.title, bi.title) END AS title,
  CASE WHEN k = 9 THEN coalesce(e2.season, pi.season, ex.season) WHEN k = 10 THEN coalesce(e3.season, pi.season, ex.season) WHEN k IN (3, 6, 7) THEN bi.season WHEN k = 5 THEN coalesce(ex.season, e0.season, e9.season, CASE WHEN 2 * n / (2 * n + 3) >= 0.82 THEN coalesce(e2.season, e1.season) END) ELSE coalesce(ex.season, bi.season) END AS s,
  CASE WHEN k = 9 THEN coalesce(e2.episode, pi.episode, ex.episode) WHEN k = 10 THEN coalesce(e3.episode, pi.episode, ex.episode) WHEN k IN (3, 6, 7) THEN bi.episode WHEN k = 5 THEN coalesce(ex.episode, e0.episode, e9.episode, CASE WHEN 2 * n / (2 * n + 3) >= 0.82 THEN coalesce(e2.episode, e1.episode) END) ELSE coalesce(ex.episode, bi.episode) END AS e, ex.title IS NOT NULL AS plain, e0.title IS NOT NULL AS shorter, e9.title IS NOT NULL AS longer
  FROM q LEFT JOIN ex ON ex.show = q.show AND ex.key = t LEFT JOIN bi ON bi.show = q.show AND bi.base = t LEFT JOIN pi ON pi.show = q.show AND pi.base = t AND pi.part = 2
  LEFT JOIN ex e0 ON e0.show = q.show AND e0.key = substr(t, 2) LEFT JOIN ex e9 ON e9.show = q.show AND e9.key = 'c' || t LEFT JOIN ex e1 ON e1.show = q.show AND e1.key = t || ' 1' LEFT JOIN ex e2 ON e2.show = q.show AND e2.key = t || ' 2' LEFT JOIN ex e3 ON e3.show = q.show AND e3.key = t || ' part two' LEFT JOIN li ON li.show = q.show AND li.season = q.season AND li.episode = q.episode),
f AS (SELECT file_id, show, season AS own_s, episode AS own_e, lt, CASE WHEN method <> 'none' THEN s END AS s, CASE WHEN method <> 'none' THEN e END AS e, CASE WHEN method <> 'none' THEN title END AS t, method,
  CAST(round(CASE method WHEN 'exact' THEN 1.0 WHEN 'contains' THEN CASE WHEN k = 3 THEN 0.5 ELSE 2 / 6 END WHEN 'fuzzy' THEN CASE WHEN plain THEN 2 * n / (2 * n + 1) WHEN shorter THEN (n - 1) / n WHEN longer THEN n / (n + 1) ELSE 2 * n / (2 * n + 3) END ELSE 0.0 END, 6) AS DOUBLE) AS score
  FROM (SELECT *, CASE WHEN title IS NULL OR k = 8 THEN 'none' WHEN k = 5 THEN 'fuzzy' WHEN k = 3 THEN 'contains' WHEN k IN (6, 7) THEN CASE WHEN own OR apart THEN 'contains' ELSE 'none' END ELSE 'exact' END AS method FROM x))"""
oracle("j26_match_episodes", f"WITH {_CASCADE} SELECT file_id, method, s AS season, e AS episode, score FROM f")
oracle(
    "j27_identify_tv",
    f"""WITH {_CASCADE}, g AS (SELECT file_id, show, coalesce(s, own_s) AS season, coalesce(e, own_e) AS episode, coalesce(t, lt) AS t, CASE WHEN method = 'none' THEN 'number' ELSE method END AS method, score FROM f)
SELECT file_id, show, season, episode, CAST(NULL AS BIGINT) AS last, CASE WHEN {_part('t')} IS NOT NULL THEN {_base('t')} || ', Part ' || ({_part('t')}) ELSE t END AS title, true AS shared, method, score FROM g""",
)
oracle(
    "j13_episode_range",
    f"""WITH c AS (SELECT show, season, episode, title, runtime, {_base('title')} AS base FROM v_episode QUALIFY row_number() OVER (PARTITION BY show, season, episode ORDER BY title) = 1),
m AS (SELECT file_id, show, season, episode, title, file_id % 3 AS span, duration_s FROM v_file),
s AS (SELECT m.file_id, count(*) AS listed, count(DISTINCT c.base) AS bases, min(c.base) AS base, sum(c.runtime) AS together, count(c.runtime) AS timed FROM m JOIN c ON c.show = m.show AND c.season = m.season AND c.episode BETWEEN m.episode AND m.episode + m.span WHERE m.span > 0 GROUP BY m.file_id),
j AS (SELECT m.*, s.base, coalesce(listed = span + 1, false) AND span > 0 AS whole, coalesce(bases = 1 AND s.base <> '', false) AS one, coalesce(timed = span + 1 AND duration_s > 0 AND abs(duration_s - c.runtime * 60) < abs(duration_s - together * 60), false) AS single
  FROM m LEFT JOIN s ON s.file_id = m.file_id LEFT JOIN c ON c.show = m.show AND c.season = m.season AND c.episode = m.episode)
SELECT file_id, CASE WHEN whole AND (one OR NOT single) THEN episode + span END AS last, CASE WHEN whole AND (one OR NOT single) AND one THEN base ELSE title END AS title, CASE WHEN whole AND (one OR NOT single) THEN one ELSE true END AS shared FROM j""",
)


@query("u7_shared_words", f"SELECT a.file_id, array_to_string(list_sort(list_intersect(string_split({_key('a.title')}, ' '), string_split({_key('b.title')}, ' '))), ' ') AS words FROM v_file a JOIN v_file b ON b.file_id = a.file_id + 1")
def u7(spark, d):
    f = files(spark, d)
    nxt = f.select((C("file_id") - 1).alias("file_id"), C("title").alias("other"))
    return f.join(nxt, "file_id").select("file_id", F.array_join(F.array_sort(episodes.shared_words(C("title"), C("other"))), " ").alias("words"))


# Identity

oracle(
    "j15_search_candidates",
    """WITH n AS (SELECT DISTINCT tmdb, title AS key FROM v_file), r AS (SELECT file_id AS title_id, title AS key FROM v_file WHERE kind = 'movie'), k AS (SELECT DISTINCT key FROM r),
w AS (SELECT k.key, n.tmdb, CASE WHEN k.key = n.key THEN 1048576 ELSE len(list_intersect(string_split(k.key, ' '), string_split(n.key, ' '))) END AS shared FROM k, n),
t AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY shared DESC, tmdb) AS rank FROM w WHERE shared > 0)
SELECT title_id, tmdb, CAST(shared AS BIGINT) AS shared, CAST(rank AS INT) AS rank FROM r JOIN t USING (key) WHERE rank <= 10""",
)
oracle(
    "f32_trailing_drops",
    """WITH n AS (SELECT file_id, year, string_split(title || CASE file_id % 4 WHEN 0 THEN '' WHEN 1 THEN ' the third' WHEN 2 THEN ' of the old days' ELSE ' x' END, ' ') AS w FROM v_file), t AS (SELECT *, CASE WHEN file_id % 4 = 3 THEN list_concat(['The'], w) ELSE w END AS ws FROM n WHERE file_id % 5 <> 0),
d AS (SELECT *, unnest(range(1, len(ws) // 2 + 1)) AS k FROM t)
SELECT file_id AS title_id, array_to_string(ws[1:len(ws) - k], ' ') AS name, CAST(year AS INT) AS year, CAST(k AS INT) AS dropped FROM d WHERE lower(array_to_string(ws[1:len(ws) - k], ' ')) NOT IN ('the', 'a', 'an', '')""",
)
oracle(
    "p70_movie_ladder",
    """WITH r AS (SELECT name_id AS title_id, unnest([{'p': 0, 'r': 'embedded tag', 'i': false, 'n': 1}, CASE WHEN name_id % 6 = 1 THEN {'p': 2, 'r': 'folder ids', 'i': true, 'n': 0} END, {'p': 5, 'r': 'file name', 'i': false, 'n': 1}, {'p': 6, 'r': 'folder', 'i': false, 'n': CASE name_id % 6 WHEN 0 THEN 2 WHEN 5 THEN 3 ELSE 1 END}]) AS s FROM v_name)
SELECT title_id, CAST(s.p AS INT) AS place, s.r AS rung, s.i AS by_id, CAST(s.n AS INT) AS n_readings FROM r WHERE s IS NOT NULL""",
)


@query("p70_show_ladder", "SELECT file_id AS title_id, CAST(s.p AS BIGINT) AS place, s.r AS rung, s.i AS by_id FROM (SELECT file_id, unnest([{'p': 0, 'r': 'embedded tag', 'i': file_id % 2 = 0}, {'p': 2, 'r': 'upper folder ids', 'i': true}, {'p': 5, 'r': 'file name', 'i': false}]) AS s FROM v_file WHERE kind = 'tv')")
def p70_shows(spark, d):
    i = C("file_id")
    path = F.concat(L("lib/"), "show", L(" (1999) [tvdbid-"), i.cast("string"), L("]/Season 01/"), "show", L(" - S01E02 - x.mkv"))
    rows = files(spark, d).where("kind = 'tv'").select(i.alias("title_id"), path.alias("path"), _none().alias("origin"), F.when(i % 2 == 0, i.cast("string")).alias("tag_tvdb"), _none().alias("tag_tmdb"), C("show").alias("tag_show"))
    return resolve.show_ladder(rows).select("title_id", C("place").cast("long").alias("place"), "rung", "by_id")


def _word_name(i: F.Column) -> F.Column:
    """A name of two words that no other file's name is like."""
    h = F.md5(i.cast("string"))
    return F.concat(F.substring(h, 1, 8), L(" "), F.substring(h, 9, 8))


_WORD_NAME = "substr(md5(CAST(file_id AS VARCHAR)), 1, 8) || ' ' || substr(md5(CAST(file_id AS VARCHAR)), 9, 8)"


@query("j30_search_with_retries", f"SELECT file_id AS title_id, tmdb, CAST(1 + file_id % 3 AS BIGINT) AS step, {_WORD_NAME} AS wanted FROM v_file")
def j30(spark, d):
    i = C("file_id")
    f = files(spark, d)
    names = f.select("tmdb", _word_name(i).alias("name"))
    reads = f.select(i.alias("title_id"), F.concat(F.when(i % 3 == 1, "zqzqzqzqzqzqzqzqzqzq ").otherwise(""), _word_name(i), F.when(i % 3 == 2, " kkkkkkkkkkkk vvvvvvvvvvvv").otherwise("")).alias("name"), C("year").cast("int").alias("year"))
    known = spark.read.parquet(f"{d}/region.parquet").select(F.explode(F.array(L("kkkkkkkkkkkk"), L("vvvvvvvvvvvv"), F.lower("r_name"))).alias("word"))
    # the names' own words are words, also where a hash has letters only
    known = known.unionByName(names.select(F.explode(F.split("name", " ")).alias("word"))).distinct()
    return resolve.search_with_retries(reads, names, known).select("title_id", "tmdb", C("step").cast("long").alias("step"), "wanted")


@query("f29_candidate_score", f"SELECT file_id AS title_id, {_WORD_NAME} AS wanted, tmdb, CAST(CASE WHEN file_id % 2 = 0 THEN 1.0 ELSE 0.9 END AS DOUBLE) AS score FROM v_file")
def f29(spark, d):
    i = C("file_id")
    f = files(spark, d)
    pairs = f.select(i.alias("title_id"), _word_name(i).alias("wanted"), "tmdb")
    names = f.select("tmdb", F.explode(F.array(F.concat(L("More of "), _word_name(i)), F.when(i % 2 == 0, F.upper(_word_name(i))).otherwise("?"))).alias("name"))
    return resolve.candidate_score(pairs, names)


def _scored(spark, d) -> DataFrame:
    """Three candidates of each file, with scores, completeness and years that differ."""
    i = C("file_id")
    rows = files(spark, d).select(i.alias("title_id"), C("year").cast("int").alias("name_year"), F.posexplode(F.array(L("a"), L("b"), L("c"))).alias("at", "tmdb"))
    t, at = C("title_id"), C("at")
    return rows.withColumns({"score": (L(0.8) + ((t * (at + 1)) % 5) * 0.05), "complete": (t + at) % 3 != 0, "entity_year": C("name_year") + (t * at) % 4 - 1, "pinned": t % 11 == 0})


_SCORED = "s AS (SELECT *, CAST(0.8 AS DOUBLE) + ((title_id * (at + 1)) % 5) * CAST(0.05 AS DOUBLE) AS score, (title_id + at) % 3 <> 0 AS complete, year + (title_id * at) % 4 - 1 AS entity_year, title_id % 11 = 0 AS pinned FROM (SELECT file_id AS title_id, year, unnest(['a', 'b', 'c']) AS tmdb, unnest([0, 1, 2]) AS at FROM v_file))"


@query(
    "w10_top_candidates",
    f"""WITH {_SCORED}, o AS (SELECT * FROM s WHERE score >= CASE WHEN pinned THEN 0 ELSE 0.82 END AND (pinned OR abs(entity_year - year) <= 1)),
t AS (SELECT *, max(score) OVER (PARTITION BY title_id) AS top, max(CASE WHEN complete THEN score END) OVER (PARTITION BY title_id) AS tc FROM o),
b AS (SELECT * FROM t WHERE CASE WHEN coalesce(tc >= top, false) THEN complete AND score = tc ELSE score = top END)
SELECT title_id, tmdb, round(score, 6) AS score, complete, count(*) OVER (PARTITION BY title_id) > 1 AS tied FROM b""",
)
def w10_top(spark, d):
    return resolve.top_candidates(_scored(spark, d)).withColumn("score", F.round("score", 6))


@query(
    "w18_best_reading",
    f"""WITH {_SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY title_id ORDER BY score DESC, complete DESC, at) AS n, max(score) OVER (PARTITION BY title_id) AS top FROM s),
e AS (SELECT title_id, count(DISTINCT tmdb) AS k FROM r WHERE score = top AND complete GROUP BY title_id)
SELECT r.title_id, tmdb, round(score, 6) AS score, complete, coalesce(k, 0) > 1 AS tied FROM r LEFT JOIN e ON e.title_id = r.title_id WHERE n = 1""",
)
def w18(spark, d):
    rows = _scored(spark, d).withColumns({"rung": L("file name"), "place": C("at")})
    return resolve.best_reading(rows).select("title_id", "tmdb", F.round("score", 6).alias("score"), "complete", "tied")


@query("o8_top_k", f"WITH {_SCORED} SELECT title_id, tmdb, CAST(n AS INT) AS rank FROM (SELECT title_id, tmdb, row_number() OVER (PARTITION BY title_id ORDER BY score DESC, tmdb) AS n FROM s) WHERE n <= 2")
def o8(spark, d):
    return resolve.top_k(_scored(spark, d), ["title_id"], [F.desc("score"), F.asc("tmdb")], 2).select("title_id", "tmdb", "rank")


@query(
    "a16_agreeing_rungs",
    """SELECT title_id, rungs FROM (SELECT file_id AS title_id, CASE WHEN file_id % 3 <> 0 AND file_id % 4 <> 0 THEN CASE WHEN file_id % 5 <> 0 THEN 'tag,folder ids' END WHEN file_id % 3 <> 0 THEN 'tag' WHEN file_id % 4 <> 0 THEN 'folder ids' WHEN file_id % 2 = 0 THEN 'file name,folder' END AS rungs FROM v_file) WHERE rungs IS NOT NULL""",
)
def a16(spark, d):
    """Ids that agree, disagree, or are told by one rung only; names where no rung has ids."""
    i, own, f = C("file_id"), C("tmdb"), files(spark, d)
    rung = lambda place, name, by_id, tmdb, complete: f.select(i.alias("title_id"), L(place).alias("place"), L(name).alias("rung"), L(by_id).alias("by_id"), tmdb.alias("tmdb"), complete.alias("complete"))
    rungs = rung(0, "tag", True, own, i % 3 != 0).unionByName(rung(1, "folder ids", True, F.when(i % 5 == 0, "x").otherwise(own), i % 4 != 0))
    rungs = rungs.unionByName(rung(2, "file name", False, own, L(True))).unionByName(rung(3, "folder", False, F.when(i % 2 == 0, own).otherwise("y"), L(True)))
    return resolve.agreeing_rungs(rungs).select("title_id", F.array_join("rungs", ",").alias("rungs"))


@query("a25_hold_guesses", f"WITH {_SCORED}, g AS (SELECT title_id, string_agg(tmdb, ',' ORDER BY tmdb) AS g FROM s WHERE score = (SELECT max(score) FROM s x WHERE x.title_id = s.title_id) GROUP BY title_id) SELECT file_id AS title_id, CASE WHEN file_id % 3 = 0 THEN 'x,y' WHEN file_id % 3 = 1 THEN 'z' ELSE g END AS guesses FROM v_file JOIN g ON g.title_id = file_id")
def a25(spark, d):
    titles = files(spark, d).select(C("file_id").alias("title_id"))
    tied = titles.where("title_id % 3 = 0").withColumn("tmdb", F.explode(F.array(L("y"), L("x"))))
    resolved = titles.where("title_id % 3 < 2").withColumn("tmdb", L("z"))
    return resolve.hold_guesses(titles, tied, resolved, _scored(spark, d)).select("title_id", F.array_join("guesses", ",").alias("guesses"))


@query("j23_unknown_words", "SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(string_split(title, ' ')) AS w FROM v_file) WHERE length(w) <> 3")
def j23(spark, d):
    tokens = files(spark, d).select(F.explode(F.split(F.concat(L("("), "title", L(").")), " ")).alias("token")).distinct()
    known = files(spark, d).select(F.explode(F.split("title", " ")).alias("word")).where("length(word) = 3").distinct()
    return resolve.unknown_words(tokens, known).select("word").distinct()


@query("j28_apply_pinned", "SELECT file_id AS title_id, CASE WHEN file_id % 2 = 0 THEN 'Own' WHEN file_id % 3 <> 0 THEN title END AS title, CAST(CASE WHEN file_id % 3 <> 0 THEN year END AS BIGINT) AS year, file_id % 3 = 0 AS manual, CASE WHEN file_id % 2 = 0 AND file_id % 3 <> 0 THEN 'title Own instead of ' || title ELSE '' END AS notes FROM v_file")
def j28(spark, d):
    i = C("file_id")
    f = files(spark, d)
    titles = f.select(i.alias("title_id"), F.when(i % 2 == 0, "Own").alias("title"), L(None).cast("int").alias("year"), _none().alias("imdb"), "tmdb")
    entities = f.where("file_id % 3 <> 0").select("tmdb", C("title").alias("label"), "year", _none().alias("imdb"))
    return resolve.apply_pinned(titles, entities).select("title_id", "title", C("year").cast("long").alias("year"), "manual", F.array_join("notes", "; ").alias("notes"))


@query("p66_identification_outcome", "SELECT file_id AS title_id, CASE file_id % 6 WHEN 0 THEN 'sources disagree: a, b' WHEN 1 THEN 'several entities fit: the name gives no year' WHEN 2 THEN 'several entities fit: both were released in the same year' WHEN 3 THEN 'a bare number is no listed episode' WHEN 4 THEN 'missing year, imdb' ELSE 'nothing found' END AS problem FROM v_file")
def p66(spark, d):
    k = C("file_id") % 6
    rows = files(spark, d).select(
        C("file_id").alias("title_id"), F.when(k == 0, "disagreement").otherwise("incomplete").alias("outcome"), F.array(L("a"), L("b")).alias("entities"), k.isin(1, 2).alias("tied"), (k == 2).alias("same_year"),
        F.when(k != 1, C("year")).alias("name_year"), (k == 3).alias("weak_unlisted"), F.when(k == 4, F.array(L("year"), L("imdb"))).otherwise(F.array().cast("array<string>")).alias("missing"),
    )
    return resolve.identification_outcome(rows)


@query("p74_poster_url", "SELECT file_id, CASE WHEN file_id % 2 = 0 THEN 'https://images.example/w342/p' || file_id || '.jpg' END AS poster_url FROM v_file")
def p74(spark, d):
    f = files(spark, d)
    posters = f.select("tmdb", F.when(C("file_id") % 2 == 0, F.concat(L("/p"), C("file_id").cast("string"), L(".jpg"))).alias("poster_path"))
    return resolve.poster_url(f.select("file_id", "tmdb"), posters).select("file_id", "poster_url")


@query("w11_first_folder", "SELECT kind, min(title) AS folder FROM v_file GROUP BY kind")
def w11(spark, d):
    return resolve.first_folder(files(spark, d).select("kind", C("title").alias("folder")), ["kind"])


@query("w13_pick_file", "SELECT show AS folder, min(show || ' ' || file_id || '.mkv') AS name FROM v_file GROUP BY show")
def w13(spark, d):
    plain = F.concat("show", L(" "), C("file_id").cast("string"), L(".mkv"))
    rows = files(spark, d).select(C("show").alias("folder"), F.explode(F.array(plain, F.concat("show", L(" - A"), C("file_id").cast("string"), L(".mkv")))).alias("name"))
    return resolve.pick_file(rows)


@query(
    "j3_tv_incumbents",
    """WITH t AS (SELECT file_id, show, season, episode FROM v_file WHERE kind = 'tv'), f AS (SELECT DISTINCT show, show || ' (1999) [tvdbid-' || substr(show, 7) || ']' AS folder FROM t)
SELECT t.file_id AS title_id, f.folder, CASE WHEN t.file_id % 2 = 0 THEN (SELECT min(show || ' - S' || lpad(CAST(season AS VARCHAR), 2, '0') || 'E' || lpad(CAST(episode AS VARCHAR), 2, '0') || ' - ' || file_id || '.mkv') FROM v_file g WHERE g.kind = 'tv' AND g.file_id % 2 = 0 AND g.show = t.show AND g.season = t.season AND g.episode = t.episode)
  ELSE (SELECT min(show || ' - S' || lpad(CAST(season AS VARCHAR), 2, '0') || 'E' || lpad(CAST(episode AS VARCHAR), 2, '0') || ' - ' || file_id || '.mkv') FROM v_file g WHERE g.kind = 'tv' AND g.file_id % 2 = 0 AND g.show = t.show AND g.season = t.season AND g.episode = t.episode) END AS file FROM t JOIN f ON f.show = t.show""",
)
def j3(spark, d):
    f = files(spark, d).where("kind = 'tv'")
    number = F.substring_index("show", "#", -1)
    folder = F.concat("show", L(" (1999) [tvdbid-"), number, L("]"))
    # by id or, for one in three, by name
    by_name = C("file_id") % 3 == 1
    ids = f.select(C("file_id").alias("title_id"), "show", L(1999).alias("show_year"), F.when(~by_name, number).alias("tvdb"), _none().alias("tmdb"), "season", "episode", F.lit(None).cast("int").alias("episode_last"))
    inside = f.where("file_id % 2 = 0").select(folder.alias("folder"), "season", F.concat("show", L(" - "), N.episode_code(C("season"), C("episode")), L(" - "), C("file_id").cast("string"), L(".mkv")).alias("name"))
    return resolve.tv_incumbents(ids, f.select(folder.alias("folder")).distinct(), inside).select("title_id", "folder", "file")


@query(
    "j31_find_incumbents",
    """SELECT file_id AS title_id, CAST(a AS BIGINT) AS area, CASE WHEN NOT has THEN 'no folder' WHEN a = 0 AND file_id % 5 = 0 THEN 'no file in the folder' END AS missing, CASE WHEN has AND NOT (a = 0 AND file_id % 5 = 0) THEN 'x.mkv' END AS file
FROM (SELECT file_id, a, CASE WHEN a = 0 THEN file_id % 2 = 0 ELSE file_id % 3 = 0 END AS has FROM v_file, (VALUES (0), (1)) t(a))""",
)
def j31(spark, d):
    i = C("file_id")
    f = files(spark, d)
    folder = F.concat("title", L(" (1999) [tmdbid-"), "tmdb", L("]"))
    ids = f.select(i.alias("title_id"), "title", L(1998).alias("year"), "tmdb", _none().alias("imdb"))
    area = lambda rows, gaps: (rows.select(folder.alias("folder")), rows.where(gaps).select(folder.alias("folder"), L("x.mkv").alias("name")))
    out = resolve.find_incumbents(ids, [area(f.where("file_id % 2 = 0"), i % 5 != 0), area(f.where("file_id % 3 = 0"), L(True))])
    return out.select("title_id", C("area").cast("long").alias("area"), "missing", "file")
