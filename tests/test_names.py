"""Worked examples of names and figures."""

import difflib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from catalogkit.functions import figures as G
from catalogkit.functions import helpers as H
from catalogkit.functions import names as N
from catalogkit.functions import vocabulary as V


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return row.select(expr.alias("x")).first()["x"]


def each(spark, expr, texts):
    """``expr`` of column s for each text, in one run."""
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", expr.alias("x")).collect()
    return [r.x for r in sorted(rows, key=lambda r: r.i)]


def movies(spark, names):
    rows = N.with_movie_readings(spark.createDataFrame(list(enumerate(names)), "i int, s string"), x=F.col("s")).collect()
    return [[(x.name, x.year) for x in r.x] for r in sorted(rows, key=lambda r: r.i)]


@pytest.mark.parametrize(
    "f,s,want",
    [
        (N.to_filename, "Star Wars: Episode VI – Return of the Jedi", "Star Wars Episode VI - Return of the Jedi"),
        (N.to_filename, "AC/DC?", "AC-DC"),
        (N.match_key, "The Wire", "wire"),
        (N.match_key, "The", "the"),
        (N.match_key, "Ｆｕｌｌ & Wide", "full and wide"),
        (N.validate_component, "NUL.mkv", ["reserved-device-name"]),
        (N.validate_component, "End.", ["trailing-period-or-space"]),
        (N.to_part_suffix, "Pilot (2)", "Pilot, Part 2"),
        (N.to_part_suffix, "Rising, Part Two", "Rising, Part 2"),
        (N.to_part_suffix, "Part 1", "Part 1"),
        (N.to_part_suffix, "Rising (Part Two)", "Rising, Part 2"),
        (N.to_part_suffix, "Rising - pt. 3", "Rising, Part 3"),
        (N.to_part_suffix, "Counterpart 2", "Counterpart 2"),
        (N.strip_release_tag, "Film (2160p)(x265)(dts)(atmos)(7.1)", "Film"),
        (N.strip_release_tag, "Film (Extras) (2160p) [kept] (x265)", "Film (Extras) (2160p) [kept]"),
        (N.strip_leading_fields, "[a][b] [c] (d)[e] 1080p Movie", "Movie"),
        (N.strip_leading_fields, "(1999) Movie", "(1999) Movie"),
        (N.tidy_name, " - A -  B ( ) -", "A B"),
        (N.season_from_folder, "Show/Season 3 extra/x.mkv", None),
        (N.strip_release_tag, "Title (1080p BluRay) [x264]", "Title"),
        (N.cut_release_fields, "Some.Movie.1080p.WEB-DL", "Some Movie"),
        (N.cut_release_fields, "1080p.Movie", ""),
        (N.cut_release_fields, "Proper.Movie.720p", "Proper Movie"),
        (N.strip_leading_fields, "[Group] www.site.com - Movie", "Movie"),
        (N.edition_from_name, "Movie 1999 Directors Cut 1080p.mkv", "Director's Cut"),
        (N.edition_from_name, "The Final Cut Story", None),
        (N.season_from_folder, "Show/Season 03/x.mkv", 3),
        (N.classify, "Fahrenheit 451 (2018)", "movie"),
        (N.classify, "Show/Season 1/x.s01e02.mkv", "tv"),
        (N.title_from_filename, "Show - S01E02 - The Title.mkv", "The Title"),
        (N.extras_reason, "x/Movie - trailer.mkv", "file name carries 'trailer'"),
        (N.extras_reason, "x/Show S01E02 - Proof.mkv", None),
        (G.named_forced, "English-FORCED-PGS", True),
        (G.named_forced, "Non-Forced", False),
        (G.named_forced, "Unforced", False),
        (G.hms_to_seconds, "01:02:03.5", 3723.5),
        (G.pedigree, "a/Movie.WEB-DL.x264.mkv", "web"),
        (G.bit_depth, "yuv420p10le", 10),
    ],
)
def test_examples(spark, f, s, want):
    assert one(spark, f(F.col("s")), s=s) == want


NUMBERED = [
    ("s04e01e02", None, (4, 1, 2, False)),
    ("Show S01E02 - 99", None, (1, 2, 2, False)),
    ("Show S02E01-E09", None, (2, 1, 1, False)),
    ("Show S02E01-E02", None, (2, 1, 2, False)),
    ("Family Guy - 319 - Title.avi", None, (3, 19, 19, True)),
    ("1003 - Title.mkv", 10, (10, 3, 3, True)),
    ("Part 3 of 6", 2, (2, 3, 3, False)),
    ("Show S01E01 - Parts 1-2", None, (1, 1, 2, False)),
    ("Movie 1999 1080p", None, None),
    ("Show 2x05", None, (2, 5, 5, False)),
    ("Show s1e2-e3", None, (1, 2, 3, False)),
    ("Show S01E02-03", None, (1, 2, 3, False)),
    ("Show S01E02 and 03", None, (1, 2, 3, False)),
    ("Show S01E02toE04", None, (1, 2, 4, False)),
    ("Show S01E05-E02", None, (1, 5, 5, False)),
    ("Show 1x02-1x03", None, (1, 2, 3, False)),
    ("Show.1x02.to.03", None, (1, 2, 2, False)),
    ("Show Season 3 Episode 12", None, (3, 12, 12, False)),
    ("ShowS01E02", None, None),
    ("Movie 1920x1080", None, None),
    ("12 - Title.mkv", 4, (4, 12, 12, False)),
    ("112 - Title.mkv", 4, (4, 112, 112, True)),
    ("E07.mkv", 2, (2, 7, 7, False)),
    ("Show h.264 Title", None, None),
    ("Show - 105", None, (1, 5, 5, True)),
    ("Show 105 1999", None, None),
]


def test_episode_numbers(spark):
    """Season, first and last number and whether they are weak, all in one run."""
    rows = spark.createDataFrame([(i, name, season) for i, (name, season, _) in enumerate(NUMBERED)], "i int, s string, d int").select("i", N.parse_episode(F.col("s"), F.col("d").cast("int")).alias("p"))
    got = {r.i: None if r.p is None else (r.p.season, r.p["first"], r.p.last, r.p.weak) for r in rows.collect()}
    assert [got[i] for i in range(len(NUMBERED))] == [want for *_, want in NUMBERED]


def test_readings(spark):
    read = lambda s: [(r.name, r.year) for r in one(spark, N.name_readings(F.col("s")), s=s)]
    assert read("Blade Runner (1982)") == [("Blade Runner", 1982)]
    assert read("Movie 2012 1080p") == [("Movie", 2012), ("Movie 2012", None)]
    assert read("Plain Name") == [("Plain Name", None)]
    assert read("2012 2009") == [("2012", 2009)]


def test_release_groups_in_brackets(spark):
    vocab = V.Vocabulary(groups=frozenset({"grp", "sparks"}), patterns=("X[0-9]+",))
    peel = lambda s: one(spark, N.strip_release_tag(F.col("s"), vocab), s=s)
    assert [peel(s) for s in ("Film (GRP) [x264]", "Film (SPARKS foo)", "Film [foo-X12] ", "Film (kept) [X12b]", "(1080p)")] == ["Film", "Film", "Film", "Film (kept) [X12b]", ""]
    ends = lambda s: one(spark, N.strip_release_group(F.col("s"), vocab=vocab), s=s)
    assert [ends(s) for s in ("Film 1999-SPARKS", "Film-SPARKS", "Film.DVDRip-X7", "Film 1999-War", "Film 1999 -")] == ["Film 1999", "Film-SPARKS", "Film.DVDRip", "Film 1999-War", "Film 1999 -"]


def test_vocabulary_reaches_every_name(spark):
    title = lambda s, v=V.DEFAULT: one(spark, N.title_from_filename(F.col("s"), vocab=v), s=s)
    sparks = V.Vocabulary(groups=frozenset({"sparks"}))
    assert title("Show - S01E02 - The Title 1080p-SPARKS.mkv", sparks) == "The Title 1080p"
    assert title("Show - S01E02 - The Title (PDTV SPARKS).mkv") == "The Title"
    tails = ("Some.Film.DVDRip.x", "Some.Film.BDMV", "Some Film HDTVRip", "Some.Film.TELESYNC.x264", "Some_Film_AMZN.WEB-DL", "Some Film PDTV x", "[site] Some.Film.R5")
    *plain, edition = movies(spark, [*tails, "Movie.Extended.Cut.1999.1080p.BluRay"])
    assert plain == [[("Some Film", None)]] * len(tails) and ("Movie", 1999) in edition
    own = V.Vocabulary(sources=("GRAIL.?Rip",))
    assert one(spark, N.cut_release_fields(F.col("s"), own), s="Film.GRAIL.Rip.DVDRip") == "Film"
    assert one(spark, N.strip_leading_fields(F.col("s")), s="[a] R5 Film") == "Film"
    tables = spark.createDataFrame([("A", "GRAIL.?Rip"), ("B", "(bad"), ("C", r"(?<=\\d{3,4}p.)WEB")], "label string, pattern string"), spark.createDataFrame([("Sparks", False), ("X[0-9]+", True), ("[bad", True)], "name string, is_pattern boolean")
    made = V.compiled(*tables)
    assert made.sources == ("GRAIL.?Rip", r"(?<=\\d{3,4}p.)WEB") and made.groups == {"sparks"} and made.patterns == ("X[0-9]+",)
    assert [one(spark, made.is_group(F.col("s")), s=s) for s in ("SPARKS", "X12", "x12", "", "X12b")] == [True, True, False, False, False]


LEADING = [
    ("[a] [b]", "[b]"), ("[a] 1080p", "[a] 1080p"), ("www.site.org.My Film", "Film"), ("www.site.org - Film", "Film"), ("site.co.uk - Film", "Film"), ("The.Net.1995", "The.Net.1995"),
    ("site.tv - [x] 720p.x264.Film", "Film"), ("  - Film", "Film"), ("( 1999 ) Film", "( 1999 ) Film"), ("(a[b]) Film", "(a[b]) Film"), ("Dual Film", "Dual Film"), ("my-site.com -Film", "my-site.com -Film"), ("", ""),
]


def test_leading_fields(spark):
    assert each(spark, N.strip_leading_fields(F.col("s")), [s for s, _ in LEADING]) == [want for _, want in LEADING]


NAMED_EDITIONS = [
    ("Film 1999 Director's.Definitive_Cut", "Director's Definitive Cut", "Film 1999 ", (None, None)),
    ("Film Extended", "Extended", "Film ", ("Film", "Extended")),
    ("Extended Film Extended", None, "Extended Film Extended", ("Film", "Extended")),
    ("Film (Unrated) [1080p]", "Unrated", "Film  [1080p]", ("Film ( ) [1080p]", "Unrated")),
    ("Film 1999 Extendedish", None, "Film 1999 Extendedish", (None, None)),
    ("Uncut Film 1999 (Limited Edition) x", None, "Uncut Film 1999  x", ("Film 1999 (Limited Edition) x", "Uncut")),
    ("Film Ultimate Collector's Edition 1999", None, "Film Ultimate Collector's Edition 1999", ("Film 1999", None)),
    ("Final Cut 1999", None, "Final Cut 1999", (None, None)),
    ("Film 1999 Special-Edition Uncut.mkv", "Uncut", "Film 1999 Special-Edition .mkv", (None, None)),
    ("Film 1999 directors director's cut", "Director's Cut", "Film 1999 directors ", (None, None)),
]


def test_editions(spark):
    """Text, label, text without the edition, and text without every phrase."""
    texts = [e[0] for e in NAMED_EDITIONS]
    assert each(spark, N.edition_from_name(F.col("s")), texts) == [e[1] for e in NAMED_EDITIONS]
    assert each(spark, N.strip_edition(F.col("s")), texts) == [e[2] for e in NAMED_EDITIONS]
    assert [(x.text, x.label) for x in each(spark, N.strip_edition_phrases(F.col("s")), texts)] == [e[3] for e in NAMED_EDITIONS]


def test_codes(spark):
    assert one(spark, N.episode_code(F.lit(5), F.lit(1), F.lit(2))) == "S05E01-E02"
    assert one(spark, N.movie_folder(F.lit("A: B"), F.lit(1999), F.lit("7"), F.lit("8"))) == "A B (1999) [tmdbid-7] [imdbid-tt8]"
    assert one(spark, N.movie_folder(F.lit("A"), F.lit(1999), F.lit(None), F.lit("8"))) is None
    assert one(spark, N.name_prefix_keys(F.lit("A (1999) B (2001) x"))) == ["A (1999)", "A (1999) B (2001)"]
    assert one(spark, N.without_show(F.lit("The Wire - Old Cases"), F.lit("Wire"))) == "Old Cases"


def test_figures(spark):
    assert one(spark, G.ratio_text(F.lit("64:45"), 1.0)) == pytest.approx(64 / 45)
    assert one(spark, G.ratio_text(F.lit("0:1"), 2.0)) == 2.0
    assert [one(spark, G.resolution_class(F.lit(w), F.lit(h))) for w, h in ((1920, 800), (1440, 1080), (720, 576))] == ["1080", "1080", "SD"]
    assert one(spark, G.weighted_bitrate(F.lit(4_000_000), F.lit("hevc"))) == pytest.approx(6_800_000)
    assert one(spark, G.weighted_bitrate(F.lit(0), F.lit("hevc"))) is None
    assert one(spark, G.same_cut(F.lit(100), F.lit(101), F.lit(1.0), F.lit(99.0))) is True
    assert one(spark, G.eta_seconds(F.lit(10), F.lit(110), F.lit(25.0))) == 4


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.text("abc d", max_size=12), st.text("abc d", max_size=12)), min_size=1, max_size=20))
def test_similarity_is_difflib(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    for r in df.select("a", "b", H.similarity(F.col("a"), F.col("b")).alias("r"), H.similarity_bound(F.col("a"), F.col("b")).alias("m")).collect():
        assert r.r == pytest.approx(difflib.SequenceMatcher(None, r.a, r.b).ratio()) and r.r <= r.m + 1e-9


def test_fingerprint(spark):
    head = (1).to_bytes(8, "little") + (2).to_bytes(8, "little") + b"xyz"
    row = spark.createDataFrame([(head, b"\xff" * 8)], "h binary, t binary").select(F.lit(100).cast("long").alias("n"), "h", "t")
    assert row.select(H.oshash(F.col("n"), F.col("h"), F.col("t"))).first()[0] == f"{(100 + 3 + 2**64 - 1) % 2**64:016x}"
