"""Queries over every row of v_name, against plain Python."""

import re

from catalogkit.plans import queries as Q
from catalogkit.plans.adapters import view

SF = "/root/testdata/sf0.001"


def names(spark):
    return {r.name_id: r.name for r in view(spark, SF, "v_name").collect()}


def test_components(spark):
    got = {r.name_id: r.ok for r in Q.QUERIES["p32_component_check"](spark, SF).collect()}
    bad = lambda part: bool(re.search(r'[\x00-\x1f\\/:*?"<>|]|[. ]$', part))
    assert got == {i: not any(map(bad, n.split("/")[-2:])) for i, n in names(spark).items()}
    assert {got[i] for i in got if i % 6 == 4} == {False}


def test_episodes(spark):
    got = {r.name_id: (r.season, r.first, r.last) for r in Q.QUERIES["f19_parse_episode"](spark, SF).collect()}
    want = {}
    for i, n in names(spark).items():
        m = re.search(r"S(\d\d)E(\d\d)(?:-E(\d\d))?", n)
        want[i] = (int(m[1]), int(m[2]), int(m[3] or m[2])) if m else (None, None, None)
    assert got == want


def test_incumbents(spark):
    got = {r.title_id: (r.folder, r.by) for r in Q.QUERIES["j2_movie_incumbents"](spark, SF).collect()}
    every, titles = names(spark), {r.file_id: (r.title, r.year) for r in view(spark, SF, "v_file").collect()}
    ids = {f: (re.search(r"\[tmdbid-(\d+)\]", f), re.search(r"\[imdbid-(tt\d+)\]", f)) for f in every.values()}
    ids = {f: tuple(m and m[1] for m in both) for f, both in ids.items()}
    want = {}
    for i, (title, year) in titles.items():
        tmdb = {0: str(i), 2: "0", 3: "0"}.get(i % 5)
        imdb = f"tt{i + 1000000}" if i % 5 in (1, 2) else None
        clash = lambda f: tmdb and ids[f][0] and tmdb != ids[f][0]  # noqa: B023, E731
        by_id = [f for f, (t, m) in ids.items() if (tmdb and t == tmdb) or (imdb and m == imdb and not clash(f))]
        by_name = [f for f, (t, m) in ids.items() if re.match(re.escape(f"{title} ({year})"), f) and not clash(f) and not (imdb and m and m != imdb)]
        if by_id or by_name:
            want[i] = (min(by_id or by_name), "id" if by_id else "name")
    assert got == want and {by for _, by in got.values()} == {"id", "name"}
    assert any(i % 6 == 1 and i not in got for i in titles)
