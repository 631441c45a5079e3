"""Language ID, quality and media copies: held-out accuracy and edges."""

import zlib

import numpy as np
import pytest

from catalogkit.llm import langid, media, quality

from .conftest import EDGES

WORDS = {"en": "the of and that with from house water", "fr": "le la les des une avec maison eau", "de": "der die das und mit ein haus wasser"}


def texts(n, lang, draw):
    return " ".join(draw.choice(WORDS[lang].split(), n))


def test_language_documents(docs_of):
    draw = np.random.default_rng(1)
    rows = [(100 + i, texts(40, lang, draw), lang, f"host-{lang}") for i, lang in enumerate(["en", "fr", "de"] * 40)]
    rows += [(1, texts(40, "fr", draw), "de", "host-fr"), (2, None, "en", "host-en"), (3, "123 !!", "en", "host-en"), (4, "the", None, None), (5, texts(40, "de", draw), "xx", None)]
    kept = {r.doc_id: r for r in langid.keep_identified(docs_of(rows)).collect()}
    assert all(kept[i].lang == lang for i, _, lang, _ in rows if i >= 100)
    assert kept[1].lang == "fr" and kept[5].lang == "de" and 2 not in kept and 3 not in kept
    assert kept[1].row == "clash" and kept[1].extra == "x"
    assert langid.keep_identified(docs_of([])).count() == 0


def plain_posteriors(evidence, rows):
    """The fused posterior of (text, declared, host, suffix) rows, one by one, from the evidence's text model."""
    k, names = evidence.k, evidence.languages
    scores = []
    for text, *_ in rows:
        low = bytes((text or "").encode()).translate(langid._LETTERS)
        found = np.zeros(k)
        n = 0
        for a, b, c in zip(low, low[1:], low[2:]):
            if (a, b) != (32, 32) and (b, c) != (32, 32):
                found += evidence.table[:, ((a * 2039 + b * 127 + c) * 40503 % 2**32) >> 3 & langid.BUCKETS - 1]
                n += 1
        scores.append(found * min(n, langid.EVIDENCE) / max(n, 1))
    soft = [np.exp(s - s.max()) / np.exp(s - s.max()).sum() for s in scores]
    total = sum(soft) + 1.0
    confusion = np.full((k - 1, k), 1.0)
    for (_, declared, _, _), p in zip(rows, soft):
        if declared in names[:-1]:
            confusion[names.index(declared)] += p
    confusion /= confusion.sum(axis=0)
    out = []
    for i, (_, declared, host, suffix) in enumerate(rows):
        of_suffix = sum((p for (*_, s), p in zip(rows, soft) if s == suffix), np.zeros(k)) - soft[i]
        of_host = sum((p for (*_, h, s), p in zip(rows, soft) if (h, s) == (host, suffix)), np.zeros(k)) - soft[i]
        prior = (of_suffix + langid.SUFFIX_WEIGHT * total / total.sum()) / (of_suffix.sum() + langid.SUFFIX_WEIGHT)
        prior = (of_host + langid.HOST_WEIGHT * prior) / (of_host.sum() + langid.HOST_WEIGHT)
        logs = scores[i] + np.log(prior) + (np.log(confusion[names.index(declared)]) if declared in names[:-1] else 0)
        out.append(np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum())
    return out


@pytest.mark.parametrize("bound", [50_000, 3])
def test_fusion_matches_plain_python(spark, monkeypatch, bound):
    """Few hosts (beside the text) and many (narrow joins) give the posterior worked out row by row."""
    monkeypatch.setattr(langid.common, "BROADCAST_ROWS", bound)
    draw = np.random.default_rng(8)
    rows = [(texts(int(draw.integers(1, 30)), lang, draw), lang if i % 5 else None, None if i % 11 == 0 else f"h{i % 7}", None if i % 11 == 0 else f"s{i % 7 % 2}") for i, lang in enumerate(["en", "fr", "de"] * 30)]
    rows += [(None, "en", "h1", "s1"), ("", None, None, None), ("zzkq xqj", "xx", "h2", "s0"), ("the", None, "only", "s9")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, text string, declared string, host string, suffix string")
    evidence = langid.Evidence(df)
    want = plain_posteriors(evidence, rows)
    for source in [evidence.scored] + [df] * evidence.few_hosts:
        got = {r.n: r.id_posterior for r in evidence.apply(source).collect()}
        assert len(got) == len(rows) and all(np.allclose(got[i], want[i], atol=1e-6) for i in got)


@pytest.mark.parametrize("bound", [50_000, 1])
def test_rare_languages_and_gibberish(docs_of, monkeypatch, bound):
    """A language too rare for a model keeps what it declares, one with few rows is found, jumbled letters go."""
    monkeypatch.setattr(langid.common, "BROADCAST_ROWS", bound)
    draw = np.random.default_rng(1)
    few = " ".join("zuri kwa habari sana watu nyumba maji njema mtoto kitabu".split())
    rows = [(100 + i, texts(40, lang, draw), lang, f"host-{lang}") for i, lang in enumerate(["en", "fr", "de"] * 4000)]
    rows += [(20_000 + i, " ".join(draw.choice(few.split(), 30)), "sw", "host-sw") for i in range(22)]
    rows += [(30_000 + i, "hyvaa paivaa minun nimeni oli talo vesi joulupukki kaksi kolme yksi", "fi", "host-fi") for i in range(3)]
    jumbled = " ".join("".join(draw.choice(list("bcdfghjklmnpqrstvwxz"), 6)) for _ in range(40))
    rows += [(40_000, jumbled, "en", "host-en"), (40_001, jumbled, None, None)]
    kept = {r.doc_id: r.lang for r in langid.keep_identified(docs_of(rows)).collect()}
    assert all(kept[i] == lang for i, _, lang, _ in rows if i < 40_000 and lang)
    assert 40_000 not in kept and 40_001 not in kept


def test_markup_is_read_in_linear_time():

    kept = langid.visible(b"one<script>hidden</script>two<!-- hidden -->three<style>hidden</STYLE>four")
    assert b"hidden" not in kept and all(w in kept for w in (b"one", b"two", b"three", b"four"))
    for unclosed in (b"<script>", b"<style>", b"<!--", b"<", b"<!-- <script>"):
        langid.visible(unclosed * 200_000)
        langid.visible(unclosed * 100_000 + b"</script><style></style>-->" + unclosed * 100_000)


def test_language_pages(spark):
    draw = np.random.default_rng(2)
    rows = [(i, f"https://h{i % 5}.example.{'fr' if lang == 'fr' else 'com'}/x", f'<html lang="{lang}"><p>{texts(30, lang, draw)}</p></html>') for i, lang in enumerate(["en", "fr", "de"] * 30)]
    rows += [(900, None, None), (901, "no address", ""), (902, "https://h1.example.fr/", f"<p>{texts(30, 'fr', draw)}</p>")]
    got = {r.page_id: r for r in langid.identify_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert len(got) == len(rows) and all(got[i].lang == ["en", "fr", "de"][i % 3] for i in range(90)) and got[902].lang == "fr"
    assert got[902].accepted and got[902].declared is None and got[900].host is None


def test_pages_without_rows_ties_and_a_long_one(spark):
    schema = "page_id long, url string, html string, lang string, scores string"
    assert langid.identify_pages(spark.createDataFrame([], schema)).count() == 0
    undeclared = langid.identify_pages(spark.createDataFrame([(1, "http://h.x/", "<p>some text</p>", "clash", "x")], schema)).collect()
    assert [(r.page_id, r.lang, r.confidence, r.accepted) for r in undeclared] == [(1, "und", 0.0, False)]
    draw = np.random.default_rng(2)
    rows = [(i, "http://h.x/", f'<html lang="{lang}"><p>{texts(30, lang, draw)}</p></html>', "clash", "x") for i, lang in enumerate(["en", "fr"] * 25)]
    rows += [(100, "http://h.x/", '<html lang="fr">' + "<script>" * 20_000 + texts(60_000, "en", draw), "clash", "x"), (101, None, None, None, None), (101, None, None, None, None)]
    got = langid.identify_pages(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows) and next(r for r in got if r.page_id == 100).lang == "en"
    assert len({(r.lang, r.confidence) for r in got if r.page_id == 101}) == 1


def test_quality(spark, docs_of):
    draw = np.random.default_rng(3)
    good = [(i, ". ".join(texts(12, "en", draw).capitalize() for _ in range(6))) for i in range(400)]
    junk = [(1000 + i, " ".join(["spam***" if draw.random() < 0.7 else "$$$#"] * int(draw.integers(20, 80)))) for i in range(150)]
    docs = docs_of(good + junk + EDGES)
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good] + [(i, 0, 0) for i, _ in junk] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score(docs, labels).collect()
    assert len(rows) == 550 + len(EDGES) and all(0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and (r.doc_id < 400 or r.doc_id >= 1000) and r.doc_id > 10]
    assert np.mean([(r.score >= quality.THRESHOLD) == (r.doc_id < 400) for r in held]) > 0.95
    assert {r.score for r in quality.score(docs, labels.where("false")).collect()} == {0.5}
    assert quality.score(docs_of([]), labels).count() == 0


def test_isotonic():
    """The pools are those of the max-min formula, worked out for every bin by itself."""
    draw = np.random.default_rng(6)
    for _ in range(20):
        k = int(draw.integers(1, 12))
        n = draw.integers(1, 9, k).astype(float)
        ones = np.floor(n * draw.random(k))
        _, values = quality.isotonic(np.arange(float(k)), n, ones)
        mean = lambda a, b: ones[a : b + 1].sum() / n[a : b + 1].sum()  # noqa: B023, E731
        fitted = [max(min(mean(a, b) for b in range(i, k)) for a in range(i + 1)) for i in range(k)]
        want = []
        for level in sorted(set(np.round(fitted, 9))):
            own = np.isclose(fitted, level)
            want.append((ones[own].sum() + 0.5) / (n[own].sum() + 1))
        assert np.allclose(values, want)


def test_ridge_equals_plain_numpy(spark):
    """Partition-summed normal equations and the weights they give, against all rows at once."""
    draw = np.random.default_rng(7)
    x, y = draw.normal(size=(300, len(quality.FEATURES))), draw.integers(0, 2, 300).astype(float)
    cosines = quality.Cosines(x.mean(axis=0), x.std(axis=0), 24)
    df = spark.createDataFrame([(r.tolist(), float(v)) for r, v in zip(x, y)], "x array<double>, y double").repartition(7)
    z = np.concatenate((cosines(x), y[:, None]), axis=1)
    sums = quality.normal_equations(df, cosines)
    assert np.allclose(sums, z.T @ z)
    weights = np.linalg.solve(sums[:-1, :-1] + quality.RIDGE * 300 * np.eye(25), sums[:-1, -1])
    plain = np.linalg.lstsq(np.concatenate((z[:, :-1], np.sqrt(quality.RIDGE * 300) * np.eye(25))), np.concatenate((y, np.zeros(25))), rcond=None)[0]
    assert np.allclose(weights, plain, atol=1e-6)
    # the cosines approximate a Gaussian kernel of the standardised statistics
    many = quality.Cosines(x.mean(axis=0), x.std(axis=0), 20_000)
    a, b = many(x[:5])[:, :-1], (x[:5] - x.mean(axis=0)) / x.std(axis=0)
    kernel = np.exp(-((b[:, None] - b[None]) ** 2).sum(axis=2) / (2 * len(quality.FEATURES)))
    assert np.allclose(a @ a.T, kernel, atol=0.05)


def test_media_copies(spark):
    seeds = np.arange(30, dtype=np.uint64) * np.uint64(7919) + np.uint64(3)
    drawn = media.drawn_from(seeds).astype(np.uint8)
    rows = [(i, media.encode(p)) for i, p in enumerate(drawn)]
    rows += [(100 + i, media.encode(media.edited(p.astype(float), i))) for i, p in enumerate(drawn[:12])]
    rows += [(200, media.encode(drawn[0])), (300, None), (301, b"not an image"), (302, media.encode(np.zeros((64, 64)))), (303, media.encode(np.zeros((3, 3))))]
    members, links = media.find_copies(spark.createDataFrame(rows, "media_id long, content binary"))
    got = {r.media_id: r for r in members.collect()}
    assert len(got) == len(rows) and got[200].class_id == 0
    assert all(got[100 + i].group_id == got[i].group_id for i in range(12))
    assert len({got[i].group_id for i in range(30)}) == 30
    assert all(got[i].n_links == 0 and got[i].group_id == i for i in (300, 301, 302, 303))
    assert links.count() == 12


def test_image_decoding():
    image = np.arange(12, dtype=np.uint8).reshape(3, 4)
    assert (media.decode(media.encode(image)) == image).all()
    assert media.decode(b"P5\n4 3\n255\nshort") is None


@pytest.mark.parametrize("url,host", [("http://A.Example.com:80/x", "a.example.com"), ("https://u:p@h.fr", "h.fr"), ("nothing", None)])
def test_hosts(spark, url, host):
    df = spark.createDataFrame([(url,)], "u string")
    assert df.select(langid.host_of(df["u"])).first()[0] == host
