import re

import numpy as np
import pytest
import xxhash

from catalogkit.llm import simhash

from .conftest import EDGES

pytestmark = pytest.mark.filterwarnings("ignore")


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(fps, radius=4):
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in fps:
        for b in fps:
            if bin(a ^ b).count("1") <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_fingerprints(docs_of):
    rows = simhash.fingerprints(docs_of(EDGES)).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64)) for r in rows) == sorted((i is None, i or 0, plain_fingerprint(t)) for i, t in EDGES)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bit_sliced_links_match_brute_force(seed):
    draw = np.random.default_rng(seed)
    base = draw.integers(0, 2**64, 40, dtype=np.uint64)
    fps = base.copy()
    for _ in range(3):
        flips = np.array([sum(1 << int(b) for b in draw.choice(64, draw.integers(0, 6), replace=False)) for _ in base], np.uint64)
        fps = np.concatenate((fps, base ^ flips))
    fps = np.unique(fps)
    u, v = simhash.local_links(np.zeros(len(fps), np.int64), fps, 4)
    want = plain_groups([int(f) for f in fps])
    got = {int(f): int(f) for f in fps}
    for a, b in zip(u.view(np.uint64).tolist(), v.view(np.uint64).tolist()):
        assert want[a] == want[b]
        got[a] = b
    assert len({want[f] for f in want}) == len(set(got.values()))


def test_components_and_hot_keys(spark, docs_of, monkeypatch):
    draw = np.random.default_rng(7)
    base = int(draw.integers(0, 2**63))
    fps = sorted({base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in draw.integers(0, 64, (300, 2))} | {int(x) for x in draw.integers(0, 2**63, 50)})
    rows = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f,) for f in fps], "fp long")
    want = plain_groups(fps)
    for cell in (3, 64, 1 << 15):
        monkeypatch.setattr(simhash, "CELL", cell)
        links = simhash.components(simhash.links(rows)).collect()
        got = {r.node % (1 << 64): r.root % (1 << 64) for r in links}
        groups = {}
        for f in fps:
            groups.setdefault(want[f], set()).add(got.get(f, f))
        assert all(len(g) == 1 for g in groups.values())


def test_near_duplicates_and_keep_one(docs_of):
    text = " ".join(f"w{i}" for i in range(400))
    rows = [(10, text), (11, text), (12, text.replace("w7 ", "other ")), (13, "quite different words stand in this text")]
    found = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs_of(rows)).collect()}
    assert found[10] == found[11] == 10 and found[13] == 13
    kept = simhash.keep_one(docs_of(rows + EDGES))
    assert kept.columns == docs_of(rows).columns
    ids = [r.doc_id for r in kept.select("doc_id").collect()]
    assert ids.count(10) == 1 and 11 not in ids and 13 in ids and ids.count(4) == 1 and 5 not in ids
    assert simhash.near_duplicates(docs_of([])).count() == 0
    with pytest.raises(ValueError):
        simhash.links(found_pairs(docs_of), 8)


def found_pairs(docs_of):
    return simhash.fingerprints(docs_of([(1, "a")])).select("fp")


def test_keep_one_judges_rows(spark, docs_of):
    """One id on two texts, rows without an id, repeated rows, and columns named like the operator's own."""
    text, other = " ".join(f"w{i}" for i in range(200)), " ".join(f"v{i}" for i in range(200))
    rows = [(1, text, "a"), (5, text, "b"), (5, other, "c"), (6, other, "d"), (None, text, "e"), (None, "alone in the world", "f"), (None, "alone in the world", "g"), (7, "seven", "h"), (7, "seven", "i"), (7, "seven", "h")]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, kept_id string, count int, mark long, stays string")
    for _ in range(2):
        kept = simhash.keep_one(docs)
        assert kept.columns == docs.columns
        got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
        assert got == sorted([(1, text), (5, other), (None, "alone in the world"), (7, "seven")], key=str)
        docs = docs.repartition(5)
