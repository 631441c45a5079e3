import hashlib
import random

import numpy as np
import pytest

from catalogkit.llm import suffixes

from .conftest import EDGES


def plain(rows, length=50):
    data = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, b in data:
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            key = float("inf") if i is None else i
            least[w] = min(least.get(w, float("inf")), key)
    out = []
    for i, b in data:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if least[b[p : p + length]] < (float("inf") if i is None else i):
                gone[p : p + length] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i is None, i or 0, len(b), int(gone.sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def found(docs):
    out = []
    for r in suffixes.repeats(docs).collect():
        gone = sum(s.end - s.start for s in r.spans)
        out.append((r.doc_id is None, r.doc_id or 0, r.n_bytes, gone, hashlib.sha256(r.kept).hexdigest()))
    return sorted(out)


def random_texts(seed, n=60):
    draw = random.Random(seed)
    pool = ["".join(draw.choices("abcé ", k=draw.randint(30, 160))) for _ in range(12)]
    return [(draw.randint(0, 40), "".join(draw.choice(pool) if draw.random() < 0.6 else "".join(draw.choices("abcé ", k=40)) for _ in range(draw.randint(0, 5)))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_matches_brute_force(docs_of, monkeypatch, seed):
    monkeypatch.setattr(suffixes, "SLICE", 2000)
    monkeypatch.setattr(suffixes, "CHUNK", 700)
    rows = random_texts(seed) + [(50, "ab" * 300), (51, "ab" * 200), (52, "x" * 400), (53, "x" * 49), (54, "x" * 50)]
    assert found(docs_of(rows)) == plain(rows)


def test_hot_anchors(docs_of, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)
    line = "This very common line stands at the start of many texts here. "
    rows = [(i, line + f"{hashlib.sha256(str(i).encode()).hexdigest()}" * 2) for i in range(40)]
    assert found(docs_of(rows)) == plain(rows)


def test_edges(docs_of):
    rows = [*EDGES, (None, "no id here at all " * 9), (None, "no id here at all " * 9), (8, "word " * 30)]
    assert found(docs_of(rows)) == plain(rows)
    assert suffixes.repeats(docs_of([])).count() == 0
