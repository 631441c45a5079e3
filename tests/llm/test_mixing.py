import math
import re
from collections import defaultdict

from catalogkit.llm import mixing

from .conftest import EDGES


def plain_targets(sizes):
    """Water-filling, one source after another."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        full = {s for s in open_ if 3 * sizes[s] < level * weight[s]}
        if not full:
            return target | {s: level * weight[s] for s in open_}
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full


def check(rows, out):
    sizes = defaultdict(int)
    for i, t, _, s in rows:
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    want = plain_targets(sizes)
    taken, most = defaultdict(int), defaultdict(int)
    assert len(out) == len(rows)
    for r in out:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        most[r.source] = max(most[r.source], r.size)
    for s in sizes:
        assert abs(taken[s] - want[s]) <= most[s] + 1e-6


def test_mix(docs_of):
    rows = [(i, "w " * (1 + i * 7 % 90), "en", "big" if i % 3 else f"s{i % 11}") for i in range(600)]
    rows += [(i, t, "en", None) for i, t in EDGES] + [(None, "null id here", "en", "big")] * 9 + [(900, "tiny", "en", "zz")]
    docs = docs_of(rows)
    first = sorted(mixing.mix(docs).collect(), key=str)
    check(rows, first)
    assert first == sorted(mixing.mix(docs.repartition(7)).collect(), key=str)


def test_empty_and_blank(docs_of):
    assert mixing.mix(docs_of([])).count() == 0
    assert [r.taken for r in mixing.mix(docs_of([(1, None, "en", "a"), (2, "", "en", None)])).collect()] == [0, 0]


def test_repeated_rows(docs_of, monkeypatch):
    """Equal rows are numbered and dealt to many folds, also where they are written out in stretches."""
    monkeypatch.setattr(mixing, "REPEATS", 1000)
    docs = docs_of([(1, "one two three", "en", "a"), (None, "no id", "en", "a"), (2, "x " * 50, "en", "b")])
    docs = docs.where("source = 'b'").unionByName(docs.where("source = 'a'").crossJoin(docs.sparkSession.range(10_000).select("id")).drop("id"))
    rows = mixing.numbered(docs.select("doc_id", "source")).collect()
    assert len(rows) == 20_001 and len({r.row for r in rows}) == 20_001
    out = mixing.mix(docs).collect()
    check([(r.doc_id, "one two three" if r.doc_id == 1 else "no id" if r.doc_id is None else "x " * 50, "en", r.source) for r in docs.select("doc_id", "source").collect()], out)


def test_the_mix_itself(docs_of):
    rows = [(i, "w " * (1 + i * 7 % 90), "en", "big" if i % 3 else f"s{i % 11}") for i in range(300)] + [(5, "another text", "en", "s0"), (None, "no id", "en", None), (8, "twice " * 9, "en", "s1"), (8, "twice " * 9, "en", "s1")]
    docs = docs_of(rows)
    planned = mixing.plan(docs).collect()
    out = mixing.mixed(docs)
    assert out.columns[: len(docs.columns)] == docs.columns
    got = out.collect()
    want = {}
    for r in planned:
        want[(r.doc_id, r.size, r.source)] = want.get((r.doc_id, r.size, r.source), 0) + r.copies
    have = {}
    for r in got:
        have.setdefault((r.doc_id, r.mix_size, r.source), []).append(r.mix_copy)
    assert {k: sorted(v) for k, v in have.items()} == {k: list(range(1, n + 1)) for k, n in want.items() if n}
    assert mixing.mixed(docs_of([])).count() == 0
