"""Fill-in-the-middle against plain Python, and exact round trips."""

import hashlib

import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from catalogkit.llm import infill

from .conftest import EDGES


def plain(doc_id, text):
    text = text or ""
    digits = hashlib.sha256(("1:" + ("" if doc_id is None else str(doc_id))).encode()).hexdigest()
    h = [int(digits[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    if not n or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted([h[0] % (n + 1), h[1] % (n + 1)])
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


def test_forms_cuts_and_round_trip(spark, docs_of):
    rows = EDGES + [(i, "".join(chr(65 + (i * k) % 57) for k in range(i % 37))) for i in range(100, 400)]
    rows += [(500 + i, t) for i, t in enumerate(["a<P>b", "<S>", "x<M>", "<<P", "S><", "P>S>M>", "\r\n\r\n", "é́️😀" * 9, "a b\x00c"])]
    out = infill.restore(infill.fill_in_middle(docs_of(rows))).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=key) == sorted(((i, *plain(i, t)) for i, t in rows), key=key)
    assert sorted((r.restored for r in out)) == sorted(t or "" for _, t in rows)
    assert {r.form for r in out} == {"plain", "psm", "spm"}
    assert infill.restore(infill.fill_in_middle(docs_of([]))).count() == 0


def test_long_texts_are_matched_in_stretches():
    text = "aé\n😀" * 5000
    assert infill.unit_ends(text, stretch=999) == infill.unit_ends(text) == list(range(1, len(text) + 1))
    assert infill.unit_ends("one two  three ", r"\S+\s*", 2) == infill.unit_ends("one two  three ", r"\S+\s*") == [4, 9, 15]
    assert infill.unit_ends(" x", r"\S+\s*") is None and infill.unit_ends("", r"\S+") == []


def test_other_units_and_sentinels(spark, docs_of):
    plan = infill.Plan(unit=r"\S+\s*", prefix="[pre]", suffix="[suf]", middle="[mid]", transformed=100, suffix_first=50, seed="7/")
    rows = [(i, " ".join(f"w{k}" for k in range(i % 9))) for i in range(60)] + [(99, "  leading blank")]
    out = infill.restore(infill.fill_in_middle(docs_of(rows), plan), plan).collect()
    want = dict(rows)
    assert all(r.restored == want[r.doc_id] for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}
    for r in out:
        if r.form != "plain":
            cut, end = r.prefix_chars, r.prefix_chars + r.middle_chars
            starts = {m.start() for m in regex.finditer(r"\S+", want[r.doc_id])} | {len(want[r.doc_id])}
            assert r.n == r.doc_id % 9 and {cut, end} <= starts
    assert next((r.n, r.form) for r in out if r.doc_id == 99) == (0, "plain")
    try:
        infill.fill_in_middle(docs_of(rows), infill.Plan(prefix="ab", suffix="bc"))
        raise AssertionError("sentinels that overlap must be refused")
    except ValueError:
        pass


@settings(max_examples=200, deadline=None)
@given(st.text(), st.integers(0, 10**9))
def test_any_text_comes_back(text, doc_id):
    n, form, a, m, output = infill.transformed(text, doc_id, infill.Plan())
    assert (n, form, a, m, output) == plain(doc_id, text) and infill.restored(output, form) == text
