"""Personal data against plain expressions, and revealing words against plain counts."""

import math
import re

import pytest
from pyspark.sql import functions as F

from catalogkit.llm import disclosure as D

from .conftest import EDGES

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def lower(t):
    return t.translate({ord(c): c.lower() for c in UPPER})


def luhn(d):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if c > "4" else 2 * int(c)) for i, c in enumerate(reversed(d))) % 10 == 0


def good(kind, v):
    d = re.sub("[^0-9]", "", v)
    return {"email": True, "ip": kind != "ip" or all(int(p) <= 255 for p in v.split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]


def words(t):
    return re.findall(r"[^\W\d_]{3,}", lower(t))


def terms(ws):
    return set(ws) | {w[:4] + "*" for w in ws if len(w) >= 6}


def base(text):
    """(kind, start, end, entity, terms near)"""
    out = []
    for kind, p in PATTERNS.items():
        ms, at = list(re.finditer(p, text)), 0
        for i, m in enumerate(ms):
            before, after = text[at : m.start()], text[m.end() : ms[i + 1].start() if i + 1 < len(ms) else len(text)]
            at = m.end()
            if good(kind, m[0]):
                b = re.sub(r"^[^\W\d_]+", "", before[-128:]) if len(before) > 128 else before
                a = re.sub(r"[^\W\d_]+$", "", after[:128]) if len(after) > 128 else after
                name = lower(m[0]) if kind == "email" else m[0] if kind == "ip" else re.sub("[^0-9]", "", m[0])
                out.append((kind, m.start(), m.end(), f"{kind}:{name}", terms(words(b)[-6:] + words(a)[:6])))
    return out


def plain(rows, support=2, disclosed=0.9):
    texts = [t or "" for _, t in rows]
    found, n = [base(t) for t in texts], len(rows)
    joint, held, said = {}, {}, {}
    for t, spans in zip(texts, found):
        for pair in {(e, w) for *_, e, near in spans for w in near}:
            joint[pair] = joint.get(pair, 0) + 1
        for e in {s[3] for s in spans}:
            held[e] = held.get(e, 0) + 1
        for w in terms(words(t)):
            said[w] = said.get(w, 0) + 1
    told = {w for (e, w), k in joint.items() if k >= support and held[e] < n and w in said and math.log(n * k / (held[e] * said[w])) >= disclosed * math.log(n / held[e])}
    how = {w: "general" if len(w) >= 6 and w[:4] + "*" not in told else "remove" for w in told if not w.endswith("*")}
    out = []
    for (i, _), t, spans in zip(rows, texts, found):
        more = [(how[m[0]], m.start(), m.end()) for m in re.finditer(r"[^\W\d_]+", lower(t)) if m[0] in how and not any(s[1] < m.end() and m.start() < s[2] for s in spans)]
        rank = ["email", "ip", "card", "phone", "general", "remove"].index
        out.append((i, sorted([s[:3] for s in spans] + more, key=lambda s: (rank(s[0]), s[1]))))
    return out


ROWS = [
    (20, "Ünï bob.s@mail.example.com, call +1 (555) 123-4567 or 4111-1111-1111-1111; host 10.0.0.255 or 10.0.0.256"),
    (21, "a@b a@b@c.d a@b.c_d@e.f x@1.2.3.4 @x.y .@a.b 1.2.3.4.5.6.7.8 0001.02.3.0000255 +12 +1 23456789 +1234567890123456"),
    (22, "4111 1111 1111 1112 4111111111111111 41111111111111111111 1-2-3-4-5-6-7-8-9-0-1-2-3"),
    (30, "the zygomorphic plan of ann@x.org for tea"), (31, "see ann@x.org about the zygomorphic plan and Kexo"), (32, "Kexo saw ANN@X.ORG again"), (33, "the plan and tea for all"), (34, "a zygote is the start"), (39, "zygotes"), (40, "the zygotic plan"),
    (35, "no entity here but zygomorphic and kexo stand"), (36, None), (37, ""), (31, "see ann@x.org about the zygomorphic plan and Kexo"), (38, "zygon and kex@x.org 😀"),
    *[(50 + i, f"plain filler number {i} to see and saw again the usual words about tea and plan for all") for i in range(200)],
]


def key(r):
    return (r[0] is None, r[0] or 0, repr(r[1]))


def scanned(docs):
    return sorted(((r.doc_id, [tuple(s) for s in r.spans]) for r in D.scan(docs).collect()), key=key)


def test_spans(docs_of, monkeypatch):
    rows = ROWS + EDGES
    want = sorted(plain(rows), key=key)
    assert {s[0] for _, spans in want for s in spans} == {*PATTERNS, "general", "remove"}
    assert scanned(docs_of(rows)) == want
    monkeypatch.setattr(D.common, "BROADCAST_ROWS", 0)
    assert scanned(docs_of(rows)) == want


def test_long_runs_are_linear(docs_of):
    rows = [(1, "a" * 300_000), (2, "1" * 300_000), (3, "1 " * 150_000), (4, "1." * 100_000), (5, "+1" * 50_000), (6, "a@b.c " * 3000), (7, "x." * 100_000 + "@y.z"), (8, "1.2.3.4 " * 3000 + "9" * 400_000)]
    got = dict(scanned(docs_of(rows)))
    assert len(got[6]) == 3000 and got[6][-1] == ("email", 17994, 17999) and got[7] == [("email", 0, 200_004)] and len(got[8]) == 3000 and got[1] == got[2] == got[3] == got[5] == []


def test_sanitise(docs_of):
    out = {r.doc_id: r for r in D.sanitise(docs_of(ROWS)).collect()}
    assert D.sanitise(docs_of(ROWS)).count() == len(ROWS) and D.sanitise(docs_of([])).count() == 0 and D.scan(docs_of([])).count() == 0
    assert out[20].text == "Ünï [EMAIL], call [PHONE] or [CARD]; host [IP] or 10.0.0.256"
    assert out[32].text == " saw [EMAIL] again" and out[31].text == "see [EMAIL] about the zygo* plan and " and out[34].text == "a zygote is the start" and out[35].text == "no entity here but zygo* and  stand"
    assert out[36].text is None and out[37].text == "" and out[33].text == "the plan and tea for all" and out[20].extra == "x" and out[20].row == "clash"


@pytest.mark.parametrize("n", [1, 2, 3, 10, 17])
def test_sums_before(spark, n):
    got = spark.range(1).select(D.sums_before(F.array(*[F.lit(k).cast("long") for k in range(1, n + 1)])).alias("s")).first().s
    assert got == [sum(range(1, k)) for k in range(1, n + 1)]
