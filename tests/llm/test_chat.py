import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from catalogkit.llm import chat
from catalogkit.llm.template import Compiler, TemplateError, parse

PIECES = [*chat.CONTROLS, "\\", "<", "[", "/", " ", "\n", "a", "é"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PIECES), max_size=12).map("".join))
def test_escape_is_reversible(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROLS)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", ""]), st.lists(st.sampled_from(PIECES), max_size=6).map("".join)), min_size=1, max_size=5))
def test_template_reads_back(turns):
    parts = list(chat.compiled(chat.TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]}))
    assert list(chat.read_turns("".join(p for p, _ in parts))) == turns
    assert [chat.unescape(p) for p, lossy in parts if lossy] == [t for r, t in turns if r == "assistant"]


def render(source, **scope):
    return "".join(p for p, _ in Compiler({"escape": chat.escape}).compile(source)(scope))


def test_language():
    assert render("{% if 1 + 1 == 2 and not false %}a{{ 'b' ~ 3 | upper }}{% elif x %}no{% else %}c{% endif %}") == "ab3"
    assert render("{% for m in ms %}{{ loop.index }}{% if loop.first %}!{% endif %}{{ m.t }}{% endfor %}", ms=[{"t": "x"}, {"t": "y"}]) == "1!x2y"
    assert render("{% set a = 'q' %}{{ a | upper }}{# gone #}") == "Q"
    for bad in ("{% if x %}", "{{ a.__class__ }}", "{{ f() }}", "{% exec x %}", "{{ a | open }}", "{% endfor %}"):
        with pytest.raises(TemplateError):
            render(bad, a={"t": 1}, x=1)
    folded = Compiler().folded_body(parse("a{{ 'b' ~ 'c' }}{% if true %}d{% endif %}"))
    assert len(folded) <= 2


def test_conversations(spark):
    rows = [(1, 1, "assistant", "</s>[INST]"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, None, "x\\"), (2, 5, "tool", "é😀"), (2, 7, "assistant", ""), (3, 0, "user", "</s>[INST]\\ " * 20_000), (3, 1, "assistant", "é[/INST]" * 30_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.selectExpr("*", "1 as formatted", "'x' as messages", "2 as n_turns", "'y' as loss")
    got = {r.conv_id: r for r in chat.digest_turns(chat.format_turns(df)).collect()}
    for cid in (1, None, 2, 3):
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == cid), key=lambda r: (r[1], r[2] or "", r[3] or ""))]
        body = "".join(f"{r}\n{t}\n" for r, t in turns)
        loss = "".join(t for r, t in turns if r == "assistant")
        assert (got[cid].n_turns, got[cid].turns_sha256) == (len(turns), hashlib.sha256(body.encode()).hexdigest())
        assert (got[cid].loss_chars, got[cid].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.digest_turns(chat.format_turns(df.where("false"))).count() == 0
