"""A small sandboxed template language, compiled to Python closures.

    {{ expression }}                    output
    {% for m in messages %} {% endfor %}
    {% if a %} {% elif b %} {% else %} {% endif %}
    {% set name = expression %}
    {% generation %} {% endgeneration %}   output under the loss mask

Expressions: names, ``m.field`` (fields of a message and of ``loop``: index,
first), string and integer literals, true, false, none, ``~`` (join as text),
``+`` on two numbers or two texts, ``== != and or not in``, parentheses, and
the filters ``escape``, ``trim``, ``upper``, ``lower``, ``length``. There are no
calls, no other attributes and no access to Python objects.

A template is parsed to a tree, constants are folded, neighbouring literal
outputs are joined, and each node becomes a closure. Closures are generators,
so ``messages`` may be a stream of any length.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any, NamedTuple


class TemplateError(ValueError):
    pass


class Const(NamedTuple):
    value: Any


class Name(NamedTuple):
    name: str


class Field(NamedTuple):
    base: Any
    name: str


class Filter(NamedTuple):
    base: Any
    name: str


class Binary(NamedTuple):
    op: str
    left: Any
    right: Any


class Not(NamedTuple):
    item: Any


class Output(NamedTuple):
    item: Any


class For(NamedTuple):
    name: str
    source: Any
    body: tuple


class If(NamedTuple):
    tests: tuple  # of (condition, body)
    other: tuple


class Set(NamedTuple):
    name: str
    item: Any


class Generation(NamedTuple):
    body: tuple


_PART = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(\d+)|'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\"|([A-Za-z_]\w*)|(==|!=|[~+().|]))")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"and", "or", "not", "in", "true", "false", "none"}


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


def _plus(a: Any, b: Any) -> Any:
    if isinstance(a, str) and isinstance(b, str) or isinstance(a, int) and isinstance(b, int):
        return a + b
    raise TemplateError("+ needs two texts or two numbers")


def _within(a: Any, b: Any) -> bool:
    if not isinstance(b, str):
        raise TemplateError("in needs a text on the right")
    return _text(a) in b


_BINARY: dict[str, Callable] = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: _text(a) + _text(b), "+": _plus, "in": _within}


class _Expression:
    """Recursive descent over one expression."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:at + 20]!r}")
            number, one, two, name, op = m.groups()
            quoted = one if one is not None else two
            if number is not None:
                self.tokens.append(("const", int(number)))
            elif quoted is not None:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda x: _ESCAPED.get(x[1], x[1]), quoted, flags=re.S)))
            else:
                self.tokens.append(("op" if op or name in _WORDS else "name", op or name))
            at = m.end()
        self.at = 0

    def peek(self, *ops: str) -> str | None:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)
        return value if kind == "op" and value in ops else None

    def take(self, *ops: str) -> str | None:
        if (op := self.peek(*ops)) is not None:
            self.at += 1
        return op

    def whole(self) -> Any:
        out = self.either()
        if self.at != len(self.tokens):
            raise TemplateError("an expression goes on after its end")
        return out

    def either(self) -> Any:
        out = self.all()
        while self.take("or"):
            out = Binary("or", out, self.all())
        return out

    def all(self) -> Any:
        out = self.negated()
        while self.take("and"):
            out = Binary("and", out, self.negated())
        return out

    def negated(self) -> Any:
        return Not(self.negated()) if self.take("not") else self.compared()

    def compared(self) -> Any:
        out = self.added()
        while op := self.take("==", "!=", "in"):
            out = Binary(op, out, self.added())
        return out

    def added(self) -> Any:
        out = self.filtered()
        while op := self.take("~", "+"):
            out = Binary(op, out, self.filtered())
        return out

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("end", None)
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def filtered(self) -> Any:
        out = self.single()
        while op := self.take("|", "."):
            out = Filter(out, self.name()) if op == "|" else Field(out, self.name())
        return out

    def single(self) -> Any:
        if self.take("("):
            out = self.either()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
            return out
        if word := self.take("true", "false", "none"):
            return Const({"true": True, "false": False, "none": None}[word])
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "const":
            self.at += 1
            return Const(self.tokens[self.at - 1][1])
        return Name(self.name())


def parse(source: str) -> tuple:
    """The tree of a template."""
    stack: list[tuple[str, Any, list]] = [("top", None, [])]
    at = 0

    def put(node: Any) -> None:
        stack[-1][2].append(node)

    def close(*kinds: str) -> tuple[str, Any, list]:
        if stack[-1][0] not in kinds:
            raise TemplateError(f"an end without its {kinds[0]}")
        return stack.pop()

    for m in [*_PART.finditer(source), None]:
        if plain := source[at : m.start() if m else len(source)]:
            put(Output(Const(plain)))
        if not m:
            break
        at = m.end()
        if m[1] is not None:
            put(Output(_Expression(m[1]).whole()))
        elif m[2] is not None:
            word, _, rest = m[2].strip().partition(" ")
            if word == "for":
                f = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if not f:
                    raise TemplateError("for needs: for name in expression")
                stack.append(("for", (f[1], _Expression(f[2]).whole()), []))
            elif word == "endfor":
                _, (name, items), body = close("for")
                put(For(name, items, tuple(body)))
            elif word == "if":
                stack.append(("if", ([], _Expression(rest).whole()), []))
            elif word in ("elif", "else"):
                _, (done, test), body = close("if")
                done = [*done, (test, tuple(body))]
                stack.append(("if", (done, _Expression(rest).whole()), []) if word == "elif" else ("else", done, []))
            elif word == "endif":
                kind, state, body = close("if", "else")
                done, other = (state, tuple(body)) if kind == "else" else ([*state[0], (state[1], tuple(body))], ())
                put(If(tuple(done), other))
            elif word == "set":
                name, eq, value = rest.partition("=")
                if not eq or not name.strip().isidentifier():
                    raise TemplateError("set needs: set name = expression")
                put(Set(name.strip(), _Expression(value).whole()))
            elif word == "generation":
                stack.append(("generation", None, []))
            elif word == "endgeneration":
                put(Generation(tuple(close("generation")[2])))
            else:
                raise TemplateError(f"unknown statement {word!r}")
    if len(stack) != 1:
        raise TemplateError(f"{stack[-1][0]} is not closed")
    return tuple(stack[0][2])


class Compiler:
    """Folds and compiles a tree. ``filters`` are functions of one value."""

    def __init__(self, filters: dict[str, Callable[[Any], Any]] | None = None):
        self.filters = {"trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(), "lower": lambda v: _text(v).lower(), "length": lambda v: len(_text(v))} | (filters or {})

    def folded(self, node: Any) -> Any:
        """The expression with its constant parts worked out."""
        if isinstance(node, Filter):
            if node.name not in self.filters:
                raise TemplateError(f"unknown filter {node.name!r}")
            base = self.folded(node.base)
            return Const(self.filters[node.name](base.value)) if isinstance(base, Const) else Filter(base, node.name)
        if isinstance(node, Field):
            return Field(self.folded(node.base), node.name)
        if isinstance(node, Not):
            item = self.folded(node.item)
            return Const(not item.value) if isinstance(item, Const) else Not(item)
        if isinstance(node, Binary):
            left, right = self.folded(node.left), self.folded(node.right)
            if isinstance(left, Const) and node.op in ("and", "or"):
                return right if bool(left.value) == (node.op == "and") else left
            if isinstance(left, Const) and isinstance(right, Const):
                return Const(_BINARY[node.op](left.value, right.value))
            if node.op == "~" and isinstance(right, Const) and isinstance(left, Binary) and left.op == "~" and isinstance(left.right, Const):
                return Binary("~", left.left, Const(_text(left.right.value) + _text(right.value)))
            return Binary(node.op, left, right)
        return node

    def folded_body(self, body: tuple) -> tuple:
        out: list[Any] = []
        for node in body:
            if isinstance(node, Output):
                item = self.folded(node.item)
                if isinstance(item, Const):
                    item = Const(_text(item.value))
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].item, Const):
                        out[-1] = Output(Const(out[-1].item.value + item.value))
                        continue
                    if not item.value:
                        continue
                out.append(Output(item))
            elif isinstance(node, For):
                out.append(For(node.name, self.folded(node.source), self.folded_body(node.body)))
            elif isinstance(node, Generation):
                out.append(Generation(self.folded_body(node.body)))
            elif isinstance(node, Set):
                out.append(Set(node.name, self.folded(node.item)))
            else:
                tests, other = [], self.folded_body(node.other)
                for test, inner in node.tests:
                    test, inner = self.folded(test), self.folded_body(inner)
                    if isinstance(test, Const) and not test.value:
                        continue
                    if isinstance(test, Const):
                        other = inner
                        break
                    tests.append((test, inner))
                if tests:
                    out.append(If(tuple(tests), other))
                else:
                    out.extend(other)
        return tuple(out)

    def value(self, node: Any) -> Callable[[dict], Any]:
        if isinstance(node, Const):
            return lambda scope, v=node.value: v
        if isinstance(node, Name):

            def name(scope: dict, key=node.name) -> Any:
                if key not in scope:
                    raise TemplateError(f"unknown name {key!r}")
                return scope[key]

            return name
        if isinstance(node, Field):

            def field(scope: dict, base=self.value(node.base), key=node.name) -> Any:
                held = base(scope)
                if type(held) is not dict or key not in held:
                    raise TemplateError(f"no field {key!r}")
                return held[key]

            return field
        if isinstance(node, Filter):
            return lambda scope, f=self.filters[node.name], base=self.value(node.base): f(base(scope))
        if isinstance(node, Not):
            return lambda scope, item=self.value(node.item): not item(scope)
        left, right = self.value(node.left), self.value(node.right)
        if node.op == "and":
            return lambda scope: left(scope) and right(scope)
        if node.op == "or":
            return lambda scope: left(scope) or right(scope)
        return lambda scope, f=_BINARY[node.op]: f(left(scope), right(scope))

    def body(self, nodes: tuple, lossy: bool = False) -> Callable[[dict], Iterator[tuple[str, bool]]]:
        parts = [self.statement(n, lossy) for n in nodes]

        def run(scope: dict) -> Iterator[tuple[str, bool]]:
            for part in parts:
                yield from part(scope)

        return run

    def statement(self, node: Any, lossy: bool) -> Callable[[dict], Iterator[tuple[str, bool]]]:
        if isinstance(node, Output):
            item = self.value(node.item)
            return lambda scope: iter(((_text(item(scope)), lossy),))
        if isinstance(node, Generation):
            return self.body(node.body, True)
        if isinstance(node, Set):

            def assign(scope: dict, item=self.value(node.item), key=node.name) -> Iterator:
                scope[key] = item(scope)
                return iter(())

            return assign
        if isinstance(node, For):

            def loop(scope: dict, source=self.value(node.source), inner=self.body(node.body, lossy), key=node.name) -> Iterator:
                for i, held in enumerate(source(scope)):
                    yield from inner(scope | {key: held, "loop": {"index": i + 1, "first": i == 0}})

            return loop
        tests = [(self.value(t), self.body(b, lossy)) for t, b in node.tests]
        other = self.body(node.other, lossy)

        def choose(scope: dict) -> Iterator:
            for test, inner in tests:
                if test(scope):
                    return inner(scope)
            return other(scope)

        return choose

    def compile(self, source: str) -> Callable[[dict], Iterator[tuple[str, bool]]]:
        """A function of the names in scope that yields (text, under the loss mask)."""
        return self.body(self.folded_body(parse(source)))
