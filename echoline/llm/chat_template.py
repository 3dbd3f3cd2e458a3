"""Chat formatting: a compiler for a sandboxed template language.

A template is read into a syntax tree, constants are folded, and the tree becomes Python
closures: expressions take the scope, statements yield pieces ``(text, counts for the loss)``.
Pieces come out as turns go in, with one turn of look-ahead for ``loop.last``, so a
conversation of any length is rendered with bounded memory.

    {{ expression }}   {# comment #}   tags with a minus, as {%- and -%}, trim the blanks before or after them
    {% for m in messages %} ... {% endfor %}      loop.index0, loop.index, loop.first, loop.last
    {% if c %} ... {% elif c %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}       text under the loss mask
    expressions: 'text', 12, true, false, none, names, m.role, m['role'], ==, !=, <, <=, >, >=,
    in, not, and, or, +, ~, a if c else b, ( ), filters: x | upper

Sandbox: names reach the given values only, ``.`` looks up keys of mappings only, there are no
calls and no attributes of Python objects, and the filters are the ones listed in ``FILTERS``.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

#: Control strings begin with these two characters; inside texts a backslash parts them.
_CONTROL = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    """No ``<|`` is left; ``unescape`` gives the text back."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def escape_line(text: str) -> str:
    """For a header line: line feeds as ``\\n``, backslashes doubled, then as ``escape``."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable[[str], object]] = {
    "escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len,
}


class TemplateError(ValueError):
    """A template that can't be compiled, or a look-up that the sandbox refuses."""


# Syntax tree: expressions.


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


# Syntax tree: statements.


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class Let:
    name: str
    value: object


@dataclass(frozen=True)
class If:
    arms: tuple
    other: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


#: What a tag holds: texts in quotes, in which its end may stand, and anything else but its end.
_INSIDE = r"((?:'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\"|(?!-?{0}).)*)"
_PART = re.compile(r"\{\{(-?)" + _INSIDE.replace("{0}", r"\}\}") + r"(-?)\}\}|\{%(-?)" + _INSIDE.replace("{0}", r"%\}") + r"(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[<>()\[\].|~+]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """A recursive-descent reader, weakest operator first."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:].strip()!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return None if kind == "text" else text

    def take(self, *wanted: str) -> str | None:
        found = self.peek()
        if found in wanted and found is not None:
            self.at += 1
            return found
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self) -> object:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> object:
        out = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return Op("if", (test, out, self.choice()))
        return out

    def either(self) -> object:
        out = self.both()
        while self.take("or"):
            out = Op("or", (out, self.both()))
        return out

    def both(self) -> object:
        out = self.negation()
        while self.take("and"):
            out = Op("and", (out, self.negation()))
        return out

    def negation(self) -> object:
        return Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> object:
        out = self.sum()
        while sign := self.take("==", "!=", "<", "<=", ">", ">=", "in"):
            out = Op(sign, (out, self.sum()))
        return out

    def sum(self) -> object:
        out = self.filtered()
        while sign := self.take("+", "~"):
            out = Op(sign, (out, self.filtered()))
        return out

    def filtered(self) -> object:
        out = self.item()
        while self.take("|"):
            name = self.name()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            out = Op("|" + name, (out,))
        return out

    def item(self) -> object:
        out = self.atom()
        while True:
            if self.take("."):
                out = Item(out, Const(self.name()))
            elif self.take("["):
                out = Item(out, self.choice())
                self.need("]")
            else:
                return out

    def atom(self) -> object:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        if self.take("("):
            out = self.choice()
            self.need(")")
            return out
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(text))
        if kind == "name" and text not in {"and", "or", "not", "in", "if", "else"}:
            return {"true": Const(True), "false": Const(False), "none": Const(None)}.get(text) or Name(text)
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    """The statements of a template."""
    parts, at, trim = [], 0, False

    def plain(text: str, before: bool) -> None:
        text = text.lstrip() if trim else text
        text = text.rstrip() if before else text
        if text:
            parts.append(("text", text))

    for m in _PART.finditer(source):
        groups = m.groups()
        plain(source[at : m.start()], "-" in (groups[0], groups[3], groups[6]))
        if groups[1] is not None:
            parts.append(("value", groups[1]))
        elif groups[4] is not None:
            parts.append(("do", groups[4].strip()))
        at, trim = m.end(), "-" in (groups[2], groups[5], groups[7])
    plain(source[at:], False)
    body, left = _block(parts, 0, ())
    if left < len(parts):
        raise TemplateError(f"unexpected {parts[left][1]!r}")
    return body


def _block(parts: list[tuple[str, str]], at: int, ends: tuple[str, ...]) -> tuple[tuple, int]:
    out: list[object] = []
    while at < len(parts):
        kind, text = parts[at]
        if kind == "text":
            out.append(Emit(Const(text)))
        elif kind == "value":
            out.append(Emit(_Expression(text).whole()))
        else:
            word, _, rest = text.partition(" ")
            if word in ends:
                return tuple(out), at
            if word == "set":
                e = _Expression(rest.replace("=", " ( ", 1) + " )") if "=" in rest else _Expression("")
                name = e.name()
                out.append(Let(name, e.whole()))
            elif word == "generation":
                body, at = _block(parts, at + 1, ("endgeneration",))
                out.append(Generation(body))
            elif word == "for":
                e = _Expression(rest)
                name = e.name()
                e.need("in")
                over = e.whole()
                body, at = _block(parts, at + 1, ("endfor",))
                out.append(For(name, over, body))
            elif word == "if":
                arms, other, test = [], (), _Expression(rest).whole()
                while True:
                    body, at = _block(parts, at + 1, ("elif", "else", "endif") if test is not None else ("endif",))
                    if test is None:
                        other = body
                    else:
                        arms.append((test, body))
                    word, _, rest = (parts[at][1] if at < len(parts) else "endif").partition(" ")
                    if word == "endif":
                        break
                    test = _Expression(rest).whole() if word == "elif" else None
                out.append(If(tuple(arms), other))
            else:
                raise TemplateError(f"unknown tag {text!r}")
            if at >= len(parts):
                raise TemplateError("a block has no end")
        at += 1
    if ends:
        raise TemplateError(f"{ends[-1]!r} is missing")
    return tuple(out), at


def _text(value: object) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


_PLAIN = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "in": lambda a, b: a in b, "not": operator.not_, "+": operator.add, "~": lambda a, b: _text(a) + _text(b),
}


def _applied(name: str) -> Callable:
    return (lambda f: lambda x: f(_text(x)))(FILTERS[name[1:]]) if name[0] == "|" else _PLAIN[name]


def _lookup(of: object, key: object) -> object:
    if not isinstance(of, dict):
        raise TemplateError("only mappings have items")
    return of.get(key)


def fold(node: object) -> object:
    """The expression with constant parts worked out."""
    if isinstance(node, Item):
        return Item(fold(node.of), fold(node.key))
    if not isinstance(node, Op):
        return node
    args = tuple(map(fold, node.args))
    first = args[0]
    if node.name == "if" and isinstance(first, Const):
        return args[1] if first.value else args[2]
    if node.name in ("and", "or") and isinstance(first, Const):
        return args[1] if bool(first.value) == (node.name == "and") else first
    if node.name not in ("if", "and", "or") and all(isinstance(a, Const) for a in args):
        try:
            return Const(_applied(node.name)(*(a.value for a in args)))
        except TypeError as e:
            raise TemplateError(f"{node.name!r}: {e}") from e
    return Op(node.name, args)


def fold_block(body: tuple) -> tuple:
    """Statements with folded expressions, decided branches resolved and neighbouring texts joined."""
    out: list[object] = []
    for node in body:
        if isinstance(node, Emit):
            new: list[object] = [Emit(fold(node.value))]
        elif isinstance(node, Let):
            new = [Let(node.name, fold(node.value))]
        elif isinstance(node, Generation):
            new = [Generation(fold_block(node.body))]
        elif isinstance(node, For):
            new = [For(node.name, fold(node.over), fold_block(node.body))]
        else:
            arms, other = [], fold_block(node.other)
            for test, arm in ((fold(t), b) for t, b in node.arms):
                if isinstance(test, Const) and not test.value:
                    continue
                if isinstance(test, Const):
                    other = fold_block(arm)
                    break
                arms.append((test, fold_block(arm)))
            new = [If(tuple(arms), other)] if arms else list(other)
        for x in new:
            if isinstance(x, Emit) and isinstance(x.value, Const):
                x = Emit(Const(_text(x.value.value)))
                if not x.value.value:
                    continue
                if out and isinstance(out[-1], Emit) and isinstance(out[-1].value, Const):
                    x = Emit(Const(out.pop().value.value + x.value.value))
            out.append(x)
    return tuple(out)


def _closure(node: object) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if isinstance(node, Name):
        name = node.name
        return lambda scope: scope.get(name)
    if isinstance(node, Item):
        of, key = _closure(node.of), _closure(node.key)
        return lambda scope: _lookup(of(scope), key(scope))
    args = [_closure(a) for a in node.args]
    if node.name == "if":
        test, yes, no = args
        return lambda scope: yes(scope) if test(scope) else no(scope)
    if node.name == "and":
        a, b = args
        return lambda scope: a(scope) and b(scope)
    if node.name == "or":
        a, b = args
        return lambda scope: a(scope) or b(scope)
    f = _applied(node.name)
    if len(args) == 1:
        (a,) = args
        return lambda scope: f(a(scope))
    a, b = args
    return lambda scope: f(a(scope), b(scope))


Piece = tuple[str, bool]


def _statement(node: object, loss: bool) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Emit):
        if isinstance(node.value, Const):
            piece = (node.value.value, loss)
            return lambda scope: iter((piece,))
        value = _closure(node.value)
        return lambda scope: iter(((_text(value(scope)), loss),))
    if isinstance(node, Let):
        name, value = node.name, _closure(node.value)

        def let(scope: dict) -> Iterator[Piece]:
            scope[name] = value(scope)
            return iter(())

        return let
    if isinstance(node, Generation):
        return _sequence(node.body, True)
    if isinstance(node, If):
        arms, other = [(_closure(t), _sequence(b, loss)) for t, b in node.arms], _sequence(node.other, loss)
        return lambda scope: next((b for t, b in arms if t(scope)), other)(scope)
    over, body, name = _closure(node.over), _sequence(node.body, loss), node.name

    def loop(scope: dict) -> Iterator[Piece]:
        items = iter(over(scope) or ())
        none = object()
        now, i = next(items, none), 0
        outer = {k: scope[k] for k in (name, "loop") if k in scope}
        while now is not none:
            after = next(items, none)
            scope[name], scope["loop"] = now, {"index0": i, "index": i + 1, "first": i == 0, "last": after is none}
            yield from body(scope)
            now, i = after, i + 1
        #: The names of a loop end with it; an outer loop gets its own back.
        for k in (name, "loop"):
            scope.pop(k, None)
        scope.update(outer)

    return loop


def _sequence(body: tuple, loss: bool) -> Callable[[dict], Iterator[Piece]]:
    steps = [_statement(x, loss) for x in body]

    def run(scope: dict) -> Iterator[Piece]:
        for step in steps:
            yield from step(scope)

    return run


class _Once:
    """Messages that come as a stream can be gone through once."""

    def __init__(self, messages: Iterator[dict]):
        self.messages: Iterator[dict] | None = messages

    def __iter__(self) -> Iterator[dict]:
        if self.messages is None:
            raise TemplateError("the messages are a stream and have been read")
        messages, self.messages = self.messages, None
        return messages


@dataclass
class Template:
    """A compiled template."""

    source: str
    tree: tuple = field(init=False)

    def __post_init__(self):
        try:
            self.tree = fold_block(parse(self.source))
            self._run = _sequence(self.tree, False)
        except RecursionError as e:
            raise TemplateError("too deeply nested") from e

    def pieces(self, messages: Iterable[dict], **values: object) -> Iterator[Piece]:
        """Pieces of text, as the messages come, and whether they count for the loss."""
        once = isinstance(messages, Iterator)
        try:
            yield from self._run({**values, "messages": _Once(messages) if once else messages})
        except (RecursionError, TypeError) as e:
            raise TemplateError(str(e)) from e

    def render(self, messages: Iterable[dict], **values: object) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans under the loss mask."""
        out, spans, at = [], [], 0
        for text, loss in self.pieces(messages, **values):
            if loss and text:
                spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans
