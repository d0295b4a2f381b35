"""A compiler for a small, sandboxed template language.

    {{ expression }}   {% if e %} {% elif e %} {% else %} {% endif %}   {% for x in e %} {% endfor %}
    {% set x = e %}    {% generation %} ... {% endgeneration %}          {# comment #}

Expressions: names, attributes of records (x.role), strings, integers, true/false/none, + ~ == != < > <= >=, in,
and, or, not, parentheses, `a if c else b`, and filters (x | trim). Names resolve only to what the caller and the
template itself bind, attributes only to keys of records, filters only to FILTERS: Python objects are never
reached. A tag's inner dashes ({%- -%}) strip the white space beside it.

parse() gives a syntax tree, fold() replaces constant parts by their values, generate() turns the tree into
Python closures. A rendered template is a stream of pieces of text and of the markers GENERATION_START and
GENERATION_END, so a conversation of any length is rendered turn by turn.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    pass


class Marker:
    def __init__(self, name: str) -> None:
        self.name = name


GENERATION_START, GENERATION_END = Marker("start"), Marker("end")
Context = dict[str, Any]
Piece = str | Marker


# --- syntax tree ---


@dataclass
class Const:
    value: Any


@dataclass
class Name:
    name: str


@dataclass
class Attribute:
    of: Any
    key: str


@dataclass
class Apply:
    """An operator or filter of FUNCTIONS applied to all its arguments."""

    function: str
    args: list


@dataclass
class Choice:
    """`and`, `or` and conditional expressions, which evaluate only what they need."""

    kind: str
    args: list


@dataclass
class Text:
    value: str


@dataclass
class Output:
    expression: Any


@dataclass
class If:
    branches: list[tuple[Any, list]]


@dataclass
class For:
    name: str
    over: Any
    body: list


@dataclass
class Set:
    name: str
    expression: Any


@dataclass
class Generation:
    body: list = field(default_factory=list)


def _text(x: Any) -> str:
    return "" if x is None else ("true" if x else "false") if isinstance(x, bool) else str(x)


FILTERS: dict[str, Callable[[Any], Any]] = {
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x),
    "string": _text,
}
OPERATORS: dict[str, Callable[..., Any]] = {
    "+": lambda a, b: a + b,
    "~": lambda a, b: _text(a) + _text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b,
    ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b,
    "not": lambda a: not a,
}

# --- parser ---

_TAG = re.compile(r"\{\{-?(?P<out>.*?)-?\}\}|\{%-?(?P<tag>.*?)-?%\}|\{#.*?#\}", re.S)
_WORD = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>().|,=]))")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    def __init__(self, source: str) -> None:
        self.words: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _WORD.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at : at + 20]!r}")
            self.words.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] != "str" else ""

    def take(self, *wanted: str) -> bool:
        if self.peek() in wanted and self.peek():
            self.at += 1
            return True
        return False

    def next(self) -> tuple[str, str]:
        if self.at >= len(self.words):
            raise TemplateError("the expression ends too early")
        self.at += 1
        return self.words[self.at - 1]

    def whole(self) -> Any:
        e = self.conditional()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return e

    def conditional(self) -> Any:
        e = self.either()
        if self.take("if"):
            condition = self.either()
            if not self.take("else"):
                raise TemplateError("if without else")
            return Choice("if", [condition, e, self.conditional()])
        return e

    def either(self) -> Any:
        e = self.both()
        while self.take("or"):
            e = Choice("or", [e, self.both()])
        return e

    def both(self) -> Any:
        e = self.negated()
        while self.take("and"):
            e = Choice("and", [e, self.negated()])
        return e

    def negated(self) -> Any:
        return Apply("not", [self.negated()]) if self.take("not") else self.compared()

    def compared(self) -> Any:
        e = self.joined()
        while (op := self.peek()) in ("==", "!=", "<", ">", "<=", ">=", "in"):
            self.at += 1
            e = Apply(op, [e, self.joined()])
        return e

    def joined(self) -> Any:
        e = self.filtered()
        while (op := self.peek()) in ("+", "~"):
            self.at += 1
            e = Apply(op, [e, self.filtered()])
        return e

    def filtered(self) -> Any:
        e = self.atom()
        while True:
            if self.take("."):
                kind, key = self.next()
                if kind != "name" or key.startswith("_"):
                    raise TemplateError(f"no attribute {key!r}")
                e = Attribute(e, key)
            elif self.take("|"):
                e = Apply("|" + self.next()[1], [e])
            else:
                return e

    def atom(self) -> Any:
        kind, word = self.next()
        if kind == "str":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        if kind == "int":
            return Const(int(word))
        if word == "(":
            e = self.conditional()
            if not self.take(")"):
                raise TemplateError("missing )")
            return e
        if kind == "name":
            constants = {"true": True, "false": False, "none": None}
            return Const(constants[word]) if word in constants else Name(word)
        raise TemplateError(f"unexpected {word!r}")


def parse(source: str) -> list:
    """The syntax tree of a template: a list of nodes."""
    root: list = []
    stack: list[tuple[str, list]] = [("", root)]
    at, strip_next = 0, False
    for m in [*_TAG.finditer(source), None]:
        text = source[at : m.start() if m else len(source)]
        if strip_next:
            text = text.lstrip()
        if m and m[0][2:3] == "-":
            text = text.rstrip()
        body = stack[-1][1]
        if text:
            body.append(Text(text))
        if not m:
            break
        at, strip_next = m.end(), m[0][-3:-2] == "-"
        if m["out"] is not None:
            body.append(Output(_Expression(m["out"]).whole()))
        elif m["tag"] is not None:
            _statement(m["tag"].strip(), stack)
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return root


def _statement(tag: str, stack: list[tuple[str, list]]) -> None:
    word, _, rest = tag.partition(" ")
    body = stack[-1][1]
    if word == "if":
        node = If([(_Expression(rest).whole(), [])])
        body.append(node)
        stack.append(("if", node.branches[-1][1]))
    elif word in ("elif", "else"):
        if stack[-1][0] != "if":
            raise TemplateError(f"{word} outside of if")
        stack.pop()
        node = stack[-1][1][-1]
        node.branches.append((_Expression(rest).whole() if word == "elif" else Const(True), []))
        stack.append(("if", node.branches[-1][1]))
    elif word == "for":
        m = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
        if not m:
            raise TemplateError(f"can't read {tag!r}")
        node = For(m[1], _Expression(m[2]).whole(), [])
        body.append(node)
        stack.append(("for", node.body))
    elif word == "generation":
        node = Generation()
        body.append(node)
        stack.append(("generation", node.body))
    elif word == "set":
        m = re.fullmatch(r"([A-Za-z]\w*)\s*=(?!=)(.+)", rest, re.S)
        if not m:
            raise TemplateError(f"can't read {tag!r}")
        body.append(Set(m[1], _Expression(m[2]).whole()))
    elif word.startswith("end") and word[3:] == stack[-1][0]:
        stack.pop()
    else:
        raise TemplateError(f"unexpected {tag!r}")


# --- constant folding ---


def fold(node: Any, functions: dict[str, Callable[..., Any]] | None = None) -> Any:
    """The tree with constant expressions evaluated, dead branches cut and neighbouring texts joined."""
    functions = functions if functions is not None else _functions({})
    again = lambda x: fold(x, functions)
    match node:
        case list():
            out: list = []
            for x in map(again, node):
                for y in x if isinstance(x, list) else [x]:
                    if isinstance(y, Text) and out and isinstance(out[-1], Text):
                        out[-1] = Text(out[-1].value + y.value)
                    elif not (isinstance(y, Text) and not y.value):
                        out.append(y)
            return out
        case Apply(function, args):
            args = [again(a) for a in args]
            if function in functions and all(isinstance(a, Const) for a in args):
                return Const(functions[function](*[a.value for a in args]))
            return Apply(function, args)
        case Choice(kind, args):
            args = [again(a) for a in args]
            if isinstance(args[0], Const):
                first = args[0].value
                if kind == "if":
                    return args[1] if first else args[2]
                return args[1] if bool(first) == (kind == "and") else args[0]
            return Choice(kind, args)
        case Attribute(of, key):
            return Attribute(again(of), key)
        case Output(expression):
            e = again(expression)
            return Text(_text(e.value)) if isinstance(e, Const) else Output(e)
        case If(branches):
            kept: list = []
            for condition, body in branches:
                condition = again(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                kept.append((condition, again(body)))
                if isinstance(condition, Const):
                    break
            if not kept:
                return []
            return kept[0][1] if isinstance(kept[0][0], Const) else If(kept)
        case For(name, over, body):
            return For(name, again(over), again(body))
        case Set(name, expression):
            return Set(name, again(expression))
        case Generation(body):
            return Generation(again(body))
    return node


# --- closures ---


def _functions(filters: dict[str, Callable[[Any], Any]]) -> dict[str, Callable[..., Any]]:
    return OPERATORS | {f"|{k}": f for k, f in (FILTERS | filters).items()}


def _value(node: Any, functions: dict[str, Callable[..., Any]]) -> Callable[[Context], Any]:
    match node:
        case Const(value):
            return lambda c: value
        case Name(name):
            return lambda c: c.get(name)
        case Attribute(of, key):
            inner = _value(of, functions)

            def attribute(c: Context) -> Any:
                record = inner(c)
                return record.get(key) if isinstance(record, dict) else None

            return attribute
        case Apply(function, args):
            if function not in functions:
                raise TemplateError(f"no filter {function[1:]!r}")
            f, parts = functions[function], [_value(a, functions) for a in args]
            if len(parts) == 1:
                one = parts[0]
                return lambda c: f(one(c))
            a, b = parts
            return lambda c: f(a(c), b(c))
        case Choice(kind, args):
            parts = [_value(a, functions) for a in args]
            if kind == "if":
                return lambda c: parts[1](c) if parts[0](c) else parts[2](c)
            if kind == "and":
                return lambda c: parts[0](c) and parts[1](c)
            return lambda c: parts[0](c) or parts[1](c)
    raise TemplateError(f"no expression: {node}")


def _looped(items: Iterable[Any]) -> Iterator[tuple[Any, dict]]:
    """Items with loop.index, loop.index0, loop.first and loop.last, looking one item ahead."""
    i, previous, some = 0, None, False
    for x in items:
        if some:
            yield previous, {"index": i, "index0": i - 1, "first": i == 1, "last": False}
        i, previous, some = i + 1, x, True
    if some:
        yield previous, {"index": i, "index0": i - 1, "first": i == 1, "last": True}


def _body(nodes: list, functions: dict[str, Callable[..., Any]]) -> Callable[[Context], Iterator[Piece]]:
    parts = [_node(x, functions) for x in nodes]

    def run(c: Context) -> Iterator[Piece]:
        for part in parts:
            yield from part(c)

    return run


def _node(node: Any, functions: dict[str, Callable[..., Any]]) -> Callable[[Context], Iterable[Piece]]:
    match node:
        case Text(value):
            return lambda c: (value,)
        case Output(expression):
            of = _value(expression, functions)
            return lambda c: (_text(of(c)),)
        case If(branches):
            pairs = [(_value(e, functions), _body(b, functions)) for e, b in branches]
            return lambda c: next((body(c) for condition, body in pairs if condition(c)), ())
        case Set(name, expression):
            of = _value(expression, functions)

            def bind(c: Context) -> tuple:
                c[name] = of(c)
                return ()

            return bind
        case For(name, over, body):
            items, inner = _value(over, functions), _body(body, functions)

            def loop(c: Context) -> Iterator[Piece]:
                for x, state in _looped(items(c) or ()):
                    yield from inner(c | {name: x, "loop": state})

            return loop
        case Generation(body):
            inner = _body(body, functions)

            def marked(c: Context) -> Iterator[Piece]:
                yield GENERATION_START
                yield from inner(c)
                yield GENERATION_END

            return marked
    raise TemplateError(f"no statement: {node}")


def generate(tree: list, functions: dict[str, Callable[..., Any]]) -> Callable[[Context], Iterator[Piece]]:
    return _body(tree, functions)


def compiled(source: str, filters: dict[str, Callable[[Any], Any]] | None = None) -> Callable[[Context], Iterator[Piece]]:
    """The renderer of a template: context in, pieces and markers out. filters: further ones, also sandboxed in
    that only they can be called."""
    functions = _functions(filters or {})
    return generate(fold(parse(source), functions), functions)
