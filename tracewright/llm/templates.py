"""A small sandboxed template language, compiled to Python closures.

Text with `{{ expression }}`, `{% if %} {% elif %} {% else %} {% endif %}`,
`{% for x in list %} ... {% endfor %}`, `{% set x = expression %}`,
`{% generation %} ... {% endgeneration %}` and `{# comments #}`; a dash inside a
tag trims the white space on its side. Expressions know literals, names, keys
(`a.b`, `a['b']`), `or and not`, comparisons, `in`, `+ - ~` and filters. There are
no calls, no Python attributes and no names with leading underscores, so a template
reaches nothing but the values it is given.

`compile_template` parses to a syntax tree, folds constants and returns closures
that yield (text, generated) parts lazily.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass, field
from typing import Any


class TemplateError(ValueError):
    """The template is not well-formed, or asks for something it may not have."""


# syntax tree


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Key:
    of: Any
    key: Any


@dataclass(frozen=True)
class Op:
    """Operator or filter with its operands."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Show:
    value: Any


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body) pairs
    otherwise: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: Any


@dataclass(frozen=True)
class Generation:
    body: tuple


# marks: control strings in texts are escaped so that they can be restored

_OPEN, _SHUT = re.compile(r"<(\\*)\|"), re.compile(r"<(\\*)\\\|")
_LINE = re.compile(r"\\(.)", re.S)


def guard(text: str) -> str:
    """Put a backslash into every `<|`, so that no control string is left in `text`."""
    return _OPEN.sub(r"<\1\\|", text)


def unguard(text: str) -> str:
    return _SHUT.sub(r"<\1|", text)


def guard_line(text: str) -> str:
    """As `guard`, for text that must stay on one line."""
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\p")


def unguard_line(text: str) -> str:
    return _LINE.sub(lambda m: {"n": "\n", "p": "|"}.get(m[1], m[1]), text)


def _string(v: Any) -> str:
    return "" if v is None else "true" if v is True else "false" if v is False else str(v)


FILTERS: dict[str, Callable] = {
    "trim": lambda v: _string(v).strip(), "upper": lambda v: _string(v).upper(), "lower": lambda v: _string(v).lower(),
    "length": len, "string": _string, "tojson": lambda v: json.dumps(v, ensure_ascii=False, sort_keys=True),
    "default": lambda v, other="": other if v is None else v, "replace": lambda v, old, new: _string(v).replace(old, new),
    "guard": lambda v: guard(_string(v)), "guard_line": lambda v: guard_line(_string(v)),
}
_STRICT: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b,
    ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "+": lambda a, b: a + b, "-": lambda a, b: a - b,
    "~": lambda a, b: _string(a) + _string(b), "not": lambda a: not a, "neg": lambda a: -a,
} | {f"|{n}": f for n, f in FILTERS.items()}


# parser

_TAG = re.compile(r"\{#-?.*?-?#\}|\{\{-?.*?-?\}\}|\{%-?.*?-?%\}", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<string>"(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*')|(?P<name>[A-Za-z]\w*)|(?P<sign>==|!=|<=|>=|[-+~<>().,|\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        source = source.rstrip()
        while at < len(source):
            if not (m := _TOKEN.match(source, at)):
                raise TemplateError(f"unexpected {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        """The next sign or word; None for literals and at the end."""
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        return text if kind in ("sign", "name") else None

    def accept(self, *texts: str) -> str | None:
        if (found := self.peek()) in texts and found is not None:
            self.at += 1
            return found
        return None

    def expect(self, text: str) -> None:
        if not self.accept(text):
            raise TemplateError(f"expected {text!r}")

    def name(self) -> str:
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return text

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self):
        left = self._both()
        while self.accept("or"):
            left = Op("or", (left, self._both()))
        return left

    def _both(self):
        left = self._not()
        while self.accept("and"):
            left = Op("and", (left, self._not()))
        return left

    def _not(self):
        return Op("not", (self._not(),)) if self.accept("not") else self._compared()

    def _compared(self):
        left = self._sum()
        while sign := self.accept("==", "!=", "<=", ">=", "<", ">", "in"):
            left = Op(sign, (left, self._sum()))
        return left

    def _sum(self):
        left = self._filtered()
        while sign := self.accept("+", "-", "~"):
            left = Op(sign, (left, self._filtered()))
        return left

    def _filtered(self):
        value = self._keys()
        while self.accept("|"):
            name, args = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.accept("(") and not self.accept(")"):
                args.append(self.whole())
                while self.accept(","):
                    args.append(self.whole())
                self.expect(")")
            value = Op(f"|{name}", (value, *args))
        return value

    def _keys(self):
        value = self._atom()
        while sign := self.accept(".", "["):
            if sign == ".":
                value = Key(value, Const(self.name()))
            else:
                value = Key(value, self.whole())
                self.expect("]")
        return value

    def _atom(self):
        if self.accept("("):
            value = self.whole()
            self.expect(")")
            return value
        if self.accept("-"):
            return Op("neg", (self._keys(),))
        kind, text = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        self.at += 1
        if kind == "number":
            return Const(int(text))
        if kind == "string":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            known = {"true": True, "false": False, "none": None}
            return Const(known[text]) if text in known else Name(text)
        raise TemplateError("expected a value")


def parse(source: str) -> tuple:
    """Syntax tree of a template."""
    parts, at, trim = [], 0, False
    for m in _TAG.finditer(source):
        text = source[at : m.start()]
        text = text.lstrip() if trim else text
        tag = m[0]
        if tag[2] == "-":
            text = text.rstrip()
        trim = tag[-3] == "-"
        parts += [Text(text)] * bool(text)
        inner = tag[2:-2].removeprefix("-").removesuffix("-")
        if tag[1] != "#":
            parts.append((tag[1], inner.strip()))
        at = m.end()
    rest = source[at:].lstrip() if trim else source[at:]
    parts += [Text(rest)] * bool(rest)
    for p in parts:
        if isinstance(p, Text) and re.search(r"\{[{%#]", p.text):
            raise TemplateError("a tag is not closed")
    body, left, word = _body(parts, ())
    if word:
        raise TemplateError(f"unexpected {word!r}")
    return body


def _body(parts: list, ends: tuple[str, ...]) -> tuple[tuple, list, str]:
    """Nodes up to one of the tags `ends`; what is left after it; that tag."""
    out = []
    while parts:
        part, parts = parts[0], parts[1:]
        if isinstance(part, Text):
            out.append(part)
            continue
        kind, inner = part
        e = _Expression(inner if kind == "{" else inner.partition(" ")[2])
        word = inner.split(None, 1)[0] if inner else ""
        if kind == "{":
            out.append(Show(e.whole()))
        elif word in ends:
            return tuple(out), parts, inner
        elif word == "set":
            name = e.name()
            e.expect("=")
            out.append(Set(name, e.whole()))
        elif word == "for":
            name = e.name()
            e.expect("in")
            over = e.whole()
            body, parts, found = _body(parts, ("endfor",))
            _closed(found, "endfor")
            out.append(For(name, over, body))
        elif word == "generation":
            body, parts, found = _body(parts, ("endgeneration",))
            _closed(found, "endgeneration")
            out.append(Generation(body))
        elif word == "if":
            branches, otherwise, condition = [], (), e.whole()
            while True:
                e.end()
                body, parts, found = _body(parts, ("elif", "else", "endif"))
                branches.append((condition, body))
                if found.startswith("elif"):
                    e = _Expression(found.partition(" ")[2])
                    condition = e.whole()
                    continue
                if found == "else":
                    otherwise, parts, found = _body(parts, ("endif",))
                _closed(found, "endif")
                break
            out.append(If(tuple(branches), otherwise))
        else:
            raise TemplateError(f"unknown tag {inner!r}")
        e.end()
    return tuple(out), [], ""


def _closed(found: str, wanted: str) -> None:
    if found != wanted:
        raise TemplateError(f"missing {wanted!r}")


# constant folding


def fold(node):
    """The same tree with everything worked out that needs no input."""
    if isinstance(node, tuple):
        out: list = []
        for n in map(fold, node):
            for x in n if isinstance(n, tuple) else (n,):
                if isinstance(x, Text) and out and isinstance(out[-1], Text):
                    out[-1] = Text(out[-1].text + x.text)
                elif not (isinstance(x, Text) and not x.text):
                    out.append(x)
        return tuple(out)
    if isinstance(node, Key):
        return Key(fold(node.of), fold(node.key))
    if isinstance(node, Op):
        args = tuple(map(fold, node.args))
        if node.name in ("and", "or"):
            if isinstance(args[0], Const):
                return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
            return Op(node.name, args)
        if all(isinstance(a, Const) for a in args):
            try:
                return Const(_STRICT[node.name](*[a.value for a in args]))
            except Exception as exc:
                raise TemplateError(f"{node.name}: {exc}") from exc
        return Op(node.name, args)
    if isinstance(node, Show):
        value = fold(node.value)
        return Text(_string(value.value)) if isinstance(value, Const) else Show(value)
    if isinstance(node, If):
        branches, otherwise = [], fold(node.otherwise)
        for condition, body in node.branches:
            condition = fold(condition)
            if isinstance(condition, Const):
                if condition.value:
                    otherwise = fold(body)
                    break
                continue
            branches.append((condition, fold(body)))
        return If(tuple(branches), otherwise) if branches else otherwise
    if isinstance(node, For):
        return For(node.name, fold(node.over), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, Set):
        return Set(node.name, fold(node.value))
    return node


# closures

Part = tuple[str, bool]


def _value(node) -> Callable[[dict], Any]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    if isinstance(node, Key):
        of, key = _value(node.of), _value(node.key)

        def get(env):
            holder, k = of(env), key(env)
            if isinstance(holder, Mapping):
                return holder.get(k)
            if isinstance(holder, (list, tuple, str)) and isinstance(k, int):
                return holder[k] if -len(holder) <= k < len(holder) else None
            return None

        return get
    if node.name == "and":
        a, b = map(_value, node.args)
        return lambda env: a(env) and b(env)
    if node.name == "or":
        a, b = map(_value, node.args)
        return lambda env: a(env) or b(env)
    f, args = _STRICT[node.name], [_value(a) for a in node.args]
    if len(args) == 1:
        return lambda env, x=args[0]: f(x(env))
    return lambda env: f(*[a(env) for a in args])


def _with_last(items: Iterable) -> Iterator[tuple[Any, bool]]:
    it = iter(items)
    for held in it:
        for following in it:
            yield held, False
            held = following
        yield held, True


def _run(node) -> Callable[[dict, bool], Iterator[Part]]:
    if isinstance(node, tuple):
        steps = [_run(n) for n in node]

        def block(env, generated):
            for s in steps:
                yield from s(env, generated)

        return block
    if isinstance(node, Text):
        return lambda env, generated, t=node.text: iter(((t, generated),))
    if isinstance(node, Show):
        value = _value(node.value)
        return lambda env, generated: iter(((_string(value(env)), generated),))
    if isinstance(node, Generation):
        body = _run(node.body)
        return lambda env, generated: body(env, True)
    if isinstance(node, Set):
        value = _value(node.value)

        def assign(env, generated):
            env[node.name] = value(env)
            return iter(())

        return assign
    if isinstance(node, If):
        branches, otherwise = [(_value(c), _run(b)) for c, b in node.branches], _run(node.otherwise)

        def choose(env, generated):
            for condition, body in branches:
                if condition(env):
                    return body(env, generated)
            return otherwise(env, generated)

        return choose
    over, body = _value(node.over), _run(node.body)

    def loop(env, generated):
        for k, (item, last) in enumerate(_with_last(over(env) or ())):
            yield from body({**env, node.name: item, "loop": {"index": k + 1, "index0": k, "first": k == 0, "last": last}}, generated)

    return loop


def _uses(node, name: str, inside: bool = False) -> list[bool]:
    """For every use of `name` whether it is a list that an outermost loop walks through."""
    if isinstance(node, Name):
        return [False] * (node.name == name)
    if isinstance(node, tuple):
        return [u for n in node for u in _uses(n, name, inside)]
    if isinstance(node, For):
        own = [not inside] if node.over == Name(name) else _uses(node.over, name, True)
        return own + _uses(node.body, name, True)
    if hasattr(node, "__dataclass_fields__"):
        return [u for f in node.__dataclass_fields__ for u in _uses(getattr(node, f), name, inside)]
    return []


@dataclass(frozen=True)
class Template:
    """Compiled template. `lazy`: the messages are read once, in order, so they may be an iterator."""

    tree: tuple
    lazy: bool
    run: Callable = field(repr=False, compare=False)

    def parts(self, messages: Iterable[Mapping], **values) -> Iterator[Part]:
        """(text, generated) pieces; a generation block is one or more pieces with True."""
        held = messages if self.lazy else list(messages)
        return self.run({**values, "messages": held}, False)

    def render(self, messages: Iterable[Mapping], **values) -> tuple[str, list[tuple[int, int]]]:
        """Text and its generated spans in code points."""
        text, spans, at = [], [], 0
        for part, generated in self.parts(messages, **values):
            if generated and part:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(part))
                else:
                    spans.append((at, at + len(part)))
            text.append(part)
            at += len(part)
        return "".join(text), spans


def compile_template(source: str) -> Template:
    tree = fold(parse(source))
    return Template(tree, _uses(tree, "messages") in ([], [True]), _run(tree))
