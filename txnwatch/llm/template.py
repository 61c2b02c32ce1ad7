"""A small template language for conversations, compiled to Python closures.

``{{ expression }}`` prints, ``{% if %} {% elif %} {% else %} {% endif %}`` chooses, ``{% set name = expression %}``
names a value until the end of the turn, ``{% for message in messages %} ... {% endfor %}`` holds what is printed per
turn, ``{% generation %} ... {% endgeneration %}`` marks text that a model learns to write, ``{# #}`` is a comment, and
a minus inside a bracket removes the white space beside it. Expressions have strings, whole numbers, true, false, none,
``message.role``, ``message.text``, ``message.turn``, ``loop.first``, ``loop.last``, ``loop.index``, ``loop.index0``,
given constants, ``+ - ~ == != < <= > >= in not and or``, ``a if c else b`` and filters.

There is nothing else, so a template cannot reach Python: no calls, no other attributes, one loop, and what it
names must exist when it is compiled. Text before and after the loop is printed once per conversation.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Any

LONGEST = 100_000
DEEPEST = 50


class TemplateError(ValueError):
    """A template that cannot be compiled."""


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Apply:
    """An operator or filter on evaluated operands."""

    name: str
    run: Callable[..., Any]
    operands: tuple[Any, ...]


@dataclass(frozen=True)
class Choice:
    """``then`` if ``test`` holds, else ``otherwise``; also what ``and`` and ``or`` become."""

    test: Any
    then: Any
    otherwise: Any


@dataclass(frozen=True)
class Either:
    """``first and second`` (``stop`` false) or ``first or second`` (``stop`` true)."""

    stop: bool
    first: Any
    second: Any


@dataclass(frozen=True)
class Print:
    value: Any


@dataclass(frozen=True)
class Branch:
    test: Any
    then: tuple[Any, ...]
    otherwise: tuple[Any, ...]


@dataclass(frozen=True)
class Assign:
    name: str
    value: Any


@dataclass(frozen=True)
class Marked:
    body: tuple[Any, ...]


@dataclass(frozen=True)
class Each:
    body: tuple[Any, ...]


def escape(text: str) -> str:
    """No ``<|`` is left: a bar after ``<`` and any backslashes gets one more backslash."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_header(text: str) -> str:
    """Like ``escape``, and no line break is left."""
    return text.replace("\\", "\\\\").replace("\n", "\\n").replace("<|", "<\\|")


def unescape_header(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text)


def _string(value: Any) -> str:
    return "" if value is None else {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


FILTERS: dict[str, tuple[int, Callable[..., Any]]] = {
    "escape": (0, lambda v: escape(_string(v))),
    "escape_header": (0, lambda v: escape_header(_string(v))),
    "trim": (0, lambda v: _string(v).strip()),
    "upper": (0, lambda v: _string(v).upper()),
    "lower": (0, lambda v: _string(v).lower()),
    "length": (0, lambda v: len(_string(v))),
    "default": (1, lambda v, other: other if v is None or v == "" else v),
    "replace": (2, lambda v, old, new: _string(v).replace(_string(old), _string(new))),
}


def _ordered(test: Callable[[Any, Any], bool]) -> Callable[[Any, Any], bool]:
    """A comparison of two numbers or two strings; false for anything else."""
    return lambda a, b: test(a, b) if isinstance(a, str) == isinstance(b, str) and a is not None and b is not None else False


def _add(a: Any, b: Any) -> Any:
    return a + b if isinstance(a, int) and isinstance(b, int) else _string(a) + _string(b)


def _subtract(a: Any, b: Any) -> Any:
    return a - b if isinstance(a, int) and isinstance(b, int) else None


# Defined for every pair of values, so no turn can make a compiled template fail.
OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": operator.eq, "!=": operator.ne, "<": _ordered(operator.lt), "<=": _ordered(operator.le), ">": _ordered(operator.gt),
    ">=": _ordered(operator.ge), "+": _add, "-": _subtract, "~": lambda a, b: _string(a) + _string(b),
    "in": lambda a, b: _string(a) in _string(b), "not in": lambda a, b: _string(a) not in _string(b),
}
FIELDS = {"message": ("role", "text", "turn"), "loop": ("first", "last", "index", "index0")}
WORDS = {"true": True, "false": False, "none": None}
PIECE = re.compile(r"\{\{(-?)(.*?)(-?)\}\}|\{%(-?)(.*?)(-?)%\}|\{#(-?).*?(-?)#\}", re.S)
TOKEN = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+~<>()\[\].,|=]))""", re.S)
PLAIN = {"\\n": "\n", "\\t": "\t"}


class Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, text: str, known: set[str]):
        self.tokens: list[tuple[str, str]] = []
        self.known, self.at, self.depth = known, 0, 0
        end = 0
        text = text.strip()
        while end < len(text):
            m = TOKEN.match(text, end)
            if not m:
                raise TemplateError(f"cannot read {text[end:]!r}")
            self.tokens.append((("string", "number", "name", "sign")[m.lastindex - 1], m[m.lastindex]))
            end = m.end()

    def take(self, *signs: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "string" and self.tokens[self.at][1] in signs:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, sign: str) -> None:
        if not self.take(sign):
            raise TemplateError(f"{sign!r} expected")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def whole(self) -> Any:
        value = self.ternary()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} not expected")
        return value

    def ternary(self) -> Any:
        self.depth += 1
        if self.depth > DEEPEST:
            raise TemplateError("too deeply nested")
        value = self.either("or", lambda: self.either("and", self.negated))
        if self.take("if"):
            test = self.either("or", lambda: self.either("and", self.negated))
            value = Choice(test, value, self.ternary() if self.take("else") else Const(None))
        self.depth -= 1
        return value

    def either(self, word: str, part: Callable[[], Any]) -> Any:
        value = part()
        while self.take(word):
            value = Either(word == "or", value, part())
        return value

    def negated(self) -> Any:
        flips = 0
        while self.take("not"):
            flips += 1
        value = self.compared()
        for _ in range(flips):
            value = Apply("not", operator.not_, (value,))
        return value

    def compared(self) -> Any:
        value = self.summed()
        sign = self.take("==", "!=", "<", "<=", ">", ">=", "in")
        if not sign and self.take("not"):
            self.need("in")
            sign = "not in"
        return Apply(sign, OPERATORS[sign], (value, self.summed())) if sign else value

    def summed(self) -> Any:
        value = self.filtered()
        while sign := self.take("+", "-", "~"):
            value = Apply(sign, OPERATORS[sign], (value, self.filtered()))
        return value

    def filtered(self) -> Any:
        value = self.atom()
        while self.take("|"):
            name, operands = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    operands.append(self.ternary())
                    if not self.take(","):
                        self.need(")")
                        break
            if len(operands) != FILTERS[name][0]:
                raise TemplateError(f"{name} takes {FILTERS[name][0]} operands")
            value = Apply(name, FILTERS[name][1], (value, *operands))
        return value

    def atom(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression expected")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "string":
            return Const(re.sub(r"\\.", lambda m: PLAIN.get(m[0], m[0][1]), text[1:-1], flags=re.S))
        if kind == "number":
            return Const(int(text))
        if text == "(":
            value = self.ternary()
            self.need(")")
            return value
        if kind != "name":
            raise TemplateError(f"{text!r} not expected")
        if text in WORDS:
            return Const(WORDS[text])
        if text in FIELDS:
            if self.take("["):
                quoted = self.atom()
                self.need("]")
                part = quoted.value if isinstance(quoted, Const) else None
            else:
                self.need(".")
                part = self.name()
            text = f"{text}.{'text' if part == 'content' else part}"
        if text not in self.known:
            raise TemplateError(f"no value {text!r}")
        return Name(text)


def fold(node: Any) -> Any:
    """The node with everything evaluated that depends on constants only."""
    if isinstance(node, Apply):
        operands = tuple(fold(x) for x in node.operands)
        if all(isinstance(x, Const) for x in operands):
            return Const(node.run(*[x.value for x in operands]))
        return Apply(node.name, node.run, operands)
    if isinstance(node, Choice):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold(node.then if test.value else node.otherwise)
        return Choice(test, fold(node.then), fold(node.otherwise))
    if isinstance(node, Either):
        first = fold(node.first)
        if isinstance(first, Const):
            return first if bool(first.value) == node.stop else fold(node.second)
        return Either(node.stop, first, fold(node.second))
    if isinstance(node, Print):
        value = fold(node.value)
        return Print(Const(_string(value.value)) if isinstance(value, Const) else value)
    if isinstance(node, Branch):
        test = fold(node.test)
        if isinstance(test, Const):
            return fold_all(node.then if test.value else node.otherwise)
        return Branch(test, fold_all(node.then), fold_all(node.otherwise))
    if isinstance(node, Assign):
        return Assign(node.name, fold(node.value))
    if isinstance(node, (Marked, Each)):
        return type(node)(fold_all(node.body))
    return node


def fold_all(nodes: tuple[Any, ...]) -> tuple[Any, ...]:
    """Folded nodes; neighbouring constant texts become one, decided branches their content."""
    out: list[Any] = []
    for node in nodes:
        folded = fold(node)
        for x in folded if isinstance(folded, tuple) else (folded,):
            constant = isinstance(x, Print) and isinstance(x.value, Const)
            if constant and not x.value.value:
                continue
            if constant and out and isinstance(out[-1], Print) and isinstance(out[-1].value, Const):
                x = Print(Const(out.pop().value.value + x.value.value))
            out.append(x)
    return tuple(out)


@dataclass
class Output:
    """What has been printed: parts, their length in code points, and marked spans."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def text(self) -> str:
        return "".join(self.parts)


Env = dict[str, Any]


def evaluator(node: Any) -> Callable[[Env], Any]:
    """A closure that evaluates an expression."""
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env[name]
    if isinstance(node, Choice):
        test, then, otherwise = evaluator(node.test), evaluator(node.then), evaluator(node.otherwise)
        return lambda env: then(env) if test(env) else otherwise(env)
    if isinstance(node, Either):
        first, second, stop = evaluator(node.first), evaluator(node.second), node.stop
        return lambda env: value if bool(value := first(env)) == stop else second(env)
    run, operands = node.run, [evaluator(x) for x in node.operands]
    if len(operands) == 1:
        only = operands[0]
        return lambda env: run(only(env))
    return lambda env: run(*[x(env) for x in operands])


def printer(nodes: tuple[Any, ...]) -> Callable[[Env, Output], None]:
    """A closure that prints nodes."""
    steps = [_step(node) for node in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: Env, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


def _step(node: Any) -> Callable[[Env, Output], None]:
    if isinstance(node, Print):
        if isinstance(node.value, Const):
            text = node.value.value
            return lambda env, out: out.write(text)
        value = evaluator(node.value)
        return lambda env, out: out.write(_string(value(env)))
    if isinstance(node, Branch):
        test, then, otherwise = evaluator(node.test), printer(node.then), printer(node.otherwise)
        return lambda env, out: then(env, out) if test(env) else otherwise(env, out)
    if isinstance(node, Assign):
        name, value = node.name, evaluator(node.value)
        return lambda env, out: env.__setitem__(name, value(env))
    body = printer(node.body)

    def marked(env: Env, out: Output) -> None:
        start = out.size
        body(env, out)
        if out.size > start:
            out.spans.append((start, out.size))

    return marked


def parse(template: str, constants: Mapping[str, Any]) -> tuple[Any, ...]:
    """The syntax tree of a template: a tuple of nodes with exactly one ``Each``."""
    if len(template) > LONGEST:
        raise TemplateError("template too long")
    names = {f"{k}.{v}" for k, fields in FIELDS.items() for v in fields}
    # Each open block: its word, the nodes before it, its finished parts, and the names known before it.
    open_blocks: list[tuple[str, list[Any], list[Any], set[str]]] = []
    nodes: list[Any] = []
    known, at, strip, loops = set(constants), 0, False, 0

    def text(end: int, trim: bool) -> None:
        part = template[at:end]
        part = part.lstrip() if strip else part
        part = part.rstrip() if trim else part
        if part:
            nodes.append(Print(Const(part)))

    for m in PIECE.finditer(template):
        left, right = (m[1] or m[4] or m[7]), (m[3] or m[6] or m[8])
        text(m.start(), bool(left))
        at, strip = m.end(), bool(right)
        if m[2] is not None:
            nodes.append(Print(Expression(m[2], known).whole()))
            continue
        if m[5] is None:
            continue
        word, _, rest = m[5].strip().partition(" ")
        rest = rest.strip()
        inside = [b[0] for b in open_blocks]
        if word == "if":
            open_blocks.append(("if", nodes, [[Expression(rest, known).whole()]], set(known)))
            nodes = []
        elif word in ("elif", "else") and inside and inside[-1] == "if" and len(open_blocks[-1][2][-1]) == 1:
            open_blocks[-1][2][-1].append(tuple(nodes))
            known = set(open_blocks[-1][3])
            open_blocks[-1][2].append([Expression(rest, known).whole()] if word == "elif" else [Const(True)])
            nodes = []
        elif word == "endif" and inside and inside[-1] == "if":
            _, before, parts, known = open_blocks.pop()
            parts[-1].append(tuple(nodes))
            tail: tuple[Any, ...] = ()
            for test, body in reversed(parts):
                tail = (Branch(test, body, tail),)
            nodes = [*before, *tail]
        elif word == "for" and rest.split() == ["message", "in", "messages"] and not inside and not loops:
            open_blocks.append(("for", nodes, [], set(known)))
            nodes, known, loops = [], known | names, 1
        elif word == "endfor" and inside and inside[-1] == "for":
            _, before, _, known = open_blocks.pop()
            nodes = [*before, Each(tuple(nodes))]
        elif word == "generation" and "generation" not in inside and "for" in inside:
            open_blocks.append(("generation", nodes, [], set(known)))
            nodes = []
        elif word == "endgeneration" and inside and inside[-1] == "generation":
            _, before, _, known = open_blocks.pop()
            nodes = [*before, Marked(tuple(nodes))]
        elif word == "set" and re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=).*", rest, re.S):
            name, _, value = rest.partition("=")
            name = name.strip()
            if name in FIELDS or name in WORDS:
                raise TemplateError(f"{name!r} cannot be set")
            nodes.append(Assign(name, Expression(value, known).whole()))
            known = known | {name}
        else:
            raise TemplateError(f"{m[0]!r} not expected")
    text(len(template), False)
    if open_blocks:
        raise TemplateError(f"{open_blocks[-1][0]!r} is not closed")
    if not loops:
        raise TemplateError("a loop over the messages is missing")
    return tuple(nodes)


class Template:
    """A compiled template. ``constants`` are values that the template may name."""

    def __init__(self, source: str, **constants: Any):
        self.source, self.constants = source, constants
        known = [Assign(k, Const(v)) for k, v in constants.items()]
        self.tree = fold_all(_with_constants(parse(source, constants), {a.name: a.value for a in known}))
        place = next(k for k, node in enumerate(self.tree) if isinstance(node, Each))
        self.before, self.body, self.after = printer(self.tree[:place]), printer(self.tree[place].body), printer(self.tree[place + 1 :])

    def __reduce__(self):
        return _rebuild, (self.source, self.constants)

    def turn(self, role: str, text: str, turn: Any, index: int, last: bool, shared: Env | None = None) -> Output:
        """What one turn prints, with the text before the first turn and after the last one.

        ``shared`` carries what the text before the loop sets; hand the same dictionary to all turns of a conversation.
        """
        out = Output()
        shared = {} if shared is None else shared
        if index == 0:
            self.before(shared, out)
        env = {
            **shared, "message.role": role, "message.text": text, "message.turn": turn,
            "loop.first": index == 0, "loop.last": last, "loop.index": index + 1, "loop.index0": index,
        }
        self.body(env, out)
        if last:
            self.after(dict(shared), out)
        return out


def _rebuild(source: str, constants: Mapping[str, Any]) -> Template:
    return Template(source, **constants)


def _with_constants(node: Any, values: Mapping[str, Const]) -> Any:
    """The tree with given constants in place of their names, as long as the template does not set them."""
    if isinstance(node, tuple):
        out, left = [], dict(values)
        for x in node:
            out.append(_with_constants(x, left))
            for name in _assigned(x):
                left.pop(name, None)
        return tuple(out)
    if isinstance(node, Name):
        return values.get(node.name, node)
    if isinstance(node, (Apply, Choice, Either, Print, Branch, Assign, Marked, Each)):
        kept = {k: v for k, v in vars(node).items() if k in ("name", "run", "stop")}
        return type(node)(**{k: v if k in kept else _with_constants(v, values) for k, v in vars(node).items()})
    return node


def _assigned(node: Any) -> set[str]:
    """Names that a node sets."""
    if isinstance(node, Assign):
        return {node.name}
    parts = node if isinstance(node, tuple) else vars(node).values() if isinstance(node, (Branch, Marked, Each)) else ()
    return {name for x in parts for name in _assigned(x)}
