"""Chat formatting: a compiler for a small, sandboxed template language.

Templates are lexed and parsed into a syntax tree, constants are folded, and each node becomes a Python
closure; nothing is evaluated as Python source. A template can read only the values it is given, by name
and by key or index into lists and mappings; it cannot call anything but the filters listed here, touch
attributes, or loop over more than its input.

    {{ expression }}                                   output
    {% if e %} {% elif e %} {% else %} {% endif %}      choice
    {% for x in e %} {% else %} {% endfor %}            loop, with loop.index, index0, first, last, length
    {% set x = e %}                                    variable of the current scope
    {% generation %} {% endgeneration %}               text that the model is to learn
    {# comment #}    {%- -%} {{- -}}                    comment; trimming of white space

Expressions: literals, names, a.b, a[b], a[b:c], + - ~ * / // %, comparisons, in, not in, is (not)
defined|none|string|mapping|sequence, and, or, not, x if c else y, and filters after a bar.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import q


class TemplateError(ValueError):
    """A template that cannot be compiled, or a value it cannot be applied to."""


class Undefined:
    """What a missing name or key gives: empty as text, false, and without parts."""

    def __bool__(self) -> bool:
        return False

    def __str__(self) -> str:
        return ""

    def __iter__(self):
        return iter(())

    def __len__(self) -> int:
        return 0

    def __eq__(self, other) -> bool:
        return isinstance(other, Undefined)

    __hash__ = None


NOTHING = Undefined()
FILTERS: dict[str, Callable] = {
    "trim": lambda v: text(v).strip(),
    "upper": lambda v: text(v).upper(),
    "lower": lambda v: text(v).lower(),
    "title": lambda v: text(v).title(),
    "capitalize": lambda v: text(v).capitalize(),
    "string": lambda v: text(v),
    "int": lambda v: int(v or 0),
    "length": lambda v: len(v),
    "first": lambda v: next(iter(v), NOTHING),
    "last": lambda v: list(v)[-1] if len(v) else NOTHING,
    "join": lambda v, by="": text(by).join(text(x) for x in v),
    "default": lambda v, other="": other if isinstance(v, Undefined) or v is None else v,
    "replace": lambda v, old, new: text(v).replace(text(old), text(new)),
    "tojson": lambda v: json.dumps(None if isinstance(v, Undefined) else v, ensure_ascii=False, sort_keys=True),
    "reverse": lambda v: list(v)[::-1],
}
TESTS: dict[str, Callable] = {
    "defined": lambda v: not isinstance(v, Undefined),
    "none": lambda v: v is None,
    "string": lambda v: isinstance(v, str),
    "mapping": lambda v: isinstance(v, dict),
    "sequence": lambda v: isinstance(v, (list, tuple, str)),
}
PARTS = re.compile(r"(\{\{-?|\{%-?|\{#)(.*?)(-?\}\}|-?%\}|#\})", re.S)
TOKENS = re.compile(
    r"""\s*(?:(?P<num>\d+\.\d+|\d+)|(?P<name>[A-Za-z_]\w*)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")
    |(?P<op>==|!=|<=|>=|//|[-+~*/%<>()\[\]{}.,|:=]))""",
    re.X,
)
ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


def text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "true" if value else "false"
    return str(value)


def tokenise(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    source = source.rstrip()
    while at < len(source):
        m = TOKENS.match(source, at)
        if not m:
            raise TemplateError(f"unexpected {source[at:at + 20]!r}")
        kind, value = m.lastgroup, m[m.lastgroup]
        if kind == "num":
            value = float(value) if "." in value else int(value)
        elif kind == "str":
            value = re.sub(r"\\(.)", lambda e: ESCAPES.get(e[1], "\\" + e[1]), value[1:-1], flags=re.S)
        out.append((kind, value))
        at = m.end()
    return out


class Reader:
    """A recursive-descent parser of one expression; nodes are tuples (kind, ...)."""

    LEVELS = [("or",), ("and",), None, ("==", "!=", "<", "<=", ">", ">=", "in", "not", "is"), ("~",), ("+", "-"), ("*", "/", "//", "%")]

    def __init__(self, source: str) -> None:
        self.tokens, self.at, self.depth = tokenise(source), 0, 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values: str) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"expected {value!r}")

    def name(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "name":
            raise TemplateError("expected a name")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def expression(self):
        self.depth += 1
        if self.depth > 50:
            raise TemplateError("expression is nested too deeply")
        value = self.level(0)
        if self.take("if"):
            condition = self.level(0)
            other = self.expression() if self.take("else") else ("const", NOTHING)
            value = ("cond", condition, value, other)
        self.depth -= 1
        return value

    def level(self, k: int):
        if k == len(self.LEVELS):
            return self.unary()
        ops = self.LEVELS[k]
        if ops is None:
            return ("not", self.level(k)) if self.take("not") else self.level(k + 1)
        left = self.level(k + 1)
        while self.peek(*ops):
            op = self.tokens[self.at][1]
            self.at += 1
            if op == "not":
                self.need("in")
                left = ("not", ("op", "in", left, self.level(k + 1)))
            elif op == "is":
                negative, test = self.take("not"), self.name()
                if test not in TESTS:
                    raise TemplateError(f"unknown test {test!r}")
                left = ("test", test, left)
                left = ("not", left) if negative else left
            else:
                left = ("op", op, left, self.level(k + 1))
        return left

    def unary(self):
        if self.take("-"):
            return ("op", "-", ("const", 0), self.unary())
        value = self.primary()
        while True:
            if self.take("."):
                value = ("get", value, ("const", self.name()))
            elif self.take("["):
                start = None if self.peek(":") else self.expression()
                if self.take(":"):
                    stop = None if self.peek("]") else self.expression()
                    value = ("slice", value, start, stop)
                else:
                    value = ("get", value, start)
                self.need("]")
            elif self.take("|"):
                name, arguments = self.name(), []
                if name not in FILTERS:
                    raise TemplateError(f"unknown filter {name!r}")
                if self.take("("):
                    while not self.take(")"):
                        arguments.append(self.expression())
                        if not self.peek(")"):
                            self.need(",")
                value = ("filter", name, value, *arguments)
            else:
                return value

    def primary(self):
        if self.at >= len(self.tokens):
            raise TemplateError("expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind in ("num", "str"):
            return ("const", value)
        if kind == "name":
            constants = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}
            return ("const", constants[value]) if value in constants else ("name", value)
        if value == "(":
            inner = self.expression()
            self.need(")")
            return inner
        if value == "[":
            items = []
            while not self.take("]"):
                items.append(self.expression())
                if not self.peek("]"):
                    self.need(",")
            return ("list", *items)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """The syntax tree of a template: a list of statement nodes."""
    pieces, at = [], 0
    trim = False
    for m in PARTS.finditer(source):
        literal = source[at : m.start()]
        literal = literal.lstrip() if trim else literal
        pieces.append(("text", literal.rstrip() if m[1].endswith("-") else literal))
        trim = m[3].startswith("-")
        kind = {"{{": "out", "{%": "tag", "{#": "note"}[m[1][:2]]
        if m[3].lstrip("-") != {"out": "}}", "tag": "%}", "note": "#}"}[kind]:
            raise TemplateError(f"{m[1]} is closed by {m[3]}")
        if kind != "note":
            pieces.append((kind, m[2].strip()))
        at = m.end()
    pieces.append(("text", source[at:].lstrip() if trim else source[at:]))
    nodes, rest = body(pieces, 0, ())
    assert rest == len(pieces)
    return nodes


def body(pieces: list, at: int, ends: tuple[str, ...]) -> tuple[list, int]:
    """Statements up to a tag that begins with one of ``ends``, and where that is."""
    nodes = []
    while at < len(pieces):
        kind, value = pieces[at]
        if kind == "text":
            if value:
                nodes.append(("text", value))
            at += 1
            continue
        if kind == "out":
            reader = Reader(value)
            nodes.append(("out", reader.expression()))
            reader.done()
            at += 1
            continue
        word = value.split(None, 1)[0] if value else ""
        if word in ends:
            return nodes, at
        reader = Reader(value[len(word) :])
        if word == "set":
            name = reader.name()
            reader.need("=")
            nodes.append(("set", name, reader.expression()))
            at += 1
        elif word == "if":
            branches, condition = [], reader.expression()
            while True:
                reader.done()
                inner, at = body(pieces, at + 1, ("elif", "else", "endif"))
                branches.append((condition, inner))
                if at >= len(pieces):
                    raise TemplateError("if without endif")
                tag = pieces[at][1]
                if tag == "endif":
                    break
                reader = Reader(tag[4:])
                condition = reader.expression() if tag.startswith("elif") else ("const", True)
            nodes.append(("if", branches))
            at += 1
        elif word == "for":
            name = reader.name()
            reader.need("in")
            items = reader.level(0)
            inner, at = body(pieces, at + 1, ("else", "endfor"))
            otherwise: list = []
            if at < len(pieces) and pieces[at][1] == "else":
                otherwise, at = body(pieces, at + 1, ("endfor",))
            if at >= len(pieces):
                raise TemplateError("for without endfor")
            nodes.append(("for", name, items, inner, otherwise))
            at += 1
        elif word == "generation":
            inner, at = body(pieces, at + 1, ("endgeneration",))
            if at >= len(pieces):
                raise TemplateError("generation without endgeneration")
            nodes.append(("generation", inner))
            at += 1
        else:
            raise TemplateError(f"unknown tag {word!r}")
        reader.done()
    if ends:
        return nodes, at
    return nodes, at


def plus(a, b):
    return a + b if not isinstance(a, str) and not isinstance(b, str) else text(a) + text(b)


OPERATORS: dict[str, Callable] = {
    "+": plus,
    "-": lambda a, b: a - b,
    "*": lambda a, b: a * b if not isinstance(a, (str, list)) and not isinstance(b, (str, list)) else NOTHING,
    "/": lambda a, b: a / b,
    "//": lambda a, b: a // b,
    "%": lambda a, b: a % b if not isinstance(a, str) else NOTHING,
    "~": lambda a, b: text(a) + text(b),
    "==": lambda a, b: a == b,
    "!=": lambda a, b: not a == b,
    "<": lambda a, b: a < b,
    "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b,
    ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b if not isinstance(b, Undefined) else False,
}


def get(value, key):
    if isinstance(value, dict):
        return value.get(key, NOTHING)
    if isinstance(value, (list, tuple, str)) and isinstance(key, int) and -len(value) <= key < len(value):
        return value[key]
    return NOTHING


def fold(node):
    """The node with constant parts computed and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "op":
        a, b = fold(node[2]), fold(node[3])
        if node[1] in ("and", "or"):
            if a[0] == "const":
                return (b if a[1] else a) if node[1] == "and" else (a if a[1] else b)
            return ("op", node[1], a, b)
        if a[0] == b[0] == "const":
            try:
                return ("const", OPERATORS[node[1]](a[1], b[1]))
            except (TypeError, ValueError, ArithmeticError):
                pass  # left for the time it is rendered, if it ever is
        return ("op", node[1], a, b)
    if kind == "not":
        a = fold(node[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "cond":
        c, a, b = fold(node[1]), fold(node[2]), fold(node[3])
        return (a if c[1] else b) if c[0] == "const" else ("cond", c, a, b)
    if kind in ("filter", "test"):
        parts = [fold(x) for x in node[2:]]
        if all(p[0] == "const" for p in parts):
            try:
                return ("const", {**FILTERS, **TESTS}[node[1]](*[p[1] for p in parts]) if kind == "filter" else TESTS[node[1]](parts[0][1]))
            except (TypeError, ValueError):
                pass
        return (kind, node[1], *parts)
    if kind in ("get", "list", "slice"):
        return (kind, *[fold(x) if x is not None else None for x in node[1:]])
    if kind == "out":
        e = fold(node[1])
        return ("text", text(e[1])) if e[0] == "const" else ("out", e)
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "if":
        branches = []
        for condition, inner in node[1]:
            condition = fold(condition)
            if condition[0] == "const" and not condition[1]:
                continue
            branches.append((condition, fold_all(inner)))
            if condition[0] == "const":
                break
        if not branches or branches[0][0][0] == "const":
            return ("block", branches[0][1] if branches else [])
        return ("if", branches)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold_all(node[3]), fold_all(node[4]))
    return (kind, fold_all(node[1]))


def fold_all(nodes: list) -> list:
    out: list = []
    for node in nodes:
        node = fold(node)
        for n in node[1] if node[0] == "block" else [node]:
            if n[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + n[1])
            elif n[0] != "text" or n[1]:
                out.append(n)
    return out


def closure(node) -> Callable:
    """A function of the scope that gives the value of an expression."""
    kind = node[0]
    if kind == "const":
        value = node[1]
        return lambda s: value
    if kind == "name":
        name = node[1]
        return lambda s: s.get(name, NOTHING)
    if kind == "not":
        a = closure(node[1])
        return lambda s: not a(s)
    if kind == "cond":
        c, a, b = map(closure, node[1:])
        return lambda s: a(s) if c(s) else b(s)
    if kind == "op":
        a, b = closure(node[2]), closure(node[3])
        if node[1] == "and":
            return lambda s: a(s) and b(s)
        if node[1] == "or":
            return lambda s: a(s) or b(s)
        f = OPERATORS[node[1]]
        return lambda s: f(a(s), b(s))
    if kind in ("filter", "test"):
        f = (FILTERS if kind == "filter" else TESTS)[node[1]]
        parts = [closure(x) for x in node[2:]]
        return lambda s: f(*[p(s) for p in parts])
    if kind == "get":
        a, b = closure(node[1]), closure(node[2])
        return lambda s: get(a(s), b(s))
    if kind == "slice":
        a = closure(node[1])
        b, c = (closure(x) if x is not None else (lambda s: None) for x in node[2:])
        return lambda s: a(s)[b(s) : c(s)]
    parts = [closure(x) for x in node[1:]]
    return lambda s: [p(s) for p in parts]


def runner(nodes: list) -> Callable:
    """A function of (scope, output) that runs the statements; output counts characters as it grows."""
    steps = []
    for node in nodes:
        kind = node[0]
        if kind == "text":
            steps.append(lambda s, o, v=node[1]: o.add(v))
        elif kind == "out":
            steps.append(lambda s, o, e=closure(node[1]): o.add(text(e(s))))
        elif kind == "set":
            steps.append(lambda s, o, n=node[1], e=closure(node[2]): s.__setitem__(n, e(s)))
        elif kind == "generation":
            steps.append(lambda s, o, r=runner(node[1]): o.span(r, s))
        elif kind == "if":
            branches = [(closure(c), runner(inner)) for c, inner in node[1]]

            def choose(s, o, branches=branches):
                for condition, run in branches:
                    if condition(s):
                        run(s, o)
                        return

            steps.append(choose)
        elif kind == "for":

            def loop(s, o, name=node[1], items=closure(node[2]), run=runner(node[3]), other=runner(node[4])):
                values = list(items(s))
                for i, value in enumerate(values):
                    state = {"index": i + 1, "index0": i, "first": i == 0, "last": i == len(values) - 1, "length": len(values)}
                    run({**s, name: value, "loop": state}, o)
                if not values:
                    other(s, o)

            steps.append(loop)
    if len(steps) == 1:
        return steps[0]

    def run(s, o):
        for step in steps:
            step(s, o)

    return run


class Output:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, value: str) -> None:
        self.parts.append(value)
        self.size += len(value)

    def span(self, run, scope) -> None:
        start = self.size
        run(scope, self)
        if self.size > start:
            self.spans.append((start, self.size))


def compile_template(source: str) -> Callable[..., tuple[str, list[tuple[int, int]]]]:
    """A function of keyword values that gives the text and the (start, end) characters of generations."""
    run = runner(fold_all(parse(source)))

    def render(**values):
        out = Output()
        try:
            run(dict(values), out)
        except (TypeError, ArithmeticError, AttributeError) as e:
            raise TemplateError(f"the template does not fit these values: {e}") from e
        return "".join(out.parts), out.spans

    return render


CHAT = (
    "{% for message in messages %}<|im_start|>{{ message.role }}\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.content }}<|im_end|>{% endgeneration %}\n"
    "{% else %}{{ message.content }}<|im_end|>\n{% endif %}{% endfor %}"
)


def format_chats(
    turns: DataFrame,
    template: str = CHAT,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """(<conv>, text, spans, n_turns): each conversation rendered, in order of its turns.

    The template gets ``messages``, a list of mappings with role, content and turn. ``spans`` has the start
    and end characters of what was rendered inside generation tags. Turns come by number, null ones last,
    then by role and text, nulls last; repeated rows are repeated turns. Null roles and texts render as
    nothing; rows with a null conversation are one conversation. Other columns are ignored. A conversation
    is collected in one task, as it must be to be one text.
    """
    compile_template(template)  # fail here rather than in a task
    kind = turns.schema[conv_col].dataType
    last = lambda c: F.col(q(c)).isNull()
    ordered = F.sort_array(
        F.collect_list(
            F.struct(
                last(turn_col).alias("a"), F.col(q(turn_col)).alias("turn"), last(role_col).alias("b"),
                F.col(q(role_col)).alias("role"), last(text_col).alias("c"), F.col(q(text_col)).alias("content"),
            )
        )
    )
    grouped = turns.groupBy(F.col(q(conv_col)).alias("conv")).agg(ordered.alias("m"))
    plain = grouped.select("conv", F.transform("m", lambda m: F.struct(m["turn"].alias("turn"), m["role"].alias("role"), m["content"].alias("content"))).alias("m"))

    def format_(batches):
        render = compile_template(template)
        for batch in batches:
            made = [render(messages=m) for m in batch.column(1).to_pylist()]
            spans = [[{"start": a, "end": b} for a, b in s] for _, s in made]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([t for t, _ in made], pa.string()),
                    pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                    pa.array([len(m) for m in batch.column(1).to_pylist()], pa.int32()),
                ],
                names=[conv_col, "text", "spans", "n_turns"],
            )

    blank = grouped.select(
        F.lit(None).cast(kind).alias(conv_col),
        F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("array<struct<start:int,end:int>>").alias("spans"),
        F.lit(None).cast("int").alias("n_turns"),
    )
    return plain.mapInArrow(format_, blank.schema)
