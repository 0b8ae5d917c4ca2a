"""Chat formatting by a template compiler.

A template is text with ``{{ expression }}``, ``{% if / elif / else / for / set / generation %}`` and ``{# comments #}``; ``-`` beside a bracket
strips white space. It is parsed into a syntax tree, constants are folded, and every node becomes a Python closure. The language
is a sandbox: values are texts, numbers, lists and records, names reach nothing but the given context, ``a.b`` is the entry ``b`` of a record
and never a Python attribute, filters come from a fixed table, and there are no calls, no unbounded loops and no text
multiplication. Text written inside ``{% generation %}`` is marked as spans: the loss mask.

On Spark the one top-level loop over ``messages`` is the job's parallel unit. Nothing passes from one turn of a loop to the next, so each
row renders its own turn where it is read, whatever the size of its conversation; what stands before and after the loop is rendered
once. Templates that use ``loop`` get a row's place from a range-partitioned numbering, which splits large conversations too.

``guard`` makes text safe: it doubles each backslash and puts one behind the first character of every control string, so no control
string is left and ``unguard`` restores the text.

Cases: a null text or role is the empty text; rows of a conversation are in the order of turn (null first), role, text, so ties and repeated
rows have a defined place; rows without a conversation id form one conversation; an empty table gives no rows; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from retrieva.session import ship_package

from .common import ranged, small_batches


class TemplateError(ValueError):
    """The template is malformed or not allowed here."""


# --- control strings ------------------------------------------------------------------------

def guard(text: str, controls: tuple[str, ...]) -> str:
    """Text without any of the control strings; ``unguard`` gives the text back."""
    text = text.replace("\\", "\\\\")
    return re.sub("(?=" + "|".join(map(re.escape, controls)) + ")(.)", r"\1\\", text, flags=re.S) if controls else text


def unguard(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


# --- lexer and parser -----------------------------------------------------------------------

_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<num>\d+)|(?P<name>[A-Za-z_]\w*)"""
                    r"""|(?P<end>-?%\}|-?\}\})|(?P<op>==|!=|<=|>=|//|[-+*%~<>|.,\[\]()=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def _lex(source: str) -> list[tuple]:
    """('text', s) and ('tag', kind, tokens) in order; white-space control is applied."""
    out, at, strip = [], 0, False
    while at < len(source):
        opens = min((p for p in (source.find(x, at) for x in ("{{", "{%", "{#")) if p >= 0), default=len(source))
        text = source[at:opens]
        text = text.lstrip() if strip else text
        strip = False
        if opens < len(source) and source[opens + 2:opens + 3] == "-":
            text = text.rstrip()
        if text:
            out.append(("text", text))
        if opens == len(source):
            break
        kind = source[opens + 1]
        at = opens + 2 + (source[opens + 2:opens + 3] == "-")
        if kind == "#":
            close = source.find("#}", at)
            if close < 0:
                raise TemplateError("comment without end")
            strip, at = source[close - 1] == "-", close + 2
            continue
        tokens = []
        while True:
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"unexpected character at {at}")
            at = m.end()
            if m["end"]:
                if m["end"][-2:] != {"{": "}}", "%": "%}"}[kind]:
                    raise TemplateError(f"tag closed by {m['end']} at {at}")
                strip = m["end"][0] == "-"
                break
            if m["str"]:
                tokens.append(("const", re.sub(r"\\(.)", lambda e: _ESCAPES.get(e[1], e[1]), m["str"][1:-1], flags=re.S)))
            elif m["num"]:
                tokens.append(("const", int(m["num"])))
            else:
                tokens.append(("name", m["name"]) if m["name"] else ("op", m["op"]))
        out.append(("tag", kind, tokens))
    return out


_CONST = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
#: Binary operators by rising strength.
_LEVELS = (("==", "!=", "<", ">", "<=", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "//", "%"))


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, tokens: list[tuple]):
        self.t, self.i = tokens, 0

    def peek(self, *values) -> bool:
        return self.i < len(self.t) and self.t[self.i][0] != "const" and self.t[self.i][1] in values

    def take(self, *values) -> str:
        if not self.peek(*values):
            raise TemplateError(f"expected {' or '.join(values)}")
        self.i += 1
        return self.t[self.i - 1][1]

    def name(self) -> str:
        if self.i >= len(self.t) or self.t[self.i][0] != "name":
            raise TemplateError("expected a name")
        self.i += 1
        return self.t[self.i - 1][1]

    def whole(self) -> tuple:
        e = self.choice()
        if self.i < len(self.t):
            raise TemplateError(f"unexpected {self.t[self.i][1]!r}")
        return e

    def choice(self) -> tuple:
        e = self.either()
        if self.peek("if"):
            self.take("if")
            c = self.either()
            e = ("choose", c, e, self.choice() if self.peek("else") and self.take("else") else ("const", None))
        return e

    def either(self) -> tuple:
        e = self.both()
        while self.peek("or"):
            self.take("or")
            e = ("or", e, self.both())
        return e

    def both(self) -> tuple:
        e = self.negated()
        while self.peek("and"):
            self.take("and")
            e = ("and", e, self.negated())
        return e

    def negated(self) -> tuple:
        if self.peek("not"):
            self.take("not")
            return ("not", self.negated())
        return self.binary(0)

    def binary(self, level: int) -> tuple:
        if level == len(_LEVELS):
            return self.filtered()
        e = self.binary(level + 1)
        while True:
            if "in" in _LEVELS[level] and self.peek("not"):
                self.take("not")
                self.take("in")
                op = "not in"
            elif self.peek(*_LEVELS[level]):
                op = self.take(*_LEVELS[level])
            elif "in" in _LEVELS[level] and self.peek("is"):
                self.take("is")
                wrong = self.peek("not") and bool(self.take("not"))
                e = ("test", self.take("defined", "none"), e)
                e = ("not", e) if wrong else e
                continue
            else:
                return e
            e = ("binary", op, e, self.binary(level + 1))

    def filtered(self) -> tuple:
        e = self.atom()
        while self.peek("|", ".", "["):
            op = self.take("|", ".", "[")
            if op == ".":
                e = ("entry", e, ("const", self.name()))
            elif op == "[":
                e = ("entry", e, self.choice())
                self.take("]")
            else:
                name, args = self.name(), ()
                if name not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                if self.peek("("):
                    self.take("(")
                    args = self.items(")")
                e = ("filter", name, e, *args)
        return e

    def items(self, end: str) -> tuple:
        out = []
        while not self.peek(end):
            out.append(self.choice())
            if not self.peek(end):
                self.take(",")
        self.take(end)
        return tuple(out)

    def atom(self) -> tuple:
        if self.peek("("):
            self.take("(")
            e = self.choice()
            self.take(")")
            return e
        if self.peek("["):
            self.take("[")
            return ("list", *self.items("]"))
        if self.peek("-"):
            self.take("-")
            return ("binary", "-", ("const", 0), self.atom())
        if self.i < len(self.t) and self.t[self.i][0] == "const":
            self.i += 1
            return self.t[self.i - 1]
        n = self.name()
        return ("const", _CONST[n]) if n in _CONST else ("name", n)


def parse(source: str) -> list[tuple]:
    """The syntax tree: nodes ('text', s), ('out', e), ('set', name, e), ('if', ((cond, body), ...)), ('for', name, e, body), ('generation', body)."""
    pieces, at = _lex(source), 0

    def block(*ends: str) -> tuple[list[tuple], str, list]:
        nonlocal at
        nodes = []
        while at < len(pieces):
            p = pieces[at]
            at += 1
            if p[0] == "text":
                nodes.append(p)
                continue
            if p[1] == "{":
                nodes.append(("out", _Expression(p[2]).whole()))
                continue
            if not p[2] or p[2][0][0] != "name":
                raise TemplateError("empty tag")
            word, rest = p[2][0][1], p[2][1:]
            if word in ends:
                return nodes, word, rest
            x = _Expression(rest)
            if word == "set":
                name = x.name()
                x.take("=")
                nodes.append(("set", name, x.whole()))
            elif word == "if":
                arms, cond = [], x.whole()
                while True:
                    body, word, rest = block(*(("endif",) if cond == ("const", True) and arms and word == "else" else ("elif", "else", "endif")))
                    arms.append((cond, body))
                    if word == "endif":
                        break
                    cond = _Expression(rest).whole() if word == "elif" else ("const", True)
                nodes.append(("if", tuple(arms)))
            elif word == "for":
                name = x.name()
                x.take("in")
                nodes.append(("for", name, x.whole(), block("endfor")[0]))
            elif word == "generation":
                nodes.append(("generation", block("endgeneration")[0]))
            else:
                raise TemplateError(f"unexpected {word}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return nodes, "", []

    return block()[0]


# --- values ---------------------------------------------------------------------------------

def _text(v) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


def _entry(obj, key):
    if isinstance(obj, dict):
        return obj.get(key)
    if isinstance(obj, (list, str)) and isinstance(key, int) and -len(obj) <= key < len(obj):
        return obj[key]
    return None


def _number(f: Callable) -> Callable:
    def op(a, b):
        if not isinstance(a, int) or not isinstance(b, int):
            raise TemplateError("numbers expected")
        return f(a, b)
    return op


def _has(b, a) -> bool:
    return b is not None and (_text(a) in b if isinstance(b, str) else a in b)


_OPERATORS = {"==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": _number(lambda a, b: a < b), ">": _number(lambda a, b: a > b),
              "<=": _number(lambda a, b: a <= b), ">=": _number(lambda a, b: a >= b), "in": lambda a, b: _has(b, a), "not in": lambda a, b: not _has(b, a),
              "~": lambda a, b: _text(a) + _text(b), "+": lambda a, b: a + b if isinstance(a, str) and isinstance(b, str) else _number(lambda x, y: x + y)(a, b),
              "-": _number(lambda a, b: a - b), "*": _number(lambda a, b: a * b), "//": _number(lambda a, b: a // b), "%": _number(lambda a, b: a % b)}

FILTERS = {"trim": lambda c, v: _text(v).strip(), "upper": lambda c, v: _text(v).upper(), "lower": lambda c, v: _text(v).lower(),
           "length": lambda c, v: 0 if v is None else len(v), "default": lambda c, v, d: d if v is None else v,
           "replace": lambda c, v, a, b: _text(v).replace(a, b), "join": lambda c, v, s="": _text(s).join(map(_text, v or [])),
           "first": lambda c, v: _entry(v, 0), "last": lambda c, v: _entry(v, -1), "string": lambda c, v: _text(v),
           "guard": lambda c, v: guard(_text(v), c), "unguard": lambda c, v: unguard(_text(v))}


# --- folding and closures -------------------------------------------------------------------

def _closure(e: tuple, controls: tuple[str, ...]) -> Callable[[dict], object]:
    """An expression as a closure over its context."""
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env.get(n)
    sub = [_closure(x, controls) for x in e[1:] if isinstance(x, tuple)]
    if kind == "entry":
        return lambda env, a=sub[0], b=sub[1]: _entry(a(env), b(env))
    if kind == "binary":
        return lambda env, f=_OPERATORS[e[1]], a=sub[0], b=sub[1]: f(a(env), b(env))
    if kind == "filter":
        return lambda env, f=FILTERS[e[1]], s=sub: f(controls, *[x(env) for x in s])
    if kind == "test":
        return lambda env, a=sub[0], none=e[1] == "none": (a(env) is None) == none
    if kind == "list":
        return lambda env, s=sub: [x(env) for x in s]
    if kind == "not":
        return lambda env, a=sub[0]: not a(env)
    if kind == "and":
        return lambda env, a=sub[0], b=sub[1]: a(env) and b(env)
    if kind == "or":
        return lambda env, a=sub[0], b=sub[1]: a(env) or b(env)
    return lambda env, c=sub[0], a=sub[1], b=sub[2]: a(env) if c(env) else b(env)


def _fold(e: tuple, controls: tuple[str, ...]) -> tuple:
    """An expression with every part that needs no context replaced by its value; a part that fails is left to fail when rendered."""
    if e[0] in ("const", "name"):
        return e
    e = tuple(_fold(x, controls) if isinstance(x, tuple) else x for x in e)
    parts = [x for x in e[1:] if isinstance(x, tuple)]
    if all(p[0] == "const" for p in parts):
        try:
            return ("const", _closure(e, controls)({}))
        except Exception:  # noqa: BLE001 - the error belongs to the rendering
            return e
    if e[0] == "choose" and e[1][0] == "const":
        return e[2] if e[1][1] else e[3]
    if e[0] in ("and", "or") and e[1][0] == "const":
        return e[2] if bool(e[1][1]) == (e[0] == "and") else e[1]
    return e


def fold(nodes: list[tuple], controls: tuple[str, ...] = ()) -> list[tuple]:
    """The tree with constants folded: texts joined, arms that can't be reached dropped, constant loops over nothing removed."""
    out = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node != ("text", ""):
            out.append(node)

    for n in nodes:
        if n[0] == "out":
            e = _fold(n[1], controls)
            add(("text", _text(e[1])) if e[0] == "const" else ("out", e))
        elif n[0] == "set":
            add(("set", n[1], _fold(n[2], controls)))
        elif n[0] == "if":
            arms = []
            for cond, body in n[1]:
                cond = _fold(cond, controls)
                if cond[0] != "const" or cond[1]:
                    arms.append((cond, fold(body, controls)))
                if cond[0] == "const" and cond[1]:
                    break
            if arms and arms[0][0][0] == "const":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(("if", tuple(arms)))
        elif n[0] == "for":
            e = _fold(n[2], controls)
            if e[0] != "const" or e[1]:
                add(("for", n[1], e, fold(n[3], controls)))
        elif n[0] == "generation":
            add(("generation", fold(n[1], controls)))
        else:
            add(n)
    return out


@dataclass
class Output:
    """Rendered text with the spans written under a generation marker (characters, first and past the last)."""
    parts: list[str] = field(default_factory=list)
    spans: list[tuple[int, int]] = field(default_factory=list)
    length: int = 0

    def write(self, s: str) -> None:
        self.parts.append(s)
        self.length += len(s)


def loop_state(index: int, length: int) -> dict:
    return {"index": index + 1, "index0": index, "first": index == 0, "last": index == length - 1, "length": length}


def _render(nodes: list[tuple], controls: tuple[str, ...]) -> Callable[[dict, Output], None]:
    """Nodes as one closure (context, output)."""
    steps: list[Callable[[dict, Output], None]] = []
    for n in nodes:
        if n[0] == "text":
            steps.append(lambda env, out, s=n[1]: out.write(s))
        elif n[0] == "out":
            steps.append(lambda env, out, e=_closure(n[1], controls): out.write(_text(e(env))))
        elif n[0] == "set":
            steps.append(lambda env, out, k=n[1], e=_closure(n[2], controls): env.__setitem__(k, e(env)))
        elif n[0] == "if":
            def choose(env, out, arms=[(_closure(c, controls), _render(b, controls)) for c, b in n[1]]):
                for cond, body in arms:
                    if cond(env):
                        return body(env, out)
            steps.append(choose)
        elif n[0] == "for":
            def loop(env, out, name=n[1], e=_closure(n[2], controls), body=_render(n[3], controls)):
                items = e(env) or []
                for i, x in enumerate(items):
                    body({**env, name: x, "loop": loop_state(i, len(items))}, out)  # what a turn sets ends with it
            steps.append(loop)
        else:
            def marked(env, out, body=_render(n[1], controls)):
                start = out.length
                body(env, out)
                out.spans.append((start, out.length))
            steps.append(marked)

    def run(env: dict, out: Output) -> None:
        for s in steps:
            s(env, out)
    return run


def _names(x) -> set[str]:
    """Every name a tree refers to."""
    if isinstance(x, tuple) and len(x) == 2 and x[0] == "name":
        return {x[1]}
    return set().union(*map(_names, x)) if isinstance(x, (tuple, list)) and x else set()


class Template:
    """A compiled template. ``controls``: the strings that ``guard`` keeps out of texts (two characters or more, no backslash)."""

    def __init__(self, source: str, controls: tuple[str, ...] = ()):
        if any(len(c) < 2 or "\\" in c for c in controls):
            raise TemplateError("control strings have two characters or more and no backslash")
        self.source, self.controls = source, tuple(controls)
        self.tree = fold(parse(source), self.controls)
        self._all = _render(self.tree, self.controls)

    def __reduce__(self):  # closures are compiled again where they are needed
        return Template, (self.source, self.controls)

    def render(self, messages: list[dict], **context) -> tuple[str, list[tuple[int, int]]]:
        """A whole conversation: its text and the spans under a generation marker."""
        out = Output()
        self._all({**context, "messages": messages}, out)
        return "".join(out.parts), out.spans

    def by_turn(self) -> tuple[str, Callable[[dict, dict], Output], str, bool]:
        """(text before the loop, closure for one turn, text after it, whether turns need their place) of a template with one
        top-level loop over ``messages`` that is used nowhere else."""
        loops = [i for i, n in enumerate(self.tree) if n[0] == "for" and n[2] == ("name", "messages")]
        if len(loops) != 1:
            raise TemplateError("the template needs one top-level loop over messages")
        head, (_, name, _, body), tail = self.tree[:loops[0]], self.tree[loops[0]], self.tree[loops[0] + 1:]
        if "messages" in _names(head) | _names(body) | _names(tail):
            raise TemplateError("messages is used outside of its loop")
        env, edges = {}, []
        for nodes in (head, tail):
            out = Output()
            _render(nodes, self.controls)(env, out)
            if out.spans:
                raise TemplateError("generation outside of the loop")
            edges.append("".join(out.parts))
            if nodes is head:
                shared = dict(env)
        run = _render(body, self.controls)

        def turn(message: dict, place: dict) -> Output:
            out = Output()
            run({**shared, name: message, "loop": place}, out)
            return out
        return edges[0], turn, edges[1], "loop" in _names(body)


# --- the production template -----------------------------------------------------------------

#: Strings with a meaning for the model; texts never hold one after ``guard``.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[TEXT]", "[/ROLE]")
INSTRUCT = """<s>
{%- for message in messages -%}
  {%- if message.role == 'user' -%}      {{ '[INST] ' ~ (message.text | guard) ~ ' [/INST]' }}
  {%- elif message.role == 'system' -%}  {{ '<<SYS>>' ~ (message.text | guard) ~ '<</SYS>>' }}
  {%- elif message.role == 'assistant' -%}  {% generation %}{{ message.text | guard }}{% endgeneration %}</s>
  {%- else -%}  [ROLE]{{ message.role | guard }}[TEXT]{{ message.text | guard }}[/ROLE]
  {%- endif -%}
{%- endfor -%}"""


def read_turns(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, first, past the last character of its guarded text) of the turns in a text of the production template, or in a part of it that
    starts and ends between turns. Anything else is an error."""
    out, at = [], 3 if text.startswith("<s>") else 0
    while at < len(text):
        role, opens, close = next(((r, a, b) for r, a, b in (("user", "[INST] ", " [/INST]"), ("system", "<<SYS>>", "<</SYS>>"), (None, "[ROLE]", "[/ROLE]"))
                                   if text.startswith(a, at)), ("assistant", "", "</s>"))
        start = at + len(opens)
        if role is None:
            body = text.index("[TEXT]", start)
            role, start = unguard(text[start:body]), body + len("[TEXT]")
        end = text.index(close, start)
        out.append((role, unguard(text[start:end]), start, end))
        at = end + len(close)
    return out


# --- Spark jobs -------------------------------------------------------------------------------

def _arrow(fields: list[tuple[str, pa.DataType]], batch: pa.RecordBatch, keep: list[str], columns: list[list]) -> pa.RecordBatch:
    arrays = [batch.column(k) for k in keep] + [pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=keep + [n for n, _ in fields])


def format_conversations(rows: DataFrame, template: Template) -> DataFrame:
    """(conv_id, turn, piece, loss) for rows (conv_id, turn, role, text): the formatted text of each turn and the spans of it under the loss mask.

    A conversation's text is the template's head, its pieces in order, and the tail (``Template.by_turn``)."""
    ship_package(rows.sparkSession)
    small_batches(rows.sparkSession)
    needs_place = template.by_turn()[3]
    rows = rows.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    if needs_place:
        placed = ranged(rows.withColumn("_one", F.lit(1)), ["conv_id"], ["turn", "role", "text"], "_one", "chat-order").drop("_one", "before")
        counts = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.count(F.lit(1)).alias("_of"))
        rows = placed.join(counts.hint("merge"), F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    schema = T.StructType([rows.schema["conv_id"], rows.schema["turn"]]).add("piece", "string").add("loss", T.DataType.fromDDL("array<struct<first:int,past:int>>"))
    span = pa.struct([("first", pa.int32()), ("past", pa.int32())])

    def render(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = template.by_turn()[1]
        for b in it:
            places = [loop_state(*x) for x in zip(b.column("slot").to_pylist(), b.column("_of").to_pylist(), strict=True)] if needs_place else [None] * b.num_rows
            done = [turn({"role": r, "text": t}, p) for r, t, p in zip(b.column("role").to_pylist(), b.column("text").to_pylist(), places, strict=True)]
            yield _arrow([("piece", pa.string()), ("loss", pa.list_(span))], b, ["conv_id", "turn"],
                         [["".join(o.parts) for o in done], [[{"first": x, "past": y} for x, y in o.spans] for o in done]])

    return rows.mapInArrow(render, schema)


def read_back(pieces: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, loss, chars): the turns read from formatted pieces of the production template, with the unguarded text under their mask."""
    ship_package(pieces.sparkSession)
    schema = T.StructType([pieces.schema["conv_id"], pieces.schema["turn"]]).add("role", "string").add("text", "string").add("loss", "string").add("chars", "long")

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, cols = [], [[], [], [], []]
            for i, (piece, loss) in enumerate(zip(b.column("piece").to_pylist(), b.column("loss").to_pylist(), strict=True)):
                spans = [(x["first"], x["past"]) for x in loss]
                for k, (role, text, start, end) in enumerate(read_turns(piece)):
                    under = "".join(unguard(piece[x:y]) for x, y in spans if start <= x and y <= end)
                    at.append(i)
                    for c, v in zip(cols, (role, text, under, len(piece) if k == 0 else 0), strict=True):
                        c.append(v)
            yield _arrow([("role", pa.string()), ("text", pa.string()), ("loss", pa.string()), ("chars", pa.int64())], b.take(pa.array(at, pa.int64())), ["conv_id", "turn"], cols)

    return pieces.mapInArrow(read, schema)


def conversation_digests(turns: DataFrame, edge_chars: int) -> DataFrame:
    """One row for each conversation of ``read_back``: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest runs over a conversation from its first character to its last, so the turns stream in order through the task of their conversation
    (sorted by Spark, spilled if need be); the task keeps one batch and two hash states, however long the conversation is."""
    ordered = turns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = T.StructType([turns.schema["conv_id"]]).add("n_turns", "long").add("turns_sha256", "string").add("loss_chars", "long").add("loss_sha256", "string").add("formatted_chars", "long")
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def digest(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, id_type = None, pa.int64()

        def closed() -> pa.RecordBatch:
            conv, n, turns_hash, loss_chars, loss_hash, chars = now
            values = [[n], [turns_hash.hexdigest()], [loss_chars], [loss_hash.hexdigest()], [chars + edge_chars]]
            return pa.RecordBatch.from_arrays([pa.array([conv], id_type)] + [pa.array(v) for v in values], names=["conv_id", *names])

        for b in it:
            id_type = b.schema.field("conv_id").type
            done = []
            for conv, role, text, loss, chars in zip(*[b.column(c).to_pylist() for c in ("conv_id", "role", "text", "loss", "chars")], strict=True):
                if now is None or now[0] != conv:
                    if now is not None:
                        done.append(closed())
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                now[3] += len(loss)
                now[4].update(loss.encode())
                now[5] += chars
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if now is not None:
            yield closed()

    return ordered.mapInArrow(digest, schema)
