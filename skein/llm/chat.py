"""Chat formatting: a template compiler and the formatting of conversations.

A template is parsed into a syntax tree, constant parts of it are folded, and each node becomes a Python closure; a
rendering is a generator of (text, whether a generation marker encloses it). The language has {{ expression }}, {# #},
{% if %} {% elif %} {% else %} {% endif %}, {% for x in xs %} {% endfor %}, {% set x = e %} and {% generation %}
{% endgeneration %}. It is sandboxed: values are strings, numbers, booleans, none, lists and dicts; a name, a filter or
an attribute is looked up in tables of the template's own, never by getattr, and nothing can be called; numbers alone are
multiplied, no value outgrows ``MOST_CHARS`` or ``MOST_BITS``, and whatever fails is a TemplateError. A hyphen inside a
tag's brackets takes away the white space beside it.

A loop takes its list item by item, so messages may be an iterator: a conversation is rendered turn by turn and no task
holds more than a turn, whichever share of the rows one conversation has. Read-back takes the pieces the same way.

Control strings inside texts are escaped so that none is left, and read back to the same text. Null texts and null roles
are empty. Turns stand in order of turn (nulls first), then role, then text, so that rows that repeat are turns of their
own and reruns agree. Rows whose id is null are one conversation. An empty table has no conversations. Columns besides
the four that the caller names are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import operator
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


class TemplateError(ValueError):
    pass


# Syntax tree


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
class Apply:
    """A filter or an operator by name, with its operands."""

    name: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Sequence:
    parts: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: object
    otherwise: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: object


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: object


MOST_CHARS, MOST_BITS = 1 << 28, 4096


def text_of(value: object) -> str:
    return "" if value is None else {True: "true", False: "false"}[value] if isinstance(value, bool) else str(value)


def _item(of: object, key: object) -> object:
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, str)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


def _numbers(*values: object) -> tuple:
    if not all(isinstance(v, (int, float)) for v in values):
        raise TemplateError("only numbers can be multiplied or divided")
    return values


OPERATORS: dict[str, Callable] = {
    "==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge,
    "+": operator.add, "-": operator.sub, "*": lambda a, b: operator.mul(*_numbers(a, b)), "%": lambda a, b: operator.mod(*_numbers(a, b)), "~": lambda a, b: text_of(a) + text_of(b),
    "in": lambda a, b: a in b, "not in": lambda a, b: a not in b, "not": operator.not_, "item": _item,
}
FILTERS: dict[str, Callable] = {
    "trim": lambda s: text_of(s).strip(), "upper": lambda s: text_of(s).upper(), "lower": lambda s: text_of(s).lower(), "length": len, "string": text_of,
    "default": lambda s, other: other if s is None else s, "replace": lambda s, a, b: text_of(s).replace(a, b), "first": lambda s: s[0] if s else None, "last": lambda s: s[-1] if s else None,
}

# Parser

_TAG = re.compile(r"(?:\{\{(?P<ol>-?)(?P<output>.*?)(?P<or>-?)\}\}|\{%(?P<tl>-?)(?P<tag>.*?)(?P<tr>-?)%\}|\{#(?P<cl>-?).*?(?P<cr>-?)#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<number>\d+)|(?P<text>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)|(?P<sign>==|!=|<=|>=|[-+*%~<>()\[\].,|=]))""")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_LEVELS = (("==", "!=", "<", "<=", ">", ">=", "in", "not in"), ("~",), ("+", "-"), ("*", "%"))


class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.tokens, at, self.filters = [], 0, filters
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" else None

    def take(self, *wanted: str) -> str | None:
        if self.peek() in wanted and wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, what: str) -> None:
        if not self.take(what):
            raise TemplateError(f"{what!r} is missing")

    def name(self) -> str:
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
        if kind != "name":
            raise TemplateError("a name is missing")
        self.at += 1
        return value

    def end(self, value):
        if self.at < len(self.tokens):
            raise TemplateError(f"too much: {self.tokens[self.at][1]!r}")
        return value

    def expression(self):
        left = self.conjunction()
        while self.take("or"):
            left = Apply("or", (left, self.conjunction()))
        return left

    def conjunction(self):
        left = self.negation()
        while self.take("and"):
            left = Apply("and", (left, self.negation()))
        return left

    def negation(self):
        return Apply("not", (self.negation(),)) if self.take("not") else self.binary(0)

    def binary(self, level: int):
        if level == len(_LEVELS):
            return self.filtered()
        left = self.binary(level + 1)
        while True:
            sign = self.take(*_LEVELS[level])
            if not sign and level == 0 and self.peek() == "not" and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1][1] == "in":
                self.at, sign = self.at + 2, "not in"
            if not sign:
                return left
            left = Apply(sign, (left, self.binary(level + 1)))

    def filtered(self):
        value = self.postfix()
        while self.take("|"):
            name, args = self.name(), [value]
            if name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.expression())
                    if not self.take(",") and self.peek() != ")":
                        raise TemplateError("')' is missing")
            value = Apply(f"|{name}", tuple(args))
        return value

    def postfix(self):
        value = self.primary()
        while sign := self.take(".", "["):
            if sign == ".":
                value = Apply("item", (value, Const(self.name())))
            else:
                value = Apply("item", (value, self.expression()))
                self.need("]")
        return value

    def primary(self):
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "number":
            return Const(int(value))
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return Const(fixed[value.lower()]) if value.lower() in fixed else Name(value)
        if value == "(":
            inner = self.expression()
            self.need(")")
            return inner
        if value == "-":
            return Apply("-", (Const(0), self.postfix()))
        raise TemplateError(f"unexpected {value!r}")


class _Parser:
    def __init__(self, source: str, filters: dict[str, Callable]):
        self.filters, self.parts, at = filters, [], 0
        bare = False  # whether the white space that follows goes
        for m in _TAG.finditer(source):
            text = source[at : m.start()]
            text = text.lstrip() if bare else text
            if text := text.rstrip() if m["ol"] or m["tl"] or m["cl"] else text:
                self.parts.append(("text", text))
            if m["output"] is not None:
                self.parts.append(("output", m["output"]))
            elif m["tag"] is not None:
                self.parts.append(("tag", m["tag"].strip()))
            at, bare = m.end(), bool(m["or"] or m["tr"] or m["cr"])
        if text := source[at:].lstrip() if bare else source[at:]:
            self.parts.append(("text", text))
        self.at = 0

    def body(self, *ends: str) -> tuple[Sequence, str]:
        """Parts up to a tag whose first word is among ends, and that tag."""
        out = []
        while self.at < len(self.parts):
            kind, value = self.parts[self.at]
            self.at += 1
            if kind == "text":
                out.append(Output(Const(value)))
                continue
            if kind == "output":
                e = _Expression(value, self.filters)
                out.append(Output(e.end(e.expression())))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return Sequence(tuple(out)), value
            out.append(self.tag(word, rest))
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return Sequence(tuple(out)), ""

    def tag(self, word: str, rest: str):
        e = _Expression(rest, self.filters)
        if word == "if":
            return self.branches(e)
        if word == "for":
            name = e.name()
            e.need("in")
            over = e.end(e.expression())
            return For(name, over, self.body("endfor")[0])
        if word == "set":
            name = e.name()
            e.need("=")
            return Set(name, e.end(e.expression()))
        if word == "generation":
            return Generation(self.body("endgeneration")[0])
        raise TemplateError(f"no tag {word!r}")

    def branches(self, e: _Expression):
        test = e.end(e.expression())
        then, end = self.body("elif", "else", "endif")
        if end.startswith("elif"):
            return If(test, then, self.branches(_Expression(end[4:], self.filters)))
        return If(test, then, self.body("endif")[0] if end == "else" else Sequence(()))


def parse(source: str, filters: dict[str, Callable] | None = None):
    return _Parser(source, FILTERS | (filters or {})).body()[0]


# Constant folding


def fold(node, filters: dict[str, Callable]):
    """The same tree with all that is constant evaluated: operators and filters of constants, tests of branches, and
    neighbouring constant outputs as one."""
    same = lambda n: fold(n, filters)
    if isinstance(node, Apply):
        args = tuple(map(same, node.args))
        if all(isinstance(a, Const) for a in args):
            return Const(_applied(node.name, filters)(*(a.value for a in args)))
        return Apply(node.name, args)
    if isinstance(node, Output):
        value = same(node.value)
        return Output(Const(text_of(value.value)) if isinstance(value, Const) else value)
    if isinstance(node, Sequence):
        out: list = []
        for part in map(same, node.parts):
            for p in part.parts if isinstance(part, Sequence) else (part,):
                if isinstance(p, Output) and isinstance(p.value, Const):
                    if not p.value.value:
                        continue
                    if out and isinstance(out[-1], Output) and isinstance(out[-1].value, Const):
                        p = Output(Const(out.pop().value.value + p.value.value))
                out.append(p)
        return Sequence(tuple(out))
    if isinstance(node, If):
        test = same(node.test)
        if isinstance(test, Const):
            return same(node.then if test.value else node.otherwise)
        return If(test, same(node.then), same(node.otherwise))
    if isinstance(node, For):
        return For(node.name, same(node.over), same(node.body))
    if isinstance(node, Set):
        return Set(node.name, same(node.value))
    if isinstance(node, Generation):
        return Generation(same(node.body))
    return node


def _applied(name: str, filters: dict[str, Callable]) -> Callable:
    if name == "and":
        return lambda a, b: a and b
    if name == "or":
        return lambda a, b: a or b
    own = filters[name[1:]] if name[0] == "|" else OPERATORS[name]

    def safe(*args: object) -> object:
        try:
            value = own(*args)
        except TemplateError:
            raise
        except Exception as e:
            raise TemplateError(f"{name}: {e}") from e
        if isinstance(value, str) and len(value) > MOST_CHARS or isinstance(value, int) and value.bit_length() > MOST_BITS:
            raise TemplateError(f"{name}: the result is too long")
        return value

    return safe


# Closures


def _value(node, filters: dict[str, Callable]) -> Callable[[dict], object]:
    if isinstance(node, Const):
        return lambda env, v=node.value: v
    if isinstance(node, Name):
        return lambda env, n=node.name: env.get(n)
    args = [_value(a, filters) for a in node.args]
    if node.name in ("and", "or"):
        left, right = args
        return (lambda env: left(env) and right(env)) if node.name == "and" else (lambda env: left(env) or right(env))
    f = _applied(node.name, filters)
    if len(args) == 1:
        return lambda env, a=args[0]: f(a(env))
    if len(args) == 2:
        return lambda env, a=args[0], b=args[1]: f(a(env), b(env))
    return lambda env: f(*(a(env) for a in args))


Piece = tuple[str, bool]


def _render(node, marked: bool, filters: dict[str, Callable]) -> Callable[[dict], Iterator[Piece]]:
    if isinstance(node, Output):
        value = _value(node.value, filters)

        def output(env: dict) -> Iterator[Piece]:
            if s := text_of(value(env)):
                yield s, marked

        return output
    if isinstance(node, Sequence):
        parts = [_render(p, marked, filters) for p in node.parts]

        def sequence(env: dict) -> Iterator[Piece]:
            for part in parts:
                yield from part(env)

        return parts[0] if len(parts) == 1 else sequence
    if isinstance(node, If):
        test, then, otherwise = _value(node.test, filters), _render(node.then, marked, filters), _render(node.otherwise, marked, filters)
        return lambda env: then(env) if test(env) else otherwise(env)
    if isinstance(node, Generation):
        return _render(node.body, True, filters)
    if isinstance(node, Set):
        value = _value(node.value, filters)

        def assign(env: dict) -> Iterator[Piece]:
            env[node.name] = value(env)
            return iter(())

        return assign
    over, body = _value(node.over, filters), _render(node.body, marked, filters)

    def loop(env: dict) -> Iterator[Piece]:
        for k, item in enumerate(over(env) or ()):
            yield from body(env | {node.name: item, "loop": {"index": k + 1, "index0": k, "first": k == 0}})

    return loop


def compile_template(source: str, filters: dict[str, Callable] | None = None) -> Callable[[dict], Iterator[Piece]]:
    known = FILTERS | (filters or {})
    return _render(fold(parse(source, filters), known), False, known)


# Conversations

#: What marks turns. None of them may stand in an escaped text.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "[END]")
TEMPLATE = """{% for m in messages %}{% if m.role == 'user' %}{{ '[INST] ' ~ m.text|escape ~ ' [/INST]' }}{% elif m.role == 'assistant' %}{{ '<s>' }}{% generation %}{{ m.text|escape }}{% endgeneration %}{{ '</s>' }}{% else %}{{ '[ROLE]' ~ m.role|escape ~ '[/ROLE]' ~ m.text|escape ~ '[END]' }}{% endif %}{% endfor %}"""

_CONTROL = re.compile("|".join([re.escape("\\"), *map(re.escape, CONTROLS)]))
_CODES = {"\\": "0", "[": "1", "<": "2"}
_SIGNS = {code: sign for sign, code in _CODES.items()}


def escape(text: str) -> str:
    """text without any control string: a backslash and the first character of a control string become a backslash and
    a digit."""
    return _CONTROL.sub(lambda m: f"\\{_CODES[m[0][0]]}{m[0][1:]}", text)


def unescape(text: str) -> str:
    return re.sub(r"\\([012])", lambda m: _SIGNS[m[1]], text)


@lru_cache(8)
def chat_template(source: str) -> Callable[[dict], Iterator[Piece]]:
    return compile_template(source, {"escape": escape})


PIECES_SQL = "conv_id long, seq long, formatted string, loss array<struct<start:int,stop:int>>"
_PIECES = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("formatted", pa.string()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())])))])


def _conversations(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple[object, Iterator[tuple]]]:
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True))
    return itertools.groupby(rows, key=lambda row: row[0])


def _batched(rows: Iterator[dict], schema: pa.Schema, size: Callable[[dict], int], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += size(row)
        if total >= most:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def format_conversations(df: DataFrame, template: str = TEMPLATE, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Each conversation as pieces, one for each turn (or more text before the next): conv_id, seq from 0, formatted,
    and the spans of it (in code points) that generation markers enclose. Pieces of a conversation stand in order in one
    partition; joined by seq they are its whole text."""

    def pieces(conv_id: int | None, turns: Iterator[tuple]) -> Iterator[dict]:
        pulled, held, spans, place, seq = [0], [], [], 0, 0

        def messages() -> Iterator[dict]:
            for _, role, text in turns:
                pulled[0] += 1
                yield {"role": role or "", "text": text or ""}

        seen = 0
        for text, marked in chat_template(template)({"messages": messages()}):
            if pulled[0] > max(seen, 1) and held:
                yield {"conv_id": conv_id, "seq": seq, "formatted": "".join(held), "loss": spans}
                held, spans, place, seq = [], [], 0, seq + 1
            seen = pulled[0]
            if marked:
                spans.append({"start": place, "stop": place + len(text)})
            held.append(text)
            place += len(text)
        yield {"conv_id": conv_id, "seq": seq, "formatted": "".join(held), "loss": spans}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (p for conv_id, turns in _conversations(batches, ("conv_id", "role", "text")) for p in pieces(conv_id, turns))
        return _batched(rows, _PIECES, lambda p: len(p["formatted"]) + 100)

    columns = df.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    ordered = columns.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, PIECES_SQL)


_OPEN = {"[INST] ": ("user", " [/INST]"), "<s>": ("assistant", "</s>")}


def turns_of(pieces: Iterator[str]) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn, read from the formatted text."""
    held = ""
    for piece in itertools.chain(pieces, [None]):
        held += piece or ""
        while held:
            for begin, (role, end) in _OPEN.items():
                if held.startswith(begin) and (at := held.find(end, len(begin))) >= 0:
                    yield role, unescape(held[len(begin) : at])
                    held = held[at + len(end) :]
                    break
            else:
                if held.startswith("[ROLE]") and (at := held.find("[END]")) >= 0:
                    role, _, text = held[6:at].partition("[/ROLE]")
                    yield unescape(role), unescape(text)
                    held = held[at + 5 :]
                    continue
                if piece is None:
                    raise ValueError("the formatted text is cut off")
                break


BACK_SQL = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_BACK = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(pieces: DataFrame, ordered: bool = True) -> DataFrame:
    """Digests of the turns and of the text under the loss mask, as read from pieces. ordered: the pieces come straight
    from format_conversations; else they are brought together and put in order first."""

    def one(conv_id: int | None, rows: Iterator[tuple]) -> dict:
        turns, loss, count, chars, total = hashlib.sha256(), hashlib.sha256(), 0, 0, 0

        def texts() -> Iterator[str]:
            nonlocal chars, total
            for _, formatted, spans in rows:
                total += len(formatted)
                for span in spans:
                    own = unescape(formatted[span["start"] : span["stop"]])
                    chars += len(own)
                    loss.update(own.encode())
                yield formatted

        for role, text in turns_of(texts()):
            turns.update(f"{role}\n{text}\n".encode())
            count += 1
        return {"conv_id": conv_id, "n_turns": count, "turns_sha256": turns.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": total}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _batched((one(c, rows) for c, rows in _conversations(batches, ("conv_id", "formatted", "loss"))), _BACK, lambda _: 300)

    rows = pieces if ordered else pieces.repartition("conv_id").sortWithinPartitions("conv_id", "seq")
    return rows.mapInArrow(run, BACK_SQL)
