"""Chat formatting by a compiled template.

A small, sandboxed template language is parsed into a syntax tree, constants are folded, and the tree becomes nested
Python closures. Rendering gives the text and the code-point ranges of its generation blocks, the loss mask.

The language has text, {{ expression }}, {% for x in list %}, {% if %}, {% elif %}, {% else %}, and {% generation %},
with endfor, endif and endgeneration. Expressions have literals, names, dotted fields, ==, !=, and, or, not, +,
parentheses and filters. Fields are looked up in mappings only and nothing can be called, so that a template reaches
nothing but its input.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from revlens.llm.common import table

_CONTROL = {"\\": "\\", "<": "l", "\n": "n"}
_PLAIN = {v: k for k, v in _CONTROL.items()}


def escape(text: str) -> str:
    """No control string contains a text that is escaped: every < is written with a backslash instead."""
    return text.replace("\\", "\\\\").replace("<", "\\l")


def escape_line(text: str) -> str:
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _PLAIN[m[1]], text, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}

DEFAULT_TEMPLATE = (
    "{% for m in messages %}<turn>{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</turn>\n{% endfor %}"
)
TURN = re.compile(r"<turn>([^<\n]*)\n([^<]*)</turn>\n")


class TemplateError(ValueError):
    pass


@dataclass
class Const:
    value: object


@dataclass
class Name:
    path: tuple[str, ...]


@dataclass
class Op:
    kind: str
    args: list


@dataclass
class Filter:
    name: str
    of: object


@dataclass
class Emit:
    of: object


@dataclass
class For:
    name: str
    of: object
    body: list


@dataclass
class If:
    arms: list = field(default_factory=list)  # of (condition, body)


@dataclass
class Generation:
    body: list


_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_LEX = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z_]\w*)|(==|!=|[().|+]))", re.S)


class _Expression:
    def __init__(self, source: str) -> None:
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m:
                raise TemplateError(f"bad expression: {source[at:]!r}")
            kind = m.lastindex
            self.tokens.append((kind, m[kind]))
            at = m.end()
        self.at = 0

    def take(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] in (3, 4) and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def word(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == 3:
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def whole(self) -> object:
        found = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return found

    def chain(self, words: tuple[str, ...], below: Callable[[], object]) -> object:
        left = below()
        while kind := self.take(*words):
            left = Op(kind, [left, below()])
        return left

    def either(self) -> object:
        return self.chain(("or",), lambda: self.chain(("and",), self.negated))

    def negated(self) -> object:
        return Op("not", [self.negated()]) if self.take("not") else self.chain(("==", "!="), lambda: self.chain(("+",), self.filtered))

    def filtered(self) -> object:
        found = self.atom()
        while self.take("|"):
            name = self.word()
            if name not in FILTERS:
                raise TemplateError(f"no such filter: {name}")
            found = Filter(name, found)
        return found

    def atom(self) -> object:
        if self.take("("):
            found = self.either()
            if not self.take(")"):
                raise TemplateError("a ) is missing")
            return found
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, value = self.tokens[self.at]
        if kind == 1:
            self.at += 1
            return Const(re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == 2:
            self.at += 1
            return Const(int(value))
        path = [self.word()]
        if path[0] in ("true", "false"):
            return Const(path[0] == "true")
        while self.take("."):
            path.append(self.word())
        return Name(tuple(path))


def parse(source: str) -> list:
    """The syntax tree of a template."""
    parts = [p for p in _TAGS.split(source) if p]
    at = 0

    def body(*ends: str) -> tuple[list, str, str]:
        nonlocal at
        nodes: list = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(Emit(_Expression(part[2:-2]).whole()))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return nodes, word, rest
                if word == "for":
                    m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
                    if not m:
                        raise TemplateError(f"bad for: {rest!r}")
                    nodes.append(For(m[1], _Expression(m[2]).whole(), body("endfor")[0]))
                elif word == "if":
                    node, test, end = If(), rest, ""
                    while end != "endif":
                        condition = Const(True) if end == "else" else _Expression(test).whole()
                        inner, end, test = body("endif") if end == "else" else body("elif", "else", "endif")
                        node.arms.append((condition, inner))
                    nodes.append(node)
                elif word == "generation":
                    nodes.append(Generation(body("endgeneration")[0]))
                else:
                    raise TemplateError(f"unexpected tag: {word}")
            else:
                nodes.append(Emit(Const(part)))
        if ends:
            raise TemplateError(f"{' or '.join(ends)} is missing")
        return nodes, "", ""

    return body()[0]


def _apply(kind: str, a: object, b: object = None) -> object:
    if kind == "+":
        return a + b if isinstance(a, int) and isinstance(b, int) else f"{a}{b}"
    return {"==": lambda: a == b, "!=": lambda: a != b, "and": lambda: a and b, "or": lambda: a or b, "not": lambda: not a}[kind]()


def fold(node: object) -> object:
    """The same tree with constant expressions computed, dead branches cut and neighbouring texts joined."""
    if isinstance(node, list):
        out: list = []
        for x in map(fold, node):
            for y in x if isinstance(x, list) else [x]:
                if isinstance(y, Emit) and isinstance(y.of, Const) and out and isinstance(out[-1], Emit) and isinstance(out[-1].of, Const):
                    out[-1] = Emit(Const(f"{out[-1].of.value}{y.of.value}"))
                else:
                    out.append(y)
        return out
    if isinstance(node, Op):
        args = [fold(a) for a in node.args]
        return Const(_apply(node.kind, *[a.value for a in args])) if all(isinstance(a, Const) for a in args) else Op(node.kind, args)
    if isinstance(node, Filter):
        of = fold(node.of)
        return Const(FILTERS[node.name](str(of.value))) if isinstance(of, Const) else Filter(node.name, of)
    if isinstance(node, Emit):
        return Emit(fold(node.of))
    if isinstance(node, For):
        return For(node.name, fold(node.of), fold(node.body))
    if isinstance(node, Generation):
        return Generation(fold(node.body))
    if isinstance(node, If):
        arms = []
        for condition, inner in node.arms:
            condition = fold(condition)
            if isinstance(condition, Const) and not condition.value:
                continue
            if isinstance(condition, Const) and not arms:
                return fold(inner)
            arms.append((condition, fold(inner)))
            if isinstance(condition, Const):
                break
        return If(arms) if arms else []
    return node


class _Out:
    def __init__(self) -> None:
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def add(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _value(node: object) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        first, *rest = node.path

        def look(env: dict) -> object:
            x = env.get(first, "")
            for k in rest:
                x = x.get(k, "") if isinstance(x, dict) else ""
            return x

        return look
    if isinstance(node, Filter):
        f, of = FILTERS[node.name], _value(node.of)
        return lambda env: f(str(of(env)))
    args = [_value(a) for a in node.args]
    if node.kind == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.kind == "or":
        return lambda env: args[0](env) or args[1](env)
    return lambda env: _apply(node.kind, *[a(env) for a in args])


def _run(nodes: list) -> Callable[[dict, _Out], None]:
    steps = [_step(n) for n in nodes]

    def run(env: dict, out: _Out) -> None:
        for s in steps:
            s(env, out)

    return run


def _step(node: object) -> Callable[[dict, _Out], None]:
    if isinstance(node, Emit):
        if isinstance(node.of, Const):
            text = str(node.of.value)
            return lambda env, out: out.add(text)
        value = _value(node.of)
        return lambda env, out: out.add(str(value(env)))
    if isinstance(node, For):
        items, inner = _value(node.of), _run(node.body)

        def loop(env: dict, out: _Out) -> None:
            every = items(env) or []
            for i, x in enumerate(every):
                inner(env | {node.name: x, "loop": {"index0": i, "first": i == 0, "last": i == len(every) - 1}}, out)

        return loop
    if isinstance(node, Generation):
        inner = _run(node.body)

        def mark(env: dict, out: _Out) -> None:
            start = out.size
            inner(env, out)
            out.spans.append((start, out.size))

        return mark
    arms = [(_value(c), _run(b)) for c, b in node.arms]

    def choose(env: dict, out: _Out) -> None:
        for condition, inner in arms:
            if condition(env):
                return inner(env, out)

    return choose


def compile_template(source: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """A function from messages, each with role and text, to the text and its generation ranges."""
    run = _run(fold(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        run({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


def format_chats(conversations: DataFrame, template: str = DEFAULT_TEMPLATE) -> DataFrame:
    """conv_id, formatted and loss_spans (code-point ranges, end exclusive) for each conversation.

    Turns stand in order of turn, ties in order of role and text; null turns come first. Null roles and texts count as
    empty. Rows with a null conv_id form one conversation. Repeated rows are turns of their own. A conversation is one
    output text, so that it has to fit in a task's memory. An empty table gives an empty result. Other columns are
    ignored, whatever their names.
    """
    render = compile_template(template)  # fails here, not on the executors, if the template is wrong

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        for batch in batches:
            texts, spans = [], []
            for turns in batch.column(1).to_pylist():
                text, marks = render(turns)
                texts.append(text)
                spans.append([{"start": a, "end": b} for a, b in marks])
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(spans, kind)], ["conv_id", "formatted", "loss_spans"])

    del render
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turns = F.sort_array(F.collect_list(F.struct(F.col("turn").cast("long").alias("turn"), "role", "text")))
    grouped = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role"), text("text")).groupBy("conv_id").agg(turns.alias("turns"))
    return grouped.mapInArrow(rows, "conv_id long, formatted string, loss_spans array<struct<start:bigint,end:bigint>>")


def read_back(formatted: str, spans: list[dict]) -> tuple[list[tuple[str, str]], str]:
    """Turns, and the text under the loss mask, of a text in the default template."""
    turns = [(unescape(m[1]), unescape(m[2])) for m in TURN.finditer(formatted)]
    return turns, "".join(unescape(formatted[s["start"] : s["end"]]) for s in spans)


def chat_digest(formatted: DataFrame) -> DataFrame:
    """Counts and digests of each formatted conversation, from its text and spans alone."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hexed = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for conv, text, spans in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                turns, loss = read_back(text, spans)
                found = (conv, len(turns), hexed("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), hexed(loss), len(text))
                for column, x in zip(out, found, strict=True):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)

    return formatted.mapInArrow(rows, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "\\### Assistant: </turn> ok"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    return chat_digest(format_chats(rows))


_ESCAPED = "replace(replace({}, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l')"
ORACLE = {
    "op4_chat_format": f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, 0, 'user', chr(92) || '### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', chr(92) || '### Assistant: </turn> ok')
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_ESCAPED.format("text")}) + length(replace({_ESCAPED.format("role")}, chr(10), chr(92) || 'n')) + 15)::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""
}
QUERIES = {"op4_chat_format": op4_chat_format}
