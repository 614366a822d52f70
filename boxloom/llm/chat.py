"""Chat formatting with a small compiled template language.

    {{ expr }}   {% for message in messages %}..{% endfor %}   {% if expr %}..{% elif expr %}..{% else %}..{% endif %}
    {% generation %}..{% endgeneration %}

Expressions: strings, ``message.role``, ``message.text``, ``loop.first``, ``loop.last``, ``loop.index``, ``==``, ``!=``, ``and``,
``or``, ``not``, ``+``, brackets, and the filters ``| escape``, ``| trim``, ``| upper``, ``| lower``. Nothing else can be named,
called or reached, so a template cannot touch the interpreter. A template becomes a syntax tree; constants are folded;
each node becomes a Python closure. Rendering is a stream of (text, generated) pieces, one turn at a time, so a
conversation of any length needs the memory of one turn.

Texts are escaped reversibly: a backslash goes in front of each backslash and of each control string's first character,
so no text can open or close a turn. :func:`read_back` decodes the stream piece by piece.

Defined results: rows of a conversation in the order of turn, then role, then text; nulls first, null role and text
empty; rows with a null conv_id form one conversation; equal rows stay; no rows, no conversations; other columns are
not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Marks of the production template. Fixed values of this format.
OPEN, MIDDLE, CLOSE = "<turn ", ">\n", "</turn>\n"
#: Strings that must not occur unescaped inside a text or role: their first characters get a backslash.
CONTROL = ("<turn", "</turn>", "### ", ">\n")
TEMPLATE = (
    "{% for message in messages %}<turn {{ message.role | escape }}>\n"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}</turn>\n{% endfor %}"
)

_SPECIAL = re.compile("\\\\|" + "|".join(re.escape(c[0]) + "(?=" + re.escape(c[1:]) + ")" for c in CONTROL))


def escape(s: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], s)


def unescape(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s, flags=re.S)


FILTERS: dict[str, Callable[[str], str]] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower}
NAMES = {"message.role", "message.text", "loop.first", "loop.last", "loop.index"}


class TemplateError(ValueError):
    pass


# ------------------------------------------------------------------ syntax tree: tuples (kind, ...)

_LEX = re.compile(r"""\s*(?:('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|([A-Za-z_][\w.]*)|(==|!=|[()|+]))""")


class _Expr:
    def __init__(self, src: str):
        self.toks, at = [], 0
        src = src.strip()
        while at < len(src):
            m = _LEX.match(src, at)
            if not m:
                raise TemplateError(f"cannot read {src[at:]!r}")
            self.toks.append(("s", m[1]) if m[1] else ("n", m[2]) if m[2] else ("o", m[3]))
            at = m.end()
        self.i = 0

    def take(self, *want: str) -> str | None:
        if self.i < len(self.toks) and self.toks[self.i][1] in want and self.toks[self.i][0] != "s":
            self.i += 1
            return self.toks[self.i - 1][1]
        return None

    def parse(self):
        e = self.or_()
        if self.i < len(self.toks):
            raise TemplateError(f"unexpected {self.toks[self.i][1]!r}")
        return e

    def or_(self):
        e = self.and_()
        while self.take("or"):
            e = ("or", e, self.and_())
        return e

    def and_(self):
        e = self.not_()
        while self.take("and"):
            e = ("and", e, self.not_())
        return e

    def not_(self):
        return ("not", self.not_()) if self.take("not") else self.compare()

    def compare(self):
        e = self.plus()
        while op := self.take("==", "!="):
            e = (op, e, self.plus())
        return e

    def plus(self):
        e = self.piped()
        while self.take("+"):
            e = ("+", e, self.piped())
        return e

    def piped(self):
        e = self.atom()
        while self.take("|"):
            kind, name = self.toks[self.i] if self.i < len(self.toks) else ("", "")
            if kind != "n" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.i += 1
            e = ("filter", name, e)
        return e

    def atom(self):
        if self.take("("):
            e = self.or_()
            if not self.take(")"):
                raise TemplateError("bracket not closed")
            return e
        if self.i >= len(self.toks):
            raise TemplateError("expression expected")
        kind, t = self.toks[self.i]
        self.i += 1
        if kind == "s":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1]))
        if kind == "n" and t in ("true", "false"):
            return ("const", t == "true")
        if kind == "n" and t in NAMES:
            return ("name", t)
        raise TemplateError(f"no name {t!r}")


def parse(template: str):
    """The template's syntax tree."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", template, flags=re.S)
    pos = 0

    def block(*until: str):
        nonlocal pos
        out = []
        while pos < len(parts):
            p = parts[pos]
            pos += 1
            if p.startswith("{{"):
                out.append(("out", _Expr(p[2:-2]).parse()))
            elif p.startswith("{%"):
                body = p[2:-2].strip()
                word = body.split()[0] if body else ""
                if word in until:
                    return ("seq", out), body
                if word == "for" and body.split() == ["for", "message", "in", "messages"]:
                    out.append(("for", block("endfor")[0]))
                elif word == "generation":
                    out.append(("gen", block("endgeneration")[0]))
                elif word == "if":
                    arms, test = [], body[2:]
                    while True:
                        inner, end = block("elif", "else", "endif")
                        arms.append((_Expr(test).parse(), inner))
                        if end == "endif":
                            break
                        test = end[4:] if end.startswith("elif") else "true"
                    out.append(("if", arms))
                else:
                    raise TemplateError(f"no statement {body!r}")
            elif p:
                out.append(("text", p))
        if until:
            raise TemplateError(f"{until[-1]} expected")
        return ("seq", out), ""

    return block()[0]


def fold(node):
    """Constant expressions become constants, constant branches go, neighbouring texts join."""
    kind = node[0]
    if kind == "seq":
        out = []
        for x in map(fold, node[1]):
            for y in x[1] if x[0] == "seq" else [x]:
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                elif y != ("text", ""):
                    out.append(y)
        return ("seq", out)
    if kind == "out":
        e = fold(node[1])
        return ("text", _show(e[1])) if e[0] == "const" else ("out", e)
    if kind in ("for", "gen"):
        return (kind, fold(node[1]))
    if kind == "if":
        arms = []
        for test, body in node[1]:
            test = fold(test)
            if test[0] == "const" and not test[1]:
                continue
            arms.append((test, fold(body)))
            if test[0] == "const":
                break
        if not arms:
            return ("text", "")
        return arms[0][1] if arms[0][0][0] == "const" else ("if", arms)
    if kind in ("or", "and", "+", "==", "!="):
        a, b = fold(node[1]), fold(node[2])
        if a[0] == b[0] == "const":
            return ("const", _value((kind, a, b))({}))
        return (kind, a, b)
    if kind == "not" or kind == "filter":
        e = fold(node[-1])
        new = (*node[:-1], e)
        return ("const", _value(new)({})) if e[0] == "const" else new
    return node


def _show(v) -> str:
    return v if isinstance(v, str) else str(v).lower()


def _value(node) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        v = node[1]
        return lambda env: v
    if kind == "name":
        n = node[1]
        return lambda env: env[n]
    if kind == "not":
        f = _value(node[1])
        return lambda env: not f(env)
    if kind == "filter":
        g, f = FILTERS[node[1]], _value(node[2])
        return lambda env: g(_show(f(env)))
    a, b = _value(node[1]), _value(node[2])
    return {
        "or": lambda env: a(env) or b(env),
        "and": lambda env: a(env) and b(env),
        "+": lambda env: _show(a(env)) + _show(b(env)),
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
    }[kind]


Piece = tuple[str, bool]


def _render(node, generated: bool = False) -> Callable[[dict], Iterator[Piece]]:
    kind = node[0]
    if kind == "text":
        piece = (node[1], generated)
        return lambda env: iter((piece,))
    if kind == "out":
        f = _value(node[1])
        return lambda env: iter(((_show(f(env)), generated),))
    if kind == "gen":
        return _render(node[1], True)
    if kind == "seq":
        parts = [_render(x, generated) for x in node[1]]

        def seq(env):
            for p in parts:
                yield from p(env)

        return seq
    if kind == "if":
        arms = [(_value(t), _render(b, generated)) for t, b in node[1]]

        def branch(env):
            for test, body in arms:
                if test(env):
                    yield from body(env)
                    return

        return branch
    body = _render(node[1], generated)

    def loop(env):
        turns = iter(env["messages"])
        cur, i = next(turns, None), 0
        while cur is not None:
            nxt = next(turns, None)
            role, text = cur
            i += 1
            yield from body({**env, "message.role": role, "message.text": text, "loop.first": i == 1, "loop.last": nxt is None, "loop.index": i})
            cur = nxt

    return loop


def compile_template(template: str) -> Callable[[Iterable[tuple[str, str]]], Iterator[Piece]]:
    """(role, text) turns to (text, generated) pieces."""
    run = _render(fold(parse(template)))
    return lambda messages: run({"messages": messages})


# ------------------------------------------------------------------ reading back


def _find(buf: str, mark: str, at: int) -> int:
    """The next ``mark`` that is not escaped; -1 if there is none yet."""
    i = buf.find(mark, at)
    while i >= 0:
        k = i
        while k > at and buf[k - 1] == "\\":
            k -= 1
        if (i - k) % 2 == 0:
            return i
        i = buf.find(mark, i + 1)
    return -1


def read_back(pieces: Iterable[Piece]) -> Iterator[tuple[str, str, str]]:
    """(role, text, text under the loss mask) of each turn, decoded from the formatted output alone."""
    buf, mask = "", ""
    for text, generated in pieces:
        buf += text
        mask += ("1" if generated else "0") * len(text)
        while text.endswith(CLOSE):
            if not buf.startswith(OPEN):
                raise ValueError("a turn does not open")
            a = _find(buf, MIDDLE, len(OPEN))
            b = _find(buf, CLOSE, a + len(MIDDLE)) if a >= 0 else -1
            if b < 0:
                break
            lo, hi = a + len(MIDDLE), b
            spans = [buf[m.start() : m.end()] for m in re.finditer("1+", mask[: b + len(CLOSE)])]
            yield unescape(buf[len(OPEN) : a]), unescape(buf[lo:hi]), "".join(map(unescape, spans))
            buf, mask = buf[b + len(CLOSE) :], mask[b + len(CLOSE) :]
            if not buf:
                break
    if buf:
        raise ValueError("the last turn is not closed")


# ------------------------------------------------------------------ Spark


def _conversations(batches, most: int = 1 << 16):
    """(conv_id, turns) in the order of the rows, without holding a conversation."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    cur = next(rows, None)
    while cur is not None:
        conv = cur[0]

        def turns():
            nonlocal cur
            while cur is not None and cur[0] == conv:
                row, cur = cur, next(rows, None)
                yield row[2] or "", row[3] or ""

        mine = turns()
        yield conv, mine
        for _ in mine:
            pass


def _ordered(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def format_turns(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """The formatted output: conv_id, piece (its order), text, generated. Joined in order the pieces are the conversation."""

    def run(batches):
        render, out = compile_template(template), []
        for conv, turns in _conversations(batches):
            for i, (text, gen) in enumerate(render(turns)):
                out.append((conv, i, text, gen))
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "piece", "text", "generated"), r, strict=True)) for r in out], schema=schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("conv_id", "piece", "text", "generated"), r, strict=True)) for r in out], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("text", pa.string()), ("generated", pa.bool_())])
    return _ordered(conversations).mapInArrow(run, "conv_id long, piece long, text string, generated boolean")


def format_digests(conversations: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Format, read the output back, and return digests of what was read: one row per conversation."""
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        render, out = compile_template(template), []
        for conv, turns in _conversations(batches):
            size = 0

            def counted():
                nonlocal size
                for piece in render(turns):
                    size += len(piece[0])
                    yield piece

            n = loss = 0
            all_turns, loss_text = hashlib.sha256(), hashlib.sha256()
            for role, text, masked in read_back(counted()):
                n += 1
                loss += len(masked)
                all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                loss_text.update(masked.encode("utf-8", "surrogatepass"))
            out.append((conv, n, all_turns.hexdigest(), loss, loss_text.hexdigest(), size))
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _ordered(conversations).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
