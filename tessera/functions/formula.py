"""The calculated-field language: text to a tree, tree to a column or to JSON and back.

    comparison := sum [(> | < | >= | <= | == | !=) sum]        one comparison, not a chain
    sum        := product {(+ | -) product}
    product    := unary {(* | / | %) unary}
    unary      := (+ | -) unary | primary
    primary    := number (a leading point will do) | 'text' | "text" | true | false | null | name(args) | name.name... | (comparison)

Arithmetic reads null and text that is no number as 0; + joins texts if either side is one; comparison is numeric;
Round goes to even; division by zero is an error.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .semantics import truthy

NUMBER = T.DecimalType(28, 10)
TOKEN = re.compile(r"""\s*(?:(?P<number>\d+(?:\.\d+)?|\.\d+)|(?P<name>[^\W\d]\w*)|(?P<text>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<sign>>=|<=|==|!=|[-+*/%<>(),.]))""")
BINDING = {">": 1, "<": 1, ">=": 1, "<=": 1, "==": 1, "!=": 1, "+": 2, "-": 2, "*": 3, "/": 3, "%": 3}
WORDS = {"true": True, "false": False, "null": None}


@dataclass(frozen=True)
class Node:
    """kind: literal, path, unary, binary or call; what: the value, the names, the sign or the function."""

    kind: str
    what: object
    args: tuple[Node, ...] = ()

    def to_json(self) -> str:
        return json.dumps(self._plain())

    def _plain(self) -> list:
        return [self.kind, list(self.what) if isinstance(self.what, tuple) else self.what, [a._plain() for a in self.args]]

    @staticmethod
    def from_json(text: str) -> Node:
        build = lambda p: Node(p[0], tuple(p[1]) if isinstance(p[1], list) else p[1], tuple(build(a) for a in p[2]))
        return build(json.loads(text))

    def names(self) -> set[str]:
        own = {".".join(self.what)} if self.kind == "path" else set()
        return own.union(*(a.names() for a in self.args))


class Reader:
    def __init__(self, text: str):
        self.parts, at = [], 0
        text = text.rstrip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise ValueError(f"unexpected {text[at:].strip()[:10]!r}")
            self.parts.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.parts.append(("end", ""))
        self.at = 0

    def take(self, sign: str | None = None) -> tuple[str, str]:
        got = self.parts[self.at]
        if sign is not None and got != ("sign", sign):
            raise ValueError(f"expected {sign!r}, found {got[1]!r}")
        self.at += 1
        return got

    def sees(self, sign: str) -> bool:
        return self.parts[self.at] == ("sign", sign)

    def expression(self, least: int = 1) -> Node:
        left = self.prefix()
        while True:
            kind, sign = self.parts[self.at]
            power = BINDING.get(sign, 0) if kind == "sign" else 0
            if power < least:
                return left
            self.take()
            left = Node("binary", sign, (left, self.expression(power + 1)))
            if power == 1:
                least = 2  # a second comparison may not follow

    def prefix(self) -> Node:
        kind, text = self.take()
        if kind == "number":
            return Node("literal", text if "." in text else int(text)) if "." not in text else Node("literal", float(text))
        if kind == "text":
            return Node("literal", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), text[1:-1]))
        if kind == "sign" and text in "+-":
            return Node("unary", text, (self.prefix(),))
        if kind == "sign" and text == "(":
            inner = self.expression()
            self.take(")")
            return inner
        if kind != "name":
            raise ValueError(f"unexpected {text or 'end'!r}")
        if text.lower() in WORDS:
            return Node("literal", WORDS[text.lower()])
        if self.sees("("):
            self.take()
            args: list[Node] = []
            while not self.sees(")"):
                if args:
                    self.take(",")
                args.append(self.expression())
            self.take(")")
            return Node("call", text, tuple(args))
        path = [text]
        while self.sees("."):
            self.take()
            path.append(self.take()[1])
        return Node("path", tuple(path))


def parse(text: str) -> Node:
    r = Reader(text)
    out = r.expression()
    if r.parts[r.at][0] != "end":
        raise ValueError(f"unexpected {r.parts[r.at][1]!r}")
    return out


Compiled = tuple[Column, T.DataType]


class Compiler:
    """Trees to columns over one DataFrame. ``paths`` gives columns for dotted names and lookups, joined beforehand."""

    def __init__(self, df: DataFrame, paths: Mapping[str, Column] = {}):
        self.kinds = {f.name.lower(): (f.name, f.dataType) for f in df.schema.fields}
        self.paths = {k.lower(): v for k, v in paths.items()}

    def number(self, n: Node) -> Column:
        c, kind = self.compile(n)
        if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            return F.unix_date(c.cast("date")).cast(NUMBER)
        if isinstance(kind, T.StringType):
            return F.coalesce(c.try_cast(NUMBER), F.lit(0).cast(NUMBER))
        return F.coalesce(c.cast(NUMBER), F.lit(0).cast(NUMBER))

    def text(self, n: Node) -> Column:
        c, kind = self.compile(n)
        shown = c.cast("string")
        if kind == NUMBER:  # without the zeros of its scale
            shown = F.regexp_replace(shown, r"\.?0+$", "")
        return F.coalesce(shown, F.lit(""))

    def compile(self, n: Node) -> Compiled:
        return getattr(self, f"_{n.kind}")(n)

    def _literal(self, n: Node) -> Compiled:
        kind = {bool: T.BooleanType(), int: NUMBER, float: NUMBER, str: T.StringType(), type(None): T.StringType()}[type(n.what)]
        return F.lit(str(n.what) if isinstance(n.what, float) else n.what).cast(kind), kind

    def _path(self, n: Node) -> Compiled:
        name = ".".join(n.what)
        if name.lower() in self.paths:
            return self.paths[name.lower()], T.StringType()
        if name.lower() not in self.kinds:
            raise ValueError(f"unknown field {name!r}")
        real, kind = self.kinds[name.lower()]
        return F.col(f"`{real}`"), kind

    def _unary(self, n: Node) -> Compiled:
        c = self.number(n.args[0])
        return (-c if n.what == "-" else c), NUMBER

    def _binary(self, n: Node) -> Compiled:
        a, b = n.args
        if n.what == "+" and any(isinstance(self.compile(x)[1], T.StringType) for x in n.args):
            return F.concat(self.text(a), self.text(b)), T.StringType()
        x, y = self.number(a), self.number(b)
        made: dict[str, Callable[[], Column]] = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: x % y}
        if n.what in made:
            return made[n.what]().cast(NUMBER), NUMBER
        return {">": x > y, "<": x < y, ">=": x >= y, "<=": x <= y, "==": x == y, "!=": x != y}[n.what], T.BooleanType()

    def _call(self, n: Node) -> Compiled:
        name, args = n.what.lower(), n.args
        wrong = ValueError(f"wrong number of arguments for {n.what}")
        if name == "round":
            if not 1 <= len(args) <= 2 or len(args) == 2 and not isinstance(args[1].what, int):
                raise wrong
            return F.bround(self.number(args[0]), args[1].what if len(args) == 2 else 0).cast(NUMBER), NUMBER
        if name in ("min", "max"):
            if len(args) < 2:
                raise wrong
            return {"min": F.least, "max": F.greatest}[name](*map(self.number, args)), NUMBER
        if name == "abs":
            if len(args) != 1:
                raise wrong
            return F.abs(self.number(args[0])), NUMBER
        if name == "if":
            if len(args) != 3:
                raise wrong
            (c, ck), (a, ak), (b, bk) = map(self.compile, args)
            if type(ak) is not type(bk):
                a, b, ak = a.cast("string"), b.cast("string"), T.StringType()
            return F.when(truthy(c, ck), a).otherwise(b), ak
        if name in ("relatedlookup", "querylookup", "lookupmultilevel"):
            given = f"{name}({','.join(str('.'.join(a.what) if a.kind == 'path' else a.what) for a in args)})".lower()
            if given in self.paths:
                return self.paths[given], T.StringType()
            raise ValueError(f"{n.what} needs its joined column")
        raise ValueError(f"unknown function {n.what!r}")


#: What the functions are called in a page's script; lookups are calls that a page awaits.
SCRIPT_NAMES = {"round": "roundNumber", "min": "Math.min", "max": "Math.max", "abs": "Math.abs", "relatedlookup": "await relatedLookup", "querylookup": "await queryLookup", "lookupmultilevel": "await queryLookup"}


def to_script(n: Node, read: str = "parseFieldValue", names: Mapping[str, str] = SCRIPT_NAMES) -> str:
    """The tree as a JavaScript expression, which reads fields through the function ``read``."""
    args = [to_script(a, read, names) for a in n.args]
    if n.kind == "literal":
        if isinstance(n.what, str):
            return "'" + n.what.replace("'", "\\'") + "'"
        return json.dumps(n.what)
    if n.kind == "path":
        return f"{read}('{'.'.join(n.what)}')"
    if n.kind == "unary":
        return f"{n.what}{args[0]}"
    if n.kind == "binary":
        return f"({args[0]} {n.what} {args[1]})"
    if n.what.lower() == "if" and len(args) == 3:
        return f"({args[0]} ? {args[1]} : {args[2]})"
    if n.what.lower() not in names:
        raise ValueError(f"unknown function {n.what!r}")
    return f"{names[n.what.lower()]}({', '.join(args)})"


def formula(df: DataFrame, text: str, paths: Mapping[str, Column] = {}) -> Column:
    return Compiler(df, paths).compile(parse(text))[0]


def calculated(df: DataFrame, fields: Mapping[str, str]) -> DataFrame:
    """All formulas as columns, in the order that their references ask for; a cycle is an error."""
    trees = {k: parse(v) for k, v in fields.items()}
    low = {k.lower(): k for k in fields}
    done: list[str] = []

    def visit(name: str, above: tuple[str, ...]) -> None:
        if name in above:
            raise ValueError("cycle: " + " -> ".join([*above, name]))
        if name not in done:
            for ref in sorted(trees[name].names()):
                if ref.lower() in low and low[ref.lower()] != name or ref.lower() == name.lower():
                    visit(low[ref.lower()], (*above, name))
            done.append(name)

    for name in fields:
        visit(name, ())
    return reduce(lambda d, k: d.withColumn(k, Compiler(d).compile(trees[k])[0]), done, df)
