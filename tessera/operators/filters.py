"""Filter trees over one entity, and the request formats that build them."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.semantics import below, false_if_null, fold, literal, parse_list

#: Every spelling of an operator, by its canonical name.
SPELLINGS = {
    "eq": ("eq", "equals", "=", "=="), "ne": ("ne", "neq", "notequals", "!=", "<>"), "contains": ("contains", "like"),
    "startswith": ("startswith", "starts"), "endswith": ("endswith", "ends"), "in": ("in",), "notin": ("notin", "nin", "not in"),
    "gt": ("gt", "greaterthan", ">"), "lt": ("lt", "lessthan", "<"),
    "ge": ("ge", "gte", "greaterthanorequal", ">="), "le": ("le", "lte", "lessthanorequal", "<="),
}
CANONICAL = {s: name for name, all_of in SPELLINGS.items() for s in all_of}


@dataclass(frozen=True)
class Clause:
    field: str
    op: str
    value: object = None


@dataclass(frozen=True)
class Group:
    """Clauses and nested groups under one connective. An empty And holds, an empty Or doesn't."""

    clauses: tuple[Clause, ...] = ()
    groups: tuple[Group, ...] = ()
    any_of: bool = False


@dataclass(frozen=True)
class Sort:
    field: str
    descending: bool = False


@dataclass(frozen=True)
class QueryDefinition:
    where: Group = field(default_factory=Group)
    sorts: tuple[Sort, ...] = ()
    skip: int = 0
    top: int | None = None


def operator(name: str) -> str:
    try:
        return CANONICAL[str(name).strip().lower()]
    except KeyError:
        raise ValueError(f"unknown filter operator {name!r}") from None


def kind_of(df: DataFrame, name: str) -> T.StructField:
    """The field by name, case aside; an unknown name is an error."""
    for f in df.schema.fields:
        if f.name.lower() == name.lower():
            return f
    raise ValueError(f"unknown field {name!r}")


def clause(df: DataFrame, c: Clause) -> Column:
    f, op = kind_of(df, c.field), operator(c.op)
    col, kind = F.col(f"`{f.name}`"), f.dataType
    if isinstance(kind, T.ArrayType) and op in ("contains", "in", "notin", "eq", "ne"):
        wanted = [v.lower() for v in parse_list(c.value)]
        found = false_if_null(F.exists(col, lambda x: fold(x).isin(wanted)))
        return ~found if op in ("ne", "notin") else found
    if op in ("contains", "startswith", "endswith"):
        if c.value is None:
            return F.lit(False)
        text, wanted = fold(col), F.lit(str(c.value).lower())
        return col.isNotNull() & {"contains": F.contains, "startswith": F.startswith, "endswith": F.endswith}[op](text, wanted)
    if op in ("in", "notin"):
        values = parse_list(c.value)
        if isinstance(kind, T.StringType):
            found = F.lower(col).isin([v.lower() for v in values])
        else:
            found = col.isin([literal(v, kind) for v in values])
        found = col.isNotNull() & found if values else F.lit(False)
        return ~found if op == "notin" else found
    text = isinstance(kind, T.StringType)
    left = F.lower(col) if text else col
    right = literal(None if c.value is None else str(c.value).lower() if text else c.value, kind)
    if op in ("eq", "ne"):
        if c.value is None:
            return col.isNull() if op == "eq" else col.isNotNull()
        same = col.isNotNull() & (left == right)  # null is no match; both halves reach the scan
        return same if op == "eq" else ~same
    if c.value is not None:  # null is below every value
        return {"lt": left.isNull() | (left < right), "le": left.isNull() | (left <= right), "gt": col.isNotNull() & (left > right), "ge": col.isNotNull() & (left >= right)}[op]
    return {"lt": below(left, right), "le": below(left, right, True), "gt": below(right, left), "ge": below(right, left, True)}[op]


def condition(df: DataFrame, g: Group) -> Column:
    parts = [clause(df, c) for c in g.clauses] + [condition(df, x) for x in g.groups]
    if not parts:
        return F.lit(not g.any_of)
    return reduce((lambda a, b: a | b) if g.any_of else (lambda a, b: a & b), parts)


def filtered(df: DataFrame, *clauses: Clause | Group, any_of: bool = False) -> DataFrame:
    own = tuple(c for c in clauses if isinstance(c, Clause))
    return df.where(condition(df, Group(own, tuple(c for c in clauses if isinstance(c, Group)), any_of)))


def search_all(fields: list[str], text: str) -> Group:
    """The text anywhere in any of the fields."""
    return Group(tuple(Clause(f, "contains", text) for f in fields), any_of=True)


def _sorts(items) -> tuple[Sort, ...]:
    out = []
    for s in items or ():
        if isinstance(s, Mapping):
            out.append(Sort(s["field"], str(s.get("direction", s.get("dir", "asc"))).lower().startswith("d")))
        else:
            name, _, way = str(s).partition(":")
            out.append(Sort(name.removeprefix("-"), s.startswith("-") or way.lower().startswith("d")))
    return tuple(out)


def from_json(body: Mapping) -> QueryDefinition:
    """clauses, groups, logic, sorts, skip, top."""

    def group(g: Mapping) -> Group:
        return Group(tuple(Clause(c["field"], c.get("operator", c.get("op", "eq")), c.get("value")) for c in g.get("clauses", ())), tuple(group(x) for x in g.get("groups", ())), str(g.get("logic", "and")).lower() == "or")

    return QueryDefinition(group(body), _sorts(body.get("sorts")), int(body.get("skip") or 0), body.get("top"))


def from_querystring(df: DataFrame, params: Mapping[str, str], list_fields: list[str] | None = None) -> QueryDefinition:
    """q, f_<field> with op_<field>, field/op/value, sort, skip and top (kept within 1 and 10000)."""
    clauses, groups = [], []
    default = lambda name: "contains" if isinstance(kind_of(df, name).dataType, T.StringType) else "eq"
    for key, value in params.items():
        if key.startswith("f_"):
            clauses.append(Clause(key[2:], params.get(f"op_{key[2:]}") or default(key[2:]), value))
    if params.get("field"):
        clauses.append(Clause(params["field"], params.get("op") or default(params["field"]), params.get("value")))
    if params.get("q"):
        groups.append(search_all(list_fields or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)], params["q"]))
    top = min(max(int(params["top"]), 1), 10_000) if params.get("top") else None
    sorts = _sorts([f"{params['sort']}:{params.get('dir', 'asc')}"]) if params.get("sort") else ()
    return QueryDefinition(Group(tuple(clauses), tuple(groups)), sorts, int(params.get("skip") or 0), top)


def from_lookup(params: Mapping[str, object]) -> QueryDefinition:
    """Repeated filter=field:value and search with searchField; 200 rows unless told otherwise, 10000 at most."""
    given = params.get("filter") or []
    clauses = [Clause(*_split(x)) for x in ([given] if isinstance(given, str) else given)]
    if params.get("search") and params.get("searchField"):
        clauses.append(Clause(str(params["searchField"]), "contains", params["search"]))
    return QueryDefinition(Group(tuple(clauses)), _sorts([params["sort"]]) if params.get("sort") else (), int(params.get("skip") or 0), min(int(params.get("top") or 200), 10_000))


def _split(pair: str) -> tuple[str, str, str]:
    name, _, value = pair.partition(":")
    return name, "eq", value


def from_tool(args: Mapping) -> QueryDefinition:
    """filters[] of field, operator, value; 50 rows unless told otherwise, 200 at most."""
    found = from_json({"clauses": args.get("filters", ()), "sorts": args.get("sorts")})
    return QueryDefinition(found.where, found.sorts, int(args.get("skip") or 0), min(int(args.get("top") or 50), 200))


def from_graphql(args: Mapping[str, object]) -> QueryDefinition:
    """Arguments other than take, skip and sort are equalities."""
    clauses = tuple(Clause(k, "eq", v) for k, v in args.items() if k not in ("take", "skip", "sort"))
    take = args.get("take")
    return QueryDefinition(Group(clauses), _sorts([args["sort"]]) if args.get("sort") else (), int(args.get("skip") or 0), None if take is None else int(take))
