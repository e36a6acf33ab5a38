"""Actions over rows: assertions, conditional assignments, loops over child lists, and calls on related rows."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.structured import Build, X


@dataclass(frozen=True)
class Assert:
    condition: X
    message: str
    severity: str = "error"


@dataclass(frozen=True)
class Set:
    field: str
    value: X
    condition: X | None = None


@dataclass(frozen=True)
class ForEach:
    """For each item of a list: if the condition holds, the parent's field takes the value. The last write wins; with
    ``running`` each item sees what the one before has written, under the field's own name."""

    items: str
    field: str
    value: X
    condition: X | None = None
    running: bool = False


Step = Assert | Set | ForEach


def _loop(df: DataFrame, s: ForEach, params: Mapping[str, object]):
    kind = df.schema[s.field].dataType
    inner = df.schema[s.items].dataType.elementType
    own = F.col(f"`{s.field}`")

    class Running(Build):
        now = None

        def __call__(self, e: X):
            return self.now if s.running and e.op == "field" and e.value == s.field and self.now is not None else super().__call__(e)

    def fold(acc, item):
        b = Running(df, params, item, inner)
        b.now = acc
        value = b(s.value).cast(kind)
        return value if s.condition is None else F.when(b.true(s.condition), value).otherwise(acc)

    return F.coalesce(F.aggregate(F.col(f"`{s.items}`"), own, fold), own)


def apply(df: DataFrame, steps: list[Step], params: Mapping[str, object] = {}) -> DataFrame:
    """All assignments read the row as it came; a row with a failed error keeps its values. Adds ``problems``."""
    build = Build(df, params)
    found, fatal = [], F.lit(False)
    for s in steps:
        if isinstance(s, Assert):
            bad = ~Build(df).true(s.condition)  # parameters do not reach assertions
            found.append(F.when(bad, F.lit(f"{s.severity}: {s.message}")))
            fatal = fatal | bad if s.severity == "error" else fatal
    new = {}
    for s in steps:
        if isinstance(s, Set):
            value = build(s.value).cast(df.schema[s.field].dataType)
            now = new.get(s.field, F.col(f"`{s.field}`"))
            new[s.field] = value if s.condition is None else F.when(build.true(s.condition), value).otherwise(now)
        elif isinstance(s, ForEach):
            new[s.field] = _loop(df, s, params)
    cols = {f: F.when(fatal, F.col(f"`{f}`")).otherwise(c) for f, c in new.items()}
    problems = F.filter(F.array(*found).cast("array<string>"), lambda m: m.isNotNull())
    return df.withColumns({**cols, "problems": problems})


def invoke(df: DataFrame, target: DataFrame, fk: str, key: str, steps: list[Step], when: X | None = None, params: Mapping[str, object] = {}) -> DataFrame:
    """The target's rows that a source row names, after the steps; the others as they were. One level deep."""
    asked = (df.where(Build(df, params).true(when)) if when is not None else df).select(F.col(fk).alias(key)).distinct()
    hit = target.join(asked, key, "left_semi")
    rest = target.join(asked, key, "left_anti").withColumn("problems", F.array().cast("array<string>"))
    return apply(hit, steps, params).unionByName(rest)


def when_due(df: DataFrame, due: str, steps: list[Step], params: Mapping[str, object] = {}) -> DataFrame:
    """A scheduled run: the steps on the rows whose column ``due`` holds, the others as they were."""
    fields = [s.field for s in steps if not isinstance(s, Assert)]
    ran = apply(df.withColumns({f"_was_{f}": F.col(f"`{f}`") for f in fields}), steps, params)
    return ran.withColumns({f: F.when(F.col(due), F.col(f"`{f}`")).otherwise(F.col(f"`_was_{f}`")) for f in fields}).select(*df.columns)
