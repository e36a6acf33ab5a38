"""What a report will do, which indexes or partitions would help, and how long plans took."""

from __future__ import annotations

import time
from collections import deque
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .report import Report


def steps(report: Report) -> list[dict[str, str]]:
    """LoadEntity, HashJoin, PostJoinFilter and ProjectAndSort, in order."""
    out = [{"step": "LoadEntity", "detail": e} for e in [report.root, *(x.right for x in report.links)]]
    out += [{"step": "HashJoin", "detail": f"{x.left}.{x.left_field} = {x.right}.{x.right_field} ({x.how})"} for x in report.links]
    out += [{"step": "PostJoinFilter", "detail": f"{e}.{c.field} {c.op} {c.value}"} for e, c in report.clauses]
    return [*out, {"step": "ProjectAndSort", "detail": ", ".join(o.label for o in report.outs) or "all fields"}]


def advice(report: Report) -> list[str]:
    """Fields that are filtered, joined or sorted on without an index (here: partition, bucket or sort them)."""
    used = [(e, c.field, "filter") for e, c in report.clauses] + [(x.right, x.right_field, "join") for x in report.links]
    labels = {o.label: (o.entity, o.field) for o in report.outs if not o.aggregate}
    used += [(*labels[s], "sort") for s, _ in report.sorts if s in labels]
    return [f"{e}.{f}: no index for {why}" for e, f, why in used if f not in report.catalog[e].indexed]


@dataclass(frozen=True)
class Ran:
    name: str
    seconds: float
    rows: int


class History:
    """The last plans that ran, newest first."""

    def __init__(self, most: int = 100):
        self._ran: deque[Ran] = deque(maxlen=most)

    def run(self, name: str, df: DataFrame) -> Ran:
        began = time.monotonic()
        rows = df.count()
        self._ran.appendleft(Ran(name, time.monotonic() - began, rows))
        return self._ran[0]

    def __iter__(self):
        return iter(self._ran)
