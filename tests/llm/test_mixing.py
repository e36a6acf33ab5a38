import math

import pytest

from tessera.llm import queries
from tessera.llm.mixing import decide, mix
from tests.compare import connect, difference

SCHEMA = "doc_id long, text string, source string, _src string"


def table(spark, sizes, extra=()):
    rows, k = [], 0
    for source, docs in sizes.items():
        for n in docs:
            rows.append((k, " ".join(["w"] * n), source, "clash"))
            k += 1
    return spark.createDataFrame(rows + list(extra), SCHEMA)


SIZES = {"big": [10] * 400, "mid": [7] * 80, "small": [5] * 12, None: [9] * 20}


def weights(sizes, alpha):
    t = {s: sum(d) for s, d in sizes.items()}
    z = sum((x / sum(t.values())) ** alpha for x in t.values())
    return {s: (x / sum(t.values())) ** alpha / z for s, x in t.items()}


def alpha_by_bisection(met, lo=0.0, hi=1.0):
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if met(mid) else (lo, mid)
    return lo


def check_realised(rows, sizes, want, budget):
    total = {s: sum(d) for s, d in sizes.items()}
    for s in sizes:
        own = [r for r in rows if r.source == s]
        assert all(abs(r.mix_weight - want[s]) < 1e-6 for r in own)
        quota = want[s] * budget
        taken = sum(r.mix_copies * r.mix_tokens for r in own)
        assert taken <= quota + 1e-6 and quota - taken < max(sizes[s]) + 1e-6
        epochs = math.floor(quota / total[s] + 1e-9)
        assert {r.mix_copies for r in own} <= {epochs, epochs + 1}
        extra = sorted((r.mix_block, r.mix_copies - epochs) for r in own)
        cut = [b for b, e in extra if e == 0]
        assert all(e == 1 for b, e in extra if cut and b < min(cut))  # whole blocks in the order of the permutation
        assert all(e == 0 for b, e in extra if cut and b > min(cut))


def test_entropy_target(spark):
    df = table(spark, SIZES)
    rows = decide(spark, df, target_entropy=0.9, blocks=40).collect()
    entropy = lambda a: -sum(w * math.log(w) for w in weights(SIZES, a).values())
    alpha = alpha_by_bisection(lambda a: entropy(a) >= 0.9 * math.log(len(SIZES)))
    check_realised(rows, SIZES, weights(SIZES, alpha), sum(map(sum, SIZES.values())))


def test_repeat_limit(spark):
    budget = 6000
    rows = decide(spark, table(spark, SIZES), max_repeats=4, budget=budget, blocks=40).collect()
    met = lambda a: max(w * budget / sum(SIZES[s]) for s, w in weights(SIZES, a).items()) > 4
    alpha = alpha_by_bisection(met)
    check_realised(rows, SIZES, weights(SIZES, alpha), budget)
    assert max(r.mix_copies for r in rows) <= 5


def test_copies_are_rows_and_columns_stay(spark):
    df = table(spark, SIZES)
    chosen = {r.doc_id: r.mix_copies for r in decide(spark, df, target_entropy=0.95).collect()}
    out = mix(spark, df, target_entropy=0.95)
    assert out.columns == df.columns
    count = {}
    for r in out.collect():
        count[r.doc_id] = count.get(r.doc_id, 0) + 1
        assert r._src == "clash"
    assert count == {d: n for d, n in chosen.items() if n}


FOLDER = "/root/testdata/sf0.01"


def test_same_as_sql(spark):
    assert difference(queries.op9_mixing(spark, FOLDER), connect(FOLDER), queries.oracle_sql()["op9_mixing"]) == ""


def test_binds_on_near_equal_sources(spark):
    """Sources of documents hold almost alike; half of the way to equal weights still moves every one of them."""
    rows = queries.op9_mixing(spark, FOLDER).collect()
    sizes = {}
    for r in rows:
        sizes.setdefault(r.source, []).append(r.mix_tokens)
    total = sum(map(sum, sizes.values()))
    ln = math.log(len(sizes))
    entropy = lambda a: -sum(w * math.log(w) for w in weights(sizes, a).values()) / ln
    alpha = alpha_by_bisection(lambda a: entropy(a) >= (1 + entropy(1.0)) / 2)
    assert 0.5 < alpha < 0.9
    check_realised(rows, sizes, weights(sizes, alpha), total)
    copies = [r.mix_copies for r in rows]
    assert set(copies) == {0, 1, 2} and copies.count(0) > 10 and copies.count(2) > 10
    assert all(len({r.mix_block for r in rows if r.source == s}) > 30 for s in sizes)


def test_as_they_are_when_even_enough(spark):
    even = {"a": [5] * 30, "b": [5] * 30}
    rows = decide(spark, table(spark, even), target_entropy=0.9).collect()
    assert {r.mix_copies for r in rows} == {1}


def test_odd_rows(spark):
    extra = [(900, None, "none", "x"), (901, "", "none", "x"), (None, "w w", "big", "x"), (3, " ".join(["w"] * 10), "big", "x"), (902, "w " * 20_000, "huge", "x")]
    df = table(spark, SIZES, extra)
    rows = {r.doc_id: r for r in decide(spark, df, target_entropy=0.9).collect()}
    assert rows[900].mix_copies == rows[901].mix_copies == 1 and rows[900].mix_weight == 0.0
    assert len(decide(spark, df, target_entropy=0.9).collect()) == df.count()
    assert decide(spark, df.limit(0), target_entropy=0.9).count() == 0 and mix(spark, df.limit(0), max_repeats=2).count() == 0
    assert mix(spark, table(spark, {"only": [3] * 5}), target_entropy=0.9).count() == 5
    with pytest.raises(ValueError):
        decide(spark, df)
