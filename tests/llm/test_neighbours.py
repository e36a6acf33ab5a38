import math

import numpy as np

from tessera.llm import queries
from tessera.llm.neighbours import nearest
from tests.compare import connect, difference

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, every, most):
    good = [(i, [float(np.float32(x)) for x in v]) for i, v in rows if i is not None and v is not None and None not in v and all(map(math.isfinite, v)) and any(v)]
    size = max({len(v) for _, v in good}, key=[len(v) for _, v in good].count)
    good = [(i, np.array(v)) for i, v in good if len(v) == size]
    out = {}
    for q, v in good:
        if q % every == 0:
            near = sorted((-(v @ w) / (np.sqrt(v @ v) * np.sqrt(w @ w)), i) for i, w in good if i != q)
            out[q] = [(i, -s) for s, i in near[:most]]
    return out


def run(spark, rows, every=50, most=5):
    df = spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "x") for i, v in rows], SCHEMA)
    out = {}
    for r in nearest(spark, df, every, most).collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(i, s) for _, i, s in sorted(v)] for q, v in out.items()}, out


def test_recall(spark):
    rng = np.random.default_rng(5)
    rows = [(k, rng.standard_normal(24).tolist()) for k in range(2500)]
    got, raw = run(spark, rows)
    want = brute(rows, 50, 5)
    assert set(got) == set(want) and all([r for r, _, _ in sorted(v)] == [1, 2, 3, 4, 5] for v in raw.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9
    vectors = {i: np.float32(v).astype(float) for i, v in rows}
    for q, found in got.items():
        for i, s in found:
            a, b = vectors[q], vectors[i]
            assert abs(s - (a @ b) / (np.sqrt(a @ a) * np.sqrt(b @ b))) < 1e-12


def test_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(6)
    one = rng.standard_normal(8).tolist()
    rows = [(k, one) for k in range(300)] + [(300 + k, rng.standard_normal(8).tolist()) for k in range(60)]
    rows += [(1000, None), (1050, [0.0] * 8), (1100, [1.0, None] + [0.0] * 6), (1150, [float("nan")] + [1.0] * 7), (1200, [float("inf")] + [1.0] * 7), (1250, [1.0, 2.0]), (None, one), (50, one), (1300, [x * 2 for x in one]), (1350, [])]
    got, _ = run(spark, rows)
    want = brute(list(dict((r[0], r) for r in rows).values()), 50, 5)
    assert set(got) == set(want)
    for q in got:
        assert [round(s, 9) for _, s in got[q]] == [round(s, 9) for _, s in want[q]]
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[100]] == [0, 1, 2, 3, 4]


def complete(got, want):
    return set(got) == set(want) and all(len(got[q]) == len(want[q]) for q in want)


def test_outlier_keeps_its_query(spark):
    """A tight cluster and one vector opposite to it, which is alone in its leaf of every tree."""
    rng = np.random.default_rng(9)
    centre = rng.standard_normal(16)
    rows = [(0, (-centre).tolist())] + [(k, (centre + 0.01 * rng.standard_normal(16)).tolist()) for k in range(1, 2001)]
    got, _ = run(spark, rows)
    want = brute(rows, 50, 5)
    assert complete(got, want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9


def test_islands(spark):
    """Groups of one to four vectors far from each other: neighbours lie on other islands."""
    rng = np.random.default_rng(10)
    rows, k = [], 0
    for g in range(300):
        centre = rng.standard_normal(48) * 10
        for _ in range(1 + g % 4):
            rows.append((k, (centre + 0.001 * rng.standard_normal(48)).tolist()))
            k += 1
    got, _ = run(spark, rows, every=10)
    want = brute(rows, 10, 5)
    assert complete(got, want)
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9


def test_same_as_exact_sql(spark):
    """On a table of this size the graph search finds all of the exact nearest."""
    folder = "/root/testdata/sf0.01"
    assert difference(queries.op5_nearest_neighbours(spark, folder), connect(folder), queries.oracle_sql()["op5_nearest_neighbours"]) == ""


def test_small_tables(spark):
    assert run(spark, [(0, [1.0, 0.0])])[0] == {}
    got, _ = run(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])])
    assert [i for i, _ in got[0]] == [2, 1]
    assert nearest(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_recall_in_dense_groups(spark):
    """Groups of different vectors whose cosines differ by less than 16-bit rounding, among others."""
    rng = np.random.default_rng(8)
    rows = [(k, rng.standard_normal(32).tolist()) for k in range(300)]
    for g, noise in enumerate((2e-2, 1e-3, 1e-4)):
        centre = rng.standard_normal(32)
        rows += [(1000 * (g + 1) + k, (centre + noise * rng.standard_normal(32)).tolist()) for k in range(1000)]
    got, _ = run(spark, rows)
    want = brute(rows, 50, 5)
    assert set(got) == set(want)
    for g in range(4):
        kept = [len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want if q // 1000 == g]
        print(f"group {g}: recall {np.mean(kept):.3f}")
        assert np.mean(kept) >= 0.95
