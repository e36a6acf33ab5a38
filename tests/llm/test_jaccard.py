import random

import pytest

from tessera.llm import queries
from tessera.llm.jaccard import chance, near_duplicates, one_of_each, overlaps, runs_for
from tessera.llm.graph import components
from tessera.llm.common import Scratch
from tests.compare import connect, difference

SCHEMA = "doc_id long, text string, _set string, links int"


def corpus(seed=1, groups=12, lone=40, hot=70):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    line = " ".join(word() for _ in range(12))
    out = []
    for g in range(groups + 1):
        base = [word() for _ in range(rng.randrange(40, 120))]
        for _ in range(hot if g == 0 else rng.randrange(2, 6)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                w[rng.randrange(len(w))] = word()
            out.append(" ".join(w))
    out += [f"{line} " + " ".join(word() for _ in range(rng.randrange(1, 80))) for _ in range(lone)]
    return out + ["", "one two", "one two", "a b c d", " \n ", "one  two"]


def brute(rows, threshold=0.8, width=5):
    sets = []
    for _, t in rows:
        w = (t or "").split()
        k = min(width, len(w))
        sets.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else frozenset())
    near = lambda a, b: a == b or bool(a and b) and len(a & b) >= threshold * len(a | b)
    label, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            if rows[i][1] is not None and rows[j][1] is not None and near(sets[i], sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    least = {}
    for (d, _), x in zip(rows, label):
        least[x] = min(least.get(x, d), d)
    return sorted((d, least[x], n) for (d, _), x, n in zip(rows, label, links))


def test_brute_force(spark):
    rows = [(k, t) for k, t in enumerate(corpus())] + [(900, None), (901, None)]
    out = near_duplicates(spark, spark.createDataFrame([(d, t, "x", 5) for d, t in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.class_id, r.links) for r in out) == brute(rows)


def test_hot_group_over_blocks(spark, monkeypatch):
    import tessera.llm.jaccard as m

    monkeypatch.setattr(m, "BLOCK", 16)
    monkeypatch.setattr(m, "SMALL", 16)
    rows = [(k, t) for k, t in enumerate(corpus(seed=3, groups=3, lone=30, hot=90))]
    out = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.links) for r in out) == brute(rows)


def test_one_component_of_many_sizes(spark, monkeypatch):
    """A chain: each text holds the one before and some words more, so sizes span many classes of several blocks each."""
    import tessera.llm.jaccard as m

    monkeypatch.setattr(m, "BLOCK", 8)
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(700)]
    rows = [(k, " ".join(words[: 60 + 6 * k])) for k in range(100)] + [(200 + k, " ".join(words[: 60 + 6 * k] + ["end"])) for k in range(100)]
    out = near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.class_id, r.links) for r in out) == brute(rows)


def test_same_as_exact_sql(spark):
    folder = "/root/testdata/sf0.01"
    assert difference(queries.op4_ngram_jaccard(spark, folder), connect(folder), queries.oracle_sql()["op4_ngram_jaccard"]) == ""


def test_one_of_each_keeps_the_first(spark):
    rows = [(k, t) for k, t in enumerate(corpus(seed=5, hot=20))] + [(3, None), (None, "one two"), (None, "lone words that nobody else has at all"), (2, "twice the very same row of text"), (2, "twice the very same row of text")]
    df = spark.createDataFrame([(d, t, "x", 5) for d, t in rows], SCHEMA)
    out = one_of_each(spark, df)
    assert out.columns == df.columns
    want = {d for d, c, _ in brute([(d if d is not None else 10_000 + k, t) for k, (d, t) in enumerate(rows)]) if d == c}
    got = [r.doc_id for r in out.collect()]
    assert sorted(x for x in got if x is not None and x != 3) == sorted({d for d in want if d < 10_000 and d != 3})
    assert got.count(3) == 1 + (3 in {d for d, c, _ in brute([(d, t) for d, t in rows if t is not None and d is not None]) if d == c})
    assert got.count(None) == 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_duplicates(spark, df).count() == 0 and one_of_each(spark, df).count() == 0


def test_runs_meet_the_recall():
    p = chance(3)
    assert 1 - (1 - p) ** runs_for(0.999) >= 0.999 and runs_for(0.9) < runs_for(0.999)


def test_overlaps():
    import numpy as np

    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, n)).astype(np.uint64) for n in (3, 90, 200, 1)]
    assert overlaps(sets).tolist() == [[len(set(a) & set(b)) for b in sets] for a in sets]


@pytest.mark.parametrize("n", [1, 9, 64])
def test_components_of_chains(spark, n):
    edges = [(k, k + 1) for k in range(n)] + [(1000 + k, 2000) for k in range(n)]
    out = components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t"), f"c{n}").collect()
    assert {r.node: r.label for r in out} == {k: 0 for k in range(n + 1)} | {1000 + k: 1000 for k in range(n)} | {2000: 1000}


def test_recall_at_the_threshold_three_splits_deep(spark, monkeypatch):
    """Pairs whose sketches agree in each position with the threshold's chance, and whose nodes all split to the end."""
    import numpy as np

    import tessera.llm.jaccard as m

    monkeypatch.setattr(m, "SMALL", 0)
    rng, n = np.random.default_rng(7), 8000
    a, b = rng.integers(0, 1 << 32, (2, n, m.TOKENS), dtype=np.uint32)
    b = np.where(rng.random(b.shape) < 0.8, a, b)
    rows = [(2 * k + j, x[k].tobytes()) for k in range(n) for j, x in enumerate((a, b))]
    sets = spark.createDataFrame(rows, "_set long, _sketch binary").repartition(4)
    met = m.candidates(sets, Scratch(spark, "deep"), 0.8, 0.999).distinct().count()
    print(f"missed {n - met} of {n}")
    assert n - met <= 16


def test_roots_draw_enough_positions():
    import numpy as np

    import tessera.llm.jaccard as m

    roots = m.roots_for(0.8, 0.999)
    drawn = m.drawn_at(roots, 0.8)[1]
    assert drawn.any(axis=1).all() and m.missed(drawn.sum(axis=0), 0.8) <= 0.001
    assert m.missed(np.zeros(m.TOKENS, int), 0.8) > 0.999
