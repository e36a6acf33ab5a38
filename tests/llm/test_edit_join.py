import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.edit_join import alike, edit_classes, edit_distance, near, similarity
from tessera.llm.edit_sketch import Embedder, code_points


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[j - 1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@settings(max_examples=400, deadline=None)
@given(st.text("abc", max_size=14), st.text("abc", max_size=14))
def test_edit_distance(a, b):
    assert edit_distance(a, b) == plain(a, b)


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=14), st.text("ab", max_size=14), st.sampled_from([0.5, 0.8, 0.9]))
def test_near_is_the_similarity(a, b, threshold):
    assert near(a, b, threshold) == (similarity(a, b) >= threshold - 1e-12)


def test_alike_is_the_likeness_of_pairs():
    rng, embed = random.Random(5), Embedder()
    texts = ["", "a", "ab"] + ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 300))) for _ in range(40)]
    texts += [t[: len(t) // 2] + "xyz" + t[len(t) // 2 :] for t in texts] + texts[:5]
    prints = [embed.fingerprint(code_points(t), embed.walk(code_points(t))) for t in texts]
    side = np.array([k % 2 for k in range(len(texts))])
    for sides in (np.zeros(len(texts), int), side):
        want = [[i != j and (not sides.any() or sides[i] != sides[j]) and embed.likeness(a, b) >= 0.2 - 1e-6 for j, b in enumerate(prints)] for i, a in enumerate(prints)]
        assert alike(embed, prints, sides, 0.2).tolist() == want


def test_classes_against_brute_force(spark):
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("etaoin shrdlucmfw") for _ in range(n))
    texts = []
    for g in range(25):
        base = make(rng.randrange(200, 500))
        texts.append(base)
        for _ in range(rng.randrange(0, 4) if g else 40):
            t = list(base)
            for _ in range(rng.randrange(1, 5)):
                k = rng.randrange(len(t))
                t[k : k + rng.randrange(0, 2)] = make(rng.randrange(0, 2))
            texts.append("".join(t))
    texts += ["", "", texts[0], make(3000)]
    rows = list(enumerate(texts)) + [(900, None)]
    label, links = list(range(len(texts))), [0] * len(texts)
    for i in range(len(texts)):
        for j in range(i):
            if abs(len(texts[i]) - len(texts[j])) <= 0.1 * max(1, len(texts[i]), len(texts[j])) and similarity(texts[i], texts[j]) >= 0.9:
                links[i] += 1
                links[j] += 1
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    got = {r.doc_id: (r.class_id, r.links) for r in edit_classes(spark, spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, links int")).collect()}
    assert got[900] == (900, 0) and all(got[k][0] == label[k] and got[k][1] <= links[k] for k in range(len(texts)))
    assert sum(n for _, n in got.values()) >= 0.97 * sum(links)
    assert edit_classes(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
