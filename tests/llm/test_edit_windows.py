import random

import numpy as np

from tessera.llm.edit_join import Windows, _in_band, distances, edit_classes, edit_distance, fitting, linked_of, near, shown


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "in", "er", "on", "a", "ti"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def changed(rng, text, edits):
    x = list(text)
    for _ in range(edits):
        if x:
            x[rng.randrange(len(x))] = rng.choice(["", "a", "bb", "cdcdcdcdcdcd"])
    return "".join(x)


def test_distances_and_bounds_against_one_pair_at_a_time():
    rng = random.Random(6)
    for turn in range(500):
        make = lambda most: "".join(rng.choice("abcd" if turn % 2 else "ab") for _ in range(rng.randrange(most)))
        b = make(150 if turn % 3 else 12)
        many = [changed(rng, b, rng.randrange(8)) if rng.random() < 0.6 else make(150) for _ in range(rng.randrange(1, 6))]
        most = np.array([rng.randrange(20) for _ in many])
        want = np.array([edit_distance(a, b) for a in many])
        got = distances(b, many, most)
        assert ((got == want) | ((got > most) & (want > most))).all()
        for a, m, w in zip(many, most.tolist(), want.tolist()):
            banded, bound = _in_band(a, b, m), shown(a, b, m)
            assert banded == w if w <= m else banded > m
            assert bound >= w or bound > m


def test_links_by_way_of_others_are_the_links(monkeypatch):
    rng = random.Random(7)
    for turn in range(60):
        monkeypatch.setattr("tessera.llm.edit_join.BANDED", 4096 if turn % 2 else 80)  # long ones are settled by bounds
        base = "".join(rng.choice("abcdef") for _ in range(rng.randrange(60, 140)))
        texts = list(dict.fromkeys(changed(rng, base, rng.randrange(12)) for _ in range(rng.randrange(2, 14))))
        asked = np.triu(np.random.default_rng(turn).random((len(texts), len(texts))) < 0.7, 1)
        asked |= asked.T
        want = [[bool(asked[i, j]) and near(a, b, 0.9) for j, b in enumerate(texts)] for i, a in enumerate(texts)]
        assert linked_of(texts, asked, 0.9).tolist() == want


def test_texts_of_one_vocabulary_with_one_first_line_do_not_fit():
    """Fingerprints of such texts were alike enough for a tenth of all pairs; of these not one in a hundred is verified."""
    rng = random.Random(8)
    line, windows = words(rng, 18), Windows()
    texts = [line + "\n" + words(rng, 200) for _ in range(200)]
    texts.append(texts[0][:300] + "this one is near" + texts[0][300:])
    fits = fitting([windows.of(t)[1] for t in texts], np.zeros(len(texts), int), 0.9, 3)
    assert fits[0, 200] and fits[200, 0] and fits[:200, :200].sum() <= 0.01 * 200 * 199


def test_texts_that_have_moved_at_both_ends_are_found(spark):
    """No walk from either end is in step with the middle; fingerprints alone missed most of these."""
    rng, rows = random.Random(9), []
    for k in range(30):
        text = words(rng, 500)
        n = len(text) // 25
        rows += [(2 * k, text), (2 * k + 1, text[:40] + words(rng, n)[:n] + text[40:-40] + words(rng, n)[:n] + text[-40:])]
    rows += [(100 + k, t) for k, t in enumerate(["abcdefghij", "abcdeXghij", "klmnopqrst", "klmno.qrst", "abcdefghi", "abcdefgh."])]
    got = {r.doc_id: (r.class_id, r.links) for r in edit_classes(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2 * k] == got[2 * k + 1] == (2 * k, 1) for k in range(30))
    assert [got[k] for k in range(100, 106)] == [(100, 1), (100, 1), (102, 1), (102, 1), (104, 0), (105, 0)]
