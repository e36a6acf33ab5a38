import random

import numpy as np

from tessera.llm import edit_join
from tessera.llm.edit_join import Bounds, Windows, _in_band, edit_distance, one_of_alike
from tessera.llm.edit_sketch import Embedder, code_points
from tests.llm.test_edit_windows import changed, words


def test_texts_walked_together_are_walked_as_each_alone():
    rng, embed, windows = random.Random(10), Embedder(), Windows()
    texts = ["", "a", "abcdefghij", "x" * 3000, "\U0001f600\u00e9" * 40] + [words(rng, rng.randrange(1, 300)) for _ in range(40)]
    for some in (texts, texts[:5], []):
        many = [code_points(t) for t in some]
        assert [w.tolist() for w in embed.walks(many)] == [embed.walk(c).tolist() for c in many]
    for (bands, told), text in zip(windows.of_all(texts), texts):
        own, alone = windows.of(text)
        assert told == alone and bands.tolist() == own.tolist()


def test_counts_of_grams_reject_no_near_pair():
    rng = random.Random(11)
    for _ in range(60):
        base = words(rng, rng.randrange(1, 60))
        texts = [base, "", "ab"] + [changed(rng, base, rng.randrange(1 + len(base) // 3)) for _ in range(8)]
        most = np.array([edit_distance(base, t) for t in texts[1:]])
        assert not Bounds(texts).far(0, np.arange(1, len(texts)), most).any()
    unlike = [words(rng, 80) for _ in range(20)]
    assert Bounds(unlike).far(0, np.arange(1, 20), np.full(19, 30)).all()


def test_a_band_ends_as_soon_as_its_column_costs_too_much(monkeypatch):
    """Two unlike long texts: of the second one only the beginning is read."""
    rng, read = random.Random(12), []
    a, b = ("".join(rng.choice("abcdefghijklmnop") for _ in range(12000)) for _ in range(2))
    monkeypatch.setattr(edit_join, "_number", lambda bits, f=edit_join._number: read.append(len(bits)) or f(bits))
    assert _in_band(a, b, 1200) > 1200
    assert len(read) <= 16 * 4  # tables of 16 characters, of 4 chunks of 12 at most
    c = a[:3000] + a[3100:7000] + "x" * 60 + a[7000:]
    assert _in_band(a, c, 1200) == _in_band(c, a, 160) == 160 and _in_band(a, c, 159) > 159


def test_buckets_of_the_same_sets_are_compared_once(spark):
    rows = [(1, k) for k in range(5)] + [(2, k) for k in range(5)] + [(3, k) for k in range(4)] + [(4, 9)] + [(5, k) for k in range(1, 6)]
    state = spark.createDataFrame(rows, "_label long, _set long")
    assert sorted(map(tuple, one_of_alike(state).collect())) == [(1, 5), (3, 4), (5, 5)]
