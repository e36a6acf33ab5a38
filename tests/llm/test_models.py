"""Quality and language: held-out accuracy, what they learn from, and odd rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from tessera.llm.common import held_out
from tessera.llm.language import HASHES, SLOT_BITS, grams, identify, predict, slots
from tessera.llm.quality import SLOT_BITS as SLOTS
from tessera.llm.quality import Indicators, descend, fit, learn, log_ratios, score_quality, shape, sigmoid

FOLDER = "/root/testdata/sf0.01"


def test_held_out_is_crc32_of_the_id(spark):
    rows = spark.range(200).select("id", held_out("id").alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_quality_of_held_out_rows(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet"), spark.read.parquet(f"{FOLDER}/labels.parquet")
    got = score_quality(spark, docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    good, bad = got[got.quality == 1].score, got[got.quality == 0].score
    assert np.mean([(g > b) + (g == b) / 2 for g in good for b in bad]) > 0.98
    assert ((got.score >= 0.7).astype(int) == got.predicted).all() and got.score.between(0, 1).all()
    assert got.predicted[got.quality == 1].mean() > 0.95


def test_quality_does_not_learn_from_held_out_labels(spark):
    docs, labels = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300), spark.read.parquet(f"{FOLDER}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 4 = 2 then 1 - quality else quality end as quality")
    a, b = (sorted((r.doc_id, r.score) for r in score_quality(spark, docs, x).collect()) for x in (labels, turned))
    assert a == b


def test_quality_odd_rows(spark):
    rows = [(k, "Some plain words here." if k % 2 else "BAD!! TEXT!! $$$", "x", 0.5) for k in range(60)] + [(60, None, "x", 0.1), (61, "", "x", 0.1), (None, "Plain", "x", 0.1), (3, "long " * 50_000, "x", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out string, score double")
    labels = spark.createDataFrame([(k, k % 2 if k != 9 else None) for k in range(60)], "doc_id long, quality int")
    out = score_quality(spark, docs, labels).collect()
    assert len(out) == len(rows) and all(r.score is not None and 0 <= r.score <= 1 for r in out)
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert {r.score for r in score_quality(spark, docs, none).collect()} == {0.5}
    assert score_quality(spark, docs.limit(0), labels).count() == 0


def test_dual_coordinate_descent_solves_the_hinge_loss():
    """Against plain subgradient descent on the primal."""
    rng = np.random.default_rng(0)
    docs = [np.unique(rng.integers(0, 40, 8)).astype(np.int32) for _ in range(120)]
    y = np.array([1 if (d < 20).mean() > 0.5 else -1 for d in docs])
    r = np.ones(40)
    w, b = descend(docs, y, r, 1.0, 400)
    x = np.zeros((len(y), 41))
    for row, d in zip(x, docs):
        row[d] = 1 / np.sqrt(len(d))
        row[40] = 1
    cost = np.where(y > 0, len(y) / 2 / (y > 0).sum(), len(y) / 2 / (y < 0).sum())
    loss = lambda v: v @ v / 2 + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    v, best = np.zeros(41), np.inf
    for k in range(20_000):
        active = y * (x @ v) < 1
        v = v - (v - x.T @ (cost * y * active)) / (k + 2)
        best = min(best, loss(v))
    assert loss(np.append(w, b)) <= best * 1.01


def plain_slots(text):
    """The slots of a text's n-grams, one at a time."""
    def slot(gram, salt):
        g = (gram ^ (0x9E3779B1 * salt & 0xFFFFFFFF)) * 0x85EBCA6B & 0xFFFFFFFF
        return ((g ^ g >> 15) * 0xC2B2AE35 & 0xFFFFFFFF) >> 32 - SLOTS

    raw, out = (text or "").encode(), set()
    for size in (1, 2, 3, 4):
        for k in range(len(raw) - size + 1):
            out.add(slot(int.from_bytes(raw[k : k + size], "little"), size))
    words = (text or "").split()
    signs = [shape(w) + 16 * (k > 0 and words[k - 1] == w) + 1 for k, w in enumerate(words)]
    for size in (1, 2, 3):
        for k in range(len(signs) - size + 1):
            out.add(slot(sum(s << 6 * j for j, s in enumerate(signs[k : k + size])), 10 + size))
    if words:
        out.add(slot(len(words).bit_length(), 20))
    return out


def test_scores_by_brute_force(spark):
    """Counts, ratios, margins and scores over sets and dictionaries, against the query's; only the fit itself, which has a
    test of its own, is shared."""
    docs, labels = spark.read.parquet("/root/testdata/sf0.001/documents.parquet"), spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    known = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2}
    texts = {r.doc_id: r.text for r in docs.collect()}
    slots_of = {d: plain_slots(t) for d, t in texts.items()}
    model = learn(spark, docs.select("doc_id", "text"), labels, 4000)
    good, bad = ([d for d, q in known.items() if q == x and d in texts] for x in (1, 0))
    ratio = {}
    for s in set().union(*slots_of.values()):
        p, q = ((1 + sum(s in slots_of[d] for d in own)) / (len(own) + 2) for own in (good, bad))
        ratio[s] = math.log(p / q)
    assert all(abs(math.sqrt(model.squares[s]) - abs(r)) < 1e-4 for s, r in ratio.items())
    weight = {s: float(model.weights[s]) / r if abs(r) > 1e-9 else 0.0 for s, r in ratio.items()}
    for r in score_quality(spark, docs, labels).collect():
        own = slots_of[r.doc_id]
        length = math.sqrt(sum(ratio[s] ** 2 for s in own))
        margin = sum(weight[s] * ratio[s] / length for s in own) + model.bias if length else model.bias
        want = 1 / (1 + math.exp(-(model.slope * margin + model.shift)))
        assert abs(r.score - want) < 1e-4 and r.predicted == (r.score >= 0.7)


def test_sigmoid_and_ratios():
    slope, shift = sigmoid(np.array([-2.0, -1, 1, 2] * 20), np.array([-1, -1, 1, 1] * 20))
    assert slope > 0 and abs(shift) < 0.2
    r = log_ratios([np.array([1], np.int32)] * 5 + [np.array([2], np.int32)] * 5, np.array([1] * 5 + [-1] * 5))
    assert r[1] > 0 > r[2] and r[3] == 0
    assert fit([], np.array([], int)).score(np.array([], np.int32)) == 0.5


def test_indicators_see_repeats():
    see = Indicators()
    assert len(see("")) == len(see(None)) == 0
    assert set(see("the the the")) - set(see("the cat sat"))


def test_language_of_held_out_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97 and got.score.between(0, 1).all()


def test_language_odd_rows(spark):
    rng = random.Random(1)
    rows = [(k, ("uno dos tres casa perro " if k % 2 else "haus hund katze eins zwei ") * rng.randrange(1, 5), ["de", "es"][k % 2], "x") for k in range(80)]
    rows += [(90, None, "de", "x"), (91, "", None, "x"), (92, "123 $$$ ___", None, "x"), (93, "casa " * 40_000, None, "x"), (None, "haus", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    out = {r.doc_id: r for r in identify(spark, docs).collect()}
    assert [out[k].lang_pred for k in (90, 91, 92)] == ["und"] * 3 and out[93].lang_pred == "es" and out[None].lang_pred == "de"
    assert all(out[k].lang_pred == ["de", "es"][k % 2] for k in range(80))
    nothing = identify(spark, docs.withColumn("lang", docs.lang.substr(9, 1).cast("int").cast("string")).where("doc_id = 93"))
    assert [r.lang_pred for r in nothing.collect()] == ["und"]
    assert identify(spark, docs.limit(0)).count() == 0


def test_languages_by_brute_force(spark):
    """Exact counts of exact n-grams, without a filter: the same language wins."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    counts: dict[str, Counter] = {}
    for r in docs:  # fewer rows a language than are sampled, so all are learned from
        if r.lang is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            counts.setdefault(r.lang, Counter()).update(grams(r.text, 4).tolist())
    rate = {k: {g: n / c.total() for g, n in c.items() if n >= 2} for k, c in counts.items()}
    best: dict[int, float] = {}
    for own in rate.values():
        for g, x in own.items():
            best[g] = max(best.get(g, 0.0), x)
    member = {k: {g for g, x in own.items() if x >= 0.25 * best[g]} for k, own in rate.items()}
    got = {r.doc_id: r for r in identify(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), train_rows=10_000).collect()}
    odd = 0
    for r in docs:
        h = grams(r.text, 4).tolist()
        if not h:
            assert got[r.doc_id].lang_pred == "und"
            continue
        hits = {k: sum(g in own for g in h) for k, own in member.items()}
        odd += got[r.doc_id].lang_pred != max(sorted(hits), key=hits.get)
        assert abs(got[r.doc_id].score - max(hits.values()) / max(1, sum(hits.values()))) < 0.05
    assert odd <= 1


@pytest.mark.parametrize("langs", [2, 70])
def test_filter_never_misses_and_counts_are_corrected(langs):
    """Against exact sets of n-grams, with one and with two mask words."""
    rng = random.Random(langs)
    words = [[("".join(rng.choice("abcdefghijklmnop") for _ in range(6))) for _ in range(40)] for _ in range(langs)]
    names = [f"l{k:02}" for k in range(langs)]
    exact = [set(grams(" ".join(w), 4).tolist()) for w in words]
    table = np.zeros((-(-langs // 63), 1 << SLOT_BITS), np.int64)
    for k, own in enumerate(exact):
        for at in slots(np.array(sorted(own), np.uint64)):
            table[k // 63, at] |= np.int64(1) << np.int64(k % 63)
    false = np.array([((table[k // 63] >> (k % 63)) & 1).mean() for k in range(langs)]) ** HASHES
    for k in range(langs):
        text = " ".join(rng.sample(words[k], 12))
        assert predict(text, names, table, false, names[0], 4)[0] == names[k]
