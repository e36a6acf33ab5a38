import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.common import Scratch
from tessera.llm.packing import END_ID, GAP, WAITS, Encoder, best_fit, between, brackets, cut, pack, settled

CAPACITY = 1024


def one_at_a_time(lengths, capacity):
    """Best-fit decreasing, the plain way: the multiset of sequences as sorted lengths."""
    gaps = []
    for n in sorted(lengths, reverse=True):
        fits = [k for k, (gap, _) in enumerate(gaps) if gap >= n]
        if fits:
            k = min(fits, key=lambda k: gaps[k][0])
            gaps[k] = (gaps[k][0] - n, [*gaps[k][1], n])
        else:
            gaps.append((capacity - n, [n]))
    return sorted(sorted(x) for _, x in gaps)


def by_stack(kind):
    """Pieces and gaps that a plain stack pairs, and those that it leaves."""
    stack, pairs, spare = [], set(), []
    for k, x in enumerate(kind):
        if x == WAITS:
            stack.append(k)
        elif stack:
            pairs.add((stack.pop(), k))
        else:
            spare.append(k)
    return pairs, spare, stack


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([WAITS, GAP]), max_size=60))
def test_brackets_equal_a_stack(kind):
    a, b = brackets(np.array(kind, int))
    assert set(zip(a.tolist(), b.tolist())) == by_stack(kind)[0]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([WAITS, GAP]), max_size=60), st.lists(st.integers(0, 60), max_size=5))
def test_partitions_meet_as_one_sweep(kind, cuts):
    """A sweep in parts, joined from their counts, pairs what one sweep over all does."""
    edges = sorted({0, len(kind), *(min(c, len(kind)) for c in cuts)})
    pairs, left = set(), []
    for part, (lo, hi) in enumerate(zip(edges, edges[1:])):
        own, spare, stack = by_stack(kind[lo:hi])
        pairs |= {(a + lo, b + lo) for a, b in own}
        left.append((part, [x + lo for x in spare], [x + lo for x in stack[::-1]]))
    for _, gpart, gat, wpart, wat, n in between([(p, len(g), len(w)) for p, g, w in left]):
        pairs |= {(left[wpart][2][wat + k], left[gpart][1][gat + k]) for k in range(n)}
    assert pairs == by_stack(kind)[0]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=30), st.lists(st.integers(1, 30), max_size=30))
def test_settled_leaves_no_piece_that_fits(sizes, gaps):
    n, free = np.sort(np.array(sizes, np.int64)), np.sort(np.array(gaps, np.int64))
    placed, room, waits = settled(np.arange(len(n)), n, np.arange(len(free)), free)
    used = Counter()
    for ids, seqs, lengths in placed:
        assert (n[ids] == lengths).all()
        for q, x in zip(seqs.tolist(), lengths.tolist()):
            used[q] += x
    assert all(free[q] - used[q] == room[q] >= 0 for q in range(len(free)))
    assert sorted([*(i for ids, _, _ in placed for i in ids.tolist()), *np.flatnonzero(waits).tolist()]) == list(range(len(n)))
    assert not waits.any() or not len(room) or room.max() < n[waits].min()


RNG = np.random.default_rng(6)
MIXTURES = {
    "uniform": RNG.integers(1, 65, 600), "short": RNG.integers(1, 9, 900), "ones": np.ones(300, int), "alike": np.full(200, 20), "halves": np.full(101, 32), "full": np.full(50, 64),
    "skewed": np.clip(RNG.lognormal(2, 1, 700).astype(int), 1, 64), "two": np.repeat([25, 19], [90, 160]), "one": np.array([3]),
}


@pytest.mark.parametrize("adaptive", ["true", "false"])  # few partitions, and as many as there are
@pytest.mark.parametrize("name", MIXTURES)
def test_as_few_sequences_as_best_fit_decreasing(spark, tmp_path, name, adaptive):
    if adaptive == "false" and name not in ("uniform", "skewed", "short"):
        pytest.skip("three mixtures do for many partitions")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        lengths = MIXTURES[name].tolist()
        pieces = spark.createDataFrame(list(enumerate(lengths)), "id long, n long")
        rows = best_fit(pieces, 64, Scratch(spark, "test")).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sorted(r.id for r in rows) == list(range(len(lengths)))
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, lengths[r.id]))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= 64
    plain = len(one_at_a_time(lengths, 64))
    print(name, adaptive, len(by), plain, -(-sum(lengths) // 64))
    assert len(by) <= plain * 1.01 + (1 if adaptive == "true" else 4)


def test_cut():
    assert cut(5, 8) == [(0, 5)] and cut(8, 8) == [(0, 8)]
    assert cut(19, 8) == [(0, 3), (3, 8), (11, 8)] and cut(16, 8) == [(0, 8), (8, 8)]


TEXTS = ["", "Hello world", "don't  stop\n\n\tnow ", "naïve façade — ¿qué? 数据 🙂", "<|endoftext|> in text", "a" * 3000, "x\x1cy z\xa0w​!", "12345 67,89 $$$ %%% x_y"]


def tokens(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [[*whole.encode(t or "", add_special_tokens=False).ids, END_ID] for t in texts]


def test_ids_are_the_tokenizers():
    encode = Encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    assert [np.frombuffer(encode(t), "<u4").tolist() for t in TEXTS] == tokens(TEXTS)


def test_round_trip(spark):
    words = "alpha beta gamma delta epsilon".split()
    rows = [(k, " ".join(words[(k * j) % 5] for j in range((k * 37) % 2500)), "x") for k in range(60)]
    rows += [(100 + k, t, "x") for k, t in enumerate(TEXTS)] + [(200, None, None), (None, "no id", "x"), (7, "again", "x"), (7, "again", "x")]
    out = pack(spark, spark.createDataFrame(rows, "doc_id long, text string, length string"), CAPACITY).collect()
    want = tokens([t for _, t, _ in rows])
    places = Counter()
    for r, ids in zip(rows, want):
        for k, (s, n) in enumerate(cut(len(ids), CAPACITY)):
            places[(r[0], k, s, n, zlib.crc32(np.asarray(ids[s : s + n], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == places
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for off, n in sorted(parts):
            assert off == at
            at += n
        assert at <= CAPACITY


def test_empty(spark):
    assert pack(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("n", [1, 1023, 1024, 1025, 5000])
def test_cut_covers(n):
    pieces = cut(n, 1024)
    assert sum(x for _, x in pieces) == n and all(x == 1024 for _, x in pieces[1:]) and [s for s, _ in pieces] == np.cumsum([0, *[x for _, x in pieces]])[:-1].tolist()
