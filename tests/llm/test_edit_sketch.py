import hashlib
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.edit_sketch import PERIOD, Embedder, code_points, edit_fingerprints, edited
from tests.compare import connect, difference

EMBED = Embedder()


def print_of(text):
    codes = code_points(text)
    return EMBED.fingerprint(codes, EMBED.walk(codes))


def by_steps(text):
    """The walk one step at a time: the step at which each character is reached."""
    codes = code_points(text)
    moves = []
    for c in range(64):
        stay = np.frombuffer(EMBED.steps[c], np.uint8)
        moves.append(stay)
    reached, j = [0], 0
    for c in codes.tolist():
        cls = (c * 0x9E3779B1 & 0xFFFFFFFF) >> 26
        while moves[cls][j % PERIOD] != 1:  # the bit isn't set: stay for a step
            j += 1
        j += 1
        reached.append(j)
    return reached


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_walk_equals_steps(text):
    assert EMBED.walk(code_points(text)).tolist() == by_steps(text)


def test_likeness():
    rng = random.Random(1)
    make = lambda n: "".join(rng.choice("etaoin shrdlu") for _ in range(n))
    for n in (30, 200, 1500, 40_000):
        a, b = make(n), make(n)
        near = edited(a, b)
        assert EMBED.likeness(print_of(a), print_of(a)) == 1.0
        assert EMBED.likeness(print_of(a), print_of(near)) > EMBED.likeness(print_of(a), print_of(b)) + 0.2
        assert 0 <= EMBED.likeness(print_of(a), print_of(b)) <= 0.45
        one = a[: n // 2] + "X" + a[n // 2 + 1 :]
        assert EMBED.likeness(print_of(a), print_of(one)) > 0.6
        assert EMBED.likeness(print_of(a), print_of(near)) == EMBED.likeness(print_of(near), print_of(a))
    assert print_of("") == print_of("") and EMBED.likeness(print_of(""), print_of("x" * 500)) == 0.0


def test_rows_against_a_plain_loop(spark):
    rng = random.Random(2)
    rows = [(k * 3, "".join(rng.choice("abcdé 🙂") for _ in range(rng.randrange(0, 200))), "x") for k in range(120)]
    rows += [(1000, None, "x"), (1001, "", "x"), (1002, "long " * 30_000, "x")]
    for segments in (1, 7, 500):
        out = {r.doc_id: r for r in edit_fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string, fingerprint string"), segments).collect()}
        order = sorted(rows, reverse=True)
        assert len(out) == len(rows)
        for k, (d, t, _) in enumerate(order):
            t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
            new = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
            r = out[d]
            assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
            assert (r.fingerprint, r.edited_fingerprint) == (print_of(t), print_of(new))
            assert (r.near_edited, r.near_next) == (EMBED.likeness(print_of(t), print_of(new)), EMBED.likeness(print_of(t), print_of(nxt)))


def test_odd_tables(spark):
    one = edit_fingerprints(spark, spark.createDataFrame([(1, "abcdef")], "doc_id long, text string")).collect()
    assert len(one) == 1 and one[0].edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and one[0].near_next == 1.0
    rows = [(5, "same"), (5, "same"), (5, "other text"), (None, "no id"), (None, "no id either"), (7, "x" * 50)]
    out = edit_fingerprints(spark, spark.createDataFrame(rows, "doc_id long, text string"), 3).collect()
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == sorted((d or 0, len(t)) for d, t in rows)
    assert edit_fingerprints(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_lengths_and_digests_as_sql(spark):
    folder = "/root/testdata/sf0.01"
    sql = """WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    e AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS next FROM d WINDOW w AS (ORDER BY doc_id DESC))
    SELECT doc_id, length(t) AS n_chars, sha256(substr(t, 1, length(t) - length(t) // 3) || substr(next, 1, length(t) // 3)) AS edited_sha256 FROM e"""
    got = edit_fingerprints(spark, spark.read.parquet(f"{folder}/documents.parquet"))
    assert difference(got.select("doc_id", "n_chars", "edited_sha256"), connect(folder), sql) == ""
