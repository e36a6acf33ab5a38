import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm.substring import GEAR, LONGEST, Powers, chunks, dedupe_passages, digests, gear


def text_of(rng, n):
    return " ".join("".join(rng.choice("abcdefghijé") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def raw_of(text):
    return np.frombuffer(text.encode(), np.uint8)


def test_gear_equals_the_recurrence():
    raw = np.random.default_rng(1).integers(0, 256, 300, dtype=np.uint8)
    h, want = 0, []
    for b in raw:
        h = (2 * h + int(GEAR[b])) & 0xFFFF
        want.append(h)
    assert gear(raw)[16:].tolist() == want[16:]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=400))
def test_chunks_cover_and_keep_characters(text):
    raw = raw_of(text)
    starts, ends = chunks(raw)
    assert "".join(raw[a:b].tobytes().decode() for a, b in zip(starts, ends)) == text


def test_long_texts_without_words_are_cut():
    starts, ends = chunks(raw_of("é" * 5000))
    assert (ends - starts).max() <= 2 * LONGEST and (ends > starts).all()


def test_digests_know_content_not_place():
    rng = random.Random(2)
    passage = text_of(rng, 60)
    a, b = raw_of(text_of(rng, 40) + " " + passage), raw_of("Ünlike " + text_of(rng, 77) + " " + passage + " end")
    powers = Powers()
    x, y = (digests(r, *chunks(r), powers) for r in (a, b))
    parts = {raw[s:e].tobytes(): d for raw, dd in ((a, x), (b, y)) for s, e, d in zip(*chunks(raw), dd)}
    assert len(set(parts.values())) == len(parts)
    assert len(set(x) & set(y)) >= 5


def test_passages_go_and_clean_texts_stay(spark):
    rng = random.Random(3)
    rows, planted, clean = [], {}, {}
    for p in range(15):
        passage = text_of(rng, 55)
        for k in range(4):
            d = 100 * p + k
            rows.append((d, text_of(rng, 60) + "\n" + passage + "\n" + text_of(rng, 30)))
            planted[d] = (passage, k)
    for k in range(40):
        clean[5000 + k] = text_of(rng, 80) + "\nLicensed under the Apache License, Version 2.0."
        rows.append((5000 + k, clean[5000 + k]))
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, _row string")
    out = {r.doc_id: r for r in dedupe_passages(spark, df).collect()}
    assert len(out) == len(rows)
    for d, (passage, k) in planted.items():
        old = dict(rows)[d]
        assert (out[d].text == old) if k == 0 else (passage not in out[d].text and out[d].sub_removed > 100)
        assert len(old) - len(out[d].text) == out[d].sub_removed
        kept, upto = b"", 0
        for s in out[d].sub_spans:
            kept, upto = kept + old.encode()[upto : s["start"]], s["end"]
        assert (kept + old.encode()[upto:]).decode() == out[d].text
    assert all(out[d].text == t for d, t in clean.items())


def check_against_windows(old, new, short=24, long=400):
    """Every byte taken out lies in a run of ``short`` bytes that an earlier text (or place) has too; what is left of a text
    shares no run of ``long`` bytes with any earlier text. All runs of all texts, by brute force."""
    seen_short, seen_long = set(), {}
    for d in sorted(old):
        a = (old[d] or "").encode()
        for k in range(max(0, len(a) - long + 1)):
            seen_long.setdefault(hash(a[k : k + long]), d)
    for d in sorted(old):
        a, b = (old[d] or "").encode(), (new[d] or "").encode()
        own = {a[k : k + short] for k in range(max(0, len(a) - short + 1))}
        if a == b:
            seen_short |= own
        else:
            twice = {}
            for k in range(len(a) - short + 1):
                twice.setdefault(a[k : k + short], k)
            covered = [False] * len(a)
            for k in range(len(a) - short + 1):
                if a[k : k + short] in seen_short or twice[a[k : k + short]] < k:
                    covered[k : k + short] = [True] * short
            # what stays must hold every byte that is in no repeated run, in order
            at = 0
            for x, c in zip(a, covered):
                if not c:
                    at = b.find(bytes([x]), at) + 1
                    assert at > 0, d
            seen_short |= own
        for k in range(max(0, len(b) - long + 1)):
            first = seen_long.get(hash(b[k : k + long]))
            assert first is None or first >= d, (d, first, b[k : k + long])


def test_brute_force_over_all_runs(spark):
    """Texts of words, of Thai letters, of hexadecimal and of base64 digits that share passages at odd places."""
    rng = random.Random(21)
    digits = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    thai, base64 = "".join(map(chr, range(0xE01, 0xE2F))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    makers = [lambda n: text_of(rng, n // 6), lambda n: digits(thai, n // 3), lambda n: digits("0123456789abcdef", n), lambda n: digits(base64, n)]
    old = {}
    for k, make in enumerate(makers):
        passages = [make(900 + 300 * j) for j in range(3)]
        for j in range(12):
            parts = [make(rng.randrange(200, 900)), rng.choice(passages), make(rng.randrange(1, 400)), rng.choice(passages), make(rng.randrange(100, 300))]
            old[100 * k + j] = (" " if k == 0 else "").join(parts[: rng.randrange(3, 6)])
    new = {r.doc_id: r.text for r in dedupe_passages(spark, spark.createDataFrame(list(old.items()), "doc_id long, text string")).collect()}
    assert sum(len(old[d]) - len(new[d]) for d in old) > 12_000
    check_against_windows(old, new)


def test_an_insertion_moves_no_cut_but_those_beside_it():
    rng = random.Random(22)
    thai, base64 = "".join(map(chr, range(0xE01, 0xE2F))), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for letters in (thai, "0123456789abcdef", base64, "abcdefgh "):
        text = "".join(rng.choice(letters) for _ in range(8000))
        at = rng.randrange(3000, 5000)
        a, b = raw_of(text), raw_of(text[:at] + "x" + text[at:])
        own = [{r[s:e].tobytes() for s, e in zip(*chunks(r))} for r in (a, b)]
        assert len(own[0] - own[1]) <= 4 and len(own[0]) > 25


def test_odd_rows(spark):
    long = text_of(random.Random(4), 100)
    rows = [(1, None), (2, ""), (3, long), (3, long), (4, long), (None, long), (5, (text_of(random.Random(9), 90) + " ") * 2)]
    out = dedupe_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.text)
    assert by[1] == [None] and by[2] == [""] and by[3] == [long, long] and len(by[4][0]) == 0 and len(by[None][0]) == 0
    assert len(by[5][0]) < len(rows[-1][1])
    assert dedupe_passages(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_shifted_repeats_without_words_share_chunks():
    rng = random.Random(11)
    for letters in ("".join(map(chr, range(0x0E01, 0x0E2F))), "".join(map(chr, range(0x1780, 0x17A3))), "ACGT", "ABCDEFGHabcdefgh0123456789+/"):
        made = lambda n: "".join(rng.choice(letters) for _ in range(n))
        shared = total = 0
        for _ in range(20):
            passage = made(900)
            a, b = raw_of(made(300) + passage + made(200)), raw_of(made(rng.randrange(301, 700)) + passage + made(50))
            x, y = (digests(r, *chunks(r), Powers()) for r in (a, b))
            starts, ends = chunks(b)
            shared += int((ends - starts)[np.isin(y, x)].sum())
            total += len(passage.encode())
        print(f"{shared / total:.3f} of the bytes in shared chunks")
        assert shared >= 0.85 * total


def test_short_passages_go_to_their_ends(spark):
    rng = random.Random(12)
    rows, planted = [], {}
    for p in range(400):
        passage = " ".join("".join(rng.choice("abcdefghijé") for _ in range(rng.choice((4, 5, 5, 6)))) for _ in range(51))
        for k in range(2):
            # each side ends in its own character, so the passage's ends are the repeat's ends
            planted[2 * p + k] = (text_of(rng, 20) + "XY"[k], passage, "ZW"[k] + text_of(rng, 20), k)
            rows.append((2 * p + k, "".join(planted[2 * p + k][:3])))
    out = {r.doc_id: r.text for r in dedupe_passages(spark, spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    whole = [a + b + c == out[d] for d, (a, b, c, k) in planted.items() if k == 0]
    gone = [a + c == out[d] for d, (a, b, c, k) in planted.items() if k == 1]
    left = [(len(out[d]) - len(a + c)) / len(b) for d, (a, b, c, k) in planted.items() if k == 1]
    print(f"gone to the ends {sum(gone)} of {len(gone)}, untouched {sum(x >= 1 for x in left)}, share left {np.mean(left):.3f}")
    assert all(whole) and sum(gone) >= 0.995 * len(gone)


def test_different_texts_under_one_id_or_none(spark):
    rng = random.Random(13)
    passage = text_of(rng, 80)
    rows = [(d, text_of(rng, 20) + "\n" + passage + "\n" + text_of(rng, 20)) for d in [7] * 5 + [None] * 5]
    for some in (rows[:5], rows[5:], rows):
        out = [r.text for r in dedupe_passages(spark, spark.createDataFrame(some, "doc_id long, text string")).collect()]
        assert sum(passage in t for t in out) == 1
