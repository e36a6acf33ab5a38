import random

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from tessera.llm.token_count import SPACE, Counter, token_counts, vocabulary_of

VOCABULARY = [(SPACE, -3.0), ("a", -2.0), ("b", -2.0), ("ab", -4.0), ("ba", -3.0), ("aba", -6.0), ("bab", -5.0), (SPACE + "a", -5.0), (SPACE + "ab", -7.0), ("c", -1.0)]


def brute(text, vocabulary):
    """Every start for every end, by ascending start; a strictly better one replaces."""
    text = SPACE + text.replace(" ", SPACE)
    known, worst = dict(vocabulary), min(s for _, s in vocabulary) - 10
    best = [(0.0, 0)] + [None] * len(text)
    for end in range(1, len(text) + 1):
        for start in range(end):
            piece = text[start:end]
            options = [(known[piece], 1)] if piece in known else [(worst, len(piece.encode()))] if end - start == 1 else []
            for score, n in options:
                if best[end] is None or best[start][0] + score > best[end][0]:
                    best[end] = (best[start][0] + score, best[start][1] + n)
    return best[-1][1]


@settings(max_examples=300, deadline=None)
@given(st.text("ab cé", max_size=14))
def test_brute_force(text):
    assert Counter(VOCABULARY).count(text) == (brute(text, VOCABULARY) if text else 0)


def test_ties_as_the_library():
    byte = [(f"<0x{k:02X}>", -50.0) for k in range(256)]
    plain = Tokenizer(Unigram([("<unk>", 0.0), *VOCABULARY, *byte], 0, True))
    rng = random.Random(2)
    low = [*VOCABULARY, ("<0x00>", -50.0)]  # the library's lowest score counts its byte pieces
    counter = Counter(low)
    for _ in range(500):
        text = "".join(rng.choice("ab cé") for _ in range(rng.randrange(1, 20)))
        assert counter.count(text) == len(plain.encode(SPACE + text.replace(" ", SPACE)).ids), text


def test_whole_vocabulary_by_word_and_whole():
    vocabulary = vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))
    by_word, whole = Counter(vocabulary), Counter(vocabulary)
    whole.by_word = False
    assert by_word.by_word
    for text in ("The quick  brown fox", "  two   three    four ", "naïve\nline\t数据 🙂", "a" * 300, "x▁y"):
        assert by_word.count(text) == whole.count(text)


def test_pieces_over_a_space_are_solved_whole():
    vocabulary = [*VOCABULARY, ("a" + SPACE + "b", -1.0)]
    counter = Counter(vocabulary)
    assert not counter.by_word and counter.count("a b") == brute("a b", vocabulary)


def test_rows(spark):
    rows = [(1, "ab ab", 9), (2, None, 9), (3, "", 9), (None, "ab", 9), (1, "ab ab", 9), (4, "ab " * 30_000, 9)]
    out = token_counts(spark, spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    found = sorted(((r.doc_id or 0), r.n_tokens) for r in out)
    assert len(out) == 6 and found[0][0] == 0 and {n for d, n in found if d in (2, 3)} == {0}
    assert len({n for d, n in found if d == 1}) == 1
    assert token_counts(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
