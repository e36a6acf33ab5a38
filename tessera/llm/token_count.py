"""Token counts under a unigram vocabulary, without the tokens.

An Aho-Corasick automaton lists every vocabulary match of a text; a dynamic programme over end positions carries the
best score and the number of pieces of its path. Ties follow the unigram tokenizers: candidates are taken by ascending
start and only a strictly better one replaces the path so far, so the longest last piece wins. A character that no
single-character piece covers may be unknown, at ten below the lowest score, and then counts as its UTF-8 bytes.

Segments between spaces repeat, so each worker remembers their counts. That changes nothing as long as no piece runs
over a space into the next word and scores are whole numbers (sums are then exact); otherwise whole texts are solved.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_batches, spread

SPACE = "▁"


def vocabulary_of(model_file: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    m = SentencePieceProcessor(model_file=model_file)
    return [(m.id_to_piece(i), m.get_score(i)) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))]


class Counter(dict):
    """Segment to (pieces); forgets all when it grows too large, which changes no value."""

    def __init__(self, vocabulary: list[tuple[str, float]], byte_fallback: bool = True, most: int = 100_000):
        import ahocorasick

        super().__init__()
        self.most, self.byte_fallback = most, byte_fallback
        self.matches = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.matches.add_word(piece, (len(piece), float(score)))
        if vocabulary:
            self.matches.make_automaton()
        self.known = bool(vocabulary)
        self.unknown = min((float(s) for _, s in vocabulary), default=0.0) - 10.0
        pieces = {p for p, _ in vocabulary}
        self.by_word = SPACE in pieces and byte_fallback and all(s == int(s) for _, s in vocabulary) and not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.split = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall

    def __missing__(self, segment: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[segment] = self.solve(segment)
        return n

    def solve(self, segment: str) -> int:
        best, count, fused = [0.0], [0], [False]
        found = self.matches.iter(segment) if self.known else iter(())
        now = next(found, None)
        for end, char in enumerate(segment):
            top, n, single, unk = None, 0, False, False
            while now is not None and now[0] == end:  # the longest match comes first
                size, score = now[1]
                start = end + 1 - size
                if top is None or best[start] + score > top:
                    top, n = best[start] + score, count[start] + 1
                single |= size == 1
                now = next(found, None)
            if not single and (top is None or best[end] + self.unknown > top):
                top, unk = best[end] + self.unknown, True
                n = count[end] + (len(char.encode()) if self.byte_fallback else not fused[end])
            best.append(top)
            count.append(n)
            fused.append(unk)
        return count[-1]

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        text = SPACE + text.replace(" ", SPACE)
        return sum(map(self.__getitem__, self.split(text))) if self.by_word else self.solve(text)


def token_counts(spark: SparkSession, docs: DataFrame, model_file: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id column and n_tokens (long).

    A null or empty text has 0 tokens; a very long one is counted whole, run by run between white space where the pieces
    allow that. Repeated rows each give a row, a null id stays null, and an empty table gives an empty result. Columns but
    the id and the text are not read, so they may have any name. Scores that tie go to the longest last piece.
    """
    byte_batches(spark)
    model_file = model_file or public_tokenizers.path("piece_bpe_32k.model")
    kept = spread(docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")))

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary_of(model_file))
        for b in batches:
            n = [counter.count(t.as_py()) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], [id_col, "n_tokens"])

    return kept.mapInArrow(work, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long")
