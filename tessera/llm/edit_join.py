"""Near texts by edit distance: bands of windows of the random walk, then verified exactly.

The walk of ``edit_sketch`` is made over a text's first half from its beginning and over its second half from its end, and
sampled at fixed steps, whose distances grow with the step. A sample is not one character but the ``width`` characters that
begin where the walk stands: two texts agree in it only if their walks are in step there, so unlike texts hardly ever agree.
Where text has moved further than a walk catches up with, neither helps; so walks also begin anew at ``marks`` places of the
text's own choosing, those with the smallest hash of the following characters in each of as many classes of hashes.
Each sample and each eighth mark is a band. Texts of like length that share a band and, from ``LONG`` characters on,
have equal marks in ``least`` of the text's eighths are nominated: one that only shares a passage has them in fewer.

Nominated texts are joined to components, and inside a component all such pairs are verified by their true edit distance
(bit-parallel, on whole texts, one against many at a time). Equal texts are one throughout. Large buckets and components
are cut by length, compared in pairs of blocks, and pairs never leave a task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, runs, byte_batches, spread, text_key
from .edit_sketch import SAMPLES, Embedder, code_points, scale_of
from .graph import components, stars
from .jaccard import in_size_classes

#: Texts of fewer characters are nominated by any band; a walk's samples in each doubling of the step.
LONG, PER_DOUBLING, MARKS, PARTS = 256, 2, 128, 8
#: Of windows: characters, the lengths of the texts that have them, the steps they reach, marks. A pair of short texts at 0.9
#: may have no 12 characters in a row in common, and texts of fewer than 10 none but equal ones.
KINDS = ((12, 65, 1 << 62, 1 << 22, MARKS), (5, 10, 72, 1 << 7, MARKS // 2))
#: Bits that one text is compared with at a time.
AT_ONCE = 1 << 18
#: Longer texts are compared in a band about the diagonal, one with one.
BANDED = 4096
#: Larger buckets are compared in blocks, the others' pairs on their own.
SMALL = 8
#: Prints that one task compares, of each side; they are short.
TOGETHER = 1024
#: Bytes of texts that are walked together.
WALKED = 4 << 20


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, a column of the matrix at a time as bit vectors of vertical differences."""
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    whole, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = whole, 0, len(a)
    for c in b:
        match = where.get(c, 0)
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = down | (whole & ~(diagonal | up)), up & diagonal
        score += bool(right & last) - bool(left & last)
        right, left = (right << 1 | 1) & whole, left << 1 & whole
        up, down = left | (whole & ~(diagonal | right)), right & diagonal
    return score


def similarity(a: str, b: str) -> float:
    """1 less the edit distance over the longer length; 1 for two empty texts."""
    return 1 - edit_distance(a, b) / max(1, len(a), len(b))


def common(a: str, b: str) -> int:
    """Length of the common beginning, by halving."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def near(a: str, b: str, threshold: float) -> bool:
    """Whether the similarity is ``threshold`` or more. What two texts begin and end with alike costs no distance."""
    longest = max(1, len(a), len(b))
    if abs(len(a) - len(b)) > (1 - threshold) * longest + 1e-9:
        return False
    k = common(a, b)
    a, b = a[k:], b[k:]
    k = common(a[::-1], b[::-1])
    return 1 - edit_distance(a[: len(a) - k], b[: len(b) - k]) / longest >= threshold - 1e-12


def distances(b: str, many: list[str], most: np.ndarray) -> np.ndarray:
    """Edit distances of ``b`` to each of ``many``, as ``edit_distance`` has them; where one is over ``most``, that or any
    other number over it. The bit vectors of all lie in one, with a bit between them that carries end in."""
    if len(many) == 1:
        a = many[0]
        k = common(a, b)
        a, c = a[k:], b[k:]
        k = common(a[::-1], c[::-1])
        a, c = a[: len(a) - k], c[: len(c) - k]
        if min(len(a), len(c)) < 64:
            return np.array([edit_distance(a, c)])
        return np.array([_in_band(a, c, int(most[0]))]) if max(len(a), len(c)) > BANDED else _distances(c, [a], most)
    return _distances(b, many, most)


def shown(a: str, b: str, most: int, width: int = 12) -> int:
    """Edits of one way to turn ``a`` into ``b``, so the distance or more: runs that both have go on as far as they do, and
    the next one begins with the next ``width`` characters that are found again. A number over ``most`` if none is that cheap."""
    i = j = total = 0
    while total <= most:
        step = 32
        while (k := common(a[i : i + step], b[j : j + step])) == step:
            i, j, step = i + step, j + step, 2 * step
        i, j = i + k, j + k
        if i == len(a) or j == len(b):
            return total + len(a) - i + len(b) - j
        for reach, span in ((64, 64), (most - total + 1, most - total)):
            for skip in range(min(reach, len(a) - width - i + 1)):
                at = b.find(a[i + skip : i + skip + width], j, j + skip + span + width)
                if at >= 0:
                    break
            else:
                continue
            break
        else:
            return total + (edit_distance(a[i:], b[j:]) if len(a) - i <= 4 * width + most // 8 and len(b) - j <= 4 * width + most // 8 else most + 1)
        total += edit_distance(a[i : i + skip], b[j:at])
        i, j = i + skip, at
    return total


def _in_band(a: str, b: str, most: int) -> int:
    """The edit distance if it is ``most`` or less, else a larger number: of the matrix only the diagonals from which the end is
    still within ``most``. The vectors move down by a row with each column; the score is that of the lowest diagonal, then of
    the last row. It ends when a column and the way that is left from it cost more."""
    if len(a) < len(b):
        a, b = b, a
    more = len(a) - len(b)
    if more > most or len(a) <= most:
        return most + 1 if len(a) > most else edit_distance(a, b)
    above, below = (most - more) // 2, (most + more) // 2
    full, top = (1 << (above + below + 1)) - 1, 1 << (above + below)
    up, down, score, row, codes = full ^ ((1 << above) - 1), 0, below, top >> 1, code_points(a)
    left_over = np.abs(np.arange(-above, below + 1) - more)
    chunk = max(1024, len(b) // 12, most // 2)
    for start in range(0, len(b), chunk):
        if above < start <= len(a) - below:
            steps = _bits(up, above + below) - _bits(down, above + below)
            column = score - np.concatenate([np.cumsum(steps[::-1])[::-1], [0]])
            if (column + left_over).min() > most:
                return most + 1
        low = start - above
        part, some = codes[max(0, low) : start + chunk + below + 1], b[start : start + chunk]
        where = {x: _number(part == ord(x)) << max(0, -low) for x in set(some)}  # the band's part of the text
        for j, c in enumerate(some):
            match = where[c] >> j & full
            diagonal = ((((match & up) + up) ^ up) | match | down) & full
            right, left = down | (full & ~(diagonal | up)), up & diagonal
            if start + j < len(a) - below:
                score += not diagonal & top
            else:
                score += bool(right & row) - bool(left & row)
                row >>= 1
            diagonal >>= 1
            up, down = left | (full & ~(diagonal | right)), diagonal & right
    return score


def _bits(x: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer((x & ((1 << n) - 1)).to_bytes(n // 8 + 1, "little"), np.uint8), bitorder="little", count=n).astype(np.int32)


class Bounds:
    """Texts' counts of grams, for pairs that are too far apart to be worth their distance: an edit takes and makes ``WIDTH``
    grams at most. Grams whose hashes agree are counted as one, which only makes texts more alike."""

    WIDTH, PLACES = 4, 1024

    def __init__(self, texts: list[str]):
        self.texts, self.counts = texts, None

    def far(self, i: int, other: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Of which of the others text i is surely further away than ``most`` says."""
        if self.counts is None:
            grams = [Windows.grams(code_points(t), self.WIDTH) if len(t) >= self.WIDTH else np.zeros(0, np.uint64) for t in self.texts]
            self.counts = np.stack([np.bincount((g >> np.uint64(54)).astype(np.int64), minlength=self.PLACES) for g in grams]).astype(np.int32)
        return np.abs(self.counts[other] - self.counts[i]).sum(axis=1) > 2 * self.WIDTH * most


def _number(bits: np.ndarray) -> int:
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def _distances(b: str, many: list[str], most: np.ndarray) -> np.ndarray:
    size = np.array([len(a) for a in many])
    begin = np.concatenate([[0], np.cumsum(size + 1)])
    codes = np.full(begin[-1], 0x110000, np.uint32)
    for at, a in zip(begin, many):
        codes[at : at + len(a)] = code_points(a)
    bits = np.ones(len(codes), bool)
    bits[begin[1:] - 1] = False
    whole, firsts = _number(bits), np.zeros(len(codes), bool)
    firsts[begin[:-1]] = True
    first = _number(firsts & bits)
    where = {c: _number(codes == ord(c)) for c in set(b)}

    def steps(up: int, down: int) -> np.ndarray:
        get = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(len(codes) // 8 + 1, "little"), np.uint8), bitorder="little", count=len(codes)).astype(np.int32)
        return get(up) - get(down)

    up, down, look = whole, 0, min(len(b), 2 * int(most.max()) + 8)
    for j, c in enumerate(b, 1):
        match = where[c]
        diagonal = (((match & up) + up) ^ up) | match | down
        right, left = down | (whole & ~(diagonal | up)), up & diagonal
        right, left = (right << 1 | first) & whole, left << 1 & whole
        up, down = left | (whole & ~(diagonal | right)), right & diagonal
        if j == look and j < len(b):  # what a column and the way that is left cost at least
            sums = np.concatenate([[0], np.cumsum(steps(up, down))])
            row = np.arange(len(codes)) - np.repeat(begin[:-1], size + 1)
            at = sums[:-1] - np.repeat(sums[begin[:-1]], size + 1) + j
            bound = np.minimum.reduceat(at + np.abs(np.repeat(size, size + 1) - row - (len(b) - j)), begin[:-1])
            alive = np.flatnonzero(bound <= most)
            if len(alive) <= len(many) // 2:
                if len(alive):
                    bound[alive] = _distances(b, [many[k] for k in alive], most[alive])
                return bound
    sums = np.concatenate([[0], np.cumsum(steps(up, down))])
    return len(b) + sums[begin[1:]] - sums[begin[:-1]]


def linked_of(texts: list[str], asked: np.ndarray, threshold: float) -> np.ndarray:
    """Which of the pairs asked for are near. A text's distances to two others bound the distance of those."""
    size = np.array([len(t) for t in texts], np.int64)
    most = np.floor((1 - threshold) * np.maximum(1, np.maximum(size[:, None], size[None, :])) + 1e-9).astype(np.int64)
    like = np.abs(size[:, None] - size[None, :]) <= most
    wait = asked & like
    out = np.zeros_like(wait)
    count, known, far, gain = wait.sum(axis=1), np.zeros(0, np.int64), np.zeros(0, np.int64), 0
    bounds = Bounds(texts)
    for turn in range(len(texts)):
        if not count.any():
            break
        # of a text's many copies the one that all were made from is nearest to any of them, and bounds the most
        at = np.flatnonzero(count[known])
        i = int(known[at[far[at].argmin()]]) if len(at) else int(count.argmax())
        other = np.flatnonzero(wait[i] | (like[i] & (count > 0)))
        if gain <= 0 and (turn >= 3 or 2 * count[i] < len(other)):  # those not asked for only serve as bounds
            other = np.flatnonzero(wait[i])
        other = other[other != i]
        far, rest = most[i, other] + 1, np.flatnonzero(~bounds.far(i, other, most[i, other]))
        if size[i] > BANDED:  # a bound that is low enough will do
            far[rest] = [shown(texts[i], texts[j], int(most[i, j])) for j in other[rest]]
            rest = rest[far[rest] > most[i, other[rest]]]
            far[rest] = [distances(texts[i], [texts[j]], most[i, [j]])[0] for j in other[rest]]
        elif len(rest):
            some, per = other[rest], max(1, AT_ONCE // (int(size[other[rest]].max()) + 1))
            far[rest] = np.concatenate([distances(texts[i], [texts[j] for j in some[k : k + per]], most[i, some[k : k + per]]) for k in range(0, len(some), per)])
        gain = -len(other)
        met = far <= most[i, other]
        out[i, other] |= wait[i, other] & met
        out[other, i] = out[i, other]
        wait[i] = wait[:, i] = False
        known, far = other[met], far[met]
        both = np.ix_(known, known)
        sure, sums, gaps = wait[both], far[:, None] + far[None, :], np.abs(far[:, None] - far[None, :])
        out[both] |= sure & (sums <= most[both])
        wait[both] &= (sums > most[both]) & ((gaps <= most[both]) | (size[i] > BANDED))
        gain += int(sure.sum() - wait[both].sum()) // 2
        count = wait.sum(axis=1)
    return out


class Windows:
    """A text's bands, and its length, marks and the eighths of the text that they stand in."""

    def __init__(self) -> None:
        self.embed = Embedder()
        self.steps = []
        for *_, reach, _ in KINDS:
            all_ = np.unique(np.round(24 * (2.0 ** (np.arange(32 * PER_DOUBLING) / PER_DOUBLING) - 1)).astype(np.int64))
            self.steps.append(all_[all_ < reach])

    @staticmethod
    def grams(codes: np.ndarray, width: int) -> np.ndarray:
        """Hashes of all ``width`` characters in a row, from hashes of one, two, four and so on."""
        out, done, power, h = None, 0, 1, codes.astype(np.uint64) + np.uint64(1)
        while True:
            if width & power:
                out = h if out is None else Windows._joined(h, out, power)
                done += power
            if done == width:
                out = out * np.uint64(0xC2B2AE3D27D4EB4F)
                return out ^ out >> np.uint64(31)
            h, power = Windows._joined(h, h, power), 2 * power

    @staticmethod
    def _joined(a: np.ndarray, b: np.ndarray, by: int) -> np.ndarray:
        n = min(len(a), len(b) - by)
        x = (a[:n] * np.uint64(0x9E3779B97F4A7C15) ^ b[by : by + n]) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ x >> np.uint64(32)

    def of(self, text: str) -> tuple[np.ndarray, bytes]:
        return next(self.of_all([text]))

    def of_all(self, texts: list[str]) -> Iterator[tuple[np.ndarray, bytes]]:
        many = [code_points(t) for t in texts]
        halves = [h for c in many for h in (c[: (len(c) + 1) // 2], c[(len(c) + 1) // 2 :][::-1])]
        ends = self.embed.walks(halves)
        for k, codes in enumerate(many):
            yield self._of(codes, ends[2 * k : 2 * k + 2] if len(codes) >= KINDS[1][1] else [])

    def _of(self, codes: np.ndarray, ends: list[np.ndarray]) -> tuple[np.ndarray, bytes]:
        n, bands = len(codes), []
        values, parts = np.zeros(MARKS, np.uint16), np.zeros(MARKS, np.uint8)
        for kind, (width, low, high, _, marks) in enumerate(KINDS):
            if not low <= n <= high:
                continue
            g = self.grams(codes, width)
            for back, reached in enumerate(ends):
                own = np.flatnonzero(self.steps[kind] < reached[-1])
                at = np.searchsorted(reached, self.steps[kind][own], "right") - 1
                at = n - width - at if back else at
                inside = (at >= 0) & (at < len(g))
                bands.append(g[at[inside]] ^ _mixed(own[inside] * 8 + kind * 4 + back))
            shift = np.uint64(65 - marks.bit_length())
            classes, ordered = (g >> shift).astype(np.int64), np.sort(g)
            least = ordered[np.minimum(np.searchsorted(ordered, np.arange(marks, dtype=np.uint64) << shift), len(g) - 1)]
            of = np.flatnonzero(least >> shift == np.arange(marks, dtype=np.uint64))
            at = np.flatnonzero(g == least[classes])[::-1]  # so that of equal windows the first one's place stays
            bands.append((least[of] ^ _mixed(of * 8 + kind * 4 + 2))[of % 8 == 0])
            if not kind:
                values[of] = (least[of] & np.uint64(0xFFFF)).astype(np.uint16) | np.uint16(1)
                parts[classes[at]] = at * PARTS // len(g)
        return np.concatenate(bands) if bands else np.zeros(0, np.uint64), n.to_bytes(4, "big") + values.tobytes() + parts.tobytes()


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)


def together(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """The same rows in larger batches, each of ``most`` bytes and one batch more at most."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= most:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def prints(docs: DataFrame) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows()
        for b in together(batches, WALKED):
            texts = b.column(2).to_pylist()
            found = windows.of_all([t for t in texts if t is not None])
            keys, bands, out = [], [], []
            for text in texts:
                own, told = (None, None) if text is None else next(found)
                keys.append(None if text is None else xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63))
                bands.append(None if text is None else own.view(np.int64))
                out.append(told)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.int64()), pa.array(out, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "_row", "_set", "_print", "_bands"])

    rows = docs.select(F.col("doc_id").cast("long"), text_key("doc_id", "text"), F.col("text").cast("string"))
    return spread(rows).mapInArrow(work, "doc_id long, _row long, _set long, _print binary, _bands array<long>")


def alike(embed: Embedder, prints_of: list[str], side: np.ndarray, least: float) -> np.ndarray:
    """Which pairs have a likeness of ``least`` or more, as ``Embedder.likeness`` has it: a row of the matrix at a time, the
    row's text being the longer one."""
    n = np.array([int(p[:8], 16) for p in prints_of])
    scale = np.array([scale_of(int(x)) for x in n])
    bits = np.unpackbits(np.frombuffer(bytes.fromhex("".join(p[8:] for p in prints_of)), np.uint8)).reshape(len(n), 2, SAMPLES).astype(np.float32) * 2 - 1
    out = np.zeros((len(n), len(n)), bool)
    for i in range(len(n)):
        for half in (0, 1):  # texts of the same scale, and of the one below
            small = scale[i] >> half
            other = np.flatnonzero((n <= n[i]) & (scale == small))
            inside = int(np.searchsorted(embed.share * (2 * small), 2 * n[i]))
            if len(other) and inside:
                score = np.maximum(0, bits[other, 0, :inside] @ bits[i, half, :inside] / inside) * min(1.0, small / max(1, n[i]))
                out[i, other[score >= least - 1e-6]] = True
    same = np.array(prints_of)
    out |= same[:, None] == same[None, :]
    out |= out.T
    if side.any():
        out &= side[:, None] != side[None, :]
    np.fill_diagonal(out, False)
    return out


def _parsed(prints_of: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(prints_of), np.uint8).reshape(len(prints_of), 4 + 3 * MARKS)
    n = np.ascontiguousarray(raw[:, :4]).view(">i4")[:, 0].astype(np.int64)
    return n, np.ascontiguousarray(raw[:, 4 : 4 + 2 * MARKS]).view(np.uint16), raw[:, 4 + 2 * MARKS :]


def fitting(prints_of: list[bytes], side: np.ndarray, threshold: float, least: int) -> np.ndarray:
    """Which pairs are of like length and, if both are long, have equal marks in ``least`` of the longer text's eighths."""
    n, values, parts = _parsed(prints_of)
    order = np.argsort(n, kind="stable")
    n, values, parts, side = n[order], values[order], parts[order], side[order]
    first = np.searchsorted(n, n - (1 - threshold) * np.maximum(1, n) - 1e-9)
    sought = np.where(values > 0, values, np.uint16(2))  # marks are odd, so that what is missing equals nothing
    out, both = np.zeros((len(n), len(n)), bool), side.any()
    for i in range(len(n)):
        low = first[i]
        if low == i:
            continue
        equal = values[low:i] == sought[i]
        some = np.flatnonzero(equal.view(np.uint64).any(axis=1) | (n[low:i] < LONG))
        if both:
            some = some[side[low + some] != side[i]]
        if len(some):
            met = equal[some].astype(np.float32) @ (parts[i][:, None] == np.arange(PARTS)).astype(np.float32)
            out[i, low + some] = ((met > 0).sum(axis=1) >= least) | (n[low + some] < LONG)
    back = np.empty_like(order)
    back[order] = np.arange(len(order))
    out = (out | out.T)[np.ix_(back, back)]
    return out


def dealt(rows: DataFrame) -> DataFrame:
    """Tasks together, over so many partitions that all cores compare: their rows are few for the time that they take."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(parts, "_task").sortWithinPartitions("_task")


def chars() -> Column:
    """The length of a text, from the first four bytes of ``_print``."""
    return F.conv(F.hex(F.substring("_print", 1, 4)), 16, 10).cast("int")


def one_of_alike(state: DataFrame) -> DataFrame:
    """_label, _size of the buckets of two sets or more, one of all that hold the same sets: the others' pairs are its own."""
    held = state.groupBy("_label").agg(F.count(F.lit(1)).alias("_size"), F.bit_xor(F.xxhash64("_set")).alias("_members")).where("_size > 1")
    return held.groupBy("_size", "_members").agg(F.min("_label").alias("_label")).select("_label", "_size")


def pairs_of(rows: DataFrame, threshold: float) -> DataFrame:
    """a, b: the pairs of like length that share a bucket (_label), once each."""
    a, b = (rows.select("_label", F.col("_set").alias(x), F.col("_chars").alias(f"_{x}")) for x in "ab")
    longer = F.greatest("_a", "_b", F.lit(1))
    met = a.join(b, "_label").where((F.col("a") < F.col("b")) & (F.abs(F.col("_a") - F.col("_b")) <= (1 - threshold) * longer + 1e-9))
    return met.select("a", "b").distinct()


def check_pairs(pairs: DataFrame, told: DataFrame, threshold: float, least: int) -> DataFrame:
    """Those of the pairs (a, b) that ``fitting`` has, by the sets' prints."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                (n, values, parts), (m, others, spots) = (_parsed(b.column(k).to_pylist()) for k in (2, 3))
                equal = (values == others) & (values > 0)
                parts = np.where((n >= m)[:, None], parts, spots)
                fits = (np.sum([(equal & (parts == k)).any(axis=1) for k in range(PARTS)], axis=0) >= least) | (np.minimum(n, m) < LONG)
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(fits)) for c in b.columns[:2]], ["a", "b"])

    one, two = (told.select(F.col("_set").alias(x), F.col("_print").alias(f"_{x}")) for x in "ab")
    return pairs.join(one, "a").join(two, "b").select("a", "b", "_a", "_b").mapInArrow(work, "a long, b long")


def nominate(rows: DataFrame, threshold: float, least: int) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, "_task"):
            a, b = stars(fitting(group["_print"].to_pylist(), group["_side"].to_numpy(), threshold, least), group["_set"].to_numpy())
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt(rows).mapInArrow(work, "a long, b long")


def verify(rows: DataFrame, threshold: float, least: int) -> DataFrame:
    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in runs(batches, "_task"):
            ids, copies, texts = group["_set"].to_numpy(), group["_copies"].to_numpy(), group["_text"].to_pylist()
            linked = linked_of(texts, fitting(group["_print"].to_pylist(), group["_side"].to_numpy(), threshold, least), threshold)
            links = linked @ copies
            some = np.flatnonzero(links)
            if len(some):
                a, b = stars(linked, ids)
                ends = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(b, pa.int64())])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([ids[some], a])), ends, pa.array(np.concatenate([links[some], np.zeros(len(a), np.int64)]).astype(np.int64))], ["a", "b", "links"])

    return dealt(rows).mapInArrow(work, "a long, b long, links long")


def edit_classes(spark: SparkSession, docs: DataFrame, threshold: float = 0.9, least: int = 3) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest doc_id of those it is linked to, directly or through others)
    and links (other documents whose edit similarity is ``threshold`` or more; copies count).

    A pair of ``LONG`` characters or more is verified if it has equal marks in ``least`` of ``PARTS`` parts of the text; a
    pair that no band brings together, directly or through others, is missed. The windows are for thresholds about 0.9.
    A null text is linked to nothing; empty texts are copies; a very long one is compared whole. Rows that repeat are
    copies; of ids the smallest names a class. Columns but doc_id and text are not read, so they may have any name; an
    empty table gives an empty result.
    """
    byte_batches(spark)
    scratch = Scratch(spark, "edits")
    told = scratch.save(prints(docs), "told")
    sets = told.where("_set is not null").groupBy("_set").agg(F.first(F.struct("_print", "_bands")).alias("_told"), F.min("doc_id").alias("_first"), F.min("_row").alias("_row"), F.count(F.lit(1)).alias("_copies"))
    sets = scratch.save(sets.select("_set", "_told.*", "_first", "_row", "_copies"), "sets")
    told = scratch.save(told.select("doc_id", "_set"), "members")
    scratch.drop("told")
    state = sets.select("_set", chars().alias("_chars"), F.explode("_bands").alias("_label"))
    state = scratch.save(state.join(one_of_alike(state), "_label"), "buckets")
    few = pairs_of(state.where(F.col("_size") <= SMALL), threshold)
    few = scratch.save(check_pairs(scratch.save(few, "pairs"), sets.select("_set", "_print"), threshold, least), "few")
    many = state.where(F.col("_size") > SMALL).drop("_size")
    rows = in_size_classes(many, scratch, threshold, ["_set"], F.col("_chars"), TOGETHER).join(sets.select("_set", "_print"), "_set")
    groups = components(scratch.save(nominate(rows, threshold, least), "met").unionByName(few), scratch, "met-all")
    scratch.drop("buckets", "pairs")
    wanted = sets.drop("_bands").join(groups.select(F.col("node").alias("_set"), F.col("label").alias("_label")), "_set")
    texts = docs.where(F.col("text").isNotNull()).select(text_key("doc_id", "text").alias("_row"), F.col("text").cast("string").alias("_text"))
    whole = scratch.save(texts.join(wanted, "_row").dropDuplicates(["_set"]), "whole")
    rows = in_size_classes(whole, scratch, threshold, ["_set", "_copies", "_print", "_text"], F.length("_text"))
    found = scratch.save(verify(rows, threshold, least), "found")
    labels = components(found.where("b is not null").select("a", "b"), scratch, "linked").select(F.col("node").alias("_set"), F.col("label").alias("_class"))
    links = found.where("b is null").groupBy(F.col("a").alias("_set")).agg(F.sum("links").alias("_links"))
    named = sets.select("_set", "_first", "_copies").join(labels, "_set", "left").join(links, "_set", "left").withColumn("_class", F.coalesce("_class", "_set"))
    ids = named.groupBy("_class").agg(F.min("_first").alias("class_id"))
    named = scratch.save(named.join(ids, "_class").select("_set", "class_id", (F.col("_copies") - 1 + F.coalesce("_links", F.lit(0))).alias("links")), "classes")
    own = F.col("_set").isNull()
    return told.select("doc_id", "_set").join(named, "_set", "left").select("doc_id", F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
