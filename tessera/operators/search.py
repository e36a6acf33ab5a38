"""Text search over tokens: inverted (first tier that hits), prefix, suffix and substring."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.scalars import tokens

SHORTEST = 3
#: Tiers of the inverted search, best first.
EXACT, PREFIX, SUFFIX, PART = range(4)


def words(text: str) -> list[str]:
    out: list[str] = []
    for w in "".join(c if c.isalnum() else " " for c in text.lower()).split():
        if w not in out:
            out.append(w)
    return out


def postings(df: DataFrame, key: str, *fields: str) -> DataFrame:
    """key, token: each token of a row once."""
    text = F.concat_ws(" ", *[F.col(f).cast("string") for f in fields])
    return df.select(key, F.explode(tokens(text)).alias("token"))


def _tier(token: Column, wanted: str) -> Column:
    long = len(wanted) >= SHORTEST
    out = F.when(token == wanted, EXACT)
    if long:
        out = out.when(token.startswith(wanted), PREFIX).when(token.endswith(wanted), SUFFIX)
    return out.when(token.contains(wanted), PART)


def inverted(df: DataFrame, key: str, fields: list[str], text: str) -> DataFrame:
    """Keys of rows that any query word finds; each word takes only its best tier over all rows.

    Two passes over the rows: one for the best tier of each word, a row a word, and one for the keys of its hits."""
    asked = words(text)
    if not asked:
        return df.select(key).limit(0)
    token = F.col("token")
    hits = postings(df, key, *fields)
    each = F.filter(F.array(*[F.struct(F.lit(w).alias("word"), _tier(token, w).alias("tier")) for w in asked]), lambda h: h["tier"].isNotNull())
    hits = hits.select(key, F.explode(each).alias("h")).select(key, "h.word", "h.tier")
    best = hits.groupBy("word").agg(F.min("tier").alias("tier"))  # one row a query word
    return hits.join(F.broadcast(best), ["word", "tier"]).select(key).distinct()


def _any(df: DataFrame, key: str, fields: list[str], text: str, test) -> DataFrame:
    asked = words(text)
    if not asked:
        return df.select(key).limit(0)
    tokens_of = tokens(F.concat_ws(" ", *[F.col(f).cast("string") for f in fields]))
    hit = F.exists(tokens_of, lambda t: reduce(lambda a, b: a | b, [test(t, w) for w in asked]))
    return df.where(F.coalesce(hit, F.lit(False))).select(key).distinct()


def prefix(df: DataFrame, key: str, fields: list[str], text: str) -> DataFrame:
    """Exact words, and beginnings of at least three letters."""
    return _any(df, key, fields, text, lambda t, w: t.startswith(w) if len(w) >= SHORTEST else t == w)


def suffix(df: DataFrame, key: str, fields: list[str], text: str) -> DataFrame:
    return _any(df, key, fields, text, lambda t, w: t.endswith(w) if len(w) >= SHORTEST else t == w)


def ordered(df: DataFrame, key: str, fields: list[str], text: str) -> DataFrame:
    """Words that equal or begin with the text."""
    return _any(df, key, fields, text, lambda t, w: t.startswith(w))


def substring(df: DataFrame, key: str, fields: list[str], text: str) -> DataFrame:
    return _any(df, key, fields, text, lambda t, w: t.contains(w))


#: A membership filter in front of the same test changes no result; Parquet's own bloom filters serve at the scan.
KINDS = {"inverted": inverted, "prefix": prefix, "suffix": suffix, "btree": ordered, "treap": substring, "bloom": substring}


def search(df: DataFrame, key: str, fields: list[str], text: str, kind: str = "inverted") -> DataFrame:
    if kind not in KINDS:
        raise ValueError(f"unknown index kind {kind!r}")
    return KINDS[kind](df, key, fields, text)


def all_of(df: DataFrame, key: str, *steps: DataFrame) -> DataFrame:
    """Rows whose keys every step has found."""
    return reduce(lambda d, s: d.join(s.select(key).distinct(), key, "left_semi"), steps, df)


def any_of(key: str, *steps: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), [s.select(key) for s in steps]).distinct()
