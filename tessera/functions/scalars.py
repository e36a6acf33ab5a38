"""Scalar functions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_value(c: Column, form: str | None) -> Column:
    """currency, number, date or datetime as text; anything else as it prints. Null stays null."""
    if form == "currency":
        return F.concat(F.when(c < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(c), 2))
    if form == "number":
        return F.format_number(c, 2)
    if form == "date":
        return F.date_format(c, "yyyy-MM-dd")
    if form == "datetime":
        return F.date_format(c, "yyyy-MM-dd HH:mm")
    return c.cast("string")


def display(c: Column, kind: str) -> Column:
    """Text for a screen: null is empty, lists are joined by commas."""
    if kind.startswith("array"):
        return F.coalesce(F.array_join(c.cast("array<string>"), ", "), F.lit(""))
    if kind == "date":
        return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit(""))
    if kind.startswith("timestamp"):
        return F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss'Z'"), F.lit(""))
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_html(c: Column) -> Column:
    """Without anything between < and >, an unclosed tag included, nor any stray >."""
    return F.replace(F.regexp_replace(c, "<[^>]*>?", ""), F.lit(">"), F.lit(""))


def tokens(c: Column) -> Column:
    """Distinct lower-case runs of letters and digits."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{Nd}]+)"), F.lit(1)))


def count_byte(c: Column, char: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(char), F.lit("")))


def composite_key(*parts: Column) -> Column:
    """Each part after its length, so no two lists of parts share a key."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat_ws("|", *[F.concat(F.length(t).cast("string"), F.lit(":"), t) for t in texts])


#: Fixed values of the 32-bit FNV-1a hash.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def fnv1a_32(c: Column) -> Column:
    """FNV-1a over the code units of ASCII text, as an unsigned number in a long."""
    codes = F.transform(F.split(c, ""), lambda x: F.ascii(x).cast("long"))
    step = lambda h, x: F.pmod(h.bitwiseXOR(x) * F.lit(FNV_PRIME), F.lit(1 << 32))
    return F.when(c == "", F.lit(FNV_BASIS).cast("long")).otherwise(F.aggregate(codes, F.lit(FNV_BASIS).cast("long"), step))


#: Fixed value of the Castagnoli polynomial, bits reversed.
CASTAGNOLI = 0x82F63B78


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = (n >> 1) ^ (CASTAGNOLI if n & 1 else 0)
        out.append(n)
    return out


def crc32c(c: Column) -> Column:
    """CRC-32C of the UTF-8 bytes of a text, as an unsigned number in a long."""
    pairs = F.regexp_extract_all(F.hex(F.encode(c, "UTF-8")), F.lit("(..)"), F.lit(1))
    codes = F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("long"))
    table = F.lit(_crc_table()).cast("array<long>")
    step = lambda h, b: F.get(table, h.bitwiseXOR(b).bitwiseAND(F.lit(255)).cast("int")).bitwiseXOR(F.shiftright(h, 8))
    return F.aggregate(codes, F.lit(0xFFFFFFFF).cast("long"), step, lambda h: h.bitwiseXOR(F.lit(0xFFFFFFFF)))


def split_list(c: Column) -> Column:
    """Comma-separated values, trimmed, blanks dropped."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def slug(c: Column) -> Column:
    """A name with capitals as a lower-case, dashed one."""
    apart = F.regexp_replace(F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1-$2"), "[^A-Za-z0-9]+", "-")
    return F.lower(F.regexp_replace(apart, "^-+|-+$", ""))


def spaced(c: Column) -> Column:
    return F.regexp_replace(c, "([a-z0-9])([A-Z])", "$1 $2")


def plural(c: Column) -> Column:
    """English plural by ending: consonant and y to ies; s, x, z, ch, sh take es."""
    low = F.lower(c)
    return F.when(low.rlike("[^aeiou]y$"), F.concat(F.regexp_replace(c, "[yY]$", ""), F.lit("ies"))).when(low.rlike("(s|x|z|ch|sh)$"), F.concat(c, F.lit("es"))).otherwise(F.concat(c, F.lit("s")))


MONTHS = {"Monthly": 1, "Quarterly": 3, "Yearly": 12}
DAYS = {"Hourly": 1, "Daily": 1, "Weekly": 7}


def date_advance(start: Column, period: str, today: Column) -> Column:
    """The first step of ``period`` after ``today``. Month steps compound: a clamped day stays clamped."""
    if period in DAYS:
        n = DAYS[period]
        late = F.greatest(F.lit(0), F.datediff(today, start))
        return F.when(start > today, start).otherwise(F.date_add(start, (F.floor(late / n).cast("int") + 1) * n))
    n = MONTHS[period]
    steps = F.greatest(F.lit(0), F.ceil(F.months_between(today, start) / n).cast("int") + 2)
    walk = F.aggregate(F.sequence(F.lit(0), steps), start, lambda d, _: F.when(d > today, d).otherwise(F.add_months(d, n).cast("date")))
    return F.when(start > today, start).otherwise(walk)


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Great-circle distance on a sphere of 6371 km."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(2 * 6371.0) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def _sum_of(a: Column, b: Column, f) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), f), F.lit(0.0), lambda t, x: t + x)


def dot(a: Column, b: Column) -> Column:
    return _sum_of(a, b, lambda x, y: x * y)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 less the cosine; 1 if either vector is zero."""
    return F.coalesce(1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(1.0))


def dot_distance(a: Column, b: Column) -> Column:
    return -dot(a, b)


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(_sum_of(a, b, lambda x, y: (x - y) * (x - y)))


DISTANCES = {"cosine": cosine_distance, "dot": dot_distance, "l2": l2_distance}
