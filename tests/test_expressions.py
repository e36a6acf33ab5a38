import datetime

import pytest
from pyspark.sql import functions as F

from tessera.functions import scalars as sc
from tessera.functions import validation as va
from tessera.functions.formula import Node, calculated, formula, parse, to_script
from tessera.functions.structured import Build, field, item, lit, param, x
from tessera.operators import actions as ac


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(2, 3.5, "ab", None, "4"), (None, -1.25, "", True, "no")], "a int, b double, s string, t boolean, n string")


@pytest.mark.parametrize(
    "text, want",
    [
        ("1 + 2 * 3", [7, 7]), ("(1 + 2) * 3", [9, 9]), ("-a + b", [1.5, -1.25]), ("a + n", ["24", "no"]), ("a * n", [8, 0]), ("7 % 4 - 1", [2, 2]),
        ("Round(2.5)", [2, 2]), ("round(3.5)", [4, 4]), ("Round(1.125, 2)", [1.12, 1.12]), ("Min(a, 1, b)", [1, -1.25]), ("MAX(a, 1)", [2, 1]), ("Abs(b)", [3.5, 1.25]),
        ("If(a > 1, 'yes', 'no')", ["yes", "no"]), ("If(s, 1, 2)", [1, 2]), ("s + '-' + a", ["ab-2", "-"]), ("a >= 2", [True, False]), ("'x' == 'y'", [True, True]), ("a != 0", [True, False]),
        ("10 / 4", [2.5, 2.5]), ("If(t, 1, 0)", [0, 1]), ('"it\\"s" + 1', ['it"s1', 'it"s1']), ("2 - 3 - 4", [-5, -5]), ("null + 1", None),
    ],
)
def test_formula(df, text, want):
    got = [r.v for r in df.select(formula(df, text).alias("v")).collect()]
    got = [float(v) if v is not None and not isinstance(v, (bool, str)) else v for v in got]
    if want is not None:
        assert got == want
    assert Node.from_json(parse(text).to_json()) == parse(text)


@pytest.mark.parametrize("text", ["1 +", "(1", "1 < 2 < 3", "Round()", "If(1, 2)", "Nope(1)", "zzz + 1", "1 @ 2", "Min(1)", ""])
def test_formula_errors(df, text):
    with pytest.raises(ValueError):
        formula(df, text)


def test_division_by_zero_is_an_error(df):
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|ivision by zero"):
        df.select(formula(df, "1 / (a - a)")).collect()


def test_calculated_order_and_cycles(df):
    out = calculated(df, {"z": "y * 2", "y": "a + 1"}).first()
    assert float(out.z) == 6
    with pytest.raises(ValueError, match="cycle"):
        calculated(df, {"p": "q", "q": "p"})


def test_structured(df):
    b = Build(df, {"k": 2})
    got = df.select(
        b(x("div", lit(5), lit(0))).alias("zero"), b(x("mod", lit(5), lit(0))).alias("mod0"), b(x("add", field("a"), lit(1))).alias("nul"), b(x("eq", field("s"), lit("AB"))).alias("case"),
        b(x("eq", field("a"), lit(None))).alias("none"), b(x("lt", field("a"), lit(0))).alias("low"), b(x("and", field("s"), param("k"))).alias("true"), b(x("if", x("not", field("t")), lit(1), lit(2))).alias("cond"),
    ).collect()
    assert [tuple(r) for r in got] == [(0.0, 0.0, 3.0, False, False, False, True, 1), (0.0, 0.0, None, False, True, True, False, 2)]
    with pytest.raises(ValueError):
        b(param("missing"))


def test_lists_and_actions(spark):
    df = spark.createDataFrame([(1, 10.0, [(1, 2.0), (2, 5.0)]), (2, 0.0, [])], "id int, total double, items array<struct<n:int,q:double>>")
    b = Build(df)
    got = df.select(*[b(x(f, item("q"), value="items")).alias(f) for f in ("sum", "count", "max", "avg")], b(x("all", x("gt", item("q"), lit(1)), value="items")).alias("all")).collect()
    assert tuple(got[0]) == (7.0, 2, 5.0, 3.5, True) and tuple(got[1]) == (0.0, 0, None, None, False)
    seq = ac.apply(df, [ac.ForEach("items", "total", x("add", field("total"), item("q")), running=True)]).collect()
    last = ac.apply(df, [ac.ForEach("items", "total", x("add", field("total"), item("q")))]).collect()
    assert [r.total for r in seq] == [17.0, 0.0] and [r.total for r in last] == [15.0, 0.0]
    kept = ac.apply(df, [ac.Assert(x("gt", field("total"), lit(5)), "low"), ac.Set("total", lit(1))]).collect()
    assert [(r.total, r.problems) for r in kept] == [(1.0, []), (0.0, ["error: low"])]


def test_scalars(spark):
    d = lambda t: F.lit(t).cast("date")
    one = spark.range(1).select(
        sc.strip_html(F.lit("a<b>c</b>d > e <open")).alias("html"), sc.format_value(F.lit(-1234.5), "currency").alias("money"), sc.composite_key(F.lit("ab"), F.lit(None)).alias("key"),
        sc.date_advance(d("2024-01-31"), "Monthly", d("2024-03-01")).alias("month"), sc.date_advance(d("2024-01-01"), "Daily", d("2024-01-05")).alias("day"), sc.date_advance(d("2024-06-01"), "Yearly", d("2024-01-05")).alias("later"),
        sc.slug(F.lit("OrderLine Item")).alias("slug"), sc.plural(F.lit("box")).alias("plural"), sc.tokens(F.lit("It's 2 cats, CATS")).alias("tokens"), sc.fnv1a_32(F.lit("a")).alias("fnv"),
        sc.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"), sc.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0)).alias("half"),
    ).first()
    assert (one.html, one.money, one.key) == ("acd  e ", "-$1,234.50", "2:ab|0:")
    assert one.month == datetime.date(2024, 3, 29) and one.day == datetime.date(2024, 1, 6) and one.later == datetime.date(2024, 6, 1)
    assert (one.slug, one.plural, one.tokens, one.fnv, one.zero) == ("order-line-item", "boxes", ["it", "s", "2", "cats"], 0xE40C292C, 1.0)
    assert abs(one.half - 6371 * 3.14159265) < 0.01


def test_crc32c(spark):
    def plain(text):
        h = 0xFFFFFFFF
        for b in text.encode():
            h ^= b
            for _ in range(8):
                h = (h >> 1) ^ (sc.CASTAGNOLI if h & 1 else 0)
        return h ^ 0xFFFFFFFF

    rows = spark.createDataFrame([("123456789",), ("",), ("naïve ¿?",)], "t string").select("t", sc.crc32c(F.col("t")).alias("crc")).collect()
    assert rows[0].crc == 0xE3069283 and all(r.crc == plain(r.t) for r in rows)


def test_validation(spark):
    df = spark.createDataFrame([("a@b.co", "+1 555 123 4567", "https://x.y/z", "ab"), ("nope", "call", "ftp://x", "abcdef"), ("", None, "", "")], "mail string, tel string, url string, s string")
    rules = {"mail": va.email(F.col("mail")), "tel": va.phone(F.col("tel")), "url": va.url(F.col("url")), "len": va.length(F.col("s"), 1, 3), "rule": va.rule(df, "nothing > 1")}
    assert [r.errors for r in va.validate(df, rules).collect()] == [[], ["mail", "tel", "url", "len"], []]


def test_phone_numbers_of_any_script(spark):
    tel = ["+1\t(555) 123.45-67", "٠١٢٣٤٥٦٧", "12 34", "1234567x", "1" * 21]
    df = spark.createDataFrame([(t,) for t in tel], "t string")
    assert [r.ok for r in df.select(va.phone(F.col("t")).alias("ok")).collect()] == [True, True, False, False, False]


def test_leading_points_and_scripts(spark):
    assert spark.range(1).select(formula(spark.range(1), ".5 + 1.25").cast("double")).first()[0] == 1.75
    assert to_script(parse("-x.y + 'a' % .25 != True")) == "((-parseFieldValue('x.y') + ('a' % 0.25)) != true)"
    assert to_script(parse("RelatedLookup(a, 'b')"), read="get") == "await relatedLookup(get('a'), 'b')"
    with pytest.raises(ValueError):
        to_script(parse("nothing(1)"))
