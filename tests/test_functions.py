import datetime as dt
import decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlight.functions import codes, dates, identity, money, text


def values(spark, expr, rows, schema="c string"):
    df = spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema)
    return [r[0] for r in df.select(expr).collect()]


def test_gtin(spark):
    got = values(spark, codes.normalize_gtin(F.col("c")), ["036000291452", "0036000291452", "036000291453", "12", "", None, "abc"])
    assert got == ["0036000291452", "0036000291452", None, None, None, None, None]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("0123456789", min_size=12, max_size=13), min_size=1, max_size=20))
def test_gtin_against_a_loop(spark, given_codes):
    def valid(code):
        return sum(int(d) * (3 if i % 2 else 1) for i, d in enumerate(reversed(code))) % 10 == 0

    assert values(spark, codes.normalize_gtin(F.col("c")), given_codes) == [c.zfill(13) if valid(c) else None for c in given_codes]


@pytest.mark.parametrize(("raw", "want"), [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("239,00 €", 239.0), ("1.234", 1234.0), ("12.5", 12.5), ("gratis", None), ("", None), (None, None)])
def test_parse_price(spark, raw, want):
    assert values(spark, money.parse_price(F.col("c")), [raw]) == [want]


def test_money_is_exact_and_refuses_thousands(spark):
    got = values(spark, money.money(F.col("c")), ["9,50", "0.1", "1.234,5", "x", " -3 "])
    assert got == [decimal.Decimal("9.500000"), decimal.Decimal("0.100000"), None, None, decimal.Decimal("-3.000000")]


def test_decimal_text(spark):
    assert values(spark, money.decimal_text(F.col("c").cast("decimal(38,6)")), ["9.5", "10", "0.125"]) == ["9.50", "10.00", "0.125"]


def test_half_up(spark):
    assert values(spark, money.half_up(F.col("c").cast("decimal(18,4)")), ["2.345", "2.3449"]) == [decimal.Decimal("2.3500"), decimal.Decimal("2.3400")]
    assert values(spark, money.half_up(F.col("c").cast("decimal(18,4)"), "0.5"), ["2.25", "2.2"]) == [decimal.Decimal("2.5000"), decimal.Decimal("2.0000")]


def test_vat_and_backoff(spark):
    rows = [(121.0, 100.0), (110.0, 100.0), (104.0, 100.0), (115.0, 100.0), (1.0, 0.0)]
    assert values(spark, money.infer_vat(F.col("a"), F.col("b")), rows, "a double, b double") == [21, 10, 4, None, None]
    assert values(spark, money.backoff_seconds(F.col("c")), [0, 1, 5, 20], "c int") == [60, 120, 1920, 3600]


@pytest.mark.parametrize("told", ["54□21", "54-21", "54/21", "54 21", "AB 54 □ 21 C"])
def test_caliber(spark, told):
    assert values(spark, codes.normalize_caliber(F.col("c")), [told]) == ["54-21"]


def test_written_date_has_no_zone_shift(spark):
    got = values(spark, dates.written_date(F.col("c")), ["2026-01-02T23:45:00-05:00", "03/02/2026 10:00:00", "no", None])
    assert got == [dt.date(2026, 1, 2), dt.date(2026, 2, 3), None, None]


def test_price_states(spark):
    now = F.lit("2025-01-15 00:00:00").cast("timestamp_ntz")
    got = values(spark, dates.price_state(F.col("c").cast("timestamp_ntz"), now), ["2025-01-10", "2025-01-05", "2024-12-01", "2025-02-01", None])
    assert got == ["current", "last_known", "expired", "expired", "expired"]


def test_text_helpers(spark):
    assert values(spark, text.identity_key(F.col("c")), ["Ray-Bán 3025", None]) == ["RAYBAN3025", ""]
    assert values(spark, text.model_key(F.col("c")), ["FT1234S", "FT1234"]) == ["FT1234", "FT1234"]
    assert values(spark, text.zero_padded(F.col("c"), 6), ["0012", "12", "x", "000"]) == ["000012", "000012", None, "000000"]
    assert values(spark, text.slug(F.col("c")), ["¡Óptica & más!"]) == ["optica-mas"]
    assert values(spark, text.view_of_file(F.col("c")), ["a__b__V2.jpg", "a__v1__x.png", "plain.jpg"]) == ["V2", "V1", None]
    assert values(spark, text.canonical_url(F.col("c")), ["http://a/b?utm_source=x&page=2#top"]) == ["http://a/b?page=2"]
    assert values(spark, text.spans(F.split("c", " "), 2), ["a b c"]) == [["a", "b", "c", "ab", "bc"]]
    assert values(spark, text.html_escape(F.col("c")), ["<a href='x'>&"]) == ["&lt;a href=&#x27;x&#x27;&gt;&amp;"]


def test_reference_spellings_agree(spark):
    parsed = identity.parse_reference(F.col("c"), ["Bvlgari"])
    got = values(spark, parsed, ["Bvlgari BV1274S 005 54-21", "bvlgari bv1274s-005 54/21", "BVLGARI BV1274S/005 54□21"])
    assert len({tuple(g) for g in got}) == 1 and tuple(got[0]) == ("BVLGARI", "BV1274S", "005", "54-21")


def test_natural_order_of_long_codes(spark):
    told = ["8056597000001", "8056597000009", "08056597000010", "14056597000001", "9", "a10b", "a9b", "A09C", "", None]
    got = values(spark, text.natural_key(F.col("c")), told)
    assert len(set(got[:4])) == 4 and sorted(got[:5]) == [got[4], got[0], got[1], got[2], got[3]]
    assert sorted(got[5:8]) == [got[6], got[7], got[5]] and got[8] == got[9] == ""
    assert values(spark, text.zero_padded(F.col("c")), ["0123456789012345", "1234567890123456"]) == ["123456789012345".zfill(14), "1234567890123456"]


def test_folding_is_that_of_the_decomposition(spark):
    import unicodedata

    told = ["Łódź őšč", "Ñandú", "ﬁ ĳ ™", "e\u0301", "ｆｕｌｌ", "Ǆ", "中 ø", "54□21×3"]
    want = ["".join(x for x in unicodedata.normalize("NFKD", t.replace("□", "x").replace("×", "x")) if x.isascii()) for t in told]
    assert values(spark, text.ascii_fold(F.col("c")), told) == want
