"""Rule tests on small hand-made frames."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tipflow.functions import columns as C
from tipflow.operators import text as T


def one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_s1_period_bounds(spark):
    rows = [(dt.datetime(2024, 1, 31, 0, 0),), (dt.datetime(2024, 1, 31, 15, 0),), (dt.datetime(2024, 2, 1, 0, 0),)]
    closed = one(spark, C.in_period("t", "2024-01-01", "2024-01-31", "closed", "timestamp"), rows, "t timestamp")
    nextm = one(spark, C.in_period("t", "2024-01-01", "2024-01-31", "next_midnight", "timestamp"), rows, "t timestamp")
    half = one(spark, C.in_period("t", "2024-01-01", "2024-01-31", "half_open", "timestamp"), rows, "t timestamp")
    assert closed == [True, False, False]      # BETWEEN drops most of the last day
    assert nextm == [True, True, True]         # <= end + 1 day keeps next midnight
    assert half == [True, True, False]


def test_s2_distinct_from(spark):
    got = one(spark, C.distinct_from("s", "C"), [(None,), ("C",), ("A",)], "s string")
    assert got == [True, False, True]


def test_s3_c2_status_precedence(spark):
    rows = [("paid", "C"), ("SETTLED", None), (None, "C"), (None, "E"), ("canceled", None),
            ("EXPIRED", None), ("waiting", None), (None, None)]
    got = one(spark, C.batch_status("cs", "bs"), rows, "cs string, bs string")
    assert got == ["pago", "pago", "cancelado", "erro", "cancelado", "vencido", "pendente", "pendente"]


def test_d7_list_and_badge(spark):
    rows = [("expired", None, True), (None, "E", True), (None, None, False), ("waiting", None, False)]
    # a cancelled charge of a live invoice reads as waiting; a paid one wins over a cancelled batch
    more = spark.createDataFrame([("canceled", None, True), ("paid", "C", True), ("canceled", None, False)],
                                 "cs string, bs string, has boolean")
    assert [r[0] for r in more.select(C.badge_status("cs", "bs", "has")).collect()] == [
        "Aguardando pagamento", "Pago", "Sem boleto"]
    df = spark.createDataFrame(rows, "cs string, bs string, has boolean")
    got = df.select(C.list_status("cs", "bs", "has").alias("l"), C.badge_status("cs", "bs", "has").alias("b")).collect()
    assert [r.l for r in got] == ["cancelado", "pendente", "cancelado", "pendente"]
    assert [r.b for r in got] == ["Vencido", "Erro no boleto", "Sem boleto", "Aguardando pagamento"]


def test_s5_rounding_is_decimal_half_up(spark):
    df = spark.createDataFrame([(Decimal("100.50"), Decimal("1.0000"), "D")], "g decimal(18,2), r decimal(9,4), t string")
    service, charge, movement = C.fee_split("g", "r", "t")
    row = df.select(service.alias("s"), charge.alias("c"), movement.alias("m")).first()
    assert row.s == Decimal("1.01")            # 1.005 -> 1.01 (HALF_UP), not the double 1.00
    assert row.c == Decimal("100.50") and row.m == Decimal("99.49")


def test_d4_invariant_charge_minus_service(spark):
    rows = [(Decimal("1234.57"), Decimal("7.5000"), "D"), (Decimal("99.99"), Decimal("3.0000"), "A"),
            (Decimal("10.00"), None, "")]
    df = spark.createDataFrame(rows, "g decimal(18,2), r decimal(9,4), t string")
    s, c, m = C.fee_split("g", "r", "t")
    for row in df.select("t", "g", s.alias("s"), c.alias("c"), m.alias("m")).collect():
        if row.t == "A":
            assert row.c - row.s == row.m == row.g
        else:
            assert row.c - row.s == row.m and row.c == row.g


def test_s6_cpf_pad_never_shortens(spark):
    got = one(spark, C.pad_cpf("d"), [("123",), ("12345678901",), ("123456789012",), ("",)], "d string")
    assert got == ["00000000123", "12345678901", "123456789012", ""]


def test_s7_leading_number(spark):
    got = one(spark, C.leading_number("v"), [("12abc",), ("1.234,56",), ("-5",), ("abc",), (" 7.5 ",), ("1e3",)],
              "v string")
    assert got == [12.0, 1.234, -5.0, None, 7.5, 1000.0]


def test_cpf_check_digits(spark):
    rows = [("529.982.247-25",), ("52998224725",), ("52998224724",), ("000.000.000-00",), ("11111111111",),
            ("1234",), (None,)]
    got = one(spark, C.cpf_valid("c"), rows, "c string")
    assert got == [True, True, False, False, False, False, False]


def test_s16_birth_dates(spark):
    rows = [("32874",), ("05/01/1990",), ("5/1/90",), ("5/1/20",), ("1990-01-05",), ("31/02/1990",), ("abc",)]
    got = one(spark, C.parse_birth_date("b"), rows, "b string")
    assert got[0] == dt.date(1990, 1, 1)
    assert got[1] == dt.date(1990, 1, 5) and got[2] == dt.date(1990, 1, 5)
    assert got[3] == dt.date(2020, 1, 5) and got[4] == dt.date(1990, 1, 5)
    assert got[5] is None and got[6] is None


def test_h1_masks(spark):
    df = spark.createDataFrame([("rafael@x.com", "(11) 98765-4321"), ("a@b", "123"), ("nodomain", None)],
                               "e string, p string")
    got = df.select(T.mask_email("e").alias("e"), T.mask_phone("p").alias("p")).collect()
    assert [r.e for r in got] == ["r*****@x.com", "a*@b", None]
    assert [r.p for r in got] == ["*******4321", None, None]


def test_h2_phone(spark):
    df = spark.createDataFrame([("11987654321",), ("551198765432",), ("123",), ("1198765432",)], "p string")
    num, reason = T.phone_e164("p")
    got = df.select(num.alias("n"), reason.alias("r")).collect()
    assert [(r.n, r.r) for r in got] == [("5511987654321", None), (None, "not_mobile"),
                                         (None, "invalid_length"), (None, "not_mobile")]


def test_h3_ascii_fold(spark):
    got = one(spark, T.ascii_fold("s"), [("Ação — “ok” ‘x’… ß\nfim",)], "s string")
    assert got == ["Acao - \"ok\" 'x'... fim"]


def test_h4_h5_formats(spark):
    df = spark.createDataFrame([("12345678901", "11987654321", "12345678000199", Decimal("1234.5"), "ana maria silva")],
                               "cpf string, ph string, cnpj string, v decimal(18,2), n string")
    r = df.select(T.format_cpf("cpf").alias("a"), T.format_phone("ph").alias("b"), T.format_cnpj("cnpj").alias("c"),
                  T.format_brl("v").alias("d"), T.initials("n").alias("e")).first()
    assert r.a == "123.456.789-01" and r.b == "(11) 9 8765-4321" and r.c == "12.345.678/0001-99"
    assert r.d == "R$\u00a01.234,50" and r.e == "AM"


def test_s9_search_guard(spark, tmp_path):
    from tipflow.operators.people import collaborators_all
    from tipflow.sources.mart import mart
    m = mart(spark, "/root/testdata/sf0.001")
    guarded = collaborators_all(m, "zzz-no-match", limit=500).count()
    legacy = collaborators_all(m, "zzz-no-match", legacy_digits=True, limit=500).count()
    assert guarded == 0 and legacy > 0        # '%%' on digits matches everyone in the literal form


def test_month_label_pt(spark):
    got = one(spark, C.month_label_pt("d"), [(dt.date(1999, 3, 1),)], "d date")
    assert got == ["março de 1999"]


def test_page_clamp_and_global_page(spark):
    from tipflow.operators.topups import clamped_page, page
    df = spark.range(0, 1200).withColumn("cli_id", F.col("id") % 2)
    assert clamped_page(0, None) == (50, 0)          # 0 is "not given": default 50
    assert clamped_page(-5, -1) == (1, 0)
    assert clamped_page(10_000, 7) == (500, 7)
    assert page(df, ["id"], limit=1000, per=None).count() == 1000      # a page is as large as asked for
    with pytest.raises(ValueError):
        page(df, ["id"], limit=0)
    rows = page(df, [F.desc("id")], limit=3, offset=2, per=None).collect()
    assert [r.id for r in rows] == [1197, 1196, 1195]
    per_tenant = page(df, ["id"], limit=2, offset=1, per="cli_id").collect()
    assert sorted(r.id for r in per_tenant) == [2, 3, 4, 5]


def test_default_dashboard_period():
    from tipflow.operators.dashboard import default_period
    assert default_period("2000-03-01") == ("2000-01-31", "2000-03-01")


def test_div_round2_has_no_double_rounding(spark):
    # 36290.50 * 17906453.40 / 18087326.67 = 35927.59499990... -> 35927.59 (one rounding)
    df = spark.createDataFrame([(Decimal("36290.50"), Decimal("17906453.40"), Decimal("18087326.67")),
                                (Decimal("1.00"), Decimal("1.00"), Decimal("8.00")),        # 0.125 -> 0.13
                                (Decimal("10.00"), Decimal("1.00"), Decimal("3.00"))],      # 3.333 -> 3.33
                               "a decimal(18,2), b decimal(18,2), g decimal(20,2)")
    got = [r[0] for r in df.select(C.div_round2(F.col("a") * F.col("b"), F.col("g"))).collect()]
    exact = [(Decimal("36290.50") * Decimal("17906453.40") / Decimal("18087326.67"))]
    assert exact[0] < Decimal("35927.595")
    assert got == [Decimal("35927.59"), Decimal("0.13"), Decimal("3.33")]
