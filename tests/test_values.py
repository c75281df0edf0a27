import random
import unicodedata
import uuid
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from clauselake import catalog
from clauselake.functions import display, ids, text, values

C = F.col


def column(spark, rows, expression):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, t string")
    return [r[1] for r in df.select("i", expression).orderBy("i").collect()]


def test_decimals_in_both_notations(spark):
    cases = {
        "1.000,50": "1000.50", "1,000.50": "1000.50", "R$ 1.000.000,00": "1000000.00", "1.000": "1.000", "1,000": "1.000",
        "4% ou 5%": "45", "-5": "-5", ".5": "0.5", "1.": "1", "007": "7", "1.000.000": None, "": None, "-": None, "12-5": None, "abc": None,
    }
    assert column(spark, list(cases), values.number_text(C("t"))) == list(cases.values())
    parsed = column(spark, list(cases), values.parse_decimal(C("t")))
    assert parsed == [None if v is None else Decimal(v) for v in cases.values()]


def test_money_rounds_half_up(spark):
    assert column(spark, ["0.005", "-0.005", "0.0049999999999", "2,345"], values.parse_money(C("t"))) == [
        Decimal("0.01"), Decimal("-0.01"), Decimal("0.00"), Decimal("2.35"),
    ]


def test_dates(spark):
    cases = {
        "2025-01-01": date(2025, 1, 1), " 1/2/2025 ": date(2025, 2, 1), "01-02-2025": date(2025, 2, 1),
        "31/02/2025": None, "001/2/2025": None, "01/02-2025": None, "0000-01-01": None, "2025/01/01": None,
    }
    assert column(spark, list(cases), values.parse_date(C("t"))) == list(cases.values())


def folded(t):
    plain = "".join(c for c in unicodedata.normalize("NFKD", t.strip().lower()) if not unicodedata.combining(c))
    return " ".join(plain.split()) or None


def test_fold_equals_unicode_rule_on_latin_text(spark):
    rng = random.Random(7)
    alphabet = [chr(c) for c in [*range(32, 127), *range(0xA0, 0x250), 0x2026, 0xFB01, 0xBD, 0x2122, 0x301, 9, 10]]
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(200)]
    assert column(spark, rows, text.fold(C("t"))) == [folded(r) for r in rows]
    assert column(spark, rows, text.fold_exact(C("t"))) == [folded(r) for r in rows]


def test_fold_equals_unicode_rule_on_every_assigned_character(spark):
    assigned = [c for c in map(chr, [*range(1, 0xD800), *range(0xE000, 0x110000)]) if unicodedata.category(c) not in ("Cn", "Co")]
    rows = [f"x{c}Y {c}" for c in assigned] + assigned
    assert column(spark, rows, text.fold(C("t"))) == [folded(r) for r in rows]


def test_fold_of_mixed_scripts(spark):
    rng = random.Random(11)
    pools = [range(0xAC00, 0xD7A4), range(0xFB50, 0xFE00), range(0x1D400, 0x1D800), range(0x3300, 0x3400), range(0x2460, 0x2500), range(32, 127), range(0x300, 0x370)]
    rows = ["".join(chr(rng.choice(rng.choice(pools))) for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = ["".join(c for c in r if unicodedata.category(c) != "Cn") for r in rows]
    assert column(spark, rows, text.fold(C("t"))) == [folded(r) for r in rows]
    assert column(spark, [None, "", " ", "한국어 약관", "㍿ ﷺ ①"], text.fold(C("t"))) == [None, None, None, folded("한국어 약관"), folded("㍿ ﷺ ①")]


def normalized(spark, kind, value):
    df = spark.createDataFrame([(kind, value)], "k string, v string")
    raw = values.parse_value(C("k"), C("v"))
    return df.select(values.normalize_value(C("k"), raw).alias("n"), values.value_pairs(C("k"), values.normalize_value(C("k"), raw)).alias("p")).first()


@pytest.mark.parametrize(
    ("kind", "value", "pairs"),
    [
        ("money", '{"amount": "R$ 1.234,5", "currency": "usd"}', "amount=1234.50, currency=USD"),
        ("money", '"R$ 10"', "amount=10.00, currency=BRL"),
        ("money", '{"amount": 1, "currency": null}', None),
        ("money", '{"amount": 1, "currency": "REAL"}', None),
        ("number", "30", "number=30"),
        ("number", "true", None),
        ("date", '{"date": "1/2/2025"}', "date=2025-02-01"),
        ("period", '"de 01/01/2025 a 2026-01-01"', "duration_days=365, end=2026-01-01, start=2025-01-01"),
        ("period", '"01/01/2025"', None),
        ("period", '{"start": "2026-01-01", "end": "2025-01-01"}', None),
        ("text", '{"text": "  Améríca   do Sul "}', "text=america do sul"),
        ("text", '{"text": "   "}', None),
        ("money", "null", None),
    ],
)
def test_normalisation(spark, kind, value, pairs):
    assert normalized(spark, kind, value)["p"] == pairs


def test_typed_text_keeps_currency_of_the_original(spark):
    original = F.struct(F.lit("USD").alias("currency"), F.lit(None).cast("string").alias("unit"))
    raw = values.raw_from_text(F.lit("money"), C("t"), original)
    assert column(spark, ["100"], raw["currency"]) == ["USD"]


def test_conversion_to_brl(spark):
    df = spark.createDataFrame([("USD", "2.00", "5.255"), ("BRL", "2.00", None), ("EUR", "2.00", None), ("EUR", "2.00", "0")], "c string, a string, r string")
    brl = values.to_brl(C("a").cast("decimal(38,2)"), C("c"), C("r").cast("decimal(18,8)"))
    assert [r[0] for r in df.select(brl).collect()] == [Decimal("10.51"), Decimal("2.00"), None, None]


def test_uuid5_equals_the_standard_library(spark):
    namespace = uuid.UUID(catalog.UUID_NAMESPACE)
    names = [f"nome {i} ç" for i in range(50)]
    assert column(spark, names, ids.uuid5(C("t"))) == [str(uuid.uuid5(namespace, n)) for n in names]


def test_display(spark):
    shown = column(spark, ["1234567.5", "-1234.567", "0.10", "5"], display.decimal_br(C("t")))
    assert shown == ["1.234.567,5", "-1.234,567", "0,1", "5"]
    assert column(spark, ["1234.5"], display.decimal_br(C("t"), 2)) == ["1.234,50"]
    assert column(spark, ["FOUND", "OUTRO"], display.status_label(C("t"))) == ["encontrado", "OUTRO"]


def test_text_helpers(spark):
    assert column(spark, ["/x/Apólice Um (v2).PDF", "...", "a.b.pdf"], text.policy_id_from_filename(C("t"))) == ["ap_lice_um_v2", "apolice", "a_b"]
    assert column(spark, [" x ", " ", "N/A"], text.clean_optional(C("t"), null_words=True)) == ["x", None, None]
    assert column(spark, ["a \n b", "x" * 200], text.snippet(C("t"))) == ["a b", "x" * 160 + "…"]


def test_catalog_is_complete(spark):
    assert [len(catalog.FIELD_TABLE), len(catalog.REPORT_FIELD_TABLE), len(catalog.CHECKLIST), len(catalog.STOPWORDS)] == [10, 90, 14, 38]
    assert sum(float(r[1]) for r in catalog.RANKING_CRITERIA) == 100
    assert {sum(w) for w in catalog.SENSITIVITY_SCENARIOS.values()} == {105.0}
    assert [r["unit"] for r in catalog.list_fields(spark).orderBy("ordinal").collect()][4] == "dias"
