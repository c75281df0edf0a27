"""Typed values: parsing, normalisation and comparable keys.

A raw value is one struct of strings (``RAW_VALUE``); a normalised value is one
struct for all five types (``NORMALIZED_VALUE``). Both have a fixed schema, so
normalising and comparing stay inside generated code. Anything that cannot be
read gives null, never an exception.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clauselake.catalog import CITATION_KEYS
from clauselake.functions.text import fold, is_blank, strip
from clauselake.plans.once import compute_once, let

RAW_KEYS = ["amount", "currency", "number", "unit", "date", "start", "end", "text", "value_text", *CITATION_KEYS]
RAW_VALUE = "struct<" + ",".join(f"`{key}`:string" for key in RAW_KEYS) + ">"
MONEY_TYPE = "decimal(38,2)"
NUMBER_TYPE = "decimal(38,10)"
NORMALIZED_TYPES = {
    "amount": MONEY_TYPE, "currency": "string", "number_text": "string", "number": NUMBER_TYPE, "date": "date",
    "start": "date", "end": "date", "duration_days": "int", "text": "string",
}
NORMALIZED_VALUE = "struct<" + ",".join(f"{key}:{kind}" for key, kind in NORMALIZED_TYPES.items()) + ">"
PERIOD_DATE = r"(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}-\d{2}-\d{4})"


def decimal_text(raw: Column) -> Column:
    """Plain decimal text of a number written with a comma or a point.

    With both marks the later one is the decimal mark; a lone comma or a lone
    point is the decimal mark. All other characters are dropped, so digits
    around words are joined. The text may still be no number (``1.2.3``), which
    the casts turn into null. Each step refers to the previous one once.
    """
    marks = F.regexp_replace(raw, r"[^0-9.,\-]", "")
    without_points = F.regexp_replace(marks, r"\.(?=.*,[^.]*$)", "")  # the comma comes last
    without_commas = F.regexp_replace(without_points, r",(?=.*\.)", "")  # the point comes last
    return F.translate(without_commas, ",", ".")


def parse_decimal(raw: Column) -> Column:
    return decimal_text(raw).try_cast(NUMBER_TYPE)


def parse_money(raw: Column) -> Column:
    """Amount rounded half up to cents."""
    return decimal_text(raw).try_cast(MONEY_TYPE)


def number_text(raw: Column) -> Column:
    """Number as text with its written scale: ``007`` -> ``7``, ``.5`` -> ``0.5``, ``1.`` -> ``1``."""
    valid = F.regexp_extract(decimal_text(raw), r"^(-?(?:[0-9]+(?:\.[0-9]+)?|\.[0-9]+))\.?$", 1)
    padded = F.regexp_replace(F.nullif(valid, F.lit("")), r"^(-?)(?=\.)", "$1#")
    return F.regexp_replace(F.translate(padded, "#", "0"), r"^(-?)0+(?=[0-9])", "$1")


def parse_date(raw: Column) -> Column:
    """``YYYY-MM-DD``, ``DD/MM/YYYY`` or ``DD-MM-YYYY``; day and month may have one digit."""
    iso = F.regexp_replace(strip(raw), r"^(\d{1,2})([/-])(\d{1,2})\2(\d{4})$", "$4-$3-$1")
    return F.regexp_extract(iso, r"^((?!0000)\d{4}-\d{1,2}-\d{1,2})$", 1).try_cast("date")


def _raw(**parts: Column) -> Column:
    raw = F.expr("named_struct(" + ", ".join(f"'{key}', cast(null as string)" for key in RAW_KEYS) + ")")
    for key, part in parts.items():
        raw = raw.withField(key, part.cast("string"))
    return raw


def raw_from_text(field_type: Column, text: Column, original: Column | None = None) -> Column:
    """Typed text -> raw value. Currency and unit come from the value it replaces.

    A period needs exactly two dates in the text. Blank text gives null.
    """
    original_currency = F.lit(None).cast("string") if original is None else original["currency"]
    original_unit = F.lit(None).cast("string") if original is None else original["unit"]

    def typed(given: Column) -> Column:
        dates = F.regexp_extract_all(given, F.lit(PERIOD_DATE), 1)
        period = let(
            dates, lambda found: F.when(F.size(found) == 2, _raw(start=F.get(found, F.lit(0)), end=F.get(found, F.lit(1))))
        )
        value = (
            F.when(field_type == "text", _raw(text=given))
            .when(field_type == "number", _raw(number=given, unit=original_unit))
            .when(field_type == "money", _raw(amount=given, currency=F.coalesce(original_currency, F.lit("BRL"))))
            .when(field_type == "date", _raw(date=given))
            .when(field_type == "period", period)
        )
        return F.when(~is_blank(given), value)

    return let(text, typed)


def is_object(value_json: Column) -> Column:
    return F.coalesce(F.ltrim(value_json).startswith("{"), F.lit(False))


def scalar_text(value_json: Column) -> Column:
    """Text of a JSON scalar (string unquoted, number and boolean as written); objects give null."""
    text = F.trim(value_json)
    unquoted = F.get_json_object(F.concat(F.lit('{"v":'), text, F.lit("}")), "$.v")
    return F.when(~is_object(value_json) & (text != "null"), F.coalesce(unquoted, text))


def parse_value(field_type: Column, value_json: Column) -> Column:
    """JSON value -> raw struct; scalars go through the typed-text rule."""
    null_currency = value_json.rlike(r'"currency"\s*:\s*null')
    parsed = F.from_json(value_json, RAW_VALUE)
    marked = let(parsed, lambda raw: raw.withField("currency", F.lit("NONE")))
    parsed = F.when(null_currency, marked).otherwise(parsed)  # lambdas are interpreted: only for the rows that need one
    return F.when(is_object(value_json), parsed).otherwise(raw_from_text(field_type, scalar_text(value_json)))


def _normalized(**parts: Column) -> Column:
    value = F.expr("named_struct(" + ", ".join(f"'{k}', cast(null as {t})" for k, t in NORMALIZED_TYPES.items()) + ")")
    for key, part in parts.items():
        value = value.withField(key, part.cast(NORMALIZED_TYPES[key]))
    return value


def normalized_parts(field_type: Column, raw: Column) -> Column:
    """What ``normalize_value`` reads from a raw struct, each part parsed once and only for its own type."""

    def of(kind: str, part: Column) -> Column:
        return F.when(field_type == kind, part)

    currency = of("money", F.upper(F.coalesce(raw["currency"], F.lit("BRL"))))
    parts = [
        of("money", parse_money(raw["amount"])), currency, of("number", number_text(raw["number"])),
        of("number", parse_decimal(raw["number"])), of("date", parse_date(raw["date"])),
        of("period", parse_date(raw["start"])), of("period", parse_date(raw["end"])), of("text", fold(raw["text"])),
    ]
    names = [name for name in NORMALIZED_TYPES if name != "duration_days"]
    return F.struct(*[part.alias(name) for name, part in zip(names, parts, strict=True)])


def from_parts(parts: Column) -> Column:
    """Normalised struct of ``normalized_parts``; unreadable gives null."""
    part = {name: parts[name] for name in NORMALIZED_TYPES if name != "duration_days"}
    given = {name: column.isNotNull() for name, column in part.items()}
    valid = (
        (given["amount"] & part["currency"].rlike("^[A-Z]{3}$")) | given["number"] | given["date"]
        | (part["start"] <= part["end"]) | given["text"]
    )
    return F.when(valid, _normalized(**part, duration_days=F.datediff(part["end"], part["start"])))


def normalize_value(field_type: Column, raw: Column) -> Column:
    """Raw struct -> normalised struct by field type; unreadable gives null."""
    return let(normalized_parts(field_type, raw), from_parts)


def normalize_once(df: DataFrame, name: str, field_type: Column, raw: Column, where: Column) -> DataFrame:
    """``df`` with ``normalize_value`` of the rows that fulfil ``where`` as column ``name``; parsing is compiled, unlike in ``let``."""
    parsed = compute_once(df, __parts=F.when(where, normalized_parts(field_type, raw)))
    return compute_once(parsed, **{name: from_parts(F.col("__parts"))}).drop("__parts")


def to_brl(amount: Column, currency: Column, rate: Column) -> Column:
    """Amount in BRL, half up to cents; a missing or non-positive rate gives null."""
    converted = F.when(rate > 0, F.round(amount.cast("decimal(28,2)") * rate.cast("decimal(18,8)"), 2))
    return F.when(currency == "BRL", amount).otherwise(converted.cast(MONEY_TYPE))


def value_pairs(field_type: Column, value: Column) -> Column:
    """Normalised value as ``k=v`` pairs in key order; null stays null."""

    def show(*parts: tuple[str, Column]) -> Column:
        return F.concat_ws(", ", *[F.concat(F.lit(key + "="), part.cast("string")) for key, part in parts])

    return F.when(
        value.isNotNull(),
        F.when(field_type == "money", show(("amount", value["amount"]), ("currency", value["currency"])))
        .when(field_type == "number", show(("number", value["number_text"])))
        .when(field_type == "date", show(("date", value["date"])))
        .when(
            field_type == "period",
            show(("duration_days", value["duration_days"]), ("end", value["end"]), ("start", value["start"])),
        )
        .otherwise(show(("text", value["text"]))),
    )
