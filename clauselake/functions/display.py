"""Display formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from clauselake.catalog import CURRENCY_SYMBOLS, STAGE_LABELS, STATUS_LABELS, lookup

DASH = "—"


def decimal_br(number: Column, decimals: int | None = None) -> Column:
    """Number as ``1.234,56``; ``decimals`` cuts or pads, without it trailing zeros go."""
    text = number.cast("string")
    sign = F.when(text.startswith("-") & text.rlike("[1-9]"), F.lit("-")).otherwise(F.lit(""))
    whole = F.regexp_extract(text, r"^-?([0-9]*)", 1)
    grouped = F.regexp_replace(whole, r"(?<=[0-9])(?=([0-9]{3})+$)", ".")
    fraction = F.regexp_extract(text, r"\.([0-9]*)$", 1)
    if decimals is None:
        fraction = F.regexp_replace(fraction, "0+$", "")
    else:
        fraction = F.substring(F.concat(fraction, F.lit("0" * decimals)), 1, decimals)
    return F.concat(sign, grouped, F.when(fraction == "", F.lit("")).otherwise(F.concat(F.lit(","), fraction)))


def date_br(date: Column) -> Column:
    return F.date_format(date, "dd-MM-yyyy")


def format_value(value: Column, unit: Column) -> Column:
    """Normalised value for a reader: ``R$ 2.000.000,00``, ``01-01-2025 a 01-01-2026``, ``30 dias``, ``5%``."""
    currency = value["currency"]
    money = F.concat(lookup(currency, CURRENCY_SYMBOLS), F.lit(" "), decimal_br(value["amount"], 2))
    number = decimal_br(value["number_text"])
    unit_text = F.coalesce(F.trim(unit), F.lit(""))
    with_unit = (
        F.when(unit_text == "%", F.concat(number, F.lit("%")))
        .when(unit_text == "", number)
        .otherwise(F.concat(number, F.lit(" "), unit_text))
    )
    return F.coalesce(
        F.when(value["amount"].isNotNull(), money)
        .when(value["start"].isNotNull(), F.concat(date_br(value["start"]), F.lit(" a "), date_br(value["end"])))
        .when(value["date"].isNotNull(), date_br(value["date"]))
        .when(value["number_text"].isNotNull(), with_unit)
        .otherwise(value["text"]),
        F.lit(DASH),
    )


def status_label(status: Column) -> Column:
    """Fact status for a reader."""
    return lookup(status, STATUS_LABELS)


def stage_label(stage: Column) -> Column:
    """Processing stage for a reader."""
    return lookup(stage, STAGE_LABELS)
