"""Money and number texts of scanned invoices as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(20,4)"
#: Row arithmetic may be off by so much.
TOLERANCE = 1


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def decimal_comma(text: Column) -> Column:
    """A single comma before two digits becomes a dot; nothing else changes."""
    one = ~F.contains(text, F.lit(".")) & (F.length(text) - F.length(F.replace(text, F.lit(","))) == 1)
    return F.when(one, F.regexp_replace(text, r"\b(\d+),(\d{2})\b", "$1.$2")).otherwise(text)


def repaired_digits(text: Column) -> Column:
    """Letters read for digits, beside digits: O as 0, l and I as 1, B as 8."""
    text = F.regexp_replace(text, r"(?<=\d)[Oo](?=\d|\.|$)", "0")
    text = F.regexp_replace(text, r"(?<=[\d.])[lI](?=\d|\.|$)", "1")
    return F.regexp_replace(text, r"(?<=\d)[B8](?=\d|\.|$)", "8")


def to_decimal(text: Column) -> Column:
    """A number text as a decimal; 0 where there is none."""
    # most are plain numbers, or have a comma for the point
    plain = text.rlike(r"\A-?\d+(?:[.,]\d{2}|\.\d+)?\z")
    clean = repaired_digits(F.regexp_replace(F.trim(decimal_comma(text)), r"[₹$,\s]", ""))
    clean = F.regexp_replace(F.regexp_replace(clean, r"\.(?=.*\.)", ""), "[^0-9.-]", "")
    return F.coalesce(F.when(plain, F.replace(text, F.lit(","), F.lit("."))).otherwise(clean).try_cast(MONEY), F.lit(0).cast(MONEY))


def decimals_in(text: Column) -> Column:
    """All numbers with 1 to 3 decimals in a text; where a match has commas alone, each is a dot."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?\d[\d,]*[.,]\d{1,3}"), F.lit(0))
    return F.transform(found, lambda m: to_decimal(F.when(F.contains(m, F.lit(".")), m).otherwise(F.replace(m, F.lit(","), F.lit(".")))))


def first_money(text: Column) -> Column:
    """The first number with two decimals of a text without blanks; null if there is none."""
    found = F.regexp_extract(F.regexp_replace(text, r"\s", ""), r"\d+[.,]\d{2}", 0)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(".")).try_cast(MONEY))


def fused_decimals(text: Column) -> Column:
    """Values of two decimals each in a text where they run together, such as 12.5034.00."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d+\.\d{2}"), F.lit(0)), lambda m: m.try_cast(MONEY))


def fused_integers(text: Column) -> Column:
    """Integers of 1 to 3 digits in a text."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\d{1,3}"), F.lit(0)), lambda m: m.cast("int"))


def lenient_number(text: Column) -> Column:
    """A number without currency signs, blanks, percent and commas; null if there is none."""
    return F.regexp_replace(F.upper(F.coalesce(text, F.lit(""))), r"[₹$,%\s]", "").try_cast("double")


def row_formula(qty: Column, rate: Column, amount: Column, discount: Column) -> Column:
    """Which formula explains an amount, within TOLERANCE; the first that does.

    zero_amount fits only where qty is 0; math_failed and all_formulas_failed fit never.
    """
    base = qty * rate
    fits = lambda value: F.abs(value - amount) <= TOLERANCE
    return (
        F.when(amount == 0, "zero_amount").when(fits(base), "qty_x_rate").when(F.coalesce(discount, F.lit(0)) == 0, "math_failed")
        .when(fits(base - discount), "base_less_absolute_discount").when(fits(base * (1 - discount / 100)), "percentage_discount")
        .when(fits(qty * (rate - discount)), "per_unit_rate_discount").otherwise("all_formulas_failed")
    )


def formula_fits(formula: Column, qty: Column) -> Column:
    return F.when(formula == "zero_amount", qty == 0).otherwise(~formula.isin("math_failed", "all_formulas_failed"))


def minor_formula(qty: Column, rate: Column, amount: Column, percent: Column) -> Column:
    """row_formula() in minor units and whole percents: integer arithmetic, alike on every engine."""
    base = qty * rate
    fits = lambda value: F.abs(value - amount) <= 100
    return (
        F.when(amount == 0, "zero_amount").when(fits(base), "qty_x_rate").when(percent == 0, "math_failed")
        .when(fits(base - 100 * percent), "base_less_absolute_discount").when(F.abs(base * (100 - percent) - 100 * amount) <= 10_000, "percentage_discount")
        .when(fits(qty * (rate - 100 * percent)), "per_unit_rate_discount").otherwise("all_formulas_failed")
    )
