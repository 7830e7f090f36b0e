"""Money columns. NULL is unknown and never becomes zero; nothing is rounded or guessed on the way in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def normalize_currency(code: Column) -> Column:
    """Trimmed upper-case code; RM is spelled MYR."""
    clean = F.upper(F.trim(code))
    return F.when(clean == "RM", "MYR").otherwise(clean)


def strict_currency(code: Column) -> Column:
    """The normalised code if it has three letters, else NULL."""
    clean = normalize_currency(code)
    return F.when(F.regexp_like(clean, F.lit("^[A-Z]{3}$")), clean)


def number(text: Column) -> Column:
    """Lenient number: NULL for blank and unparsable text, zero stays zero."""
    return text.cast("string").try_cast("decimal(38,10)")


def strict_amount(text: Column) -> Column:
    """A reviewed amount: digits with at most two decimals, no sign and no comma; else NULL."""
    return F.when(F.regexp_like(text, F.lit(r"^[0-9]+(\.[0-9]{1,2})?$")), text.try_cast(MONEY))


def bank_cell(text: Column) -> Column:
    """A printed cell: exactly two decimals and commas only where thousands are; else NULL."""
    plain = F.regexp_replace(text, ",", "")
    return F.when(F.regexp_like(text, F.lit(r"^([0-9]{1,3}(,[0-9]{3})+|[0-9]+)\.[0-9]{2}$")), plain.try_cast(MONEY))


def money(value: Column) -> Column:
    return value.cast(MONEY)


def unless_conflicting(left: Column, right: Column) -> Column:
    """True if either side is unknown or both agree: only two known, different values conflict."""
    return left.isNull() | right.isNull() | (left == right)


def currencies_agree(left: Column, right: Column) -> Column:
    known = lambda c: F.nullif(normalize_currency(c), F.lit(""))
    return unless_conflicting(known(left), known(right))


def formula_escape(text: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets a leading apostrophe."""
    return F.when(F.regexp_like(text, F.lit(r"^[=+\-@\t\r]")), F.concat(F.lit("'"), text)).otherwise(text)


def written(value: Column) -> Column:
    """An amount with thousands commas and two decimals."""
    return F.format_number(value, 2)


def particulars(*facts: Column) -> Column:
    """Known facts joined by ' : '; unknown and blank ones are left out."""
    return F.array_join(F.filter(F.array(*facts), lambda x: x.isNotNull() & (x != "")), " : ")


def cents(value: Column) -> Column:
    return (value * 100).cast("bigint")


def default_allocation(available: Column, amount: Column) -> Column:
    """What a line can take from a piece: the smaller of the two, not below zero; unknown stays unknown."""
    return F.when(available.isNotNull() & amount.isNotNull(), F.greatest(F.least(available, amount), F.lit(0).cast(MONEY)))
