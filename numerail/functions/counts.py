"""Digit-count arguments: whole numbers, plain or in exact scientific notation."""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest count (2^64 - 1 less room for rounding up to a multiple of 18).
LIMIT = 2**64 - 18
PATTERN = r"^(\d+)(?:\.(\d+))?(?:[eE]\+?(\d+))?$"


def parse_count(text: str) -> int | None:
    """The value, or None for signs, fractions, zero, trailing text and values out of range.

    A point needs digits on both sides and an exponent.
    """
    m = re.fullmatch(PATTERN, text)
    if not m or (m[2] and not m[3]) or len(m[1]) + len(m[2] or "") > 64 or (m[3] and len(m[3]) > 6):
        return None
    digits, shift = m[1] + (m[2] or ""), int(m[3] or 0) - len(m[2] or "")
    if not int(digits) or len(digits.lstrip("0")) + shift > 20:
        return None
    value = Decimal(digits).scaleb(shift)
    return int(value) if value == value.to_integral_value() and value <= LIMIT else None


def count_column(text: Column) -> Column:
    """The same rule for a column, as decimal(20,0); null where it is rejected."""
    whole, part, power = (F.regexp_extract(text, PATTERN, i) for i in (1, 2, 3))
    ok = text.rlike(PATTERN) & ((part == "") | (power != "")) & (F.length(whole) + F.length(part) <= 64) & (F.length(power) <= 6)
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    shift = F.coalesce(power.try_cast("int"), F.lit(0)) - F.length(part)
    cut = F.when(shift < 0, F.substring(digits, F.lit(1), F.greatest(F.length(digits) + shift, F.lit(0)))).otherwise(F.rpad(digits, F.least(F.length(digits) + shift, F.lit(40)), "0"))
    exact = (shift >= 0) | ((F.length(digits) + shift >= 0) & F.regexp_replace(F.substring(digits, F.greatest(F.length(digits) + shift + 1, F.lit(1)), F.lit(64)), "0", "").eqNullSafe(""))
    value = F.when(ok & exact & (digits != "") & (F.length(digits) + shift <= 20), cut.try_cast("decimal(20,0)"))
    return F.when((value > 0) & (value <= F.lit(str(LIMIT)).cast("decimal(20,0)")), value)
