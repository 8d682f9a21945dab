"""Amount and rate parsing as plain column expressions (no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WIDE = "decimal(38,0)"
_LIMB = 15  # hex digits per limb: 60 bits, so conv() stays inside a signed 64-bit value
_MOST_HEX = 32  # hex digits of the largest decimal(38,0)
_WAD = 1e18
_BLANKS = " \t\n\r\f\x0b"
# Amounts that fit 64 bits whatever their digits are: nearly all, so they skip the wide arithmetic.
_SHORT_DECIMAL, _SHORT_HEX = r"^[0-9]{1,18}\z", rf"^0[xX][0-9a-fA-F]{{1,{_LIMB}}}\z"


def base_units(col: Column, *, name: str | Column, amount_type: str = "bigint") -> Column:
    """Amount in base units from an integer, a decimal string or a ``0x`` hex string.

    Null and blank give 0 and thousands commas are dropped. Anything else that isn't a whole number
    (points, exponents, letters) is an error that names the column; so is a value outside
    ``amount_type``, of which decimal(38,0) is the widest. Short plain digits are read as 64-bit numbers; all
    other forms go through decimals.
    """
    label = F.lit(name) if isinstance(name, str) else name
    text = F.trim(F.coalesce(col.cast("string"), F.lit("0")), F.lit(_BLANKS))
    lower = F.lower(text)

    def fail(why: str) -> Column:
        return F.raise_error(F.concat(label, F.lit(f": {why} '"), text, F.lit("'"))).cast(_WIDE)

    after = F.substr(lower, F.lit(3))
    digits = F.regexp_replace(after, "^0+(?=.)", "")
    padded = F.lpad(digits, 3 * _LIMB, "0")
    limb = lambda k: F.conv(F.substring(padded, k * _LIMB + 1, _LIMB), 16, 10).cast("decimal(19,0)")
    worth = lambda bits: F.lit(str(1 << bits)).cast(_WIDE)
    from_hex = (limb(0) * worth(4 * 2 * _LIMB) + limb(1) * worth(4 * _LIMB) + limb(2)).cast(_WIDE)

    plain = F.regexp_replace(text, ",", "")
    parsed = (
        F.when(
            lower.startswith("0x"),
            F.when(~digits.rlike("^[0-9a-f]+$"), fail("bad hex value"))
            .when(F.length(digits) > _MOST_HEX, fail("more than 38 decimal digits in"))
            .otherwise(from_hex),
        )
        .when(plain == "", F.lit(0).cast(_WIDE))
        .when(~plain.rlike("^[+-]?[0-9]+$"), fail("expected a whole number, found"))
        .otherwise(plain.cast(_WIDE))
    )
    given = col.cast("string")
    short = lambda number: number.cast("bigint").cast(amount_type)
    return (
        F.when(given.rlike(_SHORT_DECIMAL), short(given))
        .when(given.rlike(_SHORT_HEX), short(F.conv(F.substr(given, F.lit(3)), 16, 10)))
        .otherwise(parsed.cast(amount_type))
    )


def rate_per_second(col: Column) -> Column:
    """Per-second rate from its 1e18-scaled integer form; null counts as zero."""
    return F.coalesce(col.cast("double"), F.lit(0.0)) / F.lit(_WAD)
