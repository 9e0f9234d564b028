"""Exact arithmetic on integers kept as text, of any width, in native expressions.

A decimal holds 38 digits; raw amounts may have up to 78. Text is cut into limbs of fixed width,
limbs are added as numbers (so a sum is a plain, mergeable aggregate) and carried once, at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from recohort.contracts import INTEGER_PATTERN, TOKEN_PLACES, USD_PLACES

SUM_LIMB = 9
SUM_LIMBS = 10
_BASE = 10 ** SUM_LIMB


def is_integer_text(raw: Column) -> Column:
    """Canonical non-negative integer: digits only, no leading zero."""
    return raw.rlike(INTEGER_PATTERN)


def strip_zeros(digits: Column) -> Column:
    """Digits without leading zeros; zero stays one digit."""
    return F.coalesce(F.nullif(F.ltrim(digits, F.lit("0")), F.lit("")), F.substring(digits, 1, 1))


def shift_point(digits: Column, places: int) -> tuple[Column, Column]:
    """Whole and fractional digits after moving the decimal point left."""
    digits = F.ltrim(digits, F.lit("0"))
    padded = F.lpad(digits, F.greatest(F.length(digits), F.lit(places + 1)), F.lit("0"))
    return F.left(padded, F.length(padded) - places), F.right(padded, F.lit(places))


def scale_usd(raw: Column, places: int = USD_PLACES) -> Column:
    """Raw integer text over 10^places, exact and without trailing zeros; null when not an integer."""
    whole, fraction = shift_point(raw, places)
    fraction = F.rtrim(fraction, F.lit("0"))
    return F.when(raw.rlike("^[0-9]+$"),
                  F.when(fraction == "", whole).otherwise(F.concat_ws(".", whole, fraction)))


def scale_token_units(raw: Column, places: int = TOKEN_PLACES) -> Column:
    """Raw signed integer text over 10^places with every fractional digit kept."""
    sign = F.when(raw.startswith("-"), "-").otherwise("")
    whole, fraction = shift_point(F.ltrim(raw, F.lit("-")), places)
    return F.when(raw.rlike("^-?[0-9]+$"), F.concat(sign, whole, F.lit("."), fraction))


def sum_limbs(raw: Column, limbs: int = SUM_LIMBS) -> Column:
    """Aggregate: per-limb sums of integer text of up to ``9 * limbs`` digits, as one struct; nulls are skipped.

    A limb's sum is a long, which some nine billion rows of one group can fill; more are an error, not a wrong sum.
    """
    padded = F.lpad(raw, SUM_LIMB * limbs, "0")
    checked = F.when(F.length(raw) > SUM_LIMB * limbs,
                     F.raise_error("integer text is wider than the sum supports")).otherwise(padded)
    return F.struct(*[F.sum(F.substring(checked, SUM_LIMB * (limbs - 1 - k) + 1, SUM_LIMB).cast("bigint")).alias(f"s{k}") for k in range(limbs)])


def merge_limbs(sums: str, limbs: int = SUM_LIMBS) -> Column:
    """Aggregate: the sum of structs that ``sum_limbs`` made of smaller groups, without going through text."""
    return F.struct(*[F.sum(F.col(f"{sums}.s{k}").cast("decimal(38,0)")).alias(f"s{k}") for k in range(limbs)])


def carry_limbs(sums: Column, limbs: int = SUM_LIMBS) -> Column:
    """Integer text from a struct of per-limb sums."""
    base = F.lit(_BASE).cast("decimal(10,0)")
    digits, carry = [], F.lit(0).cast("decimal(38,0)")
    for limb in range(limbs):
        total = (F.coalesce(sums[f"s{limb}"].cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")) + carry).cast("decimal(38,0)")
        last = limb == limbs - 1
        digit = total if last else (total % base).cast(f"decimal({SUM_LIMB},0)")
        digits.insert(0, F.lpad(digit.cast("string"), 38 if last else SUM_LIMB, "0"))
        carry = F.call_function("div", total, base).cast("decimal(38,0)") if not last else carry
    return strip_zeros(F.concat(*digits))


def compare_text(left: Column, right: Column) -> Column:
    """-1, 0 or 1 for two integer texts of any width."""
    a, b = strip_zeros(left), strip_zeros(right)
    longer = F.length(a) - F.length(b)
    return F.when(longer != 0, F.signum(longer)).when(a < b, -1).when(a > b, 1).otherwise(0).cast("int")


_LIMB = 15
_LIMB_BASE = 10 ** _LIMB
_ZERO_TYPE = "decimal(38,0)"


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _limbs(raw: Column) -> Column:
    """Little-endian array of fixed-width limbs."""
    count = F.ceil(F.length(raw) / F.lit(_LIMB)).cast("int")
    padded = F.lpad(raw, count * _LIMB, F.lit("0"))
    return F.transform(F.sequence(count - 1, F.lit(0), F.lit(-1)),
                       lambda i: F.substr(padded, i * _LIMB + 1, F.lit(_LIMB)).cast(_ZERO_TYPE))


def _carried(values: Column) -> Column:
    """Integer text from little-endian limbs that may be negative or above the base."""
    base = F.lit(_LIMB_BASE).cast("decimal(16,0)")
    start = F.struct(F.lit(0).cast(_ZERO_TYPE).alias("carry"), F.lit("").alias("text"))

    def step(state, value):
        def split(total):
            digit = F.pmod(total, base).cast(_ZERO_TYPE)
            carry = F.call_function("div", (total - digit).cast(_ZERO_TYPE), base).cast(_ZERO_TYPE)
            return F.struct(carry.alias("carry"),
                            F.concat(F.lpad(digit.cast("string"), _LIMB, "0"), state["text"]).alias("text"))
        return let((value + state["carry"]).cast(_ZERO_TYPE), split)

    return strip_zeros(F.aggregate(values, start, step,
                                   lambda state: F.concat(state["carry"].cast("string"), state["text"])))


def _number(raw: Column) -> Column:
    return raw.cast(_ZERO_TYPE)


def _subtract_wide(left: Column, right: Column) -> Column:
    zero = F.lit(0).cast(_ZERO_TYPE)
    return _carried(F.zip_with(_limbs(left), _limbs(right), lambda a, b: (
        F.coalesce(a, zero) - F.coalesce(b, zero)).cast(_ZERO_TYPE)))


def _multiply_wide(left: Column, right: Column) -> Column:
    zero = F.lit(0).cast(_ZERO_TYPE)

    def convolve(pair):
        a, b = pair["a"], pair["b"]

        def place(position):
            low = F.greatest(F.lit(0), position - F.size(b) + 1)
            high = F.least(position, F.size(a) - 1)
            return F.aggregate(F.sequence(low, high), zero, lambda total, i: (
                total + F.get(a, i).cast("decimal(15,0)") * F.get(b, position - i).cast("decimal(15,0)")).cast(_ZERO_TYPE))

        return _carried(F.transform(F.sequence(F.lit(0), F.size(a) + F.size(b) - 2), place))

    return let(F.struct(_limbs(left).alias("a"), _limbs(right).alias("b")), convolve)


def subtract_text(left: Column, right: Column) -> Column:
    """``left - right`` for integer texts with left >= right; limbs are used above 38 digits only."""
    def difference(pair):
        a, b = pair["a"], pair["b"]
        return F.when(F.length(a) <= 38, (_number(a) - _number(b)).cast("string")).otherwise(_subtract_wide(a, b))

    return let(F.struct(strip_zeros(left).alias("a"), strip_zeros(right).alias("b")), difference)


def multiply_text(left: Column, right: Column) -> Column:
    """Product of two integer texts; limbs are used when it may pass 38 digits."""
    def product(pair):
        a, b = pair["a"], pair["b"]
        return F.when(F.length(a) + F.length(b) <= 38, (_number(a) * _number(b)).cast("string")).otherwise(_multiply_wide(a, b))

    return let(F.struct(strip_zeros(left).alias("a"), strip_zeros(right).alias("b")), product)


def net_fee(fee: Column, discount: Column, price: Column, places: int = USD_PLACES) -> Column:
    """(fee - discount) * price over 10^places as exact text; null when any part is unknown."""
    def value(parts):
        a, b, c = parts["a"], parts["b"], parts["c"]
        return F.when(fee_fault(a, b, c).isNull() & a.isNotNull() & b.isNotNull() & c.isNotNull(),
                      let(multiply_text(subtract_text(a, b), c), lambda total: scale_usd(total, places)))

    return let(F.struct(fee.alias("a"), discount.alias("b"), price.alias("c")), value)


def fee_fault(fee: Column, discount: Column, price: Column) -> Column:
    """Why a complete set of fee parts is unusable; null when it is fine or incomplete."""
    digits = "^[0-9]+$"
    known = fee.isNotNull() & discount.isNotNull() & price.isNotNull()
    shaped = fee.rlike(digits) & discount.rlike(digits) & price.rlike(digits)
    return F.when(known, F.when(~shaped, "fee parts must be non-negative integers")
                  .when(compare_text(discount, fee) > 0, "discount exceeds fee")
                  .when(strip_zeros(price) == "0", "price is not positive"))

