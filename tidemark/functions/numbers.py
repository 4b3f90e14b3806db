"""Number parsing and arithmetic guards as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a double may look like: signs, digits with single underscores between them, exponents, infinities, not-a-number.
_NUMBER = r"(?i)^[+-]?(?:(?:[0-9](?:_?[0-9])*)(?:\.(?:[0-9](?:_?[0-9])*)?)?(?:e[+-]?[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*(?:e[+-]?[0-9](?:_?[0-9])*)?|inf(?:inity)?|nan)$"
_WIDE = ("０１２３４５６７８９", "0123456789")
# Fixed value: the characters stripped from a number's front, as a set.
VAGUE = "约近超过超逾不多于至少不低于不超过不高于"


def to_double(text: Column) -> Column:
    """The double a text says, or null; white space around it and wide digits are allowed, type suffixes are not."""
    plain = F.translate(F.trim(F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")), *_WIDE)
    return F.when(plain.rlike(_NUMBER), F.replace(plain, F.lit("_"), F.lit("")).try_cast("double"))


def value_as_float(text: Column) -> Column:
    """A field value as a number: thousands separators dropped; null if it says none."""
    return to_double(F.replace(text, F.lit(","), F.lit("")))


def parse_number(text: Column) -> Column:
    """A number with the units 万 and 亿, per cent signs and vague prefixes; null for anything else."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", ""), "[,， ]", "")
    per_cent = to_double(F.substring(t, F.lit(1), F.length(t) - 1)) / 100.0
    strip = lambda x: F.regexp_replace(x, f"^[{VAGUE}]+", "")
    hundred_million = to_double(strip(F.replace(t, F.lit("亿"), F.lit("")))) * 100_000_000.0
    ten_thousand = to_double(strip(F.replace(t, F.lit("万"), F.lit("")))) * 10_000.0
    return F.when(t.endswith("%"), per_cent).when(t.contains("亿"), hundred_million).when(t.contains("万"), ten_thousand).otherwise(to_double(strip(t)))


def normalize_amount(value: Column, unit: Column) -> Column:
    """An amount in units of ten thousand."""
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    return F.when(u.isin("cny_100m", "亿", "亿元"), value * 10_000.0).when(u.isin("cny", "元"), value / 10_000.0).otherwise(value)


def safe_divide(a: Column, b: Column, default: float = 0.0) -> Column:
    return F.when(F.abs(b) < 1e-10, F.lit(default)).otherwise(a / b)


def clamp(v: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """v within bounds; null stays null, which greatest and least alone would not do."""
    return F.when(v.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), v)))


def _let(value: Column, result: Callable[[Column], Column]) -> Column:
    """result(value) with the value computed once and not repeated in the plan, whose compiled form would grow too long."""
    return F.element_at(F.transform(F.array(value), result), 1)


def _product(a: Column, b: float) -> Column:
    """a * b as a double, the exact error of it by splitting both factors in halves, and the floor."""
    splitter = float((1 << 27) + 1)
    bh = b * splitter - (b * splitter - b)
    bl = b - bh

    def halves(ah: Column) -> Column:
        return _let(F.struct((a * b).alias("p"), (a - ah).alias("al")), lambda t: F.struct(
            t["p"].alias("p"), (((ah * bh - t["p"]) + ah * bl + t["al"] * bh) + t["al"] * bl).alias("error"), F.floor(t["p"]).alias("floor")
        ))

    return _let(a * splitter - (a * splitter - a), halves)


def _rounded(size: Column, digits: int) -> Column:
    """A double from 0 up to 2**53 with so many decimals."""

    def place(whole: Column) -> Column:
        def near(t: Column) -> Column:
            over = t["p"] - t["floor"].cast("double") - 0.5
            odd = (t["floor"] if digits else whole) % 2 == 1
            return t["floor"] + F.when((over > 0) | ((over == 0) & ((t["error"] > 0) | ((t["error"] == 0) & odd))), 1).otherwise(0)

        def shown(r: Column) -> Column:
            up = r == 10**digits
            text = F.format_number(whole + F.when(up, 1).otherwise(0), 0)
            return F.concat(text, F.lit("."), F.lpad(F.when(up, 0).otherwise(r).cast("string"), digits, "0")) if digits else text

        return _let(_let(_product(size - whole.cast("double"), float(10**digits)), near), shown)

    return _let(F.floor(size), place)


def fixed(x: Column, digits: int, plus: bool = False, separators: bool = False) -> Column:
    """A double's exact value with so many decimals (15 at most), ties to even (0.0625 is 0.062), with a plus sign or thousands separators if wanted.

    Null stays null; not-a-number and infinities are nan and inf; minus zero and what rounds to it keep the sign. Exact below 2**126 (beyond, digits
    after the seventeenth are zeros). `format_string`, `format_number` and `round` work on the shortest decimal text, which rounds 0.0625 or 0.0005 otherwise.
    """
    if not 0 <= digits <= 15:
        raise ValueError("0 to 15 decimals")
    two53, two63 = float(1 << 53), float(1 << 63)

    def unsigned(size: Column) -> Column:
        # Beyond 2**53 a double is whole: as one or two integers it keeps all its digits.
        high = F.floor(F.when((size >= two63) & (size < two63 * two63), size) / two63)
        parts = _let(high, lambda h: h.cast("decimal(19,0)") * F.lit(str(1 << 63)).cast("decimal(19,0)") + (size - h.cast("double") * two63).try_cast("long").cast("decimal(19,0)"))
        text = F.when(F.isnan(size), "nan").when(size == float("inf"), "inf").when(size < two53, _rounded(F.when(size < two53, size), digits))
        text = text.when(size < two63, F.format_number(F.when(size < two63, size).try_cast("long"), digits)).when(size < two63 * two63, F.format_number(parts, digits)).otherwise(F.format_number(size, digits))
        return text if separators else F.replace(text, F.lit(","), F.lit(""))

    def signed(x: Column) -> Column:
        negative = ~F.isnan(x) & ((x < 0) | ((x == 0) & x.cast("string").startswith("-")))
        return F.concat(F.when(negative, "-").otherwise("+" if plus else ""), _let(F.abs(x), unsigned))

    return _let(x.cast("double"), signed)


def format_value(value: Column, kind: Column) -> Column:
    """A field value for display: whole numbers with separators, others with up to four decimals, texts as they are."""
    v = value_as_float(value)
    shown = F.when(v == F.floor(v), fixed(v, 0, separators=True)).otherwise(F.regexp_replace(fixed(v, 4, separators=True), r"\.?0+$", ""))
    return F.coalesce(F.when((kind == "numeric") & v.isNotNull(), shown), value, F.lit(""))


def direction_label(composite: Column) -> Column:
    return F.when(composite > 0.1, "bullish").when(composite < -0.1, "bearish").otherwise("neutral")


def is_high_impact(composite: Column, threshold: float = 0.5) -> Column:
    return F.abs(composite) >= threshold
