"""Column expressions that turn messy text into numbers (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import config as C

# FIXED VALUES: patterns of the text-to-number rules.
CURRENCY_OR_WHITESPACE = r"(?U)[₹$€£¥\s]+"
CURRENCY_ADAPTIVE = "$€£¥₹,"
US_GROUPED = r"(?U)\d,\d{3}[.,]"
EU_NUMBER = r"^(?U)\d{1,3}(\.\d{3})+(,\d+)?$"
NON_NUMERIC = r"(?U)[^\d.\-]"
EDGE_WHITESPACE = r"(?U)^\s+|\s+$"
THREE_DECIMALS = r"^\d{1,3}\.\d{3}$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bound(x: Column, then) -> Column:
    """``then(x)`` with ``x`` computed once, however often ``then`` uses it."""
    return F.get(F.transform(F.array(x), then), F.lit(0))


def py_strip(c) -> Column:
    """Strip leading/trailing whitespace like ``str.strip`` (tabs, newlines too)."""
    return F.regexp_replace(_col(c).cast("string"), EDGE_WHITESPACE, "")


# a number as float() reads it; Java's own literals (30d, 1.5f, 0x1p3) are none
DECIMAL = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
SPECIAL = r"(?i)^[+-]?(inf|infinity|nan)$"


def to_double(c) -> Column:
    """Cast of decimal text only; null for anything else. ``inf`` and ``nan`` read as such."""
    return bound(py_strip(c), _decimal)


def _decimal(s: Column) -> Column:
    special = (F.when(F.lower(s).contains("nan"), F.lit(float("nan")))
               .when(s.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
    return F.when(s.rlike(DECIMAL), s.try_cast("double")).when(s.rlike(SPECIAL), special)


def as_double(c: str, dtype: str) -> Column:
    """A column as double: text is parsed, numbers are cast."""
    return F.col(f"`{c}`").cast("double") if dtype != "string" else to_double(F.col(f"`{c}`"))


def plain_text(c: Column, dtype: str) -> Column:
    """A typed column as text; doubles and floats as Python writes them (``12345678.0``, ``1e+16``)."""
    if dtype not in ("double", "float"):
        return c.cast("string")
    s = c.cast("string")
    a = F.abs(c)
    # Java turns to exponents at 1e7 and below 1e-3, Python at 1e16 and below 1e-4
    zeros = lambda x: F.regexp_replace(F.regexp_replace(x, r"0+$", ""), r"\.$", ".0")
    big, small = zeros(s.try_cast("decimal(38,10)").cast("string")), zeros(s.try_cast("decimal(38,30)").cast("string"))
    mantissa = F.regexp_replace(F.regexp_extract(s, r"^(-?[0-9.]+)E", 1), r"\.0$", "")
    power = F.regexp_extract(s, r"E(-?[0-9]+)$", 1).cast("int")
    exponent = F.concat(mantissa, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), 2, "0"))
    return (F.when(~s.contains("E"), s).when((a >= 1e7) & (a < 1e16), big)
            .when((a < 1e-3) & (a >= 1e-4), small).otherwise(exponent))


def clean_num(c, locale_rule: str = "default") -> Column:
    """Currency, whitespace and locale repair, then a lenient cast.

    The European pattern wins over everything else, so ``12.345`` becomes
    12345 and ``1234,56`` (not European by the pattern) loses its comma and
    becomes 123456; ``(5)`` keeps only the digit; ``1e-05`` is not a number.
    ``locale_rule='v1'`` reproduces the first release, where a US number with
    comma thousands and a decimal point also took the European branch.
    """
    def separators(s: Column) -> Column:
        eu = s.rlike(EU_NUMBER)
        if locale_rule == "v1":
            eu = eu | s.rlike(US_GROUPED)
        # European: points go, the comma becomes the point
        return F.when(eu, F.translate(s, ",.", ".")).otherwise(F.translate(s, ",", ""))

    bare = F.regexp_replace(_col(c).cast("string"), CURRENCY_OR_WHITESPACE, "")
    return bound(F.regexp_replace(bound(bare, separators), NON_NUMERIC, ""),
                 lambda d: F.when(d.rlike(DECIMAL), d.try_cast("double")))


def reparse_float(c, strict: bool = False) -> Column:
    """P10: re-apply :func:`clean_num` to a column that is already numeric.

    The reference turns parsed floats back into their Python text and parses
    them again. That text differs from Spark's, so the effects are emulated
    from the value: three-decimal values below 1000 read as European numbers
    (``29.125`` -> 29125), non-zero values below 1e-4 (``1e-05``) become null,
    values from 1e16 up lose their exponent marker (``1e+16`` -> 116), and
    NaN/inf become null. ``strict=True`` keeps the parsed value instead.
    """
    def again(v: Column) -> Column:
        a = F.abs(v)
        odd = F.isnan(v) | (a == float("inf"))
        if strict:
            return F.when(~odd, v)
        large = F.replace(F.replace(v.cast("string"), F.lit(".0E"), F.lit("E")), F.lit("E"), F.lit(""))
        thousand = (v >= 0.001) & (v < 1000) & v.cast("string").rlike(THREE_DECIMALS)
        return (F.when(odd | ((a > 0) & (a < 1e-4)), F.lit(None).cast("double"))
                .when(a >= 1e16, large.try_cast("double"))
                .when(thousand, F.translate(v.cast("string"), ".", "").try_cast("double")).otherwise(v))

    return bound(_col(c).cast("double"), again)


def adaptive_num(c) -> Column:
    """Null tokens, currency/commas and a trailing percent, then cast."""
    known = bound(py_strip(c), lambda t: F.when(~t.isin(C.ADAPTIVE_NULL_TOKENS), t))
    return to_double(F.regexp_replace(F.translate(known, CURRENCY_ADAPTIVE, ""), r"%$", ""))


def safe_float(c, default: float = 0.0) -> Column:
    """Non-finite or null -> default."""
    v = _col(c).cast("double")
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")),
                  F.lit(float(default))).otherwise(v)


def lower_token(c) -> Column:
    """``str(x).strip().lower()`` for label mapping; null stays null."""
    return F.lower(py_strip(c))
