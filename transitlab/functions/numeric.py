"""Numeric coercion helpers shared by every operator.

Spark 4 runs in ANSI mode, so casts and divisions that the reference treats
as "missing" must use the try_* family. NaN is folded into NULL on entry (D2):
in Spark NaN sorts above every number and equals itself, which would change
every threshold comparison of the classifier.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import NULL_TOKENS

# Text of which ``try_cast`` makes a double as Python's ``float`` does: no Java suffixes such as '1.5d' and no
# hexadecimal literals, which it would otherwise accept.
NUMERIC_TEXT = r"\A[-+.0-9eE]++\z"


#: What Python's ``str.strip`` takes off: all white space, not the space alone.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Text without white space of any kind at either end."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def nan_to_null(c: Column) -> Column:
    """NULL for NaN, value otherwise (for double columns). ``nanvl`` refers to
    its input once, which keeps inlined expression trees small."""
    return F.nanvl(c, F.lit(None).cast("double"))


def finite_or_null(c: Column) -> Column:
    """NULL for NaN and +-infinity."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


#: The same with white space around it, and the names of what isn't finite.
PADDED_NUMERIC_TEXT = rf"\A[{WHITE_SPACE}]*+(?:[-+.0-9eE]++|[-+]?(?i:inf|infinity|nan))[{WHITE_SPACE}]*+\z"


def text_to_double(c: Column) -> Column:
    """Parse text the way Python's float() does for the usual literals: null
    tokens and unparseable text become NULL, NaN becomes NULL.

    The tokens are no numbers, or NaN. Only text that isn't plainly a number is looked at for white space."""
    number = F.coalesce(F.when(c.rlike(NUMERIC_TEXT), c), F.when(c.rlike(PADDED_NUMERIC_TEXT), strip(c)))
    return nan_to_null(number.try_cast("double"))


def as_double(c: Column, dtype: T.DataType) -> Column:
    """Coerce a column of any type to a NaN-free double."""
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return nan_to_null(c.cast("double"))
    if isinstance(dtype, T.NumericType):
        return c.cast("double")
    if isinstance(dtype, T.BooleanType):
        return c.cast("double")
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return text_to_double(c)
    return F.lit(None).cast("double")


def null_tokens_to_null(c: Column) -> Column:
    """S3: the CSV null tokens (after trimming) become NULL; other text is kept."""
    return F.when(~strip(c).isin(*NULL_TOKENS), c)


def round_half_away(c: Column, digits: int) -> Column:
    """sign(x)*floor(|x|*10^d + 0.5)/10^d, the same IEEE steps on every engine."""
    scale = float(10**digits)
    return F.signum(c) * F.floor(F.abs(c) * scale + 0.5) / scale


def fixed_text(c: Column, digits: int) -> Column:
    """x with exactly ``digits`` decimals, rounded half away from zero.

    Built from integer arithmetic and string concatenation (no per-value
    formatter), so it stays in generated code and gives the same text on
    every engine: k = floor(|x|*10^d + 0.5); sign, k div 10^d, '.', digits."""
    scale = 10**digits
    k = F.floor(F.abs(c) * F.lit(float(scale)) + F.lit(0.5)).cast("long")
    sign = F.when(c < 0, F.lit("-")).otherwise(F.lit(""))
    if digits == 0:
        return F.concat(sign, k.cast("string"))
    whole = (k / F.lit(scale)).cast("long").cast("string")
    frac = F.lpad((k % F.lit(scale)).cast("string"), digits, "0")
    return F.concat(sign, whole, F.lit("."), frac)


def display_number(c: Column) -> Column:
    """|x|>=100 -> 0 digits, >=10 -> 1, else 2; NULL -> a dash."""
    a = F.abs(c)
    txt = F.when(a >= 100, fixed_text(c, 0)).when(a >= 10, fixed_text(c, 1)).otherwise(fixed_text(c, 2))
    return F.when(c.isNull(), F.lit("—")).otherwise(txt)
