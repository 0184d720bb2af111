"""Column expressions shared by the operators.  Everything stays inside the JVM."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keytempo import names

_BLOCK = 64


def number(col: Column | str) -> Column:
    """A double, or NULL for text that is no number and for NaN."""
    value = F.col(col) if isinstance(col, str) else col
    cast = value.try_cast("double")
    return F.when(~F.isnan(cast), cast)


def finite(col: Column) -> Column:
    """True for values that are neither NULL, NaN nor infinite."""
    return col.isNotNull() & ~F.isnan(col) & (F.abs(col) != F.lit(float("inf")))


def is_missing(df: DataFrame, name: str) -> Column:
    """NULL, and NaN where the type has it."""
    null = F.col(name).isNull()
    if dict(df.dtypes)[name] in ("double", "float"):
        return null | F.isnan(F.col(name))
    return null


def non_negative(col: Column) -> Column:
    """Raise negatives to 0 and keep NULL (``greatest`` alone would turn NULL into 0)."""
    return F.when(col.isNotNull(), F.greatest(F.lit(0.0), col))


def clip(col: Column, low: float, high: float) -> Column:
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(low)), F.lit(high)))


def ratio(part: Column, whole: Column) -> Column:
    """part / max(whole, 1)."""
    return part / F.greatest(whole, F.lit(1))


def rounded(df: DataFrame, digits: Mapping[str, int] | int) -> DataFrame:
    """Round as a last projection; an int rounds every double column."""
    if isinstance(digits, int):
        digits = {c: digits for c, t in df.dtypes if t in ("double", "float")}
    return df.withColumns({
        c: F.round(F.col(c), d) + F.lit(0.0) for c, d in digits.items() if c in df.columns
    })


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def mask_key(col: Column) -> Column:
    """An abstract token for a key name: ``k_`` and six hex digits of its MD5."""
    return F.concat(F.lit("k_"), F.substring(F.md5(col.cast("string")), 1, 6))


def map_condition(col: Column, mapping: Mapping[str, str] = names.CONDITION_LABELS) -> Column:
    """Label of a condition code: exact code, then upper-case code, else unchanged."""
    table = F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])
    code = col.cast("string")
    return F.coalesce(F.element_at(table, code), F.element_at(table, F.upper(code)), code)


def hmac_sha256(message: Column, secret: str) -> Column:
    """Keyed digest (RFC 2104) from two nested SHA-256 calls, as lower-case hex."""
    import hashlib

    key = secret.encode("utf-8")
    if len(key) > _BLOCK:
        key = hashlib.sha256(key).digest()
    key = key.ljust(_BLOCK, b"\0")
    inner = F.lit(bytearray(b ^ 0x36 for b in key))
    outer = F.lit(bytearray(b ^ 0x5C for b in key))
    first = F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(outer, first), 256)


def is_pseudonym(col: Column) -> Column:
    return col.cast("string").rlike(names.PSEUDONYM)


def pseudonym(col: Column, secret: str) -> Column:
    """``usr_`` and 16 hex digits; valid pseudonyms pass, blank or missing ids are an error."""
    if not secret or not secret.strip():
        raise ValueError("the pseudonym secret must not be blank")
    text = F.trim(col.cast("string"))
    return (
        F.when(is_pseudonym(col), col.cast("string"))
        .when(F.coalesce(text, F.lit("")) == "", F.raise_error(F.lit("blank person id")))
        .otherwise(F.concat(F.lit("usr_"), F.substring(hmac_sha256(text, secret), 1, 16)))
    )


def laplace(scale: Column, uniform: Column) -> Column:
    """Noise from Laplace(0, scale): the inverse distribution function of a uniform in (0, 1)."""
    u = uniform - F.lit(0.5)
    tail = F.greatest(F.lit(1.0) - F.lit(2.0) * F.abs(u), F.lit(5e-324))
    return -scale * F.signum(u) * F.log(tail)


def reasons(rules: Iterable[tuple[Column, Column | str]]) -> Column:
    """The texts of all rules that hold, as an array in rule order."""
    found = [
        F.when(rule, text if isinstance(text, Column) else F.lit(text)) for rule, text in rules
    ]
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def first_present(columns: Iterable[str], candidates: Iterable[str]) -> str | None:
    have = set(columns)
    return next((c for c in candidates if c in have), None)
