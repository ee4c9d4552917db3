"""Text-to-number columns that accept exactly what a strict parser accepts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from specimen_spark.functions.text import WHITE, as_column, let

_DIGITS = r"[0-9]+(?:_[0-9]+)*"
_FLOAT = (
    rf"(?i)^{WHITE}*[+-]?(?:(?:{_DIGITS}\.?(?:{_DIGITS})?|\.{_DIGITS})(?:e[+-]?{_DIGITS})?|inf(?:inity)?|nan){WHITE}*$"
)
_INTEGER = rf"^{WHITE}*[+-]?{_DIGITS}{WHITE}*$"
# What nearly every cell looks like; such text needs no further care.
_PLAIN = r"^-?[0-9]{1,300}(?:\.[0-9]*)?$"


def _careful(text: Column) -> Column:
    """Double of any accepted spelling: outer white space, digit separators, signed nan."""
    bare = F.regexp_replace(text, rf"(?i){WHITE}|_|^{WHITE}*[+-](?=nan)", "")
    return F.when(text.rlike(_FLOAT), bare.try_cast("double"))


def parse_float_any(c) -> Column:
    """Double including nan and the infinities; null when the text is no number."""
    text = as_column(c).cast("string")

    def read(t: Column) -> Column:
        return F.when(t.rlike(_PLAIN), t.try_cast("double")).otherwise(_careful(t))

    return read(text) if isinstance(c, str) else let(text, read)


def is_finite(c) -> Column:
    # nan compares above infinity.
    return F.coalesce(F.abs(as_column(c)) < F.lit(float("inf")), F.lit(False))


def parse_float_finite(c) -> Column:
    text = as_column(c).cast("string")

    def read(t: Column) -> Column:
        odd = let(_careful(t), lambda v: F.when(F.abs(v) < F.lit(float("inf")), v))
        return F.when(t.rlike(_PLAIN), t.try_cast("double")).otherwise(odd)

    # A column needs no lambda, which would not be compiled.
    return read(text) if isinstance(c, str) else let(text, read)


def parse_float(c, default: float = 0.0) -> Column:
    return F.coalesce(parse_float_any(c), F.lit(float(default)))


def parse_float_opt(c) -> Column:
    """Null when blank or unreadable, nan when the text says so."""
    return parse_float_any(c)


def parse_int(c, default: int | None = 0) -> Column:
    text = as_column(c).cast("string")
    value = F.when(text.rlike(_INTEGER), F.regexp_replace(text, rf"{WHITE}|_", "").try_cast("bigint"))
    return value if default is None else F.coalesce(value, F.lit(default).cast("bigint"))


_NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")


def number_column(df, name: str) -> Column:
    """Double view of a manifest column: typed columns are cast, text columns are parsed."""
    if name not in df.columns:
        return F.lit(None).cast("double")
    kind = dict(df.dtypes)[name]
    if kind in _NUMERIC or kind.startswith("decimal"):
        return F.col(name).cast("double")
    return parse_float_any(name)


def integer_column(df, name: str) -> Column:
    if name not in df.columns:
        return F.lit(None).cast("bigint")
    if dict(df.dtypes)[name] in ("tinyint", "smallint", "int", "bigint"):
        return F.col(name).cast("bigint")
    return parse_int(name, default=None)


def flag_column(df, name: str, words=("true",)) -> Column:
    """True when a boolean column is true or a text column spells one of ``words``."""
    if name not in df.columns:
        return F.lit(False)
    if dict(df.dtypes)[name] == "boolean":
        return F.coalesce(F.col(name), F.lit(False))
    return F.lower(F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))).isin(*words)
