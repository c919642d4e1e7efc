"""Hand-crafted posting features: missingness, lengths, patterns, location, salary.

All of them are built-in column expressions, so the whole block is one projection
inside whole-stage codegen; nothing shuffles.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import patterns as P
from ..functions import text as tx


def build_full_text(df: DataFrame, columns=None, out: str = S.FULL_TEXT) -> DataFrame:
    columns = columns or S.TEXT_COLUMNS
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in columns])
    return df.withColumn(out, tx.squish(joined))


def add_missing_indicators(df: DataFrame, columns=None) -> DataFrame:
    columns = columns or S.MISSINGNESS_COLUMNS
    return df.withColumns({f"{c}_is_missing": tx.is_blank(c).cast("int") for c in columns})


def add_text_length_features(df: DataFrame, columns=None) -> DataFrame:
    columns = columns or S.TEXT_COLUMNS + [S.FULL_TEXT]
    new = {}
    for c in columns:
        new[f"{c}_char_count"] = tx.char_count(c)
        new[f"{c}_word_count"] = tx.word_count(c)
    return df.withColumns(new)


def _ratio(num, den):
    return F.coalesce(F.try_divide(num.cast("double"), F.nullif(den, F.lit(0)).cast("double")),
                      F.lit(0.0))


def add_text_pattern_features(df: DataFrame, column: str = S.FULL_TEXT) -> DataFrame:
    t = F.coalesce(F.col(column), F.lit(""))
    return df.withColumns({
        "caps_ratio": _ratio(tx.count_chars(t, tx.ASCII_UPPER), tx.count_chars(t, tx.ASCII_LETTERS)),
        "digit_ratio": _ratio(tx.count_chars(t, tx.DIGIT_CHARS), F.length(t)),
        "exclamation_count": tx.count_chars(t, "!"),
        "question_count": tx.count_chars(t, "?"),
        "has_email": ((t.contains("@") | t.contains("#")) & t.rlike(P.EMAIL)).cast("int"),  # the pattern needs one of them
        "has_url": t.rlike(P.URL).cast("int"),
        "has_phone": t.rlike(P.PHONE).cast("int"),
        "has_money": t.rlike(P.MONEY).cast("int"),
    })


def add_location_features(df: DataFrame, column: str = S.LOCATION) -> DataFrame:
    parts = F.split(F.coalesce(F.col(column), F.lit("")), ",")
    first = F.upper(tx.strip(F.get(parts, 0)))
    return df.withColumns({
        "country": F.coalesce(F.nullif(first, F.lit("")), F.lit("Unknown")),
        "location_depth": F.size(F.filter(parts, lambda p: tx.strip(p) != "")),
    })


def add_salary_features(df: DataFrame, column: str = S.SALARY) -> DataFrame:
    raw = F.coalesce(F.col(column), F.lit(""))
    low = F.nullif(F.regexp_extract(raw, P.SALARY, 1), F.lit("")).try_cast("double")
    high = F.nullif(F.regexp_extract(raw, P.SALARY, 2), F.lit("")).try_cast("double")
    return df.withColumns({
        "salary_low": F.coalesce(low, F.lit(-1.0)),
        "salary_high": F.coalesce(high, F.lit(-1.0)),
        "salary_span": F.coalesce(high - low, F.lit(-1.0)),
    })


def add_all_features(df: DataFrame) -> DataFrame:
    """full_text first, then every feature family, in the contract's order."""
    return (df.transform(build_full_text)
              .transform(add_missing_indicators)
              .transform(add_text_length_features)
              .transform(add_text_pattern_features)
              .transform(add_location_features)
              .transform(add_salary_features))
