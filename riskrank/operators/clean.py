"""Cleaning of the raw posting table (row-local, one narrow stage)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as tx


def clean_text_columns(df: DataFrame, columns=None) -> DataFrame:
    """HTML -> text on the text fields and ``location``; NULL becomes ''."""
    columns = columns or S.TEXT_COLUMNS + [S.LOCATION]
    return df.withColumns({c: tx.clean_html(c) for c in columns if c in df.columns})


def normalise_categories(df: DataFrame, columns=None) -> DataFrame:
    """NULL/blank -> 'Unknown', otherwise stripped."""
    columns = columns or S.CATEGORICAL_COLUMNS
    return df.withColumns({
        c: F.coalesce(F.nullif(tx.strip(F.col(c)), F.lit("")), F.lit("Unknown"))
        for c in columns if c in df.columns})


def clean_postings(df: DataFrame) -> DataFrame:
    """Text fields + location cleaned, categories normalised; target untouched."""
    return df.transform(clean_text_columns).transform(normalise_categories)
