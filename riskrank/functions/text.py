"""Text column functions with Python ``str`` semantics, kept JVM-side.

Java's ``\\s``/``\\w``/``\\d`` are ASCII by default and ``trim`` strips only spaces,
while the behaviour to match is Python's Unicode ``str``. Every helper here uses
explicit character classes so Spark, DuckDB (the oracle) and Python agree:

* whitespace = exactly the characters ``str.isspace()`` accepts;
* word character = ``[\\p{L}\\p{N}_]`` (equal to Python's ``\\w``);
* digit = ``\\p{Nd}`` (equal to Python's ``\\d``).

Four steps run in Python, as Arrow-batched pandas UDFs: HTML cleaning (entities of the HTML5
table, tags, whitespace, in one go), accent stripping (NFKD; NULL for every pure ASCII row),
whitespace collapsing and word counts. The last two are ``str.split``, a fraction of the time
of a regex with the Unicode classes.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The code points Python's str.isspace() accepts (Unicode White_Space
# plus U+001C..U+001F), written as a regex character-class body (Java and RE2 syntax).
SPACE = (r"\t\n\x{0B}\f\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
         r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WORD = r"\p{L}\p{N}_"
DIGIT = r"\p{Nd}"

# The same whitespace set as literal characters (for btrim / translate).
SPACE_CHARS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
# Unicode decimal digits (category Nd), built by rule: Python's \d.
DIGIT_CHARS = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Nd")
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LETTERS = ASCII_UPPER + ASCII_UPPER.lower()

TAG = r"<[^>]+>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace (a set
    trim, no regex)."""
    return F.btrim(_col(c), F.lit(SPACE_CHARS))


@F.pandas_udf(T.StringType())
def _squish(s: pd.Series) -> pd.Series:
    return s.map(lambda v: " ".join(v.split()) if isinstance(v, str) else None)


def squish(c) -> Column:
    """Collapse whitespace runs into one space each, then strip (``' '.join(s.split())``)."""
    return _squish(_col(c))


def is_blank(c) -> Column:
    """NULL or whitespace-only (the reference's missing-value predicate)."""
    c = _col(c)
    return c.isNull() | (strip(c) == "")


def char_count(c) -> Column:
    """Code points, NULL counted as ''."""
    return F.length(F.coalesce(_col(c), F.lit("")))


@F.pandas_udf(T.IntegerType())
def _word_count(s: pd.Series) -> pd.Series:
    return s.map(lambda v: len(v.split())).astype("int32")


def word_count(c) -> Column:
    """Whitespace-separated tokens (``len(s.split())``), blank -> 0. (``regexp_count`` copies the rest of
    the text at every match: its time grows with the square of a text's length.)"""
    return _word_count(F.coalesce(_col(c), F.lit("")))


def count_chars(c, chars: str) -> Column:
    """Occurrences of any character of ``chars`` (a translate or replace, no regex)."""
    t = F.coalesce(_col(c), F.lit(""))
    rest = F.replace(t, F.lit(chars), F.lit("")) if len(chars) == 1 else F.translate(t, chars, "")
    return F.length(t) - F.length(rest)


@F.pandas_udf(T.StringType())
def _html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda v: html.unescape(v) if isinstance(v, str) else None)


def html_unescape(c) -> Column:
    """Decode HTML entities once (``html.unescape``). Rows without '&' never leave
    the JVM: the UDF sees NULL for them and ``coalesce`` keeps the original."""
    c = _col(c)
    return F.coalesce(_html_unescape(F.when(c.contains("&"), c)), c)


@F.pandas_udf(T.StringType())
def _clean_html(s: pd.Series) -> pd.Series:
    tag = re.compile(TAG)

    def clean(v):
        v = html.unescape(v) if "&" in v else v
        return " ".join((tag.sub(" ", v) if "<" in v else v).split())
    return s.map(clean)


def clean_html(c) -> Column:
    """NULL -> '', decode entities first, tags -> ' ', collapse whitespace, strip."""
    return _clean_html(F.coalesce(_col(c), F.lit("")))


def _strip_accents_py(v):
    if not isinstance(v, str):
        return None
    return "".join(ch for ch in unicodedata.normalize("NFKD", v) if not unicodedata.combining(ch))


@F.pandas_udf(T.StringType())
def _strip_accents(s: pd.Series) -> pd.Series:
    return s.map(_strip_accents_py)


def strip_accents(c) -> Column:
    """NFKD then drop combining marks; pure-ASCII rows stay in the JVM."""
    c = _col(c)
    return F.coalesce(_strip_accents(F.when(c.rlike(r"[^\x{00}-\x{7F}]"), c)), c)


def word_tokens(c) -> Column:
    """Runs of two or more word characters (the default token rule)."""
    return F.regexp_extract_all(_col(c), F.lit(f"[{WORD}]{{2,}}"), F.lit(0))


def remove_words(tokens, words) -> Column:
    """Drop tokens found in ``words`` (an In/InSet test inside a lambda)."""
    words = list(words)
    return F.filter(_col(tokens), lambda t: ~t.isin(words))


def bigrams(tokens) -> Column:
    """Adjacent pairs joined by one space; empty for arrays shorter than two."""
    t = _col(tokens)
    pairs = F.zip_with(t, F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))),
                       lambda a, b: F.concat_ws(" ", a, b))
    return F.slice(pairs, 1, F.greatest(F.size(t) - 1, F.lit(0)))


def truncate(c, n: int) -> Column:
    """Prefix of ``n`` characters (used only where the reference cuts text)."""
    return F.substring(_col(c), 1, n)
