"""Queries for cleaning, row features, dedupe and the split."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as tx
from ..operators import dedupe, split
from ..sources.tables import table
from ..sources.testviews import featured_postings, raw_postings
from . import oracle as O
from .catalog import register



# -- B1: HTML pages -> text ---------------------------------------------------
@register("clean_pages", f"SELECT page_id, {O.clean_html('html')} AS text FROM pages")
def clean_pages(spark, sf_dir):
    """B1 on every page of ``pages``."""
    pages = table(spark, sf_dir, "pages", spread_key="page_id")
    return pages.select("page_id", tx.clean_html("html").alias("text"))


# -- B2/B3: cleaned postings ----------------------------------------------------
@register("category_normalise", O.with_postings(
    "SELECT job_id, " + ", ".join(O.qi(c) for c in S.CATEGORICAL_COLUMNS) + " FROM clean_postings", labelled=False))
def category_normalise(spark, sf_dir):
    from ..operators.clean import clean_postings
    return raw_postings(spark, sf_dir, labelled=False).transform(clean_postings) \
        .select("job_id", *S.CATEGORICAL_COLUMNS)


@register("full_text", O.with_postings("SELECT job_id, full_text FROM featured", labelled=False))
def full_text(spark, sf_dir):
    return featured_postings(spark, sf_dir, labelled=False).select("job_id", "full_text")


@register("text_cut", O.with_postings("SELECT job_id, left(full_text, 2000) AS text FROM featured", labelled=False))
def text_cut(spark, sf_dir):
    """The first 2,000 characters, as the scorer's prompts take them."""
    f = featured_postings(spark, sf_dir, labelled=False)
    return f.select("job_id", tx.truncate("full_text", 2000).alias("text"))


@register("missing_flags", O.with_postings(
    "SELECT job_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in S.MISSING_FEATURES)
    + " FROM featured", labelled=False))
def missing_flags(spark, sf_dir):
    return featured_postings(spark, sf_dir, labelled=False).select("job_id", *S.MISSING_FEATURES)


@register("text_lengths", O.with_postings(
    "SELECT job_id, " + ", ".join(S.LENGTH_FEATURES) + " FROM featured", labelled=False))
def text_lengths(spark, sf_dir):
    return featured_postings(spark, sf_dir, labelled=False).select("job_id", *S.LENGTH_FEATURES)


@register("caps_digit_ratio", O.with_postings(
    "SELECT job_id, round(caps_ratio, 6) AS caps_ratio, round(digit_ratio, 6) AS digit_ratio "
    "FROM featured", labelled=False))
def caps_digit_ratio(spark, sf_dir):
    return featured_postings(spark, sf_dir, labelled=False).select("job_id", "caps_ratio", "digit_ratio")


@register("punct_counts", O.with_postings(
    "SELECT job_id, exclamation_count, question_count FROM featured", labelled=False))
def punct_counts(spark, sf_dir):
    return featured_postings(spark, sf_dir, labelled=False).select("job_id", "exclamation_count", "question_count")


_CONTACT = ["has_email", "has_url", "has_phone", "has_money"]


@register("contact_flags", O.with_postings(
    "SELECT job_id, " + ", ".join(f"CAST({c} AS BIGINT) AS {c}" for c in _CONTACT) + " FROM featured", labelled=False))
def contact_flags(spark, sf_dir):
    return featured_postings(spark, sf_dir, labelled=False).select("job_id", *_CONTACT)


@register("location_parts", O.with_postings(
    "SELECT job_id, location, country, location_depth FROM featured", labelled=False))
def location_parts(spark, sf_dir):
    return featured_postings(spark, sf_dir, labelled=False).select("job_id", "location", "country", "location_depth")


@register("salary_parts", O.with_postings(
    "SELECT job_id, salary_range, round(salary_low, 6) AS salary_low, "
    "round(salary_high, 6) AS salary_high, round(salary_span, 6) AS salary_span FROM featured", labelled=False))
def salary_parts(spark, sf_dir):
    return featured_postings(spark, sf_dir, labelled=False).select("job_id", "salary_range", "salary_low",
                                                   "salary_high", "salary_span")


# -- C1: exact dedupe -----------------------------------------------------------
@register("dedupe_exact", """
SELECT min(doc_id) AS doc_id, text, lang, source, CAST(n_chars AS BIGINT) AS n_chars
FROM documents GROUP BY text, lang, source, n_chars""")
def dedupe_exact(spark, sf_dir):
    """C1 on ``documents``: copies on every column but ``doc_id``; smallest id kept."""
    docs = table(spark, sf_dir, "documents")
    return dedupe.drop_duplicates_except_id(docs, "doc_id")


@register("dedupe_report", """
SELECT CAST(count(*) AS BIGINT) AS before,
       CAST((SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS BIGINT) AS after,
       CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source, n_chars FROM documents)) AS BIGINT) AS dropped
FROM documents""")
def dedupe_report(spark, sf_dir):
    return dedupe.duplicate_report(table(spark, sf_dir, "documents"), "doc_id")


# -- C2: stratified split (arithmetic key so SQL can replay it) -------------------
def _split_sql():
    return O.with_postings("""
SELECT job_id, CAST(fraudulent AS BIGINT) AS fraudulent, split FROM assigned""",
                           extra_ctes=O.split_ctes("featured"))


@register("stratified_split", _split_sql())
def stratified_split(spark, sf_dir):
    """C2 with the SQL-replayable key; the default key is xxhash64."""
    df = featured_postings(spark, sf_dir).select("job_id", "fraudulent")
    return split.stratified_split(df, key="arith").select("job_id", "fraudulent", "split")


@register("split_sizes", O.with_postings("""
SELECT split, CAST(fraudulent AS BIGINT) AS fraudulent, CAST(n AS BIGINT) AS n FROM (
  SELECT 'test' AS split, fraudulent, test_c AS n FROM val_q
  UNION ALL SELECT 'val', fraudulent, val_c FROM val_q
  UNION ALL SELECT 'train', fraudulent, n - test_c - val_c FROM val_q) WHERE n > 0""",
    extra_ctes=O.split_ctes("featured")))
def split_sizes(spark, sf_dir):
    """C2 with the production key (xxhash64): rows per (split, class) equal the quotas."""
    df = featured_postings(spark, sf_dir).select("job_id", "fraudulent")
    s = split.stratified_split(df)
    return s.groupBy("split", "fraudulent").agg(F.count(F.lit(1)).alias("n"))


def _processed_sql():
    from .. import schema as S
    raw_cols = [c for c in S.RAW_COLUMNS if c != "job_id"]
    dedup = ("raw_dedup AS (SELECT min(job_id) AS job_id, " + ", ".join(O.qi(c) for c in raw_cols)
             + " FROM raw_postings GROUP BY " + ", ".join(O.qi(c) for c in raw_cols) + ")")
    ctes = O.POSTING_CTES.replace("FROM raw_postings)", "FROM raw_dedup)", 1)
    ctes = ctes.replace("FROM documents d JOIN labels l ON d.doc_id = l.doc_id),",
                        "FROM documents d JOIN labels l ON d.doc_id = l.doc_id),\n" + dedup + ",", 1)
    doubles = {"caps_ratio", "digit_ratio", "salary_low", "salary_high", "salary_span"}
    ints = set(S.MISSING_FEATURES) | set(S.BINARY_COLUMNS) | {"has_email", "has_url", "has_phone",
                                                               "has_money", "fraudulent"}
    feat_cols = (S.RAW_COLUMNS + [S.FULL_TEXT] + S.MISSING_FEATURES + S.LENGTH_FEATURES + S.PATTERN_FEATURES
                 + ["country"] + S.LOCATION_FEATURES + S.SALARY_FEATURES)
    sel = []
    for c in dict.fromkeys(feat_cols):
        if c in doubles:
            sel.append(f"round(f.{c}, 6) AS {c}")
        elif c in ints:
            sel.append(f"CAST(f.{c} AS BIGINT) AS {c}")
        else:
            sel.append(f"f.{O.qi(c)} AS {O.qi(c)}")
    return ("WITH " + ctes + ",\n" + O.split_ctes("featured") + "\nSELECT " + ", ".join(sel)
            + ", a.split FROM featured f JOIN assigned a USING (job_id)")


@register("processed_dataset", _processed_sql())
def processed_dataset(spark, sf_dir):
    """A5: dedupe -> clean -> features -> split over the raw posting view (SQL-replayable key)."""
    from .dataset import processed
    return processed(raw_postings(spark, sf_dir), key="arith")
