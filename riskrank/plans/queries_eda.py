"""Queries for the exploratory summaries (E1-E10, E13, E14), over every posting."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import eda
from ..sources.testviews import featured_postings
from . import oracle as O
from .catalog import register

_FLAGS = ["has_email", "has_url", "has_phone", "has_money"]


@register("class_balance", O.with_postings("""
SELECT CAST(fraudulent AS BIGINT) AS fraudulent, n, round(n / sum(n) OVER (), 6) AS share,
       CAST(n = max(n) OVER () AS BIGINT) AS is_majority
FROM (SELECT fraudulent, count(*) AS n FROM featured GROUP BY fraudulent)"""))
def class_balance(spark, sf_dir):
    """Rows and share per class; the majority share is the always-majority accuracy."""
    return eda.class_balance(featured_postings(spark, sf_dir))


@register("flag_rates", O.with_postings(
    "SELECT " + ", ".join(f"round(avg({f}), 6) AS {f}" for f in _FLAGS) + " FROM featured", labelled=False))
def flag_rates(spark, sf_dir):
    """contact/money flag rates overall."""
    return eda.flag_rates(featured_postings(spark, sf_dir, labelled=False), _FLAGS)


@register("flag_rate_by_class", O.with_postings(
    "SELECT CAST(fraudulent AS BIGINT) AS fraudulent, "
    + ", ".join(f"round(avg({f}), 6) AS {f}" for f in _FLAGS) + " FROM featured GROUP BY fraudulent"))
def flag_rate_by_class(spark, sf_dir):
    """Flag rates per class."""
    return eda.flag_rate_by_class(featured_postings(spark, sf_dir), _FLAGS)


_MISS = eda.MISSINGNESS_FLAGS
_LIFT_NAMES = _MISS + ["no_company_logo", "no_screening_questions"]


@register("missingness_lift", O.with_postings(f"""
SELECT flag, round(real, 6) AS real, round(fake, 6) AS fake, round(fake / nullif(real, 0), 6) AS lift,
  row_number() OVER (ORDER BY fake / nullif(real, 0) DESC NULLS LAST, flag) AS lift_rank
FROM (SELECT flag, max(rate) FILTER (WHERE fraudulent = 0) AS real,
             max(rate) FILTER (WHERE fraudulent = 1) AS fake
      FROM (UNPIVOT w ON {", ".join(_LIFT_NAMES)} INTO NAME flag VALUE rate) GROUP BY flag)""",
    extra_ctes="w AS (SELECT fraudulent, " + ", ".join(f"avg({f}) AS {f}" for f in _MISS)
    + ", 1 - avg(has_company_logo) AS no_company_logo, 1 - avg(has_questions) AS no_screening_questions"
    + " FROM featured GROUP BY fraudulent)"))
def missingness_lift(spark, sf_dir):
    """E5: missing rate by class and the fake/real lift."""
    return eda.missingness_lift(featured_postings(spark, sf_dir))


_MED = ["full_text_word_count", "caps_ratio", "exclamation_count"]


def _long_sql(cols, src="featured"):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS field, fraudulent, CAST({c} AS DOUBLE) AS value FROM {src}" for c in cols)


@register("median_by_class", O.with_postings(f"""
SELECT field, CAST(fraudulent AS BIGINT) AS fraudulent, round(quantile_cont(value, 0.5), 6) AS median
FROM ({_long_sql(_MED)}) GROUP BY field, fraudulent"""))
def median_by_class(spark, sf_dir):
    """Exact medians per class (distributed selection, no collected groups)."""
    return eda.median_by_class(featured_postings(spark, sf_dir), _MED)


@register("present_rate", O.with_postings("""
SELECT CAST(fraudulent AS BIGINT) AS fraudulent,
       round(avg(CAST(length(company_profile) > 0 AS DOUBLE)), 6) AS present_rate
FROM featured GROUP BY fraudulent"""))
def present_rate(spark, sf_dir):
    """Share of postings with a company profile, per class."""
    return eda.present_rate(featured_postings(spark, sf_dir), "company_profile")


def _rate_sql(col, min_count, top):
    return O.with_postings(f"""
SELECT {col}, round(avg(fraudulent), 6) AS positive_rate, count(*) AS n
FROM featured WHERE {col} IS NOT NULL GROUP BY {col} HAVING count(*) >= {min_count}
ORDER BY avg(fraudulent) DESC, {col} LIMIT {top}""")


@register("rate_by_category", _rate_sql("required_experience", 30, 12))
def rate_by_category(spark, sf_dir):
    """E8 with the reference's defaults (min 30 rows, top 12)."""
    return eda.rate_by_category(featured_postings(spark, sf_dir), "required_experience", min_count=30, top=12)


@register("rate_by_industry", _rate_sql("industry", 10, 12))
def rate_by_industry(spark, sf_dir):
    """E8 on a 20-value category."""
    return eda.rate_by_category(featured_postings(spark, sf_dir), "industry", min_count=10, top=12)


@register("length_histogram", O.with_postings("""
SELECT CAST(fraudulent AS BIGINT) AS fraudulent, CAST(bin AS BIGINT) AS bin,
       round((bin - 1) * 20.0, 6) AS bin_start, n,
       round(n / (sum(n) OVER (PARTITION BY fraudulent) * 20.0), 6) AS density
FROM (SELECT fraudulent, bin, count(*) AS n FROM (
        SELECT fraudulent, CASE WHEN full_text_word_count = 1200 THEN 60
                                ELSE CAST(floor(full_text_word_count / 20.0) AS BIGINT) + 1 END AS bin
        FROM featured WHERE full_text_word_count >= 0 AND full_text_word_count <= 1200)
      GROUP BY fraudulent, bin)"""))
def length_histogram(spark, sf_dir):
    """Density histogram of full-text words, 60 bins on [0, 1200], per class."""
    return eda.length_histogram(featured_postings(spark, sf_dir), "full_text_word_count")


_BOX = ["company_profile_word_count", "description_word_count", "requirements_word_count",
        "benefits_word_count"]


@register("box_stats", O.with_postings(f"""
SELECT l.field, CAST(l.fraudulent AS BIGINT) AS fraudulent, round(q.q1, 6) AS q1,
       round(q.median, 6) AS median, round(q.q3, 6) AS q3,
       round(min(l.value) FILTER (WHERE l.value >= q.q1 - 1.5 * (q.q3 - q.q1)), 6) AS whislo,
       round(max(l.value) FILTER (WHERE l.value <= q.q3 + 1.5 * (q.q3 - q.q1)), 6) AS whishi
FROM l JOIN q ON l.field = q.field AND l.fraudulent = q.fraudulent
GROUP BY l.field, l.fraudulent, q.q1, q.median, q.q3""",
    extra_ctes=f"""l AS ({_long_sql(_BOX)}),
q AS (SELECT field, fraudulent, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median,
             quantile_cont(value, 0.75) AS q3 FROM l GROUP BY field, fraudulent)"""))
def box_stats(spark, sf_dir):
    """Quartiles and whiskers of per-field word counts by class."""
    return eda.box_stats(featured_postings(spark, sf_dir), _BOX)


@register("pos_weight", O.with_postings("""
SELECT round(CAST(count(*) FILTER (WHERE fraudulent = 0) AS DOUBLE)
             / nullif(count(*) FILTER (WHERE fraudulent = 1), 0), 6) AS scale_pos_weight FROM featured"""))
def pos_weight(spark, sf_dir):
    """Negatives per positive."""
    return eda.scale_pos_weight(featured_postings(spark, sf_dir))


@register("class_weights", O.with_postings("""
SELECT CAST(fraudulent AS BIGINT) AS fraudulent, n,
       round(sum(n) OVER () / (count(*) OVER () * n), 6) AS weight
FROM (SELECT fraudulent, count(*) AS n FROM featured GROUP BY fraudulent)"""))
def class_weights(spark, sf_dir):
    """Balanced class weights n / (2 n_c)."""
    return eda.class_weights(featured_postings(spark, sf_dir))


@register("split_summary", O.with_postings("""
SELECT split, CAST(count(*) AS BIGINT) AS n, round(avg(CAST(fraudulent AS DOUBLE)), 6) AS positive_rate
FROM assigned GROUP BY split""", O.split_ctes("featured")))
def split_summary(spark, sf_dir):
    """E2/A2 summary: rows and positive rate per split."""
    from ..operators import split
    f = featured_postings(spark, sf_dir).select("job_id", "fraudulent")
    return eda.split_summary(split.stratified_split(f, key="arith"))
