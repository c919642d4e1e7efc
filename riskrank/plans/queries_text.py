"""Queries for the text operators: TF-IDF vocabulary and weights (H1), top
n-grams per class (E11) and word frequencies (E12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.text import DIGIT, WORD
from ..operators import tfidf
from ..sources.testviews import featured_postings
from . import oracle as O
from .catalog import register

_STOP = "[" + ", ".join(O.q(w) for w in tfidf.english_stop_words()) + "]"
_TOKEN2 = O.q(f"[{WORD}]{{2,}}")


def _toks(expr):
    return (f"list_filter(regexp_extract_all({expr}, {_TOKEN2}), "
            f"lambda w: NOT list_contains({_STOP}, w))")


_BIGRAMS = "list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1])"

_TFIDF_CTES = f"""tf_docs AS (SELECT job_id AS id, {_toks("strip_accents(lower(coalesce(full_text, '')))")} AS t
  FROM featured),
tf_terms AS (SELECT id, unnest(list_concat(t, {_BIGRAMS})) AS term FROM tf_docs),
tf AS (SELECT id, term, count(*) AS tf FROM tf_terms GROUP BY id, term),
ndocs AS (SELECT count(*) AS n FROM featured),
stats AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term),
kept AS (SELECT stats.*, ndocs.n FROM stats, ndocs WHERE df >= 3 AND df <= 0.9 * n
         ORDER BY total DESC, term LIMIT 50000),
vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS term_id, df, total,
                 ln((1.0 + n) / (1.0 + df)) + 1.0 AS idf FROM kept)"""


def _fit(spark, sf_dir):
    docs = featured_postings(spark, sf_dir, labelled=False).select("job_id", "full_text")
    return docs, tfidf.fit(docs, "job_id", "full_text")


@register("tfidf_vocab", O.with_postings(
    """SELECT term, CAST(term_id AS BIGINT) AS term_id, CAST(df AS BIGINT) AS df,
       CAST(total AS BIGINT) AS total, round(idf, 6) AS idf FROM vocab""", _TFIDF_CTES, labelled=False))
def tfidf_vocab(spark, sf_dir):
    """H1a-e, H1g: the fitted vocabulary with document frequency and smoothed idf."""
    _, model = _fit(spark, sf_dir)
    return model.vocabulary


@register("tfidf_weights", O.with_postings(
    """SELECT id AS job_id, CAST(term_id AS BIGINT) AS term_id,
       round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 6) AS weight
FROM (SELECT tf.id, v.term_id, (1 + ln(tf.tf)) * v.idf AS w FROM tf JOIN vocab v USING (term))""",
    _TFIDF_CTES, labelled=False))
def tfidf_weights(spark, sf_dir):
    """H1f, H1h: sublinear tf * idf, L2-normalised per posting."""
    docs, model = _fit(spark, sf_dir)
    return model.transform(docs, "job_id", "full_text") \
                .select(F.col("id").alias("job_id"), "term_id", "weight")


@register("top_bigrams", O.with_postings(
    """SELECT cls AS fraudulent, CAST("rank" AS BIGINT) AS "rank", term, CAST(cnt AS BIGINT) AS "count"
FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY cnt DESC, term) AS "rank"
      FROM tb_stats WHERE df >= 3) WHERE "rank" <= 15""",
    f"""tb_docs AS (SELECT job_id AS id, fraudulent AS cls, {_toks("lower(coalesce(full_text, ''))")} AS t
  FROM featured),
tb_terms AS (SELECT id, cls, unnest({_BIGRAMS}) AS term FROM tb_docs),
tb_tf AS (SELECT id, cls, term, count(*) AS tf FROM tb_terms GROUP BY id, cls, term),
tb_stats AS (SELECT cls, term, sum(tf) AS cnt, count(*) AS df FROM tb_tf GROUP BY cls, term)"""))
def top_bigrams(spark, sf_dir):
    """15 most frequent bigrams per class (doc freq >= 3 within the class)."""
    f = featured_postings(spark, sf_dir)
    return tfidf.top_ngrams(f, "full_text", "fraudulent", n=15, ngram=(2, 2), min_df=3)


_WF_TOKEN = O.q(tfidf.WORD_FREQ_TOKEN)


@register("word_freq", O.with_postings(
    """SELECT cls AS fraudulent, CAST("rank" AS BIGINT) AS "rank", word, CAST(n AS BIGINT) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY cls ORDER BY n DESC, word) AS "rank"
      FROM (SELECT cls, word, count(*) AS n FROM wf_words GROUP BY cls, word)) WHERE "rank" <= 200""",
    f"""wf_raw AS (SELECT fraudulent AS cls, unnest(regexp_extract_all(lower(coalesce(full_text, '')), {_WF_TOKEN})) AS w
  FROM featured),
wf_words AS (SELECT cls, regexp_replace(w, '''s$', '') AS word FROM wf_raw
  WHERE NOT regexp_matches(regexp_replace(w, '''s$', ''), {O.q(f'^{DIGIT}+$')})
    AND length(regexp_replace(w, '''s$', '')) > 0
    AND NOT list_contains({_STOP}, regexp_replace(w, '''s$', '')))"""))
def word_freq(spark, sf_dir):
    """Word-cloud frequencies per class (every text, top 200 words)."""
    f = featured_postings(spark, sf_dir)
    return tfidf.word_frequencies(f, "full_text", "fraudulent", top=200)
