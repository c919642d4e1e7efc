"""Prompt and reply tables for an external scorer, and the balanced draws.

The scorer itself (an HTTP model) is outside Spark: postings leave as a prompt
table and come back as a reply table keyed by id, so scoring is a join, and
parsing is ``from_json`` with a corrupt-record column.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as tx

# The labelled fields of a rendered posting, in order.
POSTING_FIELDS = [
    ("Title", "title"), ("Location", "location"), ("Department", "department"),
    ("Salary range", "salary_range"), ("Employment type", "employment_type"),
    ("Required experience", "required_experience"), ("Required education", "required_education"),
    ("Industry", "industry"), ("Function", "function"), ("Has company logo", "has_company_logo"),
    ("Has screening questions", "has_questions"), ("Telecommuting", "telecommuting"),
    ("Company profile", "company_profile"), ("Description", "description"),
    ("Requirements", "requirements"), ("Benefits", "benefits"),
]
MISSING = "(missing)"
REPLY_SCHEMA = "fraud_probability double, reason string, _corrupt string"


def render_posting(max_chars: int = 3000, fields=None) -> Column:
    """``Label: value`` lines ('(missing)' for blanks), cut at ``max_chars``."""
    lines = []
    for label, col in fields or POSTING_FIELDS:
        v = tx.strip(F.col(col).cast("string"))
        lines.append(F.concat(F.lit(f"{label}: "), F.coalesce(F.nullif(v, F.lit("")), F.lit(MISSING))))
    return F.substring(F.concat_ws("\n", *lines), 1, max_chars)


def prompt_table(df: DataFrame, id_col: str = S.ID, max_chars: int = 3000) -> DataFrame:
    return df.select(id_col, render_posting(max_chars).alias("prompt"))


def parse_replies(replies: DataFrame, body: str = "body", stop_reason: str = "stop_reason") -> DataFrame:
    """(…, fraud_probability, reason): refusal / truncation / no text / bad JSON give
    a NULL score and a reason; scores are clamped to [0, 1] (NULL stays NULL)."""
    p = F.from_json(F.col(body), REPLY_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"})
    parsed = replies.withColumn("_p", p)
    sr = F.col(stop_reason)
    prob = F.col("_p.fraud_probability")
    clamped = F.when(prob.isNotNull(), F.least(F.greatest(prob, F.lit(0.0)), F.lit(1.0)))
    bad_json = F.col("_p._corrupt").isNotNull()
    score = (F.when(sr == "refusal", F.lit(None)).when(sr == "max_tokens", F.lit(None))
              .when(F.col(body).isNull(), F.lit(None)).when(bad_json, F.lit(None))
              .otherwise(clamped)).cast("double")
    reason = (F.when(sr == "refusal", F.lit("refused"))
               .when(sr == "max_tokens", F.lit("truncated at max_tokens"))
               .when(F.col(body).isNull(), F.lit("no text block returned"))
               .when(bad_json, F.lit("unparseable JSON"))
               .otherwise(F.col("_p.reason")))
    return parsed.withColumn("fraud_probability", score).withColumn("reason", reason).drop("_p")


def score_with_replies(rows: DataFrame, replies: DataFrame, id_col: str = S.ID) -> DataFrame:
    """Attach parsed replies to the rows they score (inner join on the id)."""
    return rows.join(parse_replies(replies).select(id_col, "fraud_probability", "reason"), id_col)


def quota_sample(df: DataFrame, class_col: str, quotas: dict | int, key: Column,
                 id_col: str = S.ID, shuffle_key: Column | None = None) -> DataFrame:
    """Up to ``quotas[c]`` rows per class, smallest ``key`` first (ties by id), then
    an ``ord`` column from ``shuffle_key``. ``row_number() <= k`` is limited per task
    before the shuffle (WindowGroupLimit), so a large class never gathers in one task."""
    if isinstance(quotas, int):
        limit, quota = quotas, F.lit(quotas)
    else:
        limit = max(quotas.values())
        quota = F.lit(0)
        for c, q in quotas.items():
            quota = F.when(F.col(class_col) == c, F.lit(q)).otherwise(quota)
    w = Window.partitionBy(class_col).orderBy(key, F.col(id_col))
    picked = df.withColumn("_k", key).withColumn("_rn", F.row_number().over(w)) \
               .where(F.col("_rn") <= limit).where(F.col("_rn") <= quota)
    order = Window.orderBy("_k2", id_col)  # over the picked rows only (sum of quotas)
    sk = shuffle_key if shuffle_key is not None else key
    return picked.withColumn("_k2", sk).withColumn("ord", F.row_number().over(order)) \
                 .drop("_k", "_rn", "_k2")


def few_shot_document(sample: DataFrame, class_col: str = S.TARGET, max_chars: int = 3000) -> DataFrame:
    """One row: the rendered, labelled examples in ``ord`` order, blank-line separated."""
    verdict = F.when(F.col(class_col) == 1, F.lit("FRAUDULENT")).otherwise(F.lit("LEGITIMATE"))
    block = F.concat(F.lit("### Example posting\n"), render_posting(max_chars), F.lit("\n\nVerdict: "), verdict)
    items = sample.select(F.struct(F.col("ord"), block.alias("text")).alias("e"))
    doc = items.agg(F.array_sort(F.collect_list("e")).alias("es"))  # bounded by the quotas
    return doc.select(F.concat(F.lit("Here are labelled examples from the same dataset.\n\n"),
                               F.array_join(F.transform("es", lambda e: e["text"]), "\n\n")).alias("document"))


def head_by_hash(df: DataFrame, n: int, key: Column, id_col: str = S.ID) -> DataFrame:
    """A fixed-size, reproducible sample: the ``n`` rows with the smallest key
    (TakeOrdered, no full sort)."""
    return df.withColumn("_k", key).orderBy("_k", id_col).limit(n).drop("_k")
