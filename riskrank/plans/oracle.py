"""DuckDB SQL builders for the oracle side of the correctness gate.

Each helper returns a SQL expression string equal in meaning to the Spark column
function of the same name in ``functions.text`` / ``operators.features``. DuckDB's
RE2 has no look-behind and ASCII ``\\s``/``\\d``, so the same explicit classes are used.
"""

from __future__ import annotations

from ..functions.text import DIGIT, SPACE, WORD

S = SPACE
W = WORD


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, {q(f'^[{S}]+|[{S}]+$')}, '', 'g')"


def squish(x: str) -> str:
    collapsed = f"regexp_replace({x}, {q(f'[{S}]+')}, ' ', 'g')"
    return f"regexp_replace({collapsed}, '^ | $', '', 'g')"


def is_blank(x: str) -> str:
    return f"({x} IS NULL OR NOT regexp_matches({x}, {q(f'[^{S}]')}))"


def rcount(x: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all(coalesce({x}, ''), {q(pattern)})) AS BIGINT)"


def unescape4(x: str) -> str:
    """The four named entities present in the test pages; ``&amp;`` last so a
    double-escaped entity is decoded once, like ``html.unescape``."""
    out = x
    for ent, ch in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
        out = f"replace({out}, {q(ent)}, {q(ch)})"
    return out


def clean_html(x: str) -> str:
    untagged = f"regexp_replace({unescape4(f"coalesce({x}, '')")}, '<[^>]+>', ' ', 'g')"
    return squish(untagged)


def ratio(num: str, den: str) -> str:
    return f"coalesce(CAST({num} AS DOUBLE) / nullif(CAST({den} AS DOUBLE), 0), 0.0)"


EMAIL = rf"(?i)#EMAIL_[0-9a-f]+#|[{W}.+-]+@[{W}-]+\.[{W}.]{{2,}}"
URL = rf"(?i)#URL_[0-9a-f]+#|https?://[^{S}]+|www\.[^{S}]+"
PHONE = rf"#PHONE_[0-9a-f]+#|\+?{DIGIT}[{DIGIT}{S}().-]{{8,}}{DIGIT}"
MONEY = (rf"(?i)[$€£][{S}]?{DIGIT}|(^|[^{W}]){DIGIT}{{2,}}[{S}]?k([^{W}]|$)"
         rf"|(^|[^{W}])per hour([^{W}]|$)")
SALARY = rf"^[{S}]*({DIGIT}+)[{S}]*-[{S}]*({DIGIT}+)[{S}]*$"

_LINE = "string_split(d.text, chr(10))"

RAW_POSTINGS = f"""raw_postings AS (
  SELECT d.doc_id AS job_id,
    {_LINE}[1] AS title,
    concat_ws(', ', upper(d.lang),
              CASE WHEN d.doc_id % 3 = 0 THEN '' ELSE d.source END,
              CASE WHEN d.doc_id % 2 = 0 THEN '' ELSE 'City' || CAST(d.doc_id % 7 AS VARCHAR) END) AS location,
    CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE d.source END AS department,
    CASE WHEN d.doc_id % 6 = 0 THEN CAST((20 + d.doc_id % 50) * 1000 AS VARCHAR) || '-'
                                   || CAST((30 + d.doc_id % 60) * 1000 AS VARCHAR)
         WHEN d.doc_id % 6 = 1 THEN 'negotiable' END AS salary_range,
    CASE WHEN d.doc_id % 3 = 0 THEN NULL WHEN d.doc_id % 3 = 1 THEN '  '
         ELSE {_LINE}[2] END AS company_profile,
    d.text AS description,
    {_LINE}[3] AS requirements,
    {_LINE}[4] AS benefits,
    CAST(d.doc_id % 2 AS INTEGER) AS telecommuting,
    CAST(l.quality AS INTEGER) AS has_company_logo,
    CAST(d.doc_id % 3 = 0 AS INTEGER) AS has_questions,
    CASE WHEN d.doc_id % 5 = 0 THEN NULL WHEN d.doc_id % 5 = 1 THEN '  ' ELSE d.lang END AS employment_type,
    'L' || CAST(d.doc_id % 4 AS VARCHAR) AS required_experience,
    'E' || CAST(d.doc_id % 3 AS VARCHAR) AS required_education,
    d.source AS industry,
    d.source AS "function",
    CAST(l.toxic AS INTEGER) AS fraudulent
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""

_TEXT = ["title", "company_profile", "description", "requirements", "benefits"]
_CATS = ["employment_type", "required_experience", "required_education", "industry", "function"]
_MISS = ["company_profile", "description", "requirements", "benefits", "location",
         "salary_range", "department"]


def _cat(c: str) -> str:
    return f"coalesce(nullif({strip(qi(c))}, ''), 'Unknown')"


def qi(c: str) -> str:
    return f'"{c}"'


CLEAN_POSTINGS = ("clean_postings AS (\n  SELECT job_id, "
                  + ", ".join(f"{clean_html(c)} AS {c}" for c in _TEXT + ["location"]) + ",\n  "
                  + "department, salary_range, telecommuting, has_company_logo, has_questions, "
                  + ", ".join(f"{_cat(c)} AS {qi(c)}" for c in _CATS)
                  + ", fraudulent\n  FROM raw_postings)")

_FT = "full_text"
_PARTS = "string_split(coalesce(location, ''), ',')"
_LOW = f"try_cast(nullif(regexp_extract(coalesce(salary_range, ''), {q(SALARY)}, 1), '') AS DOUBLE)"
_HIGH = f"try_cast(nullif(regexp_extract(coalesce(salary_range, ''), {q(SALARY)}, 2), '') AS DOUBLE)"

WITH_FULL_TEXT = ("with_full_text AS (SELECT *, "
                  + squish("concat_ws(' ', " + ", ".join(f"coalesce({c}, '')" for c in _TEXT) + ")")
                  + " AS full_text FROM clean_postings)")

_feature_exprs = (
    [f"CAST({is_blank(c)} AS INTEGER) AS {c}_is_missing" for c in _MISS]
    + [e for c in _TEXT + [_FT] for e in (
        f"CAST(length(coalesce({c}, '')) AS BIGINT) AS {c}_char_count",
        f"{rcount(c, f'[^{S}]+')} AS {c}_word_count")]
    + [f"{ratio(rcount(_FT, '[A-Z]'), rcount(_FT, '[A-Za-z]'))} AS caps_ratio",
       f"{ratio(rcount(_FT, DIGIT), f'length({_FT})')} AS digit_ratio",
       f"{rcount(_FT, '!')} AS exclamation_count",
       f"{rcount(_FT, chr(92) + '?')} AS question_count",
       f"CAST(regexp_matches({_FT}, {q(EMAIL)}) AS INTEGER) AS has_email",
       f"CAST(regexp_matches({_FT}, {q(URL)}) AS INTEGER) AS has_url",
       f"CAST(regexp_matches({_FT}, {q(PHONE)}) AS INTEGER) AS has_phone",
       f"CAST(regexp_matches({_FT}, {q(MONEY)}) AS INTEGER) AS has_money",
       f"coalesce(nullif(upper({strip(_PARTS + '[1]')}), ''), 'Unknown') AS country",
       f"CAST(len(list_filter({_PARTS}, lambda p: {strip('p')} <> '')) AS BIGINT) AS location_depth",
       f"coalesce({_LOW}, -1.0) AS salary_low",
       f"coalesce({_HIGH}, -1.0) AS salary_high",
       f"coalesce({_HIGH} - {_LOW}, -1.0) AS salary_span"])

FEATURED = "featured AS (SELECT *, " + ",\n  ".join(_feature_exprs) + " FROM with_full_text)"

POSTING_CTES = ",\n".join([RAW_POSTINGS, CLEAN_POSTINGS, WITH_FULL_TEXT, FEATURED])

SCORES = """scores AS (
  SELECT 'length_score' AS model, d.doc_id AS job_id, CAST(l.toxic AS INTEGER) AS y_true,
         round(CAST(d.n_chars % 1000 AS DOUBLE) / 1000.0, 3) AS y_proba
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id
  UNION ALL
  SELECT 'hash_score', d.doc_id, CAST(l.toxic AS INTEGER), CAST(d.doc_id * 37 % 101 AS DOUBLE) / 101.0
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def with_postings(select_sql: str, extra_ctes: str = "", labelled: bool = True) -> str:
    """``labelled=False`` keeps the documents without a label, as ``testviews`` does."""
    postings = POSTING_CTES if labelled else POSTING_CTES.replace("FROM documents d JOIN", "FROM documents d LEFT JOIN")
    ctes = postings + (",\n" + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{select_sql}"


def with_scores(select_sql: str, extra_ctes: str = "") -> str:
    ctes = SCORES + (",\n" + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{select_sql}"


JOBS = """jobs AS (SELECT d.doc_id AS job_id, CAST(l.toxic AS INTEGER) AS fraudulent
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def split_ctes(src: str = "featured", test_frac=0.15, val_frac=0.15, seed=42) -> str:
    """Exact-quota stratified split with the arithmetic key; ends with ``assigned``
    (job_id, fraudulent, split)."""
    rel = val_frac / (1.0 - test_frac)
    return f"""keyed AS (SELECT job_id, fraudulent, ((job_id * 7919 + {seed}) % 100003 + 100003) % 100003 AS k FROM {src}),
cls AS (SELECT fraudulent, count(*) AS n FROM keyed GROUP BY fraudulent),
tot AS (SELECT sum(n) AS total, CAST(ceil({test_frac} * sum(n)) AS BIGINT) AS n_test FROM cls),
tr1 AS (SELECT c.fraudulent, c.n, CAST(c.n AS DOUBLE) / t.total * (t.total - t.n_test) AS cont,
               t.total - t.n_test AS draws FROM cls c, tot t),
tr1r AS (SELECT *, floor(cont) AS fl, row_number() OVER (ORDER BY cont - floor(cont) DESC, fraudulent) AS rr,
               draws - sum(floor(cont)) OVER () AS need FROM tr1),
test_q AS (SELECT fraudulent, n, n - (fl + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS test_c FROM tr1r),
rest AS (SELECT fraudulent, n - test_c AS m, test_c FROM test_q),
rtot AS (SELECT sum(m) AS total, CAST(ceil({rel!r} * sum(m)) AS BIGINT) AS n_val FROM rest),
tr2 AS (SELECT r.fraudulent, r.m, r.test_c, CAST(r.m AS DOUBLE) / t.total * (t.total - t.n_val) AS cont,
               t.total - t.n_val AS draws FROM rest r, rtot t),
tr2r AS (SELECT *, floor(cont) AS fl, row_number() OVER (ORDER BY cont - floor(cont) DESC, fraudulent) AS rr,
               draws - sum(floor(cont)) OVER () AS need FROM tr2),
val_q AS (SELECT fraudulent, test_c, m - (fl + CASE WHEN rr <= need THEN 1 ELSE 0 END) AS val_c,
                 m + test_c AS n FROM tr2r),
ranked AS (SELECT *, row_number() OVER (PARTITION BY fraudulent ORDER BY k, job_id) AS r FROM keyed),
assigned AS (SELECT job_id, fraudulent,
  CASE WHEN r <= test_c THEN 'test' WHEN r <= test_c + val_c THEN 'val' ELSE 'train' END AS split
  FROM ranked JOIN val_q USING (fraudulent))"""


def curve_ctes(src: str, groups=(), name: str = "curve") -> str:
    """Distinct-score curve table (``threshold pos neg tp fp P N precision recall fpr tpr``)."""
    g = ", ".join(groups)
    gsel = g + ", " if g else ""
    part = f"PARTITION BY {g} " if g else ""
    return f"""{name}_counts AS (SELECT {gsel}CAST(y_proba AS DOUBLE) AS threshold,
    count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true <> 1) AS neg
  FROM {src} WHERE y_proba IS NOT NULL GROUP BY {gsel}CAST(y_proba AS DOUBLE)),
{name}_cum AS (SELECT *, sum(pos) OVER (w ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
    sum(neg) OVER (w ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp,
    sum(pos) OVER w AS "P", sum(neg) OVER w AS "N"
  FROM {name}_counts WINDOW w AS ({part})),
{name} AS (SELECT *, CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS "precision",
    CASE WHEN "P" = 0 THEN 1.0 ELSE CAST(tp AS DOUBLE) / "P" END AS recall,
    CASE WHEN "N" > 0 THEN CAST(fp AS DOUBLE) / "N" ELSE 0.0 END AS fpr,
    CASE WHEN "P" > 0 THEN CAST(tp AS DOUBLE) / "P" ELSE 0.0 END AS tpr
  FROM {name}_cum)"""


def fbeta(beta: float, p: str = '"precision"', r: str = "recall") -> str:
    b2 = beta * beta
    return f"CASE WHEN {b2!r} * {p} + {r} > 0 THEN (1 + {b2!r}) * {p} * {r} / ({b2!r} * {p} + {r}) ELSE 0.0 END"


AP = 'coalesce(sum(CAST(pos AS DOUBLE) / nullif("P", 0) * "precision"), 0.0)'
AUC = 'sum(neg * (tp - pos / 2.0)) / nullif(CAST(max("P") AS DOUBLE) * max("N"), 0)'

REPLIES = """replies AS (SELECT d.doc_id AS job_id,
    CASE WHEN d.doc_id % 11 = 0 THEN 'refusal' WHEN d.doc_id % 13 = 0 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason,
    CASE WHEN d.doc_id % 17 = 0 THEN NULL WHEN d.doc_id % 19 = 0 THEN 'not json {'
         WHEN d.doc_id % 23 = 0 THEN '{"reason": "' || d.source || '"}'
         ELSE '{"fraud_probability": ' || CAST(CAST(d.n_chars % 150 AS DOUBLE) / 100.0 AS VARCHAR)
              || ', "reason": "' || d.source || '"}' END AS body
  FROM documents d),
parsed AS (SELECT job_id,
    CASE WHEN stop_reason IN ('refusal', 'max_tokens') OR body IS NULL OR NOT json_valid(body) THEN NULL
         WHEN TRY_CAST(json_extract_string(body, '$.fraud_probability') AS DOUBLE) IS NULL THEN NULL
         ELSE least(greatest(TRY_CAST(json_extract_string(body, '$.fraud_probability') AS DOUBLE), 0.0), 1.0) END
      AS fraud_probability,
    CASE WHEN stop_reason = 'refusal' THEN 'refused' WHEN stop_reason = 'max_tokens' THEN 'truncated at max_tokens'
         WHEN body IS NULL THEN 'no text block returned' WHEN NOT json_valid(body) THEN 'unparseable JSON'
         ELSE json_extract_string(body, '$.reason') END AS reason
  FROM replies)"""
