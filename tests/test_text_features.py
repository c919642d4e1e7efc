"""Golden rows for the text helpers and row features (expected values follow
Python's str / re / html semantics)."""

import html
import re

import pytest
from pyspark.sql import functions as F

from riskrank.functions import text as tx
from riskrank.operators import features as FT
from riskrank.operators.clean import clean_postings

NBSP = " "


def _one(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def _py_clean(t):
    if t is None:
        return ""
    t = html.unescape(t)
    t = re.sub(r"<[^>]+>", " ", t)
    return re.sub(r"\s+", " ", t).strip()


CLEAN_CASES = [None, "", "<p>a&nbsp;b</p>", "&lt;b&gt;x&lt;/b&gt;", "&amp;lt;", "a\tb\n c", "x < y > z",
               "caf&eacute; &#39;q&#39; &copy", " lead　trail\x1c"]


def test_clean_html_matches_python(spark):
    got = _one(spark, CLEAN_CASES, tx.clean_html)
    assert got == [_py_clean(v) for v in CLEAN_CASES]


def test_strip_and_blank(spark):
    vals = [None, "", " \t", NBSP, "\x1c", " a ", f"{NBSP}b "]
    assert _one(spark, vals, tx.strip) == [None if v is None else v.strip() for v in vals]
    assert _one(spark, vals, tx.is_blank) == [v is None or v.strip() == "" for v in vals]


def test_counts(spark):
    vals = ["", " a  b ", "😀 x", "café crème", f"a{NBSP}b c"]
    assert _one(spark, vals, tx.char_count) == [len(v) for v in vals]
    assert _one(spark, vals, tx.word_count) == [len(v.split()) for v in vals]


def test_caps_and_digit_ratio(spark):
    vals = ["!!!", "ABC", "A1b2", "٣٤ x"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "i int, full_text string")
    got = [(r.caps_ratio, r.digit_ratio) for r in FT.add_text_pattern_features(df).orderBy("i").collect()]
    for v, (caps, dig) in zip(vals, got):
        letters = len(re.findall("[A-Za-z]", v))
        assert caps == pytest.approx(len(re.findall("[A-Z]", v)) / letters if letters else 0.0)
        assert dig == pytest.approx(len(re.findall(r"\d", v)) / len(v) if v else 0.0)


PY = {
    "has_email": re.compile(r"#EMAIL_[0-9a-f]+#|[\w.+-]+@[\w-]+\.[\w.]{2,}", re.IGNORECASE),
    "has_url": re.compile(r"#URL_[0-9a-f]+#|https?://\S+|www\.\S+", re.IGNORECASE),
    "has_phone": re.compile(r"#PHONE_[0-9a-f]+#|\+?\d[\d\s().-]{8,}\d"),
    "has_money": re.compile(r"[$€£]\s?\d|\b\d{2,}\s?k\b|\bper hour\b", re.IGNORECASE),
}
CONTACT_CASES = ["#EMAIL_ab12#", "#email_AB12#", "mail me at jo.doe+x@ex-ample.co.uk", "www.x",
                 "see https://a.b/c", "#URL_ff#", "$ 5", "£5", "45 K", "12 kids", "paid per hour",
                 "Per Hour", "+1 (555) 123-4567", "123456", "#PHONE_1a#", "#phone_1a#",
                 "é12k", "x12k", "12kg", "€3", "tel 555.123.4567 now"]


def test_contact_flags_match_python(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(CONTACT_CASES)], "i int, full_text string")
    rows = FT.add_text_pattern_features(df).orderBy("i").collect()
    for v, r in zip(CONTACT_CASES, rows):
        for k, pat in PY.items():
            assert r[k] == int(bool(pat.search(v))), (k, v)


def test_location_and_salary(spark):
    locs = [None, "", "US, NY, New York", "US, , ", " gb ", "NA, , Windhoek"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(locs)], "i int, location string")
    got = [(r.country, r.location_depth) for r in FT.add_location_features(df).orderBy("i").collect()]
    exp = []
    for v in locs:
        parts = (v or "").split(",")
        c = parts[0].strip().upper()
        exp.append((c if c else "Unknown", sum(1 for p in parts if p.strip())))
    assert got == exp
    sal = ["50000-60000", " 10 - 20 ", "60-50", "10-", "abc", None, "12345678901234567890-1"]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(sal)], "i int, salary_range string")
    got = [(r.salary_low, r.salary_high, r.salary_span) for r in FT.add_salary_features(df).orderBy("i").collect()]
    assert got[0] == (50000.0, 60000.0, 10000.0)
    assert got[1] == (10.0, 20.0, 10.0)
    assert got[2] == (60.0, 50.0, -10.0)
    assert got[3] == got[4] == got[5] == (-1.0, -1.0, -1.0)
    assert got[6][0] == pytest.approx(1.2345678901234567e19)


def test_full_text_and_missing(spark):
    df = spark.createDataFrame([(1, "T", None, "  d  ", "", "b")],
                               "job_id long, title string, company_profile string, description string, "
                               "requirements string, benefits string")
    out = FT.build_full_text(df).first()
    assert out.full_text == "T d b"


def test_clean_postings_categories(spark):
    df = spark.createDataFrame([(1, None, "  x ", "", "\t", "y")],
                               "job_id long, employment_type string, required_experience string, "
                               "required_education string, industry string, function string")
    r = clean_postings(df).first()
    assert (r.employment_type, r.required_experience, r.required_education, r.industry, r.function) == \
        ("Unknown", "x", "Unknown", "Unknown", "y")


def test_tokens_and_bigrams(spark):
    df = spark.createDataFrame([("The Oil & Gas industry, a b cd",)], "t string")
    toks = df.select(tx.remove_words(tx.word_tokens(F.lower("t")), ["the"]).alias("k")).first().k
    assert toks == ["oil", "gas", "industry", "cd"]
    bg = df.select(tx.bigrams(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("b")).first().b
    assert bg == ["a b", "b c"]
    assert df.select(tx.bigrams(F.array(F.lit("a"))).alias("b")).first().b == []
