"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SHARDS = [(f"shard{i:02d}", 2 if i < 4 else 1) for i in range(16)]
#: Target weights of the mix. The domain of a document is the last digit of its source.
MIX_WEIGHTS = {"domain": {"0": 1.0, "1": 2.0, "2": 0.5}, "lang": {"en": 4.0, "de": 2.0}, "source": {"src0": 0.5}}
MIX_FRACTION = 0.8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def crc_of(id_col: str, mod: int):
    """crc32 of the id's text, modulo ``mod`` (null ids count as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


@register("op1_quality_rules")
def op1_quality_rules(spark, sf_dir):
    from .isolation import quality_rules
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def _maglev_sql(size: int) -> str:
    names = sorted(SHARDS)
    turns = [i + 1 for i, (_, w) in enumerate(names) for _ in range(w)]
    h = "CAST('0x' || substr(md5('{}:' || name), 1, 15) AS BIGINT) % {}"
    return f"""
WITH RECURSIVE shards AS (
  SELECT list(name ORDER BY name) AS names, list({h.format('offset', size)} ORDER BY name) AS off,
         list({h.format('skip', size - 1)} + 1 ORDER BY name) AS skip
  FROM (SELECT unnest({[n for n, _ in names]}) AS name)),
fill(claim, slot, taken) AS (
  SELECT 0, CAST(NULL AS BIGINT), list_resize(CAST([] AS BIGINT[]), {size}, 0) FROM shards
  UNION ALL
  SELECT claim + 1, s, list_concat(taken[:s], [t], taken[s + 2:]) FROM (
    SELECT claim, taken, t, (off[t] + list_position(list_transform(range({size}),
             lambda j: taken[CAST((off[t] + j * skip[t]) % {size} AS BIGINT) + 1] = 0), true) * skip[t] - skip[t]) % {size} AS s
    FROM (SELECT *, CAST({turns}[claim % {len(turns)} + 1] AS BIGINT) AS t FROM fill, shards WHERE claim < {size}))),
lookup AS (SELECT unnest(range({size})) AS slot, unnest(taken) AS i FROM fill WHERE claim = {size})
SELECT doc_id, CAST(slot AS INTEGER) AS slot, names[i] AS shard FROM (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {size} AS slot
  FROM documents) JOIN lookup USING (slot), shards"""


@register("op2_shard_placement", _maglev_sql(2053))
def op2_shard_placement(spark, sf_dir):
    from .sharding import place
    return place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", SHARDS)


@register("op3_simhash_near_dedup")
def op3_simhash_near_dedup(spark, sf_dir):
    from .simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"))


@register("op4_warc_round_trip", """
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN revisit THEN best END AS refers_to
FROM (SELECT *, n >= 1000 AND best IS NOT NULL AND (page_id IS NULL OR page_id < best) AS revisit
  FROM (SELECT page_id, html, strlen(html) AS n, max(page_id) OVER (PARTITION BY html) AS best
    FROM (SELECT page_id, coalesce(html, '') AS html FROM pages)))""")
def op4_warc_round_trip(spark, sf_dir):
    from .warc import read_records, write_archives
    return read_records(write_archives(table(spark, sf_dir, "pages"))) \
        .select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@register("op5_nearest_neighbours")
def op5_nearest_neighbours(spark, sf_dir):
    from .neighbours import nearest
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@register("op6_quality_classifier")
def op6_quality_classifier(spark, sf_dir):
    from .subword import fit_quality, score
    docs = table(spark, sf_dir, "documents")
    odds = fit_quality(docs, table(spark, sf_dir, "labels"), crc_of("id", 5) != 0)
    return score(docs, odds).select("doc_id", (crc_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@register("op7_substring_dedup")
def op7_substring_dedup(spark, sf_dir):
    from .chunks import without_repeats
    out = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("row.doc_id", F.col("clean").alias("text"), "n_removed_chunks", "n_removed_words")


@register("op8_sentencepiece")
def op8_sentencepiece(spark, sf_dir):
    from .pieces import Pieces, encode
    return encode(table(spark, sf_dir, "documents"), Pieces.from_model())


@register("op9_katz_scores")
def op9_katz_scores(spark, sf_dir):
    from .katz import lm_scores
    out = lm_scores(table(spark, sf_dir, "documents"), crc_of("doc_id", 7) != 2)
    return out.withColumn("held_out", crc_of("doc_id", 7) == 2)


def _level_sql(up: str, path: str) -> str:
    """Budgets of the children on one level, given their parents' (``up``)."""
    keys = path.split(", ")
    parent, tie = ", ".join(keys[:-1]) or "1", path
    join = f"JOIN {up} USING ({parent})" if up else "CROSS JOIN root"
    weights = MIX_WEIGHTS.get(keys[-1], {})
    weight = "CASE " + " ".join(f"WHEN {keys[-1]} = '{n}' THEN {w}" for n, w in weights.items()) + " ELSE 1.0 END"
    return f"""(SELECT {path}, CASE WHEN lvl IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), w * lvl) END AS b
  FROM (SELECT *, max(CASE WHEN cap / w > lv THEN lv END) OVER (PARTITION BY {parent}) AS lvl
    FROM (SELECT *, (pb - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / w, {tie} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
               / sum(w) OVER (PARTITION BY {parent} ORDER BY cap / w, {tie} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv
      FROM (SELECT {path}, CAST({weight} AS DOUBLE) AS w, sum(cap) AS cap FROM leaves GROUP BY ALL) {join})))"""


def domain_of(source):
    return F.substring(F.coalesce(source, F.lit("")), -1, 1)


@register("op10_mix_sources", f"""
WITH docs AS (SELECT doc_id, right(coalesce(source, ''), 1) AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, 3 * sum(n_tokens) AS cap FROM docs GROUP BY ALL HAVING sum(n_tokens) > 0),
root AS (SELECT floor(sum(tokens) * {MIX_FRACTION}) AS pb FROM leaves),
d AS (SELECT domain, b AS pb FROM {_level_sql('', 'domain')}),
l AS (SELECT domain, lang, b AS pb FROM {_level_sql('d', 'domain, lang')}),
s AS (SELECT domain, lang, source, CAST(floor(b + 1e-6) AS BIGINT) AS budget FROM {_level_sql('l', 'domain, lang, source')}),
plan AS (SELECT *, least(budget // tokens, 3) AS e, budget - least(budget // tokens, 3) * tokens AS rest FROM s JOIN leaves USING (domain, lang, source)),
placed AS (SELECT docs.*, e, rest, md5('10:' || e || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM docs LEFT JOIN plan USING (domain, lang, source)),
ran AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)
    - sum(n_tokens) OVER (PARTITION BY domain, lang, source, place) AS ahead FROM placed)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(epochs AS BIGINT) AS epochs, in_prefix, CAST(epochs + CAST(in_prefix AS INT) AS BIGINT) AS copies
FROM (SELECT *, CASE WHEN n_tokens > 0 THEN coalesce(e, 0) ELSE 0 END AS epochs, coalesce(n_tokens > 0 AND ahead < rest, false) AS in_prefix FROM ran)""")
def op10_mix_sources(spark, sf_dir):
    from .mixing import select_mix
    docs = table(spark, sf_dir, "documents")
    out = select_mix(docs, domain_of(F.col("source")), MIX_FRACTION, MIX_WEIGHTS, keep=False)
    return out.select("row.doc_id", "domain", "lang", "source", "n_tokens", "epochs", "in_prefix", "copies")


@register("op11_token_records")
def op11_token_records(spark, sf_dir):
    import public_tokenizers

    from .records import read_records, write_records
    index = write_records(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return read_records(index, with_ids=False).select("doc_id", "start", "n_tokens", "ids_crc32")


def _made_periodic(doc_id, words):
    """The contract's rewrite: in a tenth of the documents the words from some place on repeat."""
    h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * -(-(n - a) // p))[:n - a]


@register("op12_periodic_runs")
def op12_periodic_runs(spark, sf_dir):
    from .runs import periodic_runs
    return periodic_runs(table(spark, sf_dir, "documents"), rewrite=_made_periodic)


@register("op13_ranked_search", r"""
WITH terms AS (SELECT doc_id, row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)),
lengths AS (SELECT row, doc_id, CAST(len(ws) AS BIGINT) AS n FROM terms WHERE len(ws) > 0),
stats AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
items AS (SELECT DISTINCT item_id, text, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
postings AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(ws) AS term FROM terms)
  WHERE term IN (SELECT term FROM items) GROUP BY ALL),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(big_n) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM postings, stats GROUP BY term),
norms AS (SELECT row, doc_id, 50 + (50 * n * big_n) // big_l AS m FROM lengths, stats),
scored AS (SELECT item_id, text, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM items JOIN postings USING (term) JOIN weights USING (term) JOIN norms USING (row) GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 50""")
def op13_ranked_search(spark, sf_dir):
    from .strata import search
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
