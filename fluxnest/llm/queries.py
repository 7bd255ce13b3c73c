"""Queries p5, p7, p8, p9 and p10, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sessions import clean_ifa
from ..runtime import materialise, table
from . import canonical, frequent, kmv, mixing, tokenise

DIMS = ["day", "country", "site_id"]
FREQUENT_SHARE = 0.005
SMALL_K = 32


def _hashed(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "request_log")
    some = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    day = F.when(F.unix_micros("req_ts") != 0, F.date_format("req_ts", "yyyy-MM-dd")).alias("day")
    return log.select(day, some("country"), some("site_id"), kmv.hash60(clean_ifa(F.col("ifa"))).alias("ifa"), kmv.hash60(F.col("user_id")).alias("user_id"))


def p5_distinct(spark: SparkSession, d: str) -> DataFrame:
    """Estimated numbers of devices and users of each group, with 95 % bounds."""
    log = _hashed(spark, d)
    sketches = kmv.sketch_groups(log, DIMS, ["ifa", "user_id"], tasks=log.rdd.getNumPartitions())  # a plain scan: nothing runs
    value, low, high = kmv.estimate(F.col("hashes"))
    return sketches.select("field", "by", *DIMS, F.round(value).cast("bigint").alias("n_distinct"), F.round(low).cast("bigint").alias("low"), F.round(high).cast("bigint").alias("high"))


def _overlap(spark: SparkSession, d: str, k: int) -> DataFrame:
    """Devices seen in a country on a day and on the next: union, intersection and difference of sketches."""
    log = _hashed(spark, d).select("day", "country", "ifa")
    days = kmv.sketch_groups(log, ["day", "country"], ["ifa"], k, tasks=log.rdd.getNumPartitions()).filter("by = 'day,country'")
    days = materialise(days.select("day", "country", "hashes"), "days")
    after = days.select(F.date_format(F.date_add(F.to_date("day"), -1), "yyyy-MM-dd").alias("day"), "country", F.col("hashes").alias("later"))
    both = days.join(after, ["day", "country"])
    est = {kind: kmv.set_operation(F.col("hashes"), F.col("later"), kind, k) for kind in ("union", "intersection", "difference")}
    cols = [F.round(c).cast("bigint").alias(f"{kind}_{n}") for kind, three in est.items() for n, c in zip(("n", "low", "high"), three)]
    return both.select("day", "country", *cols)


def p5_country_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _overlap(spark, d, kmv.K)


def p5_country_overlap_small(spark: SparkSession, d: str) -> DataFrame:
    """The same with sketches of 32 hashes, which most groups exceed on any table: the estimates themselves."""
    return _overlap(spark, d, SMALL_K)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return frequent.heavy_values(table(spark, d, "request_log"), ["ua", "ip"], FREQUENT_SHARE).select("field", "item")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """The frequent values with the counts of the exact pass."""
    return frequent.heavy_values(table(spark, d, "request_log"), ["ua", "ip"], FREQUENT_SHARE).select("field", "item", "n")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenise.encode_ids(table(spark, d, "documents"), "doc_id", "text")


def _sizes(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").filter(F.col("source").isNotNull())
    return tokenise.count_tokens(docs, ["doc_id", "source"], "text")


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(_sizes(spark, d), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.report(_sizes(spark, d), table(spark, d, "mix_targets"))


def _characters(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "source", F.col("n_chars").alias("n_tokens"))


def p9_char_documents(spark: SparkSession, d: str) -> DataFrame:
    """The same selection by characters instead of tokens, which SQL can count."""
    return mixing.select_documents(_characters(spark, d), table(spark, d, "mix_targets"))


def p9_char_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.document_shares(_characters(spark, d), table(spark, d, "mix_targets"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.lookalike_pairs(table(spark, d, "documents"), "doc_id", "text")


def p10_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text in its consistent form."""
    return canonical.canonical_texts(table(spark, d, "documents"), "doc_id", "text")


def p10_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its class of texts that look the same, and how many of these are stored otherwise."""
    return canonical.lookalike_classes(table(spark, d, "documents"), "doc_id", "text")


QUERIES = {f.__name__: f for f in (p5_distinct, p5_country_overlap, p5_country_overlap_small, p7_found, p7_counts, p8_ids, p9_mix, p9_shares, p9_char_documents, p9_char_shares, p10_found, p10_texts, p10_classes)}

_FREQUENT = "SELECT field, item{n} FROM (SELECT 'ua' AS field, ua AS item, count(*) AS n FROM request_log GROUP BY ALL UNION ALL SELECT 'ip', ip, count(*) FROM request_log GROUP BY ALL) WHERE item IS NOT NULL AND item <> '' AND n >= 0.005 * (SELECT count(*) FROM request_log)"
_HASH = "CASE WHEN {x} <> '' THEN CAST('0x' || substr(md5({x}), 1, 15) AS BIGINT) END"
_LOG = f"""
WITH e AS (
  SELECT CASE WHEN epoch_us(req_ts) <> 0 THEN strftime(req_ts, '%Y-%m-%d') END AS day, nullif(country, '') AS country, nullif(site_id, '') AS site_id, user_id,
    lower(regexp_replace(ifa, '[[:punct:]]', '', 'g')) AS ifa FROM request_log
), c AS (
  SELECT day, country, site_id, user_id, CASE WHEN regexp_full_match(ifa, '[0-9a-f]{{32}}') AND ifa <> repeat('0', 32) THEN ifa END AS ifa FROM e
), h AS (
  SELECT 'ifa' AS field, day, country, site_id, {_HASH.format(x="ifa")} AS h FROM c
  UNION ALL SELECT 'user_id', day, country, site_id, {_HASH.format(x="user_id")} FROM c
)
"""
_SETS = [("day",), ("country",), ("site_id",), ("day", "country"), ("day", "site_id"), ("country", "site_id"), ("day", "country", "site_id")]
_GROUPS = " UNION ALL ".join(
    f"SELECT DISTINCT field, '{','.join(s)}' AS \"by\", {', '.join(c if c in s else f'NULL::VARCHAR AS {c}' for c in DIMS)}, h FROM h WHERE h IS NOT NULL AND {' AND '.join(f'{c} IS NOT NULL' for c in s)}" for s in _SETS
)
_CHOSEN = f"""
WITH sizes AS (
  SELECT doc_id, source, n_chars AS n, CAST('0x' || substr(md5('7/' || source || '/' || doc_id), 1, 15) AS BIGINT) AS h FROM documents WHERE n_chars > 0 AND source IN (SELECT source FROM mix_targets)
), tot AS (
  SELECT source, CAST(sum(n) AS BIGINT) AS available, greatest(1, CAST(ceil(count(*) / {mixing.BUCKET}) AS BIGINT)) AS buckets FROM sizes GROUP BY source
), t AS (
  SELECT mix_id, source, sum(target_weight) AS w, max(max_repeats) AS r, any_value(available) AS available FROM mix_targets JOIN tot USING (source) WHERE mix_id IS NOT NULL AND target_weight > 0 AND max_repeats > 0 GROUP BY ALL
), s AS (
  SELECT *, w / sum(w) OVER (PARTITION BY mix_id) AS share FROM t
), q AS (
  SELECT *, CAST(round_even(floor(min(available * r / share) OVER (PARTITION BY mix_id) + 1e-6) * share, 0) AS BIGINT) AS quota FROM s
), p AS (
  SELECT doc_id, source, n, sum(n) OVER (PARTITION BY source ORDER BY h % buckets, h, doc_id ROWS UNBOUNDED PRECEDING) - n AS start FROM sizes JOIN tot USING (source)
), c AS (
  SELECT mix_id, source, doc_id, n, least(r, greatest(0, CAST(floor((quota - start - n / 2) / available) AS BIGINT) + 1)) AS copies FROM p JOIN q USING (source)
), chosen AS (
  SELECT mix_id, source, doc_id, CAST(unnest(range(copies)) AS BIGINT) AS repeat, n AS n_tokens FROM c
)
"""
_FORMS = f"WITH f AS (SELECT doc_id, text, {canonical.form_sql('text')} AS form FROM documents), v AS (SELECT * FROM f WHERE trim(form, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(8232) || chr(8233)) <> '') "
ORACLES = {
    "p10_found": _FORMS + "SELECT a.doc_id AS doc_a, b.doc_id AS doc_b FROM v AS a JOIN v AS b USING (form) WHERE a.doc_id < b.doc_id AND a.text <> b.text",
    "p10_texts": _FORMS + "SELECT doc_id, form AS text FROM f",
    "p10_classes": _FORMS + """, k AS (SELECT form, text, count(*) AS n, min(doc_id) AS first FROM v GROUP BY ALL), w AS (SELECT form, min(first) AS class_id, CAST(sum(n) AS BIGINT) AS n_members, count(*) AS n_texts FROM k GROUP BY form)
SELECT doc_id, class_id, n_members, n_texts, n_members - n AS n_links FROM v JOIN w USING (form) JOIN k USING (form, text)""",
    "p9_char_documents": _CHOSEN + "SELECT mix_id, source, doc_id, repeat, n_tokens FROM chosen",
    "p9_char_shares": _CHOSEN
    + """, g AS (
  SELECT mix_id, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) AS n_rows, max(repeat) + 1 AS repeats_used FROM chosen GROUP BY ALL
), m AS (
  SELECT mix_id, sum(tokens) AS mix_tokens FROM g GROUP BY ALL
), w AS (
  SELECT mix_id, sum(target_weight) FILTER (WHERE target_weight > 0) AS weights FROM mix_targets GROUP BY ALL
)
SELECT mix_id, source, max_repeats, target_weight / weights AS target_share, coalesce(share, 0.0) AS aim_share, coalesce(CAST(tokens AS DOUBLE) / mix_tokens, 0.0) AS actual_share,
  coalesce(tokens, 0) AS tokens, coalesce(n_rows, 0) AS n_rows, coalesce(repeats_used, 0) AS repeats_used
FROM mix_targets JOIN w USING (mix_id) LEFT JOIN (SELECT mix_id, source, share FROM q) USING (mix_id, source) LEFT JOIN g USING (mix_id, source) LEFT JOIN m USING (mix_id)""",
    "p5_distinct": _LOG
    + f""", g AS ({_GROUPS}
), r AS (
  SELECT *, row_number() OVER (PARTITION BY field, "by", day, country, site_id ORDER BY h) AS i FROM g
), s AS (
  SELECT field, "by", day, country, site_id, count(*) AS n, max(h) FILTER (WHERE i = {kmv.K}) AS top FROM r WHERE i <= {kmv.K} GROUP BY ALL
), v AS (
  SELECT *, {kmv.K - 1} / (top / {kmv.HASH_RANGE}) AS e, 1.96 / sqrt({kmv.K - 2}) AS rel FROM s
)
SELECT field, "by", day, country, site_id, CAST(round(CASE WHEN n < {kmv.K} THEN n ELSE e END) AS BIGINT) AS n_distinct,
  CAST(round(CASE WHEN n < {kmv.K} THEN n ELSE e * (1 - rel) END) AS BIGINT) AS low, CAST(round(CASE WHEN n < {kmv.K} THEN n ELSE e * (1 + rel) END) AS BIGINT) AS high FROM v
""",
    # Exact counts: the estimates are exact while a union has fewer than k members, as at the scale SQL is run at.
    "p5_country_overlap": _LOG
    + """, g AS (
  SELECT DISTINCT day, country, h FROM h WHERE field = 'ifa' AND h IS NOT NULL AND day IS NOT NULL AND country IS NOT NULL
), later AS (
  SELECT strftime(CAST(day AS DATE) - 1, '%Y-%m-%d') AS day, country, h FROM g
), n AS (
  SELECT day, country, count(*) AS a FROM g GROUP BY ALL
), m AS (
  SELECT day, country, count(*) AS b FROM later GROUP BY ALL
), i AS (
  SELECT day, country, count(*) AS c FROM g JOIN later USING (day, country, h) GROUP BY ALL
), t AS (
  SELECT day, country, a + b - coalesce(c, 0) AS u, coalesce(c, 0) AS c, a - coalesce(c, 0) AS d FROM n JOIN m USING (day, country) LEFT JOIN i USING (day, country)
)
SELECT day, country, u AS union_n, u AS union_low, u AS union_high, c AS intersection_n, c AS intersection_low, c AS intersection_high, d AS difference_n, d AS difference_low, d AS difference_high FROM t""",
    "p5_country_overlap_small": _LOG
    + f""", g AS (
  SELECT DISTINCT day, country, h FROM h WHERE field = 'ifa' AND h IS NOT NULL AND day IS NOT NULL AND country IS NOT NULL
), a AS (
  SELECT day, country, h FROM g QUALIFY row_number() OVER (PARTITION BY day, country ORDER BY h) <= {SMALL_K}
), b AS (
  SELECT strftime(CAST(day AS DATE) - 1, '%Y-%m-%d') AS day, country, h FROM a
), pairs AS (
  SELECT day, country FROM a INTERSECT SELECT day, country FROM b
), u AS (
  SELECT day, country, h, bool_or(first) AS ina, bool_or(NOT first) AS inb FROM (SELECT *, true AS first FROM a UNION ALL SELECT *, false FROM b) JOIN pairs USING (day, country) GROUP BY ALL
), s AS (
  SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY day, country ORDER BY h) <= {SMALL_K}
), n AS (
  SELECT day, country, count(*) AS n, max(h) AS top, count(*) FILTER (WHERE ina AND inb) AS shared, count(*) FILTER (WHERE ina AND NOT inb) AS lone FROM s GROUP BY ALL
), sized AS (
  SELECT *, CASE WHEN n < {SMALL_K} THEN n ELSE {SMALL_K - 1} / (top / {kmv.HASH_RANGE}) END AS w, 1.96 / sqrt({SMALL_K - 2}) AS rel FROM n
), p AS (
  SELECT *, shared / n AS pi, lone / n AS pd FROM sized
), x AS (
  SELECT *, CASE WHEN n < {SMALL_K} THEN 0 ELSE 1.96 * sqrt((pi * (1 - pi) + 1.0 / {SMALL_K}) / n) + pi * rel END AS ei, CASE WHEN n < {SMALL_K} THEN 0 ELSE 1.96 * sqrt((pd * (1 - pd) + 1.0 / {SMALL_K}) / n) + pd * rel END AS ed FROM p
)
SELECT day, country, CAST(round(w) AS BIGINT) AS union_n, CAST(round(CASE WHEN n < {SMALL_K} THEN w ELSE w * (1 - rel) END) AS BIGINT) AS union_low, CAST(round(CASE WHEN n < {SMALL_K} THEN w ELSE w * (1 + rel) END) AS BIGINT) AS union_high,
  CAST(round(w * pi) AS BIGINT) AS intersection_n, CAST(round(greatest(w * (pi - ei), 0)) AS BIGINT) AS intersection_low, CAST(round(w * least(pi + ei, 1 + rel)) AS BIGINT) AS intersection_high,
  CAST(round(w * pd) AS BIGINT) AS difference_n, CAST(round(greatest(w * (pd - ed), 0)) AS BIGINT) AS difference_low, CAST(round(w * least(pd + ed, 1 + rel)) AS BIGINT) AS difference_high FROM x""",
    "p7_found": _FREQUENT.format(n=""),
    "p7_counts": _FREQUENT.format(n=", n"),
}
