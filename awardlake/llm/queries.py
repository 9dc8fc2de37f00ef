"""Registered queries of this subpackage: each applies one operator to a whole table."""

QUERIES, ORACLES = {}, {}


def query(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op6_byte_bpe")
def byte_bpe(spark, sf_dir):
    import public_tokenizers

    from awardlake.llm import bpe

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.digests(documents(spark, sf_dir), ranks, public_tokenizers.PATTERN)


NEAR_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 4 THEN list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS g FROM s),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM s UNION SELECT r.x, b.b FROM reach r JOIN ways b ON b.a = r.y),
firsts AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x)
SELECT s.doc_id, len(s.sh) AS n_shingles, firsts.component_id, s.doc_id = firsts.component_id AS kept
FROM s JOIN firsts ON s.doc_id = firsts.x
"""


@query("op9_minhash", NEAR_SQL)
def minhash(spark, sf_dir):
    from awardlake.llm.minhash import near_duplicates

    return near_duplicates(documents(spark, sf_dir), words=4, percent=80)


REPEATS_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, p, sha256(h[2 * p + 1:2 * p + 200]) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 99)) AS p FROM d)),
again AS (SELECT doc_id, p FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, p) AS k FROM w) WHERE k > 1),
edges AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY p ROWS UNBOUNDED PRECEDING) AS run FROM edges),
spans AS (SELECT doc_id, min(p) AS s, max(p) + 100 AS e FROM runs GROUP BY doc_id, run),
gaps AS (SELECT doc_id, s, e, lead(s) OVER (PARTITION BY doc_id ORDER BY s) AS next FROM spans),
tails AS (
  SELECT g.doc_id, min(s) AS s, CAST(sum(e - s) AS BIGINT) AS n_removed, count(*) AS n_spans,
    string_agg(d.h[2 * e + 1:2 * coalesce(next, n)], '' ORDER BY s) AS tail
  FROM gaps g JOIN d USING (doc_id) GROUP BY g.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN s IS NULL THEN h ELSE h[1:2 * s] || tail END)) AS kept_sha256
FROM d LEFT JOIN tails USING (doc_id)
"""


@query("op10_suffix_dedup", REPEATS_SQL)
def suffix_dedup(spark, sf_dir):
    from awardlake.llm import suffixes

    return suffixes.digests(documents(spark, sf_dir), length=100)


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    len(regexp_extract_all(coalesce(text, ''), '[!#$%&*|]+')) AS runs,
    (CAST('0x' || substr(md5('5:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / (1 - least(0.9::DOUBLE, runs::DOUBLE / greatest(size, 1))) AS key FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM k GROUP BY source),
r AS (SELECT *, ([3, 1, 2])[1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS weight FROM s),
o AS (SELECT *, 2 * source_size::DOUBLE / weight AS ratio FROM r),
l AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT) - 2 * CAST(sum(source_size) OVER up - source_size AS BIGINT))
    / CAST(sum(weight) OVER () - sum(weight) OVER up + weight AS BIGINT) AS level
  FROM o WINDOW up AS (ORDER BY ratio, source ASC NULLS LAST ROWS UNBOUNDED PRECEDING)),
t AS (
  SELECT source, source_size, coalesce(least((max(level) FILTER (WHERE level <= ratio) OVER ()) * weight, 2 * source_size::DOUBLE), 2 * source_size::DOUBLE) AS target
  FROM l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
f AS (
  SELECT k.doc_id, k.size, e.source_size, e.target, e.epochs, CAST(round(e.target - e.epochs * e.source_size) AS BIGINT) AS rest,
    CAST(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - k.size AS ahead
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - ahead)) AS BIGINT) AS taken FROM f
"""


@query("op5_mixing", MIX_SQL)
def mixing(spark, sf_dir):
    from awardlake.llm.mixing import allotment

    return allotment(documents(spark, sf_dir))


@query("op4_imatch")
def imatch(spark, sf_dir):
    from awardlake.llm.imatch import fingerprints

    return fingerprints(documents(spark, sf_dir))


@query("op7_license_scan")
def license_scan(spark, sf_dir):
    from awardlake.llm.licenses import scan

    return scan(documents(spark, sf_dir))


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


@query("op3_toxicity")
def toxicity(spark, sf_dir):
    from awardlake.llm.toxicity import severity

    return severity(documents(spark, sf_dir), labels(spark, sf_dir))


@query("op1_quality")
def quality(spark, sf_dir):
    from awardlake.llm.quality import score

    return score(documents(spark, sf_dir), labels(spark, sf_dir))


@query("op2_language")
def language(spark, sf_dir):
    from awardlake.llm.language import identify

    return identify(documents(spark, sf_dir))


@query("op8_cross_polytope")
def cross_polytope(spark, sf_dir):
    from awardlake.llm.ann import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "id % 20 = 0")


@query("op12_whitening")
def whitened(spark, sf_dir):
    from awardlake.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query("op13_conversation_repair")
def conversation_repair(spark, sf_dir):
    from awardlake.llm.conversations import audits, damaged

    return audits(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


@query("op11_quality_rules")
def quality_rules(spark, sf_dir):
    from awardlake.llm.rules import judge

    return judge(documents(spark, sf_dir), labels(spark, sf_dir))
