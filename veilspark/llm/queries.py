"""The opN_ queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import decontamination, fill_in_middle, filter_audit, html_extraction, license_scan, maxent_lm, minhash, pii, quality_rules, secret_scan, sentencepieces, sharding, suffix_dedup
from veilspark.llm.common import table


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and each benchmark item that it leaks."""
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extraction.extract(table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


def op5_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("position").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version",
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op8_sentencepieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.report(table(spark, sf_dir, "documents"))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.deduplicated(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.report(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each source, order of the five filters, and step."""
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.report(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_quality_rules, op3_html_extraction, op4_pii, op5_maxent_lm, op6_sharding, op7_license_scan, op8_sentencepieces, op9_minhash, op10_suffix_dedup, op11_fill_in_middle,
        op12_filter_audit, op13_secret_scan,
    )
}
#: Exact near-duplicates: all pairs that share a shingle, and their components.
NEAR_DUPLICATES = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
u AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w WHERE len(ws) >= 5),
v AS (SELECT doc_id, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g, lead(x, 4) OVER o AS last FROM u WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
g AS (SELECT DISTINCT doc_id, hash(g) AS g FROM v WHERE last IS NOT NULL UNION ALL SELECT doc_id, hash(array_to_string(ws, ' ')) FROM w WHERE len(ws) BETWEEN 1 AND 4),
n AS (SELECT doc_id, count(g) AS n, bit_xor(g) AS h, sum(g % 1000003) AS h2 FROM documents LEFT JOIN g USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, h, h2, CASE WHEN n = 0 THEN doc_id END) AS rep FROM n),
f AS (SELECT doc_id, g FROM g SEMI JOIN (SELECT rep AS doc_id FROM c) r USING (doc_id)),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM f a JOIN f b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
r AS (SELECT doc_id AS node, doc_id AS root FROM n UNION SELECT t.b, r.root FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) t ON t.a = r.node),
m AS (SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT c.doc_id, c.n::BIGINT AS n_shingles, m.root AS component_id, c.doc_id = m.root AS kept FROM c JOIN m ON m.node = c.rep"""
#: Strings of 100 bytes by hashes of hashes of their halves, byte by byte.
REPEATS = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
x AS (SELECT doc_id, regexp_extract_all(hex(t), '..') AS bs FROM d),
b AS (SELECT doc_id, unnest(bs) AS b, generate_subscripts(bs, 1) AS i FROM x),
h1 AS (SELECT doc_id, i, b, hash(b, lead(b, 1) OVER o) AS h FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h2 AS (SELECT doc_id, i, b, hash(h, lead(h, 2) OVER o) AS h FROM h1 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h3 AS (SELECT doc_id, i, b, h AS h4, hash(h, lead(h, 4) OVER o) AS h FROM h2 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h4 AS (SELECT doc_id, i, b, h4, hash(h, lead(h, 8) OVER o) AS h FROM h3 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h5 AS (SELECT doc_id, i, b, h4, hash(h, lead(h, 16) OVER o) AS h FROM h4 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
h6 AS (SELECT doc_id, i, b, h4, h AS h32, hash(h, lead(h, 32) OVER o) AS h FROM h5 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, i, b, CASE WHEN lead(b, 99) OVER o IS NOT NULL THEN hash(h, lead(h32, 64) OVER o, lead(h4, 96) OVER o) END AS h FROM h6 WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, b, h IS NOT NULL AND row_number() OVER (PARTITION BY h ORDER BY doc_id, i) > 1 AS again FROM s),
c AS (SELECT doc_id, i, b, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM r),
e AS (SELECT doc_id, i, b, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
k AS (SELECT doc_id, count(*) AS n, count_if(gone) AS removed, count_if(opens) AS spans, sha256(unhex(coalesce(string_agg(b, '' ORDER BY i) FILTER (WHERE NOT gone), ''))) AS digest FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, coalesce(digest, sha256('')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)"""
#: Units as lists, cut by list slices.
FILL_IN_MIDDLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || doc_id::VARCHAR) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '[A-Za-z]+|[^A-Za-z]') AS us, ('0x' || h[1:8])::UBIGINT AS h1, ('0x' || h[9:16])::UBIGINT AS h2, ('0x' || h[17:24])::UBIGINT AS h3, ('0x' || h[25:32])::UBIGINT AS h4 FROM d),
c AS (SELECT *, len(us) AS n, least(h1 % (len(us) + 1), h2 % (len(us) + 1))::BIGINT AS lo, greatest(h1 % (len(us) + 1), h2 % (len(us) + 1))::BIGINT AS hi,
             CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, coalesce(array_to_string(us[1:lo], ''), '') AS p, coalesce(array_to_string(us[lo + 1:hi], ''), '') AS m, coalesce(array_to_string(us[hi + 1:n], ''), '') AS s FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM p"""
#: Each order walked step by step over the documents' failures.
FILTER_AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, (CASE WHEN len(ws) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 2 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END)::INT AS mask FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, count_if(good) AS good, count_if(toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY ALL),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS b),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.b, q.b, r.b, s.b, t.b] AS bs FROM x p, x q, x r, x s, x t WHERE len(list_distinct([p.b, q.b, r.b, s.b, t.b])) = 5),
k AS (SELECT filter_order, step, bs[step] AS own, coalesce(list_sum(bs[1:step - 1]), 0)::INT AS earlier FROM o, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
r AS (SELECT part, filter_order, step::INT AS step, own, coalesce(sum(n) FILTER (mask & (earlier + own) = 0), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (mask & earlier <> 0 AND mask & own <> 0), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (mask & earlier = 0 AND mask & own <> 0), 0)::BIGINT AS toxic_lost FROM c, k GROUP BY part, filter_order, step, own)
SELECT * EXCLUDE (own), sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM r"""
ORACLES: dict[str, str] = {"op11_fill_in_middle": FILL_IN_MIDDLE, "op12_filter_audit": FILTER_AUDIT, "op9_minhash": NEAR_DUPLICATES, "op10_suffix_dedup": REPEATS}
