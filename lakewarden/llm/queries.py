"""The pipeline operators' queries with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table
from .decontamination import contamination_report
from .html_mincut import extract_pages
from .jaccard_join import jaccard_components
from .lattice import near_duplicate_vectors
from .mixing import mix_sources
from .quality import resample_report
from .sharding import shard_documents
from .url_cascade import UrlRule, judge_urls
from .warc import archive_and_read, resolve_revisits
from .wavelet import tokenize_to_shards

URL_RULES = [
    UrlRule("allow", "com", "/"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
]


def op1_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op2_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = resolve_revisits(archive_and_read(read_table(spark, sf_dir, "pages")))
    page = lambda c: F.split(c, ":")[2].try_cast("long")
    rows = facts.select(page(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page(F.col("refers_to")).alias("refers_to"), "status", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("_copy"))
    return rows.drop("_copy")


def op4_lattice_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(read_table(spark, sf_dir, "embeddings"))


def op5_html_mincut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(read_table(spark, sf_dir, "pages"))


def op6_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"), URL_RULES)


def op7_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    read = tokenize_to_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2, memo_words=750_000)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op9_grouped_prefix_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(read_table(spark, sf_dir, "documents")).drop("text_hash")


def op10_shard_interleaved(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_documents(read_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), iw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[p:p + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS p FROM i WHERE len(w) > 0)
), dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)
), hit AS (
  SELECT dw.doc_id, dw.p, dw.n, iw.item_id FROM dw JOIN iw USING (n, g)
), words AS (
  SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM (SELECT DISTINCT doc_id, p, n, unnest(range(p, p + n)) AS k FROM hit) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body FROM pages
), h AS (
  SELECT page_id, strlen(body)::BIGINT AS payload_bytes, sha1(body) AS hex, min(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p
), b AS (
  SELECT *, array_to_string(list_transform(range(8), lambda i: array_to_string(list_transform([15, 10, 5, 0], lambda s:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * i + 1, 5))::INT >> s) & 31)::BIGINT + 1, 1)), '')), '') AS payload_digest FROM h
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to, 'ok' AS status
FROM b
"""

OP4_SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), u AS (
  SELECT * FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_inner_product(e, e) > 0
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(vec_id, other) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT reach.vec_id, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT v.vec_id, coalesce(n, 0) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v LEFT JOIN (SELECT a AS vec_id, count(*)::BIGINT AS n FROM link GROUP BY a) USING (vec_id) JOIN (SELECT vec_id, min(other) AS component_id FROM reach GROUP BY vec_id) c USING (vec_id)
"""

OP6_SQL = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT u.*, r.verdict, rhost || rpath AS rule, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM u LEFT JOIN rules r ON ('.' || u.host) LIKE ('%.' || rhost) AND starts_with(u.path, rpath)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""

OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source
), o AS (
  SELECT *, 3.0 * n / w AS most,
         (sum(n) OVER () - coalesce(sum(3 * n) OVER (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / sum(w) OVER (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM s
), l AS (SELECT coalesce(arg_min(unit, most) FILTER (WHERE unit <= most), max(most)) AS unit FROM o
), t AS (
  SELECT source, n, least(3.0 * n, l.unit * w)::DOUBLE AS target FROM o, l
), b AS (
  SELECT *, CASE WHEN n > 0 THEN least(3, floor(target / n))::BIGINT ELSE 0 END AS base FROM t
), r AS (
  SELECT d.*, b.n AS source_size, b.target, b.base, CASE WHEN b.base < 3 THEN b.target - b.base * b.n ELSE 0 END AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS upto,
         sum(size) OVER (PARTITION BY d.source, h)::DOUBLE AS same
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
       (size * (base + CASE WHEN rest > 0 AND (upto < rest OR (upto - same < rest AND rest - (upto - same) >= upto - rest)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""

OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN len(w)::VARCHAR || ' ' || array_to_string(w, ' ') ELSE array_to_string(w[p:p + 4], ' ') END AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY doc_id
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM d UNION SELECT reach.doc_id, link.b FROM reach JOIN link ON link.a = reach.other
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) c USING (doc_id)
"""

OP10_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS n))
), b AS (
  SELECT doc_id, source, len(x) // 2 AS n, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT) AS bytes FROM (SELECT doc_id, source, hex(encode(coalesce(text, ''))) AS x FROM documents)
), d AS (
  SELECT doc_id, coalesce('s' || source::VARCHAR, '~') AS stratum, (n + 1)::BIGINT AS size, ('0x' || substr(md5('10:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295::BIGINT) AS text_crc32
  FROM b, tab
), r AS (
  SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY h, doc_id, text_crc32, size) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY stratum)) AS fraction FROM d
), p AS (
  SELECT *, row_number() OVER (ORDER BY fraction, stratum, h, doc_id, text_crc32, size) - 1 AS place, count(*) OVER () AS n FROM r
), s AS (SELECT *, place * 16 // n AS k FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, k::INTEGER AS shard, (place - (k * n + 15) // 16)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM s
"""

QUERIES = {
    "op1_winnowing_decontamination": op1_winnowing_decontamination,
    "op2_importance_resampling": op2_importance_resampling,
    "op3_warc_segments": op3_warc_segments,
    "op4_lattice_near_dup": op4_lattice_near_dup,
    "op5_html_mincut": op5_html_mincut,
    "op6_url_cascade": op6_url_cascade,
    "op7_wavelet_tokens": op7_wavelet_tokens,
    "op8_mix_sources": op8_mix_sources,
    "op9_grouped_prefix_join": op9_grouped_prefix_join,
    "op10_shard_interleaved": op10_shard_interleaved,
}

ORACLES = {"op1_winnowing_decontamination": OP1_SQL, "op3_warc_segments": OP3_SQL, "op4_lattice_near_dup": OP4_SQL, "op6_url_cascade": OP6_SQL, "op8_mix_sources": OP8_SQL, "op9_grouped_prefix_join": OP9_SQL, "op10_shard_interleaved": OP10_SQL}
