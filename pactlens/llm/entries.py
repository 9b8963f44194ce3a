"""The queries of this subpackage over the tables of a folder, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, byte_bpe, decontaminate, divergence, html_extract, jaccard_join, langid, license_scan, packing, period_runs, substring_dedup, token_store, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "coverage", "verbatim")


def byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return byte_bpe.round_trip_digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def substring_deduplication(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(~held_out()))
    return langid.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), model).drop("text")


def license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def vantage_point_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), k=20, factor=1.0)


def token_id_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    manifest, folder = token_store.write_shards(table(spark, sf_dir, "documents"), path, end_id=1)
    return token_store.read_shards(manifest, folder)


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), n=3, num=90, den=100).drop("k")


def best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=0)


def source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = period_runs.period_runs(docs, seed=F.crc32(F.col("doc_id").cast("string")), change=period_runs.planted_tail)
    return period_runs.run_digests(found)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": html_extraction,
        "op2_decontamination": decontamination,
        "op3_byte_level_bpe": byte_level_bpe,
        "op4_substring_dedup": substring_deduplication,
        "op5_language_id": language_id,
        "op6_license_scans": license_scans,
        "op7_warc": warc_round_trip,
        "op8_vantage_point_neighbours": vantage_point_neighbours,
        "op9_token_id_shards": token_id_shards,
        "op10_ngram_jaccard_join": ngram_jaccard_join,
        "op11_best_fit_packing": best_fit_packing,
        "op12_source_divergence": source_divergence,
        "op13_period_runs": periodic_runs,
    }


WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS ws FROM documents),
w AS (SELECT doc_id, s, array_to_string(ws[s:s + 34], ' ') AS key
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS s FROM d WHERE len(ws) >= 35)),
again AS (SELECT key FROM w GROUP BY key HAVING count(*) > 1),
cut AS (SELECT DISTINCT doc_id, unnest(range(s, s + 35)) AS pos FROM w JOIN again USING (key)),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS kept, count(*) AS n
         FROM words ANTI JOIN cut USING (doc_id, pos) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

JACCARD = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, {WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(ws[s:s + 2], ' ') AS gram
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 1, 2))) AS s FROM d WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g AS a JOIN g AS b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_ JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) AS r ON r.a = d.doc_id"""

_DIGITS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'"
_BASE32 = " || ".join(f"{_DIGITS}[((('0x' || substr(h, {5 * k + 1}, 5))::INT >> {s}) & 31) + 1]" for k in range(8) for s in (15, 10, 5, 0))

REVISITS = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT h, max(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(body) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN m USING (h)"""

NEAREST = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score
      FROM e AS q JOIN e AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 20"""

DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
w AS (SELECT row_id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT row_id) >= 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
dense AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY g.lang, g.source) AS total FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
l AS (SELECT lang, term, sum(n) AS n, sum(sum(n)) OVER (PARTITION BY lang) AS total FROM dense GROUP BY lang, term),
p AS (SELECT lang, source, term, n, (1 + 1000000000::HUGEINT * (n + 1) // (total + v))::BIGINT AS p FROM dense JOIN v USING (lang)),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 1) // (total + v))::BIGINT AS q FROM l JOIN v USING (lang)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums ON sums.lang = a.lang AND sums.source = a.source AND sums.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT * FROM r WHERE part = 'pair' OR rank <= 200"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_substring_dedup": SUBSTRINGS,
        "op6_license_scans": license_scan.oracle(),
        "op7_warc": REVISITS,
        "op8_vantage_point_neighbours": NEAREST,
        "op10_ngram_jaccard_join": JACCARD,
        "op12_source_divergence": DIVERGENCE,
    }
