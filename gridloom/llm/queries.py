"""The registered queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, decontaminate, exact_dedup, language_id, near_dedup, sharding, substring_dedup, token_counts, toxicity, warc

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content sort over all documents."""
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


ORACLES["op5_exact_dedup"] = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""


@query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniform shuffle of all documents into 16 shards whose counts are at most one apart."""
    placed = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 10 benchmark words, found by FM-indexes over all documents."""
    found = decontaminate.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.digest(found)


ORACLES["op4_decontaminate"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item, CASE WHEN len(w) < 10 THEN len(w) ELSE 10 END AS n, array_to_string(w[k : k + 9], ' ') AS win
        FROM b, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 9, 1))) AS k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
starts AS (SELECT doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM d, sizes, LATERAL (SELECT unnest(generate_series(1, len(w) - n + 1)) AS k) WHERE len(w) >= n),
occ AS (SELECT doc_id, k, starts.n, item FROM starts JOIN win USING (win, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(k, k + n - 1)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM occ GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all pages as WARC records in Zstandard frames, then read the archives back."""
    path = common.scratch(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).drop("url")


ORACLES["op7_warc"] = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN strlen(h) >= 1000 AND page_id <> max(page_id) OVER w THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN strlen(h) >= 1000 AND page_id <> max(page_id) OVER w THEN max(page_id) OVER w END AS refers_to
FROM p WINDOW w AS (PARTITION BY h)
"""


@query
def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 13 words that a smaller document has too, over all documents."""
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents"))


ORACLES["op3_substring_dedup"] = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, k, array_to_string(w[k : k + 12], ' ') AS win FROM d, LATERAL (SELECT unnest(generate_series(1, len(w) - 12)) AS k) WHERE len(w) >= 13),
f AS (SELECT win, min(doc_id) AS least FROM s GROUP BY win),
gone AS (SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(generate_series(k, k + 12)) AS p FROM s JOIN f USING (win) WHERE least < doc_id)),
g AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE [w[i] FOR i IN generate_series(1, len(w)) IF NOT list_contains(ps, i)] END, ' ')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose sets of two-word shingles have a similarity of 0.8 or more, over all documents."""
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle=2, percent=80)


ORACLES["op8_near_dedup"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, CASE WHEN len(w) = 1 THEN w[1] ELSE w[k] || ' ' || w[k + 1] END AS sh
      FROM d, LATERAL (SELECT unnest(generate_series(1, greatest(len(w) - 1, 1))) AS k) WHERE len(w) > 0),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT a, b FROM i JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(doc_id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id AND r.c < e.b),
m AS (SELECT doc_id, min(c) AS component_id FROM r GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM m LEFT JOIN n USING (doc_id)
"""


@query
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode all documents with the public word-level vocabulary."""
    return bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), digests=True)


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of all documents with the public pieces."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain's probabilities and decision for all documents."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.chain_of_labels())
    return toxicity.score(docs, model)


@query
def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of all documents."""
    return language_id.identify(table(spark, sf_dir, "documents")).drop("languages")
