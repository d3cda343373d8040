"""One query per operator over the whole tables, with SQL where SQL can state the result."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plurality.llm import divergence, gridjoin, lines, mixing, packing, periods, prunedgraph, quality, sharding, simhash, topk, toxicity, urls

SHARDS = 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_epsilon_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gridjoin.near_duplicates(table(spark, sf_dir, "embeddings"))


OP2_SQL = """
WITH RECURSIVE clean AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 AND len([x FOR x IN embedding IF x <> 0]) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM clean a JOIN clean b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95
), reach(vec_id, root) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT l.b, r.root FROM reach r JOIN links l ON l.a = r.vec_id
), roots AS (SELECT vec_id, min(root) AS component_id FROM reach GROUP BY vec_id),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT r.vec_id, coalesce(n, 0) AS n_links, component_id, r.vec_id = component_id AS kept
FROM roots r LEFT JOIN counts ON a = r.vec_id
"""


def op3_pivotal_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    mixed = mixing.copies(docs.select("doc_id", "source", mixing.word_count().alias("size")))
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken, "copies")


def op4_impact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.search(rows, rows.filter("vec_id % 50 = 0"))


OP4_SQL = """
WITH clean AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM clean q JOIN clean c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op5_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_hypergeometric_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shuffle_shards(table(spark, sf_dir, "documents"), SHARDS)
    return sharding.sized(placed, "shard", "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op7_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op8_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.digests(docs, lines.keep_bitmaps(docs))


OP9_SQL = r"""
WITH split_lines AS (
  SELECT doc_id, text, generate_subscripts(parts, 1) AS n, unnest(parts) AS line
  FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, concat(chr(32), chr(9), chr(10), chr(11), chr(12), chr(13))),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split_lines
), repeated AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.last_doc AS gone FROM keyed k LEFT JOIN repeated r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op11_divergence_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), w AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
held AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
counts AS (
  SELECT g.lang, g.source, k.term, coalesce(h.n, 0)::HUGEINT AS n, k.n::HUGEINT AS lang_n
  FROM (SELECT DISTINCT lang, source FROM d) g JOIN kept k USING (lang) LEFT JOIN held h USING (lang, source, term)
), shares AS (
  SELECT lang, source, term, n,
         1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS p,
         1 + (1000000000 * (lang_n + 1)) // (sum(lang_n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS q
  FROM counts
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(sum((a.p - b.p) * (a.p - b.p) // b.p), 0)::BIGINT AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), lone AS (
  SELECT DISTINCT a.lang, a.source, b.source AS item FROM d a JOIN d b ON a.lang = b.lang AND a.source <> b.source
), parts AS (
  SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM lone LEFT JOIN pairs USING (lang, source, item)
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q) // q)::BIGINT FROM shares WHERE n > 0 AND p > q
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""


def op12_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return prunedgraph.search(rows, rows.filter("vec_id % 50 = 0"))


def rehearsed(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's planted repetition: in a tenth of the documents, chosen by doc_id, the words from a place on repeat; without a doc_id none."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.detect(table(spark, sf_dir, "documents"), rehearsed))


QUERIES = {
    "op1_simhash_multi_index": op1_simhash_multi_index,
    "op2_epsilon_grid": op2_epsilon_grid,
    "op3_pivotal_mix": op3_pivotal_mix,
    "op4_impact_top_k": op4_impact_top_k,
    "op5_subword_toxicity": op5_subword_toxicity,
    "op6_hypergeometric_shards": op6_hypergeometric_shards,
    "op7_pattern_packing": op7_pattern_packing,
    "op8_pu_quality": op8_pu_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_url_filter": op10_url_filter,
    "op11_divergence_tree": op11_divergence_tree,
    "op12_pruned_graph": op12_pruned_graph,
    "op13_periodic_runs": op13_periodic_runs,
}
SQL = {"op2_epsilon_grid": OP2_SQL, "op4_impact_top_k": OP4_SQL, "op9_line_dedup": OP9_SQL, "op11_divergence_tree": OP11_SQL}
