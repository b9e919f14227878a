"""The thin queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import byte_bpe_roundtrip
from .embedding_dedup import near_duplicate_vectors
from .html_extraction import extract_main_text
from .language_id import language_id
from .minhash_dedup import near_duplicate_documents
from .packing import pack_documents
from .periodic_runs import periodic_runs
from .prefix_trie import number_turns, prefix_trie
from .substring_dedup import remove_repeats
from .token_counts import token_counts
from .toxicity import toxicity
from .url_filters import judge_urls
from .vector_search import top_k_inner_product


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(_table(spark, sf_dir, "pages"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(_table(spark, sf_dir, "embeddings"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe_roundtrip(_table(spark, sf_dir, "documents"))


def op8_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_documents(_table(spark, sf_dir, "documents"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(_table(spark, sf_dir, "documents"))


def op10_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_inner_product(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def rebuilt_conversations(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of c - c % 20 in place of its own first h; h = crc32(c) % 4.

    Also the ids, for conversations that are left without turns. A start is joined with 20 conversations at most in
    either direction from 0, and has three turns at most.
    """
    convs = rows.groupBy("conv_id").agg(F.count(F.when(F.col("place") < 3, 1)).alias("n"))
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 4).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("base_n", F.lit(0))))
    starts = rows.filter("place < 3").select(F.col("conv_id").alias("base"), "place", "content", "twin", "words")
    starts = convs.select("conv_id", "base", "h").join(starts, "base").filter("place < h").select("conv_id", "place", "content", "twin", "words")
    own = rows.join(convs.select("conv_id", "h", "m"), "conv_id").filter("place >= h").withColumn("place", F.col("place") - F.col("h") + F.col("m"))
    return own.select(starts.columns).unionByName(starts), convs.select("conv_id")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = number_turns(_table(spark, sf_dir, "conversations"))
    return prefix_trie(*rebuilt_conversations(rows))


def with_periods(docs: DataFrame) -> DataFrame:
    """Documents of which one in ten, by crc32 of the id, is made to repeat from some word on; the others as they are.

    With h = crc32(doc_id), g = floor(h / 10) and n words, if h % 10 = 0: from word a = g % n on, word i becomes word
    a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)).
    """
    planted = r"""transform(array(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+', 0)), w ->
      transform(array(named_struct('a', (h div 10) % size(w), 'p', 1 + (size(w) - (h div 10) % size(w)) div (3 + (h div 10) % 8))), s ->
        array_join(transform(sequence(0, size(w) - 1), i -> w[if(i < s.a, i, int(s.a + (i - s.a) % s.p))]), ' '))[0])[0]"""
    hashed = docs.withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    return hashed.select("doc_id", F.expr(rf"case when h % 10 = 0 and regexp_like(text, '[^\\x20\\x09-\\x0D]') then {planted} else text end").alias("text"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs(with_periods(_table(spark, sf_dir, "documents")))


#: The rules of the query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op13_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(_table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (
            op1_toxicity,
            op2_substring_dedup,
            op3_token_counts,
            op4_packing,
            op5_html_extraction,
            op6_embedding_dedup,
            op7_byte_bpe,
            op8_minhash_dedup,
            op9_language_id,
            op10_vector_search,
            op11_prefix_trie,
            op12_periodic_runs,
            op13_url_filters,
        )
    }


#: Words of every document with their places, and the documents that start each window first.
_OP2 = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, i, list_aggregate(w[i:i + 12], 'string_agg', ' ') AS run
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT run, min(doc_id) AS first FROM starts GROUP BY run
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS k FROM starts JOIN firsts USING (run) WHERE first < doc_id
), gone AS (
  SELECT doc_id, list(k) AS ks FROM covered GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, len(coalesce(ks, []))::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda k: NOT list_contains(coalesce(ks, []), k)), lambda k: w[k]), ' '), '')) AS kept_sha256
FROM words LEFT JOIN gone USING (doc_id)
"""

_OP6 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
), usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT a AS node, a AS found FROM links UNION SELECT node, b FROM reach JOIN links ON found = a
), part AS (
  SELECT node, min(found) AS component_id FROM reach GROUP BY node
), degree AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, coalesce(component_id, vec_id) AS component_id, vec_id = coalesce(component_id, vec_id) AS kept
FROM v LEFT JOIN part ON node = vec_id LEFT JOIN degree ON a = vec_id
"""

_OP8 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i:i + 4], 'string_agg', ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 3))) AS i FROM words WHERE len(w) > 0)
), sizes AS (
  SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach AS (
  SELECT a AS node, a AS found FROM links UNION SELECT node, b FROM reach JOIN links ON found = a
), part AS (
  SELECT node, min(found) AS component_id FROM reach GROUP BY node
)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM words LEFT JOIN sizes USING (doc_id) LEFT JOIN part ON node = doc_id
"""

_OP10 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank, vec_id, score
FROM scored QUALIFY rank <= 20
"""


#: The trie by whole prefixes: a prefix's key is the list of the digests of its turns.
_OP11 = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
    sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS what, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(0, 8)), lambda r, k: CASE WHEN r % 2 = 0 THEN r >> 1 ELSE xor(r >> 1, 3988292384) END)), 4294967295) % 4 AS h FROM (SELECT DISTINCT conv_id FROM turns)
), starts AS (
  SELECT c.conv_id, place, what, words FROM convs c JOIN turns t ON t.conv_id = c.base WHERE place < h
), rebuilt AS (
  SELECT * FROM starts UNION ALL SELECT t.conv_id, place - h + (SELECT count(*) FROM starts s WHERE s.conv_id = t.conv_id), what, words FROM turns t JOIN convs USING (conv_id) WHERE place >= h
), every AS (
  SELECT conv_id, place + 1 AS depth, words, list(what) OVER (PARTITION BY conv_id ORDER BY place) AS key FROM rebuilt UNION ALL SELECT conv_id, 0, 0, [] FROM convs
), lasts AS (
  SELECT conv_id, max(depth) AS depth FROM every GROUP BY conv_id
), nodes AS (
  SELECT key, e.depth, min(e.conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(CASE WHEN l.depth = e.depth THEN e.conv_id::VARCHAR END, ',' ORDER BY e.conv_id), '')) AS ends_sha256
  FROM every e JOIN lasts l ON l.conv_id = e.conv_id GROUP BY key, e.depth
), kids AS (
  SELECT p.key, count(*) AS n FROM nodes p JOIN nodes c ON c.depth = p.depth + 1 AND c.key[:p.depth] = p.key GROUP BY p.key
), sums AS (
  SELECT u.key, sum((v.n_convs - 1) * v.words) AS saved, count(*) FILTER (v.key NOT IN (SELECT key FROM kids)) AS leaves FROM nodes u JOIN nodes v ON v.key[:u.depth] = u.key GROUP BY u.key
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n, 0) AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[:n.depth - 1] LEFT JOIN kids ON kids.key = n.key JOIN sums ON sums.key = n.key
"""

_OP13 = r"""
WITH rules(rule_host, rule_path, verdict) AS (
  VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), parts AS (
  SELECT row_number() OVER () AS row, page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT row, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts
)
SELECT page_id, host, path, rule_host || rule_path AS rule, coalesce(verdict, 'allow') AS verdict
FROM parsed LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(rule_host || rule_path) DESC) = 1
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL; the other operators need tokenizers, a parser or training and are tested by brute force instead."""
    return {"op2_substring_dedup": _OP2, "op6_embedding_dedup": _OP6, "op8_minhash_dedup": _OP8, "op10_vector_search": _OP10, "op11_prefix_trie": _OP11, "op13_url_filters": _OP13}
