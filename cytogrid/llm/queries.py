"""The registered queries of this package, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cytogrid.llm import (
    language_model, lexical, near_duplicates, packing, passages, quality_rules, sentence_pieces, sharding, spelling,
    token_counts, toxicity, urls, vectors,
)
from cytogrid.llm.common import read


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(read(spark, sf_dir, "pages"))


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_documents(read(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(read(spark, sf_dir, "documents"), with_ids=False)


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), with_ids=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_vectors(read(spark, sf_dir, "embeddings"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "component_id", "kept")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(read(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.rank_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: call for name, call in globals().items() if name.startswith("op")}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_url_filter": OP2_SQL,
        "op11_sharding": OP11_SQL,
        "op12_spelling_variants": OP12_SQL,
        "op13_lexical_search": OP13_SQL,
    }


OP2_SQL = r"""
WITH rest AS (
  SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0
                                THEN substr(url, strpos(url, '://') + 3) END, '') AS rest
  FROM pages
), parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
), rules(rule_host, rule_path, action) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'),
         ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fitting AS (
  SELECT p.page_id, p.host, p.path, r.rule_host || r.rule_path AS rule, r.action,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.rule_host || r.rule_path) DESC NULLS LAST,
                            r.rule_host || r.rule_path) AS place
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.rule_host OR ends_with(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fitting WHERE place = 1
"""

# The table of crc32 and its sum over the bytes of a text, given as the column ``body``.
CRC_TABLE = """
crc_table AS (
  SELECT list(value ORDER BY i) AS steps FROM (
    SELECT i, list_reduce(list_concat([i], range(8)),
                          lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS value
    FROM range(256) r(i)))"""
CRC = """xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(regexp_extract_all(hex(encode(body)), '..'),
                                                                 lambda x: ('0x' || x)::BIGINT)),
                     lambda a, x: xor(a >> 8, steps[(xor(a, x) & 255) + 1])), 4294967295)"""

OP11_SQL = f"""
WITH {CRC_TABLE}, sized AS (
  SELECT doc_id, md5(coalesce(text, '')) AS grp, coalesce(text, '') AS body, octet_length(encode(coalesce(text, ''))) + 1 AS size
  FROM documents
), placed AS (
  SELECT *, sum(size) OVER (ORDER BY grp, doc_id ROWS UNBOUNDED PRECEDING)::BIGINT AS upto,
         row_number() OVER (ORDER BY grp, doc_id) AS place, sum(size) OVER ()::BIGINT AS total, max(size) OVER () AS longest
  FROM sized
), grouped AS (
  SELECT *, min(upto - size) OVER g AS group_start, max(upto) OVER g AS group_end FROM placed WINDOW g AS (PARTITION BY grp)
), edges AS (
  SELECT j, total, CASE WHEN group_end - group_start <= longest THEN group_start ELSE upto - size END AS low,
         CASE WHEN group_end - group_start <= longest THEN group_end ELSE upto END AS high
  FROM grouped, range(1, 8) t(j) WHERE (upto - size) * 8 // total < j AND upto * 8 // total >= j
), cuts AS (SELECT CASE WHEN 2 * total * j <= (low + high) * 8 THEN low ELSE high END AS cut FROM edges
), sharded AS (
  SELECT *, (SELECT count(*) FROM cuts WHERE cut <= upto - size)::INT AS shard FROM grouped)
SELECT doc_id, size::BIGINT AS size, {CRC}::BIGINT AS text_crc32, 'bytes' AS law, shard,
       row_number() OVER (PARTITION BY shard ORDER BY place) - 1 AS slot, NULL::INT AS grown_shard
FROM sharded, crc_table
"""

OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE}, found AS (
  SELECT doc_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run
  FROM documents
), runs AS (SELECT run, doc_id || ':' || run AS body, count(*) AS n FROM found WHERE length(run) >= 6 GROUP BY doc_id, run
), hashed AS (SELECT run, n, {CRC} AS h FROM runs, crc_table
), slipped AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2)
              ELSE run END AS word, n FROM hashed
), words AS (
  SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), holes AS (
  SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM words, unnest(range(1, length(word) + 1)) t(i)
), near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON h.rest = w.word
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON h.rest = w.word
), best AS (
  SELECT word, count(*) AS n_near, arg_max(other, (other_n, -place)) AS other, max(other_n) AS other_n
  FROM (SELECT *, row_number() OVER (ORDER BY encode(other)) AS place FROM near) GROUP BY word
), judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other END AS form,
         CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word
), chain(word, tip, depth) AS (
  SELECT word, word, 0 FROM words
  UNION ALL SELECT c.word, j.form, depth + 1 FROM chain c JOIN judged j ON c.tip = j.word WHERE j.form IS NOT NULL
)
SELECT j.word, form, root, n, n_near, form_n
FROM judged j JOIN (SELECT word, arg_max(tip, depth) AS root FROM chain GROUP BY word) r ON j.word = r.word
"""

OP13_SQL = r"""
WITH cut AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents WHERE text IS NOT NULL
), sized AS (SELECT doc_id, row, words, len(words) AS n FROM cut WHERE len(words) > 0
), whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM sized
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), posted AS (
  SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(words) AS term FROM sized)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weighed AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM posted, whole GROUP BY term, docs
), scored AS (
  SELECT item_id, row, doc_id,
         sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))))::BIGINT AS score
  FROM asked JOIN posted USING (term) JOIN weighed USING (term), whole GROUP BY item_id, row, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 50
"""
