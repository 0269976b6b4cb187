"""The queries over the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.llm.class_lm import scored
from setweave.llm.common import LOWER, UPPER, scratch
from setweave.llm.exact_dedup import exact_dedup
from setweave.llm.mixing import mixture
from setweave.llm.piece_sampling import segmentations
from setweave.llm.quality import judged
from setweave.llm.secret_scan import scanned
from setweave.llm.simhash import near_classes
from setweave.llm.substring_dedup import without_repeated_passages
from setweave.llm.suffix_dedup import without_repeated_strings
from setweave.llm.token_files import encode_to_files, read_tokens

QUERIES, ORACLES = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query
def op1_huffman_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "token-files")
    encode_to_files(documents(spark, sf_dir), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_tokens(spark, path).select(F.col("id").alias("doc_id"), "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


@query
def op2_gumbel_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = segmentations(documents(spark, sf_dir), model, decode=True)
    return rows.select(F.col("id").alias("doc_id"), "sample", "n_pieces", "log_prob", "log_inclusion", F.crc32("ids").alias("ids_crc32"), F.sha2("text", 256).alias("decoded_sha256"))


@query
def op3_pigeonring_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir)).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _removed(cut: DataFrame, n: str) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s[1] - s[0])
    return cut.select(F.col("id").alias("doc_id"), F.col("n").alias(n), removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(without_repeated_strings(documents(spark, sf_dir)), "n_bytes")


@query
def op5_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(documents(spark, sf_dir))


@query
def op6_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir))


@query
def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


@query
def op8_forest_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(documents(spark, sf_dir))


@query
def op9_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


@query
def op10_automaton_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _removed(without_repeated_passages(documents(spark, sf_dir)), "n_words").drop("n_spans")


#: Bytes of a text as two hexadecimal digits each, and the windows of 100 that also start earlier.
ORACLES["op4_suffix_dedup"] = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT doc_id, p, substr(x, 2 * p + 1, 200) AS s FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM d WHERE length(x) >= 200)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
g AS (SELECT doc_id, p, coalesce(p > max(p) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 100, true) AS fresh FROM r),
k AS (SELECT doc_id, p, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM g),
c AS (SELECT doc_id, span, min(p) AS a, max(p) + 100 AS b FROM k GROUP BY doc_id, span),
e AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS open FROM c),
t AS (SELECT e.doc_id, sum(b - a) AS gone, count(*) AS spans, string_agg(substr(x, 2 * open + 1, 2 * (a - open)), '' ORDER BY a) || substr(any_value(x), 2 * max(b) + 1) AS kept FROM e JOIN d USING (doc_id) GROUP BY e.doc_id)
SELECT d.doc_id, (length(x) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES["op10_automaton_dedup"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS words FROM documents),
w AS (SELECT doc_id, p, words[p + 1 : p + 20] AS s FROM (SELECT doc_id, words, unnest(range(0, len(words) - 19)) AS p FROM d WHERE len(words) >= 20)),
r AS (SELECT doc_id, p FROM w QUALIFY row_number() OVER (PARTITION BY s ORDER BY doc_id, p) > 1),
gone AS (SELECT DISTINCT doc_id, p + i AS at FROM r, range(0, 20) AS o(i)),
u AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS at FROM d),
t AS (SELECT u.doc_id, count(*) AS n, count(gone.at) AS n_gone, string_agg(word, ' ' ORDER BY u.at) FILTER (gone.at IS NULL) AS kept FROM u LEFT JOIN gone ON gone.doc_id = u.doc_id AND gone.at = u.at GROUP BY u.doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_words, coalesce(n_gone, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)
"""

ORACLES["op6_quality_cascade"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS words FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) FILTER (regexp_matches(line, '^[\x20\x09-\x0D]*[-*•●▪]')) AS n_bullets
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
w AS (SELECT doc_id, p, words[p : p + 2] AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS p FROM d WHERE len(words) >= 3)),
again AS (SELECT doc_id, p FROM w QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
rep AS (SELECT doc_id, count(DISTINCT p + i) AS n_repeat_words FROM again, range(0, 3) AS o(i) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, coalesce(n_bullets, 0) AS n_bullets, len(list_filter(words, lambda x: regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_letter_words
  FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars / greatest(n_words, 1) < 2 OR word_chars / greatest(n_words, 1) > 15 OR n_symbols > 0.1 * n_words OR n_dup_lines > 0.3 * n_lines OR n_letter_words < 0.7 * n_words OR n_bullets > 0.9 * n_lines) AS kept FROM b
"""

ORACLES["op9_radix_dedup"] = f"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM n WINDOW w AS (PARTITION BY t)
"""
