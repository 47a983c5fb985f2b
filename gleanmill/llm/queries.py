"""The thin queries ``opN_<name>`` over whole tables, with production parameters, and their SQL where it can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, media, packing, pieces, quality, resample, sharding, tokencount, toxicity
from .runtime import shared_path, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    roles = F.element_at(F.array(F.lit("user"), F.lit("assistant")), (F.col("id") + 1).cast("int"))
    own = spark.range(0, 2, 1, 1).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), roles.alias("role"), F.lit(said).alias("text"))
    return chat.digest(chat.format_conversations(turns.unionByName(own)))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_decode(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "media")
    media.write_archives(table(spark, sf_dir, "documents"), path)
    return media.features(media.read_archives(spark, path))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_documents(table(spark, sf_dir, "documents"), jaccard.Rule(words=3, num=90, den=100))


def op5_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), shards=24)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "start_byte")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).drop("clean_text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


_ALL = (
    op1_chat_format,
    op2_sentencepiece,
    op3_media,
    op4_ngram_jaccard,
    op5_importance_resampling,
    op6_sharding,
    op7_toxicity,
    op8_quality_rules,
    op9_packing,
    op10_token_counts,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1, "op4_ngram_jaccard": OP4, "op8_quality_rules": OP8}


OP1 = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1::BIGINT, 0::BIGINT, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
told AS (
  SELECT *, CASE WHEN regexp_matches(text, '<\|im_(start|end)\|>|<\\+n?\|')
                 THEN regexp_replace(text, '<(\\*n?)\|', '<\\\1|', 'g') ELSE text END AS body FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10)))::BIGINT AS formatted_chars,
       count_if(body <> text)::BIGINT AS n_escaped
FROM told GROUP BY conv_id"""

OP4 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, md5(array_to_string(CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END, chr(10))) AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 90 * (p.n + q.n - c)),
ends AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, ends.y FROM reach JOIN ends ON reach.b = ends.x)
SELECT a AS doc_id, any_value(coalesce(n.n, 0))::BIGINT AS n_shingles, min(b) AS component_id
FROM reach LEFT JOIN n ON n.doc_id = a GROUP BY a"""

OP8 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, '') AS host FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS all_lines FROM d),
l AS (SELECT *, list_filter(all_lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM w),
grams AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
          FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) > 2)),
again AS (SELECT doc_id, i FROM grams QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
covered AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY doc_id),
norm AS (SELECT DISTINCT host, text, trim(lower(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), ' ') AS line
         FROM (SELECT host, text, unnest(lines) AS x FROM l)),
hot AS (SELECT host, line FROM norm GROUP BY ALL HAVING count(*) > 20),
hot_of AS (SELECT host, list(line) AS hot FROM hot GROUP BY host),
clean AS (SELECT l.*, list_filter(all_lines, lambda x: NOT list_contains(coalesce(hot, []), trim(lower(regexp_replace(x, '[\x20\x09-\x0D]+', ' ', 'g')), ' '))) AS stays
          FROM l LEFT JOIN hot_of USING (host)),
counts AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(regexp_extract_all(array_to_string(stays, chr(10)), '[^\x20\x09-\x0D]+'))::BIGINT AS left_words
  FROM clean LEFT JOIN covered USING (doc_id))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * left_words >= n_words AS kept
FROM counts"""
