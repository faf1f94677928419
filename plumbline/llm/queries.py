"""One query for each operator of this package, over its whole table, with production parameters.

The operators keep their own interfaces; a query derives digests and picks columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.expressions import col
from plumbline.llm.byte_bpe import encode_documents
from plumbline.llm.conversation_repair import REPORT, conversation_report
from plumbline.llm.embedding_dedup import near_vector_groups
from plumbline.llm.exact_dedup import content_groups
from plumbline.llm.line_dedup import drop_repeated_lines
from plumbline.llm.lm_scoring import BIGRAM_WEIGHT, SMOOTHING, score_documents
from plumbline.llm.packing import pack_documents
from plumbline.llm.phrases import collocations
from plumbline.llm.quality import score_quality, train_quality
from plumbline.llm.sharding import shard_documents
from plumbline.llm.simhash_dedup import near_duplicate_groups
from plumbline.llm.substring_dedup import remove_repeated_windows
from plumbline.llm.toxicity import grade_toxicity, train_toxicity

WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = pack_documents(_table(spark, folder, "documents"), WORD_VOCABULARY, with_ids=False)
    return pieces.drop("ids")


def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return encode_documents(_table(spark, folder, "documents"), BYTE_RANKS, digests=True)


def op3_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return grade_toxicity(docs, train_toxicity(docs, _table(spark, folder, "labels")))


def op4_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vector_groups(_table(spark, folder, "embeddings"))


def op5_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicate_groups(_table(spark, folder, "documents"))


def op6_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = drop_repeated_lines(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    kept = remove_repeated_windows(_table(spark, folder, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    scored = score_documents(_table(spark, folder, "documents"), _table(spark, folder, "labels"))
    # Adding zero turns a rounded -0.0 into 0.0.
    losses = [(F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("target_loss", "background_loss", "difference")]
    return scored.select("doc_id", "n_tokens", *losses)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return score_quality(docs, train_quality(docs, _table(spark, folder, "labels")))


def op10_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return content_groups(_table(spark, folder, "documents"), keep="largest")


def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(_table(spark, folder, "documents"))


def op12_sharding(spark: SparkSession, folder: str) -> DataFrame:
    dealt = shard_documents(_table(spark, folder, "documents"), shards=24)
    return dealt.select("*", F.lit("bytes").alias("law"), F.lit(None).cast("int").alias("grown_shard"))


def damaged(turns: DataFrame) -> tuple[DataFrame, Column]:
    """Some rows dropped, emptied, without their stops, repeated or given to the user, by a hash of their place; the
    second value says how often a row stands there."""
    name, turn = (F.coalesce(col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))
    fault = F.crc32(F.concat_ws(":", name, turn).cast("binary")) % 20
    text = F.coalesce(col("text"), F.lit(" "))
    rows = turns.select("conv_id", "turn", "role", "text", fault.alias("fault")).filter("fault <> 0").select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.coalesce("role", F.lit(" "))).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        "fault",
    )
    return rows, F.when(F.col("fault") == 3, 2).otherwise(1)


def op13_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    turns = _table(spark, folder, "conversations")
    rows, copies = damaged(turns)
    report = conversation_report(rows, copies=copies).withColumnRenamed("conv_id", "reported_id")
    # A conversation of which no row is left has no report.
    every = turns.select("conv_id").distinct().join(report, F.col("conv_id").eqNullSafe(F.col("reported_id")), "left")
    return every.select(
        "conv_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in REPORT], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"),
    )


# A-Z, and the six characters that are stripped or separate words.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_STRIPPED = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

OP6_SQL = f"""
WITH split_lines AS (
  SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS place
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
keyed AS (SELECT *, {_LOWER.format(f"trim(line, {_STRIPPED})")} AS key FROM split_lines),
common AS (
  SELECT key, max(doc_id) AS last_id FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT k.*, c.key IS NOT NULL AND k.doc_id <> c.last_id AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""

OP7_SQL = """
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words
  FROM documents),
windows AS (
  SELECT doc_id, pos, array_to_string(words[pos:pos + 19], ' ') AS body
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS pos FROM words WHERE len(words) >= 20)),
later AS (
  SELECT doc_id, pos FROM (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY body ORDER BY doc_id, pos) AS n FROM windows)
  WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(pos, pos + 20)) AS place FROM later),
placed AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS place FROM words),
kept AS (
  SELECT p.doc_id, count(*) FILTER (g.place IS NOT NULL) AS n_removed,
         string_agg(word, ' ' ORDER BY p.place) FILTER (g.place IS NULL) AS body
  FROM placed p LEFT JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY p.doc_id)
SELECT w.doc_id, len(w.words) AS n_words, coalesce(n_removed, 0) AS n_removed,
       sha256(coalesce(body, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id"""

OP8_SQL = f"""
WITH words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good
  FROM documents),
-- A word is told from the marks by the letter before it.
sequences AS (
  SELECT doc_id, good, list_concat(['begin'], list_transform(words, lambda w: 'w' || w), ['end']) AS tokens FROM words),
placed AS (
  SELECT doc_id, good, tokens[place - 1] AS before, tokens[place] AS token
  FROM (SELECT doc_id, good, tokens, unnest(range(2, len(tokens) + 1)) AS place FROM sequences)),
own AS (SELECT doc_id, good, token, count(*) AS n FROM placed GROUP BY ALL),
own_pairs AS (SELECT doc_id, good, before, token, count(*) AS n FROM placed GROUP BY ALL),
own_before AS (SELECT doc_id, before, count(*) AS n FROM placed GROUP BY ALL),
unigrams AS (SELECT token, sum(n) AS every, coalesce(sum(n) FILTER (good), 0) AS target FROM own GROUP BY token),
bigrams AS (SELECT before, token, sum(n) AS every, coalesce(sum(n) FILTER (good), 0) AS target FROM own_pairs GROUP BY ALL),
contexts AS (SELECT before, sum(every) AS every, sum(target) AS target FROM bigrams GROUP BY before),
sizes AS (SELECT count(*) AS words, sum(every) AS every, sum(target) AS target FROM unigrams),
lengths AS (SELECT doc_id, good, count(*) AS n_tokens FROM placed GROUP BY ALL),
seen AS (
  SELECT p.doc_id, l.n_tokens, p.n AS times, s.words,
         u.every - o.n AS u_every, u.target - CASE WHEN p.good THEN o.n ELSE 0 END AS u_target,
         b.every - p.n AS b_every, b.target - CASE WHEN p.good THEN p.n ELSE 0 END AS b_target,
         c.every - q.n AS c_every, c.target - CASE WHEN p.good THEN q.n ELSE 0 END AS c_target,
         s.every - l.n_tokens AS s_every, s.target - CASE WHEN p.good THEN l.n_tokens ELSE 0 END AS s_target
  FROM own_pairs p JOIN lengths l ON p.doc_id = l.doc_id JOIN own o ON p.doc_id = o.doc_id AND p.token = o.token
  JOIN own_before q ON p.doc_id = q.doc_id AND p.before = q.before
  JOIN unigrams u ON p.token = u.token JOIN bigrams b ON p.before = b.before AND p.token = b.token
  JOIN contexts c ON p.before = c.before CROSS JOIN sizes s),
chances AS (
  SELECT doc_id, n_tokens, times,
         CASE WHEN c_every > 0 THEN {BIGRAM_WEIGHT} ELSE 0.0 END::DOUBLE AS k_every,
         CASE WHEN c_target > 0 THEN {BIGRAM_WEIGHT} ELSE 0.0 END::DOUBLE AS k_target,
         b_every::DOUBLE / greatest(c_every, 1)::DOUBLE AS p_every, b_target::DOUBLE / greatest(c_target, 1)::DOUBLE AS p_target,
         (u_every::DOUBLE + {SMOOTHING}::DOUBLE) / (s_every::DOUBLE + {SMOOTHING}::DOUBLE * words) AS base_every,
         (u_target::DOUBLE + {SMOOTHING}::DOUBLE) / (s_target::DOUBLE + {SMOOTHING}::DOUBLE * words) AS base_target
  FROM seen),
losses AS (
  SELECT doc_id, n_tokens,
         sum(-log2(k_target * p_target + (1 - k_target) * base_target) * times) / n_tokens AS target_loss,
         sum(-log2(k_every * p_every + (1 - k_every) * base_every) * times) / n_tokens AS background_loss
  FROM chances GROUP BY doc_id, n_tokens)
SELECT doc_id, n_tokens, round(target_loss, 6) + 0.0 AS target_loss, round(background_loss, 6) + 0.0 AS background_loss,
       round(target_loss - background_loss, 6) + 0.0 AS difference
FROM losses"""

OP10_SQL = f"""
WITH lowered AS (SELECT doc_id, {_LOWER.format("coalesce(text, '')")} AS body FROM documents),
grouped AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM lowered GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(body) AS text_sha256
FROM lowered JOIN grouped USING (body)"""

OP11_SQL = f"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(body, '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, {_LOWER.format("coalesce(text, '')")} AS body FROM documents)),
split AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda w: w <> '') AS words FROM pieces),
sizes AS (SELECT lang, sum(len(words)) AS n FROM split GROUP BY lang),
known AS (
  SELECT lang, phrase, size, count(*) AS f FROM (
    SELECT lang, size, array_to_string(words[pos:pos + size - 1], ' ') AS phrase
    FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS pos
          FROM split, (VALUES (1), (2), (3), (4), (5)) AS s(size) WHERE len(words) >= size))
  GROUP BY ALL HAVING count(*) >= 100),
cuts AS (
  SELECT *, string_split(phrase, ' ') AS words, unnest(range(1, size)) AS k FROM known WHERE size >= 2),
scored AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n, k,
         (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score
  FROM cuts c JOIN known l ON l.lang = c.lang AND l.phrase = array_to_string(words[1:k], ' ')
  JOIN known r ON r.lang = c.lang AND r.phrase = array_to_string(words[k + 1:], ' ') JOIN sizes s ON s.lang = c.lang),
weakest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT w.lang, w.phrase FROM weakest w JOIN known b
  ON b.lang = w.lang AND b.f >= w.a AND b.size > 2 AND b.phrase <> w.phrase AND contains(' ' || b.phrase || ' ', ' ' || w.phrase || ' ')),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase::BLOB) AS rank
  FROM weakest w WHERE NOT EXISTS (SELECT 1 FROM longer b WHERE b.lang = w.lang AND b.phrase = w.phrase))
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000"""

QUERIES = {f.__name__: f for f in (
    op1_packing, op2_byte_bpe, op3_toxicity, op4_embedding_dedup, op5_simhash_dedup, op6_line_dedup, op7_substring_dedup,
    op8_lm_scoring, op9_quality, op10_exact_dedup, op11_phrases, op12_sharding, op13_conversation_repair,
)}
ORACLES = {"op6_line_dedup": OP6_SQL, "op7_substring_dedup": OP7_SQL, "op8_lm_scoring": OP8_SQL, "op10_exact_dedup": OP10_SQL, "op11_phrases": OP11_SQL}
