"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_toolcalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as linked, validated and ordered calls; other turns as context."""
    from .toolcalls import CHAT_SCHEMA, chat_calls, context, link

    chat = _table(spark, sf_dir, "conversations")
    return link(*chat_calls(chat), CHAT_SCHEMA).unionByName(context(chat))


OP3_SQL = r"""
WITH call AS (
  SELECT conv_id, turn, min(coalesce(text, chr(1114111))) AS t0, count(*) - 1 AS more FROM conversations WHERE role = 'user' GROUP BY conv_id, turn
), calls AS (
  SELECT conv_id, turn AS position, 'c' || conv_id || '-' || turn AS call_id, CASE WHEN t0 <> chr(1114111) THEN t0 END AS text, more,
    row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS rn FROM call
), leveled AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id, position % 2, position - 2 * rn ORDER BY position) - 1 AS level FROM calls
), res AS (
  SELECT conv_id AS rc, turn AS answered, 'c' || conv_id || '-' || (turn - 1) AS rk, min(text) AS content, count(*) - 1 AS more_r
  FROM conversations WHERE role = 'assistant' GROUP BY conv_id, turn
), j AS (
  SELECT *, CASE WHEN call_id IS NULL THEN 'orphan' WHEN rk IS NULL THEN 'pending' ELSE 'linked' END AS status,
    CASE WHEN call_id IS NULL THEN '' WHEN text IS NULL THEN 'type:prompt' WHEN length(text) < 25 THEN 'short:prompt' ELSE '' END AS errors
  FROM leveled FULL JOIN res ON call_id = rk
)
SELECT coalesce(conv_id, rc) AS conv_id, coalesce(call_id, rk) AS call_id, position, answered, level, status,
  call_id IS NOT NULL AND errors = '' AS valid, errors, (coalesce(more, 0) + coalesce(more_r, 0))::BIGINT AS repeats,
  '{"arguments":' || CASE WHEN call_id IS NULL THEN 'null' ELSE '{"prompt":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"turn":' || position || '}' END
  || ',"call_id":' || to_json(coalesce(call_id, rk)) || ',"name":' || CASE WHEN call_id IS NULL THEN 'null' ELSE '"reply"' END
  || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || ',"status":"' || status || '"}' AS json
FROM j
UNION ALL SELECT conv_id, NULL, turn, NULL, NULL, 'context', false, '', 0::BIGINT,
  '{"content":' || coalesce(to_json(text)::VARCHAR, 'null') || ',"role":' || coalesce(to_json(role)::VARCHAR, 'null') || '}'
FROM conversations WHERE role IS NULL OR role NOT IN ('user', 'assistant')
"""


def op4_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilities of quality and toxicity of all documents, and whether to keep them."""
    from .cotrain import co_train

    found = co_train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    keep = (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)
    return found.select(F.col("id").alias("doc_id"), "quality", "toxic", keep.alias("keep"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    from .packing import pack

    found = pack(_table(spark, sf_dir, "documents"), _vocabulary())
    return found.withColumn("ids_crc32", F.crc32("ids")).withColumnRenamed("id", "doc_id").drop("ids")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back by byte ranges."""
    from .warc import key_of, read_warc, write_warc

    found = read_warc(spark, write_warc(_table(spark, sf_dir, "pages")), with_payload=False)
    return found.select(
        key_of("record_id").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        key_of("refers_to").cast("bigint").alias("refers_to"),
    )


OP6_SQL = r"""
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha256(h) AS payload_digest,
  CASE WHEN strlen(h) >= 100 AND page_id > low THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN strlen(h) >= 100 AND page_id > low THEN low END AS refers_to
FROM (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS low FROM pages)
"""


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of four fifths of them."""
    from .lm import score_texts

    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1
    found = score_texts(_table(spark, sf_dir, "documents"), ~held_out)
    names = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    return found.select(F.col("id").alias("doc_id"), (~F.col("trained")).alias("held_out"), *names)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents that lie in a benchmark window, and the items met."""
    from .decontam import contamination

    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(len(words), 10) AS k, array_to_string(words[i:i + 9], ' ') AS gram
  FROM b, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS u(i) WHERE len(words) > 0
), size AS (SELECT DISTINCT k FROM bw), dw AS (
  SELECT doc_id, k, i, array_to_string(words[i:i + k - 1], ' ') AS gram FROM w, size, unnest(range(1, len(words) - k + 2)) AS u(i)
), met AS (
  SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, gram)
), hit AS (
  SELECT doc_id, count(DISTINCT i + o) AS n FROM met, unnest(range(0, k)) AS v(o) GROUP BY doc_id
), it AS (
  SELECT doc_id, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM met) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN it ON w.doc_id = it.doc_id
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by SimHash over Golay keys."""
    from .simhash import near_duplicates

    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op1_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the images of all pages; their edits neither turn nor zoom, so a few scales and corners do."""
    from .media import copies, page_images

    found = copies(page_images(_table(spark, sf_dir, "pages")), scales=3, apart=16, whole=True)
    return found.select(F.col("id").alias("page_id"), F.col("class").alias("image_class"), F.col("component").alias("component_id"), "n_descriptors")


def op2_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without 20-word windows that start earlier elsewhere."""
    from .substring import remove_repeats

    found = remove_repeats(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS gram FROM w, unnest(range(1, len(words) - 18)) AS u(i)
), later AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS rn FROM win) WHERE rn > 1
), gone AS (
  SELECT DISTINCT doc_id, i + o AS j FROM later, unnest(range(0, 20)) AS v(o)
), word AS (
  SELECT doc_id, j, words[j] AS x FROM w, unnest(range(1, len(words) + 1)) AS t(j)
), kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY j) AS kept, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, (len(words) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""


def op10_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of a ring without slack: counts differ by one at most."""
    from .sharding import shard_rows

    found = shard_rows(_table(spark, sf_dir, "documents"), shards=16, slack=0.0)
    nothing = F.lit(None).cast("int").alias("grown_shard")
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", nothing)


def lm_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of the language model's scores, on a split that SQL can express."""
    from .lm import score_texts

    found = score_texts(_table(spark, sf_dir, "documents"), F.col("doc_id") % 5 != 1)
    return found.select(F.col("id").alias("doc_id"), "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


LM_BASE_SQL = r"""
WITH w AS (
  SELECT doc_id, list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') AS words FROM documents
), t AS (SELECT doc_id, unnest(words) AS x FROM w), c AS (
  SELECT x, count(*) AS c FROM t WHERE doc_id % 5 <> 1 GROUP BY x
), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, count(*)::BIGINT AS n_tokens, count(c)::BIGINT AS n_known, any_value(n) AS train_tokens,
  round(sum(log10((coalesce(c, 0) + 0.5) / (n + 0.5 * (v + 1)))), 4) AS base_score
FROM t LEFT JOIN c USING (x), n GROUP BY doc_id
"""


def ring_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, slots and bytes of the 16 shards: the law ``rows``, and that no row is lost."""
    from .sharding import shard_rows

    found = shard_rows(_table(spark, sf_dir, "documents"), shards=16, slack=0.0).groupBy("shard")
    found = found.agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.max("slot").alias("last"), F.sum("size").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy())  # 16 rows
    return found.select("shard", "n", "slots", "last", total.alias("total_bytes"))


RING_BALANCE_SQL = """
WITH d AS (SELECT count(*) AS n, sum(strlen(coalesce(text, '')) + 1)::BIGINT AS b FROM documents),
s AS (SELECT i::INT AS shard, (n // 16 + CASE WHEN i < n % 16 THEN 1 ELSE 0 END)::BIGINT AS k, b FROM d, unnest(range(16)) AS r(i))
SELECT shard, k AS n, k AS slots, k - 1 AS last, b AS total_bytes FROM s
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_media": op1_media, "op2_substring": op2_substring, "op3_toolcalls": op3_toolcalls, "op4_cotrain": op4_cotrain, "op5_packing": op5_packing, "op6_warc": op6_warc, "op7_lm": op7_lm, "op8_decontaminate": op8_decontaminate, "op9_simhash": op9_simhash, "op10_ring": op10_ring, "lm_base": lm_base, "ring_balance": ring_balance}
ORACLES: dict[str, str] = {"op2_substring": OP2_SQL, "op3_toolcalls": OP3_SQL, "op6_warc": OP6_SQL, "op8_decontaminate": OP8_SQL, "lm_base": LM_BASE_SQL, "ring_balance": RING_BALANCE_SQL}
