"""The queries of this subpackage's operators over the driver's tables, and their SQL where SQL can express them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registrum.llm import bpe, chat, decontam, langid, linededup, minhash, quality, secrets, shards, warc
from registrum.llm._shared import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.bpe_roundtrip(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=False)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf_dir, "documents"), 16)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "kept")


#: Words of the shortest line or paragraph that production removes: headings, license lines and common phrases are no repeats of a
#: document's own text, and stay.
LEAST_WORDS = 20


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.dedup_units(table(spark, sf_dir, "documents"), min_words=LEAST_WORDS)
    return out.select("doc_id", "n_removed", "chars_removed", "spans", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_pages(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), quality.POLICIES[1])
    failed = F.col("failed").bitwiseAND(F.lit(quality.BASE.mask())) != 0
    return book.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (F.col("kept") & ~failed).alias("kept"))


#: Tools that the production query checks arguments against: tool, parameter, kind, required.
TOOLS = (("search", "query", "STRING", True), ("search", "limit", "BIGINT", False), ("fetch", "url", "STRING", True), ("calculate", "expression", "STRING", True))


def tool_turns(conversations: DataFrame) -> DataFrame:
    """The conversations with tools in them, since the table has none: texts that are JSON objects stay as they are, every assistant's
    turn calls a tool besides its text, every later user's turn answers one. By conversation and turn, some calls of the first ten
    turns use an earlier call's answer, some a later one's, some each other's; some identifiers come twice; some answers come before their call, some
    find none; some arguments are not what the tool takes. All rows stay."""
    c, t = F.col("conv_id"), F.col("turn")
    ident = lambda n: F.concat(F.lit("c"), n.cast("string"))
    used = F.when(t.between(3, 9) | ((c % 13 == 0) & (t < 9)), ident(F.when(c % 26 == 0, 4 - t).when(c % 13 == 0, t + 2).otherwise(t - 2))).otherwise(F.lit("all"))
    limit = F.when(c % 4 == 1, F.lit('"many"')).otherwise((t + 1).cast("string"))
    arguments = F.concat(F.lit('{"query":"'), used, F.lit('","limit":'), limit, F.lit("}"))
    call = F.struct(ident(F.when((c % 5 == 0) & (t == 5), 1).otherwise(t)).alias("id"), F.when(c % 7 == 6, "unknown").otherwise("search").alias("name"), arguments.alias("arguments"))
    answered = ident(F.when((c + t) % 7 == 0, t + 100).when((c + t) % 11 == 0, t + 1).otherwise(t - 1))
    said = F.when(F.col("role") == "assistant", F.to_json(F.struct(F.col("text").alias("content"), F.array(call).alias("tool_calls"))))
    said = said.when((F.col("role") == "user") & (t > 0), F.to_json(F.struct(F.col("text").alias("content"), answered.alias("tool_call_id"))))
    made = F.when(F.col("text").rlike(r"^\s*\{"), F.col("text")).otherwise(F.coalesce(said, F.col("text")))
    return conversations.select("conv_id", "turn", "role", made.alias("text"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = tool_turns(table(spark, sf_dir, "conversations"))
    linked = chat.link_tools(messages, spark.createDataFrame(TOOLS, chat.SCHEMA))
    return linked.select("conv_id", "turn", "role", "position", "after_turn", "depth", "n_calls", "n_valid", "status", F.sha2("message", 256).alias("message_sha256"))


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"), with_text=False)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.learn(docs), with_spans=False)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_bpe, op2_sharding, op3_minhash, op4_line_dedup, op5_warc, op6_decontamination, op7_quality, op8_chat, op9_secrets, op10_language)}


_SPACE, _WORDS = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"

_OP5 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS least FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN least < page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN least < page_id THEN least END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

_OP6 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
spans AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, array_to_string(w[s:s + 9], ' ') AS win, least(len(w), 10) AS width FROM spans),
widths AS (SELECT DISTINCT width FROM wins),
grams AS (SELECT doc_id, w, width, unnest(range(1, len(w) - width + 2)) AS s FROM d, widths WHERE len(w) >= width),
hits AS (SELECT g.doc_id, g.s, g.width, wins.item_id FROM (SELECT doc_id, s, width, array_to_string(w[s:s + width - 1], ' ') AS win FROM grams) g JOIN wins USING (win, width)),
places AS (SELECT DISTINCT doc_id, unnest(range(s, s + width)) AS pos FROM hits),
n AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY 1),
l AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN l USING (doc_id)
"""

_OP7 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, s, array_to_string(w[s:s + 7], ' ') AS win FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS s FROM d WHERE len(w) > 8)),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id, win) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, unnest(range(s, s + 8)) AS pos FROM r) GROUP BY 1),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(text) - len(regexp_extract_all(text, '[\x20\x09-\x0D]')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{L}'))) AS letter_words,
    coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM d LEFT JOIN c USING (doc_id)),
b AS (SELECT *, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR word_chars > 14 * n_words OR 2 * word_chars < 5 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * len(lines) OR 100 * letter_words < 70 * n_words) AS kept
FROM b
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_warc": _OP5, "op6_decontamination": _OP6, "op7_quality": _OP7}
