"""Queries and oracle SQL of the text operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import align, bpe, chat, language, ogg, packing, pii, quality_cnn, quality_rules, secrets, simhash, toxicity, vector_codes
from .common import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_classes(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op5_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.media_features(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_cnn.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_scan(table(spark, sf_dir, "documents"))


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chat(table(spark, sf_dir, "conversations"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.alignment(table(spark, sf_dir, "documents"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def with_calls(conversations: DataFrame) -> DataFrame:
    """The conversations with a call in place of each assistant's message, that needs the result of the one two turns
    before, and a result in place of each other message from the third turn on; some limits are out of range, and some
    results answer no call."""
    start = F.col("turn") == 1
    asked = F.when(start, F.lit('"start"')).otherwise(F.concat(F.lit('{"$result":"c'), (F.col("turn") - 2).cast("string"), F.lit('"}')))
    call = F.concat(F.lit('<tool_call>{"id":"c'), F.col("turn").cast("string"), F.lit('","name":"search","arguments":{"query":'), asked, F.lit(',"limit":'), (F.col("conv_id") % 130).cast("string"), F.lit("}}</tool_call>"))
    named = F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") == 4), "none").otherwise(F.concat(F.lit("c"), (F.col("turn") - 1).cast("string")))
    result = F.concat(F.lit('{"tool_call_id":"'), named, F.lit('","content":'), F.length("text").cast("string"), F.lit("}"))
    is_call, is_result = F.col("role") == "assistant", (F.col("role") != "assistant") & (F.col("turn") >= 2)
    return conversations.withColumns({"text": F.when(is_call, call).when(is_result, result).otherwise(F.col("text")), "role": F.when(is_result, "tool").otherwise(F.col("role"))})


def chat_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's operator on conversations with calls: levels and links, as SQL finds them by joins and recursion."""
    made = chat.format_chat(with_calls(table(spark, sf_dir, "conversations")))
    told = lambda field: F.get_json_object("message", f"$.tool_calls[0].{field}").cast("long")
    return made.select("conv_id", "turn", "role", "n_calls", "n_linked", "n_invalid", "answers_turn", told("level").alias("level"), told("result_turn").alias("result_turn"), F.when(F.col("role") == "tool", F.get_json_object("message", "$.content").cast("long")).alias("content"))


CHAT_LINKING = """
WITH RECURSIVE c AS (SELECT conv_id, turn FROM conversations WHERE role = 'assistant'),
  r AS (SELECT conv_id, turn, CASE WHEN conv_id % 7 = 0 AND turn = 4 THEN 'none' ELSE 'c' || (turn - 1) END AS id, length(text) AS size FROM conversations WHERE role <> 'assistant' AND turn >= 2),
  lv AS (SELECT conv_id, turn, 0 AS level FROM c WHERE turn = 1 UNION ALL SELECT c.conv_id, c.turn, lv.level + 1 FROM lv JOIN c ON c.conv_id = lv.conv_id AND c.turn = lv.turn + 2)
SELECT m.conv_id, m.turn, CASE WHEN r.id IS NOT NULL THEN 'tool' ELSE m.role END AS role, (c.turn IS NOT NULL)::BIGINT AS n_calls,
  (c.turn IS NOT NULL AND a.turn IS NOT NULL)::BIGINT AS n_linked, (c.turn IS NOT NULL AND m.conv_id % 130 NOT BETWEEN 1 AND 100)::BIGINT AS n_invalid,
  CASE WHEN r.id IS NOT NULL THEN coalesce(k.turn, -1) END AS answers_turn,
  CASE WHEN c.turn IS NOT NULL THEN coalesce(lv.level, -1) END::BIGINT AS level, CASE WHEN c.turn IS NOT NULL THEN a.turn END AS result_turn, r.size AS content
FROM conversations m
LEFT JOIN c ON m.conv_id = c.conv_id AND m.turn = c.turn
LEFT JOIN r ON m.conv_id = r.conv_id AND m.turn = r.turn
LEFT JOIN lv ON m.conv_id = lv.conv_id AND m.turn = lv.turn
LEFT JOIN r a ON a.conv_id = m.conv_id AND a.id = 'c' || m.turn
LEFT JOIN c k ON k.conv_id = m.conv_id AND r.id = 'c' || k.turn
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_toxicity": op2_toxicity,
        "op3_packing": op3_packing,
        "op4_bpe": op4_bpe,
        "op5_ogg": op5_ogg,
        "op6_pii": op6_pii,
        "op7_quality": op7_quality,
        "op8_secrets": op8_secrets,
        "op9_chat": op9_chat,
        "op10_quality_rules": op10_quality_rules,
        "op11_vector_codes": op11_vector_codes,
        "op12_alignment": op12_alignment,
        "op13_language": op13_language,
        "chat_linking": chat_linking,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op8_secrets": secrets.oracle(),
        "op9_chat": chat.ORACLE,
        "op10_quality_rules": quality_rules.oracle(),
        "op11_vector_codes": vector_codes.oracle(),
        "chat_linking": CHAT_LINKING,
    }
