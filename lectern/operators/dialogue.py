"""Conversations: intents, safety rules and the views of a history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lectern.functions.exprs import WHITE, is_blank, trimmed, unfence
from lectern.operators.retrieval import ordered_lines

# Patterns and words of the rules.
INJECTION = ["(?i:ignore\\s+previous)", "(?i:forget\\s+instructions?)", "(?i:system\\s+prompt)", "(?i:jailbreak)", "越狱", "提示词", "注入", "指令", "(?i:act\\s+as)"]
CONTINUE = ["继续", "下一步", "接着", "继续执行", "go on", "next", "proceed", "确认执行"]
ACKNOWLEDGE = ["继续", "ok", "收到"]
GREETINGS = ["你好", "您好", "hello", "hi", "嗨", "在吗", "在不在"]
HISTORY, WIDTH = 6, 280


def injection_flag(text: Column) -> Column:
    """Whether a text tries to override its instructions; blank ones don't."""
    return F.when(is_blank(text), False).otherwise(text.rlike("|".join(INJECTION)))


def can_bypass(text: Column, previous_mode: Column) -> Column:
    """Whether a turn keeps the previous mode without being classified."""
    t = trimmed(F.coalesce(text, F.lit("")))
    low = F.lower(t)
    either = lambda tests: F.coalesce(*[F.when(x, True) for x in tests], F.lit(False))
    greeting = either([low.startswith(g) for g in GREETINGS])
    deep = (F.length(t) <= 24) & either([low.endswith(k) for k in CONTINUE])
    plain = (F.length(t) <= 12) & low.isin(*ACKNOWLEDGE)
    out = F.when(previous_mode.isNull() | (previous_mode == "") | (t == "") | injection_flag(t) | greeting, False)
    return out.when(previous_mode == "deep", deep).when(previous_mode == "text-search", plain).otherwise(False)


def parse_intent(raw: Column, user_input: Column) -> Column:
    """struct<intent, confidence, reason, suggested_query, source> of a classifier's output."""
    parsed = F.try_parse_json(unfence(raw))
    get = lambda path, kind: F.try_variant_get(parsed, f"$.{path}", kind)
    there = F.variant_get(parsed, "$.confidence", "variant")
    number = F.try_variant_get(parsed, "$.confidence", "double")
    as_text = F.try_variant_get(parsed, "$.confidence", "string")
    confidence = F.when(there.isNull(), 0.5).when(F.is_variant_null(there) | (F.trim(as_text) == ""), 0.0).otherwise(F.coalesce(F.nanvl(number, F.lit(0.5)), F.lit(0.5)))
    confidence = F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence))
    is_text = lambda path: F.when(F.schema_of_variant(F.variant_get(parsed, f"$.{path}", "variant")) == "STRING", get(path, "string"))
    none = F.lit(None).cast("string")
    fields = ("intent", "confidence", "reason", "suggested_query", "source")
    verdict = lambda *values: F.struct(*[x.alias(k) for k, x in zip(fields, values)])
    good = verdict(F.when(get("intent", "string") == "other", "other").otherwise("search"), confidence, is_text("reason"), is_text("suggested_query"), F.lit("llm"))
    bad = verdict(F.lit("search"), F.lit(0.5), F.lit("LLM 分类失败，回落到默认检索"), none, F.lit("rule"))
    blank = verdict(F.lit("search"), F.lit(0.0), F.lit("输入为空"), none, F.lit("rule"))
    return F.when(is_blank(user_input), blank).when(parsed.isNull() | F.is_variant_null(parsed), bad).otherwise(good)


def route(turns: DataFrame) -> DataFrame:
    """turns (intent, injection, draft, mode, suggested_query) with route: reply, deep or the mode asked for."""
    refuse = (F.col("intent") == "other") | F.col("injection")
    has_draft = ~is_blank("draft")
    out = F.when(refuse, "reply").when(has_draft, "deep").otherwise(F.col("mode"))
    return turns.withColumns({"route": out, "reply_query": F.when(refuse, F.col("suggested_query"))})


def latest_user(messages: DataFrame) -> DataFrame:
    """(conv_id, text): the last user message that is not blank."""
    said = messages.where((F.col("role") == "user") & ~is_blank("text"))
    return said.groupBy("conv_id").agg(F.max_by("text", "turn").alias("text"))


def last_assistant(messages: DataFrame) -> DataFrame:
    """(conv_id, text): the last assistant message, empty if it has no text."""
    said = messages.where("role = 'assistant'")
    return said.groupBy("conv_id").agg(F.coalesce(F.max_by("text", "turn"), F.lit("")).alias("text"))


def summary(messages: DataFrame, n: int = HISTORY, width: int = WIDTH) -> DataFrame:
    """(conv_id, summary): the last n messages, one line each, white space collapsed, cut at width."""
    last = messages.withColumn("__n", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn")))).where(F.col("__n") <= n)
    text = F.substring(trimmed(F.regexp_replace(F.coalesce("text", F.lit("")), f"{WHITE}+", " ")), 1, width)
    return last.groupBy("conv_id").agg(ordered_lines(F.concat(F.lit("["), F.col("role"), F.lit("] "), text), F.col("turn")).alias("summary"))
