"""HIS1-HIS5: what of a conversation goes into a summary and into a prompt. Messages: conv_id, turn, role, text, status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
KEEP_RECENT, FOLD_BATCH, TURN_CHARS, SUMMARY_INPUT_CHARS = 4, 4, 800, 2000
USER, ASSISTANT, CUT = "用户：", "助手：", "…（更早对话已截断）\n"
FIRST, OLD, NEW = "【历史对话】\n", "【已有摘要】\n", "\n\n【新增对话】\n"


def valid(messages: DataFrame) -> DataFrame:
    """HIS1: turns of user and assistant with text; an assistant's must be done. A text may come from the cloud instead."""
    text = F.trim(F.coalesce(F.nullif(F.col("text"), F.lit("")), F.col("cloud_text") if "cloud_text" in messages.columns else F.lit(None), F.lit("")))
    done = (F.col("role") == "user") | (F.coalesce("status", F.lit("")) == "done") if "status" in messages.columns else F.lit(True)
    return messages.where(F.col("role").isin("user", "assistant") & done).withColumn("text", text).where(F.col("text") != "")


def unfolded(messages: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """Valid turns after the last summarised one. markers: conv_id, upto_turn; a marker that is no valid turn counts as none."""
    rows = valid(messages)
    if markers is None:
        return rows
    known = markers.join(rows.select("conv_id", F.col("turn").alias("upto_turn")), ["conv_id", "upto_turn"], "left_semi")
    return rows.join(known, "conv_id", "left").where(F.col("upto_turn").isNull() | (F.col("turn") > F.col("upto_turn"))).drop("upto_turn")


def plan(messages: DataFrame, markers: DataFrame | None = None) -> DataFrame:
    """HIS2: turns with `fold`; conversations with fewer than a batch to fold are left out."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    rows = unfolded(messages, markers).withColumn("fold", newest > KEEP_RECENT)
    return rows.withColumn("_n", F.count_if("fold").over(Window.partitionBy("conv_id"))).where(F.col("_n") >= FOLD_BATCH).drop("_n")


def summary_input(folded: DataFrame, summaries: DataFrame | None = None) -> DataFrame:
    """HIS3: conv_id, input: the newest lines that fit, in order. folded: conv_id, turn, role, text."""
    line = F.concat(F.when(F.col("role") == "user", USER).otherwise(ASSISTANT), F.col("text"))
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = folded.withColumn("line", line).withColumn("_sum", F.sum(F.length("line")).over(newest)).withColumn("_n", F.row_number().over(newest))
    fits = F.col("_sum") <= SUMMARY_INPUT_CHARS
    kept = rows.where(fits | (F.col("_n") == 1)).withColumn("line", F.when(fits, F.col("line")).otherwise(F.concat(F.substring("line", 1, SUMMARY_INPUT_CHARS), F.lit("…"))))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n")
    joined = kept.groupBy("conv_id").agg(text.alias("t")).join(rows.groupBy("conv_id").agg((~F.bool_and(fits)).alias("cut")), "conv_id")
    body = F.concat(F.when(F.col("cut"), CUT).otherwise(""), F.col("t"))
    if summaries is None:
        return joined.select("conv_id", F.concat(F.lit(FIRST), body).alias("input"))
    return joined.join(summaries, "conv_id", "left").select("conv_id", F.when(F.coalesce("summary", F.lit("")) == "", F.concat(F.lit(FIRST), body)).otherwise(F.concat(F.lit(OLD), "summary", F.lit(NEW), body)).alias("input"))


def clip(text: Column, most: int = TURN_CHARS) -> Column:
    t = F.trim(text)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("…"))).otherwise(t)


def prompt_history(messages: DataFrame, markers: DataFrame | None = None, keep: int = KEEP_RECENT, most: int = TURN_CHARS) -> DataFrame:
    """HIS4, HIS5: the last `keep` turns not yet folded, each clipped."""
    newest = F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("turn")))
    return unfolded(messages, markers).withColumn("_n", newest).where(F.col("_n") <= keep).select("conv_id", "turn", "role", clip(F.col("text"), most).alias("content"))
