"""TEL1-TEL5, TRC1, BUD1-BUD2, NPR1, MRG1: timings, traces, budgets, loops without progress, merged answers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import count_tokens, strip_think

DIVIDER = "\n\n── 云端拓展（无本地文档依据，不执行幻觉校验）──\n\n"


def stage_stats(records: DataFrame) -> DataFrame:
    """TEL1. records: stage, ts, duration; equal times go by duration."""
    return records.groupBy("stage").agg(F.count("*").alias("count"), F.sum("duration").alias("total"), F.avg("duration").alias("avg"), F.min("duration").alias("min"), F.max("duration").alias("max"), F.max_by("duration", F.struct("ts", "duration")).alias("last"))


def device_comparison(records: DataFrame, a: str = "wasm", b: str = "webgpu") -> DataFrame:
    """TEL2: mean time by device and their ratio, null where a side is missing or takes no time."""
    wide = records.where(F.col("device").isNotNull()).groupBy("stage").pivot("device", [a, b]).agg(F.avg("duration"))
    return wide.withColumn("speedup", F.when(F.col(b) > 0, F.col(a) / F.col(b)))


def retrieval_stats(samples: DataFrame) -> DataFrame:
    """TEL3 of all samples."""
    return samples.agg(*retrieval_measures())


def retrieval_measures() -> list[Column]:
    """TEL3. samples: ts, mode, hits, index_size, dropped, no_hit, relevance (array), window_chunks, matched_chunks, reranked, top_changed, overlap, skip_reason."""
    total = F.sum(F.aggregate("relevance", F.lit(0.0), lambda s, x: s + x))
    n = F.sum(F.size("relevance"))
    reranked = F.count_if("reranked")
    return [
        F.count("*").alias("count"), F.avg("hits").alias("avg_hits"), F.avg("index_size").alias("avg_index_size"), F.avg(F.coalesce(F.try_element_at("relevance", F.lit(1)), F.lit(0.0))).alias("avg_top1"),
        F.when(n == 0, 0.0).otherwise(total / n).alias("avg_relevance"), F.avg("dropped").alias("avg_dropped"), F.count_if("no_hit").alias("no_hit_count"), F.avg(F.col("no_hit").cast("int")).alias("no_hit_rate"),
        F.avg("window_chunks").alias("avg_window_chunks"), F.avg("matched_chunks").alias("avg_matched_chunks"), F.count_if(F.col("mode") == "bm25").alias("bm25_fallbacks"), reranked.alias("rerank_count"),
        F.when(reranked == 0, 0.0).otherwise(F.count_if(F.col("reranked") & F.col("top_changed")) / reranked).alias("rerank_top_changed_rate"),
        F.when(reranked == 0, 0.0).otherwise(F.sum(F.when(F.col("reranked"), F.coalesce("overlap", F.lit(1.0)))) / reranked).alias("rerank_avg_overlap"),
        F.count_if(F.col("skip_reason").isNotNull()).alias("rerank_skipped"), F.max_by("skip_reason", F.when(F.col("skip_reason").isNotNull(), F.col("ts"))).alias("last_skip_reason"), (F.count_if(F.col("reranked") & F.col("top_changed")) > 0).alias("rerank_effective"),
    ]


def bucket(relevance: Column) -> Column:
    return F.least(F.lit(4), F.floor(relevance * 5).cast("int"))


def relevance_histogram(samples: DataFrame) -> DataFrame:
    """TEL4: bucket 0..4 and its count."""
    return samples.select(F.explode("relevance").alias("r")).groupBy(bucket(F.col("r")).alias("bucket")).agg(F.count("*").alias("n"))


def latest(samples: DataFrame, most: int = 100, by: tuple[str, ...] = ()) -> DataFrame:
    """TEL5: the latest samples, of all or of each key."""
    if not by:
        return samples.orderBy(F.desc("ts")).limit(most)
    return samples.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("ts")))).where(F.col("_n") <= most).drop("_n")


def numbered_trace(nodes: DataFrame) -> DataFrame:
    """TRC1: nodes with seq within their run. nodes: run_id, ts, name, duration_ms."""
    return nodes.withColumn("seq", F.row_number().over(Window.partitionBy("run_id").orderBy("ts", "name")))


def latency_breakdown(nodes: DataFrame) -> DataFrame:
    """TRC1: run_id and a map of stage to time."""
    each = nodes.groupBy("run_id", "name").agg(F.sum("duration_ms").alias("ms"))
    return each.groupBy("run_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "ms")))).alias("breakdown"), F.sum("ms").alias("latency_ms"))


@dataclass(frozen=True)
class Limits:
    max_tokens: int = 16_000
    max_steps: int = 24
    max_cost_usd: float = 0.5
    per_1k_prompt: float = 0.0
    per_1k_completion: float = 0.0


def estimate_tokens(question: Column, top_k: int, max_new_tokens: int, chunk_chars: int = 600) -> Column:
    """BUD1: an upper bound."""
    return count_tokens(question) + top_k * chunk_chars + max_new_tokens


def price(prompt: Column, completion: Column, limits: Limits) -> Column:
    return F.round(prompt / 1000 * limits.per_1k_prompt + completion / 1000 * limits.per_1k_completion, 8)


def preflight(requests: DataFrame, limits: Limits = Limits(), top_k: int = 5, max_new_tokens: int = 512) -> DataFrame:
    """BUD1: requests with their estimate, its price, and which limit it exceeds."""
    rows = requests.withColumn("est_tokens", estimate_tokens(F.col("question"), top_k, max_new_tokens)).withColumn("est_cost", price(F.col("est_tokens"), F.lit(max_new_tokens), limits))
    return rows.withColumn("exceeded", F.when(F.col("est_tokens") > limits.max_tokens, "tokens").when(F.col("est_cost") > limits.max_cost_usd, "cost_usd"))


def ledger(calls: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """BUD2: running steps, tokens and cost of each run, and the limit exceeded at each step. calls: run_id, seq, prompt_tokens, completion_tokens."""
    w = Window.partitionBy("run_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    cost = F.round(F.sum(price(F.col("prompt_tokens"), F.col("completion_tokens"), limits)).over(w), 8)
    rows = calls.withColumn("steps", F.count("*").over(w)).withColumn("tokens", F.sum(F.col("prompt_tokens") + F.col("completion_tokens")).over(w)).withColumn("cost_usd", cost)
    return rows.withColumn("exceeded", F.when(F.col("tokens") > limits.max_tokens, "tokens").when(F.col("steps") > limits.max_steps, "steps").when(F.col("cost_usd") > limits.max_cost_usd, "cost_usd"))


def first_exceeded(rows: DataFrame) -> DataFrame:
    """BUD2: run_id, seq and limit where a run stops."""
    return rows.where(F.col("exceeded").isNotNull()).groupBy("run_id").agg(F.min(F.struct("seq", "exceeded", "tokens", "steps")).alias("s")).select("run_id", "s.*")


def no_progress(steps: DataFrame) -> DataFrame:
    """NPR1: steps with the reason to stop, if any. steps: run_id, seq, action, observation, ok."""
    w = Window.partitionBy("run_id").orderBy("seq")
    recent = F.collect_list("observation").over(w.rowsBetween(-3, -1))
    same = (F.col("action") != "") & (F.col("action") == F.lag("action").over(w))
    seen = (F.col("observation") != "") & F.array_contains(recent, F.col("observation"))
    failed = ~F.col("ok") & ~F.lag("ok").over(w)
    return steps.withColumn("reason", F.when(same, "repeated_action").when(seen, "repeated_observation").when(failed, "two_failures"))


def merge_answers(local: DataFrame, cloud: DataFrame) -> DataFrame:
    """MRG1: question_id, local_text, cloud_text, full_text; a divider warns where the cloud's part begins."""
    rows = local.select("question_id", strip_think("text").alias("local_text")).join(cloud.select("question_id", strip_think("text").alias("cloud_text")), "question_id", "full")
    a, b = F.coalesce("local_text", F.lit("")), F.coalesce("cloud_text", F.lit(""))
    return rows.select("question_id", a.alias("local_text"), b.alias("cloud_text"), F.when((a != "") & (b != ""), F.concat(a, F.lit(DIVIDER), b)).when(b != "", b).otherwise(a).alias("full_text"))
