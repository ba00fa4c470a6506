"""CAL1-CAL4, SGN1-SGN2, SWP1: thresholds and parameters over labelled samples.

Samples have id, supported, semantic (may be null), lexical, fabricated. Grids are small and are the broadcast side;
their product with the samples is summed at once and never stored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.operators.fusion import Options, fuse, mmr, with_overrides
from corpusloom.functions.text import tokens
from corpusloom.operators import legs
from corpusloom.operators.ranks import places
from corpusloom.operators.verify import Thresholds, coverage, unknown_numbers


def sample_score(sem_weight: Column, weak: Column, sure: float = Thresholds.sure_semantic) -> Column:
    base = F.when(F.col("semantic").isNull(), F.col("lexical")).otherwise(F.col("semantic") * sem_weight + F.col("lexical") * (1 - sem_weight))
    return F.when(F.col("fabricated") & (F.col("semantic").isNull() | (F.col("semantic") < sure)), F.least(base, weak - 0.01)).otherwise(base)


def build_samples(labels: DataFrame, contexts: DataFrame, semantic: DataFrame | None = None) -> DataFrame:
    """CAL4: labelled sentences with the scores that verification gives them against their document's joined chunks.

    labels: id, doc_id, sentence, supported, fabricated (may be null); contexts: doc_id, context; semantic: id, semantic
    (missing ones are null). A number that the context lacks makes a sentence fabricated, whatever its label says.
    """
    known = contexts.select("doc_id", "context", F.array_distinct(tokens("context")).alias("_ct"))
    rows = labels.join(known, "doc_id")
    rows = rows.join(semantic.select("id", "semantic"), "id", "left") if semantic is not None else rows.withColumn("semantic", F.lit(None).cast("double"))
    auto = F.size(unknown_numbers(F.col("sentence"), F.col("context"))) > 0
    return rows.select("id", "supported", "semantic", coverage(tokens("sentence"), F.col("_ct")).alias("lexical"), (F.coalesce("fabricated", F.lit(False)) | auto).alias("fabricated"))


def measures(predicted: Column, actual: Column) -> list[Column]:
    tp, fp, fn = F.count_if(predicted & actual), F.count_if(predicted & ~actual), F.count_if(~predicted & actual)
    precision, recall = F.when(tp + fp == 0, 0.0).otherwise(tp / (tp + fp)), F.when(tp + fn == 0, 0.0).otherwise(tp / (tp + fn))
    return [tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), precision.alias("precision"), recall.alias("recall"), F.when(tp == 0, 0.0).otherwise(2 * precision * recall / (precision + recall)).alias("f1")]


def confusion(samples: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """CAL1: a sample is taken as supported at or above the threshold."""
    return samples.agg(*measures(sample_score(F.lit(t.sem_weight), F.lit(t.weak)) >= t.supported, F.col("supported")))


def grid(spark: SparkSession, supported: list[float], weak: list[float], weights: list[float]) -> DataFrame:
    return spark.createDataFrame([(float(s), float(w), float(m)) for s in supported for w in weak for m in weights], "t_supported double, t_weak double, t_weight double")


def sweep(samples: DataFrame, combos: DataFrame) -> DataFrame:
    """CAL2: measures at each grid row."""
    pairs = samples.crossJoin(F.broadcast(combos))
    return pairs.groupBy("t_supported", "t_weak", "t_weight").agg(*measures(sample_score(F.col("t_weight"), F.col("t_weak")) >= F.col("t_supported"), F.col("supported")))


def best(swept: DataFrame) -> DataFrame:
    """CAL2: the greatest F1, among equals the highest supported threshold."""
    return swept.orderBy(F.desc("f1"), F.desc("t_supported"), "t_weak", "t_weight").limit(1)


def folds(samples: DataFrame, k: int) -> DataFrame:
    """CAL3: dealt in turn within each class."""
    return places(samples, ["supported"], "id", descending=False).withColumn("fold", (F.col("_row") - 1) % k).drop("_row", "_rank", "_n")


def sweep_cv(samples: DataFrame, combos: DataFrame, k: int = 5) -> DataFrame:
    """CAL3: mean and standard deviation of the F1 over folds."""
    pairs = folds(samples, k).crossJoin(F.broadcast(combos))
    by = ["t_supported", "t_weak", "t_weight"]
    each = pairs.groupBy(*by, "fold").agg(*measures(sample_score(F.col("t_weight"), F.col("t_weak")) >= F.col("t_supported"), F.col("supported")))
    return each.groupBy(*by).agg(F.avg("f1").alias("macro_f1"), F.stddev_pop("f1").alias("std_f1"))


def signal_sweep(values: DataFrame, steps: int = 401) -> DataFrame:
    """SGN1: for each signal, `steps` thresholds from its least to its greatest value; below one, a query is refused. values: signal, query_id, negative, value."""
    span = values.groupBy("signal").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    points = span.select("signal", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step"), "lo", "hi").withColumn("threshold", F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("step") / (steps - 1)).drop("lo", "hi")
    return values.join(points, "signal").groupBy("signal", "step", "threshold").agg(*measures(F.col("value") < F.col("threshold"), F.col("negative")))


def best_signals(swept: DataFrame) -> DataFrame:
    """SGN1: of each signal the safest threshold (most refusals without a false one) and the one of best F1."""
    safe = F.max(F.when(F.col("fp") == 0, F.struct("tp", -F.col("step"), "threshold")))
    top = F.max(F.struct("f1", -F.col("step"), "threshold"))
    return swept.groupBy("signal").agg(safe.alias("s"), top.alias("b")).select("signal", F.col("s.threshold").alias("safe_threshold"), F.col("s.tp").alias("safe_refusals"), F.col("b.threshold").alias("best_threshold"), F.col("b.f1").alias("best_f1"))


def signal_fusion(values: DataFrame) -> DataFrame:
    """SGN2: a query is refused where any signal lies below the least value of a positive."""
    least = values.where(~F.col("negative")).groupBy("signal").agg(F.min("value").alias("cut"))
    judged = values.join(least, "signal").groupBy("query_id", "negative").agg(F.bool_or(F.col("value") < F.col("cut")).alias("refused"))
    return judged.agg(F.count_if(F.col("negative") & F.col("refused")).alias("refusals"), F.count_if(~F.col("negative") & F.col("refused")).alias("false_refusals"), F.count_if("negative").alias("negatives")).withColumn("usable", (F.col("false_refusals") == 0) & (F.col("refusals") > 0))


#: Options that fusion_sweep reads.
SWEPT = {"vec_weight", "bm25_weight", "rrf_k"}


def option_grid(base: Options, **choices: list) -> list[tuple[str, Options]]:
    """SWP1: named options, one for each combination. Only what fusion_sweep reads may vary; others are refused."""
    if other := set(choices) - SWEPT:
        raise ValueError(f"a fusion sweep does not read {', '.join(sorted(other))}")
    out = [("", base)]
    for name, values in choices.items():
        out = [(f"{label}{',' if label else ''}{name}={v}", with_overrides(o, **{name: v})) for label, o in out for v in values]
    return out


def fusion_sweep(vec: DataFrame, bm25: DataFrame, configs: list[tuple[str, Options]], top: int = 10) -> DataFrame:
    """SWP1: config_id, query_id, chunk_id, place: ranks are made once, weights and k fan out after them. Of legs in operators.legs, take leg_sweep()."""
    one = fuse(vec, bm25)
    table = F.array(*[F.struct(F.lit(n).alias("config_id"), F.lit(float(o.vec_weight)).alias("v"), F.lit(float(o.bm25_weight)).alias("w"), F.lit(o.rrf_k).alias("k")) for n, o in configs])
    rows = one.withColumn("c", F.explode(table)).withColumn("score", F.coalesce(F.col("c.v") / (F.col("c.k") + F.col("vec_rank")), F.lit(0.0)) + F.when(F.col("bm25_rank") > 0, F.col("c.w") / (F.col("c.k") + F.col("bm25_rank"))).otherwise(0.0))
    place = F.row_number().over(Window.partitionBy("c.config_id", "query_id").orderBy(F.desc("score"), "chunk_id"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("c.config_id", "query_id", "chunk_id", "place")


def leg_sweep(found: legs.Legs, configs: list[tuple[str, Options]], top: int = 10) -> DataFrame:
    """fusion_sweep() where each task hands on its best rows of each setting."""
    rows = legs.fused(found, [(float(o.vec_weight), float(o.bm25_weight), o.rrf_k) for _, o in configs], None, top)
    place = F.row_number().over(Window.partitionBy("config", "query_id").orderBy(F.desc("rrf"), "chunk_id"))
    names = F.array(*[F.lit(n) for n, _ in configs])
    return rows.withColumn("place", place).where(F.col("place") <= top).select(F.get(names, "config").alias("config_id"), "query_id", "chunk_id", "place")


def admission_sweep(pool: DataFrame, refused: DataFrame, min_vecs: list[float], ratio: float = Options.relative_cut_ratio) -> DataFrame:
    """SWP1: the pool's rows that each least cosine admits, with min_vec and rank: one pass over the at most 20 rows a query.

    pool: query_id, pos, cosine, rrf and what is to be kept; refused: query_id of queries that the coarse gate refuses.
    """
    rows = pool.join(refused.select("query_id"), "query_id", "left_anti").withColumn("min_vec", F.explode(F.array(*[F.lit(float(v)) for v in min_vecs])))
    own = Window.partitionBy("min_vec", "query_id")
    kept = rows.where(F.coalesce("cosine", F.lit(0.0)) >= F.col("min_vec")).withColumn("_best", F.max("rrf").over(own)).where(F.col("rrf") >= F.col("_best") * ratio).drop("_best")
    return kept.withColumn("rank", F.row_number().over(own.orderBy("pos")))


def selection_sweep(hits: DataFrame, vectors: DataFrame, lams: list[float], limit: int = 10) -> DataFrame:
    """SWP1: the picks of each weight of relevance against likeness, with lam and rank. hits: gate() rows."""
    out = None
    for lam in lams:
        own = mmr(hits, limit, lam, vectors).withColumn("lam", F.lit(float(lam))).withColumnRenamed("pick", "rank").drop("vector")
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
