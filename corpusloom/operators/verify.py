"""VER1-VER15: answers, sentence by sentence, against what they cite."""

from __future__ import annotations

import warnings

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import BLANKS, MARK, cited_sentences, tokens
from corpusloom.operators.shared import staged

# Units of number facts, refusal phrases.
UNITS = "%|％|元|块|天|小时|分钟|个|折|倍|年|月|周|页|万|亿"
REFUSALS = ("没有找到", "未找到", "找不到", "无法回答", "未能找到", "不含相关", "没有相关")
NUMBER = rf"[0-9]+(?:\.[0-9]+)?[{BLANKS}]*(?:{UNITS})?"
CORE = r"[0-9]+(?:\.[0-9]+)?"


@dataclass(frozen=True)
class Thresholds:
    supported: float = 0.55
    weak: float = 0.38
    sem_weight: float = 0.75
    lex_weight: float = 0.25
    sure_semantic: float = 0.6
    claim_chars: int = 4
    refusal_chars: int = 80


def all_citations(s: Column) -> Column:
    """VER1: distinct numbers of marks, ascending, [0] included."""
    inner = F.transform(F.regexp_extract_all(s, F.lit(MARK), F.lit(0)), lambda m: F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)))
    return F.array_sort(F.array_distinct(F.transform(F.flatten(inner), lambda n: n.cast("int"))))


def citations(s: Column) -> Column:
    return F.filter(all_citations(s), lambda n: n > 0)


def invalid_citations(found: Column, passages: Column) -> Column:
    """VER2: numbers that no passage has; without passages every positive number."""
    return F.when(F.size(passages) == 0, F.filter(found, lambda n: n > 0)).otherwise(F.filter(found, lambda n: (n <= 0) | ~F.array_contains(passages, n)))


def is_claim(s: Column, least: int = Thresholds.claim_chars) -> Column:
    """VER3."""
    return F.length(F.regexp_replace(s, r"[\s\p{P}\p{S}]", "")) >= least


def numbers(s: Column) -> Column:
    """VER4: number facts with units, without inner blanks."""
    return F.transform(F.regexp_extract_all(s, F.lit(NUMBER), F.lit(0)), lambda n: F.regexp_replace(n, f"[{BLANKS}]+", ""))


def core(n: Column) -> Column:
    return F.regexp_extract(n, f"^{CORE}", 0)


def number_runs(context: Column) -> Column:
    """Maximal digit runs of a text: what a number between digit boundaries can start and end with."""
    return F.regexp_extract_all(context, F.lit("[0-9]+"), F.lit(0))


def unknown_numbers(s: Column, context: Column) -> Column:
    """VER5: facts of a sentence, marks apart, that are no fact of the context and whose core isn't in it between digit boundaries."""
    facts = F.array_except(numbers(F.regexp_replace(s, MARK, "")), numbers(context))
    padded = F.concat(F.lit(" "), context, F.lit(" "))
    return F.filter(facts, lambda n: ~F.rlike(padded, F.concat(F.lit("[^0-9]"), F.regexp_replace(core(n), r"\.", "[.]"), F.lit("[^0-9]"))))


def coverage(sentence_tokens: Column, context_tokens: Column) -> Column:
    """VER6: share of distinct tokens that the context has; 1 without tokens."""
    own = F.array_distinct(sentence_tokens)
    return F.when(F.size(own) == 0, F.lit(1.0)).otherwise(F.size(F.array_intersect(own, context_tokens)) / F.size(own))


def sentence_score(t: Thresholds = Thresholds()) -> Column:
    """VER8, from semantic (null: lexical only), lexical, fabricated, dangling, uncited."""
    base = F.when(F.col("semantic").isNull(), F.col("lexical")).otherwise(F.col("semantic") * t.sem_weight + F.col("lexical") * t.lex_weight)
    hard = F.col("fabricated") & (F.col("semantic").isNull() | (F.col("semantic") < t.sure_semantic))
    capped = F.when(hard, F.least(base, F.lit(t.weak - 0.01))).otherwise(base)
    return F.when(F.col("dangling") | F.col("uncited"), F.least(capped, F.lit(t.weak))).otherwise(capped)


def level(score: Column, t: Thresholds = Thresholds()) -> Column:
    return F.when(score >= t.supported, "supported").when(score >= t.weak, "weak").otherwise("unsupported")


def is_refusal(answer: Column, t: Thresholds = Thresholds()) -> Column:
    """VER10."""
    return (F.length(F.regexp_replace(answer, f"[{BLANKS}]+", "")) <= t.refusal_chars) & answer.rlike("|".join(REFUSALS))


def verify_sentences(answers: DataFrame, semantic: DataFrame | None = None, require_citation: bool = True, t: Thresholds = Thresholds()) -> DataFrame:
    """Sentence rows. answers: answer_id, answer, context, passages (array of int). semantic: answer_id, sentence_no, semantic."""
    told = answers.withColumn("refusal", is_refusal(F.col("answer"), t)).withColumn("_ct", F.array_distinct(tokens("context")))
    rows = told.select("answer_id", "context", "passages", "refusal", "_ct", F.posexplode(cited_sentences("answer")).alias("sentence_no", "sentence"))
    rows = rows.join(semantic, ["answer_id", "sentence_no"], "left") if semantic is not None else rows.withColumn("semantic", F.lit(None).cast("double"))
    s = F.col("sentence")
    rows = (
        rows.withColumn("trivial", F.col("refusal") | ~is_claim(s, t.claim_chars))
        .withColumn("citations", citations(s))
        .withColumn("invalid", invalid_citations(all_citations(s), F.col("passages")))
        .withColumn("unknown", unknown_numbers(s, F.col("context")))
        .withColumn("lexical", coverage(tokens(s), F.col("_ct")))
        .withColumn("fabricated", F.size("unknown") > 0)
        .withColumn("dangling", F.size("invalid") > 0)
        .withColumn("uncited", (F.lit(require_citation) & (F.size("passages") > 0) & (F.size("citations") == 0)) & ~F.col("trivial"))
    )
    scored = rows.withColumn("score", F.when(F.col("trivial"), 1.0).otherwise(sentence_score(t)))
    return scored.withColumn("level", F.when(F.col("trivial"), "supported").otherwise(level(F.col("score"), t))).drop("context", "passages", "_ct")


def scope_of(sentence_rows: DataFrame, passage_chunks: DataFrame) -> DataFrame:
    """VER7: answer_id, sentence_no, chunk_id: the chunks of valid citations, of all passages where there are none. passage_chunks: answer_id, index, chunk_id."""
    pairs = sentence_rows.select("answer_id", "sentence_no", "citations").join(passage_chunks, "answer_id")
    cited = pairs.where(F.array_contains("citations", F.col("index"))).select("answer_id", "sentence_no", "chunk_id")
    rest = pairs.join(cited.select("answer_id", "sentence_no").distinct(), ["answer_id", "sentence_no"], "left_anti").select("answer_id", "sentence_no", "chunk_id")
    return cited.unionByName(rest).distinct()


def verdicts(rows: DataFrame) -> DataFrame:
    """VER9, VER11, VER12: one row an answer."""
    claim = ~F.col("trivial")
    n, bad, weak = F.count_if(claim), F.count_if(claim & (F.col("level") == "unsupported")), F.count_if(claim & (F.col("level") == "weak"))
    out = rows.groupBy("answer_id").agg(
        F.bool_or("refusal").alias("refusal"), n.alias("claims"), bad.alias("unsupported"), weak.alias("weak"), F.count_if(claim & F.col("uncited")).alias("uncited_claims"), F.count_if(claim & F.col("dangling")).alias("out_of_range_claims"),
        F.count_if(claim & F.col("fabricated")).alias("fabricated_claims"), F.when(F.count_if(F.col("semantic").isNotNull()) > 0, "semantic").otherwise("lexical").alias("source"),
    )
    verdict = F.when(F.col("refusal"), "refused").when(F.col("claims") == 0, "supported").when(F.col("unsupported") == F.col("claims"), "unsupported").when(F.col("unsupported") + F.col("weak") > 0, "partial").otherwise("supported")
    out = out.withColumn("verdict", verdict).withColumn("cited_within_passages", F.col("out_of_range_claims") == 0)
    return out.withColumn("should_refuse", F.col("verdict").isin("refused", "unsupported") | ((F.col("source") == "lexical") & (F.col("verdict") != "supported")))


def retry_decision() -> Column:
    """VER13, over verdicts(): the first reason that holds, or null."""
    return F.when(F.col("refusal"), F.lit(None).cast("string")).when(F.col("fabricated_claims") > 0, "fabricated_number").when(F.col("out_of_range_claims") > 0, "dangling_citation").when(F.col("unsupported") + F.col("weak") > 0, "weak_evidence")


def keep_first_if_empty(first: DataFrame, second: DataFrame, flagged: DataFrame) -> DataFrame:
    """VER14: the wider retrieval's rows for flagged queries where it found any, else the first's."""
    better = second.join(flagged.select("query_id").distinct(), "query_id", "left_semi")
    return first.join(better.select("query_id").distinct(), "query_id", "left_anti").unionByName(better)


def retry_wider(first: DataFrame, queries: DataFrame, flagged: DataFrame, retrieve) -> DataFrame:
    """VER14: retrieve (queries to rows, with wider options) is run again for the flagged queries; where it finds nothing the first rows stay."""
    return keep_first_if_empty(first, retrieve(queries.join(flagged.select("query_id").distinct(), "query_id", "left_semi")), flagged)


def with_scorer(sentences: DataFrame, scope: DataFrame, scorer) -> DataFrame | None:
    """UDF1: answer_id, sentence_no, semantic by a callback (sentences, scope) -> DataFrame; without one, or where a row gets none, verification is lexical.

    The scores are computed here: a scorer that fails, on the driver or in a task, is reported and leaves verification lexical (None).
    """
    if scorer is None:
        return None
    try:
        scores = staged(scorer(sentences, scope).select("answer_id", "sentence_no", "semantic"), "semantic-scores")
    except Exception as e:
        warnings.warn(f"the semantic scorer failed, verification is lexical: {str(e).splitlines()[0] if str(e) else type(e).__name__}", stacklevel=2)
        return None
    return sentences.select("answer_id", "sentence_no").join(scores, ["answer_id", "sentence_no"], "left")


def refusal_outcome(answers: DataFrame, judged: DataFrame, gate_report: DataFrame) -> DataFrame:
    """VER15: answer_id, refused, reason. answers: answer_id, query_id, answer; gate_report: query_id, no_relevant_hit."""
    rows = answers.join(gate_report.select("query_id", "no_relevant_hit"), "query_id", "left").join(judged.select("answer_id", "verdict", "should_refuse"), "answer_id", "left")
    reason = F.when(F.col("no_relevant_hit"), "no_relevant_hit").when(F.coalesce(F.trim("answer"), F.lit("")) == "", "empty_answer").when(F.col("should_refuse"), F.concat(F.lit("verdict_"), "verdict"))
    return rows.select("answer_id", reason.isNotNull().alias("refused"), reason.alias("reason"))
