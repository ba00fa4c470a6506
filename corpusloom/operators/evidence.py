"""EXP1-EXP2 and EVI1-EVI8: query variants in, numbered evidence out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import BLANKS

# Fixed values.
MAX_EXPANSION_CHARS, MAX_EXPANSIONS, EXPANSION_WEIGHT = 40, 3, 0.7
NO_HEADING, NO_NAME, NO_EVIDENCE = "正文", "未命名文档", "文档中没有找到相关内容。"
PUNCTUATION = r"[。！？!?；;，,、：:\"'（）()【】\[\]\-—…·]"
LIST_MARK = r"^(?:[0-9]+[.、)]|[-*•·]|[①②③④⑤])\s*"
QUOTES = "“”\"'‘’《》"
EXPLANATION = r"(?:——|（注|\(注|：这|,这)(?s:.*)$"


def normal_form(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(c, r"\s+", ""), PUNCTUATION, ""))


def parse_rewrites(raw: DataFrame) -> DataFrame:
    """EXP1: query_id, variant_no (from 1), text. raw: query_id, question, raw (a rewrite a line)."""
    blank = f"^[{BLANKS}]+|[{BLANKS}]+$"
    line = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col("line"), blank, ""), LIST_MARK, ""), blank, "")
    bare = F.regexp_replace(F.regexp_replace(line, f"^[{QUOTES}]+|[{QUOTES}]+$", ""), blank, "")
    rows = raw.select("query_id", normal_form(F.col("question")).alias("own"), F.posexplode(F.split("raw", "\r?\n")).alias("n", "line")).withColumn("whole", bare).where((F.col("whole") != "") & (F.length("whole") <= MAX_EXPANSION_CHARS))
    cut = rows.withColumn("text", F.regexp_replace(F.regexp_replace("whole", EXPLANATION, ""), blank, "")).withColumn("key", normal_form(F.col("text")))
    new = cut.where((F.col("text") != "") & (F.length("key") >= 2) & (F.col("key") != F.col("own")))
    first = new.withColumn("_n", F.row_number().over(Window.partitionBy("query_id", "key").orderBy("n"))).where("_n = 1")
    return first.withColumn("variant_no", F.row_number().over(Window.partitionBy("query_id").orderBy("n"))).where(F.col("variant_no") <= MAX_EXPANSIONS).select("query_id", "variant_no", "text")


def variants(queries: DataFrame, rewrites: DataFrame, weight: float = EXPANSION_WEIGHT) -> DataFrame:
    """EXP2: query_id, variant_no, text, weight; the question itself is variant 0."""
    own = queries.select("query_id", F.lit(0).alias("variant_no"), "text", F.lit(1.0).alias("weight"))
    return own.unionByName(rewrites.select("query_id", "variant_no", "text", F.lit(weight).alias("weight")))


def heading_label(path: Column) -> Column:
    """EVI1."""
    named = F.filter(path, lambda h: h.isNotNull() & (h != ""))
    return F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit(NO_HEADING))


def page_label(start: Column, end: Column) -> Column:
    return F.when(start == end, F.concat(F.lit("P"), start)).otherwise(F.concat(F.lit("P"), start, F.lit("-"), end))


def citation_label(name: Column, path: Column, start: Column, end: Column) -> Column:
    return F.concat_ws(" · ", F.coalesce(F.when(name != "", name), F.lit(NO_NAME)), heading_label(path), page_label(start, end))


def evidence(hits: DataFrame, order: list) -> DataFrame:
    """EVI2: hits numbered from 1 within their query, with labels."""
    return hits.withColumn("index", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).withColumn("label", citation_label(F.col("doc_name"), F.col("heading_path"), F.col("page_start"), F.col("page_end")))


def scopes(contexts: DataFrame) -> DataFrame:
    """EVI3: query_id, index, chunk_id of what an answer may rest on."""
    ids = F.when(F.size("window_chunk_ids") > 0, F.col("window_chunk_ids")).otherwise(F.col("chunk_ids"))
    return contexts.select("query_id", "index", F.explode(ids).alias("chunk_id"))


def prompt_context(passages: DataFrame) -> DataFrame:
    """EVI4: query_id and the numbered passages as one text. passages: query_id, index, label, text."""
    one = F.struct("index", F.concat(F.lit("["), "index", F.lit("] "), "label", F.lit("\n"), "text").alias("t"))
    return passages.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["t"]), "\n\n").alias("context"))


def prompt(questions: DataFrame, context: DataFrame, history: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """EVI4: query_id, prompt; the parts in order: system text, context, summary, history turns, question."""
    rows = questions.join(context, "query_id", "left")
    if history is not None:
        turn = F.struct("turn", F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "content", F.lit("<|im_end|>")).alias("t"))
        rows = rows.join(history.groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda x: x["t"]), "\n").alias("_h")), "query_id", "left")
    else:
        rows = rows.withColumn("_h", F.lit(None).cast("string"))
    rows = rows.join(summaries.select("query_id", F.col("summary").alias("_s")), "query_id", "left") if summaries is not None else rows.withColumn("_s", F.lit(None).cast("string"))
    summary = F.coalesce(F.concat(F.lit("\n\n"), F.when(F.col("_s") != "", F.col("_s"))), F.lit(""))
    text = F.concat(F.lit("<|im_start|>system\n"), F.coalesce("context", F.lit(NO_EVIDENCE)), summary, F.lit("\n<|im_end|>\n"), F.coalesce(F.concat("_h", F.lit("\n")), F.lit("")), F.lit("<|im_start|>user\n"), F.col("question"), F.lit("<|im_end|>\n<|im_start|>assistant\n"))
    return rows.select("query_id", text.alias("prompt"))


def merge_evidence(parts: DataFrame) -> DataFrame:
    """EVI5: parts of several searches (run_id, search_no, index) numbered through."""
    return parts.withColumn("merged_index", F.row_number().over(Window.partitionBy("run_id").orderBy("search_no", "index")))


def collect_hits(hits: DataFrame, most: int = 12) -> DataFrame:
    """EVI6: the first of equal contents, in order of discovery, at most `most` a run. hits: run_id, seq, content."""
    first = hits.withColumn("_n", F.row_number().over(Window.partitionBy("run_id", F.xxhash64("content"), "content").orderBy("seq"))).where("_n = 1").drop("_n")
    return first.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("seq"))).where(F.col("place") <= most)


def extractive_answer(queries: DataFrame, passages: DataFrame, most: int = 5, chars: int = 500) -> DataFrame:
    """EVI7: `[n] quote` lines, or a fixed text where nothing was found."""
    line = F.struct("index", F.concat(F.lit("["), "index", F.lit("] "), F.substring("text", 1, chars)).alias("t"))
    made = passages.where(F.col("index") <= most).groupBy("query_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(line)), lambda x: x["t"]), "\n").alias("_a"))
    return queries.select("query_id").join(made, "query_id", "left").select("query_id", F.coalesce("_a", F.lit(NO_EVIDENCE)).alias("answer"))


def snapshot(contexts: DataFrame, config: dict, version: str) -> DataFrame:
    """EVI8: query_id and a JSON text of passages, configuration and version, to be kept with the answer."""
    passages = F.sort_array(F.collect_list(F.struct("index", "label", "chunk_ids", "content")))
    settings = F.struct(*[F.lit(v).alias(k) for k, v in sorted(config.items())])
    return contexts.groupBy("query_id").agg(passages.alias("passages")).select("query_id", F.to_json(F.struct("passages", settings.alias("config"), F.lit(version).alias("index_version"))).alias("snapshot"))
