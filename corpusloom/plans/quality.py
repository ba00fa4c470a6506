"""Queries over answers, evaluation, calibration, safety, history and telemetry, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import calibrate, evaluate, history, safety, telemetry, verify
from corpusloom.plans import demo, search
from corpusloom.plans.search import SQL_CORPUS, SQL_FIRST_LINES, SQL_VECTORS, sql_bm25, sql_tokens, sql_trim

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


SQL_ANSWERS = "answers AS (SELECT conv_id * 1000 + turn AS answer_id, conv_id, turn, text AS answer, context FROM (SELECT *, coalesce(lag(text) OVER (PARTITION BY conv_id ORDER BY turn), '') AS context FROM conversations) WHERE role = 'assistant')"
SQL_NUMBER = verify.NUMBER.replace("'", "''")
SQL_UNKNOWN = f"list_filter(list_distinct(list_transform(regexp_extract_all(regexp_replace(s, '{X.MARK}', '', 'g'), '{SQL_NUMBER}'), lambda n: regexp_replace(n, '[{X.BLANKS}]+', '', 'g'))), lambda n: NOT list_contains(list_transform(regexp_extract_all(context, '{SQL_NUMBER}'), lambda n: regexp_replace(n, '[{X.BLANKS}]+', '', 'g')), n) AND NOT regexp_matches(' ' || context || ' ', '[^0-9]' || replace(regexp_extract(n, '^{verify.CORE}'), '.', '[.]') || '[^0-9]'))"
# sentences without a mark are those of the plain split; the given conversations hold no mark
SQL_SENTENCES = f"""{SQL_ANSWERS}, parts AS (SELECT answer_id, answer, context, list_filter(regexp_extract_all(answer, '{X.SENTENCE}'), lambda s: s <> '') AS p FROM answers),
sentences AS (SELECT answer_id, answer, context, i - 1 AS sentence_no, p[i] AS s FROM parts, unnest(range(1, len(p) + 1)) t(i)),
judged AS (
  SELECT answer_id, sentence_no, s, length(regexp_replace(s, '[\\s\\p{{P}}\\p{{S}}]', '', 'g')) < 4 AS trivial, {SQL_UNKNOWN} AS unknown,
         list_distinct({sql_tokens('s')}) AS own, list_distinct({sql_tokens('context')}) AS ctx FROM sentences),
scored AS (SELECT *, CASE WHEN len(own) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(own, ctx))::DOUBLE / len(own) END AS lexical FROM judged),
leveled AS (SELECT *, CASE WHEN trivial THEN 1.0::DOUBLE ELSE least(CASE WHEN len(unknown) > 0 THEN least(lexical, 0.37::DOUBLE) ELSE lexical END, 0.38::DOUBLE) END AS score FROM scored),
levels AS (SELECT *, CASE WHEN trivial OR score >= 0.55 THEN 'supported' WHEN score >= 0.38 THEN 'weak' ELSE 'unsupported' END AS level FROM leveled)"""


def checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verify_sentences(demo.answers(spark, sf_dir))


@query(f"WITH {SQL_SENTENCES} SELECT answer_id, sentence_no::INTEGER AS sentence_no, trivial, len(unknown)::INTEGER AS unknown_numbers, round(lexical, 6) AS lexical, round(score, 6) AS score, level FROM levels")
def sentence_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER1-VER8, lexical mode; every answer may cite passages 1 and 2."""
    return checked(spark, sf_dir).select("answer_id", "sentence_no", "trivial", F.size("unknown").alias("unknown_numbers"), F.round("lexical", 6).alias("lexical"), F.round("score", 6).alias("score"), "level")


SQL_VERDICTS = f"""{SQL_SENTENCES}, summed AS (SELECT answer_id, count(*) FILTER (NOT trivial) AS claims, count(*) FILTER (NOT trivial AND level = 'unsupported') AS unsupported, count(*) FILTER (NOT trivial AND level = 'weak') AS weak, count(*) FILTER (NOT trivial AND len(unknown) > 0) AS fabricated_claims FROM levels GROUP BY answer_id),
verdicts AS (SELECT *, CASE WHEN claims = 0 THEN 'supported' WHEN unsupported = claims THEN 'unsupported' WHEN unsupported + weak > 0 THEN 'partial' ELSE 'supported' END AS verdict FROM summed)"""


@query(f"WITH {SQL_VERDICTS} SELECT answer_id, claims, unsupported, weak, fabricated_claims, claims AS uncited_claims, 0::BIGINT AS out_of_range_claims, verdict, verdict <> 'supported' AS should_refuse FROM verdicts")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.verdicts(checked(spark, sf_dir)).select("answer_id", "claims", "unsupported", "weak", "fabricated_claims", "uncited_claims", "out_of_range_claims", "verdict", "should_refuse")


@query(f"WITH {SQL_VERDICTS} SELECT coalesce(CASE WHEN fabricated_claims > 0 THEN 'fabricated_number' WHEN unsupported + weak > 0 THEN 'weak_evidence' END, 'none') AS reason, count(*) AS answers FROM verdicts GROUP BY 1")
def retry_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER13."""
    return verify.verdicts(checked(spark, sf_dir)).groupBy(F.coalesce(verify.retry_decision(), F.lit("none")).alias("reason")).agg(F.count("*").alias("answers"))


@query(f"WITH {SQL_VERDICTS} SELECT a.answer_id, a.conv_id % 5 = 0 OR verdict <> 'supported' AS refused, CASE WHEN a.conv_id % 5 = 0 THEN 'no_relevant_hit' WHEN verdict <> 'supported' THEN 'verdict_' || verdict END AS reason FROM answers a JOIN verdicts USING (answer_id)")
def refusal_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER15: conversations in five are refused by retrieval."""
    a = demo.answers(spark, sf_dir)
    gate = a.select(F.col("conv_id").alias("query_id"), (F.col("conv_id") % 5 == 0).alias("no_relevant_hit")).distinct()
    return verify.refusal_outcome(a.withColumnRenamed("conv_id", "query_id"), verify.verdicts(checked(spark, sf_dir)), gate)


@query(rf"SELECT doc_id, len(regexp_extract_all(text, '{SQL_NUMBER}'))::INTEGER AS facts, len(list_distinct(regexp_extract_all(text, '{X.MARK}')))::INTEGER AS marks FROM documents")
def number_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER1, VER4."""
    return demo.table(spark, sf_dir, "documents").select("doc_id", F.size(verify.numbers(F.col("text"))).alias("facts"), F.size(F.array_distinct(F.regexp_extract_all("text", F.lit(X.MARK), F.lit(0)))).alias("marks"))


@query("SELECT conv_id, turn, list_sort(list_filter([turn % 4, turn % 3], lambda n: n <= 0 OR n NOT IN (1, 3)))[1]::INTEGER AS first_invalid FROM conversations")
def invalid_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VER2: marks made from the turn, passages 1 and 3."""
    c = demo.messages(spark, sf_dir)
    said = F.concat(F.lit("["), F.col("turn") % 4, F.lit(","), F.col("turn") % 3, F.lit("]"))
    bad = F.array_sort(verify.invalid_citations(verify.all_citations(said), F.array(F.lit(1), F.lit(3))))
    return c.select("conv_id", "turn", F.try_element_at(bad, F.lit(1)).alias("first_invalid"))


def windows(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    c = demo.corpus(spark, sf_dir)
    return search.with_chunks(search.first(spark, sf_dir, k), c).select("query_id", "rank", "doc_id", F.col("ord").alias("ord_start"), F.col("ord").alias("ord_end"), "content", F.col("rank").alias("bm25_rank"))


SQL_WINDOWS = f"{SQL_CORPUS}, {sql_bm25('corpus')}, windows AS (SELECT * FROM (SELECT query_id, chunk_id AS doc_id, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM scores) JOIN documents USING (doc_id) WHERE rank <= 10)"


@query(f"WITH {SQL_WINDOWS}, hit AS (SELECT query_id, min(rank) AS r FROM windows JOIN benchmark b ON b.item_id = query_id WHERE contains(windows.text, b.text) GROUP BY query_id) SELECT item_id AS query_id, coalesce((r <= 3)::INTEGER::DOUBLE, 0.0) AS recall3, coalesce((r <= 5)::INTEGER::DOUBLE, 0.0) AS recall5 FROM benchmark LEFT JOIN hit ON query_id = item_id")
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL1."""
    w, g = windows(spark, sf_dir), demo.golden(spark, sf_dir)
    return evaluate.coverage_at(w, g, 3, "recall3").join(evaluate.coverage_at(w, g, 5, "recall5"), "query_id")


@query(f"WITH {SQL_WINDOWS}, hit AS (SELECT query_id, min(rank) AS r FROM windows JOIN benchmark b ON b.item_id = query_id WHERE contains(windows.text, b.text) GROUP BY query_id) SELECT item_id AS query_id, r::INTEGER AS first_rank, round(coalesce(1.0::DOUBLE / r, 0), 6) AS reciprocal FROM benchmark LEFT JOIN hit ON query_id = item_id")
def mrr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL2."""
    return evaluate.first_relevant(windows(spark, sf_dir), demo.golden(spark, sf_dir)).withColumn("reciprocal", F.round("reciprocal", 6))


@query(f"WITH {SQL_WINDOWS}, joined AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS t FROM windows WHERE rank <= 5 GROUP BY query_id), points AS (SELECT item_id AS query_id, unnest(string_split(text, chr(10))) AS p FROM benchmark) SELECT query_id, count(*) AS points, count(*) FILTER (contains(coalesce(t, ''), p)) AS hit FROM points LEFT JOIN joined USING (query_id) GROUP BY query_id")
def key_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL3."""
    return evaluate.key_point_hits(windows(spark, sf_dir), demo.golden(spark, sf_dir))


@query(f"""WITH {SQL_FIRST_LINES}, w AS (SELECT query_id, rank, h.doc_id, h.ord, regexp_replace(content, '[{X.BLANKS}]+', '', 'g') AS t FROM hits h JOIN (SELECT chunk_id, content FROM lines) USING (chunk_id) WHERE rank <= 3),
g AS (SELECT *, CASE WHEN length(t) > 1 THEN list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i::INTEGER, 2))) ELSE [] END AS b FROM w)
SELECT x.query_id, x.rank::INTEGER AS rank_1, y.rank::INTEGER AS rank_2, x.doc_id = y.doc_id AND abs(x.ord - y.ord) <= 1 AS adjacent, round(CASE WHEN len(x.b) + len(y.b) = 0 THEN 1.0 ELSE len(list_intersect(x.b, y.b))::DOUBLE / (len(x.b) + len(y.b) - len(list_intersect(x.b, y.b))) END, 6) AS jaccard,
       CASE WHEN len(x.b) + len(y.b) = 0 THEN 1.0 ELSE len(list_intersect(x.b, y.b))::DOUBLE / (len(x.b) + len(y.b) - len(list_intersect(x.b, y.b))) END >= 0.8 AS near_duplicate
FROM g x JOIN g y ON x.query_id = y.query_id AND x.rank < y.rank""")
def redundancy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL4, EVL5 over each query's three best lines."""
    c = demo.lines(spark, sf_dir)
    w = search.with_chunks(search.first(spark, sf_dir, 3, corpus=c), c).select("query_id", "rank", "doc_id", F.col("ord").alias("ord_start"), F.col("ord").alias("ord_end"), "content")
    return evaluate.redundant_pairs(w).withColumn("jaccard", F.round("jaccard", 6))


SQL_BIGRAMS = "list_sort(list_distinct(list_transform(range(1, length(t)), lambda i: substr(t, i::INTEGER, 2))))"


@query(f"""WITH texts AS (SELECT doc_id AS id, regexp_replace(coalesce(text, ''), '[{X.BLANKS}]+', '', 'g') AS t FROM documents), s AS (SELECT id, {SQL_BIGRAMS} AS b FROM texts), c AS (SELECT min(id) AS rep, b, list(id) AS members FROM s WHERE len(b) > 0 GROUP BY b),
e AS (SELECT rep, len(b) AS n, unnest(b) AS g FROM c), p AS (SELECT x.rep AS chunk_1, y.rep AS chunk_2, x.n + y.n AS total, count(*) AS shared FROM e x JOIN e y ON x.g = y.g AND x.rep < y.rep GROUP BY ALL)
SELECT chunk_1, chunk_2, round(shared::DOUBLE / (total - shared), 6) AS jaccard FROM p WHERE shared::DOUBLE / (total - shared) >= 0.8 UNION ALL SELECT rep, m, 1.0::DOUBLE FROM c, unnest(members) t(m) WHERE m <> rep""")
def near_duplicate_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL6 over whole documents."""
    return rounded(evaluate.near_duplicate_chunks(demo.corpus(spark, sf_dir)), "jaccard")


SQL_PER_QUERY = "per_query AS (SELECT item_id AS query_id, substr('qsmn', (item_id % 4 + 1)::INTEGER, 1) AS grp, item_id % 4 = 3 AS negative, coalesce((r <= 3)::INTEGER::DOUBLE, 0.0) AS recall3, coalesce((r <= 5)::INTEGER::DOUBLE, 0.0) AS recall5, r IS NULL AS no_hit FROM benchmark LEFT JOIN hit ON query_id = item_id)"
SQL_HIT = "hit AS (SELECT query_id, min(rank) AS r FROM windows JOIN benchmark b ON b.item_id = query_id WHERE contains(windows.text, b.text) GROUP BY query_id)"


def per_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = demo.golden(spark, sf_dir)
    return g.select("query_id", "grp", "negative").join(evaluate.query_figures(windows(spark, sf_dir), g), "query_id")


@query(f"WITH {SQL_WINDOWS}, {SQL_HIT}, {SQL_PER_QUERY} SELECT grp, count(*) AS queries, round(avg(recall3), 6) AS recall3, round(avg(recall5), 6) AS recall5, count(*) FILTER (no_hit) AS no_hit FROM (SELECT * FROM per_query UNION ALL SELECT * REPLACE ('all' AS grp) FROM per_query UNION ALL SELECT * REPLACE ('protected' AS grp) FROM per_query WHERE grp IN ('q', 'm')) GROUP BY grp")
def group_report_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL7."""
    return evaluate.grouped_report(per_query(spark, sf_dir)).withColumn("recall3", F.round("recall3", 6)).withColumn("recall5", F.round("recall5", 6))


@query(f"WITH {SQL_WINDOWS}, {SQL_HIT}, {SQL_PER_QUERY} SELECT count(*) FILTER (negative) AS negatives, count(*) FILTER (negative AND no_hit) AS negatives_refused, count(*) FILTER (NOT negative AND no_hit) AS false_refusals, round(count(*) FILTER (negative AND no_hit) / count(*) FILTER (negative), 6) AS refusal_rate FROM per_query")
def negatives_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL8: a query without a relevant window counts as refused."""
    return evaluate.negatives_report(per_query(spark, sf_dir).withColumn("refused", F.col("no_hit"))).withColumn("refusal_rate", F.round("refusal_rate", 6))


@query("WITH m AS (SELECT event_type AS metric, round(avg(value), 6) AS value FROM events GROUP BY 1), g(metric, kind, bound, other) AS (VALUES ('click', 'min', 1000.0::DOUBLE, NULL), ('view', 'max', 1.0::DOUBLE, NULL), ('error', 'max', 1e9::DOUBLE, NULL), ('purchase', 'relative', 2.0::DOUBLE, 'signup')) SELECT g.metric, kind, bound, m.value FROM g LEFT JOIN m USING (metric) LEFT JOIN m o ON o.metric = g.other WHERE NOT coalesce(CASE kind WHEN 'min' THEN m.value >= bound WHEN 'max' THEN m.value <= bound ELSE m.value >= bound * o.value END, false)")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL10 over mean event values."""
    m = demo.events(spark, sf_dir).groupBy(F.col("stage").alias("metric")).agg(F.round(F.avg("duration"), 6).alias("value"))
    g = spark.createDataFrame([("click", "min", 1000.0, None), ("view", "max", 1.0, None), ("error", "max", 1e9, None), ("purchase", "relative", 2.0, "signup")], "metric string, kind string, bound double, other string")
    return evaluate.check_gates(m, g)


def best_run(r: DataFrame) -> DataFrame:
    return r.groupBy("query_id").agg(F.collect_list(F.when(F.col("rank") <= 3, F.col("chunk_id"))).alias("covered"), F.max(F.when(F.col("rank") == 1, F.col("chunk_id"))).alias("top_doc"), F.count("*").alias("hits"))


SQL_RUNS = f"""{SQL_CORPUS}, {sql_bm25('corpus')}, {SQL_VECTORS},
a AS (SELECT query_id, list_sort(list(chunk_id) FILTER (r <= 3)) AS covered, max(chunk_id) FILTER (r = 1) AS top_doc, count(*) FILTER (r <= 10) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS r FROM scores) GROUP BY 1),
b AS (SELECT query_id, list_sort(list(chunk_id) FILTER (r <= 3)) AS covered, max(chunk_id) FILTER (r = 1) AS top_doc, count(*) FILTER (r <= 10) AS hits FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS r FROM cosines) GROUP BY 1)"""


@query(f"""WITH {SQL_RUNS} SELECT query_id, a.covered <> b.covered AS covered_differs, a.top_doc AS top_doc, b.top_doc AS top_doc_b, a.hits AS hits, b.hits AS hits_b FROM a JOIN b USING (query_id) WHERE a.covered <> b.covered OR a.top_doc IS DISTINCT FROM b.top_doc OR a.hits <> b.hits ORDER BY query_id LIMIT 10""")
def run_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL12: the first ten queries on which the keyword and the vector run differ."""
    return evaluate.mismatches(best_run(search.first(spark, sf_dir, 10)), best_run(search.top(search.cosines(spark, sf_dir), "cosine", 10)))


@query(f"""WITH {SQL_RUNS} SELECT count(*) AS queries, round(avg((a.covered = b.covered)::INTEGER), 6) AS covered, round(avg((a.top_doc = b.top_doc)::INTEGER), 6) AS top_doc, round(avg((a.hits = b.hits)::INTEGER), 6) AS hits FROM a JOIN b USING (query_id)""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL12: the keyword run against the vector run."""
    out = evaluate.agreement(best_run(search.first(spark, sf_dir, 10)), best_run(search.top(search.cosines(spark, sf_dir), "cosine", 10)))
    return out.select("queries", *[F.round(c, 6).alias(c) for c in ("covered", "top_doc", "hits")])


@query("WITH r AS (SELECT event_type AS stage, value AS ms, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events) SELECT stage, max(ms) FILTER (n = greatest(1, least(c, round_even(0.5::DOUBLE * c + 0.5, 0)::BIGINT))) AS p50, max(ms) FILTER (n = greatest(1, least(c, round_even(0.95::DOUBLE * c + 0.5, 0)::BIGINT))) AS p95, round(avg(ms), 6) AS mean, max(ms) AS max FROM r GROUP BY stage")
def latency_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL13."""
    e = demo.events(spark, sf_dir).select("stage", F.col("duration").alias("ms"))
    return evaluate.latency_summary(e, ["stage"]).withColumn("mean", F.round("mean", 6))


@query("WITH m AS (SELECT event_type AS stage, user_id, quantile_disc(-value, 0.5) * -1 AS ms FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ms) AS n, count(*) OVER (PARTITION BY stage) AS c FROM m) SELECT stage, count(*) AS queries, max(ms) FILTER (n = greatest(1, least(c, round_even(0.5::DOUBLE * c + 0.5, 0)::BIGINT))) AS p50, max(ms) FILTER (n = greatest(1, least(c, round_even(0.95::DOUBLE * c + 0.5, 0)::BIGINT))) AS p95, round(avg(ms), 6) AS mean, max(ms) AS max FROM r GROUP BY stage")
def query_latencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL13 with repeated timings: a user's events of a stage stand for one query's runs."""
    e = demo.events(spark, sf_dir).select("stage", F.col("run_id").alias("query_id"), F.col("duration").alias("ms"))
    medians = evaluate.query_medians(e, ["stage"])
    counts = medians.groupBy("stage").agg(F.count("*").alias("queries"))
    return evaluate.latency_summary(medians, ["stage"]).join(counts, "stage").withColumn("mean", F.round("mean", 6))


@query("SELECT count(*) FILTER (e AND r) AS tp, count(*) FILTER (NOT e AND r AND NOT m) AS fp, count(*) FILTER (e AND NOT r) AS fn, count(*) FILTER (NOT e AND NOT r) AS tn, count(*) FILTER (NOT e AND m) AS self_refused FROM (SELECT quality = 0 AS e, toxic = 1 OR doc_id % 5 = 0 AS r, doc_id % 7 = 0 AS m FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL)")
def refusal_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL15 over labels."""
    rows = demo.table(spark, sf_dir, "labels").where(F.col("quality").isNotNull() & F.col("toxic").isNotNull()).select((F.col("quality") == 0).alias("expect_refuse"), ((F.col("toxic") == 1) | (F.col("doc_id") % 5 == 0)).alias("refused"), (F.col("doc_id") % 7 == 0).alias("model_refused"))
    return evaluate.refusal_confusion(rows)


@query("SELECT item_id AS query_id, doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def gold_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL16."""
    return evaluate.gold_documents(demo.corpus(spark, sf_dir), demo.golden(spark, sf_dir))


@query(f"WITH {SQL_WINDOWS} SELECT round(avg(contains(windows.text, b.text)::INTEGER), 6) AS doc_top1 FROM windows JOIN benchmark b ON b.item_id = query_id WHERE rank = 1")
def document_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL16."""
    return evaluate.document_top1(windows(spark, sf_dir), gold_documents(spark, sf_dir)).withColumn("doc_top1", F.round("doc_top1", 6))


@query(f"""WITH {SQL_WINDOWS}, {SQL_VECTORS}, w AS (SELECT w.query_id, rank, text, cosine FROM windows w JOIN cosines c ON c.query_id = w.query_id AND c.chunk_id = w.doc_id),
r AS (SELECT admission, query_id, text, row_number() OVER (PARTITION BY admission, query_id ORDER BY rank) AS n FROM w, (VALUES ('all'), ('cosine'), ('either')) a(admission) WHERE admission <> 'cosine' OR cosine >= 0.2),
h AS (SELECT DISTINCT admission, query_id FROM r JOIN benchmark b ON b.item_id = query_id WHERE n <= 3 AND contains(r.text, b.text))
SELECT a.admission, round(count(h.query_id) / count(*), 6) AS coverage FROM benchmark CROSS JOIN (VALUES ('all'), ('cosine'), ('either')) a(admission) LEFT JOIN h ON h.admission = a.admission AND h.query_id = item_id GROUP BY a.admission""")
def admission_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL17."""
    rows = windows(spark, sf_dir).join(search.cosines(spark, sf_dir).withColumnRenamed("chunk_id", "doc_id"), ["query_id", "doc_id"])
    return rounded(evaluate.admission_audit(rows, demo.golden(spark, sf_dir), 0.2), "coverage")


@query(f"""WITH {SQL_WINDOWS}, {SQL_HIT}, joined AS (SELECT query_id, string_agg(text, chr(10) ORDER BY rank) AS t FROM windows WHERE rank <= 5 GROUP BY query_id), points AS (SELECT query_id, count(*) AS points, count(*) FILTER (contains(coalesce(t, ''), p)) AS hit FROM (SELECT item_id AS query_id, unnest(string_split(text, chr(10))) AS p FROM benchmark) LEFT JOIN joined USING (query_id) GROUP BY query_id),
w AS (SELECT query_id, rank, regexp_replace(text, '[{X.BLANKS}]+', '', 'g') AS t FROM windows WHERE rank <= 3), g AS (SELECT query_id, rank, {SQL_BIGRAMS} AS b FROM w),
d AS (SELECT query_id, arg_min(r1, r1 * 10 + r2) AS r1, arg_min(r2, r1 * 10 + r2) AS r2 FROM (SELECT x.query_id, x.rank AS r1, y.rank AS r2, len(list_intersect(x.b, y.b))::DOUBLE AS i, len(x.b) + len(y.b) AS n FROM g x JOIN g y ON x.query_id = y.query_id AND x.rank < y.rank) WHERE n = 0 OR i / (n - i) >= 0.8 GROUP BY query_id),
c AS (SELECT query_id, count(*) AS hits, substr(max(text) FILTER (rank = 1), 1, 40) AS top_text FROM windows GROUP BY query_id)
SELECT item_id AS query_id, item_id % 4 = 3 AS negative, coalesce(hits, 0) AS hits, top_text, coalesce(hits, 0) = 0 AS refused, coalesce((r <= 3)::INTEGER::DOUBLE, 0.0) AS coverage, r::INTEGER AS first_rank, points, hit, NULL::INTEGER AS adjacent_1, NULL::INTEGER AS adjacent_2, r1::INTEGER AS near_duplicate_1, r2::INTEGER AS near_duplicate_2
FROM benchmark LEFT JOIN hit h ON h.query_id = item_id LEFT JOIN points p ON p.query_id = item_id LEFT JOIN d ON d.query_id = item_id LEFT JOIN c ON c.query_id = item_id""")
def query_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVL18."""
    return evaluate.query_detail(windows(spark, sf_dir), demo.golden(spark, sf_dir))


SQL_SAMPLES = "samples AS (SELECT l.doc_id AS id, quality = 1 AS supported, (n_chars % 100) / 100.0::DOUBLE AS semantic, (l.doc_id % 97) / 97.0::DOUBLE AS lexical, toxic = 1 AS fabricated FROM labels l JOIN documents USING (doc_id))"
SQL_SCORE = "CASE WHEN fabricated AND semantic < 0.6 THEN least(semantic * {w} + lexical * (1 - {w}), {k} - 0.01) ELSE semantic * {w} + lexical * (1 - {w}) END"
SQL_MEASURES = "tp, fp, fn, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END, 6) AS f1"
SQL_COUNTS = "count(*) FILTER (p AND supported) AS tp, count(*) FILTER (p AND NOT supported) AS fp, count(*) FILTER (NOT p AND supported) AS fn"


def rounded(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumn(n, F.round(n, 6))
    return df


@query(f"WITH {SQL_SAMPLES}, c AS (SELECT {SQL_COUNTS} FROM (SELECT *, {SQL_SCORE.format(w='0.75::DOUBLE', k='0.38::DOUBLE')} >= 0.55 AS p FROM samples)) SELECT {SQL_MEASURES} FROM c")
def confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAL1."""
    return rounded(calibrate.confusion(demo.samples(spark, sf_dir)), "precision", "recall", "f1")


SQL_GRID = "grid AS (SELECT s / 20.0::DOUBLE AS t_supported, w / 20.0::DOUBLE AS t_weak, m / 4.0::DOUBLE AS t_weight FROM range(6, 18) a(s), range(4, 8) b(w), range(0, 5) c(m))"


def grid(spark: SparkSession) -> DataFrame:
    return calibrate.grid(spark, [s / 20 for s in range(6, 18)], [w / 20 for w in range(4, 8)], [m / 4 for m in range(5)])


SQL_SWEPT = f"{SQL_SAMPLES}, {SQL_GRID}, p AS (SELECT *, {SQL_SCORE.format(w='t_weight', k='t_weak')} >= t_supported AS p FROM samples, grid)"


@query(f"WITH {SQL_SWEPT}, c AS (SELECT t_supported, t_weak, t_weight, {SQL_COUNTS} FROM p GROUP BY ALL) SELECT t_supported, t_weak, t_weight, {SQL_MEASURES} FROM c")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAL2."""
    return rounded(calibrate.sweep(demo.samples(spark, sf_dir), grid(spark)), "precision", "recall", "f1")


SQL_FINE = "grid AS (SELECT s / 100.0::DOUBLE AS t_supported, w / 100.0::DOUBLE AS t_weak, m / 4.0::DOUBLE AS t_weight FROM range(30, 86) a(s), (VALUES (20), (30), (38), (40), (50)) b(w), range(0, 5) c(m))"


@query(f"WITH {SQL_SAMPLES}, {SQL_FINE}, p AS (SELECT *, {SQL_SCORE.format(w='t_weight', k='t_weak')} >= t_supported AS p FROM samples, grid), c AS (SELECT t_supported, t_weak, t_weight, {SQL_COUNTS} FROM p GROUP BY ALL), m AS (SELECT t_supported, t_weak, t_weight, {SQL_MEASURES} FROM c) SELECT * FROM m ORDER BY f1 DESC, t_supported DESC, t_weak, t_weight LIMIT 1")
def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAL2: the best of 56 x 5 x 5 rows."""
    fine = calibrate.grid(spark, [x / 100 for x in range(30, 86)], [0.2, 0.3, 0.38, 0.4, 0.5], [m / 4 for m in range(5)])
    return calibrate.best(rounded(calibrate.sweep(demo.samples(spark, sf_dir), fine), "precision", "recall", "f1"))


@query(f"WITH {SQL_SWEPT}, f AS (SELECT id AS fid, (row_number() OVER (PARTITION BY supported ORDER BY id) - 1) % 5 AS fold FROM samples), c AS (SELECT t_supported, t_weak, t_weight, fold, {SQL_COUNTS} FROM p JOIN f ON fid = id GROUP BY ALL), m AS (SELECT *, CASE WHEN tp = 0 THEN 0 ELSE 2.0::DOUBLE * tp / (2 * tp + fp + fn) END AS f1 FROM c) SELECT t_supported, t_weak, t_weight, round(avg(f1), 6) AS macro_f1, round(stddev_pop(f1), 6) AS std_f1 FROM m GROUP BY ALL")
def cv_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CAL3."""
    return rounded(calibrate.sweep_cv(demo.samples(spark, sf_dir), grid(spark)), "macro_f1", "std_f1")


SQL_SIGNAL_VALUES = "v AS (SELECT l.doc_id AS query_id, quality = 0 AS supported, 'size' AS signal, (n_chars % 1000) / 1000.0::DOUBLE AS value FROM labels l JOIN documents USING (doc_id) WHERE quality IS NOT NULL UNION ALL SELECT l.doc_id, quality = 0, 'place', (l.doc_id % 89) / 89.0::DOUBLE FROM labels l JOIN documents USING (doc_id) WHERE quality IS NOT NULL)"


@query(f"WITH {SQL_SIGNAL_VALUES}, s AS (SELECT signal, min(value) AS lo, max(value) AS hi FROM v GROUP BY 1), t AS (SELECT signal, i AS step, lo + (hi - lo) * i / 400 AS threshold FROM s, range(0, 401) r(i)), c AS (SELECT signal, step, threshold, {SQL_COUNTS} FROM (SELECT *, value < threshold AS p FROM v JOIN t USING (signal)) GROUP BY ALL) SELECT signal, step::INTEGER AS step, round(threshold, 6) AS threshold, {SQL_MEASURES} FROM c")
def signal_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SGN1."""
    return rounded(calibrate.signal_sweep(demo.signal_values(spark, sf_dir)), "threshold", "precision", "recall", "f1")


@query(f"WITH {SQL_SIGNAL_VALUES}, k AS (SELECT signal, min(value) AS cut FROM v WHERE NOT supported GROUP BY 1), j AS (SELECT query_id, supported, bool_or(value < cut) AS r FROM v JOIN k USING (signal) GROUP BY ALL) SELECT count(*) FILTER (supported AND r) AS refusals, count(*) FILTER (NOT supported AND r) AS false_refusals, count(*) FILTER (supported) AS negatives, count(*) FILTER (NOT supported AND r) = 0 AND count(*) FILTER (supported AND r) > 0 AS usable FROM j")
def signal_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SGN2."""
    return calibrate.signal_fusion(demo.signal_values(spark, sf_dir))


@query(f"""WITH {SQL_CORPUS}, {sql_bm25('corpus')}, {SQL_VECTORS}, {search.SQL_FUSED}, g(v, k) AS (SELECT v, k FROM (VALUES ('0.5'), ('1.0'), ('1.5'), ('2.0')) a(v), (VALUES (20), (40), (60), (80)) b(k)),
s AS (SELECT 'vec_weight=' || v || ',rrf_k=' || k AS config_id, query_id, chunk_id, coalesce(v::DOUBLE / (k + vec_rank), 0) + CASE WHEN bm25_rank > 0 THEN 1.0::DOUBLE / (k + bm25_rank) ELSE 0 END AS score FROM fused, g)
SELECT * FROM (SELECT config_id, query_id, chunk_id, row_number() OVER (PARTITION BY config_id, query_id ORDER BY score DESC, chunk_id)::INTEGER AS place FROM s) WHERE place <= 10""")
def fusion_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SWP1."""
    configs = calibrate.option_grid(calibrate.Options(), vec_weight=[0.5, 1.0, 1.5, 2.0], rrf_k=[20, 40, 60, 80])
    found = search.both_legs(spark, sf_dir)
    return calibrate.fusion_sweep(search.cosines(spark, sf_dir), search.scored(spark, sf_dir), configs) if found is None else calibrate.leg_sweep(found, configs)


SQL_BARE = f"regexp_replace(text, '[{X.BLANKS}]+', '', 'g')"


@query(f"""WITH s AS (SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN 'refused' ELSE 'supported' END AS verdict, [turn % 3] AS cites, CASE WHEN length({SQL_BARE}) > 1 THEN list_distinct(list_transform(range(1, length({SQL_BARE})), lambda i: substr({SQL_BARE}, i::INTEGER, 2))) ELSE [] END AS b FROM conversations WHERE role = 'assistant'),
p AS (SELECT x.conv_id, avg(CASE WHEN len(x.b) + len(y.b) = 0 THEN 1.0 ELSE len(list_intersect(x.b, y.b))::DOUBLE / (len(x.b) + len(y.b) - len(list_intersect(x.b, y.b))) END) AS j, avg((x.cites = y.cites)::INTEGER::DOUBLE) AS c FROM s x JOIN s y ON x.conv_id = y.conv_id AND x.turn < y.turn GROUP BY 1)
SELECT s.conv_id AS question_id, count(*) AS samples, (count(DISTINCT verdict) = 1)::INTEGER::DOUBLE AS verdict_agreement, round(coalesce(max(j), 1.0), 6) AS answer_jaccard, round(coalesce(max(c), 1.0), 6) AS citation_jaccard, count(DISTINCT verdict = 'refused') > 1 AS refusal_flip FROM s LEFT JOIN p USING (conv_id) GROUP BY s.conv_id""")
def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CON1: a conversation's assistant turns as samples."""
    s = demo.messages(spark, sf_dir).where("role = 'assistant'").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("sample_no"), F.when(F.length("text") % 3 == 0, "refused").otherwise("supported").alias("verdict"), F.col("text").alias("answer"), F.array(F.col("turn") % 3).alias("citations"))
    return rounded(evaluate.consistency(s).drop("number_jaccard"), "answer_jaccard", "citation_jaccard")


@query("WITH s AS (SELECT conv_id, count(DISTINCT CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END) AS n FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT round(avg((n = 1)::INTEGER::DOUBLE), 6) AS agreement, count(*) FILTER (n > 1) AS flips, avg((n = 1)::INTEGER::DOUBLE) >= 0.75 AND count(*) FILTER (n > 1) = 0 AS passed FROM s")
def consistency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CON2."""
    return rounded(evaluate.consistency_gate(consistency(spark, sf_dir)), "agreement")


@query()
def injection_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INJ1, INJ2 over pages."""
    p = demo.table(spark, sf_dir, "pages").select("page_id", F.col("html").alias("text"))
    return safety.redact(safety.scan(p)).select("page_id", "risk", F.size("findings").alias("findings"), F.length("safe_text").alias("safe_chars"))


@query(r"""SELECT count(*) FILTER (regexp_matches(html, '(?i)\b(data|javascript):[^\s"'']{40,}')) AS encoded, count(*) FILTER (regexp_matches(html, '(?i)<\|(im_start|im_end|system|assistant|user)\|>')) AS spoofed, count(*) AS pages FROM pages""")
def injection_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """INJ1: two of the signs by the engine's own matcher."""
    sign = {p: f"(?i){p}" for _, _, p in safety.SIGNS}
    enc, spoof = (next(v for k, v in sign.items() if k.startswith(s)) for s in (r"\b(data|", r"<\|"))
    return demo.table(spark, sf_dir, "pages").agg(F.count_if(F.col("html").rlike(enc)).alias("encoded"), F.count_if(F.col("html").rlike(spoof)).alias("spoofed"), F.count("*").alias("pages"))


SQL_HEADS = "|".join(safety.REFERENCE_LINES)
SQL_SCRUB_HEAD = r"trim(regexp_replace(lower(ltrim(l)), '[:：]\s.*$', ''))"


@query(rf"""WITH f AS (SELECT conv_id, turn, string_split(regexp_replace(text, '```(?s:.*?)```', '', 'g'), chr(10)) AS l FROM conversations),
k AS (SELECT conv_id, turn, substr(regexp_replace(array_to_string(list_filter(l, lambda l: NOT regexp_matches({SQL_SCRUB_HEAD}, '^(?:{SQL_HEADS})')), chr(10)), '{safety.CHUNK_MARK}', '', 'g'), 1, 2000) AS t FROM f)
SELECT conv_id, turn, regexp_replace(regexp_replace(t, '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS text FROM k""")
def scrubbed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRV1."""
    return demo.messages(spark, sf_dir).select("conv_id", "turn", safety.scrub(F.col("text")).alias("text"))


@query("SELECT event_type AS name, count(*) AS events, count(*) FILTER (user_id % 2 = 0) AS hidden FROM events GROUP BY event_type")
def audit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AUD1: half of the events carry a secret."""
    e = demo.table(spark, sf_dir, "events").select(F.col("event_type").alias("name"), F.when(F.col("user_id") % 2 == 0, F.concat(F.lit('{"token": "t", "args": '), "props", F.lit("}"))).otherwise(F.col("props")).alias("args"))
    return safety.audit_fields(e).groupBy("name").agg(F.count("*").alias("events"), F.count_if(F.contains("args_preview", F.lit("***"))).alias("hidden"))


SQL_VALID = "valid AS (SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '')"


@query(f"WITH {SQL_VALID}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) > 4 AS fold FROM valid), n AS (SELECT *, count(*) FILTER (fold) OVER (PARTITION BY conv_id) AS k FROM r) SELECT conv_id, turn, role, fold FROM n WHERE k >= 4")
def history_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIS1, HIS2."""
    return history.plan(demo.messages(spark, sf_dir)).select("conv_id", "turn", "role", "fold")


@query(f"""WITH {SQL_VALID}, l AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN '用户：' ELSE '助手：' END || text AS line FROM valid),
r AS (SELECT *, sum(length(line)) OVER w AS s, row_number() OVER w AS n FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY turn DESC)),
k AS (SELECT conv_id, string_agg(CASE WHEN s <= 2000 THEN line ELSE substr(line, 1, 2000) || '…' END, chr(10) ORDER BY turn) FILTER (s <= 2000 OR n = 1) AS t, NOT bool_and(s <= 2000) AS cut FROM r GROUP BY conv_id)
SELECT conv_id, '【历史对话】' || chr(10) || CASE WHEN cut THEN '…（更早对话已截断）' || chr(10) ELSE '' END || t AS input FROM k""")
def summary_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIS3 over whole conversations."""
    return history.summary_input(history.valid(demo.messages(spark, sf_dir)))


@query(f"WITH {SQL_VALID}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM valid) SELECT conv_id, turn, role, CASE WHEN length(text) > 800 THEN substr(text, 1, 800) || '…' ELSE text END AS content FROM r WHERE n <= 4")
def prompt_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HIS4."""
    return history.prompt_history(demo.messages(spark, sf_dir))


@query("SELECT event_type AS stage, count(*) AS count, round(sum(value), 4) AS total, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, arg_max(value, (ts, value)) AS last FROM events GROUP BY event_type")
def stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEL1."""
    return telemetry.stage_stats(demo.events(spark, sf_dir)).withColumn("total", F.round("total", 4)).withColumn("avg", F.round("avg", 6))


@query("SELECT event_type AS stage, round(avg(value) FILTER (user_id % 3 = 0), 6) AS wasm, round(avg(value) FILTER (user_id % 3 = 1), 6) AS webgpu, round(avg(value) FILTER (user_id % 3 = 0) / avg(value) FILTER (user_id % 3 = 1), 6) AS speedup FROM events WHERE user_id % 3 < 2 GROUP BY event_type")
def device_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEL2."""
    e = demo.events(spark, sf_dir).withColumn("device", F.when(F.col("run_id") % 3 == 0, "wasm").when(F.col("run_id") % 3 == 1, "webgpu"))
    return rounded(telemetry.device_comparison(e), "wasm", "webgpu", "speedup")


def retrieval_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_samples(demo.events(spark, sf_dir))


def as_samples(e: DataFrame) -> DataFrame:
    share = (F.col("k") % 100) / 100.0
    return e.select("ts", F.when(F.col("run_id") % 4 == 0, "bm25").otherwise("hybrid").alias("mode"), (F.col("k") % 6).alias("hits"), F.col("k").alias("index_size"), (F.col("k") % 3).alias("dropped"), (F.col("k") % 6 == 0).alias("no_hit"), F.when(F.col("k") % 6 == 0, F.array().cast("array<double>")).otherwise(F.array(share, share / 2)).alias("relevance"), (F.col("k") % 5).alias("window_chunks"), (F.col("k") % 4).alias("matched_chunks"), (F.col("k") % 2 == 0).alias("reranked"), (F.col("k") % 8 == 0).alias("top_changed"), share.alias("overlap"), F.when(F.col("k") % 9 == 0, F.concat(F.lit("slow"), "event_id")).alias("skip_reason"))


SQL_K = "k AS (SELECT *, json_extract_string(props, '$.k')::BIGINT AS k FROM events)"


@query(f"""WITH {SQL_K} SELECT count(*) AS count, round(avg(k % 6), 6) AS avg_hits, round(avg(k), 6) AS avg_index_size, round(avg(CASE WHEN k % 6 = 0 THEN 0 ELSE (k % 100) / 100.0::DOUBLE END), 6) AS avg_top1,
round(sum(CASE WHEN k % 6 = 0 THEN 0 ELSE 1.5::DOUBLE * (k % 100) / 100 END) / sum(CASE WHEN k % 6 = 0 THEN 0 ELSE 2 END), 6) AS avg_relevance, round(avg(k % 3), 6) AS avg_dropped, count(*) FILTER (k % 6 = 0) AS no_hit_count, round(avg((k % 6 = 0)::INTEGER), 6) AS no_hit_rate,
round(avg(k % 5), 6) AS avg_window_chunks, round(avg(k % 4), 6) AS avg_matched_chunks, count(*) FILTER (user_id % 4 = 0) AS bm25_fallbacks, count(*) FILTER (k % 2 = 0) AS rerank_count, round(count(*) FILTER (k % 8 = 0) / count(*) FILTER (k % 2 = 0), 6) AS rerank_top_changed_rate,
round(avg((k % 100) / 100.0::DOUBLE) FILTER (k % 2 = 0), 6) AS rerank_avg_overlap, count(*) FILTER (k % 9 = 0) AS rerank_skipped, arg_max('slow' || event_id, ts) FILTER (k % 9 = 0) AS last_skip_reason, count(*) FILTER (k % 8 = 0) > 0 AS rerank_effective FROM k""")
def quality_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEL3."""
    s = telemetry.retrieval_stats(retrieval_samples(spark, sf_dir))
    return rounded(s, *[n for n, t in s.dtypes if t == "double"])


@query(f"WITH {SQL_K}, r AS (SELECT (k % 100) / 100.0::DOUBLE AS r FROM k WHERE k % 6 <> 0 UNION ALL SELECT (k % 100) / 100.0::DOUBLE / 2 FROM k WHERE k % 6 <> 0) SELECT least(4, floor(r * 5)::INTEGER) AS bucket, count(*) AS n FROM r GROUP BY 1")
def relevance_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEL4."""
    return telemetry.relevance_histogram(retrieval_samples(spark, sf_dir))


@query("SELECT event_id, event_type AS stage FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS n FROM events) WHERE n <= 100")
def latest_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TEL5 for each stage."""
    return telemetry.latest(demo.events(spark, sf_dir), 100, ("stage",)).select("event_id", "stage")


@query("SELECT user_id AS run_id, round(sum(value), 4) AS latency_ms, round(coalesce(sum(value) FILTER (event_type = 'click'), 0), 4) AS click_ms, count(DISTINCT event_type)::INTEGER AS stages FROM events GROUP BY user_id")
def trace_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRC1."""
    t = telemetry.latency_breakdown(demo.events(spark, sf_dir).select("run_id", F.col("stage").alias("name"), F.col("duration").alias("duration_ms")))
    return t.select("run_id", F.round("latency_ms", 4).alias("latency_ms"), F.round(F.coalesce(F.try_element_at("breakdown", F.lit("click")), F.lit(0.0)), 4).alias("click_ms"), F.size("breakdown").alias("stages"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type)::INTEGER AS seq FROM events")
def trace_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TRC1."""
    return telemetry.numbered_trace(demo.events(spark, sf_dir).withColumn("name", F.col("stage"))).select("event_id", "seq")


@query(f"SELECT item_id AS query_id, (len(regexp_extract_all(text, '{X.COUNTED_WORD}')) + len(regexp_extract_all(text, '{X.HAN}')) + 3512)::INTEGER AS est_tokens, CASE WHEN len(regexp_extract_all(text, '{X.COUNTED_WORD}')) + len(regexp_extract_all(text, '{X.HAN}')) + 3512 > 3550 THEN 'tokens' END AS exceeded FROM benchmark")
def preflight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUD1."""
    q = demo.queries(spark, sf_dir).select("query_id", F.col("text").alias("question"))
    return telemetry.preflight(q, telemetry.Limits(max_tokens=3550)).select("query_id", "est_tokens", "exceeded")


SQL_LEDGER = f"{SQL_K}, l AS (SELECT user_id AS run_id, event_id AS seq, count(*) OVER w AS steps, sum(k + k % 7) OVER w AS tokens FROM k WINDOW w AS (PARTITION BY user_id ORDER BY event_id)), x AS (SELECT *, CASE WHEN tokens > 2000 THEN 'tokens' WHEN steps > 40 THEN 'steps' END AS exceeded FROM l)"
LIMITS = telemetry.Limits(max_tokens=2000, max_steps=40)


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.events(spark, sf_dir).select("run_id", F.col("event_id").alias("seq"), F.col("k").alias("prompt_tokens"), (F.col("k") % 7).alias("completion_tokens"))


@query(f"WITH {SQL_LEDGER} SELECT run_id, seq, steps, tokens::BIGINT AS tokens, exceeded FROM x")
def budget_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUD2."""
    return telemetry.ledger(calls(spark, sf_dir), LIMITS).select("run_id", "seq", "steps", "tokens", "exceeded")


@query(f"WITH {SQL_LEDGER} SELECT run_id, min(seq) AS seq, arg_min(exceeded, seq) AS exceeded, arg_min(tokens, seq)::BIGINT AS tokens, arg_min(steps, seq) AS steps FROM x WHERE exceeded IS NOT NULL GROUP BY run_id")
def budget_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.first_exceeded(telemetry.ledger(calls(spark, sf_dir), LIMITS))


@query(f"""WITH {SQL_K}, s AS (SELECT user_id AS run_id, event_id AS seq, event_type AS action, 'o' || (k % 12) AS observation, k % 5 <> 0 AS ok FROM k),
w AS (SELECT *, lag(action) OVER p AS a, lag(ok) OVER p AS o, lag(observation, 1) OVER p AS o1, lag(observation, 2) OVER p AS o2, lag(observation, 3) OVER p AS o3 FROM s WINDOW p AS (PARTITION BY run_id ORDER BY seq))
SELECT run_id, seq, CASE WHEN action = a THEN 'repeated_action' WHEN observation IN (o1, o2, o3) THEN 'repeated_observation' WHEN NOT ok AND NOT o THEN 'two_failures' END AS reason FROM w""")
def no_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NPR1."""
    s = demo.events(spark, sf_dir).select("run_id", F.col("event_id").alias("seq"), F.col("stage").alias("action"), F.concat(F.lit("o"), F.col("k") % 12).alias("observation"), (F.col("k") % 5 != 0).alias("ok"))
    return telemetry.no_progress(s).select("run_id", "seq", "reason")


@query(f"""WITH a AS (SELECT conv_id AS question_id, {sql_trim('min(text)')} AS t FROM conversations WHERE role = 'assistant' AND conv_id % 3 <> 0 GROUP BY 1), b AS (SELECT conv_id AS question_id, {sql_trim('min(text)')} AS t FROM conversations WHERE role = 'user' AND conv_id % 3 <> 1 GROUP BY 1)
SELECT question_id, coalesce(a.t, '') AS local_text, coalesce(b.t, '') AS cloud_text, CASE WHEN coalesce(a.t, '') <> '' AND coalesce(b.t, '') <> '' THEN a.t || chr(10) || chr(10) || '── 云端拓展（无本地文档依据，不执行幻觉校验）──' || chr(10) || chr(10) || b.t WHEN coalesce(b.t, '') <> '' THEN b.t ELSE coalesce(a.t, '') END AS full_text FROM a FULL JOIN b USING (question_id)""")
def merge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MRG1: thirds with a local answer, a cloud answer, both."""
    m = demo.messages(spark, sf_dir)
    side = lambda role, out: m.where((F.col("role") == role) & (F.col("conv_id") % 3 != out)).groupBy(F.col("conv_id").alias("question_id")).agg(F.min("text").alias("text"))
    return telemetry.merge_answers(side("assistant", 0), side("user", 1))


@query("SELECT conv_id, count(*) AS messages, count(*) FILTER (role = 'assistant') AS chunks FROM conversations GROUP BY conv_id")
def backup_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1: assistant turns as chunks of their conversation."""
    from corpusloom.sources import backups

    m = demo.messages(spark, sf_dir)
    conv = m.groupBy("conv_id").agg(F.count("*").alias("messages"))
    own = m.where("role = 'assistant'").select("conv_id", F.col("turn").alias("ord"), F.concat_ws(":", "conv_id", "turn").alias("chunk_id"), F.col("conv_id").alias("doc_id"), F.col("text").alias("content"))
    return backups.backup_rows(conv, own).select("conv_id", "messages", F.size("chunks").cast("long").alias("chunks"))


@query("SELECT vec_id, len(embedding)::INTEGER AS size, true AS same FROM embeddings")
def vector_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7: vectors to base64 and back."""
    from corpusloom.sources import backups

    e = demo.table(spark, sf_dir, "embeddings").withColumn("back", backups.decode_vector(backups.encode_vector("embedding")))
    return e.select("vec_id", F.size("back").alias("size"), (F.col("back") == F.col("embedding")).alias("same"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type AS stage, count(*) AS count, round(sum(value), 4) AS total, min(value) AS min, max(value) AS max, arg_max(value, (ts, value)) AS last FROM events GROUP BY ALL")
def stream_stage_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: the events read as a stream, to the end."""
    from corpusloom.streaming import jobs, runs

    e = runs.read_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("stage"), F.col("value").alias("duration"))
    out = runs.to_table(jobs.live_stage_stats(e), "complete")
    return out.select(F.col("window.start").alias("day"), "stage", "count", F.round("total", 4).alias("total"), "min", "max", "last")


@query(ORACLE_SQL["quality_stats"].replace("SELECT count(*) AS count", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, count(*) AS count") + " GROUP BY 1")
def stream_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR4: TEL3 a day, the events read as a stream."""
    from corpusloom.streaming import jobs, runs

    e = demo.as_events(runs.read_stream(spark, sf_dir, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    out = runs.to_table(jobs.live_quality(as_samples(e)), "complete")
    return rounded(out.select(F.col("window.start").alias("day"), *[c for c in out.columns if c != "window"]), *[n for n, t in out.dtypes if t == "double"])


@query(ORACLE_SQL["budget_stops"])
def stream_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR5: runs that exceed a limit, found by keyed state."""
    from corpusloom.streaming import jobs, runs

    e = runs.read_stream(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("long").alias("prompt_tokens")).withColumn("completion_tokens", F.col("prompt_tokens") % 7)
    return runs.to_table(jobs.budget_stops(e, LIMITS), "append")
