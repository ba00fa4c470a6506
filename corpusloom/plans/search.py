"""Queries over text, indexes and retrieval, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.functions.hashing import fnv1a32
from corpusloom.operators import acl, bm25, bm25_index, chunking, dense, evidence, fusion, index, legs
from corpusloom.operators.shared import bounded, folder, staged
from corpusloom.plans import demo

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


BLANK_CLASS = "[" + X.BLANKS + "]"


def sql_trim(x: str) -> str:
    return f"regexp_replace({x}, '^{BLANK_CLASS}+|{BLANK_CLASS}+$', '', 'g')"


def sql_tokens(x: str) -> str:
    han = "flatten(list_transform(regexp_extract_all({0}, '[一-鿿]+'), lambda s: CASE WHEN length(s) = 1 THEN [s] ELSE list_transform(range(1, length(s)), lambda i: substr(s, i::INTEGER, 2)) END))".format(x)
    return f"list_concat(list_transform(regexp_extract_all({x}, '{X.WORD}'), lambda t: lower(t)), {han})"


def sql_fnv(x: str) -> str:
    return f"lower(printf('%08x', list_reduce(list_concat([2166136261::BIGINT], list_transform(string_split({x}, ''), lambda c: ord(c)::BIGINT)), lambda h, u: (xor(h, u) * 16777619) % 4294967296)))"


SQL_LINES = "lines AS (SELECT doc_id, (i - 1)::INTEGER AS ord, doc_id * 100000 + (i - 1) AS chunk_id, l[i] AS content FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) t(i) WHERE trim(l[i]) <> '')"
SQL_CORPUS = "corpus AS (SELECT doc_id AS chunk_id, doc_id, doc_id AS ord, text AS content FROM documents)"


def sql_bm25(source: str, prefix: str = "") -> str:
    """CTEs up to `scores` (query_id, chunk_id, bm25) over a chunk relation."""
    return f"""
terms AS (SELECT DISTINCT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM benchmark),
tokened AS (SELECT chunk_id, {sql_tokens('content')} AS t FROM {source}),
totals AS (SELECT count(*) AS n, avg(len(t)) AS avg_length FROM tokened),
posted AS (SELECT chunk_id, length, term, count(*) AS tf FROM (SELECT chunk_id, len(t) AS length, unnest(t) AS term FROM tokened) GROUP BY ALL),
frequency AS (SELECT term, count(*) AS df FROM posted GROUP BY term),
scores AS (
  SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))), {DIGITS}) AS bm25
  FROM terms JOIN posted USING (term) JOIN frequency USING (term), totals GROUP BY query_id, chunk_id
)"""


SQL_VECTORS = f"""
numbered AS (SELECT count(*) AS nv FROM embeddings),
cosines AS (
  SELECT item_id AS query_id, d.doc_id AS chunk_id, round(list_sum(list_transform(range(1, len(c.embedding) + 1), lambda i: c.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)), {DIGITS}) AS cosine,
         list_sum(list_transform(range(1, len(c.embedding) + 1), lambda i: c.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)) AS exact
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id, documents d, numbered JOIN embeddings c ON c.vec_id = d.doc_id % nv
)"""
SQL_FUSED = """
words AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY bm25 DESC) AS bm25_rank FROM scores WHERE bm25 > 0),
sense AS (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY cosine DESC) AS vec_rank FROM cosines),
fused AS (
  SELECT query_id, chunk_id, cosine, vec_rank, coalesce(bm25, 0) AS bm25, coalesce(bm25_rank, 0) AS bm25_rank,
         round(coalesce(1.0::DOUBLE / (60 + vec_rank), 0) + coalesce(1.0::DOUBLE / (60 + bm25_rank), 0), 9) AS rrf
  FROM words FULL JOIN sense USING (query_id, chunk_id)
)"""


@query(f"SELECT page_id, {sql_trim(r'''regexp_replace(regexp_replace(regexp_replace(html, '<[^>]*>', '', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')''')} AS text FROM pages")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.table(spark, sf_dir, "pages").select("page_id", X.clean_text("html").alias("text"))


@query(f"SELECT doc_id, {sql_trim(r'''regexp_replace(array_to_string(list_filter(regexp_split_to_array(text, '\r?\n'), lambda l: NOT regexp_matches(l, '^#{1,6}\s')), chr(10)), '\n{3,}', chr(10) || chr(10), 'g')''')} AS text FROM documents")
def normalize_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.table(spark, sf_dir, "documents").select("doc_id", X.normalise_for_eval("text").alias("text"))


@query(rf"WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '{X.SENTENCE}')) AS s FROM documents) SELECT doc_id, count(*) AS sentences, sum(length(s))::BIGINT AS chars, max(length(s))::INTEGER AS longest FROM s WHERE {sql_trim('s')} <> '' GROUP BY doc_id")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = demo.table(spark, sf_dir, "documents").select("doc_id", F.explode(X.sentences("text")).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.sum(F.length("s")).alias("chars"), F.max(F.length("s")).alias("longest"))


@query(rf"SELECT doc_id, (len(regexp_extract_all(text, '{X.COUNTED_WORD}')) + len(regexp_extract_all(text, '{X.HAN}')))::INTEGER AS tokens, (length(text) + len(regexp_extract_all(text, '[\x{{10000}}-\x{{10FFFF}}]')))::INTEGER AS units FROM documents")
def count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.table(spark, sf_dir, "documents").select("doc_id", X.count_tokens("text").alias("tokens"), X.utf16_length("text").alias("units"))


@query(f"SELECT term, sum(tf)::BIGINT AS tf, count(*) AS df FROM (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) GROUP BY ALL) GROUP BY term")
def tokenize_tf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.postings(demo.corpus(spark, sf_dir)).groupBy("term").agg(F.sum("tf").alias("tf"), F.count("*").alias("df"))


@query("SELECT doc_id, 'doc_' || substr(h, 1, 12) || '5' || substr(h, 14, 3) AS id FROM (SELECT doc_id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('rag-doc:doc' || doc_id || '.md')) AS h FROM documents)")
def doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.table(spark, sf_dir, "documents").select("doc_id", X.document_id(F.concat(F.lit("doc"), "doc_id", F.lit(".md"))).alias("id"))


@query(f"SELECT doc_id, {sql_fnv('text')} AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.table(spark, sf_dir, "documents").select("doc_id", fnv1a32("text").alias("content_hash"))


@query(r"SELECT doc_id, length(text)::INTEGER AS chars, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, chr(10))) END::INTEGER AS lines, len(list_filter(string_split(text, chr(10)), lambda l: trim(l) <> ''))::INTEGER AS non_empty_lines, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::INTEGER AS words FROM documents")
def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return demo.table(spark, sf_dir, "documents").select("doc_id", *X.text_stats("text"))


@query(f"WITH {SQL_CORPUS}, {sql_bm25('corpus')} SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), {DIGITS}) AS idf, n, round(avg_length, {DIGITS}) AS avg_length FROM frequency, totals")
def bm25_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = demo.corpus(spark, sf_dir)
    df = bm25.document_frequencies(bm25.postings(c)).crossJoin(F.broadcast(bm25.totals(c)))
    return df.select("term", "df", F.round(bm25.idf(F.col("n"), F.col("df")), DIGITS).alias("idf"), "n", F.round("avg_length", DIGITS).alias("avg_length"))


def scored(spark: SparkSession, sf_dir: str, corpus: DataFrame | None = None) -> DataFrame:
    return bm25.scores(demo.corpus(spark, sf_dir) if corpus is None else corpus, demo.queries(spark, sf_dir), digits=DIGITS)


@query(f"WITH {SQL_CORPUS}, {sql_bm25('corpus')} SELECT * FROM scores")
def bm25_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir)


def top(rows: DataFrame, score: str, k: int, name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(score), "chunk_id"))).where(F.col(name) <= k)


def first(spark: SparkSession, sf_dir: str, k: int, name: str = "rank", corpus: DataFrame | None = None) -> DataFrame:
    """top() of scored() from the best rows of each task, staged: k rows a query."""
    rows = bm25.best(demo.corpus(spark, sf_dir) if corpus is None else corpus, demo.queries(spark, sf_dir), k, DIGITS)
    return staged(top(rows, "bm25", k, name), "first-hits")


def with_chunks(hits: DataFrame, corpus: DataFrame) -> DataFrame:
    """Staged hits with the columns of their chunks; where the hits are few they are broadcast, and no text is shuffled."""
    return corpus.join(bounded(hits), "chunk_id")


@query(f"WITH {SQL_CORPUS}, {sql_bm25('corpus')} SELECT query_id, chunk_id, bm25, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS rank FROM scores) WHERE rank <= 5")
def bm25_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return first(spark, sf_dir, 5).select("query_id", "chunk_id", "bm25", "rank")


@query(ORACLE_SQL["bm25_top5"])
def bm25_index_top5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM2, BM4 from a standing index of two batches; no text is read for the scores."""
    c, at = demo.corpus(spark, sf_dir), folder(spark, "bm25-index")
    for i in (0, 1):
        bm25_index.add_batch(c.where(F.col("doc_id") % 2 == i), at, i)
    return bm25_index.top_k(spark, at, demo.queries(spark, sf_dir), 5, DIGITS)


@query(f"WITH {SQL_CORPUS}, {sql_bm25('corpus')}, w AS (SELECT query_id, coalesce(df, 0) AS df, ln(1 + (n - coalesce(df, 0) + 0.5) / (coalesce(df, 0) + 0.5)) AS w FROM terms LEFT JOIN frequency USING (term), totals) SELECT query_id, round(sum(CASE WHEN df > 0 THEN w ELSE 0 END) / sum(w), {DIGITS}) AS idf_coverage FROM w GROUP BY query_id")
def idf_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.coverage(demo.corpus(spark, sf_dir), demo.queries(spark, sf_dir)).withColumn("idf_coverage", F.round("idf_coverage", DIGITS))


@query("WITH t AS (SELECT doc_id, unnest(list_distinct(" + sql_tokens("text") + ")) AS term FROM documents) SELECT term, count(*) AS df FROM t GROUP BY term")
def bm25_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM4: statistics of two halves, merged."""
    c = demo.corpus(spark, sf_dir)
    old, new = (bm25.document_frequencies(bm25.postings(c.where(F.col("doc_id") % 2 == i))) for i in (0, 1))
    return bm25.merged_statistics(old, new)


def cosines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.cosine_blocks(demo.chunk_vectors(spark, sf_dir), demo.query_vectors(spark, sf_dir)).withColumn("cosine", F.round("cosine", DIGITS))


@query(f"WITH {SQL_VECTORS} SELECT query_id, chunk_id, cosine, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS rank FROM cosines) WHERE rank <= 10")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(cosines(spark, sf_dir), "cosine", 10)


@query(f"WITH {SQL_VECTORS} SELECT query_id, chunk_id, cosine FROM cosines")
def cosine_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosines(spark, sf_dir)


@query(f"SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), {DIGITS}) AS length FROM embeddings")
def normalised_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VEC2: vectors scaled threefold and normalised again have length 1."""
    e = demo.table(spark, sf_dir, "embeddings").withColumn("v", dense.normalise(F.transform("embedding", lambda x: x * 3)))
    return e.select("vec_id", F.round(F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))), DIGITS).alias("length"))


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = bm25.best(demo.corpus(spark, sf_dir), demo.queries(spark, sf_dir), 1, DIGITS)
    return dense.signals(demo.chunk_vectors(spark, sf_dir), demo.query_vectors(spark, sf_dir), best, digits=5)


SQL_SIGNALS = f"signals AS (SELECT query_id, round(max(exact), 5) AS max_cosine, round(max(exact) - avg(exact), 5) AS cos_gap, round(max(coalesce(bm25, 0)), 5) AS max_bm25 FROM cosines LEFT JOIN scores USING (query_id, chunk_id) GROUP BY query_id)"


@query(f"WITH {SQL_CORPUS}, {sql_bm25('corpus')}, {SQL_VECTORS}, {SQL_SIGNALS} SELECT query_id, max_cosine, cos_gap, max_bm25, ((max_cosine < 0.53)::INTEGER + (cos_gap < 0.0776)::INTEGER)::INTEGER AS fired FROM signals")
def refusal_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals(spark, sf_dir).withColumn("fired", F.size(dense.fired_signals()))


def both_legs(spark: SparkSession, sf_dir: str) -> legs.Legs | None:
    return legs.legs(demo.corpus(spark, sf_dir), demo.queries(spark, sf_dir), DIGITS, demo.chunk_vectors(spark, sf_dir), demo.query_vectors(spark, sf_dir))


def leading(spark: SparkSession, sf_dir: str, k: int, name: str) -> tuple[DataFrame, DataFrame]:
    """top() of fused() from the best rows of each task, staged; and query_id, windows: the number of all its rows."""
    found = both_legs(spark, sf_dir)
    if found is None:
        rows = fused(spark, sf_dir).where("rrf > 0")
        return staged(top(rows, "rrf", k, name), "leading"), rows.groupBy("query_id").agg(F.count("*").alias("windows"))
    rows = legs.fused(found, [PLAIN], top=k).drop("config").where("rrf > 0")
    return staged(top(rows, "rrf", k, name), "leading"), legs.pairs(found).withColumnRenamed("pairs", "windows")


#: vec_weight, bm25_weight and rrf_k of the defaults.
PLAIN = (fusion.Options.vec_weight, fusion.Options.bm25_weight, fusion.Options.rrf_k)


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = both_legs(spark, sf_dir)
    if found is not None:
        return legs.fused(found, [PLAIN]).drop("config")
    return fusion.fuse(cosines(spark, sf_dir), scored(spark, sf_dir)).withColumn("rrf", F.round("rrf", 9))


@query(f"WITH {SQL_CORPUS}, {sql_bm25('corpus')}, {SQL_VECTORS}, {SQL_FUSED} SELECT query_id, chunk_id, vec_rank::INTEGER AS vec_rank, bm25_rank::INTEGER AS bm25_rank, rrf FROM fused")
def rrf_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir).select("query_id", "chunk_id", "vec_rank", "bm25_rank", "rrf")


@query(f"""WITH {SQL_CORPUS}, {sql_bm25('corpus')}, half AS (SELECT item_id, substr(text, 1, (length(text) // 2)::INTEGER) AS text FROM benchmark),
hterms AS (SELECT DISTINCT item_id AS query_id, unnest({sql_tokens('text')}) AS term FROM half),
hscores AS (SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * length / avg_length))), {DIGITS}) AS bm25 FROM hterms JOIN posted USING (term) JOIN frequency USING (term), totals GROUP BY query_id, chunk_id),
legs AS (SELECT query_id, chunk_id, 1.0::DOUBLE AS w, rank() OVER (PARTITION BY query_id ORDER BY bm25 DESC) AS r FROM scores WHERE bm25 > 0 UNION ALL SELECT query_id, chunk_id, 0.7::DOUBLE, rank() OVER (PARTITION BY query_id ORDER BY bm25 DESC) FROM hscores WHERE bm25 > 0)
SELECT query_id, chunk_id, round(sum(w / (60 + r)), 9) AS rrf FROM legs GROUP BY query_id, chunk_id""")
def rrf_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = demo.queries(spark, sf_dir)
    v = evidence.variants(q, q.select("query_id", F.lit(1).alias("variant_no"), F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")).alias("text")))
    keyed = v.withColumn("query_id", F.struct("query_id", "variant_no"))
    found = legs.legs(demo.corpus(spark, sf_dir), keyed, DIGITS)
    if found is not None:
        return legs.variant_sums(found, v, fusion.Options.rrf_k, fusion.Options.bm25_weight).withColumn("rrf", F.round("rrf", 9))
    s = bm25.scores(demo.corpus(spark, sf_dir), keyed, digits=DIGITS).select("query_id.query_id", "query_id.variant_no", "chunk_id", "bm25")
    return fusion.fuse_variants(None, s, v).select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"))


@query(f"""WITH {SQL_LINES}, {sql_bm25('lines')}, hits AS (SELECT s.*, content FROM scores s JOIN lines USING (chunk_id)),
placed AS (SELECT h.*, doc_id, ord, max(bm25) OVER (PARTITION BY query_id, doc_id) AS doc_best FROM hits h JOIN (SELECT chunk_id, doc_id, ord FROM lines) USING (chunk_id)),
best AS (SELECT *, row_number() OVER (PARTITION BY query_id, content ORDER BY bm25 DESC, doc_best DESC, doc_id, ord) AS n FROM placed)
SELECT query_id, chunk_id, bm25, pos::INTEGER AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, doc_best DESC, doc_id, ord) AS pos FROM best WHERE n = 1) WHERE pos <= 20""")
def window_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN3, WIN4 over single lines."""
    c = demo.lines(spark, sf_dir)
    # equal texts score alike, so twenty scores are twenty texts; a document's best line is among them if any of its lines is
    found = staged(bm25.best(c, demo.queries(spark, sf_dir), 20, DIGITS, kinds=True), "best-lines")
    hits = with_chunks(found, c).select("query_id", "chunk_id", "bm25", F.col("bm25").alias("rrf"), "doc_id", F.col("ord").alias("ord_start"), F.col("content").alias("matched"))
    hits = hits.withColumn("doc_rrf", F.max("rrf").over(Window.partitionBy("query_id", "doc_id")))
    return fusion.dedupe(hits).where("pos <= 20").select("query_id", "chunk_id", "bm25", "pos")


def sql_joined(texts: str) -> str:
    """Texts of a list one after another without overlaps."""
    return f"list_reduce({texts}, lambda a, b: a || substr(b, (1 + coalesce(list_max(list_filter(range(1, least(length(a), length(b)) + 1), lambda n: suffix(a, substr(b, 1, n::INTEGER)))), 0))::INTEGER))"


# hits: query_id, chunk_id, cosine, vec_rank, bm25, bm25_rank, rrf of lines. A fold over a document's hits numbers its windows.
SQL_BARE_WINDOWS = """
placed AS (SELECT h.*, doc_id, ord, content FROM hits h JOIN (SELECT chunk_id, doc_id, ord, content FROM lines) USING (chunk_id) WHERE rrf > 0),
listed AS (SELECT query_id, doc_id, max(rrf) AS doc_rrf, list({'ord': ord::BIGINT, 'chars': length(content)::BIGINT, 'no': []::BIGINT[]} ORDER BY ord) AS l FROM placed GROUP BY query_id, doc_id),
numbers AS (SELECT query_id, doc_id, doc_rrf, list_transform(l, lambda x: x.ord) AS ords, list_reduce(list_concat([{'ord': -9::BIGINT, 'chars': 0::BIGINT, 'no': [0]::BIGINT[]}], l),
  lambda a, x: {'ord': x.ord, 'chars': CASE WHEN x.ord = a.ord + 1 AND a.chars + x.chars <= 1200 THEN a.chars ELSE 0 END + x.chars, 'no': list_append(a.no, CASE WHEN x.ord = a.ord + 1 AND a.chars + x.chars <= 1200 THEN a.no[-1] ELSE a.no[-1] + 1 END)}).no AS no FROM listed),
numbered AS (SELECT query_id, doc_id, doc_rrf, unnest(ords) AS ord, unnest(no[2:]) AS no FROM numbers),
bare AS (SELECT query_id, doc_id, doc_rrf, no, min(ord) AS ord_start, max(ord) AS ord_end, max(rrf) AS rrf, max(cosine) AS cosine, arg_max(chunk_id, (rrf, -ord)) AS best_chunk, max(bm25) AS bm25, coalesce(min(bm25_rank) FILTER (bm25_rank > 0), 0) AS bm25_rank
  FROM numbered JOIN placed USING (query_id, doc_id, ord) GROUP BY query_id, doc_id, doc_rrf, no),
spans AS (SELECT DISTINCT doc_id, ord_start, ord_end FROM bare),"""
SQL_TEXTS = f"""
texts AS (SELECT s.doc_id, ord_start, ord_end, {sql_joined('list(content ORDER BY ord)')} AS matched FROM spans s JOIN lines l ON l.doc_id = s.doc_id AND l.ord BETWEEN ord_start AND ord_end GROUP BY ALL)"""
SQL_KEYWORD_HITS = "hits AS (SELECT query_id, chunk_id, NULL::DOUBLE AS cosine, bm25, bm25_rank, round(1.0::DOUBLE / (60 + bm25_rank), 9) AS rrf FROM (SELECT *, rank() OVER (PARTITION BY query_id ORDER BY bm25 DESC) AS bm25_rank FROM scores WHERE bm25 > 0)),"


def keyword_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(None, scored(spark, sf_dir, demo.lines(spark, sf_dir))).withColumn("rrf", F.round("rrf", 9))


@query(f"WITH {SQL_LINES}, {sql_bm25('lines')}, {SQL_KEYWORD_HITS} {SQL_BARE_WINDOWS} {SQL_TEXTS} SELECT query_id, doc_id, ord_start::INTEGER AS ord_start, ord_end::INTEGER AS ord_end, rrf, bm25, bm25_rank::INTEGER AS bm25_rank, matched FROM bare JOIN texts USING (doc_id, ord_start, ord_end)")
def merged_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN1, WIN2 over lines, keyword leg only."""
    found = legs.legs(demo.lines(spark, sf_dir), demo.queries(spark, sf_dir), DIGITS)
    if found is not None:
        return legs.keyword_windows(found, demo.document_lines(spark, sf_dir), fusion.Options.max_window_chars, fusion.Options.rrf_k, fusion.Options.bm25_weight)
    found = fusion.windows(keyword_hits(spark, sf_dir), demo.lines(spark, sf_dir))
    return found.select("query_id", "doc_id", F.col("ord_start").cast("int").alias("ord_start"), F.col("ord_end").cast("int").alias("ord_end"), "rrf", "bm25", "bm25_rank", "matched")


SQL_POOL = """
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, chunk_id) AS pos FROM fused WHERE rrf > 0) WHERE pos <= 20),
refused AS (SELECT query_id FROM signals WHERE max_cosine < 0.53 OR cos_gap < 0.0776),
passed AS (SELECT *, max(rrf) OVER (PARTITION BY query_id) AS best FROM pool WHERE coalesce(cosine, 0) >= 0.5 AND query_id NOT IN (SELECT query_id FROM refused)),
kept AS (SELECT *, least(1.0::DOUBLE, cosine + CASE WHEN bm25_rank > 0 THEN 0.05 ELSE 0 END) AS relevance FROM passed WHERE rrf >= best * 0.4)"""


def gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pool, every = leading(spark, sf_dir, 20, "pos")
    asked = dense.signals(demo.chunk_vectors(spark, sf_dir), demo.query_vectors(spark, sf_dir), digits=5)
    return fusion.gate(pool, demo.queries(spark, sf_dir), asked, windows=every)


@query(f"WITH {SQL_CORPUS}, {sql_bm25('corpus')}, {SQL_VECTORS}, {SQL_SIGNALS}, {SQL_FUSED}, {SQL_POOL} SELECT query_id, chunk_id, round(relevance, {DIGITS}) AS relevance, rrf, pos::INTEGER AS pos FROM kept")
def gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir)[0].select("query_id", "chunk_id", F.round("relevance", DIGITS).alias("relevance"), "rrf", "pos")


@query(f"WITH {SQL_CORPUS}, {sql_bm25('corpus')}, {SQL_VECTORS}, {SQL_SIGNALS}, {SQL_FUSED}, {SQL_POOL} SELECT item_id AS query_id, coalesce(k, 0) AS hits, CASE WHEN k IS NULL THEN coalesce(w, 0) ELSE p - k END AS dropped, k IS NULL AS no_relevant_hit FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS w FROM fused WHERE rrf > 0 GROUP BY 1) c ON c.query_id = item_id LEFT JOIN (SELECT query_id, count(*) AS k FROM kept GROUP BY 1) a ON a.query_id = item_id LEFT JOIN (SELECT query_id, count(*) AS p FROM pool GROUP BY 1) b ON b.query_id = item_id")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gated(spark, sf_dir)[1]


LAMBDA = 0.7


def sql_mmr(pool: str, limit: int, lam: float) -> str:
    """CTEs up to `picked`: from pool (query_id, place, relevance, best_chunk) and vectors_of (chunk_id, v), one pick after another."""
    near = "list_sum(list_transform(range(1, 65), lambda i: a.v[i]::DOUBLE * b.v[i]::DOUBLE))"
    out = [f"near AS (SELECT x.query_id, x.place AS p, y.place AS q, {near} AS s FROM {pool} x JOIN {pool} y USING (query_id) JOIN vectors_of a ON a.chunk_id = x.best_chunk JOIN vectors_of b ON b.chunk_id = y.best_chunk)", "step0 AS (SELECT NULL::BIGINT AS query_id, NULL::BIGINT AS place, 0 AS pick WHERE false)"]
    for i in range(1, limit + 1):
        score = f"{lam}::DOUBLE * relevance - {1 - lam}::DOUBLE * greatest(0.0::DOUBLE, coalesce((SELECT max(s) FROM near n JOIN step{i - 1} t ON t.query_id = n.query_id AND t.place = n.q WHERE n.query_id = k.query_id AND n.p = k.place), 0.0::DOUBLE))"
        left = f"SELECT query_id, place, {score} AS score FROM {pool} k WHERE NOT EXISTS (SELECT 1 FROM step{i - 1} t WHERE t.query_id = k.query_id AND t.place = k.place)"
        out.append(f"step{i} AS (SELECT * FROM step{i - 1} UNION ALL SELECT query_id, arg_max(place, (score, -place)) AS place, {i} AS pick FROM ({left}) GROUP BY query_id)")
    return ", ".join([*out, f"picked AS (SELECT k.*, t.pick FROM {pool} k JOIN step{limit} t USING (query_id, place))"])


@query(f"""WITH {SQL_VECTORS}, first AS (SELECT * FROM (SELECT query_id, chunk_id AS best_chunk, cosine AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, chunk_id) AS place FROM cosines) WHERE place <= 20),
vectors_of AS (SELECT chunk_id, embedding AS v FROM (SELECT DISTINCT best_chunk AS chunk_id FROM first), numbered JOIN embeddings ON vec_id = chunk_id % nv), {sql_mmr('first', 5, LAMBDA)}
SELECT query_id, best_chunk AS chunk_id, relevance, pick::INTEGER AS pick FROM picked""")
def mmr_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MMR1 with lambda 0.7 over the best twenty by cosine."""
    pool = top(cosines(spark, sf_dir), "cosine", 20, "place").withColumn("relevance", F.col("cosine")).withColumn("best_chunk", F.col("chunk_id"))
    return fusion.mmr(pool, 5, 0.7, demo.chunk_vectors(spark, sf_dir)).select("query_id", "chunk_id", "relevance", "pick")


SQL_FIRST_LINES = f"{SQL_LINES}, {sql_bm25('lines')}, hits AS (SELECT * FROM (SELECT s.*, doc_id, ord, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, s.chunk_id) AS rank FROM scores s JOIN lines USING (chunk_id)) WHERE rank <= 5)"


@query(f"""WITH {SQL_FIRST_LINES},
near AS (SELECT h.query_id, h.rank, h.doc_id, h.ord, max(length(l.content)) FILTER (l.ord = h.ord) AS c0, max(length(l.content)) FILTER (l.ord = h.ord - 1) AS c1, max(length(l.content)) FILTER (l.ord = h.ord + 1) AS c2
         FROM hits h JOIN lines l ON l.doc_id = h.doc_id AND l.ord BETWEEN h.ord - 1 AND h.ord + 1 GROUP BY ALL),
cut AS (SELECT *, c1 IS NOT NULL AND coalesce(c1, 0) + c0 + coalesce(c2, 0) <= 1200 AS keep1 FROM near)
SELECT query_id, rank::INTEGER AS rank, doc_id, (ord - keep1::INTEGER)::INTEGER AS window_start,
       (ord + (c2 IS NOT NULL AND c0 + coalesce(c2, 0) + CASE WHEN keep1 THEN c1 ELSE 0 END <= 1200)::INTEGER)::INTEGER AS window_end FROM cut""")
def context_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CTX1 around each query's five best lines."""
    c = demo.lines(spark, sf_dir)
    hits = with_chunks(first(spark, sf_dir, 5, corpus=c), c.select("chunk_id", "doc_id", "ord")).select("query_id", "rank", "doc_id", F.col("ord").alias("ord_start"), F.col("ord").alias("ord_end"))
    return fusion.expand(hits, c).select("query_id", "rank", "doc_id", "window_start", "window_end")


# from bare windows to the pool of the first twenty different texts
SQL_CANDIDATES = f"""{SQL_BARE_WINDOWS} {SQL_TEXTS},
firsts AS (SELECT *, row_number() OVER (PARTITION BY query_id, matched ORDER BY rrf DESC, doc_rrf DESC, doc_id, ord_start) AS n FROM bare JOIN texts USING (doc_id, ord_start, ord_end)),
pool AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_rrf DESC, doc_id, ord_start) AS pos FROM firsts WHERE n = 1) WHERE pos <= 20)"""
# of the picked windows: a neighbour on either side while all have at most 1200 characters, given up on the left first
SQL_EXPANDED = f"""
sides AS (SELECT p.query_id, p.pick, p.doc_id, p.ord_start, p.ord_end, sum(length(l.content)) FILTER (l.ord BETWEEN p.ord_start AND p.ord_end) AS c0, max(length(l.content)) FILTER (l.ord = p.ord_start - 1) AS c1, max(length(l.content)) FILTER (l.ord = p.ord_end + 1) AS c2
  FROM picked p JOIN lines l ON l.doc_id = p.doc_id AND l.ord BETWEEN p.ord_start - 1 AND p.ord_end + 1 GROUP BY ALL),
cut AS (SELECT *, c1 IS NOT NULL AND coalesce(c1, 0) + c0 + coalesce(c2, 0) <= 1200 AS keep1 FROM sides),
grown AS (SELECT *, (ord_start - keep1::INTEGER)::INTEGER AS window_start, (ord_end + (c2 IS NOT NULL AND c0 + coalesce(c2, 0) + CASE WHEN keep1 THEN c1 ELSE 0 END <= 1200)::INTEGER)::INTEGER AS window_end FROM cut),
expanded AS (SELECT g.query_id, g.pick, g.window_start, g.window_end, {sql_joined('list(content ORDER BY ord)')} AS content FROM grown g JOIN lines l ON l.doc_id = g.doc_id AND l.ord BETWEEN window_start AND window_end GROUP BY ALL)"""


@query(f"""WITH {SQL_LINES}, {sql_bm25('lines')}, {SQL_KEYWORD_HITS} {SQL_CANDIDATES},
passed AS (SELECT *, max(rrf) OVER (PARTITION BY query_id) AS best FROM pool WHERE bm25_rank BETWEEN 1 AND 3),
picked AS (SELECT * FROM (SELECT *, greatest(0, 0.6::DOUBLE - (bm25_rank - 1) * 0.05::DOUBLE) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS pick FROM passed WHERE rrf >= best * 0.4) WHERE pick <= 5), {SQL_EXPANDED}
SELECT query_id, pick::INTEGER AS pick, doc_id, window_start, window_end, round(relevance, {DIGITS}) AS relevance, rrf, content FROM picked JOIN expanded USING (query_id, pick)""")
def retrieve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP1 over lines, keyword leg only (VEC4)."""
    c, q = demo.lines(spark, sf_dir), demo.queries(spark, sf_dir)
    rows = fusion.retrieve_pool(c, q, fusion.keyword_candidates(c, q, digits=DIGITS), None, None)[0]
    return shown(rows)


def shown(rows: DataFrame) -> DataFrame:
    whole = [F.col(c).cast("int").alias(c) for c in ("window_start", "window_end")]
    return rows.select("query_id", "pick", "doc_id", *whole, F.round("relevance", DIGITS).alias("relevance"), "rrf", "content")


SQL_LINE_LEGS = f"""
numbered_vectors AS (SELECT count(*) AS nv FROM embeddings),
cosines AS (SELECT item_id AS query_id, chunk_id, round(list_sum(list_transform(range(1, 65), lambda i: c.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)), {DIGITS}) AS cosine,
         list_sum(list_transform(range(1, 65), lambda i: c.embedding[i]::DOUBLE * q.embedding[i]::DOUBLE)) AS exact
  FROM benchmark JOIN embeddings q ON q.vec_id = item_id, lines, numbered_vectors JOIN embeddings c ON c.vec_id = chunk_id % nv),
signals AS (SELECT query_id, round(max(exact), 5) AS max_cosine, round(max(exact) - avg(exact), 5) AS cos_gap FROM cosines GROUP BY query_id), {SQL_FUSED},
hits AS (SELECT * FROM fused),"""
SQL_HYBRID = f"""WITH {SQL_LINES}, {sql_bm25('lines')}, {SQL_LINE_LEGS} {SQL_CANDIDATES},
refused AS (SELECT query_id FROM signals WHERE max_cosine < 0.53 OR cos_gap < 0.0776),
passed AS (SELECT *, max(rrf) OVER (PARTITION BY query_id) AS best FROM pool WHERE coalesce(cosine, 0) >= 0.5 AND query_id NOT IN (SELECT query_id FROM refused)),
kept AS (SELECT *, least(1.0::DOUBLE, cosine + CASE WHEN bm25_rank > 0 THEN 0.05::DOUBLE ELSE 0 END) AS relevance, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS place FROM passed WHERE rrf >= best * 0.4)"""

def hybrid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """TOP1 with both legs, the refusal gates and MMR at LAMBDA."""
    c, q = demo.lines(spark, sf_dir), demo.query_vectors(spark, sf_dir)
    vectors, options = demo.line_vectors(spark, sf_dir), fusion.with_overrides(fusion.Options(), mmr_lambda=LAMBDA)
    found = legs.legs(c, demo.queries(spark, sf_dir), DIGITS, vectors, q, ("doc_id",))
    if found is not None:
        pool, seen = fusion.hybrid_candidates(found, c, options)
        held = found.rows.where("_in").select("chunk_id", "vector")
        asked = dense.signals(held, q, digits=5)
        return fusion.retrieve_pool(c, demo.queries(spark, sf_dir), pool, seen, asked, options, held.join(bounded(pool.select(F.col("best_chunk").alias("chunk_id")).distinct()), "chunk_id", "left_semi"))
    vec = staged(dense.cosine_blocks(vectors, q).withColumn("cosine", F.round("cosine", DIGITS)), "line-cosines")
    both = fusion.fuse(vec, scored(spark, sf_dir, c)).withColumn("rrf", F.round("rrf", 9))
    return fusion.retrieve(c, demo.queries(spark, sf_dir), both, dense.signals(vectors, q, digits=5), options, vectors)


@query(f"""{SQL_HYBRID}, vectors_of AS (SELECT chunk_id, embedding AS v FROM (SELECT DISTINCT best_chunk AS chunk_id FROM kept), numbered_vectors JOIN embeddings ON vec_id = chunk_id % nv), {sql_mmr('kept', 5, LAMBDA)}, {SQL_EXPANDED}
SELECT query_id, pick::INTEGER AS pick, doc_id, window_start, window_end, round(relevance, {DIGITS}) AS relevance, rrf, content FROM picked JOIN expanded USING (query_id, pick)""")
def retrieve_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP1, GAT1-GAT3, MMR1, CTX1 over lines with both legs."""
    return shown(hybrid(spark, sf_dir)[0])


@query(f"{SQL_HYBRID} SELECT item_id AS query_id, coalesce(k, 0) AS hits, CASE WHEN k IS NULL THEN coalesce(w, 0) ELSE p - k END AS dropped, k IS NULL AS no_relevant_hit FROM benchmark LEFT JOIN (SELECT query_id, count(*) AS k FROM kept GROUP BY 1) a ON a.query_id = item_id LEFT JOIN (SELECT query_id, count(*) AS p FROM pool GROUP BY 1) b ON b.query_id = item_id LEFT JOIN (SELECT query_id, count(*) AS w FROM bare GROUP BY 1) c ON c.query_id = item_id")
def retrieve_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GAT3: admitted and dropped windows of retrieve_hybrid."""
    return hybrid(spark, sf_dir)[1]


@query(f"""WITH {SQL_LINES}, {sql_bm25('lines')}, {SQL_KEYWORD_HITS} {SQL_CANDIDATES},
picked AS (SELECT *, pos AS pick, greatest(0, 0.6::DOUBLE - (bm25_rank - 1) * 0.05::DOUBLE) AS relevance FROM pool WHERE pos <= 10), {SQL_EXPANDED}
SELECT query_id, pick::INTEGER AS pick, doc_id, ord_start::INTEGER AS ord_start, ord_end::INTEGER AS ord_end, substr(e.content, 1, 1200) AS content, round(rrf, 4) AS rrf, NULL::DOUBLE AS cosine, round(bm25, 4) AS bm25, round(CASE WHEN bm25_rank > 0 THEN relevance ELSE 0 END, 4) AS relevance FROM picked JOIN expanded e USING (query_id, pick)""")
def search_kb(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TOP2 over lines."""
    c = demo.lines(spark, sf_dir)
    rows = fusion.search_pool(c, fusion.keyword_candidates(c, demo.queries(spark, sf_dir), digits=DIGITS), 10)
    return rows.withColumns({c: F.col(c).cast("int") for c in ("ord_start", "ord_end")})


@query(f"""WITH {SQL_CORPUS}, {sql_bm25('corpus')}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) AS pos FROM scores) WHERE pos <= 10),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(1 / (1 + exp(-((chunk_id % 17) - 8))), 9) DESC, pos) AS rerank_pos FROM first)
SELECT query_id, chunk_id, pos::INTEGER AS pos, rerank_pos::INTEGER AS rerank_pos FROM ranked""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RRK1, RRK3 with scores made from the ids."""
    ten = first(spark, sf_dir, 10, "pos")
    s = ten.select("query_id", "chunk_id", (F.col("chunk_id") % 17 - 8).cast("double").alias("logit"))
    return fusion.rerank(ten.withColumn("chunk_ids", F.array("chunk_id")), s).select("query_id", "chunk_id", "pos", "rerank_pos")


@query(ORACLE_SQL["rerank"].rsplit("SELECT query_id, chunk_id", 1)[0] + "SELECT query_id, max(CASE WHEN rerank_pos = 1 THEN pos END) <> 1 AS top_changed, count(*) FILTER (rerank_pos <= 5 AND pos <= 5)::INTEGER AS overlap FROM ranked GROUP BY query_id")
def rerank_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.rerank_effect(rerank(spark, sf_dir))


@query(f"WITH {SQL_CORPUS}, {sql_bm25('corpus')} SELECT query_id, count(bm25) > 1 AND max(bm25) - min(bm25) < 1e-6 AS degenerate FROM scores GROUP BY query_id")
def degenerate_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.degenerate_ends(bm25.extremes(demo.corpus(spark, sf_dir), demo.queries(spark, sf_dir), DIGITS))


@query(f"WITH corpus AS (SELECT doc_id AS chunk_id, text AS content FROM documents WHERE doc_id % 3 <= 1 AND (doc_id % 3 = 0 OR source IN ('src0', 'src3'))), {sql_bm25('corpus')} SELECT * FROM scores")
def acl_view_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1 before BM1: statistics are those of what is visible."""
    seen = acl.visible(demo.owned(spark, sf_dir), "default", ["src0", "src3"], 1)
    return scored(spark, sf_dir, seen.select(F.col("doc_id").alias("chunk_id"), "content"))


SQL_VIEWS = "views(view_no, department, clearance) AS (VALUES (1, 'src1', 1), (2, 'src2', 2))"


@query(f"WITH {SQL_VIEWS}, seen AS (SELECT view_no, doc_id, text FROM documents, views WHERE doc_id % 3 <= clearance AND (doc_id % 3 = 0 OR source = department)) SELECT view_no, count(*) AS n, round(avg(len({sql_tokens('text')})), {DIGITS}) AS avg_length FROM seen GROUP BY view_no")
def acl_many_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT1, BM5: totals of each view."""
    who = spark.createDataFrame([(1, "default", ["src1"], 1), (2, "default", ["src2"], 2)], "identity_id int, tenant string, departments array<string>, clearance int")
    seen, names = acl.views(demo.owned(spark, sf_dir), who)
    c = demo.owned(spark, sf_dir).select(F.col("doc_id").alias("chunk_id"), "content")
    stats = bm25.totals(seen.join(c, seen.doc_id == c.chunk_id).drop("doc_id"), ("view_id",))
    return stats.join(names, "view_id").select(F.col("identity_id").alias("view_no"), "n", F.round("avg_length", DIGITS).alias("avg_length"))


@query("SELECT doc_id FROM documents WHERE doc_id % 2 = 0 AND (doc_id % 4 <> 0 OR source = 'src4')")
def acl_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FLT2 in strict mode: only even documents are listed, every second of them with its department."""
    d = demo.table(spark, sf_dir, "documents")
    entries = d.where("doc_id % 2 = 0").select("doc_id", F.lit(None).cast("string").alias("tenant"), F.when(F.col("doc_id") % 4 == 0, F.col("source")).alias("department"), F.lit(None).cast("int").alias("classification"))
    return acl.visible_by_file(d.select("doc_id"), entries, None, ["src4"], None, strict=True)


@query("SELECT count(DISTINCT text) AS distinct_texts, count(DISTINCT text) FILTER (text IN (SELECT text FROM documents WHERE doc_id % 2 = 0)) AS cached, count(DISTINCT text) FILTER (text NOT IN (SELECT text FROM documents WHERE doc_id % 2 = 0)) AS encoded FROM documents")
def vector_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX2: the even documents' texts are in the cache."""
    c = demo.corpus(spark, sf_dir).withColumn("content_hash", F.sha2("content", 256))
    cache = c.where("doc_id % 2 = 0").select("content_hash", F.lit("m").alias("model"), F.lit("p").alias("scheme"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    return index.reuse_vectors(c, cache, dense.hashed_embedder(), "m", "p")[2]


@query()
def hashed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UDF2 over distinct texts."""
    c = demo.corpus(spark, sf_dir).withColumn("content_hash", F.sha2("content", 256))
    cache = c.limit(0).select("content_hash", F.lit("m").alias("model"), F.lit("p").alias("scheme"), F.array(F.lit(1.0).cast("float")).alias("vector"))
    return index.reuse_vectors(c, cache, dense.hashed_embedder(), "m", "p")[0]


@query("SELECT doc_id, doc_id % 3 = 0 AS unchanged FROM documents")
def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX1: a third of the documents are held as they are, a third with other content."""
    d = demo.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("content_hash"))
    held = d.where("doc_id % 3 = 0").unionByName(d.where("doc_id % 3 = 1").withColumn("content_hash", F.lit("other")))
    return index.unchanged(d, held).select("doc_id", F.lit(True).alias("unchanged")).unionByName(index.changed(d, held).select("doc_id", F.lit(False).alias("unchanged")))


@query("SELECT source, count(*) AS total, count(*) FILTER (doc_id % 5 < 2) AS kept, count(*) FILTER (doc_id % 5 >= 2) AS fresh FROM documents GROUP BY source")
def replaced_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX3: of one version the chunks of three documents in five are replaced."""
    d = demo.table(spark, sf_dir, "documents").select("doc_id", "source", F.lit("v1").alias("index_version"), F.lit(False).alias("new"))
    out = index.replace_chunks(d, d.where("doc_id % 5 >= 2").withColumn("new", F.lit(True)))
    return out.groupBy("source").agg(F.count("*").alias("total"), F.count_if(~F.col("new")).alias("kept"), F.count_if("new").alias("fresh"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY md5(text) ORDER BY (doc_id % 7 <> 0) DESC, n_chars DESC, doc_id) > 1 AS retired, first_value(doc_id) OVER (PARTITION BY md5(text) ORDER BY (doc_id % 7 <> 0) DESC, n_chars DESC, doc_id) AS kept_id FROM documents")
def merged_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX4: equal texts stand for equal names."""
    d = demo.table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("doc_name"), F.when(F.col("doc_id") % 7 == 0, F.lit(1)).alias("deleted_at"), F.col("n_chars").alias("created_at"))
    return index.merged_ids(d).select("doc_id", "retired", "kept_id")


@query(f"SELECT conv_id, turn, CASE WHEN ('0x' || {sql_fnv('''(conv_id || ':' || turn)''')})::BIGINT % 1000 < 250 THEN 'v3' ELSE 'v2' END AS index_version FROM conversations")
def canary_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX6, IDX7: a quarter of the turns goes to the newest version."""
    versions = spark.createDataFrame([("v1", "stale", 1, 1, 1.0), ("v2", "ready", 2, 2, 1.0), ("v3", "ready", 3, 3, 0.25)], "version string, state string, created_at int, activated_at int, traffic_ratio double")
    c = demo.table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("query_id"))
    return index.route(c, versions).select("conv_id", "turn", "index_version")


@query("SELECT count(*) AS total, count(*) FILTER (doc_id % 4 = 1) AS done, count(*) FILTER (doc_id % 4 <> 1) AS pending FROM documents")
def rebuild_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = demo.table(spark, sf_dir, "documents").select("doc_id")
    return index.progress(d, d.where("doc_id % 4 = 1"))


@query(f"WITH {SQL_LINES} SELECT doc_id, count(*) AS chunks FROM lines GROUP BY doc_id")
def document_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.list_documents(demo.lines(spark, sf_dir))


@query("""WITH c AS (SELECT conv_id AS doc_id, turn AS ord, role AS heading, (turn // 2)::BIGINT AS page FROM conversations),
f AS (SELECT *, CASE WHEN lag(heading) OVER w IS NOT DISTINCT FROM heading AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS run FROM f)
SELECT doc_id, run::BIGINT AS run, heading, min(ord) AS ord_start, max(ord) AS ord_end, min(page) AS page_start, max(page) AS page_end, count(*) AS chunks FROM r GROUP BY doc_id, run, heading""")
def outline_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = demo.messages(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("role").alias("heading"), F.floor(F.col("turn") / 2).alias("page"))
    return index.outline(c)


@query("""WITH b AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations GROUP BY conv_id),
r AS (SELECT c.*, lo, hi, greatest(1, lo) AS a, least(5, hi) AS z, row_number() OVER w AS n, sum(length(text)) OVER w AS s FROM conversations c JOIN b USING (conv_id) WHERE turn BETWEEN greatest(1, lo) AND least(5, hi) WINDOW w AS (PARTITION BY c.conv_id ORDER BY turn))
SELECT conv_id AS request_id, substr(string_agg(text, chr(10) ORDER BY turn), 1, 6000) AS content, count(*) AS chunks, count(*) < max(z - a + 1) AS cut, 1 < max(lo) AS clamped_low, 5 > max(hi) AS clamped_high
FROM r WHERE n <= 8 AND (s <= 6000 OR n = 1) GROUP BY conv_id""")
def read_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = demo.messages(spark, sf_dir).select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("text").alias("content"))
    asked = c.select(F.col("doc_id").alias("request_id"), "doc_id", F.lit(1).alias("low"), F.lit(5).alias("high")).distinct()
    return index.read_range(c, asked)


SQL_REFERENCES = "named AS (SELECT doc_id::VARCHAR AS doc_id, 'doc' || doc_id || '.md' AS doc_name FROM documents), refs AS (SELECT CASE doc_id::BIGINT % 5 WHEN 0 THEN doc_name WHEN 1 THEN doc_id WHEN 2 THEN upper(substr(doc_name, 2)) WHEN 3 THEN doc_id || '.md' ELSE right(doc_id, 2) END AS reference FROM named)"


@query(f"""WITH {SQL_REFERENCES}, part AS (SELECT reference, min(d.doc_id) AS doc_id FROM (SELECT DISTINCT reference FROM refs) JOIN named d ON contains(lower(doc_name), lower(reference)) GROUP BY reference HAVING count(*) = 1)
SELECT r.reference, coalesce(n.doc_id, i.doc_id, p.doc_id) AS doc_id FROM refs r LEFT JOIN named n ON n.doc_name = r.reference LEFT JOIN named i ON i.doc_id = r.reference LEFT JOIN part p ON p.reference = r.reference""")
def resolve_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IDX13 by name, by id and by parts of names, of which some are not unique."""
    d = demo.table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("doc"), "doc_id", F.lit(".md")).alias("doc_name"))
    turn = F.col("doc_id").cast("long") % 5
    forms = F.when(turn == 0, F.col("doc_name")).when(turn == 1, F.col("doc_id")).when(turn == 2, F.upper(F.substring("doc_name", 2, 100))).when(turn == 3, F.concat("doc_id", F.lit(".md"))).otherwise(F.right("doc_id", F.lit(2)))
    return index.resolve_reference(d.select(forms.alias("reference")), d)


@query()
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK1, CHK2."""
    return demo.chunks(spark, sf_dir)


@query()
def chunk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK4."""
    docs = chunking.text_blocks(demo.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunking.summary(docs, chunking.chunk_documents(docs))


@query()
def chunk_size_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CHK3."""
    docs = chunking.text_blocks(demo.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return chunking.sweep_sizes(docs, [128, 160, 192, 256, 320, 384, 448])


@query()
def markdown_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TXT4 over documents whose every fifth line is made a heading."""
    marked = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("# "), x)).otherwise(x)), "\n")
    d = demo.table(spark, sf_dir, "documents").select("doc_id", marked.alias("text"))
    return chunking.markdown_blocks(d).select("doc_id", F.posexplode("blocks").alias("n", "b")).select("doc_id", "n", "b.*")


@query("SELECT item_id AS query_id, 1 AS variant_no, trim(substr(replace(text, chr(10), ' '), 1, 30)) AS text FROM benchmark WHERE length(trim(substr(text, 1, 30))) > 0")
def rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EXP1: two equal lines with marks, of which one rewrite is left."""
    head = F.trim(F.substring(F.regexp_replace("text", "\n", " "), 1, 30))
    raw = demo.queries(spark, sf_dir).select("query_id", F.col("text").alias("question"), F.concat(F.lit("1. "), head, F.lit("\n- "), head, F.lit("\n")).alias("raw"))
    return evidence.parse_rewrites(raw)


@query(f"WITH {SQL_FIRST_LINES} SELECT query_id, string_agg('[' || rank || '] doc' || doc_id || ' · 正文 · P' || ord || chr(10) || content, chr(10) || chr(10) ORDER BY rank) AS context FROM hits JOIN (SELECT chunk_id, content FROM lines) USING (chunk_id) GROUP BY query_id")
def evidence_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVI1, EVI2, EVI4 over each query's five best lines."""
    c = demo.lines(spark, sf_dir)
    hits = with_chunks(first(spark, sf_dir, 5, corpus=c), c).select("query_id", "rank", F.concat(F.lit("doc"), "doc_id").alias("doc_name"), F.array().cast("array<string>").alias("heading_path"), F.col("ord").alias("page_start"), F.col("ord").alias("page_end"), F.col("content").alias("text"))
    return evidence.prompt_context(evidence.evidence(hits, ["rank"]))


@query(f"WITH {SQL_FIRST_LINES} SELECT item_id AS query_id, coalesce(a, '文档中没有找到相关内容。') AS answer FROM benchmark LEFT JOIN (SELECT query_id, string_agg('[' || rank || '] ' || substr(content, 1, 500), chr(10) ORDER BY rank) AS a FROM hits JOIN (SELECT chunk_id, content FROM lines) USING (chunk_id) GROUP BY query_id) ON query_id = item_id")
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVI7."""
    c = demo.lines(spark, sf_dir)
    hits = with_chunks(first(spark, sf_dir, 5, corpus=c), c).select("query_id", F.col("rank").alias("index"), F.col("content").alias("text"))
    return evidence.extractive_answer(demo.queries(spark, sf_dir), hits)


@query("SELECT conv_id, turn, place::INTEGER AS place FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS place FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS n FROM conversations) WHERE n = 1) WHERE place <= 12")
def collected_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """EVI6: turns stand for hits of a run."""
    hits = demo.messages(spark, sf_dir).select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), F.col("text").alias("content"))
    return evidence.collect_hits(hits).select(F.col("run_id").alias("conv_id"), F.col("seq").alias("turn"), "place")
