"""IDX1-IDX13: the versioned chunk index as table operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.hashing import fnv1a32
from corpusloom.operators.shared import staged


def unchanged(incoming: DataFrame, catalogue: DataFrame) -> DataFrame:
    """IDX1: incoming documents whose (doc_id, content_hash) is already held."""
    return incoming.join(catalogue.select("doc_id", "content_hash").distinct(), ["doc_id", "content_hash"], "left_semi")


def changed(incoming: DataFrame, catalogue: DataFrame) -> DataFrame:
    return incoming.join(catalogue.select("doc_id", "content_hash").distinct(), ["doc_id", "content_hash"], "left_anti")


def reuse_vectors(chunks: DataFrame, cache: DataFrame, embed, model: str, scheme: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """IDX2: (chunk_id, content_hash, vector), the fresh cache rows, and one row of counts.

    Texts are made distinct by hash before the cache is asked, so that boilerplate found in many documents is one row
    and is encoded once. embed: content column to vector column.
    """
    known = cache.where((F.col("model") == model) & (F.col("scheme") == scheme)).select("content_hash", "vector").dropDuplicates(["content_hash"])
    wanted = chunks.select("content_hash", "content").dropDuplicates(["content_hash"])
    fresh = wanted.join(known, "content_hash", "left_anti").withColumn("vector", embed(F.col("content"), F.lit("passage"))).select("content_hash", F.lit(model).alias("model"), F.lit(scheme).alias("scheme"), "vector")
    every = known.join(wanted, "content_hash", "left_semi").unionByName(fresh.select("content_hash", "vector"))
    counts = wanted.join(known.select("content_hash", F.lit(1).alias("hit")), "content_hash", "left").agg(F.count("*").alias("distinct_texts"), F.count("hit").alias("cached"), F.count_if(F.col("hit").isNull()).alias("encoded"))
    return chunks.select("chunk_id", "content_hash").join(every, "content_hash"), fresh, counts


def replace_chunks(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """IDX3: the index with the fresh documents' chunks in place of their old ones, in their version only."""
    return index.join(fresh.select("doc_id", "index_version").distinct(), ["doc_id", "index_version"], "left_anti").unionByName(fresh)


def merged_ids(documents: DataFrame) -> DataFrame:
    """IDX4: of each name the living, newest row is kept; `retired` marks the rest, `kept_id` the row they go to."""
    order = Window.partitionBy("doc_name").orderBy(F.col("deleted_at").isNull().desc(), F.desc("created_at"), "doc_id")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return documents.withColumn("retired", F.row_number().over(order) > 1).withColumn("kept_id", F.first("doc_id").over(whole))


def soft_delete(documents: DataFrame, vectors: DataFrame, gone: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """IDX5: stamped documents, and the vectors without theirs."""
    marked = documents.join(gone.select("doc_id", F.lit(True).alias("_gone")), "doc_id", "left")
    return marked.withColumn("deleted_at", F.when(F.col("_gone") & F.col("deleted_at").isNull(), at).otherwise(F.col("deleted_at"))).drop("_gone"), vectors.join(gone, "doc_id", "left_anti")


def activate(versions: DataFrame, version: str, at: Column) -> DataFrame:
    """IDX6: one version ready, ready ones before it stale."""
    own = F.col("version") == version
    return versions.withColumn("activated_at", F.when(own, at).otherwise(F.col("activated_at"))).withColumn("state", F.when(own, "ready").when(F.col("state") == "ready", "stale").otherwise(F.col("state")))


def ready_versions(versions: DataFrame) -> DataFrame:
    """IDX6: newest first."""
    return versions.where("state = 'ready'").withColumn("place", F.row_number().over(Window.orderBy(F.desc_nulls_last("activated_at"), F.desc("created_at"), "version")))


def collect_garbage(versions: DataFrame, index: DataFrame, version: str) -> tuple[DataFrame, int]:
    """IDX6: the index without a version's chunks and how many went; a ready version is refused."""
    if versions.where((F.col("version") == version) & (F.col("state") == "ready")).limit(1).count():
        raise ValueError(f"version {version} is ready")
    return index.where(F.col("index_version") != version), index.where(F.col("index_version") == version).count()


def route(queries: DataFrame, versions: DataFrame) -> DataFrame:
    """IDX7: queries with the version that serves them: the newest for its share by hash of the id, else the second."""
    ready = ready_versions(versions)
    one = ready.where("place <= 2").groupBy().agg(F.max(F.when(F.col("place") == 1, F.col("version"))).alias("_new"), F.max(F.when(F.col("place") == 2, F.col("version"))).alias("_old"), F.max(F.when(F.col("place") == 1, F.col("traffic_ratio"))).alias("_ratio"))
    share = F.conv(fnv1a32(F.col("query_id").cast("string")), 16, 10).cast("long") % 1000
    return queries.crossJoin(F.broadcast(one)).withColumn("index_version", F.when(F.col("_old").isNull() | (share < F.floor(F.col("_ratio") * 1000)), F.col("_new")).otherwise(F.col("_old"))).drop("_new", "_old", "_ratio")


def pending(documents: DataFrame, done: DataFrame) -> DataFrame:
    """IDX8: documents of a rebuild that are still to do."""
    return documents.join(done.select("doc_id").distinct(), "doc_id", "left_anti")


def progress(documents: DataFrame, done: DataFrame) -> DataFrame:
    marked = documents.select("doc_id").distinct().join(done.select("doc_id", F.lit(1).alias("d")).distinct(), "doc_id", "left")
    return marked.agg(F.count("*").alias("total"), F.count("d").alias("done"), F.count_if(F.col("d").isNull()).alias("pending"))


def missing_keys(needed: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """IDX9: keys without a row in `held`."""
    return needed.select(key).distinct().join(held.select(key).distinct(), key, "left_anti")


def foreign_vectors(held: DataFrame, model: str, scheme: str, size: int) -> DataFrame:
    """IDX9: vectors of another model, prefix scheme or size than the index asks for, with what is wrong."""
    wrong = F.when(F.col("model") != model, "model").when(F.col("scheme") != scheme, "scheme").when(F.size("vector") != size, "size")
    return held.withColumn("wrong", wrong).where(F.col("wrong").isNotNull())


def assert_consistent(needed: DataFrame, held: DataFrame, key: str, what: str) -> None:
    """IDX9: an error that names some of the keys without a row in `held`."""
    lost = missing_keys(needed, held, key)
    some = [str(r[0]) for r in lost.orderBy(key).limit(5).collect()]
    if some:
        raise ValueError(f"{lost.count()} keys without {what}, such as {', '.join(some)}")


def list_documents(chunks: DataFrame) -> DataFrame:
    """IDX10."""
    return chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))


def outline(chunks: DataFrame) -> DataFrame:
    """IDX11: runs of consecutive chunks under one heading path, with their pages."""
    order = Window.partitionBy("doc_id").orderBy("ord")
    new = F.coalesce(~F.col("heading").eqNullSafe(F.lag("heading").over(order)), F.lit(True)) | (F.row_number().over(order) == 1)
    return chunks.withColumn("_new", new.cast("int")).withColumn("run", F.sum("_new").over(order)).groupBy("doc_id", "run", "heading").agg(F.min("ord").alias("ord_start"), F.max("ord").alias("ord_end"), F.min("page").alias("page_start"), F.max("page").alias("page_end"), F.count("*").alias("chunks"))


def read_range(chunks: DataFrame, requests: DataFrame, most: int = 8, most_chars: int = 6000) -> DataFrame:
    """IDX12: request_id, content, chunks read, and flags. requests: request_id, doc_id, low, high, clamped to the document."""
    bounds = chunks.groupBy("doc_id").agg(F.min("ord").alias("_lo"), F.max("ord").alias("_hi"))
    asked = requests.join(bounds, "doc_id").withColumn("_a", F.greatest(F.col("low"), F.col("_lo"))).withColumn("_b", F.least(F.col("high"), F.col("_hi")))
    rows = asked.join(chunks, "doc_id").where(F.col("ord").between(F.col("_a"), F.col("_b")))
    place = Window.partitionBy("request_id").orderBy("ord")
    read = rows.withColumn("_n", F.row_number().over(place)).withColumn("_c", F.sum(F.length("content")).over(place)).where((F.col("_n") <= most) & ((F.col("_c") <= most_chars) | (F.col("_n") == 1)))
    texts = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "content"))), lambda x: x["content"]), "\n")
    wanted = F.max(F.col("_b") - F.col("_a") + 1)
    return read.groupBy("request_id").agg(F.substring(texts, 1, most_chars).alias("content"), F.count("*").alias("chunks"), (F.count("*") < wanted).alias("cut"), (F.max("low") < F.max("_lo")).alias("clamped_low"), (F.max("high") > F.max("_hi")).alias("clamped_high"))


GRAM = 3


def grams(text: Column, n: int = GRAM) -> Column:
    """Distinct pieces of n characters."""
    return F.when(F.length(text) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substring(text, i, F.lit(n))))).otherwise(F.array().cast("array<string>"))


def names_holding(names: DataFrame, documents: DataFrame) -> DataFrame:
    """IDX13: reference, n (names that hold it, in any case), doc_id (the least).

    An index of trigrams in place of a product: a reference meets the names that hold the one of its trigrams that the
    fewest names hold, and those are compared. References of one or two characters are looked up as such pieces.
    """
    asked = staged(names.select("reference", F.lower("reference").alias("_r")).where("_r <> ''").distinct(), "references")
    listed = documents.select("doc_id", F.lower("doc_name").alias("_name"))
    sizes = F.array(*[F.struct(F.lit(n).alias("size"), grams(F.col("_name"), n).alias("g")) for n in range(1, GRAM + 1)])
    own = asked.select("reference", "_r", F.least(F.length("_r"), F.lit(GRAM)).alias("size"))
    used = own.select("size").distinct()
    entries = staged(listed.select("doc_id", "_name", F.explode(sizes).alias("s")).select("doc_id", "_name", "s.size", F.explode("s.g").alias("gram")).join(F.broadcast(used), "size", "left_semi"), "grams")  # three rows
    counts = entries.groupBy("size", "gram").agg(F.count("*").alias("names"))
    pieces = own.select("reference", "_r", "size", F.explode(F.when(F.col("size") == 1, grams(F.col("_r"), 1)).when(F.col("size") == 2, grams(F.col("_r"), 2)).otherwise(grams(F.col("_r")))).alias("gram"))
    # a piece that no name holds counts 0 and leaves no candidate
    rarest = pieces.join(counts, ["size", "gram"], "left").groupBy("reference", "_r", "size").agg(F.min(F.struct(F.coalesce("names", F.lit(0)).alias("names"), "gram")).alias("p")).where("p.names > 0").select("reference", "_r", "size", "p.gram")
    met = rarest.join(entries, ["size", "gram"]).where(F.contains("_name", F.col("_r")))
    return met.groupBy("reference").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))


def resolve_reference(names: DataFrame, documents: DataFrame, substring: bool = True) -> DataFrame:
    """IDX13: reference, doc_id by exact name, else by id, else (with substring) by the only name that holds it, in any case."""
    d = documents.select("doc_id", "doc_name")
    exact = names.join(d, names.reference == d.doc_name).groupBy("reference").agg(F.min("doc_id").alias("by_name"))
    by_id = names.join(d, names.reference == d.doc_id).groupBy("reference").agg(F.min("doc_id").alias("by_id"))
    found = names.join(exact, "reference", "left").join(by_id, "reference", "left")
    if not substring:
        return found.select("reference", F.coalesce("by_name", "by_id").alias("doc_id"))
    part = names_holding(names, d).where("n = 1").select("reference", F.col("doc_id").alias("by_part"))
    return found.join(part, "reference", "left").select("reference", F.coalesce("by_name", "by_id", "by_part").alias("doc_id"))
