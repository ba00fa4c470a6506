"""FLT1-FLT4: what an identity may see. Apply these before any statistic is counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def alive(documents: DataFrame, version: str | None = None) -> DataFrame:
    """FLT4."""
    rows = documents.where(F.col("deleted_at").isNull()) if "deleted_at" in documents.columns else documents
    return rows.where(F.col("index_version") == version) if version is not None else rows


def may_see(tenant: Column, departments: Column, clearance: Column) -> Column:
    """FLT1: same tenant, classification within the clearance, a department of the list or none."""
    return (F.col("tenant_id") == tenant) & (F.col("classification") <= clearance) & ((F.col("department") == "") | F.array_contains(departments, F.col("department")))


def visible(documents: DataFrame, tenant: str, departments: list[str], clearance: int) -> DataFrame:
    return documents.where(may_see(F.lit(tenant), F.array(*[F.lit(d) for d in departments]).cast("array<string>"), F.lit(clearance)))


def views(documents: DataFrame, identities: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT1 for many identities: view_id and doc_id, one view for each distinct right; identity_id and its view_id.

    identities: identity_id, tenant, departments, clearance. Statistics by view_id are then counted once a right.
    """
    named = identities.withColumn("departments", F.array_sort(F.array_distinct("departments"))).withColumn("view_id", F.sha1(F.concat_ws("\u0001", "tenant", F.array_join("departments", "\u0002"), F.col("clearance").cast("string"))))
    rights = named.select("view_id", "tenant", "departments", "clearance").dropDuplicates(["view_id"])
    seen = documents.join(rights, (F.col("tenant_id") == F.col("tenant")) & may_see(F.col("tenant"), F.col("departments"), F.col("clearance"))).select("view_id", "doc_id")
    return seen, named.select("identity_id", "view_id")


def visible_by_file(documents: DataFrame, entries: DataFrame, tenant: str | None, departments: list[str] | None, clearance: int | None, strict: bool, default: dict | None = None) -> DataFrame:
    """FLT2: rights kept in a file by document; a missing dimension is open, an unlisted document takes the default, or none in strict mode."""
    e = entries.select("doc_id", F.col("tenant").alias("_t"), F.col("department").alias("_d"), F.col("classification").alias("_c"), F.lit(True).alias("_listed"))
    rows = documents.join(e, "doc_id", "left")
    listed = F.coalesce("_listed", F.lit(False))
    value = lambda c, name: F.when(listed, F.col(c)).otherwise(F.lit((default or {}).get(name)))
    t, d, c = value("_t", "tenant").cast("string"), value("_d", "department").cast("string"), value("_c", "classification").cast("int")
    ok = F.lit(True)
    if tenant is not None:
        ok = ok & (t.isNull() | (t == tenant))
    if departments is not None:
        ok = ok & (d.isNull() | (d == "") | d.isin(departments))
    if clearance is not None:
        ok = ok & (c.isNull() | (c <= clearance))
    return rows.where((listed | F.lit(not strict)) & ok).drop("_t", "_d", "_c", "_listed")


def only_documents(chunks: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """FLT3: narrows what is visible, never widens it."""
    return chunks.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi")
