"""Documents in: texts, blobs and pages become document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmere.functions import scalars as S
from lexmere.functions.arrays import running_sums

#: Largest blob, in bytes.
MOST_BYTES = 50 << 20


def base64_text(raw: Column) -> Column:
    """Base64 in one line."""
    return F.replace(F.base64(raw), F.lit("\r\n"), F.lit(""))


def texts(rows: DataFrame) -> DataFrame:
    """(id, text, filename, mime_type?) -> pending document rows with a base64 copy; the source group defaults to the id."""
    mime = F.coalesce("mime_type", F.lit("text/plain")) if "mime_type" in rows.columns else F.lit("text/plain")
    blob = base64_text(F.encode("text", "UTF-8"))
    source = F.coalesce("source_id", F.col("id").cast("string")) if "source_id" in rows.columns else F.col("id").cast("string")
    return rows.select("id", blob.alias("original_blob"), F.col("text").alias("text_content"), F.lit("pending").alias("status"), "filename", mime.alias("mime_type"), source.alias("source_id"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """A1: whole text files under a path."""
    name = F.element_at(F.split("_metadata.file_path", "/"), -1)
    return texts(spark.read.text(path, wholetext=True).select(S.key_id(F.col("_metadata.file_path")).alias("id"), F.col("value").alias("text"), name.alias("filename")))


def blob_files(spark: SparkSession, path: str) -> DataFrame:
    """A2: binary files under a path, gated (A3)."""
    name = F.element_at(F.split("path", "/"), -1)
    return gated(blobs(spark.read.format("binaryFile").load(path).select(S.key_id(F.col("path")).alias("id"), name.alias("filename"), F.col("length").alias("size"), "content")))


def blobs(rows: DataFrame) -> DataFrame:
    """A2: (id, filename, content, ...) -> with path doc/{id}{ext}, the content inline as base64."""
    ext = F.when(S.extension(F.col("filename")) != "", S.extension(F.col("filename"))).otherwise(".bin")
    return rows.withColumn("blob_path", F.concat(F.lit("doc/"), F.col("id").cast("string"), ext)).withColumn("original_blob", base64_text(F.col("content"))).drop("content")


def gated(rows: DataFrame) -> DataFrame:
    """With reject_reason, null for rows that may pass."""
    reason = F.when(F.coalesce(F.trim("filename"), F.lit("")) == "", "missing filename")
    if "size" in rows.columns:
        reason = reason.when(F.col("size") > MOST_BYTES, "too large")
    if "llm_mode" in rows.columns:
        reason = reason.when(~F.coalesce(F.lower(F.trim("llm_mode")), F.lit("")).isin("thinking", "instruct"), "bad mode")
    return rows.withColumn("reject_reason", reason)


def decoded(rows: DataFrame) -> DataFrame:
    """A4: original_blob -> text_content, or error_message where the bytes are no UTF-8."""
    raw = F.unbase64("original_blob")
    return rows.withColumn("text_content", F.try_validate_utf8(raw.cast("string"))).withColumn("error_message", F.when(F.col("text_content").isNull(), "the blob is not valid UTF-8"))


def routed(rows: DataFrame) -> DataFrame:
    """A5: with doc_format: by extension, then by mime type."""
    ext, mime = S.extension(F.col("filename")), F.lower(F.coalesce("mime_type", F.lit("")))
    kind = F.when(ext == ".pdf", "pdf").when(ext.isin(".txt", ".md"), "plain_text").when(mime == "application/pdf", "pdf").when(mime.startswith("text/"), "plain_text")
    return rows.withColumn("doc_format", kind.otherwise("unsupported"))


def running_offsets(pages: DataFrame) -> DataFrame:
    """Each page's begin in the assembled text: all earlier lengths and one form feed for each."""
    before = F.sum(F.length("text")).over(W.partitionBy("document_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, -1))
    return pages.withColumn("begin", (F.coalesce(before, F.lit(0)) + F.greatest(F.col("page_no"), F.lit(0))).cast("long"))


def assembled(pages: DataFrame) -> DataFrame:
    """(document_id, page_no from 0, text) -> (document_id, text_content, page_offsets): pages joined by form feeds, and their offsets.

    Page i from 1 on begins at the sum of earlier lengths plus i - 1, the last offset is the text's length.
    """
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("page_no", "text"))), lambda p: p["text"])
    out = pages.groupBy("document_id").agg(ordered.alias("p"))
    text = F.array_join("p", chr(12))
    ends = F.transform(running_sums(F.transform("p", F.length)), lambda e, i: (e + i).cast("int"))
    inner = F.slice(ends, 1, F.size("p") - 1)
    return out.select("document_id", text.alias("text_content"), F.concat(F.array(F.lit(0)), inner, F.array(F.length(text))).alias("page_offsets"))


def quality(docs: DataFrame) -> DataFrame:
    """With page_count and quality_reason: empty, empty_or_scanned, likely_scanned, or null."""
    n = F.size("page_offsets") - 1
    kept = F.length(F.trim("text_content"))
    reason = F.when(n <= 0, "empty").when(kept == 0, "empty_or_scanned").when((kept < 50) & (n > 1), "likely_scanned")
    return docs.withColumn("page_count", n).withColumn("quality_reason", reason)


def estimated_pages(docs: DataFrame) -> DataFrame:
    """A page for every 3,000 characters begun, one at least."""
    return docs.select("id", F.greatest(F.lit(1), F.ceil(F.length(F.coalesce("text_content", F.lit(""))) / 3000)).cast("long").alias("pages"))
