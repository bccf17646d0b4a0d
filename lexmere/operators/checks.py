"""Data quality: domains, references, keys and provenance, one pass over each table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmere.operators.chunks import TARGET

STATUSES = ("pending", "extracting", "extracted", "chunking", "chunked", "processing", "processed", "failed")


def domains(tables: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """(table, rule, violations) for rules that every row of a table meets; null counts as met."""
    parts = []
    for name, (df, rules) in tables.items():
        n = df.agg(*[F.count_if(~rule).alias(r) for r, rule in rules.items()])
        pairs = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("violations")) for r in rules]))
        parts.append(n.select(F.lit(name).alias("table"), pairs.alias("p")).select("table", "p.rule", "p.violations"))
    return reduce(DataFrame.unionByName, parts)


def orphans(links: dict[str, tuple[DataFrame, str, DataFrame, str]]) -> DataFrame:
    """(link, orphans) for (child, column, parent, column); null links are none."""
    count = lambda name, c, k, p, pk: c.where(F.col(k).isNotNull()).join(p.select(F.col(pk).alias(k)), k, "left_anti").agg(F.count("*").alias("orphans")).select(F.lit(name).alias("link"), "orphans")
    return reduce(DataFrame.unionByName, [count(n, *x) for n, x in links.items()])


def repeated(keys: dict[str, tuple[DataFrame, list[str]]]) -> DataFrame:
    """(key, repeated): key values that more than one row has."""
    count = lambda n, df, k: df.groupBy(*k).count().where("count > 1").agg(F.count("*").alias("repeated")).select(F.lit(n).alias("key"), "repeated")
    return reduce(DataFrame.unionByName, [count(n, *x) for n, x in keys.items()])


def provenance(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(chunks, wrong): chunks whose text is not the document's at their offsets."""
    d = documents.select(F.col("id").alias("document_id"), "text_content")
    shown = F.substring("text_content", (F.col("offset_start") + 1).cast("int"), (F.col("offset_end") - F.col("offset_start")).cast("int"))
    return chunks.join(d, "document_id").agg(F.count("*").alias("chunks"), F.count_if(shown != F.col("text")).alias("wrong"))


def chunk_sizes(chunks: DataFrame, target: int = TARGET) -> DataFrame:
    """(chunks, too_long, pages_wrong)."""
    return chunks.agg(F.count("*").alias("chunks"), F.count_if(F.length("text") > 1.5 * target).alias("too_long"), F.count_if(F.col("page_start") > F.col("page_end")).alias("pages_wrong"))
