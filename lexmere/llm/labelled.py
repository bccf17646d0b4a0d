"""A bounded sample of labelled documents for the classifiers that are trained here."""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of the sample, and bytes of their texts.
ROWS, BYTES = 4000, 24 << 20


def held_out(doc_id: Column) -> Column:
    """True for the quarter of ids that no classifier learns from. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))


def held_out_id(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int = ROWS, most_bytes: int = BYTES) -> tuple[list[bytes], np.ndarray]:
    """(texts, labels) of at most `rows` labelled documents that are not held out, at most `most_bytes` bytes of text in all.

    The rows least by a hash of the id are taken, so the sample does not
    depend on partitions or the order of rows. Rows with a null text, id or
    label, or another label than 0 and 1, are not learned from, nor texts over
    a 64th of the bytes.
    """
    own = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("_y"))
    # labels may cover far more than these documents: only ids with a usable text count, and they are cut before their texts are looked up
    usable = docs.where(F.octet_length("text") <= most_bytes // 64)
    own = own.join(usable.select("doc_id"), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(rows)
    found = usable.select(F.col("doc_id"), F.col("text").alias("_t")).join(F.broadcast(own), "doc_id")
    got = found.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id", "_t").limit(rows)
    texts, ys, total = [], [], 0
    for r in got.select("_t", "_y").toLocalIterator():
        data = r["_t"].encode("utf-8", "replace")
        if total + len(data) <= most_bytes:
            texts.append(data)
            ys.append(int(r["_y"]))
            total += len(data)
    return texts, np.array(ys, np.float64)
