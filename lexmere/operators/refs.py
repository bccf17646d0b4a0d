"""Quotations located in their chunks, and references on pages."""

from __future__ import annotations

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexmere.operators.chunks import page_at
from lexmere.session import small, stored

#: Quotes of a chunk that are searched together, about; quotes that are searched one by one: shorter ones, and those of a chunk that has few.
PART, SHORT, FEW = 20_000, 3, 8


def positions(text: str, quotes: list[str]) -> list[int]:
    """First place of each quote in a text, -1 where it is not. All longer quotes are searched in one pass over the text (Aho-Corasick)."""
    found = [-1] * len(quotes)
    many = [i for i, q in enumerate(quotes) if len(q) >= SHORT]
    if len(many) < FEW:
        return [text.find(q) for q in quotes]
    for i in set(range(len(quotes))).difference(many):
        found[i] = text.find(quotes[i])
    of: dict[str, list[int]] = {}
    for i in many:
        of.setdefault(quotes[i], []).append(i)
    words = ahocorasick.Automaton()
    for q, places in of.items():
        words.add_word(q, (len(q), places))
    words.make_automaton()
    left = len(of)
    for end, (n, places) in words.iter(text):
        if found[places[0]] < 0:
            for i in places:
                found[i] = end - n + 1
            left -= 1
            if not left:
                break
    return found


def _searched(texts: pa.Table, quotes: pa.Table) -> pa.Table:
    """One chunk and a part of its quotes: as written, and what that misses in lower case."""
    asked = quotes.column("quote").to_pylist()
    if texts.num_rows and asked:
        # of rows that repeat a chunk the first by offset and text counts
        text, start = min(zip(texts.column("text").to_pylist(), texts.column("offset_start").to_pylist()), key=lambda x: (x[1] is None, x[1] or 0, x[0] is None, x[0] or ""))
        text = text or ""
        at = positions(text, asked)
        missed = [i for i, p in enumerate(at) if p < 0]
        if missed:
            for i, p in zip(missed, positions(text.lower(), [asked[i].lower() for i in missed])):
                at[i] = p
        found = [None if p < 0 or start is None else p + start for p in at]
    else:
        found = [None] * len(asked)
    return pa.table([quotes.column("document_id"), quotes.column("chunk_index"), quotes.column("quote"), pa.array(found, pa.int64())], names=["document_id", "chunk_index", "quote", "at"])


def located(quotes: DataFrame, chunks: DataFrame, part: int = PART) -> DataFrame:
    """Distinct (document_id, chunk_index, quote) -> with `at`, the quote's place in the document's characters, null if it is not in its chunk.

    A chunk's text is shuffled once and met by all its quotes together, in
    parts of about `part` where it has more. Quotes are looked for as written,
    then in any letter case; chunks without quotes are not sent at all.
    """
    keys = ["document_id", "chunk_index"]
    counts = quotes.groupBy(*keys).agg(F.count("*").alias("n"))
    texts = chunks.select(*[F.col(k).cast(quotes.schema[k].dataType) for k in keys], "text", F.col("offset_start").cast("long").alias("offset_start"))
    kinds = ", ".join(f"{k} {quotes.schema[k].dataType.simpleString()}" for k in keys)
    search = lambda t, q, *by: t.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(_searched, f"{kinds}, quote string, at long")
    many = counts.where(F.col("n") > part).select(*keys, F.ceil(F.col("n") / part).cast("int").alias("parts"))
    if many.isEmpty():
        # dealt by the semi join's keys, texts stay where they are for the search
        return search(texts.join(counts, keys, "left_semi"), quotes, *keys)
    many = small(stored(many))
    usual = search(texts.join(counts.where(F.col("n") <= part), keys, "left_semi"), quotes.join(many, keys, "left_anti"), *keys)
    of = quotes.join(many, keys).withColumn("part", F.pmod(F.xxhash64("quote"), F.col("parts")).cast("int")).drop("parts")
    spread = texts.join(many, keys).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    return usual.unionByName(search(spread, of, *keys, "part"))


def resolved(refs: DataFrame, chunks: DataFrame) -> DataFrame:
    """Refs with spans in document characters where the quote is found in its chunk, else as they were; and found.

    Null and empty quotes, and references to chunks that are not there, are not
    found. Rows that repeat are each resolved; of chunks that repeat a key the
    first by offset counts.
    """
    keys = ["document_id", "chunk_index"]
    quotes = refs.select(*keys, F.col("verbatim_text").alias("quote")).where("quote <> '' and document_id is not null and chunk_index is not null").distinct()
    at = located(quotes, chunks).where("at is not null").select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("quote").alias("_quote"), F.col("at").alias("_at"))
    met = refs.join(at, [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("verbatim_text") == F.col("_quote")], "left")
    end = F.coalesce(F.col("_at") + F.length("verbatim_text"), F.col("span_end"))
    spans = {"span_start": F.coalesce(F.col("_at"), F.col("span_start")), "span_end": end}
    return met.select(*[spans[c].alias(c) if c in spans else F.col(c) for c in refs.columns], F.col("_at").isNotNull().alias("found"))


def summary(resolved_refs: DataFrame) -> DataFrame:
    """Found and all references per document."""
    return resolved_refs.groupBy("document_id").agg(F.count_if("found").alias("resolved"), F.count("*").alias("total"))


def rebuilt_pages(chunks: DataFrame) -> DataFrame:
    """E5: page boundaries from chunks: the first offset of each page that begins a chunk, 0 first, the last end last, also where it is the first (an empty text)."""
    firsts = chunks.groupBy("document_id", "page_start").agg(F.min_by("offset_start", "chunk_index").alias("o"), F.max("offset_end").alias("e"))
    found = firsts.groupBy("document_id").agg(F.array_sort(F.collect_list("o")).cast("array<bigint>").alias("inner"), F.max("e").cast("long").alias("e"))
    zero = F.array(F.lit(0).cast("long"))
    begins = F.when(F.try_element_at("inner", F.lit(1)) == 0, F.col("inner")).otherwise(F.concat(zero, "inner"))
    return found.select("document_id", F.concat(begins, F.array("e")).alias("page_offsets"))


def on_pages(refs: DataFrame, chunks: DataFrame, plain_text: bool = False) -> DataFrame:
    """(id, page_number, page_start, page_end): null for plain text, without chunks, or for spans outside the text."""
    met = refs.join(rebuilt_pages(chunks), "document_id", "left")
    inside = F.lit(not plain_text) & (F.size("page_offsets") > 1) & (F.col("span_start") >= 0) & (F.col("span_start") < F.element_at("page_offsets", -1)) & (F.col("span_end") <= F.element_at("page_offsets", -1)) & (F.col("span_end") >= F.col("span_start"))
    page = F.when(inside, page_at("span_start"))
    begin = F.try_element_at("page_offsets", F.coalesce(page, F.lit(1)))
    return met.select("id", page.alias("page_number"), F.when(inside, F.col("span_start") - begin).cast("long").alias("page_start"), F.when(inside, F.col("span_end") - begin).cast("long").alias("page_end"))
